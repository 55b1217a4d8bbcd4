from cubeloom.sources import tables


def test_hrefs_of_any_case(spark):
    html = '<A HREF="x">1</A><a Href="/d/y">2</a><a href="z">3</a><a href="/other">4</a>'
    pages = spark.createDataFrame([("http://a.org/d/index", html)], "url string, html string")
    assert sorted(r.href for r in tables.hrefs(pages).collect()) == [f"http://a.org/d/{k}" for k in "xyz"]
