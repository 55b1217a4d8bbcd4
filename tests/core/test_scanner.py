import datetime as dt
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest

from cubeloom import cli
from cubeloom.plans.cubeset import CubeSet
from cubeloom.sources import tables
from cubeloom.streaming import scanner

DOC = {"selectors": [
    {"name": "old", "mode": "once", "selector": "class=od", "from_date": "20200101", "to_date": "20200102"},
    {"name": "none", "mode": "once", "selector": "class=xx", "from_date": "20200101", "to_date": "20200102"},
    {"name": "day", "mode": "schedule", "selector": "class=od/rd", "last_n_days": 1, "interval_hours": 2},
    {"name": "late", "mode": "schedule", "selector": "", "last_n_days": 0, "interval_hours": 6},
], "location": "here", "stagger_minutes": 90}


def source(spark):
    rows = [("od", "1", "20200101"), ("od", "2", "20200102"), ("rd", "1", "20200302"), ("xd", "1", "20200303")]
    return spark.createDataFrame(rows, "class string, param string, date string")


def test_intervals_and_documents(spark):
    stored, clock = [], [dt.datetime(2020, 3, 3)]
    config = scanner.Config.parse(json.dumps(DOC))

    def wait(seconds):
        clock[0] += dt.timedelta(seconds=seconds)

    ran = scanner.run(spark, source(spark), config, ["class", "param"], lambda n, d: stored.append((n, d)), lambda: clock[0], rounds=7, wait=wait, every=3_600)
    assert {n: len(t) for n, t in ran.items()} == {"old": 1, "none": 1, "day": 4, "late": 1}  # due at 0, 2, 4, 6 and at 2 o'clock
    assert [n for n, _ in stored].count("here_day.json") == 4 and not [n for n, _ in stored if "none" in n]
    docs = dict(stored)
    back = CubeSet.from_arena_json(spark, docs["here_day.json"])
    assert back.axes() == {"class": ["rd"], "param": ["1"]} and back.get_metadata({"class": "rd"}, "location") == ["here"]
    assert CubeSet.from_arena_json(spark, docs["here_old.json"]).axes() == {"class": ["od"], "param": ["1", "2"]}
    assert CubeSet.from_arena_json(spark, docs["here_late.json"]).axes() == {"class": ["xd"], "param": ["1"]}


def test_failures_and_configuration(spark):
    def broken(name, doc):
        raise OSError("store is down")

    config = scanner.Config.parse({"selectors": DOC["selectors"][:1]})
    assert len(scanner.run(spark, source(spark), config, ["class", "param"], broken)["old"]) == 1
    for bad in ({}, {"selectors": []}, {"selectors": [{"name": "a", "mode": "x"}]}, {"selectors": DOC["selectors"][:1] * 2}):
        with pytest.raises(ValueError):
            scanner.Config.parse(bad)


def test_sinks(spark, tmp_path):
    got = {}

    class Store(BaseHTTPRequestHandler):
        def do_PUT(self):
            got[self.path] = (self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    Thread(target=server.handle_request, daemon=True).start()
    scanner.to_store(f"http://127.0.0.1:{server.server_port}/", "k")("a.json", "{}")
    server.server_close()
    assert got == {"/files/a.json": ("Bearer k", b"{}")}
    scanner.to_folder(spark, f"file://{tmp_path}")("b.json", "[1]")
    assert (tmp_path / "b.json").read_text() == "[1]"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "l.txt").write_text("class=od,param=1/2\n")
    cli.main(["read", "listing", str(tmp_path / "l.txt")], spark)
    assert capsys.readouterr().out == 'root\n└── class=od\n    └── param=1/2\n{"cubes": 1, "identifiers": 2}\n'
    (tmp_path / "c.json").write_text(json.dumps(DOC | {"selectors": DOC["selectors"][:1]}))
    source(spark).write.parquet(str(tmp_path / "t"))
    cli.main(["scan", str(tmp_path / "c.json"), str(tmp_path / "t"), "class,param", "--folder", str(tmp_path / "out")], spark)
    again = cli.read(spark, "arena", str(tmp_path / "out" / "here_old.json"))
    assert again.axes() == {"class": ["od"], "param": ["1", "2"]}


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"origin": ["x"], "year": ["2", "1"], "day": []}, {"origin": ["y"], "year": ["1"]}]))
    cubes = tables.read_constraints(spark, str(tmp_path / "c.json"), ["origin", "year", "day"])
    assert sorted(map(tuple, cubes.collect())) == [(["x"], ["1", "2"], [None]), (["y"], ["1"], [None])]
    assert CubeSet.from_constraints(spark, str(tmp_path / "c.json"), ["origin", "year"]).identifier_count() == 3
    (tmp_path / "i.json").write_text('{"type": "fc", "param": "t", "levtype": "sfc"}\n{"type": "em", "param": "t"}\n{"type": "fc", "param": "z", "levtype": "sfc"}\n')
    assert [r["param"] for r in tables.read_index(spark, str(tmp_path / "i.json"), ["type", "param", "levtype"]).collect()] == ["t"]
