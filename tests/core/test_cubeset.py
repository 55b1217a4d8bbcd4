import json

import pytest

from cubeloom.operators import algebra as A
from cubeloom.operators import atoms, compression, metadata
from cubeloom.plans.cubeset import CubeSet
from cubeloom.sources import json_forms, text
from cubeloom.sources.tree import Tree


def draw(short: str) -> str:
    """``a=1{b=1/2};c=2`` as a drawn tree."""
    out, depth, cur = ["root"], 0, ""
    for ch in short + ";":
        if ch in "{};":
            if cur.strip():
                out.append("│   " * depth + "├── " + cur.strip())
            cur = ""
            depth += (ch == "{") - (ch == "}")
        else:
            cur += ch
    return "\n".join(out) + "\n"


def rows(short: str) -> set:
    tree = text.parse_ascii(draw(short))
    found = set()

    def open_(path, done):
        if not path:
            found.add(frozenset(done.items()))
            return
        (d, vs), *rest = path
        for v in vs:
            open_(rest, done | {d: str(v)})

    for p in tree.paths():
        open_(list(p.items()), {})
    return found


def got(s: CubeSet) -> set:
    return {frozenset((d, v) for d, v in r.asDict().items() if v is not None) for r in s.ids.collect()}


def cubes(s: CubeSet) -> list:
    return sorted(json.dumps(c, sort_keys=True) for c in s.to_datacubes())


def make(spark, short):
    return CubeSet.from_ascii(spark, draw(short))


G2 = "class=1{expver=0001{param=1;param=2};expver=0002{param=1;param=2}};class=2{expver=0001{param=1;param=2;param=3};expver=0002{param=1;param=2}}"


def test_compress_golden(spark):
    s = make(spark, G2)
    assert s.to_ascii() == (
        "root\n├── class=1\n│   └── expver=0001/0002\n│       └── param=1/2\n└── class=2\n    ├── expver=0001\n"
        "    │   └── param=1/2/3\n    └── expver=0002\n        └── param=1/2\n"
    )
    assert len(s) == 3 and s.identifier_count() == 9
    assert len(make(spark, "class=1{param=1;param=2};class=2{param=1/2}")) == 1  # nothing is lost, all is merged


def test_select_golden(spark):
    s = make(spark, G2)
    assert got(s.select({"class": [1], "param": 1})) == rows("class=1{expver=0001/0002{param=1}}")
    assert got(s.select({"param": ["1", "3"]})) == rows("class=1{expver=0001/0002{param=1}};class=2{expver=0001{param=1/3};expver=0002{param=1}}")
    assert got(s.select({"class": ["9"]})) == set()
    mixed = make(spark, "class=1{param=1};type=x{param=2}")
    assert got(mixed.select({"class": ["1"]})) == got(mixed)
    assert got(mixed.select({"class": ["1"]}, "prune")) == got(mixed.prune(["class"])) == rows("class=1{param=1}")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("class=1{param=1/2/3/4}", "class=1{param=2/3}", "class=1{param=1/4}"),
        ("class=1/2{expver=0001{param=1/2};expver=0002{param=1/2}}", "class=1{expver=0001{param=1}}", "class=1{expver=0001{param=2};expver=0002{param=1/2}};class=2{expver=0001/0002{param=1/2}}"),
        ("class=1{param=1};class=2{param=2}", "class=1", "class=2{param=2}"),
        ("class=1{param=1}", "class=1{param=1}", ""),
        ("class=1{param=1}", "class=3{param=1}", "class=1{param=1}"),
    ],
)
def test_subtract_golden(spark, a, b, want):
    assert got(make(spark, a) - make(spark, b)) == (rows(want) if want else set())


def test_union_golden(spark):
    u = make(spark, "class=1{param=1};class=2/3{param=5}") | make(spark, "class=1/2{param=7}")
    assert got(u) == rows("class=1{param=1/7};class=2{param=5/7};class=3{param=5}")
    assert got(make(spark, "a=1{b=2}") | make(spark, "a=1;a=3")) == rows("a=1{b=2};a=3")  # an extended identifier is absorbed
    with pytest.raises(TypeError):
        u.append_many([u, 1])


def test_dimensions_golden(spark):
    s = make(spark, "param=2t/tp{time=0/1/2}")
    assert list(s.expand({"inner": [1], "outer": [2]}).dims) == ["outer", "inner", "param", "time"]
    assert list(s.prepend({"dataset": "foo", "class": "od", "x": 1}, ["dataset", "class"]).dims) == ["dataset", "class", "param", "time"]
    assert s.coxpand("time", {"step": ["s1", "s2"]}).dimensions() == {"param", "step"}
    assert s.axes() == {"param": ["2t", "tp"], "time": ["0", "1", "2"]}
    assert s.contains("param") and not s.contains("level") and not s.contains("root")
    assert s.contains({"param": "2t"}) and s.contains({}) and not s.contains({"time": ["0", "999"]})
    assert s.contains(s.select({"param": "tp"})) and not s.select({"param": "tp"}).contains(s)
    with pytest.raises(TypeError):
        s.contains(5)
    with pytest.raises(ValueError):
        s.collapse(["time", "nope"])
    assert make(spark, "param=msl;param=2t{time=0}").common_dimensions() == {"param"}
    assert CubeSet.empty(spark).common_dimensions() == set() and CubeSet.empty(spark).is_empty()
    assert got(make(spark, "class=1{expver=1{param=1/2}}").squeeze()) == rows("param=1/2")
    assert got(s.drop(["param", "none"])) == rows("time=0/1/2")


def test_provenance(spark):
    s = make(spark, "class=1{param=100/200/300}")
    s = s.set_metadata({}, "loc", ["lumi"]).set_metadata({"class": 1}, "loc", ["b"]).set_metadata({"class": 1, "param": 200}, "loc", ["mn5", "lumi"])
    assert s.get_metadata({"class": 1, "param": 100}, "loc") == ["b"] and s.get_metadata({}, "loc") == ["lumi"]
    assert s.get_metadata({"class": 1}, "none") is None
    assert s.get_all_metadata({"class": 1, "param": 200}) == {"loc": ["lumi", "mn5"]}
    parts = s.partition_by_metadata("loc")
    assert {k: got(v) for k, v in parts.items()} == {"b": rows("class=1{param=100/300}"), "lumi": rows("class=1{param=200}"), "mn5": rows("class=1{param=200}")}
    assert s.set_metadata({"class": 1}, "loc", []).get_metadata({"class": 1}, "loc") is None


def test_forms_round_trip(spark):
    s = make(spark, G2)
    for make_, doc in [
        (CubeSet.from_ascii, s.to_ascii()), (CubeSet.from_json, s.to_json()), (CubeSet.from_arena_json, json.dumps(s.to_arena_json())), (CubeSet.from_tree_json, s.to_tree_json()),
    ]:
        assert got(make_(spark, doc)) == got(s)
    assert got(CubeSet.from_paths(spark, ["class=od,expver=0001,param=1/2"])) == rows("class=od{expver=0001{param=1/2}}")
    assert text.to_ascii(text.parse_listing("alpha=0,beta=1/2\n  gamma=3\ndelta=4")) == "root\n├── alpha=0\n│   └── beta=1/2\n│       └── gamma=3\n└── delta=4\n"
    assert text.to_ascii(text.parse_listing("\n\n")) == "root\n"
    for bad in ("x", "root\n  a=1", "root\n        a=1", "root\n├── a"):
        with pytest.raises(TypeError):
            CubeSet.from_ascii(spark, bad)
    with pytest.raises(ValueError):
        json_forms.from_arena({"version": "2", "qube": []})
    with pytest.raises(TypeError):
        json_forms.coords_from_json([1, "a"])
    with pytest.raises(OverflowError):
        json_forms.coords_from_json([2**40])
    assert json_forms.to_datacubes(Tree()) == []


def test_random_laws(spark):
    import random

    rng = random.Random(8)
    some = lambda n: spark.createDataFrame([tuple(rng.randint(0, 3) for _ in range(3)) for _ in range(n)], "a int, b int, c int").distinct()
    a, b = some(40), some(30)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    x, y = as_set(a), as_set(b)
    cubes_a, cubes_b = compression.cubes(a), compression.cubes(b)
    opened = compression.explode(cubes_a)
    assert as_set(opened) == x and opened.count() == len(x)  # lossless, and no identifier twice
    for how, want in {"union": x | y, "subtract": x - y, "intersect": x & y, "symmetric_difference": x ^ y}.items():
        out = compression.explode(atoms.combine(how, cubes_a, cubes_b))
        assert as_set(out) == want and out.count() == len(want)
    assert as_set(A.union(A.subtract(a, b), A.intersect(a, b))) == x


@pytest.mark.parametrize("how", ["union", "subtract", "intersect", "symmetric_difference"])
def test_atoms_with_absent_values_and_empty_sets(spark, how):
    frame = lambda rows: spark.createDataFrame(rows, "a string, b int, c int")
    one = {(a, b, c) for a in ("x", "y", None) for b in (1, 2, None) for c in (1, 2, 3)} | {("z", None, None)}
    two = {(a, b, c) for a in ("y", None, "z") for b in (2, None) for c in (3, 4, None)}
    want = {"union": set.union, "subtract": set.difference, "intersect": set.intersection, "symmetric_difference": set.symmetric_difference}[how]
    for x, y in ((one, two), (set(), two)):
        out = atoms.combine(how, compression.cubes(frame(list(x))), compression.cubes(frame(list(y))))
        rows = [tuple(r) for r in compression.explode(out).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want(x, y)


def values(s: CubeSet, key="location") -> dict:
    """The identifiers of each value, as ``partition_by_metadata`` has them, in one job."""
    out: dict = {}
    for r in metadata.partition(s.resolve(), key).collect():
        out.setdefault(r["value"], set()).add(frozenset((d, v) for d, v in r.asDict().items() if d != "value" and v is not None))
    return out


def test_union_keeps_provenance_by_identifier(spark):
    a = make(spark, "class=1{param=1}").set_metadata({}, "location", ["X"])
    b = make(spark, "class=1{param=2}").set_metadata({}, "location", ["Y"])
    assert values(a.union(b)) == {"X": rows("class=1{param=1}"), "Y": rows("class=1{param=2}")}
    assert values(a | make(spark, "class=1{param=2}")) == {"X": rows("class=1{param=1}")}
    assert values(make(spark, "class=1{param=2}") | a) == {"X": rows("class=1{param=1}")}
    c = make(spark, "class=1{param=1/2};class=2{kind=x}").set_metadata({"class": "1"}, "location", ["Z"])
    every = a.append_many([b, c])
    assert values(every) == {"X": rows("class=1{param=1}"), "Y": rows("class=1{param=2}"), "Z": rows("class=1{param=1/2}")}
    assert every.get_metadata({"class": "1", "param": "1"}, "location") == ["X", "Z"]
    assert every.get_metadata({"class": "1"}, "location") is None and every.get_all_metadata({}) == {}
    same = make(spark, "class=1{param=1}").set_metadata({}, "location", ["Y"])
    assert (a | same).get_all_metadata({}) == {"location": ["X", "Y"]}  # sets of one shape agree at the root
    assert values(a & c) == {"X": rows("class=1{param=1}"), "Z": rows("class=1{param=1}")}
    assert values(c ^ a) == {"Z": rows("class=1{param=2}")}
    again = every.set_metadata({"class": "2"}, "location", ["W"])
    assert values(again)["W"] == rows("class=2{kind=x}") and values(again)["Z"] == rows("class=1{param=1/2}")


def test_reshaping_keeps_provenance(spark):
    s = make(spark, "class=1{param=1/2{step=0/6}};class=2{param=1{step=0}}").set_metadata({"class": "1"}, "location", ["X"]).set_metadata({"class": "2"}, "location", ["Y"])
    assert values(s.drop(["class"])) == {"X": rows("param=1/2{step=0/6}"), "Y": rows("param=1{step=0}")}
    assert values(s.collapse("param").expand({"type": ["a", "b"]})) == {"X": rows("type=a/b{class=1{step=0/6}}"), "Y": rows("type=a/b{class=2{step=0}}")}
    assert values(s.prepend({"kind": "k"})) == {"X": rows("kind=k{class=1{param=1/2{step=0/6}}}"), "Y": rows("kind=k{class=2{param=1{step=0}}}")}
    assert values(s.select({"class": "2"}).squeeze()) == {"Y": {frozenset()}}  # one identifier: no dimension is left
    assert values(s.select({"step": [0]}).squeeze()) == {"X": rows("class=1{param=1/2}"), "Y": rows("class=2{param=1}")}
    assert s.coxpand("step", {"n": [1]}).get_metadata({"n": 1, "class": "2"}, "location") == ["Y"]
    node = {r["node_id"]: r["vals"] for r in s.node_metadata().collect()}
    named = {(r["dim"], "/".join(r["coords"])): node.get(r["node_id"]) for r in s.nodes().collect()}
    assert named["class", "1"] == ["X"] and named["class", "2"] == ["Y"] and all(named.values())


def test_values_in_the_node_array(spark):
    s = make(spark, "class=1{param=1/2/3};class=2{param=1/2/3}").set_metadata({}, "owner", ["me"]).set_metadata({"class": "1"}, "location", ["X"])
    s = s.set_metadata({"class": "2", "param": "2"}, "location", ["Y"]).set_metadata({"class": "2", "param": "3"}, "location", ["Z"]).set_metadata({"class": "2", "param": "1"}, "n", [7])
    doc = s.to_arena_json()
    assert doc["qube"][0]["metadata"] == {"owner": {"strings": ["me"]}}
    assert any(r.get("metadata", {}).get("location") == {"per_coord_strings": [["Y"], ["Z"]]} and r["coords"] == {"ints": [2, 3]} for r in doc["qube"])
    assert any(r.get("metadata", {}).get("n") == {"ints": [7]} for r in doc["qube"])
    back = CubeSet.from_arena_json(spark, json.dumps(doc))
    assert got(back) == got(s) and values(back) == values(s) and values(back, "n") == values(s, "n")
    assert back.get_metadata({"class": "2", "param": "3"}, "owner") == ["me"] and back.get_metadata({"class": "1"}, "location") == ["X"]
    odd = {"version": "1", "qube": [{"dim": "root", "coords": None, "parent": None, "metadata": {"k": {"strings": ["r"]}}}, {"dim": "a", "coords": {"ints": [1, 2]}, "parent": 0, "metadata": {"k": {"per_coord_strings": [["x"]]}}},
           {"dim": "b", "coords": {"ints": [1]}, "parent": 1}, {"dim": "b", "coords": {"ints": [9]}, "parent": 0}, {"dim": "a", "coords": {"ints": [5]}, "parent": 3, "metadata": {"k": {"strings": ["y"]}}}]}
    turned = CubeSet.from_arena_json(spark, odd)  # two orders of dimensions: kept by identifier
    assert values(turned, "k") == {"x": rows("a=1/2{b=1}"), "y": rows("b=9{a=5}")}


def test_copies(spark):
    import copy

    s = make(spark, G2).set_metadata({}, "k", ["v"])
    for c in (copy.copy(s), copy.deepcopy(s), s.clone_qube()):
        assert c is not s and got(c) == got(s) and c.get_metadata({}, "k") == ["v"]
    assert repr(s) == str(s) == s.to_ascii()
