"""Queries over whole tables for every operator, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import coords as C
from cubeloom.operators import algebra as A
from cubeloom.operators import atoms, compression, metadata, navigation
from cubeloom.operators.materialise import shared_dir, written
from cubeloom.plans.cubeset import CubeSet
from cubeloom.sources import json_forms, tables, text
from cubeloom.sources.tree import to_frame
from cubeloom.streaming import scanner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def _ids(spark: SparkSession, sf: str, table: str, *dims: str, where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    rows = rows.where(where) if where else rows
    return rows.select(*dims).distinct()


LINE = ("l_returnflag", "l_linestatus", "l_linenumber")
PART = ("p_brand", "p_type")
ORDER = ("o_orderstatus", "o_orderpriority")
CUST = ("c_mktsegment", "c_nationkey")
#: Two overlapping sets that cover all orders, and a third across them.
A_WHERE, B_WHERE, C_WHERE = "o_totalprice < 200000", "o_totalprice >= 120000", "o_totalprice BETWEEN 60000 AND 150000"


def _orders(spark, sf):
    return tuple(_ids(spark, sf, "orders", *ORDER, "o_custkey", where=w) for w in (A_WHERE, B_WHERE))


_O = "o_orderstatus, o_orderpriority, o_custkey"
_AB = f"WITH a AS (SELECT DISTINCT {_O} FROM orders WHERE {A_WHERE}), b AS (SELECT DISTINCT {_O} FROM orders WHERE {B_WHERE})"


def _text_cubes(cubes: DataFrame) -> DataFrame:
    return cubes.select(*[C.joined(F.col(d)).alias(d) for d in cubes.columns])


_S = "array_to_string(list_transform(list_sort(list(DISTINCT {0})), lambda x: CAST(x AS VARCHAR)), '/')"
_PART3 = f"""WITH l3 AS (SELECT p_brand, p_type, {_S.format('p_size')} AS p_size FROM part GROUP BY 1, 2),
    n2 AS (SELECT p_brand, {_S.format('p_type')} AS p_type, p_size FROM l3 GROUP BY p_brand, p_size),
    s1 AS (SELECT p_brand, string_agg(p_type || ':' || p_size, ';' ORDER BY p_type || ':' || p_size) AS sig FROM n2 GROUP BY p_brand),
    n1 AS (SELECT {_S.format('p_brand')} AS p_brand, min(p_brand) AS one, sig FROM s1 GROUP BY sig),
    cubes AS (SELECT n1.p_brand, n2.p_type, n2.p_size FROM n1 JOIN n2 ON n2.p_brand = n1.one)"""
#: An irregular set of up to 70,000 identifiers: orders dealt to groups, parts to classes, and line numbers.
TREE = ("a", "b", "c")
_TREE_SQL = "SELECT DISTINCT l_orderkey % 1000 AS a, l_partkey % 10 AS b, l_linenumber AS c FROM lineitem"
_CUBES3 = f"""WITH t AS ({_TREE_SQL}), l3 AS (SELECT a, b, {_S.format('c')} AS c FROM t GROUP BY 1, 2),
    n2 AS (SELECT a, {_S.format('b')} AS b, c FROM l3 GROUP BY a, c),
    s1 AS (SELECT a, string_agg(b || ':' || c, ';' ORDER BY b || ':' || c) AS sig FROM n2 GROUP BY a),
    n1 AS (SELECT {_S.format('a')} AS a, min(a) AS one, sig FROM s1 GROUP BY sig),
    cubes AS (SELECT n1.a, n2.b, n2.c FROM n1 JOIN n2 ON n2.a = n1.one)"""
_PAIR_SQL = "SELECT DISTINCT l_orderkey % 5000 AS a, l_linenumber AS c FROM lineitem"
_CUBES2 = f"""WITH l2 AS (SELECT a, {_S.format('c')} AS c FROM ({_PAIR_SQL}) GROUP BY a), cubes AS (SELECT {_S.format('a')} AS a, c FROM l2 GROUP BY c)"""


def _tree(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select((F.col("l_orderkey") % 1000).alias("a"), (F.col("l_partkey") % 10).alias("b"), F.col("l_linenumber").alias("c")).distinct()


def _pairs(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") % 5000).alias("a"), F.col("l_linenumber").alias("c")).distinct()


def _line(spark, sf):
    return _ids(spark, sf, "lineitem", *LINE)


# sources


@query(f"SELECT DISTINCT {', '.join(LINE)} FROM lineitem")
def scan_identifiers(spark, sf):
    return tables.scan(spark, f"{sf}/lineitem.parquet", list(LINE))


@query("SELECT 0::BIGINT AS identifiers")
def empty_qube(spark, sf):
    return spark.createDataFrame([], "a string").agg(F.count(F.lit(1)).alias("identifiers"))


@query("SELECT count(*) = 0 AS is_empty FROM orders WHERE o_orderstatus = 'none'")
def is_empty(spark, sf):
    return _ids(spark, sf, "orders", *ORDER, where="o_orderstatus = 'none'").agg((F.count(F.lit(1)) == 0).alias("is_empty"))


_DRAWN = """root
├── class=1
│   ├── expver=0001/0002
│   │   └── param=1/2
│   └── expver=0003
│       └── param=od
└── class=2
    └── expver=0001
        └── param=1/2/3
"""
_DRAWN_SQL = """SELECT * FROM (VALUES ('1','0001','1'),('1','0001','2'),('1','0002','1'),('1','0002','2'),('1','0003','od'),
    ('2','0001','1'),('2','0001','2'),('2','0001','3')) t("class", expver, param)"""


@query(_DRAWN_SQL)
def parse_ascii(spark, sf):
    return to_frame(spark, text.parse_ascii(_DRAWN))


@query(_DRAWN_SQL)
def parse_json(spark, sf):
    doc = {"class=1": {"expver=0001/0002": {"param=1/2": {}}, "expver=0003": {"param=od": {}}}, "class=2": {"expver=0001": {"param=1/2/3": {}}}}
    return to_frame(spark, json_forms.from_nested(json.dumps(doc)))


@query(_DRAWN_SQL)
def arena_roundtrip(spark, sf):
    return to_frame(spark, json_forms.from_arena(json.dumps(json_forms.to_arena(text.parse_ascii(_DRAWN)))))


@query(_DRAWN_SQL)
def tree_roundtrip(spark, sf):
    return to_frame(spark, json_forms.from_tree_json(json.dumps(json_forms.to_tree_json(text.parse_ascii(_DRAWN)))))


@query("SELECT a::VARCHAR AS param, b::VARCHAR AS \"time\", 'od' AS \"class\" FROM (VALUES ('2t'), ('tp')) x(a), (VALUES (0), (6), (12)) y(b)")
def from_datacube(spark, sf):
    return to_frame(spark, json_forms.from_datacube({"class": "od", "param": ["2t", "tp"], "time": [0, 6, 12]}, ["param"]))


@query("SELECT * FROM (VALUES ('0','1','3',NULL),('0','2','3',NULL),(NULL,NULL,NULL,'4')) t(alpha, beta, gamma, delta)")
def mars_list(spark, sf):
    return to_frame(spark, text.parse_listing("alpha=0,beta=1/2\n  gamma=3\ndelta=4"))


@query("SELECT * FROM (VALUES ('od','0001','1'),('od','0001','2'),('rd',NULL,'3')) t(\"class\", expver, param)")
def fdb_list(spark, sf):
    rows = spark.createDataFrame([("class=od,expver=0001,param=1/2",), ("class=rd,expver=,param=3",), ("param=2, class=od,expver=0001",)], "value string")
    return text.read_path_list(rows, ["class", "expver", "param"])


@query(
    """SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS "year" FROM orders""",
    name="path_list",
)
def _path_list(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    lines = rows.select(F.concat(F.lit("status="), "o_orderstatus", F.lit(",priority="), "o_orderpriority", F.lit(",year="), F.year("o_orderdate").cast("string")).alias("value"))
    return text.read_path_list(lines, ["status", "priority", "year"])


@query("SELECT DISTINCT 'root' AS parent_id, 'p_brand' AS dim, p_brand AS coords FROM part")
def build_nodes(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("root").alias("parent_id"), F.lit("p_brand").alias("dim"), F.array("p_brand", "p_brand").alias("coords"))
    return navigation.build(rows).select("parent_id", "dim", F.array_join("coords", "/").alias("coords"))


# filters

_SEL = f"SELECT DISTINCT {', '.join(ORDER)} FROM orders WHERE "


@query(_SEL + "o_orderstatus = 'F'")
def select_one(spark, sf):
    return A.select(_ids(spark, sf, "orders", *ORDER), {"o_orderstatus": "F"})


@query(_SEL + "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def select_two(spark, sf):
    return A.select(_ids(spark, sf, "orders", *ORDER), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query(_SEL + "o_orderpriority IN ('1-URGENT', '2-HIGH')")
def select_multi_value(spark, sf):
    return A.select(_ids(spark, sf, "orders", *ORDER), {"o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query(f"SELECT DISTINCT {', '.join(LINE)} FROM lineitem WHERE l_linenumber IN (2, 5)")
def select_deep(spark, sf):
    return A.select(_ids(spark, sf, "lineitem", *LINE), {"l_linenumber": [2, 5]})


_IRR = """WITH irr AS (SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority, NULL::INT AS line FROM orders
    UNION SELECT DISTINCT l_linestatus, NULL, l_linenumber FROM lineitem) """


def _irregular(spark, sf):
    a = _ids(spark, sf, "orders", *ORDER).toDF("status", "priority")
    return A.union(a, _ids(spark, sf, "lineitem", "l_linestatus", "l_linenumber").toDF("status", "line"))


@query(_IRR + "SELECT * FROM irr WHERE (priority IS NULL OR priority IN ('1-URGENT')) AND status = 'F'")
def select_irregular(spark, sf):
    return A.select(_irregular(spark, sf), {"priority": ["1-URGENT"], "status": ["F"]})


@query(_IRR + "SELECT * FROM irr WHERE priority IN ('1-URGENT') AND status = 'F'")
def select_prune(spark, sf):
    return A.select(_irregular(spark, sf), {"priority": ["1-URGENT"], "status": ["F"]}, "prune")


@query(_IRR + "SELECT * FROM irr WHERE priority IS NOT NULL AND status IS NOT NULL")
def prune_dims(spark, sf):
    return A.prune(_irregular(spark, sf), ["priority", "status"])


@query(_IRR + "SELECT 'line' AS dim, count(line) > 0 AS contained FROM irr UNION ALL SELECT 'none', count(*) < 0 FROM irr")
def contains_dim(spark, sf):
    ids = _irregular(spark, sf)
    return A.contains_dim(ids, "line").select(F.lit("line").alias("dim"), "contained").unionByName(A.contains_dim(ids, "none").select(F.lit("none").alias("dim"), "contained"))


@query(_IRR + "SELECT 'in' AS what, bool_or(status = 'F') AND bool_or(CAST(line AS VARCHAR) = '3') AS contained FROM irr UNION ALL SELECT 'out', coalesce(bool_or(priority = 'none'), FALSE) FROM irr")
def contains_values(spark, sf):
    ids = _irregular(spark, sf)
    asked = {"in": {"status": ["F"], "line": "3"}, "out": {"priority": ["none"]}}
    return A.union(*[A.contains_values(ids, r).select(F.lit(k).alias("what"), "contained") for k, r in asked.items()])


@query(
    f"""{_AB} SELECT NOT EXISTS (SELECT 1 FROM b WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM a))
    AND NOT EXISTS (SELECT 1 FROM b WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM a))
    AND NOT EXISTS (SELECT 1 FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)) AS contained"""
)
def contains_qube(spark, sf):
    return A.contains_set(*_orders(spark, sf))


# set operations


@query(f"{_AB} SELECT * FROM a UNION SELECT * FROM b")
def union(spark, sf):
    return A.union(*_orders(spark, sf))


@query(
    f"""WITH u AS (SELECT DISTINCT {', '.join(ORDER)}, NULL::INT AS y FROM orders WHERE {A_WHERE} UNION SELECT DISTINCT {', '.join(ORDER)}, CAST(year(o_orderdate) AS INT) FROM orders WHERE {C_WHERE})
    SELECT * FROM u WHERE y IS NOT NULL OR NOT EXISTS (SELECT 1 FROM u v WHERE v.o_orderstatus = u.o_orderstatus AND v.o_orderpriority = u.o_orderpriority AND v.y IS NOT NULL)"""
)
def union_or(spark, sf):
    """Sets of unlike dimensions by the handle's operator."""
    a = _ids(spark, sf, "orders", *ORDER, where=A_WHERE)
    c = spark.read.parquet(f"{sf}/orders.parquet").where(C_WHERE).select(*ORDER, F.year("o_orderdate").alias("y"))
    return (CubeSet(a) | CubeSet(c)).ids


@query(f"{_AB} SELECT * FROM a UNION SELECT * FROM b UNION SELECT {_O} FROM orders WHERE {C_WHERE}")
def union_many(spark, sf):
    return A.union(*_orders(spark, sf), _ids(spark, sf, "orders", *ORDER, "o_custkey", where=C_WHERE))


@query(f"SELECT DISTINCT {', '.join(ORDER)} FROM orders UNION SELECT s, p FROM (VALUES ('X'), ('F')) x(s), (VALUES ('new'), ('1-URGENT')) y(p)")
def append_datacube(spark, sf):
    cube = to_frame(spark, json_forms.from_datacube({"o_orderstatus": ["X", "F"], "o_orderpriority": ["new", "1-URGENT"]}))
    return A.union(_ids(spark, sf, "orders", *ORDER), cube)


@query(
    f"""WITH u AS (SELECT DISTINCT {', '.join(CUST)} FROM customer UNION SELECT DISTINCT c_mktsegment, NULL FROM customer UNION SELECT 'EXTRA', NULL)
    SELECT * FROM u WHERE c_nationkey IS NOT NULL OR NOT EXISTS (SELECT 1 FROM u v WHERE v.c_mktsegment = u.c_mktsegment AND v.c_nationkey IS NOT NULL)"""
)
def union_absorbing(spark, sf):
    ids = _ids(spark, sf, "customer", *CUST)
    extra = spark.createDataFrame([("EXTRA",)], "c_mktsegment string")
    return A.union(ids, ids.select("c_mktsegment"), extra, absorb=True)


@query(f"{_AB} SELECT * FROM a EXCEPT SELECT * FROM b")
def subtract(spark, sf):
    return A.subtract(*_orders(spark, sf))


@query(f"{_AB} SELECT * FROM a EXCEPT SELECT * FROM b EXCEPT SELECT {_O} FROM orders WHERE {C_WHERE}")
def subtract_chain(spark, sf):
    return A.subtract(A.subtract(*_orders(spark, sf)), _ids(spark, sf, "orders", *ORDER, "o_custkey", where=C_WHERE))


@query(f"{_AB} SELECT (SELECT count(*) FROM a) AS identifiers, 0::BIGINT AS left_over")
def subtract_self(spark, sf):
    a, _ = _orders(spark, sf)
    both = a.withColumn("left_over", F.lit(0)).unionByName(A.subtract(a, a).withColumn("left_over", F.lit(1)))
    return both.agg(F.count_if(F.col("left_over") == 0).alias("identifiers"), F.count_if(F.col("left_over") == 1).alias("left_over"))


@query(f"SELECT DISTINCT {', '.join(CUST)} FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT (c_mktsegment = 'AUTOMOBILE' AND c_nationkey = 3)")
def subtract_prefix(spark, sf):
    gone = spark.createDataFrame([("BUILDING", None), ("MACHINERY", None), ("AUTOMOBILE", 3)], "c_mktsegment string, c_nationkey int")
    return A.subtract_prefix(_ids(spark, sf, "customer", *CUST), gone)


@query(f"{_AB} SELECT * FROM a INTERSECT SELECT * FROM b")
def intersect(spark, sf):
    return A.intersect(*_orders(spark, sf))


@query(f"{_AB} (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def sym_diff(spark, sf):
    return A.symmetric_difference(*_orders(spark, sf))


# projections


@query("SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem")
def drop_dim(spark, sf):
    return A.drop(_ids(spark, sf, "lineitem", *LINE), ["l_linestatus"])


@query("SELECT DISTINCT l_linenumber FROM lineitem")
def drop_multi(spark, sf):
    return A.drop(_ids(spark, sf, "lineitem", *LINE), ["l_returnflag", "l_linestatus"])


@query("SELECT DISTINCT o_orderpriority, o_custkey FROM orders")
def drop_unknown(spark, sf):
    return A.drop(_ids(spark, sf, "orders", *ORDER, "o_custkey"), ["no_such", "o_orderstatus"])


@query("SELECT DISTINCT l_linestatus, l_linenumber FROM lineitem")
def collapse(spark, sf):
    return A.collapse(_ids(spark, sf, "lineitem", *LINE), "l_returnflag")


@query("SELECT DISTINCT l_linestatus, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def squeeze(spark, sf):
    return A.squeeze(_ids(spark, sf, "lineitem", *LINE, where="l_returnflag = 'A'"))


_EV = "SELECT DISTINCT event_type, user_id FROM events"


@query(f"SELECT v.outer_dim, w.inner_dim, e.* FROM ({_EV}) e CROSS JOIN (VALUES ('x'), ('y')) v(outer_dim) CROSS JOIN (VALUES (1), (2)) w(inner_dim)")
def expand(spark, sf):
    return A.expand(_ids(spark, sf, "events", "event_type", "user_id"), {"inner_dim": [1, 2], "outer_dim": ["x", "y"]})


@query(f"SELECT 'foo' AS dataset, 'od' AS \"class\", e.* FROM ({_EV}) e")
def prepend(spark, sf):
    return A.prepend(_ids(spark, sf, "events", "event_type", "user_id"), {"class": "od", "dataset": "foo", "left_out": "x"}, ["dataset", "class"])


@query("SELECT DISTINCT v.step, event_type FROM events CROSS JOIN (VALUES ('s1'), ('s2')) v(step)")
def coxpand(spark, sf):
    return A.coxpand(_ids(spark, sf, "events", "event_type", "user_id"), "user_id", {"step": ["s1", "s2"]})


_PAD = """WITH p AS (SELECT DISTINCT event_type, NULL AS lang, NULL AS source, 'x' AS kind FROM events UNION SELECT DISTINCT NULL, lang, source, 'y' FROM documents) """


def _padded(spark, sf):
    e = _ids(spark, sf, "events", "event_type").withColumn("kind", F.lit("x"))
    return A.union(e, _ids(spark, sf, "documents", "lang", "source").withColumn("kind", F.lit("y"))).select("event_type", "lang", "source", "kind")


@query(_PAD + " UNION ".join(f"SELECT '{d}' AS dim, {d} AS value FROM p WHERE {d} IS NOT NULL" for d in ("event_type", "lang", "source", "kind")))
def axes(spark, sf):
    return A.axes(_padded(spark, sf))


@query(_PAD + " UNION ".join(f"SELECT '{d}' AS dim FROM p WHERE {d} IS NOT NULL" for d in ("event_type", "lang", "source", "kind")))
def dimensions(spark, sf):
    return A.dimensions(_padded(spark, sf))


@query(_PAD + " UNION ALL ".join(f"SELECT '{d}' AS dim FROM p HAVING count({d}) = count(*)" for d in ("event_type", "lang", "source", "kind")))
def common_dimensions(spark, sf):
    return A.common_dimensions(_padded(spark, sf))


# compression


@query(f"SELECT {_S.format('p_type')} AS p_type FROM part")
def compress_1(spark, sf):
    return _text_cubes(compression.cubes(_ids(spark, sf, "part", "p_type")))


@query(_CUBES2 + " SELECT * FROM cubes")
def compress_2(spark, sf):
    return _text_cubes(compression.cubes(_pairs(spark, sf)))


@query(_CUBES3 + " SELECT * FROM cubes")
def compress_3(spark, sf):
    return _text_cubes(compression.cubes(_tree(spark, sf), list(TREE)))


@query(_PART3 + " SELECT * FROM cubes")
def to_datacubes(spark, sf):
    return _text_cubes(compression.cubes(_ids(spark, sf, "part", *PART, "p_size")))


@query(_PART3 + " SELECT count(*) AS cubes FROM cubes")
def datacube_count(spark, sf):
    return compression.cubes(_ids(spark, sf, "part", *PART, "p_size")).agg(F.count(F.lit(1)).alias("cubes"))


@query("SELECT count(*) AS identifiers FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)")
def identifier_count(spark, sf):
    cubes = compression.cubes(_ids(spark, sf, "part", *PART, "p_size"))
    return cubes.agg(F.sum(compression.size(cubes.columns)).alias("identifiers"))


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def compress_lossless(spark, sf):
    return compression.explode(compression.cubes(_ids(spark, sf, "part", *PART, "p_size")))


@query(_CUBES2 + " SELECT a AS owners FROM cubes")
def structural_hash_groups(spark, sf):
    named = compression.structure_groups(_pairs(spark, sf), ["a", "c"])
    return named.groupBy("name").agg(C.joined(F.array_sort(F.collect_set("a"))).alias("owners")).drop("name")


# tree


def _nodes(spark, sf):
    """The node table of the irregular set; written, as queries look into it more than once."""
    return written(compression.nodes(compression.cubes(_tree(spark, sf))), "nodes")


_NODES = _CUBES3 + """, nodes AS (SELECT DISTINCT 1 AS depth, 'a' AS dim, a AS coords, a, NULL AS b, 'a=' || a AS path, NULL AS up FROM cubes
    UNION ALL SELECT 2, 'b', b, a, b, 'a=' || a || ',b=' || b, 'a=' || a FROM cubes
    UNION ALL SELECT 3, 'c', c, a, b, 'a=' || a || ',b=' || b || ',c=' || c, 'a=' || a || ',b=' || b FROM cubes) """


def _paths(nodes, key="node_id", out="path"):
    return navigation.path_text(nodes).select(F.col("node_id").alias(key), F.col("path_text").alias(out))


@query(_NODES + "SELECT dim, count(*) AS nodes, CAST(sum(len(string_split(coords, '/'))) AS BIGINT) AS coords FROM nodes GROUP BY dim")
def node_counts(spark, sf):
    return navigation.level_counts(_nodes(spark, sf))


@query(_NODES + "SELECT depth, repeat('    ', depth - 1) || dim || '=' || coords AS line FROM nodes")
def ascii_lines(spark, sf):
    return text.ascii_lines(_nodes(spark, sf))


@query(_PART3 + """ SELECT DISTINCT 'p_brand=' || p_brand AS "key", 1 AS depth FROM cubes UNION SELECT 'p_type=' || p_type, 2 FROM cubes UNION SELECT 'p_size=' || p_size, 3 FROM cubes""")
def nested_json_keys(spark, sf):
    """The document is one value and so is put together in one place; the part catalogue's tree is small."""

    def keys(obj: dict, depth: int):
        for k, below in obj.items():
            yield k, depth
            yield from keys(below, depth + 1)

    doc = CubeSet(_ids(spark, sf, "part", *PART, "p_size")).to_json()
    return spark.createDataFrame(sorted(set(keys(doc, 1))), "key string, depth int")


@query(_NODES + """SELECT n.dim, n.coords, coalesce(m.coords, '') AS parent_coords FROM nodes n LEFT JOIN nodes m ON m.path = n.up UNION ALL SELECT 'root', '', NULL""")
def arena_nodes(spark, sf):
    rows = json_forms.arena_rows(_nodes(spark, sf))
    up = rows.select(F.col("place").alias("p"), F.col("coords").alias("parent_coords"))
    return rows.join(up, rows["parent"] == up["p"], "left").select("dim", "coords", "parent_coords")


@query(_CUBES3 + " SELECT 'a=' || a || ',b=' || b || ',c=' || c AS path FROM cubes")
def leaf_paths(spark, sf):
    return navigation.path_text(navigation.leaves(_nodes(spark, sf))).select(F.col("path_text").alias("path"))


@query(_NODES + "SELECT path AS node, unnest(['b', 'c']) AS dim FROM nodes WHERE depth = 1 UNION ALL SELECT path, 'c' FROM nodes WHERE depth = 2")
def span(spark, sf):
    nodes = _nodes(spark, sf)
    return navigation.span(nodes).join(_paths(nodes, out="node"), "node_id").select("node", "dim")


@query(_NODES + "SELECT dim, coords FROM nodes WHERE list_contains(string_split(a, '/'), '7') AND (depth = 1 OR depth = 2 AND list_contains(string_split(b, '/'), '3'))")
def find_node(spark, sf):
    nodes = _nodes(spark, sf)
    found = navigation.find(nodes, {"a": 7}).unionByName(navigation.find(nodes, {"a": 7, "b": 3}))
    return found.select("dim", F.array_join("coords", "/").alias("coords"))


@query(_NODES + "SELECT path FROM nodes WHERE NOT list_contains(string_split(a, '/'), '7')")
def remove_node(spark, sf):
    nodes = _nodes(spark, sf)
    return _paths(navigation.remove(nodes, navigation.find(nodes, {"a": 7}))).select("path")


@query(_NODES + "SELECT up AS node, count(*) AS children FROM nodes WHERE depth > 1 GROUP BY up")
def children(spark, sf):
    nodes = _nodes(spark, sf)
    kids = nodes.where("depth > 1").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))
    return kids.join(_paths(nodes, "k", "node"), F.col("parent_id") == F.col("k")).select("node", "children")


@query(_NODES + "SELECT path AS node, up AS ancestor FROM nodes WHERE depth > 1 UNION ALL SELECT path, 'a=' || a FROM nodes WHERE depth = 3")
def ancestors(spark, sf):
    nodes = _nodes(spark, sf)
    up = navigation.ancestors(nodes).join(_paths(nodes, "k", "node"), F.col("node_id") == F.col("k")).drop("k")
    return up.join(_paths(nodes, "k", "ancestor_path"), F.col("ancestor") == F.col("k")).select("node", F.col("ancestor_path").alias("ancestor"))


@query(_NODES + "SELECT coords, FALSE AS is_new FROM nodes WHERE depth = 1 UNION ALL SELECT coords || '/x', TRUE FROM nodes WHERE depth = 1")
def check_new_child(spark, sf):
    nodes = _nodes(spark, sf)
    top = nodes.where("depth = 1").select("parent_id", "dim", "coords")
    more = top.withColumn("coords", F.concat("coords", F.array(F.lit("x"))))
    return navigation.is_new(nodes, top.unionByName(more)).select(F.array_join(F.transform(F.array_sort(F.transform("coords", lambda v: F.struct(v.try_cast("int").isNull(), v.try_cast("int"), v.alias("v")))), lambda x: x["v"]), "/").alias("coords"), "is_new")


@query(_NODES + """, f AS (SELECT a, b, c FROM cubes WHERE NOT list_contains(string_split(c, '/'), '7'))
    SELECT path FROM nodes n WHERE EXISTS (SELECT 1 FROM f WHERE f.a = n.a AND (n.depth = 1 OR f.b = n.b))""")
def leaf_content(spark, sf):
    """Nodes with any leaf left, where leaves with line number 7 have lost their values."""
    nodes = _nodes(spark, sf)
    emptied = nodes.withColumn("coords", F.when((F.col("depth") == 3) & F.array_contains("coords", "7"), F.array().cast("array<string>")).otherwise(F.col("coords")))
    return navigation.has_leaf_content(emptied).join(_paths(nodes), "node_id").select("path")


@query(_NODES + """, v AS (SELECT a, b, c, CASE WHEN list_bool_and(list_transform(string_split(b, '/'), lambda x: x::INT < 5)) THEN 'low'
        WHEN list_bool_and(list_transform(string_split(b, '/'), lambda x: x::INT >= 5)) THEN 'high' END AS vals FROM cubes)
    SELECT n.path, min(v.vals) AS vals FROM nodes n JOIN v ON v.a = n.a AND (n.depth = 1 OR v.b = n.b) GROUP BY n.path
    HAVING count(DISTINCT v.vals) = 1 AND count(v.vals) = count(*)""")
def node_values(spark, sf):
    """Values that all identifiers below a node agree on."""
    ids = written(_tree(spark, sf), "identifiers")
    nodes = compression.nodes(compression.cubes(ids))
    resolved = ids.select(*TREE, F.lit("level").alias("key"), F.array(F.when(F.col("b") < 5, "low").otherwise("high")).alias("vals"))
    return metadata.of_nodes(nodes, resolved, ids, list(TREE)).join(_paths(nodes), "node_id").select("path", F.array_join("vals", "/").alias("vals"))


# provenance

_LOC = f"""WITH c AS (SELECT DISTINCT {', '.join(CUST)}, r_name AS loc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) """


def _located(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(*CUST, F.col("r_name").alias("loc")).distinct()


def _leaf_meta(spark, sf):
    return metadata.table(_located(spark, sf), list(CUST), "location", F.array("loc"))


def _segment_meta(spark, sf):
    """Owner by segment, and for one segment another by nation."""
    ids = _ids(spark, sf, "customer", *CUST)
    top = ids.select(*CUST).where(F.lit(False))
    segments = ids.select("c_mktsegment").distinct().select("c_mktsegment", F.lit(None).cast("int").alias("c_nationkey"))
    whole = spark.createDataFrame([(None, None, "owner", ["all"])], "c_mktsegment string, c_nationkey int, key string, vals array<string>")
    by_segment = metadata.table(segments.where("c_mktsegment < 'G'"), list(CUST), "owner", F.array(F.lower("c_mktsegment")))
    by_nation = metadata.table(ids.where("c_mktsegment = 'BUILDING' AND c_nationkey < 5"), list(CUST), "owner", F.array(F.lit("n"), F.col("c_nationkey").cast("string")))
    return whole.unionByName(by_segment).unionByName(by_nation).unionByName(metadata.table(top, list(CUST), "owner", F.array("c_mktsegment")))


_OWNER = "CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN CAST(c_nationkey AS VARCHAR) || '/n' WHEN c_mktsegment < 'G' THEN lower(c_mktsegment) ELSE 'all' END"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("vals", F.array_join("vals", "/"))


@query(_LOC + f"SELECT loc AS value, {', '.join(CUST)} FROM c")
def partition_by_metadata(spark, sf):
    return metadata.partition(metadata.resolve(_ids(spark, sf, "customer", *CUST), _leaf_meta(spark, sf)), "location")


@query(
    _LOC + f""", g AS (SELECT loc, c_mktsegment, {_S.format('c_nationkey')} AS c_nationkey FROM c GROUP BY 1, 2)
    SELECT loc AS "value", {_S.format('c_mktsegment')} AS c_mktsegment, c_nationkey FROM g GROUP BY loc, c_nationkey"""
)
def partition_cubes(spark, sf):
    parts = metadata.partition(metadata.resolve(_ids(spark, sf, "customer", *CUST), _leaf_meta(spark, sf)), "location")
    cubes = compression.cubes(parts, ["value", *CUST])
    cubes = cubes.select(F.explode("value").alias("value"), *CUST)
    return cubes.select("value", *[C.joined(F.col(d)).alias(d) for d in CUST])


@query("SELECT DISTINCT n.n_name AS coord, r.r_name AS \"value\" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def pair_metadata(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey")
    both = rows.agg(F.array_sort(F.collect_list("n_name")).alias("coords"), F.array(F.first("r_name")).alias("vals"))
    return both.select(F.inline(metadata.pair(F.col("coords"), F.col("vals"))))


@query(f"SELECT DISTINCT {', '.join(CUST)}, 'location' AS \"key\", CASE WHEN c_nationkey = 3 THEN 'moved' ELSE loc END AS vals FROM (SELECT * FROM ({_LOC} SELECT * FROM c))")
def set_metadata(spark, sf):
    meta = _leaf_meta(spark, sf)
    new = metadata.table(_ids(spark, sf, "customer", *CUST, where="c_nationkey = 3"), list(CUST), "location", F.array(F.lit("moved")))
    return _shown(metadata.put(meta, new))


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3) THEN '3/n' ELSE 'building' END AS vals")
def get_metadata(spark, sf):
    return _shown(metadata.get(_ids(spark, sf, "customer", *CUST), _segment_meta(spark, sf), {"c_mktsegment": "BUILDING", "c_nationkey": 3}, "owner"))


@query("SELECT 'owner' AS \"key\", lower(min(c_mktsegment)) AS vals FROM customer WHERE c_mktsegment = 'BUILDING'")
def node_metadata(spark, sf):
    return _shown(metadata.at_node(_segment_meta(spark, sf), {"c_mktsegment": "BUILDING"}))


@query(f"SELECT DISTINCT {', '.join(CUST)}, 'owner' AS \"key\", {_OWNER} AS vals FROM customer")
def resolve_metadata(spark, sf):
    return _shown(metadata.resolve(_ids(spark, sf, "customer", *CUST), _segment_meta(spark, sf)))


_PUSHED = """['all'] || CASE WHEN c_mktsegment < 'G' THEN [lower(c_mktsegment)] ELSE [] END
    || CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 5 THEN ['n', CAST(c_nationkey AS VARCHAR)] ELSE [] END"""


@query(f"SELECT DISTINCT {', '.join(CUST)}, 'owner' AS \"key\", array_to_string(list_sort(list_distinct({_PUSHED})), '/') AS vals FROM customer")
def push_metadata(spark, sf):
    return _shown(metadata.push(_ids(spark, sf, "customer", *CUST), _segment_meta(spark, sf)))


@query(f"SELECT DISTINCT {', '.join(CUST)}, 'owner' AS \"key\", {_OWNER} AS vals FROM customer WHERE c_nationkey IN (3, 7)")
def select_metadata(spark, sf):
    return _shown(metadata.resolve(A.select(_ids(spark, sf, "customer", *CUST), {"c_nationkey": [3, 7]}), _segment_meta(spark, sf)))


@query(
    f"""WITH r AS (SELECT DISTINCT {', '.join(CUST)}, {_OWNER} AS vals FROM customer),
    whole AS (SELECT min(vals) AS vals FROM r HAVING count(DISTINCT vals) = 1),
    seg AS (SELECT c_mktsegment, min(vals) AS vals FROM r GROUP BY 1 HAVING count(DISTINCT vals) = 1)
    SELECT NULL::VARCHAR AS c_mktsegment, NULL::INT AS c_nationkey, 'owner' AS "key", vals FROM whole
    UNION ALL SELECT c_mktsegment, NULL, 'owner', vals FROM seg WHERE NOT EXISTS (SELECT 1 FROM whole)
    UNION ALL SELECT c_mktsegment, c_nationkey, 'owner', vals FROM r WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM seg) AND NOT EXISTS (SELECT 1 FROM whole)"""
)
def consolidate(spark, sf):
    return _shown(metadata.consolidate(metadata.resolve(_ids(spark, sf, "customer", *CUST), _segment_meta(spark, sf)), list(CUST)))


@query(
    f"""SELECT NULL::VARCHAR AS c_mktsegment, NULL::INT AS c_nationkey, 'owner' AS "key", 'all' AS vals
    UNION ALL SELECT DISTINCT c_mktsegment, NULL::INT, 'owner', lower(c_mktsegment) FROM customer WHERE c_mktsegment < 'G'
    UNION ALL SELECT DISTINCT {', '.join(CUST)}, 'owner', {_OWNER} FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5"""
)
def dedup_metadata(spark, sf):
    meta = _segment_meta(spark, sf)
    ids = _ids(spark, sf, "customer", *CUST, where="c_mktsegment > 'G'")
    again = metadata.table(ids, list(CUST), "owner", F.array(F.lit("all")))  # what these inherit anyway
    return _shown(metadata.deduplicate(meta.unionByName(again), list(CUST)))


@query(_LOC + f"SELECT {', '.join(CUST)}, 'location' AS \"key\", CASE WHEN c_nationkey < 9 THEN CASE WHEN loc < 'B' THEN loc || '/B site' ELSE 'B site/' || loc END ELSE loc END AS vals FROM c")
def meta_merge(spark, sf):
    more = metadata.table(_ids(spark, sf, "customer", *CUST, where="c_nationkey < 9"), list(CUST), "location", F.array(F.lit("B site")))
    return _shown(metadata.merge(_leaf_meta(spark, sf), more))


def _halves_of_customers(spark, sf):
    """Two overlapping sets: one with a value for all of it, one with values by segment."""
    a = CubeSet(_ids(spark, sf, "customer", *CUST, where="c_nationkey < 15")).set_metadata({}, "site", ["west"])
    ids = _ids(spark, sf, "customer", *CUST, where="c_nationkey >= 10")
    segments = ids.select("c_mktsegment", F.lit(None).cast("int").alias("c_nationkey")).distinct()
    return a, CubeSet(ids, meta=metadata.table(segments, list(CUST), "site", F.array(F.lower("c_mktsegment"))))


_HALF_SITES = f"""WITH c AS (SELECT DISTINCT {', '.join(CUST)}, c_nationkey < 15 AS w, c_nationkey >= 10 AS s FROM customer),
    v AS (SELECT {', '.join(CUST)}, CASE WHEN w AND s THEN lower(c_mktsegment) || '/west' WHEN w THEN 'west' ELSE lower(c_mktsegment) END AS vals FROM c) """


@query(_HALF_SITES + f"SELECT {', '.join(CUST)}, 'site' AS \"key\", vals FROM v")
def union_metadata(spark, sf):
    a, b = _halves_of_customers(spark, sf)
    return _shown(a.union(b).resolve())


@query(
    _HALF_SITES + f""", seg AS (SELECT c_mktsegment, min(vals) AS vals FROM v GROUP BY 1 HAVING count(DISTINCT vals) = 1), whole AS (SELECT min(vals) AS vals FROM v HAVING count(DISTINCT vals) = 1)
    SELECT NULL AS c_mktsegment, NULL AS c_nationkey, 'site' AS "key", vals FROM whole
    UNION ALL SELECT c_mktsegment, NULL, 'site', vals FROM seg WHERE NOT EXISTS (SELECT 1 FROM whole)
    UNION ALL SELECT {', '.join(CUST)}, 'site', vals FROM v WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM seg) AND NOT EXISTS (SELECT 1 FROM whole)"""
)
def union_metadata_placed(spark, sf):
    a, b = _halves_of_customers(spark, sf)
    return _shown(a.union(b).meta())


@query(_LOC + f"SELECT c_mktsegment, 'location' AS \"key\", {_S.format('loc')} AS vals FROM c GROUP BY 1")
def drop_metadata(spark, sf):
    s = CubeSet(_ids(spark, sf, "customer", *CUST), meta=_leaf_meta(spark, sf))
    return _shown(s.drop(["c_nationkey"]).resolve())


@query(f"SELECT DISTINCT v.step, {', '.join(CUST)}, 'owner' AS \"key\", {_OWNER} AS vals FROM customer CROSS JOIN (VALUES ('s1'), ('s2')) v(step)")
def expand_metadata(spark, sf):
    s = CubeSet(_ids(spark, sf, "customer", *CUST), meta=_segment_meta(spark, sf))
    return _shown(s.expand({"step": ["s1", "s2"]}).resolve())


@query(_LOC + "SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, 'location' AS \"key\", loc AS vals FROM c")
def arena_metadata(spark, sf):
    """Through the node-array document and back."""
    s = CubeSet(_ids(spark, sf, "customer", *CUST), meta=_leaf_meta(spark, sf))
    return _shown(CubeSet.from_arena_json(spark, json.dumps(s.to_arena_json())).resolve())


def _regions(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("coords"))


@query("SELECT n_name AS coord, unnest([lower(n_name), CAST(length(n_name) AS VARCHAR)]) AS \"value\" FROM nation")
def pair_per_coord(spark, sf):
    own = F.transform("coords", lambda c: F.array(F.lower(c), F.length(c).cast("string")))
    rows = _regions(spark, sf).withColumn("per_coord", own)
    back = metadata.per_coord_from_json(metadata.per_coord_json(F.col("per_coord")))
    return rows.select(F.inline(metadata.pair(F.col("coords"), F.array_distinct(F.flatten("per_coord")), back)))


@query("SELECT n_name AS coord, lower(n_name) AS \"value\" FROM nation")
def pair_zip(spark, sf):
    return _regions(spark, sf).select(F.inline(metadata.pair(F.col("coords"), F.transform("coords", lambda c: F.lower(c)))))


@query("SELECT n_name AS coord, array_to_string(list_sort(list_distinct([lower(n_name), substr(n_name, 1, 1), 'x'])), '/') AS vals FROM nation")
def merge_per_coord(spark, sf):
    one = F.transform("coords", lambda c: F.array(F.lower(c), F.lit("x")))
    two = F.transform("coords", lambda c: F.array(F.substring(c, 1, 1), F.lit("x")))
    merged = _regions(spark, sf).withColumn("per_coord", metadata.merge_per_coord(one, two)).select("coords", "per_coord", F.explode("coords").alias("coord"))
    return merged.select("coord", F.array_join(metadata.per_coord_at(F.col("coords"), F.col("per_coord"), F.col("coord")), "/").alias("vals"))


@query("SELECT DISTINCT '{\"strings\":[\"' || p_type || '\"]}' AS doc, p_type AS back FROM part UNION SELECT DISTINCT '{\"ints\":[' || p_size || ']}', CAST(p_size AS VARCHAR) FROM part")
def meta_json(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet")
    values = rows.select(F.array("p_type").alias("vals")).unionByName(rows.select(F.array(F.col("p_size").cast("string")).alias("vals"))).distinct()
    docs = values.select(metadata.to_json(F.col("vals")).alias("doc"))
    return docs.select("doc", F.array_join(metadata.from_json(F.col("doc")), "/").alias("back"))


# coordinates

_HALVES = """WITH h AS (SELECT p_brand, list_sort(list(DISTINCT p_size) FILTER (p_partkey % 2 = 0)) AS a, list_sort(list(DISTINCT p_size) FILTER (p_partkey % 2 = 1)) AS b FROM part GROUP BY p_brand),
    k AS (SELECT p_brand, coalesce(a, []) AS a, coalesce(b, []) AS b FROM h) """
_LIST = "array_to_string(list_transform(list_sort({0}), lambda x: CAST(x AS VARCHAR)), '/')"


def _halves(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand")
    half = lambda k: F.array_sort(F.collect_set(F.when(F.col("p_partkey") % 2 == k, F.col("p_size"))))
    return rows.agg(half(0).alias("a"), half(1).alias("b"))


@query(_HALVES + f"SELECT p_brand, {_LIST.format('list_filter(a, lambda x: list_contains(b, x))')} AS \"intersection\", {_LIST.format('list_filter(a, lambda x: NOT list_contains(b, x))')} AS only_a, {_LIST.format('list_filter(b, lambda x: NOT list_contains(a, x))')} AS only_b FROM k")
def coord_intersect(spark, sf):
    parts = _halves(spark, sf).select("p_brand", C.intersection(F.col("a"), F.col("b")).alias("x")).select("p_brand", "x.*")
    return parts.select("p_brand", *[C.joined(F.col(c)).alias(c) for c in ("intersection", "only_a", "only_b")])


@query(_HALVES + f"SELECT p_brand, {_LIST.format('list_distinct(list_concat(a, b))')} AS coords FROM k")
def coord_union(spark, sf):
    return _halves(spark, sf).select("p_brand", C.joined(C.union(F.col("a"), F.col("b"))).alias("coords"))


@query(_HALVES + "SELECT p_brand, list_contains(a, 7) AS has, CASE WHEN list_contains(a, 7) THEN CAST(list_position(a, 7) - 1 AS BIGINT) END AS place FROM k")
def coord_contains(spark, sf):
    return _halves(spark, sf).select("p_brand", C.contains(F.col("a"), F.lit(7)).alias("has"), C.index_of(F.col("a"), F.lit(7)).alias("place"))


_TYPED = """WITH k AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS i, list_sort(list(DISTINCT CAST(p_retailprice AS DECIMAL(18, 2))) FILTER (p_partkey % 5 = 0 AND CAST(p_retailprice AS DECIMAL(18, 2)) % 1 <> 0)) AS f,
    list_sort(list(DISTINCT p_type)) AS s FROM part GROUP BY p_brand), t AS (SELECT p_brand, list_transform(i, lambda x: CAST(x AS VARCHAR)) AS i, list_transform(coalesce(f, []), lambda x: rtrim(CAST(x AS VARCHAR), '0')) AS f, s FROM k) """


def _typed(spark, sf):
    """For each brand coordinate sets of integers, floats and strings, typed from their text."""
    price = F.col("p_retailprice").cast("decimal(18,2)")
    some = F.when((F.col("p_partkey") % 5 == 0) & (price % 1 != 0), price.cast("string"))
    rows = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("i"), F.collect_set(some).alias("f"), F.collect_set("p_type").alias("s"))
    typed = lambda c: F.when(F.size(c) > 0, C.from_text(F.array_join(c, "/"))).otherwise(F.array().cast(f"array<{C.COORD}>")).alias(c)
    return rows.select("p_brand", *[typed(c) for c in ("i", "f", "s")])


@query(_TYPED + "SELECT p_brand, array_to_string(i || f || s, '/') AS coords, 'mixed' AS kind FROM t")
def coord_union_mixed(spark, sf):
    """Promotion: integers, then floats, then strings make one mixed set, ordered by type."""
    rows = _typed(spark, sf).withColumn("u", C.union(C.union(F.col("s"), F.col("f")), F.col("i")))
    return rows.select("p_brand", C.to_text(F.col("u")).alias("coords"), C.kind(F.col("u")).alias("kind"))


@query(
    _TYPED + """SELECT p_brand, array_to_string(f, '/') AS "intersection", array_to_string(i, '/') AS only_a, array_to_string(s, '/') AS only_b,
    CASE WHEN len(f) > 0 THEN 'floats' ELSE 'empty' END AS kind FROM t"""
)
def coord_intersect_mixed(spark, sf):
    rows = _typed(spark, sf).select("p_brand", C.intersection(C.union(F.col("i"), F.col("f")), C.union(F.col("s"), F.col("f"))).alias("x"))
    return rows.select("p_brand", *[C.to_text(F.col(f"x.{c}")).alias(c) for c in ("intersection", "only_a", "only_b")], C.kind(F.col("x.intersection")).alias("kind"))


@query(
    """WITH k AS (SELECT o_orderstatus AS status, list(DISTINCT o_orderdate) FILTER (o_orderkey % 2 = 0) AS a, list(DISTINCT o_orderdate) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1),
    x AS (SELECT status, list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) AS i, list_sort(list_filter(coalesce(a, []), lambda d: NOT list_contains(coalesce(b, []), d))) AS only_a FROM k)
    SELECT status, array_to_string(list_transform(i, lambda d: strftime(d, '%Y-%m-%dT00:00:00')), '/') AS "intersection", array_to_string(list_transform(only_a, lambda d: strftime(d, '%Y-%m-%dT00:00:00')), '/') AS only_a, 'datetimes' AS kind FROM x WHERE len(i) > 0"""
)
def coord_intersect_datetimes(spark, sf):
    day = C.coord(3, C.datetime(F.date_format("o_orderdate", "yyyyMMdd")))
    half = lambda k: F.array_sort(F.collect_set(F.when(F.col("o_orderkey") % 2 == k, day)))
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(half(0).alias("a"), half(1).alias("b"))
    parts = rows.select("status", C.intersection(F.col("a"), F.col("b")).alias("x")).where(F.size("x.intersection") > 0)
    return parts.select("status", *[C.to_text(F.col(f"x.{c}")).alias(c) for c in ("intersection", "only_a")], C.kind(F.col("x.intersection")).alias("kind"))


@query(_TYPED + "SELECT p_brand, unnest(i || s) AS coord FROM t")
def coord_singles(spark, sf):
    rows = _typed(spark, sf).select("p_brand", F.explode(C.singles(C.union(F.col("i"), F.col("s")))).alias("one"))
    return rows.select("p_brand", C.to_text(F.col("one")).alias("coord"))


@query(
    """SELECT * FROM (VALUES ('1/2/10', '1/2/10', 'integers'), ('od/rd', 'od/rd', 'strings'), ('0001/0002', '0001/0002', 'strings'), ('0001/od', '0001/od', 'strings'),
    ('1.50/2', '2/1.5', 'mixed'), ('3d', '3d', 'strings'), (' 7', ' 7', 'strings'), ('b/a/b', 'a/b', 'strings'), ('-5/+3', '-5/3', 'integers'), ('2.0', '2', 'floats')) t(given, written, kind)"""
)
def coord_text(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ["1/2/10", "od/rd", "0001/0002", "0001/od", "1.50/2", "3d", " 7", "b/a/b", "-5/+3", "2.0"]], "given string")
    typed = rows.withColumn("coords", C.from_text(F.col("given")))
    return typed.select("given", C.to_text(F.col("coords")).alias("written"), C.kind(F.col("coords")).alias("kind"))


@query("SELECT * FROM (VALUES ('2021-05-04T06:07:08Z', '2021-05-04 06:07:08'), ('2021-05-04 06:07:08', '2021-05-04 06:07:08'), ('2021-05-04', '2021-05-04 00:00:00'), ('20210504', '2021-05-04 00:00:00'), ('20210504T0607', '2021-05-04 06:07:00'), ('2021', NULL)) t(given, stamp)")
def coord_datetime(spark, sf):
    rows = spark.createDataFrame([(x,) for x in ["2021-05-04T06:07:08Z", "2021-05-04 06:07:08", "2021-05-04", "20210504", "20210504T0607", "2021"]], "given string")
    return rows.select("given", F.date_format(C.datetime(F.col("given")), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


# adapters


def _quoted(col: str) -> str:
    return f"'[\"' || replace({col}, '/', '\",\"') || '\"]'"


@query(_CUBES3 + f" SELECT '{{\"a\":' || {_quoted('a')} || ',\"b\":' || {_quoted('b')} || ',\"c\":' || {_quoted('c')} || ',\"none\":[]}}' AS \"constraint\" FROM cubes")
def dss_export(spark, sf):
    cubes = compression.cubes(_tree(spark, sf).withColumn("none", F.lit(None).cast("string")))
    return tables.to_constraints(cubes)


@query(f"SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(c AS VARCHAR) AS c, NULL AS \"none\" FROM ({_TREE_SQL})")
def dss_import(spark, sf):
    """Constraint files of the irregular set, written and read back."""
    path = shared_dir(spark, "constraints")
    dss_export(spark, sf).write.text(path)
    return compression.explode(tables.read_constraints(spark, path, [*TREE, "none"], lines=True))


@query("SELECT DISTINCT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def mars_list_files(spark, sf):
    """Listing files, a few segments in each, written and read back."""
    path = shared_dir(spark, "listings")
    rows = _ids(spark, sf, "customer", *CUST).groupBy("c_mktsegment").agg(F.collect_set("c_nationkey").alias("n"))
    rows.select(F.concat(F.lit("segment="), "c_mktsegment", F.lit("\n  nation="), C.joined(F.col("n"))).alias("value")).repartition(3).write.text(path)
    cubes = text.read_listings(spark, path)
    value = lambda d: F.explode(F.element_at("cube", F.lit(d))).alias(d)
    return cubes.select("cube", value("segment")).select("segment", value("nation"))


_REC = """WITH r AS (SELECT event_type AS "type", CASE WHEN user_id % 3 = 0 THEN 'sol' ELSE 'sfc' END AS levtype, CASE WHEN user_id % 5 = 0 THEN 'z' ELSE 't' END AS param, user_id AS step FROM events) """


def _records(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.col("event_type").alias("type"), F.when(F.col("user_id") % 3 == 0, "sol").otherwise("sfc").alias("levtype"),
        F.when(F.col("user_id") % 5 == 0, "z").otherwise("t").alias("param"), F.col("user_id").alias("step"),
    )


@query(_REC + "SELECT * FROM r WHERE \"type\" NOT IN ('em', 'es', 'ep') AND levtype <> 'sol' AND NOT (param IN ('z', 'sdor', 'slor') AND levtype = 'sfc')")
def opendata_filter(spark, sf):
    return _records(spark, sf).where(~tables.excluded(F.col("type"), F.col("levtype"), F.col("param")))


@query(_REC + f"SELECT \"type\", levtype, {_S.format('param')} AS param, {_S.format('step')} AS step FROM r GROUP BY \"type\", levtype")
def opendata_group(spark, sf):
    groups = tables.group_records(_records(spark, sf), ["type", "levtype"], ["param", "step"])
    return groups.select("type", "levtype", C.joined(F.col("param")).alias("param"), C.joined(F.col("step")).alias("step"))


@query(
    _REC + f""", k AS (SELECT * FROM r WHERE levtype <> 'sol' AND param <> 'z'),
    g AS (SELECT "type", levtype, {_S.format('param')} AS param, {_S.format('CAST(step AS VARCHAR)')} AS step FROM k GROUP BY "type", levtype)
    SELECT {_S.format('"type"')} AS "type", levtype, param, step FROM g GROUP BY levtype, param, step"""
)
def opendata(spark, sf):
    """Index files, written and read back without excluded records."""
    path = shared_dir(spark, "index")
    _records(spark, sf).write.json(path)
    kept = tables.read_index(spark, path, ["type", "levtype", "param", "step"])
    cubes = tables.group_records(kept, ["type", "levtype"], ["param", "step"])
    ids = compression.explode(cubes.select(F.array("type").alias("type"), F.array("levtype").alias("levtype"), "param", "step"))
    return _text_cubes(compression.cubes(ids, ["type", "levtype", "param", "step"]))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' AS base, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages),
    q AS (SELECT page_id, base, CASE WHEN regexp_matches(raw, '^[a-z]+://') THEN raw WHEN starts_with(raw, '/') THEN site || raw ELSE base || raw END AS href FROM p)
    SELECT page_id, href FROM q WHERE starts_with(href, base) AND href <> base"""
)
def extract_hrefs(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    top = pages.select("page_id", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.lit("/")).alias("url"), "html")
    return tables.hrefs(top).select("page_id", "href")


@query()
def tree_json(spark, sf):
    """The recursive JSON document of the compressed part set."""
    doc = CubeSet(_ids(spark, sf, "part", *PART, "p_size")).to_tree_json()
    return spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "doc string")


_SCAN_SQL = "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE {0}"


@query(
    f"""SELECT 'finished' AS name, * FROM ({_SCAN_SQL.format("o_orderstatus = 'F' AND strftime(o_orderdate, '%Y%m%d') BETWEEN '19920101' AND '19941231'")})
    UNION ALL SELECT 'recent', * FROM ({_SCAN_SQL.format("strftime(o_orderdate, '%Y%m%d') BETWEEN '19970702' AND '19980801'")})"""
)
def scan_selectors(spark, sf):
    """Selectors of a configuration, each scanned to a document of its own and read back."""
    config = scanner.Config.parse(
        {"selectors": [
            {"name": "finished", "mode": "once", "selector": "status=F", "from_date": "19920101", "to_date": "19941231"},
            {"name": "recent", "mode": "schedule", "selector": "", "last_n_days": 395},
        ], "location": "here"}
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    source = orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"))
    documents: dict[str, str] = {}
    scanner.run(spark, source, config, ["status", "priority"], documents.__setitem__, now=lambda: dt.datetime(1998, 8, 1), rounds=1)
    sets = [CubeSet.from_arena_json(spark, d).ids.select(F.lit(n.removeprefix("here_").removesuffix(".json")).alias("name"), "status", "priority") for n, d in documents.items()]
    return A.union(*sets)


# cubes without explosion


def _two(spark, sf):
    a = _ids(spark, sf, "part", *PART, "p_size", where="p_size < 30")
    return a, _ids(spark, sf, "part", *PART, "p_size", where="p_size > 20")


_P3 = "p_brand, p_type, p_size"
for _how, _sql in {
    "union": "SELECT {0} FROM part WHERE p_size < 30 UNION SELECT {0} FROM part WHERE p_size > 20",
    "subtract": "SELECT {0} FROM part WHERE p_size < 30 EXCEPT SELECT {0} FROM part WHERE p_size > 20",
    "intersect": "SELECT {0} FROM part WHERE p_size < 30 INTERSECT SELECT {0} FROM part WHERE p_size > 20",
}.items():

    @query(_sql.format(_P3), name=f"atoms_{_how}")
    def _atoms(spark, sf, how=_how):
        a, b = (compression.cubes(x) for x in _two(spark, sf))
        return compression.explode(atoms.combine(how, a, b))


@query("SELECT CAST(1500000000 AS DECIMAL(38, 0)) AS identifiers")
def atoms_billion(spark, sf):
    """Union of two overlapping cubes with a billion identifiers each, whose overlap is half."""
    values = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    one = spark.range(1).select(values(1, 1000).alias("x"), values(1, 1000).alias("y"), values(1, 1000).alias("z"))
    two = spark.range(1).select(values(501, 1500).alias("x"), values(1, 1000).alias("y"), values(1, 1000).alias("z"))
    return atoms.count(atoms.combine("union", one, two))
