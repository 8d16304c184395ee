"""A query for each operator, and DuckDB SQL for the same rows."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.values import cents, fst, snd, swap
from tidelake.operators.frame import ZFrame
from tidelake.operators.outputs import by_key, extrema, scalar
from tidelake.plans.feedback import CreationContext
from tidelake.plans.games import fingers, summary, tic_tac_toe
from tidelake.sources.tables import relation, table
from tidelake.streaming.adapter import StreamCommits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def bag(cte: str, columns: str, source: str) -> str:
    """SQL for the consolidated rows of a CTE with weights w."""
    return f"WITH {cte} SELECT {columns}, CAST(sum(w) AS BIGINT) AS w FROM {source} GROUP BY {columns} HAVING sum(w) <> 0"


def out(z: ZFrame) -> DataFrame:
    return z.consolidate().df


def signed() -> Column:
    return F.when(F.col("l_returnflag") == "R", -2).otherwise(1)


SIGNED_SQL = "CASE WHEN l_returnflag = 'R' THEN -2 ELSE 1 END"


def flagged(s: SparkSession, d: str) -> ZFrame:
    return relation(s, d, "lineitem", "l_partkey", "l_returnflag", weight=signed())


def urgent(s: SparkSession, d: str) -> ZFrame:
    return relation(s, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")


def edges(s: SparkSession, d: str) -> ZFrame:
    """A graph over all customers, which grows with the tables."""
    n = table(s, d, "customer").count()
    return relation(s, d, "orders", F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % n + 1).alias("dst"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("len")).distinct()


GRAPH_SQL = "e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) + 1 AS dst, CAST(left(o_orderpriority, 1) AS BIGINT) AS len FROM orders)"


@query("""SELECT DISTINCT k, v, CAST(1 AS BIGINT) AS w FROM (
SELECT o_orderkey AS k, l_partkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey FROM orders)""")
def entry_join_concat_distinct(s: SparkSession, d: str) -> DataFrame:
    orders = relation(s, d, "orders", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), "o_orderstatus")
    lines = relation(s, d, "lineitem", F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))
    return orders.filter("o_orderstatus = 'F'").map("k").join(lines, "k").concat(orders.map("k", "v")).distinct().df


@query(bag("a AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) * 2 AS q, 1 AS w FROM lineitem)", "k, q", "a"))
def map_project(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "lineitem", "l_orderkey", "l_quantity").map(F.col("l_orderkey").alias("k"), (F.col("l_quantity").cast("bigint") * 2).alias("q")))


@query(bag("a AS (SELECT l_orderkey, l_linenumber, 1 AS w FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'A')", "l_orderkey, l_linenumber", "a"))
def filter_rows(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "lineitem").filter((F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "A")).map("l_orderkey", "l_linenumber"))


@query(bag("a AS (SELECT unnest(string_split(text, ' ')) AS word, 1 AS w FROM documents)", "word", "a"))
def flat_map_words(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "documents", "text").flat_map(F.split("text", " "), "word"))


@query(bag("a AS (SELECT CAST(round(unnest(embedding) * 1000) AS BIGINT) AS x, 1 AS w FROM embeddings)", "x", "a"))
def flatten_array(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "embeddings", "embedding").flatten("embedding", "e").map(F.round(F.col("e") * F.lit(1000).cast("float")).cast("bigint").alias("x")))


@query(bag("a AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 2 END AS w FROM lineitem)", "l_partkey", "a"))
def map_raw_weights(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "lineitem", "l_partkey", "l_returnflag").map_raw("l_partkey", F.when(F.col("l_returnflag") == "R", -1).otherwise(2).cast("bigint").alias("w")))


@query(bag("a AS (SELECT l_partkey AS k, 1 AS w FROM lineitem UNION ALL SELECT l_suppkey, -1 FROM lineitem)", "k", "a"))
def flat_map_raw(s: SparkSession, d: str) -> DataFrame:
    pair = lambda c, w: F.struct(F.col(c).alias("k"), (F.col("w") * w).alias("w"))
    return out(relation(s, d, "lineitem", "l_partkey", "l_suppkey").flat_map_raw(F.array(pair("l_partkey", 1), pair("l_suppkey", -1))))


@query(bag("a AS (SELECT n_regionkey, 1 AS w FROM nation)", "n_regionkey", "a"))
def fsts(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "nation", "n_regionkey", "n_name").fsts("n_regionkey"))


@query(bag("a AS (SELECT n_name, 1 AS w FROM nation)", "n_name", "a"))
def snds(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "nation", "n_regionkey", "n_name").snds("n_regionkey"))


@query(bag("a AS (SELECT n_name, n_regionkey, 1 AS w FROM nation)", "n_name, n_regionkey", "a"))
def swaps(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "nation", "n_regionkey", "n_name").swaps("n_regionkey"))


@query(bag("a AS (SELECT n_regionkey AS f, n_nationkey AS g, n_nationkey AS h, n_regionkey AS i, 1 AS w FROM nation)", "f, g, h, i", "a"))
def pair_fields(s: SparkSession, d: str) -> DataFrame:
    z = relation(s, d, "nation", F.struct(F.col("n_regionkey").alias("_1"), F.col("n_nationkey").alias("_2")).alias("p"))
    return out(z.map(fst("p").alias("f"), snd("p").alias("g"), swap("p").alias("q")).map("f", "g", fst("q").alias("h"), snd("q").alias("i")))


@query(bag("a AS (SELECT 'l' AS side, n_regionkey AS k, 1 AS w FROM nation UNION ALL SELECT 'r', n_nationkey, 1 FROM nation)", "side, k", "a"))
def split_pair(s: SparkSession, d: str) -> DataFrame:
    left, right = relation(s, d, "nation").split([F.lit("l").alias("side"), F.col("n_regionkey").alias("k")], [F.lit("r").alias("side"), F.col("n_nationkey").alias("k")])
    return out(left.concat(right))


@query(bag("a AS (SELECT event_type, 3 AS w FROM events)", "event_type", "a"))
def map_counts_scale(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "events", "event_type").map_counts(lambda w: w * 3))


@query(bag("a AS (SELECT event_type, -1 AS w FROM events)", "event_type", "a"))
def negate_weights(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "events", "event_type").negate())


@query(bag(f"a AS (SELECT l_partkey, {SIGNED_SQL} AS w FROM lineitem)", "l_partkey", "a"))
def consolidate_signed(s: SparkSession, d: str) -> DataFrame:
    return out(flagged(s, d).map("l_partkey"))


@query(bag("a AS (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 3 = 1 THEN -1 ELSE 5 END AS w FROM events)", "event_type", "a"))
def update_add_remove(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("event_type string")
    o, x = r.into_output(), c.begin()
    e = table(s, d, "events").select("event_type", (F.col("user_id") % 3).alias("m"))
    i.add_all(e.where("m = 0").select("event_type"))
    i.remove_all(e.where("m = 1").select("event_type"))
    i.send_all(e.where("m = 2").select("event_type", F.lit(5).alias("w")))
    x.commit()
    return o.get(x)


#: Customers by nation, and nations by region: the first has keys that the second lacks.
NATIONS_SQL = "a AS (SELECT c_nationkey AS k, 1 AS w FROM customer), b AS (SELECT n_regionkey AS k, 1 AS w FROM nation), ca AS (SELECT k, count(*) AS n FROM a GROUP BY k), cb AS (SELECT k, count(*) AS n FROM b GROUP BY k)"


def nations(s: SparkSession, d: str) -> tuple[ZFrame, ZFrame]:
    return relation(s, d, "customer", F.col("c_nationkey").alias("k")), relation(s, d, "nation", F.col("n_regionkey").alias("k"))


@query(bag(f"{NATIONS_SQL}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b)", "k", "u"))
def concat_bag(s: SparkSession, d: str) -> DataFrame:
    a, b = nations(s, d)
    return out(a.concat(b))


@query(bag(f"{NATIONS_SQL}, u AS (SELECT * FROM a UNION ALL SELECT k, -9 * w FROM b)", "k", "u"))
def minus_signed(s: SparkSession, d: str) -> DataFrame:
    a, b = nations(s, d)
    return out(a.minus(b.map_counts(lambda w: w * 9)))


@query(f"WITH {NATIONS_SQL} SELECT ca.k, CAST(ca.n * cb.n AS BIGINT) AS w FROM ca JOIN cb ON ca.k = cb.k")
def intersection_product(s: SparkSession, d: str) -> DataFrame:
    a, b = nations(s, d)
    return out(a.intersection(b))


@query(f"WITH {NATIONS_SQL} SELECT k, CAST(n AS BIGINT) AS w FROM ca WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.k = ca.k)")
def set_minus_absent(s: SparkSession, d: str) -> DataFrame:
    a, b = nations(s, d)
    return out(a.set_minus(b))


@query(bag("a AS (SELECT c_custkey AS k, c_nationkey, o_orderkey, 1 AS w FROM customer JOIN orders ON c_custkey = o_custkey)", "k, c_nationkey, o_orderkey", "a"))
def join_inner(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey").join(relation(s, d, "orders", F.col("o_custkey").alias("k"), "o_orderkey"), "k"))


@query(bag("a AS (SELECT c_nationkey, o_orderstatus, 1 AS w FROM customer JOIN orders ON c_custkey = o_custkey)", "c_nationkey, o_orderstatus", "a"))
def join_values(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey").join_values(relation(s, d, "orders", F.col("o_custkey").alias("k"), "o_orderstatus"), "k"))


@query(bag("a AS (SELECT nullif(o_custkey, 7) AS k, o_orderkey FROM orders), b AS (SELECT nullif(c_custkey, 7) AS k, c_nationkey FROM customer), j AS (SELECT a.k, o_orderkey, c_nationkey, 1 AS w FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k)", "k, o_orderkey, c_nationkey", "j"))
def join_null_safe(s: SparkSession, d: str) -> DataFrame:
    a = relation(s, d, "orders", F.nullif("o_custkey", F.lit(7).cast("long")).alias("k"), "o_orderkey")
    b = relation(s, d, "customer", F.nullif("c_custkey", F.lit(7).cast("long")).alias("k"), "c_nationkey")
    return out(a.join(b, "k"))


@query("SELECT c_custkey AS k, c_nationkey, CAST(count(*) AS BIGINT) AS w FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY ALL")
def semijoin_multiplicity(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey").semijoin(urgent(s, d).map(F.col("o_custkey").alias("k")), "k"))


@query("SELECT c_custkey AS k, c_nationkey, CAST(1 AS BIGINT) AS w FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def antijoin_absent(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey").antijoin(urgent(s, d).map(F.col("o_custkey").alias("k")), "k"))


@query("SELECT c_custkey AS k, c_nationkey, o_orderkey, o_orderkey IS NOT NULL AS matched, CAST(1 AS BIGINT) AS w FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') ON o_custkey = c_custkey")
def left_join_option(s: SparkSession, d: str) -> DataFrame:
    return out(relation(s, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey").left_join(urgent(s, d).map(F.col("o_custkey").alias("k"), "o_orderkey"), "k"))


@query("""WITH a AS (SELECT l_partkey AS x, l_suppkey AS y, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey AS x, l_orderkey AS z, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey AS y, l_orderkey AS z, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.x, a.y, b.z, CAST(a.n * b.n * c.n AS BIGINT) AS w FROM a JOIN b ON a.x = b.x JOIN c ON a.y = c.y AND b.z = c.z""")
def triangles_psl(s: SparkSession, d: str) -> DataFrame:
    pair = lambda a, b: relation(s, d, "lineitem", F.col({"x": "l_partkey", "y": "l_suppkey", "z": "l_orderkey"}[a]).alias(a), F.col({"x": "l_partkey", "y": "l_suppkey", "z": "l_orderkey"}[b]).alias(b))
    return out(pair("x", "y").triangles(pair("x", "z"), pair("y", "z")))


@query(f"SELECT l_partkey, CAST(sum({SIGNED_SQL}) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM lineitem GROUP BY l_partkey HAVING sum({SIGNED_SQL}) <> 0")
def counts(s: SparkSession, d: str) -> DataFrame:
    return flagged(s, d).map("l_partkey").counts().df


@query(f"SELECT l_partkey, CAST(1 AS BIGINT) AS w FROM lineitem GROUP BY l_partkey HAVING sum({SIGNED_SQL}) <> 0")
def distinct_signed(s: SparkSession, d: str) -> DataFrame:
    return flagged(s, d).map("l_partkey").distinct().df


def priced(s: SparkSession, d: str) -> ZFrame:
    return relation(s, d, "orders", "o_custkey", cents("o_totalprice").alias("price"))


@query("SELECT o_custkey, min(CAST(round(o_totalprice * 100) AS BIGINT)) AS price, CAST(1 AS BIGINT) AS w FROM orders GROUP BY o_custkey")
def group_min(s: SparkSession, d: str) -> DataFrame:
    return priced(s, d).group_min("o_custkey").df


@query("SELECT o_custkey, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price, CAST(1 AS BIGINT) AS w FROM orders GROUP BY o_custkey")
def group_max(s: SparkSession, d: str) -> DataFrame:
    return priced(s, d).group_max("o_custkey").df


@query(f"""WITH a AS (SELECT l_partkey AS k, CAST(l_quantity AS BIGINT) AS v, sum({SIGNED_SQL}) AS w FROM lineitem GROUP BY ALL HAVING sum({SIGNED_SQL}) <> 0)
SELECT k, CAST(sum(v * w) AS BIGINT) AS total, CAST(sum(w) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM a GROUP BY k""")
def reduce_sums(s: SparkSession, d: str) -> DataFrame:
    z = relation(s, d, "lineitem", F.col("l_partkey").alias("k"), F.col("l_quantity").cast("bigint").alias("v"), weight=signed())
    return z.reduce("k", F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("n")).df


MODE_SQL = """WITH a AS (SELECT l_suppkey AS k, CAST(l_quantity AS BIGINT) AS v, count(*) AS w FROM lineitem GROUP BY ALL)
SELECT k, min(v) AS mode, CAST(1 AS BIGINT) AS w FROM a WHERE w = (SELECT max(w) FROM a AS b WHERE b.k = a.k) GROUP BY k"""


@query(MODE_SQL)
def reduce_custom(s: SparkSession, d: str) -> DataFrame:
    z = relation(s, d, "lineitem", F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("v"))
    most = lambda a: F.element_at(F.filter(a, lambda x: x["w"] == F.array_max(F.transform(a, lambda y: y["w"]))), 1)["v"]
    return z.reduce_entries("k", most, "mode").df


@query(MODE_SQL)
def reduce_python(s: SparkSession, d: str) -> DataFrame:
    def mode(t):
        import pyarrow as pa

        best = min(zip(t.column("w").to_pylist(), t.column("v").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        return pa.table({"k": t.column("k").slice(0, 1), "mode": pa.array([best[1]], pa.int64())})

    z = relation(s, d, "lineitem", F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("v"))
    return z.reduce_table("k", mode, "k long, mode long").df


@query("SELECT o_custkey, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price FROM orders GROUP BY o_custkey")
def probe_map(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("o_custkey long, price long")
    p = r.group_max("o_custkey").probe()
    x = c.begin()
    i.send_all(priced(s, d))
    x.commit()
    return p.inspect(x)


@query("SELECT n_regionkey, n_name, CAST(count(*) AS BIGINT) AS w FROM nation GROUP BY ALL")
def kv_output(s: SparkSession, d: str) -> DataFrame:
    return by_key(relation(s, d, "nation", "n_regionkey", "n_name"), "n_regionkey").select("n_regionkey", F.inline("entries"))


@query("SELECT o_custkey AS first, count(*) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY o_custkey")
def extrema_output(s: SparkSession, d: str) -> DataFrame:
    return extrema(relation(s, d, "orders", "o_custkey", "o_orderkey"), "o_custkey").limit(1).select(F.col("o_custkey").alias("first"), F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["w"]).alias("n"))


@query(f"SELECT CAST(sum({SIGNED_SQL}) AS BIGINT) AS w FROM lineitem HAVING sum({SIGNED_SQL}) <> 0")
def scalar_output(s: SparkSession, d: str) -> DataFrame:
    return scalar(flagged(s, d))


@query("SELECT n_regionkey, n_name, CAST(count(*) AS BIGINT) AS w FROM nation GROUP BY ALL")
def graph_kv_output(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("n_regionkey int, n_name string")
    o, x = r.into_kv_output("n_regionkey"), c.begin()
    i.add_all(table(s, d, "nation").select("n_regionkey", "n_name"))
    x.commit()
    return o.get(x).select("n_regionkey", F.inline("entries"))


@query("SELECT o_custkey AS first, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY o_custkey")
def graph_extrema_output(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("o_custkey long, o_orderkey long")
    o, x = r.into_extrema_output("o_custkey"), c.begin()
    i.add_all(table(s, d, "orders").select("o_custkey", "o_orderkey"))
    x.commit()
    return o.get(x).limit(1).select(F.col("o_custkey").alias("first"), F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["w"]).alias("n"))


@query(f"SELECT CAST(sum({SIGNED_SQL}) AS BIGINT) AS w FROM lineitem HAVING sum({SIGNED_SQL}) <> 0")
def graph_own_layout(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input_("l_partkey long, l_returnflag string")
    o, x = r.into_output_(scalar), c.begin()
    i.send_all(flagged(s, d))
    x.commit()
    return o.get(x)


@query(bag("a AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 2 END AS w FROM lineitem)", "l_partkey", "a"))
def raw_input(s: SparkSession, d: str) -> DataFrame:
    """Items of any columns; what counts as their weight is said by map_."""
    c = CreationContext(s)
    i, r = c.new_input_("part long, flag string")
    o, x = r.map_(F.col("part").alias("l_partkey"), F.when(F.col("flag") == "R", -1).otherwise(2).cast("bigint").alias("w")).into_output(), c.begin()
    i.add_all(table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))
    x.commit()
    return o.get(x)


@query(bag("a AS (SELECT event_type, 2 AS w FROM events)", "event_type", "a") + " UNION ALL SELECT 'heard', CAST(2 * count(*) AS BIGINT) FROM events")
def input_handles(s: SparkSession, d: str) -> DataFrame:
    """Two handles on one input; listeners on the input and on the output."""
    c, heard, told = CreationContext(s), [], []
    i, r = c.new_input("event_type string")
    i.add_listener(heard.append)
    o, twin = r.into_output(), i.clone()
    o.add_listener(lambda: told.append(1))
    x = c.begin()
    for handle in (i, twin):
        handle.add_all(table(s, d, "events").select("event_type"))
    x.commit()
    if not told:
        raise AssertionError("the output's listener wasn't called")
    return o.get(x).unionByName(heard[0].unionByName(heard[1]).agg(F.sum("w").alias("w")).select(F.lit("heard").alias("event_type"), "w"))


@query(bag("a AS (SELECT 'l' AS side, l_partkey AS k, 1 AS w FROM lineitem UNION ALL SELECT 'r', l_suppkey, -1 FROM lineitem)", "side, k", "a"))
def split_raw(s: SparkSession, d: str) -> DataFrame:
    """The raw form of a split: each branch sets its own weights."""
    c = CreationContext(s)
    i, r = c.new_input("l_partkey long, l_suppkey long")
    left, right = r.split_([F.lit("l").alias("side"), F.col("l_partkey").alias("k"), "w"], [F.lit("r").alias("side"), F.col("l_suppkey").alias("k"), (-F.col("w")).alias("w")])
    o, x = left.concat(right).into_output(), c.begin()
    i.add_all(table(s, d, "lineitem").select("l_partkey", "l_suppkey"))
    x.commit()
    return o.get(x)


@query("SELECT o_custkey, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price, CAST(1 AS BIGINT) AS w, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def reduce_with_output(s: SparkSession, d: str) -> DataFrame:
    """A reduction whose result map is the caller's own (prices by customer), read beside the relation's own output, after a retraction."""
    c = CreationContext(s)
    i, r = c.new_input("o_custkey long, price long")
    best, results = r.reduce_with_output_("o_custkey", lambda z: z.reduce("o_custkey", F.max("price").alias("price"), F.sum("w").alias("n")), lambda z: z.consolidate().df.select("o_custkey", "n"))
    o = best.map("o_custkey", "price").into_output()
    if not best.is_reduce or r.is_reduce:
        raise AssertionError("only the reduction has a result map")
    x = c.begin()
    orders = table(s, d, "orders").select("o_custkey", cents("o_totalprice").alias("price"), "o_orderstatus")
    i.add_all(orders.drop("o_orderstatus"))
    x.commit()
    o.get(x)
    i.remove_all(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"))
    x.commit()
    return o.get(x).join(results.inspect(x), "o_custkey").select("o_custkey", "price", "w", "n")


@query("SELECT price, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM (SELECT max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price FROM orders GROUP BY o_custkey) GROUP BY price")
def probe_downstream(s: SparkSession, d: str) -> DataFrame:
    """The reduction behind a probe goes on being used."""
    c = CreationContext(s)
    i, r = c.new_input("o_custkey long, price long")
    p = r.group_max("o_custkey").probe()
    o, x = p.get_relation().snds("o_custkey").counts().into_output(), c.begin()
    i.send_all(priced(s, d))
    x.commit()
    return o.get(x)


@query(bag("a AS (SELECT o_custkey AS k, 1 AS w FROM orders UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, -1 FROM orders WHERE o_orderpriority = '1-URGENT')", "k", "a"))
def shared_relation(s: SparkSession, d: str) -> DataFrame:
    """One saved relation with three readers, debugged, typed and named on the way."""
    c = CreationContext(s)
    i, r = c.new_input("k long, status string, priority string")
    saved = r.t("k long, status string, priority string").debug("orders").named("orders").collect().save()
    failed = saved.get().filter("status = 'F'").conditional_debug("failed", F.col("k") == 1).map("k")
    urgent_ = saved.get_shown().filter("priority = '1-URGENT'").map_h("k")
    o, x = saved.clone().dynamic().map("k").concat(failed).minus(urgent_).into_output(), c.begin()
    i.add_all(table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    x.commit()
    return o.get(x)


@query("SELECT * FROM (VALUES ('input', 0, 3), ('relation', 1, 3), ('output', 3, 4)) AS t(part, tracking_index, shown)")
def graph_dump(s: SparkSession, d: str) -> DataFrame:
    """Indices of an input, a relation and an output, and how many operators the dump shows without and with the output."""
    c = CreationContext(s)
    i, r = c.new_input("k long")
    hidden = r.map_h("k")
    counted = hidden.counts().type_named("count").named("numbers")
    at, text = io.StringIO(), io.StringIO()
    c.tracker.dump_dot(at)
    o, x = counted.into_output(), c.begin()
    i.add(1)
    x.commit()
    o.get(x)
    x.tracker.dump_dot(text)
    if "numbers" not in text.getvalue() or 'label="map' in text.getvalue():
        raise AssertionError("names are shown, hidden operators aren't")
    shown = lambda t: t.getvalue().count("label=")
    rows = [("input", i.tracking_index, shown(at) + 1), ("relation", hidden.tracking_index, shown(text)), ("output", o.tracking_index, shown(text) + 1)]
    return s.createDataFrame(rows, "part string, tracking_index int, shown int")


#: Lines by part and by supplier are added, then the returned ones are taken back.
LEFT_SQL = "l AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R')"


def retracted(s: SparkSession, d: str, build: Callable, *columns: tuple[str, ...]) -> DataFrame:
    """What ``build`` makes of relations of these columns of lineitem after two commits: all lines in, then the returned ones out, the output read after each."""
    c = CreationContext(s)
    made = [c.new_input(", ".join(f"{x} long" for x in names)) for names in columns]
    o, x = build(*[r for _, r in made]).into_output(), c.begin()
    lines = table(s, d, "lineitem")
    for df, w in ((lines, 1), (lines.where("l_returnflag = 'R'"), -1)):
        for (i, _), names in zip(made, columns, strict=True):
            i.send_all(df.select(*[F.col(f"l_{n}").cast("long").alias(n) for n in names]), w)
        x.commit()
        o.get(x).count()
    return o.get(x)


@query(f"WITH {LEFT_SQL} SELECT l_partkey AS partkey, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM l GROUP BY ALL")
def retract_counts(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a: a.counts(), ("partkey",))


@query(f"WITH {LEFT_SQL} SELECT l_partkey AS partkey, CAST(min(l_quantity) AS BIGINT) AS quantity, CAST(1 AS BIGINT) AS w FROM l GROUP BY ALL")
def retract_group_min(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a: a.group_min("partkey"), ("partkey", "quantity"))


@query(f"WITH {LEFT_SQL} SELECT l_suppkey AS suppkey, CAST(sum(l_quantity) AS BIGINT) AS total, CAST(1 AS BIGINT) AS w FROM l GROUP BY ALL")
def retract_reduce(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a: a.reduce("suppkey", F.sum(F.col("quantity") * F.col("w")).alias("total")), ("suppkey", "quantity"))


KEYS_SQL = f"{LEFT_SQL}, p AS (SELECT l_partkey AS k, count(*) AS n FROM l GROUP BY ALL), q AS (SELECT l_suppkey AS k, count(*) AS n FROM l GROUP BY ALL)"


@query(f"WITH {KEYS_SQL} SELECT p.k, CAST(p.n * q.n AS BIGINT) AS w FROM p JOIN q USING (k)")
def retract_intersection(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a, b: a.map(F.col("partkey").alias("k")).intersection(b.map(F.col("suppkey").alias("k"))), ("partkey",), ("suppkey",))


@query(f"WITH {KEYS_SQL} SELECT k, CAST(n AS BIGINT) AS w FROM p WHERE k NOT IN (SELECT k FROM q)")
def retract_set_minus(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a, b: a.map(F.col("partkey").alias("k")).set_minus(b.map(F.col("suppkey").alias("k"))), ("partkey",), ("suppkey",))


@query(f"WITH {KEYS_SQL}, a AS (SELECT l_partkey AS k, l_orderkey AS orderkey, count(*) AS n FROM l GROUP BY ALL) SELECT a.k, orderkey, CAST(a.n * q.n AS BIGINT) AS w FROM a JOIN q USING (k)")
def retract_semijoin(s: SparkSession, d: str) -> DataFrame:
    return retracted(s, d, lambda a, b: a.map(F.col("partkey").alias("k"), "orderkey").semijoin(b.map(F.col("suppkey").alias("k")), "k"), ("partkey", "orderkey"), ("suppkey",))


@query(f"""WITH {LEFT_SQL}, a AS (SELECT l_partkey AS x, l_suppkey AS y, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT l_partkey AS x, l_orderkey AS z, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT l_suppkey AS y, l_orderkey AS z, count(*) AS n FROM l GROUP BY ALL)
SELECT a.x, a.y, b.z, CAST(a.n * b.n * c.n AS BIGINT) AS w FROM a JOIN b ON a.x = b.x JOIN c ON a.y = c.y AND b.z = c.z""")
def retract_triangles(s: SparkSession, d: str) -> DataFrame:
    named = lambda r, *names: r.map(*[F.col(c).alias(n) for c, n in zip(r.columns, names, strict=True)])
    build = lambda a, b, c: named(a, "x", "y").triangles(named(b, "x", "z"), named(c, "y", "z"))
    return retracted(s, d, build, ("partkey", "suppkey"), ("partkey", "orderkey"), ("suppkey", "orderkey"))


EVENTS = "user_id long, event_type string"


def events(s: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    e = table(s, d, "events")
    return (e if parity is None else e.where(F.pmod(F.dayofmonth("ts"), F.lit(2)) == parity)).select("user_id", "event_type")


@query("SELECT user_id, event_type, CAST(1 AS BIGINT) AS w FROM events WHERE day(ts) % 2 = 1 AND event_type <> 'click' GROUP BY ALL")
def two_commits(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input(EVENTS)
    o, x = r.filter("event_type <> 'click'").distinct().into_output(), c.begin()
    i.add_all(events(s, d))
    x.commit()
    i.remove_all(events(s, d, 0))
    x.commit()
    return o.get(x)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM events GROUP BY user_id")
def frame_rollback(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_trackable_input(EVENTS)
    o, x = r.fsts("user_id").counts().into_output(), c.begin()
    i.add_all(events(s, d))
    x.commit()

    def what_if(x):
        i.remove_all(events(s, d, 1))
        x.commit()

    x.in_frame(what_if)
    x.commit()
    return o.get(x)


@query("""WITH m AS (SELECT CAST((min(epoch(ts)) + max(epoch(ts))) / 2 AS BIGINT) AS x FROM events),
a AS (SELECT user_id, event_type, CASE WHEN epoch(ts) < x THEN 0 ELSE 1 END AS batch FROM events, m)
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS w FROM a WHERE batch = (SELECT min(batch) FROM a AS b WHERE b.user_id = a.user_id) GROUP BY ALL""")
def first_occurrence(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input(EVENTS)
    o = c.first_occurrences(r, "user_id").into_output()
    x, e = c.begin(), table(s, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    lo, hi = e.agg(F.min("at"), F.max("at")).first()
    middle = round((lo + hi) / 2)
    for late in (False, True):
        i.add_all(e.where((F.col("at") >= middle) == F.lit(late)).select("user_id", "event_type"))
        x.commit()
    return o.get(x)


@query(f"WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM e JOIN r ON src = node) SELECT node, CAST(1 AS BIGINT) AS w FROM r")
def reach_feed(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("node long")
    e, links = c.new_input("src long, dst long")
    known = r.distinct()
    c.feed(known.map(F.col("node").alias("src")).join(links, "src").map(F.col("dst").alias("node")), i)
    o, x = known.into_output(), c.begin()
    e.send_all(edges(s, d).map("src", "dst").distinct())
    i.add(1)
    x.commit()
    return o.get(x)


def shortest_sql(step: str) -> str:
    """Least distances from node 1, by rounds until nothing gets shorter."""
    return f"""WITH RECURSIVE {GRAPH_SQL}, r(node, dist) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION
SELECT dst, CAST(min(r.dist + {step}) AS BIGINT) FROM r JOIN e ON src = r.node LEFT JOIN recurring.r AS old ON old.node = dst GROUP BY dst HAVING coalesce(min(r.dist + {step}) < min(old.dist), true))"""


@query(f"{shortest_sql('1')} SELECT node, dist, CAST(1 AS BIGINT) AS w FROM r")
def bfs_levels(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("node long, dist long")
    e, links = c.new_input("src long, dst long")
    best = r.group_min("node")
    c.feed(best.map(F.col("node").alias("src"), "dist").join(links, "src").map(F.col("dst").alias("node"), (F.col("dist") + 1).alias("dist")), i)
    o, x = best.into_output(), c.begin()
    e.send_all(edges(s, d).map("src", "dst").distinct())
    i.add(1, 0)
    x.commit()
    return o.get(x)


def paths(s: SparkSession, end: int | None):
    c = CreationContext(s)
    i, r = c.new_input("node long, dist long")
    e, links = c.new_input("src long, dst long, len long")
    best = r.group_min("node")
    if end is not None:
        c.interrupt(best.filter(F.col("node") == end).into_output(), lambda df: df.first()["dist"])
    c.feed_ordered(best.map(F.col("node").alias("src"), "dist").join(links, "src").map((F.col("dist") + F.col("len")).alias("k"), F.col("dst").alias("node"), (F.col("dist") + F.col("len")).alias("dist")), i, "k")
    return i, e, best.into_output(), c.begin()


@query(f"{shortest_sql('len')} SELECT node, dist, CAST(1 AS BIGINT) AS w FROM r")
def sssp_feed_ordered(s: SparkSession, d: str) -> DataFrame:
    i, e, o, x = paths(s, None)
    e.send_all(edges(s, d))
    i.add(1, 0)
    x.commit()
    return o.get(x)


@query(f"{shortest_sql('len')} SELECT node, dist FROM r WHERE node = 140")
def sssp_interrupt(s: SparkSession, d: str) -> DataFrame:
    i, e, _, x = paths(s, 140)
    e.send_all(edges(s, d))
    i.add(1, 0)
    found = x.commit()
    return s.createDataFrame([] if found is None else [(140, found)], "node long, dist long")


@query("SELECT user_id, CAST(1 AS BIGINT) AS w FROM events GROUP BY user_id")
def feed_while_accumulate(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input(EVENTS)
    seen_in, seen = c.new_input("user_id long")
    c.feed_while(r.fsts("user_id").distinct().antijoin(seen, "user_id").into_output(), seen_in)
    o, x = seen.into_output(), c.begin()
    for parity in (0, 1):
        i.add_all(events(s, d, parity))
        x.commit()
    return o.get(x)


GAME = "SELECT CAST({} AS BIGINT) AS positions, CAST({} AS BIGINT) AS edges, CAST({} AS BIGINT) AS inner, CAST({} AS BIGINT) AS p1, CAST({} AS BIGINT) AS draw, CAST({} AS BIGINT) AS p2"


@query(GAME.format(5478, 16167, 4520, 2310, 1052, 1158).replace("AS inner", 'AS "inner"'))
def game_ttt(s: SparkSession, d: str) -> DataFrame:
    return summary(tic_tac_toe(s))


@query(GAME.format(1163, 3084, 1115, 356, 403, 356).replace("AS inner", 'AS "inner"'))
def game_fingers(s: SparkSession, d: str) -> DataFrame:
    return summary(fingers(s))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS w FROM events GROUP BY event_type")
def stream_foreach_batch(s: SparkSession, d: str) -> DataFrame:
    c = CreationContext(s)
    i, r = c.new_input("event_type string")
    o, x = r.counts().into_output(), c.begin()
    source = table(s, d, "events")
    stream = s.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_type")
    running = stream.writeStream.foreachBatch(StreamCommits(x, i)).trigger(availableNow=True).start()
    running.awaitTermination()
    return o.get(x)
