from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words
from ..operators import epochs, graph, incremental, loops, partitioning
from ..operators.staging import stage
from ..operators.zset import ZSet
from . import programs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Node numbers of regions, nations, customers, suppliers and parts in one graph.
REGION, NATION, CUSTOMER, SUPPLIER, PART = 0, 1_000, 1_000_000_000, 2_000_000_000, 3_000_000_000
PLACES = f"""
places AS (SELECT {REGION} + n_regionkey AS src, {NATION} + n_nationkey AS dst FROM nation
  UNION ALL SELECT {NATION} + c_nationkey, {CUSTOMER} + c_custkey FROM customer
  UNION ALL SELECT {NATION} + s_nationkey, {SUPPLIER} + s_suppkey FROM supplier)"""
TRADE = """
sold AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
trade AS (SELECT src, dst FROM sold WHERE src <> dst AND n * (SELECT count(*) FROM sold) > 1.2 * (SELECT sum(n) FROM sold))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def places(s: SparkSession, sf: str) -> DataFrame:
    n, c, p = t(s, sf, "nation"), t(s, sf, "customer"), t(s, sf, "supplier")
    e = lambda df, a, b: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"))
    return e(n, REGION + F.col("n_regionkey"), NATION + F.col("n_nationkey")).union(e(c, NATION + F.col("c_nationkey"), CUSTOMER + F.col("c_custkey"))).union(e(p, NATION + F.col("s_nationkey"), SUPPLIER + F.col("s_suppkey")))


def trade(s: SparkSession, sf: str) -> DataFrame:
    """Nations that sell to others more than 1.2 times as much as is usual."""
    li = t(s, sf, "lineitem").select("l_suppkey", "l_orderkey")
    rows = li.join(t(s, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(t(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t(s, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sold = stage(rows.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n")), "sold")
    mean = sold.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))  # one row
    return stage(sold.crossJoin(F.broadcast(mean)).filter("src <> dst AND n * k > 1.2 * all").select("src", "dst"), "trade")


def daily(s: SparkSession, sf: str) -> DataFrame:
    """Events with their day as epoch."""
    return t(s, sf, "events").withColumn("epoch", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long"))


DAY = "date_diff('day', DATE '2024-01-01', ts::DATE)"


def purses(s: SparkSession, sf: str) -> tuple[ZSet, ZSet]:
    """Nations of customers and of suppliers, as multisets."""
    return ZSet.of(t(s, sf, "customer").select(F.col("c_nationkey").alias("nation"))), ZSet.of(t(s, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


def _pair(expr: str) -> str:
    return f"""WITH a AS (SELECT c_nationkey AS nation, count(*) AS w FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS w FROM supplier GROUP BY 1),
    m AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.w, 0) AS x, coalesce(b.w, 0) AS y FROM a FULL JOIN b ON a.nation = b.nation)
    SELECT nation, ({expr})::BIGINT AS weight FROM m WHERE ({expr}) <> 0"""


# Words.
@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def wordcount(s, sf):
    return programs.word_counts(ZSet.of(t(s, sf, "documents").select("text")), "text").df.select("word", "n")


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)")
def distinct_words(s, sf):
    return ZSet.of(t(s, sf, "documents").select("text")).select_many(words(F.col("text")), "word").distinct().df.select("word")


@query("""WITH d AS (SELECT DISTINCT doc_id AS doc, unnest(string_split(text, ' ')) AS term FROM documents),
q AS (SELECT DISTINCT item_id AS query, unnest(string_split(text, ' ')) AS term FROM benchmark)
SELECT doc, query, count(*) AS n FROM d JOIN q USING (term) GROUP BY doc, query HAVING count(*) >= 20""")
def search_index(s, sf):
    q = t(s, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(20).alias("threshold"))
    return programs.search(t(s, sf, "documents").select(F.col("doc_id").alias("id"), "text"), q)


# Record by record.
@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, 1::BIGINT AS weight FROM lineitem WHERE l_discount > 0.05")
def select_where(s, sf):
    return ZSet.of(t(s, sf, "lineitem")).where("l_discount > 0.05").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice")).df


@query("SELECT unnest(string_split(l_returnflag || ' ' || l_linestatus, ' ')) AS flag, 1::BIGINT AS weight FROM lineitem")
def select_many(s, sf):
    return ZSet.of(t(s, sf, "lineitem")).select_many(F.split(F.concat_ws(" ", "l_returnflag", "l_linestatus"), " "), "flag").df


@query("SELECT unnest(list_slice(string_split(text, ' '), 2, 3)) AS word, doc_id FROM documents")
def select_many_segment(s, sf):
    return t(s, sf, "documents").select("doc_id", F.explode(F.slice(words(F.col("text")), 2, 2)).alias("word"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def select_by_partition(s, sf):
    return epochs.select_by_partition(daily(s, sf), "event_type").groupBy("event_type").agg(F.count("partition").alias("n"))


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY 1")
def unary_expression(s, sf):
    def spread(parts):
        import pandas as pd

        low, high = {}, {}
        for rows in parts:  # of all keys of the partition
            got = rows.groupby("event_type")["value"].agg(["min", "max"])
            for k, a, b in got.itertuples():
                low[k], high[k] = min(a, low.get(k, a)), max(b, high.get(k, b))
        yield pd.DataFrame({"event_type": list(low), "spread": [high[k] - low[k] for k in low]})

    return epochs.per_partition(t(s, sf, "events").select("event_type", "value"), ["event_type"], spread, "event_type string, spread double")


@query("SELECT coalesce(o_custkey, c_custkey) AS cust, c_custkey IS NOT NULL AS known, coalesce(n, 0)::BIGINT AS n FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def binary_expression(s, sf):
    def both(parts):
        import pandas as pd

        known, n = set(), {}
        for rows in parts:
            known.update(rows.loc[rows["#side"] == 0, "c_custkey"].astype("int64"))
            for k, v in rows.loc[rows["#side"] == 1, "o_custkey"].astype("int64").value_counts().items():
                n[k] = n.get(k, 0) + v
        every = sorted(known | set(n))
        yield pd.DataFrame({"cust": every, "known": [k in known for k in every], "n": [n.get(k, 0) for k in every]})

    return epochs.binary_expression(t(s, sf, "customer").select("c_custkey"), t(s, sf, "orders").select("o_custkey"), ["c_custkey"], ["o_custkey"], both, "cust long, known boolean, n long")


# Joins.
@query("SELECT o_orderkey, l_linenumber, o_custkey, 1::BIGINT AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_orders_lineitem(s, sf):
    a, b = (ZSet.of(t(s, sf, n).select(*c)) for n, c in (("orders", ["o_orderkey", "o_custkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])))
    return a.join(b, "o_orderkey", "l_orderkey", "o_orderkey", "l_linenumber", "o_custkey").df


@query("SELECT c_nationkey AS nation, sum(x * y)::BIGINT AS weight FROM (SELECT c_nationkey, count(*) AS x FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, count(*) AS y FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey GROUP BY 1")
def join_weighted(s, sf):
    a, b = purses(s, sf)
    return a.consolidate().join(b.consolidate(), "nation", "nation", F.col("l.nation").alias("nation")).consolidate().df


@query("""SELECT c_custkey AS cust, coalesce(n, 0)::BIGINT AS n_orders FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def cogroup_counts(s, sf):
    def count(key, a, b):
        import pandas as pd

        return pd.DataFrame({"cust": [key[0]], "n_orders": [int(b["weight"].sum())]})

    a, b = ZSet.of(t(s, sf, "customer").select(F.col("c_custkey").alias("cust"))), ZSet.of(t(s, sf, "orders").select(F.col("o_custkey").alias("cust")))
    return a.co_group_weighted(b, "cust", "cust", lambda k, x, y: count(k, x, y).assign(weight=1), "cust long, n_orders long, weight long").df.drop("weight")


@query(f"""SELECT g.epoch, g.user_id, max(p.value) AS value FROM (SELECT {DAY} AS epoch, user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events)) g
JOIN (SELECT {DAY} AS epoch, user_id, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2) p
ON p.user_id = g.user_id AND p.epoch = (SELECT max({DAY}) FROM events e WHERE e.user_id = g.user_id AND e.event_type = (SELECT min(event_type) FROM events) AND {DAY} <= g.epoch)
GROUP BY g.epoch, g.user_id""")
def key_value_lookup(s, sf):
    e = daily(s, sf)
    kinds = e.agg(F.min("event_type").alias("put"), F.max("event_type").alias("get")).first()
    return epochs.lookup(e.filter(F.col("event_type") == kinds["put"]), e.filter(F.col("event_type") == kinds["get"]), "user_id", "value").distinct()


# Aggregations.
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, 1::BIGINT AS weight FROM lineitem GROUP BY 1, 2")
def count_by_key(s, sf):
    return ZSet.of(t(s, sf, "lineitem")).count(["l_returnflag", "l_linestatus"]).df


@query("SELECT l_suppkey, sum(l_linenumber)::BIGINT AS total, 1::BIGINT AS weight FROM lineitem GROUP BY 1")
def sum_int(s, sf):
    return ZSet.of(t(s, sf, "lineitem").select("l_suppkey", "l_linenumber")).sum("l_suppkey", "l_linenumber").df


@query("SELECT l_suppkey, sum(l_orderkey)::BIGINT AS total, 1::BIGINT AS weight FROM lineitem GROUP BY 1")
def sum_long(s, sf):
    return ZSet.of(t(s, sf, "lineitem").select("l_suppkey", "l_orderkey")).sum("l_suppkey", "l_orderkey").df


@query("SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS total FROM lineitem GROUP BY 1")
def sum_double(s, sf):
    return ZSet.of(t(s, sf, "lineitem").select("l_suppkey", "l_extendedprice")).sum("l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).df.select("l_suppkey", F.col("total").cast("double").alias("total"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, sum(l_linenumber)::BIGINT AS lines, sum(l_quantity)::BIGINT AS quantity, 1::BIGINT AS weight FROM lineitem GROUP BY 1")
def aggregate_linear(s, sf):
    rows = t(s, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return ZSet.of(rows).aggregate("day", lines="l_linenumber", quantity="q").df


@query("SELECT o_custkey, o_orderkey, o_totalprice, 1::BIGINT AS weight FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_custkey, o_orderkey) = 1")
def min_record(s, sf):
    return ZSet.of(t(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")).min("o_custkey", "o_totalprice").df


@query("SELECT o_custkey, o_orderkey, o_totalprice, 1::BIGINT AS weight FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey DESC) = 1")
def max_record(s, sf):
    return ZSet.of(t(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")).max("o_custkey", "o_totalprice").df


@query("SELECT s_nationkey AS nation, min(s_suppkey) AS first, max(s_suppkey) AS last, 1::BIGINT AS weight FROM supplier GROUP BY 1")
def group_by_reducer(s, sf):
    def ends(rows):
        return rows.groupby("nation")["supp"].agg(first="min", last="max").reset_index()

    return ZSet.of(t(s, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supp"))).group_by("nation", ends, "nation int, first long, last long").df


# Multisets.
@query(_pair("x + y"))
def zset_concat(s, sf):
    a, b = purses(s, sf)
    return a.concat(b).consolidate().df


@query(_pair("x - y"))
def zset_except(s, sf):
    a, b = purses(s, sf)
    return a.except_(b).consolidate().df


@query(_pair("greatest(x, y)"))
def zset_union(s, sf):
    a, b = purses(s, sf)
    return a.union(b).df


@query(_pair("least(x, y)"))
def zset_intersect(s, sf):
    a, b = purses(s, sf)
    return a.intersect(b).df


@query(_pair("abs(x - y)"))
def zset_symmetric_difference(s, sf):
    a, b = purses(s, sf)
    return a.symmetric_difference(b).df


@query(_pair("CASE WHEN x - 10 * y > 0 THEN 1 ELSE 0 END"))
def zset_distinct(s, sf):
    a, b = purses(s, sf)
    return a.except_(ZSet(b.df.withColumn("weight", F.col("weight") * 10))).distinct().df


@query(_pair("abs(x - 20 * y)"))
def zset_abs(s, sf):
    a, b = purses(s, sf)
    return a.except_(ZSet(b.df.withColumn("weight", F.col("weight") * 20))).abs().df


@query("SELECT p_brand, p_size, count(*) AS weight FROM part GROUP BY 1, 2")
def zset_consolidate(s, sf):
    return ZSet.of(t(s, sf, "part").select("p_brand", "p_size")).consolidate("p_brand").df


# By epoch.
def _types(s, sf):
    e = daily(s, sf)
    half = lambda c: e.filter(c).select("epoch", "user_id")
    return half("value > 50"), half("value <= 50")


HALVES = f"WITH a AS (SELECT {DAY} AS epoch, user_id FROM events WHERE value > 50), b AS (SELECT {DAY} AS epoch, user_id FROM events WHERE value <= 50) "


@query(HALVES + "SELECT * FROM a UNION SELECT * FROM b")
def epoch_union(s, sf):
    return epochs.union(*_types(s, sf))


@query(HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b")
def epoch_concat(s, sf):
    return epochs.concat(*_types(s, sf))


@query(HALVES + "SELECT * FROM a INTERSECT SELECT * FROM b")
def epoch_intersect(s, sf):
    return epochs.intersect(*_types(s, sf))


@query(HALVES + "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.epoch = a.epoch AND b.user_id = a.user_id)")
def epoch_except(s, sf):
    return epochs.except_(*_types(s, sf))


@query(HALVES + "SELECT DISTINCT * FROM a")
def epoch_distinct(s, sf):
    return epochs.distinct(_types(s, sf)[0])


@query(HALVES + "SELECT epoch, user_id, count(*) AS n FROM a GROUP BY 1, 2")
def epoch_count(s, sf):
    return epochs.count(_types(s, sf)[0])


@query(HALVES + "SELECT a.epoch, a.user_id, count(*) AS n FROM a JOIN b ON a.epoch = b.epoch AND a.user_id = b.user_id GROUP BY 1, 2")
def epoch_join(s, sf):
    a, b = _types(s, sf)
    return epochs.count(epochs.join(a, b, ["user_id"], ["user_id"], F.col("l.user_id").alias("user_id")))


@query(f"SELECT {DAY} AS epoch, event_type, min(value) AS value FROM events GROUP BY 1, 2")
def epoch_min(s, sf):
    return epochs.minimum(daily(s, sf), ["event_type"], "value")


@query(f"SELECT {DAY} AS epoch, event_type, max(value) AS value FROM events GROUP BY 1, 2")
def epoch_max(s, sf):
    return epochs.maximum(daily(s, sf), ["event_type"], "value")


@query(f"SELECT {DAY} AS epoch, event_type, bit_xor(event_id) AS folded FROM events GROUP BY 1, 2")
def epoch_aggregate(s, sf):
    return epochs.aggregate(daily(s, sf), ["event_type"], F.bit_xor("event_id").alias("folded"))


@query(f"SELECT {DAY} AS epoch, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def epoch_group_by(s, sf):
    def users(rows):
        return rows.groupby(["epoch", "event_type"])["user_id"].nunique().rename("users").reset_index()

    return epochs.group_by(daily(s, sf).select("epoch", "event_type", "user_id").distinct(), ["event_type"], users, "epoch long, event_type string, users long")


@query(HALVES + "SELECT epoch, user_id, coalesce(x, 0)::BIGINT AS high, coalesce(y, 0)::BIGINT AS low FROM (SELECT epoch, user_id, count(*) AS x FROM a GROUP BY 1, 2) FULL JOIN (SELECT epoch, user_id, count(*) AS y FROM b GROUP BY 1, 2) USING (epoch, user_id)")
def epoch_cogroup(s, sf):
    def both(key, a, b):
        import pandas as pd

        return pd.DataFrame({"epoch": [key[0]], "user_id": [key[1]], "high": [int(a["n"].sum())], "low": [int(b["n"].sum())]})

    a, b = (epochs.count(x) for x in _types(s, sf))
    return epochs.co_group_by(a, b, ["user_id"], ["user_id"], both, "epoch long, user_id long, high long, low long")


@query(f"SELECT e.epoch + k AS epoch, event_type, count(*) AS n FROM (SELECT {DAY} AS epoch, event_type FROM events) e, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2")
def sliding_window_counts(s, sf):
    return epochs.sliding_counts(daily(s, sf), ["event_type"], 3)


@query(f"SELECT epoch, event_type, sum(w)::BIGINT AS weight FROM (SELECT {DAY} AS epoch, event_type, 1 AS w FROM events UNION ALL SELECT {DAY} + 3, event_type, -1 FROM events) GROUP BY 1, 2 HAVING sum(w) <> 0")
def sliding_window_changes(s, sf):
    return ZSet.of(daily(s, sf).select("epoch", "event_type")).sliding_window(3).consolidate().df


@query(f"SELECT greatest({DAY}, 10) AS epoch, count(*) AS weight FROM events GROUP BY 1")
def adjust_time(s, sf):
    return ZSet.of(daily(s, sf).select("epoch")).adjust_time(F.lit(10).cast("long")).consolidate().df


@query(f"SELECT count(*) AS dropped FROM events WHERE {DAY} <= 9")
def late_events(s, sf):
    return epochs.late(daily(s, sf), 9)[1]


@query(f"""WITH w AS (SELECT user_id, {DAY} AS epoch, event_type FROM events),
old AS (SELECT user_id, count(*) AS n FROM w WHERE epoch <= 14 GROUP BY 1), new AS (SELECT user_id, count(*) AS n FROM w WHERE epoch <= 15 GROUP BY 1),
c AS (SELECT user_id, n, 1 AS w FROM new UNION ALL SELECT user_id, n, -1 FROM old)
SELECT user_id, n, sum(w)::BIGINT AS weight FROM c GROUP BY 1, 2 HAVING sum(w) <> 0""")
def incremental_count(s, sf):
    e = daily(s, sf).select("epoch", "user_id")
    before, change = ZSet.of(e.filter("epoch <= 14").drop("epoch")), ZSet.of(e.filter("epoch = 15").drop("epoch"))
    return incremental.keyed_delta(before, change, ["user_id"], lambda z: z.count("user_id")).df


@query(f"""WITH a AS (SELECT {DAY} AS epoch, user_id FROM events WHERE value > 50), b AS (SELECT {DAY} AS epoch, user_id FROM events WHERE value <= 50),
j AS (SELECT a.user_id, greatest(a.epoch, b.epoch) AS epoch FROM a JOIN b USING (user_id))
SELECT user_id, count(*) AS weight FROM j WHERE epoch = 15 GROUP BY 1""")
def incremental_join(s, sf):
    a, b = _types(s, sf)
    upto = lambda df: ZSet.of(df.filter("epoch <= 14").drop("epoch")).consolidate()
    at = lambda df: ZSet.of(df.filter("epoch = 15").drop("epoch")).consolidate()
    return incremental.join_delta(upto(a), at(a), upto(b), at(b), "user_id", "user_id", F.col("l.user_id").alias("user_id")).df


# Graphs.
@query(f"WITH {PLACES} SELECT dst AS node, count(*) AS value FROM places GROUP BY 1")
def count_nodes(s, sf):
    return graph.count_nodes(places(s, sf).select(F.col("dst").alias("node")))


@query(f"WITH {PLACES} SELECT DISTINCT src AS node FROM places")
def distinct_nodes(s, sf):
    return graph.distinct_nodes(places(s, sf).select(F.col("src").alias("node")))


@query(f"WITH {PLACES} SELECT b.dst AS node, a.src AS value FROM places a JOIN places b ON b.src = a.dst")
def transmit_along(s, sf):
    e = places(s, sf)
    return graph.transmit_along(e.select(F.col("dst").alias("node"), F.col("src").alias("value")), e)


@query(f"WITH {PLACES} SELECT b.dst AS node, min(a.src) AS value FROM places a JOIN places b ON b.src = a.dst GROUP BY 1")
def graph_reduce(s, sf):
    e = places(s, sf)
    return graph.graph_reduce(e.select(F.col("dst").alias("node"), F.col("src").alias("value")), e, F.min)


@query("SELECT c_nationkey AS node, count(*) AS value FROM customer GROUP BY 1")
def node_aggregate(s, sf):
    return graph.node_aggregate(t(s, sf, "customer").select(F.col("c_nationkey").alias("node"), F.lit(1).cast("long").alias("value")))


@query("SELECT c_custkey AS node, coalesce(n, 0)::BIGINT + 1 AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def node_join(s, sf):
    v = t(s, sf, "customer").select(F.col("c_custkey").alias("node"), F.lit(1).cast("long").alias("value"))
    n = t(s, sf, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("state"))
    return graph.node_join(v, n, F.col("value") + F.col("state"), F.lit(0).cast("long"))


@query("SELECT c_custkey AS node, c_acctbal AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def filter_by(s, sf):
    return graph.filter_by(t(s, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value")), t(s, sf, "orders").select(F.col("o_custkey").alias("node")))


@query(f"SELECT user_id AS node, max(value) AS state FROM events WHERE {DAY} <= 20 GROUP BY 1")
def state_machine(s, sf):
    e = daily(s, sf).select("epoch", F.col("user_id").alias("node"), "value")
    state, better = e.filter("epoch < 0").select("node", F.col("value").alias("state")), F.greatest("state", "value")
    for low, high in ((0, 7), (8, 14), (15, 20)):
        state, _ = graph.state_machine(e.filter(F.col("epoch").between(low, high)).select("node", "value"), state, F.max, better)
    return state


@query("SELECT user_id AS node, max(value) AS state FROM events GROUP BY 1")
def state_machine_all(s, sf):
    """The state machine over all epochs of the table, week by week."""
    e = daily(s, sf).select("epoch", F.col("user_id").alias("node"), "value")
    state, better = e.filter("epoch < epoch").select("node", F.col("value").alias("state")), F.greatest("state", "value")
    first, last = e.agg(F.min("epoch"), F.max("epoch")).first()
    for low in range(first, last + 1, 7) if first is not None else ():
        state, _ = graph.state_machine(e.filter(F.col("epoch").between(low, low + 6)).select("node", "value"), stage(state, "states"), F.max, better)
    return state


@query("""SELECT count(*) AS n, count(DISTINCT n_name) AS names, 0::BIGINT AS least, (SELECT count(DISTINCT x) - 1 FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region)) AS most FROM nation JOIN region ON r_regionkey = n_regionkey""")
def rename_edges(s, sf):
    e = t(s, sf, "nation").join(t(s, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    names = graph.AutoRenamer().add(e, "src", "dst").final()
    named = graph.rename_edges(e, names)
    ends = names.agg(F.min("node").alias("least"), F.max("node").alias("most"))  # one row
    return named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("names")).crossJoin(ends)


REACH = "reach(root, node) AS (SELECT src, dst FROM {0} UNION SELECT root, dst FROM reach JOIN {0} ON src = node)"


@query(f"WITH RECURSIVE {PLACES}, {REACH.format('places')} SELECT DISTINCT node FROM reach WHERE root = 0 UNION SELECT 0")
def reachability(s, sf):
    return programs.reachable(places(s, sf), s.createDataFrame([(0,)], "node long"))


@query(f"""WITH RECURSIVE {PLACES}, {REACH.format('places')}, x AS (SELECT root, node FROM reach UNION SELECT src, src FROM places UNION SELECT dst, dst FROM places)
SELECT node, min(root) AS component FROM x GROUP BY 1""")
def connected_components(s, sf):
    return programs.connected_components(places(s, sf))


@query(f"""WITH RECURSIVE {PLACES}, {REACH.format('places')}, x AS (SELECT root, node FROM reach UNION SELECT src, src FROM places UNION SELECT dst, dst FROM places)
SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM (SELECT node, min(root) AS component FROM x GROUP BY 1) GROUP BY 1) GROUP BY 1""")
def component_sizes(s, sf):
    return programs.component_sizes(places(s, sf))


@query(f"""WITH RECURSIVE {TRADE}, {REACH.format('trade')}, x AS (SELECT root, node FROM reach UNION SELECT src, src FROM trade UNION SELECT dst, dst FROM trade)
SELECT node::BIGINT AS node, min(root)::BIGINT AS value FROM x GROUP BY 1""")
def directed_reach(s, sf):
    return programs.directed_reach(trade(s, sf))


@query(f"WITH RECURSIVE {TRADE}, {REACH.format('trade')} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM trade WHERE EXISTS (SELECT 1 FROM reach WHERE root = dst AND node = src)")
def strongly_connected(s, sf):
    return programs.strongly_connected(trade(s, sf))


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade),
nodes AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT a AS x FROM e UNION SELECT b FROM e)),
near AS (SELECT n.i, n.x, list(m.i) FILTER (m.i IS NOT NULL) AS below FROM nodes n LEFT JOIN e ON e.b = n.x LEFT JOIN nodes m ON m.x = e.a GROUP BY 1, 2),
step(i, node, colors) AS (SELECT 0::BIGINT, NULL::BIGINT, []::INTEGER[] UNION ALL
  SELECT near.i, near.x::BIGINT, list_append(colors, list_min(list_filter(range(0, 100), lambda c: NOT list_contains(list_transform(coalesce(below, []), lambda j: colors[j]), c)))::INTEGER)
  FROM step JOIN near ON near.i = step.i + 1)
SELECT node, colors[i] AS color FROM step WHERE i > 0""")
def graph_coloring(s, sf):
    return programs.coloring(trade(s, sf))


@query(f"""WITH RECURSIVE {TRADE}, deg AS (SELECT src, count(*) AS d FROM trade GROUP BY 1),
step(i, node, value) AS (SELECT 0, src, 0.15::DOUBLE FROM deg UNION ALL
  SELECT * FROM (SELECT i + 1, dst, sum(value * 0.85 / d) FROM step JOIN deg ON deg.src = node JOIN trade ON trade.src = node WHERE i < 11 GROUP BY 1, 2))
SELECT node::BIGINT AS node, round(sum(value), 6) AS value FROM step GROUP BY 1""")
def pagerank(s, sf):
    return programs.pagerank(trade(s, sf)).select("node", F.round("value", 6).alias("value"))


# Loops.
@query("SELECT c_custkey AS node, c_nationkey::BIGINT * 16 AS value FROM customer")
def iterate(s, sf):
    return loops.iterate(t(s, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("value")), lambda d: d.withColumn("value", F.col("value") * 2), 3)


@query("SELECT n_nationkey::BIGINT + k AS value FROM nation, (SELECT unnest([1, 2, 3]) AS k)")
def iterate_and_accumulate(s, sf):
    return loops.iterate_and_accumulate(t(s, sf, "nation").select(F.col("n_nationkey").cast("long").alias("value")), lambda d: d.select((F.col("value") + 1).alias("value")), 2)


@query("SELECT DISTINCT least(p_size::BIGINT + k, 50) AS value FROM part, (SELECT unnest(range(0, 51)) AS k)")
def fixed_point(s, sf):
    start = ZSet.of(t(s, sf, "part").select(F.col("p_size").cast("long").alias("value"))).distinct()
    return loops.fixed_point(start, lambda z: z.concat(z.select(F.least(F.col("value") * 2, F.lit(50)).alias("value"))).concat(z.select(F.least(F.col("value") + 1, F.lit(50)).alias("value"))).distinct()).df.select("value")


@query("SELECT DISTINCT least(p_size::BIGINT + k, 50) AS value FROM part, (SELECT unnest(range(0, 51)) AS k)")
def general_fixed_point(s, sf):
    start = ZSet.of(t(s, sf, "part").select(F.col("p_size").cast("long").alias("value"))).distinct()
    return loops.general_fixed_point(start, lambda z: z.concat(z.select(F.least(F.col("value") + F.col("value") % 7 + 1, F.lit(50)).alias("value"))).concat(z.select(F.least(F.col("value") + 1, F.lit(50)).alias("value"))).distinct(), F.floor(F.col("value") / 25)).df.select("value")


# Graphs whose size grows with the tables: suppliers to parts, parts to customers, customers to suppliers, as items were sold.
MARKET = f"""
sales AS (SELECT {SUPPLIER} + l_suppkey AS s, {PART} + l_partkey AS p, {CUSTOMER} + o_custkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
market AS (SELECT s::BIGINT AS src, p::BIGINT AS dst FROM sales UNION SELECT p, c FROM sales UNION SELECT c, s FROM sales)"""


def market(s: SparkSession, sf: str) -> DataFrame:
    li, o = t(s, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), t(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    node = lambda base, c: (F.lit(base) + F.col(c)).cast("long")
    ends = {"s": node(SUPPLIER, "l_suppkey"), "p": node(PART, "l_partkey"), "c": node(CUSTOMER, "o_custkey")}
    pairs = F.array(*(F.struct(ends[a].alias("src"), ends[b].alias("dst")) for a, b in ("sp", "pc", "cs")))
    return li.join(o, "l_orderkey").select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


@query(f"""WITH RECURSIVE {MARKET}, deg AS (SELECT src, count(*) AS d FROM market GROUP BY 1),
step(i, node, value) AS (SELECT 0, src, 0.15::DOUBLE FROM deg UNION ALL
  SELECT * FROM (SELECT i + 1, dst, sum(value * 0.85 / d) FROM step JOIN deg ON deg.src = node JOIN market ON market.src = node WHERE i < 11 GROUP BY 1, 2))
SELECT node, round(sum(value), 6) AS value FROM step GROUP BY 1""")
def pagerank_market(s, sf):
    return programs.pagerank(market(s, sf)).select("node", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {MARKET}, undirected AS (SELECT src, dst FROM market UNION SELECT dst, src FROM market UNION SELECT src, src FROM market UNION SELECT dst, dst FROM market),
step(i, node, value) AS (SELECT 0, src, src FROM undirected WHERE src = dst UNION ALL SELECT * FROM (SELECT i + 1, dst, min(value) FROM step JOIN undirected ON src = node WHERE i < 16 GROUP BY 1, 2))
SELECT node, value AS component FROM step WHERE i = 16""")
def components_market(s, sf):
    """The SQL follows paths of 16 edges, which reach all there is in these tables."""
    return programs.connected_components(market(s, sf))


@query(f"WITH {MARKET} SELECT src, dst FROM market WHERE src IN (SELECT dst FROM market) AND dst IN (SELECT src FROM market)")
def strongly_connected_market(s, sf):
    """Every sale is a cycle of supplier, part and customer, so that all edges lie within strong components."""
    return programs.strongly_connected(market(s, sf))


REWIRED = f"""WITH RECURSIVE {PLACES}, moved AS (SELECT src, dst FROM places WHERE dst >= {CUSTOMER} AND dst < {SUPPLIER} AND dst % 10 = 0),
after AS (SELECT src, dst FROM places EXCEPT SELECT src, dst FROM moved UNION ALL SELECT DISTINCT dst, dst + 7 FROM moved),
nodes AS (SELECT src AS x FROM places UNION SELECT dst FROM places UNION SELECT dst + 7 FROM moved),
old_edges AS (SELECT src, dst FROM places UNION SELECT dst, src FROM places), new_edges AS (SELECT src, dst FROM after UNION SELECT dst, src FROM after),
old_step(i, node, value) AS (SELECT 0, x, x FROM nodes WHERE x IN (SELECT src FROM old_edges) UNION ALL SELECT * FROM (SELECT i + 1, dst, min(value) FROM (SELECT i, node, value, dst FROM old_step JOIN old_edges ON src = node UNION ALL SELECT i, node, value, node FROM old_step) WHERE i < 12 GROUP BY 1, 2)),
new_step(i, node, value) AS (SELECT 0, x, x FROM nodes UNION ALL SELECT * FROM (SELECT i + 1, dst, min(value) FROM (SELECT i, node, value, dst FROM new_step JOIN new_edges ON src = node UNION ALL SELECT i, node, value, node FROM new_step) WHERE i < 12 GROUP BY 1, 2)),
c AS (SELECT node, value, 1 AS w FROM new_step WHERE i = 12 UNION ALL SELECT node, value, -1 FROM old_step WHERE i = 12)
SELECT node, value AS component, sum(w)::BIGINT AS weight FROM c GROUP BY 1, 2 HAVING sum(w) <> 0"""


@query(REWIRED)
def components_rewired(s, sf):
    """What changes in the components of places when every tenth customer leaves its nation and is linked with the customer 7 numbers on."""
    e = stage(places(s, sf), "edges")
    gone = stage(e.filter((F.col("dst") >= CUSTOMER) & (F.col("dst") < SUPPLIER) & (F.col("dst") % 10 == 0)), "removed")
    new = gone.select(F.col("dst").alias("src"), (F.col("dst") + 7).alias("dst")).distinct()
    before = stage(programs.connected_components(e), "components")
    after = programs.components_again(before, e, new, gone)
    return incremental.output_delta(ZSet.of(before), ZSet.of(after)).df


@query("WITH RECURSIVE e AS (SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey), reach(x) AS (SELECT 'ASIA' UNION SELECT dst FROM reach JOIN e ON src = x) SELECT x AS name FROM reach")
def named_reachability(s, sf):
    n, r, c = t(s, sf, "nation"), t(s, sf, "region"), t(s, sf, "customer")
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    e = e.union(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_name"))
    return programs.named_reach(e, s.createDataFrame([("ASIA",)], "name string"))


# Learning.
def dimensions(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("embedding"))).first()[0] or 0


def _k_means_sql(steps: int) -> str:
    means = "m0 AS (SELECT c, 0::BIGINT AS n, list_transform(range(0, (SELECT max(len(embedding)) FROM embeddings)), lambda j: (2 * c - 1)::DOUBLE) AS m FROM (SELECT unnest([0, 1]) AS c))"
    for i in range(1, steps + 1):
        means += f""", a{i} AS (SELECT arg_min(c, (d, c)) AS c, any_value(x) AS x FROM (SELECT vec_id, x, c, list_distance(x, m) AS d FROM v, m{i - 1}) GROUP BY vec_id),
u{i} AS (SELECT c, count(*) // any_value(len(x)) AS n, 0 AS z FROM (SELECT c, x, unnest(x) FROM a{i}) GROUP BY c),
s{i} AS (SELECT c, list(q ORDER BY j) AS m FROM (SELECT c, j, avg(q) AS q FROM (SELECT c, unnest(x) AS q, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
m{i} AS (SELECT p.c, coalesce(u.n, 0)::BIGINT AS n, coalesce(s.m, p.m) AS m FROM m{i - 1} p LEFT JOIN s{i} s ON s.c = p.c LEFT JOIN u{i} u ON u.c = p.c)"""
    return f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), {means} SELECT c AS cluster, n, j - 1 AS j, round(q, 6) AS mean FROM (SELECT c, n, unnest(m) AS q, generate_subscripts(m, 1) AS j FROM m{steps})"


@query(_k_means_sql(5))
def k_means(s, sf):
    rows = t(s, sf, "embeddings")
    d = dimensions(rows)
    got = programs.k_means(rows.select(F.col("embedding").alias("x")), [[-1.0] * d, [1.0] * d], 5)
    return got.select("cluster", "n", F.posexplode("mean").alias("j", "mean")).withColumn("mean", F.round("mean", 6))


def _regression_sql(steps: int, rate: float) -> str:
    out = "w0 AS (SELECT list_transform(range(0, (SELECT max(len(embedding)) FROM embeddings)), lambda j: 0.0::DOUBLE) AS w)"
    for i in range(1, steps + 1):
        out += f""", p{i} AS (SELECT x, y / (1 + exp(y * list_dot_product(x, w))) AS p FROM v, w{i - 1}),
w{i} AS (SELECT list(o.q + {rate} * g.q ORDER BY g.j) AS w FROM (SELECT j, sum(p * q) AS q FROM (SELECT p, unnest(x) AS q, generate_subscripts(x, 1) AS j FROM p{i}) GROUP BY j) g
  JOIN (SELECT unnest(w) AS q, generate_subscripts(w, 1) AS j FROM w{i - 1}) o ON o.j = g.j)"""
    return f"WITH v AS (SELECT embedding::DOUBLE[] AS x, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS y FROM embeddings), {out} SELECT (j - 1)::INTEGER AS j, round(q, 6) AS weight FROM (SELECT unnest(w) AS q, generate_subscripts(w, 1) AS j FROM w{steps})"


@query(_regression_sql(5, 0.01))
def logistic_regression(s, sf):
    rows = t(s, sf, "embeddings")
    samples = rows.select(F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("y"), F.col("embedding").alias("x"))
    return programs.logistic_regression(samples, dimensions(rows), 5, 0.01).withColumn("weight", F.round("weight", 6))


# Partitioning.
@query("""SELECT 'dealt' AS how, c_nationkey, 1::BIGINT AS partitions FROM customer GROUP BY 2 UNION ALL
SELECT 'not', c_nationkey, least(count(*), 4)::BIGINT FROM customer GROUP BY 2""")
def partitions_of_keys(s, sf):
    """In how many partitions the rows of a key lie: one after partition_by; else, dealt to 4 in turn within each key, in as many as can be."""
    from pyspark.sql import Window

    rows = t(s, sf, "customer").select("c_nationkey", "c_custkey")
    dealt = partitioning.partition_by(rows, "c_nationkey", n=4)
    turn = rows.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).repartitionById(4, F.pmod("i", F.lit(4)).cast("int"))
    count = lambda df, how: df.withColumn("#p", F.spark_partition_id()).groupBy("c_nationkey").agg(F.count_distinct("#p").alias("partitions")).select(F.lit(how).alias("how"), "c_nationkey", "partitions")
    return count(dealt, "dealt").union(count(turn, "not"))


@query("SELECT c_nationkey, least(count(*), 4)::BIGINT AS partitions FROM customer GROUP BY 1 HAVING count(*) > 1")
def partition_violations(s, sf):
    from pyspark.sql import Window

    rows = t(s, sf, "customer").select("c_nationkey", "c_custkey")
    turn = rows.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).repartitionById(4, F.pmod("i", F.lit(4)).cast("int"))
    bad = partitioning.violations(partitioning.partition_by(turn, "c_nationkey"), "c_nationkey")  # none
    return partitioning.violations(turn, "c_nationkey").unionByName(bad)
