"""Queries that feed epochs through streams, sources and sinks. An epoch is a week of events; what each epoch puts out is told with its number."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, streaming
from ..operators.staging import shared_dir, stage
from ..operators.zset import ZSet
from .queries import daily, query, t

WEEK = "(date_diff('day', DATE '2024-01-01', ts::DATE) // 7)"
KINDS = "kinds AS (SELECT min(event_type) AS put, max(event_type) AS get FROM events)"


def folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/loomtide/query-{uuid.uuid4().hex}"


def weekly(s: SparkSession, sf: str, *cols: str) -> tuple[DataFrame, int]:
    """Events with their week, and the number of weeks."""
    rows = stage(daily(s, sf).select(F.floor(F.col("epoch") / 7).alias("week"), *cols), "weeks")
    last = rows.agg(F.max("week")).first()[0]
    return rows, 0 if last is None else last + 1


def played(s: SparkSession, rows: DataFrame, weeks: int, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a subscription puts out, week by week, each in a micro-batch of its own, with `epoch`."""
    path, kept = folder(s), rows.drop("week")
    feed = streaming.Input(s, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema))
    told = feed.subscribe(streaming.collected(path), build, mode)
    for week in range(weeks):
        feed.on_next(rows.filter(F.col("week") == week).drop("week"))
    feed.on_completed()
    told.sync(weeks - 1)
    return s.read.parquet(f"{path}/*")


# Subscriptions.
@query(f"SELECT {WEEK} AS epoch, event_id, event_type FROM events WHERE value > 50")
def subscribe_rows(s, sf):
    return played(s, *weekly(s, sf, "event_id", "event_type", "value"), lambda r: r.filter("value > 50").select("event_id", "event_type"))


@query(f"SELECT epoch, event_type, n FROM (SELECT DISTINCT {WEEK} AS epoch FROM events) w, (SELECT DISTINCT event_type FROM events) k, LATERAL (SELECT count(*) AS n FROM events e WHERE e.event_type = k.event_type AND {WEEK} <= w.epoch) WHERE n > 0 AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = k.event_type AND {WEEK} = w.epoch)")
def stream_counts(s, sf):
    """Counts over all epochs so far of the keys that an epoch changes."""
    return played(s, *weekly(s, sf, "event_type"), lambda r: streaming.running_counts(r, ["event_type"]), "update")


@query(f"SELECT min({WEEK}) AS epoch, user_id FROM events GROUP BY user_id")
def stream_distinct(s, sf):
    return played(s, *weekly(s, sf, "user_id"), lambda r: streaming.distinct(r, "user_id"))


@query(f"""WITH low AS (SELECT {WEEK} AS epoch, user_id, min(value) AS value FROM events GROUP BY 1, 2),
best AS (SELECT epoch, user_id, min(value) OVER (PARTITION BY user_id ORDER BY epoch) AS value FROM low),
old AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY epoch) AS before FROM best)
SELECT epoch, user_id, value AS output FROM old WHERE before IS NULL OR value < before""")
def stream_blocking_minimum(s, sf):
    """Each user's least value so far, in the epochs where it changes."""
    return played(s, *weekly(s, sf, "user_id", "value"), lambda r: streaming.blocking_aggregate(r, "user_id", "value"))


@query(f"""WITH low AS (SELECT {WEEK} AS epoch, user_id, min(value) AS value FROM events GROUP BY 1, 2),
best AS (SELECT epoch, user_id, min(value) OVER (PARTITION BY user_id ORDER BY epoch) AS value FROM low),
old AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY epoch) AS before FROM best)
SELECT epoch, user_id, value AS least FROM old WHERE before IS NULL OR value < before""")
def stream_improvements(s, sf):
    """The last one of an epoch's improvements by user; how many there are depends on the order in which values come."""
    got = played(s, *weekly(s, sf, "user_id", "value"), lambda r: streaming.streaming_aggregate(r, "user_id", "value"))
    return got.groupBy("epoch", "user_id").agg(F.min("output").alias("least"))


@query(f"""WITH n AS (SELECT {WEEK} AS epoch, user_id, count(*) AS k FROM events GROUP BY 1, 2),
total AS (SELECT epoch, user_id, sum(k) OVER (PARTITION BY user_id ORDER BY epoch)::BIGINT AS now, k FROM n)
SELECT epoch, user_id, 10 * (now // 10) AS output FROM total WHERE now // 10 > (now - k) // 10""")
def stream_state_machine(s, sf):
    """A machine for each user counts events, and puts out the last multiple of ten that it has passed."""
    return played(s, *weekly(s, sf, "user_id", "event_id"), lambda r: streaming.state_machine(r, "user_id", "event_id", _tens, "long", "long"))


def _tens(held, values):
    now = (held or 0) + len(values)
    return now, [now // 10 * 10] if now // 10 > (held or 0) // 10 else []


@query(f"""WITH {KINDS}, puts AS (SELECT {WEEK} AS epoch, user_id, max(value) AS value FROM events, kinds WHERE event_type = put GROUP BY 1, 2),
gets AS (SELECT event_id, {WEEK} AS epoch, user_id FROM events, kinds WHERE event_type = get)
SELECT epoch, user_id, value, count(*) AS n FROM (SELECT g.epoch, g.user_id, g.event_id, arg_max(p.value, p.epoch) AS value FROM gets g JOIN puts p ON p.user_id = g.user_id AND p.epoch <= g.epoch GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def stream_lookup(s, sf):
    """Requests answered by the last value put, in a state store; numbers are compared as numbers."""
    kinds = t(s, sf, "events").agg(F.min("event_type").alias("put"), F.max("event_type").alias("get")).first()
    rows, weeks = weekly(s, sf, "user_id", "value", "event_type")
    rows = rows.filter(F.col("event_type").isin(kinds["put"], kinds["get"])) if kinds["put"] else rows
    return played(s, rows, weeks, lambda r: streaming.lookups(r, "user_id", "value", F.col("event_type") == kinds["get"])).groupBy("epoch", "user_id", "value").agg(F.count(F.lit(1)).alias("n"))


CHANGED = f"""WITH w AS (SELECT DISTINCT {WEEK} AS epoch FROM events),
c AS (SELECT w.epoch, user_id, count(*) AS n FROM w JOIN events ON {WEEK} <= w.epoch GROUP BY 1, 2),
d AS (SELECT epoch, user_id, n, 1 AS x FROM c UNION ALL SELECT epoch + 1, user_id, n, -1 FROM c WHERE epoch + 1 IN (SELECT epoch FROM w))
SELECT epoch, user_id, n, sum(x)::BIGINT AS weight FROM d GROUP BY 1, 2, 3 HAVING sum(x) <> 0"""


def _changes(s, sf, keys):
    """Counts by user as insertions and retractions; the query is stopped and started anew from its checkpoint before each epoch."""
    rows, weeks = weekly(s, sf, "user_id")
    base = folder(s)
    for week in range(weeks):
        rows.filter(F.col("week") == week).select("user_id").write.mode("append").parquet(f"{base}/in")
        stream = s.readStream.schema("user_id long").parquet(f"{base}/in")
        streaming.changes(stream, lambda z: z.count("user_id"), streaming.collected(f"{base}/out"), f"{base}/checkpoint", keys, fold=2).awaitTermination()
    return s.read.parquet(f"{base}/out/*").select("epoch", "user_id", "n", "weight")


@query(CHANGED)
def stream_changes(s, sf):
    return _changes(s, sf, None)


@query(CHANGED)
def stream_changes_by_key(s, sf):
    return _changes(s, sf, ["user_id"])


@query(f"SELECT {WEEK} AS epoch, count(*) AS n FROM events WHERE event_id % 7 <> 0 OR {WEEK} > 1 GROUP BY 1")
def out_of_order_epochs(s, sf):
    """Records come week by week from the last to the first, some of the first two weeks after these are closed: those are dropped."""
    rows, weeks = weekly(s, sf, "event_id")
    path, late = folder(s), F.col("event_id") % 7 == 0
    feed = streaming.Input(s, "event_id long")
    feed.subscribe(streaming.collected(path), lambda r: r.groupBy().agg(F.count(F.lit(1)).alias("n")), "update")
    gate = streaming.StreamingInput(feed)
    for week in reversed(range(weeks)):
        part = rows.filter(F.col("week") == week).drop("week")
        gate.on_recv(part.filter(~late) if week <= 1 else part, week)
    gate.on_notify(1)
    for week in range(min(2, weeks)):
        gate.on_recv(rows.filter((F.col("week") == week) & late).drop("week"), week)
    gate.on_notify(weeks - 1)
    got, before = [], 0
    for r in s.read.parquet(f"{path}/*").orderBy("epoch").collect():  # one row an epoch: the count so far
        got.append((r.epoch, r.n - before))
        before = r.n
    return s.createDataFrame(got, "epoch long, n long")


@query(f"SELECT {WEEK} AS epoch, event_type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT max({WEEK}) + 1, 'none', 0 FROM events")
def late_subscriber(s, sf):
    """One who subscribes after all epochs, an empty one among them, gets them all, each told once."""
    rows, weeks = weekly(s, sf, "event_type")
    path, sizes = folder(s), {}
    feed = streaming.Input(s, "event_type string")
    for week in range(weeks):
        feed.on_next(rows.filter(F.col("week") == week).drop("week"))
    feed.on_next()
    write = streaming.collected(path)

    def told(got: DataFrame, epoch: int) -> None:
        sizes[epoch] = got.count()
        write(got, epoch)

    feed.subscribe(told)
    counts = s.read.parquet(f"{path}/*").groupBy("epoch", "event_type").agg(F.count(F.lit(1)).alias("n"))
    empty = s.createDataFrame([(e, "none", 0) for e, n in sizes.items() if not n], "epoch long, event_type string, n long")
    return counts.unionByName(empty)


# Sources and sinks.
@query("SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents) GROUP BY 1, 2")
def text_files(s, sf):
    """Lines written as text and read again."""
    path = folder(s)
    lines = t(s, sf, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("line"))
    sources.write_text(lines.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line").alias("line")), path)
    at = F.instr("line", "\t")
    return sources.read_text(s, path).select(F.col("line").substr(F.lit(1), at - 1).cast("long").alias("doc_id"), F.expr("substr(line, instr(line, '\t') + 1)").alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey::BIGINT AS src, o_orderkey::BIGINT AS dst FROM orders")
def edge_files(s, sf):
    """Lines of two numbers, with comments."""
    path = folder(s)
    lines = t(s, sf, "orders").select(F.explode(F.array(F.concat_ws(" ", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), F.lit("# sold"))).alias("line"))
    sources.write_text(lines, path)
    return sources.read_edges(s, path)


@query("SELECT l_orderkey::BIGINT AS a, l_linenumber::BIGINT AS b FROM lineitem")
def binary_files(s, sf):
    """Pairs of numbers of eight bytes each, decoded from files."""
    import struct

    path = folder(s)

    def write(parts):
        import pandas as pd
        from pyspark import TaskContext

        rows = [struct.pack("<qq", a, b) for part in parts for a, b in zip(part["a"], part["b"], strict=True)]
        yield pd.DataFrame({"worker": [TaskContext.get().partitionId()], "content": [b"".join(rows)]})

    pairs = t(s, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    # Parquet holds the encoded files; a reader decodes each of them
    encoded = pairs.mapInPandas(write, "worker int, content binary")
    sources.write_records(encoded, path)
    return sources.decoded(sources.read_records(s, path).select("content"), lambda c: struct.iter_unpack("<qq", c), "a long, b long")


@query(f"SELECT {WEEK} AS epoch, event_id FROM events WHERE {WEEK} <> 1 UNION ALL SELECT 1, event_id + 1000000000 FROM events WHERE {WEEK} = 1")
def files_by_epoch(s, sf):
    """Folders by epoch; the one that is written again is replaced, others stay."""
    path = folder(s)
    rows, _ = weekly(s, sf, "event_id")
    rows = rows.withColumnRenamed("week", "epoch")
    sources.write_by_epoch(rows, path)
    sources.write_by_epoch(rows.filter("epoch = 1").withColumn("event_id", F.col("event_id") + 1_000_000_000), path)
    return s.read.parquet(path).select(F.col("epoch").cast("long").alias("epoch"), "event_id")


@query(f"SELECT {WEEK} AS epoch, event_id FROM events")
def files_by_worker(s, sf):
    path = folder(s)
    rows, _ = weekly(s, sf, "event_id")
    sources.write_by_worker(rows.withColumnRenamed("week", "epoch").repartition(3, "event_id"), path)
    return s.read.parquet(path).select(F.col("epoch").cast("long").alias("epoch"), "event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def table_source_and_sink(s, sf):
    """Rows written to a table of an embedded database over JDBC, and read back with the filter in the database."""
    import tempfile

    if not s.sparkContext.master.startswith("local["):
        return t(s, sf, "customer").filter("c_nationkey = 7").select("c_custkey", "c_name")  # an embedded database is for one machine
    options = {"url": f"jdbc:derby:{tempfile.mkdtemp(prefix='loomtide-')}/db;create=true", "dbtable": "customers", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    sources.write_table(t(s, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), options)
    return sources.read_table(s, options, "c_nationkey = 7").select("c_custkey", "c_name")


@query("SELECT 0::BIGINT AS epoch, r_name AS word FROM region UNION ALL SELECT 1, n_name FROM nation UNION ALL SELECT 3, r_name FROM region WHERE r_regionkey = 0")
def constant_and_batches(s, sf):
    """Records given by the program: one batch an epoch, the third one empty."""
    names = lambda df, c: [r[0] for r in df.select(c).collect()]  # noqa: E731  regions and nations: fixed small tables
    r, n = names(t(s, sf, "region").orderBy("r_regionkey"), "r_name"), names(t(s, sf, "nation"), "n_name")
    return sources.batches(s, [r, n, [], r[:1]], "word string")
