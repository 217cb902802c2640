"""Streams over the whole event and document tables, fed in several micro-batches."""

import uuid

from pyspark.sql import functions as F

from lexspan.catalog.registry import query, table
from lexspan.functions import text as tx
from lexspan.operators import chunking as ck
from lexspan.session import scratch_dir
from lexspan.streaming import flows, limits, ordered, sketches, tiers


#: Files of a micro-batch.
FILES = 8
#: Micro-batches that a table is fed in, and the last row's key: it only moves the watermark on.
BATCHES, END = 3, "__end__"


def source(spark, folder, name):
    """A table as a stream of several micro-batches, events in order of time."""
    root = f"{scratch_dir(spark)}/lexspan-feed-{uuid.uuid4().hex}"
    rows = table(spark, folder, name)
    if name == "events":
        ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        width = (ends.b - ends.a) / BATCHES
        part = F.lit(0)
        for k in range(1, BATCHES):
            part = part + (F.col("ts") >= F.lit(ends.a + k * width)).cast("int")
    else:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int")
    feed = rows.withColumn("_part", part)
    # Written one after another: a file source takes the oldest files first.
    for k in range(BATCHES):
        feed.where(F.col("_part") == k).drop("_part").coalesce(FILES).write.mode("append").parquet(root)
    if name == "events":
        later = rows.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 30 days"), "event_type": F.lit(END), "user_id": F.lit(-1).cast("long")})
        later.write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(root)


def drain(spark, stream, mode="append"):
    root = f"{scratch_dir(spark)}/lexspan-stream-{uuid.uuid4().hex}"
    return flows.run_to_table(stream, f"{root}/out", f"{root}/state", mode)


CAP, RATE, TTL = 2, 1 / 36000, 86400
BUCKET_SQL = f"""
with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as s, row_number() over (partition by user_id order by ts, event_id) as i from events),
b as (select user_id, event_id, i, true as allowed, {CAP} - 1.0::double as tokens, s as last from e where i = 1
 union all
 select e.user_id, e.event_id, e.i, f >= 1, case when f >= 1 then f - 1 else b.tokens end, case when f >= 1 then e.s else b.last end
 from b join e on e.user_id = b.user_id and e.i = b.i + 1,
 lateral (select case when e.s - b.last >= {TTL} then {CAP}::double else least({CAP}::double, b.tokens + greatest(0, e.s - b.last) * {RATE!r}::double) end as f))
"""


@query("streams_token_bucket", BUCKET_SQL + "select user_id, event_id, allowed from b")
def token_bucket(spark, folder):
    requests = source(spark, folder, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("request_id"), "ts")
    rows = drain(spark, limits.token_bucket(requests, CAP, RATE, TTL))
    return rows.where("client_id >= 0").select(F.col("client_id").alias("user_id"), F.col("request_id").alias("event_id"), "allowed")


@query("streams_warning_suppression", """
with recursive e as (select event_type, event_id, epoch_us(ts) / 1e6 as s, row_number() over (partition by event_type order by ts, event_id) as i from events),
b as (select event_type, event_id, i, s as last, true as shown from e where i = 1
 union all select e.event_type, e.event_id, e.i, case when e.s - b.last >= 3600 then e.s else b.last end, e.s - b.last >= 3600 from b join e on e.event_type = b.event_type and e.i = b.i + 1)
select event_type, event_id from b where shown""")
def warning_suppression(spark, folder):
    warnings = source(spark, folder, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("request_id"), "ts")
    rows = drain(spark, limits.suppress_repeats(warnings, 3600.0))
    return rows.where(F.col("key") != END).select(F.col("key").alias("event_type"), F.col("request_id").alias("event_id"))


def requests_of(spark, folder):
    return source(spark, folder, "events").select(
        "ts", F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("seconds"))


METRIC_COLUMNS = """path, count(*) as requests, count(*) filter (path = 'error') as failures, round(avg(value), 6) as avg_seconds, max(value) as max_seconds"""


def _metrics(spark, stream):
    rows = drain(spark, stream).where(F.col("path") != END)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "path", "requests", "failures",
                       F.round("avg_seconds", 6).alias("avg_seconds"), "max_seconds")


@query("streams_tumbling_metrics", f"""
select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, {METRIC_COLUMNS}
from (select *, event_type as path from events) group by 1, path""")
def tumbling_metrics(spark, folder):
    return _metrics(spark, flows.request_metrics(requests_of(spark, folder), "6 hours"))


@query("streams_sliding_metrics", f"""
select strftime(time_bucket(interval '3 hours', ts, timestamp '1970-01-01') - o * interval '3 hours', '%Y-%m-%d %H:%M') as window_start, {METRIC_COLUMNS}
from (select *, event_type as path from events), (values (0), (1)) t(o) group by 1, path""")
def sliding_metrics(spark, folder):
    return _metrics(spark, flows.request_metrics(requests_of(spark, folder), "6 hours", "3 hours"))


@query("streams_continuous_ingest", """
select doc_id, true as in_order, true as whole from documents where regexp_matches(text, '[^\\s]')""")
def continuous_ingest(spark, folder):
    root = f"{scratch_dir(spark)}/lexspan-ingest-{uuid.uuid4().hex}"

    def build(batch):
        cleaned = batch.withColumn("text", tx.nfc(F.col("text")))
        return cleaned.select("doc_id", "n_chars", F.posexplode(ck.parts_of(F.col("text"), always=False)).alias("part_no", "part"))

    for run in range(2):
        # The second run starts from nothing and must not change the result.
        flows.continuous_ingest(source(spark, folder, "documents"), build, f"{root}/chunks", f"{root}/state{run}").awaitTermination()
    rows = flows.latest_chunks(spark, f"{root}/chunks")
    # Parts of each document in order, and every word of its cleaned text in one of them.
    words = lambda c: F.array_distinct(F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"[.]+$", "")))
    got = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part_no", "part"))).alias("parts"))
    texts = table(spark, folder, "documents").where("text rlike '[^\\\\s]'").select("doc_id", tx.nfc(F.col("text")).alias("text"))
    both = texts.join(got, "doc_id")
    return both.select(
        "doc_id",
        F.forall("parts", lambda p: F.get("parts", p["part_no"])["part"] == p["part"]).alias("in_order"),
        (F.size(F.array_except(words(F.col("text")), words(F.array_join("parts.part", " ")))) == 0).alias("whole"),
    )


@query("streams_redelivery", "select event_id, user_id from events")
def redelivery(spark, folder):
    events = source(spark, folder, "events").select("event_id", "user_id", "ts", F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))).alias("copy"))
    return drain(spark, flows.without_redelivery(events, "event_id", "7 days")).where("user_id >= 0").select("event_id", "user_id")


@query("streams_sessions", """
with g as (select user_id, ts, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as n from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as messages from s group by user_id, sid""")
def sessions(spark, folder):
    messages = source(spark, folder, "events").select("user_id", "ts")
    rows = drain(spark, flows.sessions(messages, "user_id", "6 hours", "1 day")).where("user_id >= 0")
    return rows.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "messages")


# ---- processors with timers, tiers, sketches -----------------------------------------


@query("streams_bucket_processor", BUCKET_SQL + "select user_id, event_id, allowed, round(tokens, 6) as tokens from b where allowed")
def bucket_processor(spark, folder):
    """Requests that pass, with what is left in their bucket; state in a store with timers."""
    requests = source(spark, folder, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("request_id"), "ts")
    with ordered.with_state_store(spark):
        rows = drain(spark, ordered.token_bucket(requests, CAP, RATE, TTL))
    return rows.where("client_id >= 0 and allowed").select(
        F.col("client_id").alias("user_id"), F.col("request_id").alias("event_id"), "allowed", F.round("tokens", 6).alias("tokens"))


@query("streams_suppression_processor", """
with recursive e as (select user_id % 50 as key, event_id, epoch_us(ts) / 1e6 as s, row_number() over (partition by user_id % 50 order by ts, event_id) as i from events),
b as (select key, event_id, i, s as last, true as shown from e where i = 1
 union all select e.key, e.event_id, e.i, case when e.s - b.last >= 7200 then e.s else b.last end, e.s - b.last >= 7200 from b join e on e.key = b.key and e.i = b.i + 1)
select key, event_id from b where shown""")
def suppression_processor(spark, folder):
    """First warning of a group of users in two hours or more; every user counts."""
    warnings = source(spark, folder, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("request_id"), "ts")
    with ordered.with_state_store(spark):
        rows = drain(spark, ordered.suppress_repeats(warnings, 7200.0))
    return rows.where("key >= 0").select("key", F.col("request_id").alias("event_id"))


@query("streams_tiered_ingest", """
with w as (select doc_id, unnest(generate_series(1, len(p))) as part_no, p from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null))
select doc_id, part_no, md5(p[part_no]) as digest from w""")
def tiered_ingest(spark, folder):
    """Lines of every document through many micro-batches and merges; a second stream brings all of them again."""
    root = f"{scratch_dir(spark)}/lexspan-tiers-{uuid.uuid4().hex}"

    def build(batch):
        return batch.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "part")).select("doc_id", F.col("at") + 1, "part").toDF("doc_id", "part_no", "part")

    for run in range(2):
        tiers.tiered_ingest(source(spark, folder, "documents"), build, f"{root}/chunks", f"{root}/state{run}", fanout=3).awaitTermination()
    return tiers.latest(spark, f"{root}/chunks").select("doc_id", F.col("part_no").cast("long").alias("part_no"), F.md5("part").alias("digest"))


POINTS = {"p50": 0.5, "p95": 0.95}
GROWTH = "(1.01::double / 0.99::double)"


def sketch_sql(width):
    return f"""
with v as (select strftime(time_bucket(interval '{width}', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M') as window_start, event_type as path, value as x from events where isfinite(value)),
s as (select window_start, path, case when abs(x) < 1e-12 then 0 else sign(x) end as side,
  case when abs(x) < 1e-12 then 0 else cast(ceil(round(ln(abs(x)) / ln({GROWTH}), 9)) as int) end as bin, count(*) as n from v group by all),
r as (select *, sum(n) over (partition by window_start, path order by side, side * bin) as upto, sum(n) over (partition by window_start, path) as total,
  side * 2 * pow({GROWTH}, bin) / ({GROWTH} + 1) as middle from s)
select window_start, path, cast(max(total) as bigint) as n, round(min(middle) filter (upto > floor(0.5 * (total - 1))), 6) as p50,
 round(min(middle) filter (upto > floor(0.95 * (total - 1))), 6) as p95 from r group by 1, 2"""


def _percentiles(found):
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "path", "n", *[F.round(p, 6).alias(p) for p in POINTS])


def _sketches(spark, folder):
    return drain(spark, sketches.window_sketches(requests_of(spark, folder), "seconds", "6 hours")).where(F.col("path") != END)


@query("streams_window_percentiles", sketch_sql("6 hours"))
def window_percentiles(spark, folder):
    return _percentiles(sketches.quantiles(_sketches(spark, folder), ["window_start", "path"], POINTS))


@query("streams_merged_percentiles", sketch_sql("24 hours"))
def merged_percentiles(spark, folder):
    """Sketches of six hours added up to days; no value is read again."""
    keys = ["window_start", "path"]
    days = _sketches(spark, folder).withColumn("window_start", F.date_trunc("day", "window_start"))
    return _percentiles(sketches.quantiles(sketches.merged(days, keys), keys, POINTS))
