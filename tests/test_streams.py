"""Processors with timers, tiers of parts, and quantile sketches."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexspan.streaming import flows, ordered, sketches, tiers

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream_of(spark, folder, batches, schema):
    """Batches of rows as a stream, one file each, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def plain_bucket(rows, capacity, rate, ttl):
    kept, out = {}, {}
    for client, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        now, own = ts.timestamp(), kept.get(client)
        if own and now - own[1] >= ttl:
            own = None
        filled = min(capacity, own[0] + (now - own[1]) * rate) if own else capacity
        out[request] = (filled >= 1, round(filled - 1 if filled >= 1 else filled, 6))
        if filled >= 1:
            kept[client] = (filled - 1, now)
    return out


def requests(seed, batches, rows, hot):
    """Rows of later batches come later; within a batch in any order, ties included."""
    draw = random.Random(seed)
    made, number = [], 0
    for b in range(batches):
        part = []
        for _ in range(rows):
            client = "hot" if draw.random() < hot else f"c{draw.randint(1, 5)}"
            part.append((client, number, START + timedelta(seconds=b * 600 + draw.randint(0, 599))))
            number += 1
        draw.shuffle(part)
        made.append(part)
    return made


def test_bucket_of_a_hot_client_in_many_frames(spark, tmp_path):
    batches = requests(1, 3, 600, 0.8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        with ordered.with_state_store(spark):
            stream = stream_of(spark, tmp_path / "in", batches, "client_id string, request_id long, ts timestamp")
            found = flows.run_to_table(ordered.token_bucket(stream, 5, 0.2, 120, "10 minutes", cell=16), str(tmp_path / "out"), str(tmp_path / "state"))
        got = {r.request_id: (r.allowed, round(r.tokens, 6)) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_bucket([r for b in batches for r in b], 5, 0.2, 120)


def test_suppression_goes_on_from_its_checkpoint(spark, tmp_path):
    batches = requests(2, 4, 200, 0.5)
    schema = "key string, request_id long, ts timestamp"
    before = spark.conf.get(ordered.PROVIDER)
    with ordered.with_state_store(spark):
        for part in (batches[:2], batches[2:]):
            stream = stream_of(spark, tmp_path / "in", part, schema)
            found = flows.run_to_table(ordered.suppress_repeats(stream, 60.0, "10 minutes", cell=8), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.conf.get(ordered.PROVIDER) == before
    shown, last = set(), {}
    for key, request, ts in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() >= 60:
            last[key] = ts
            shown.add(request)
    assert {r.request_id for r in found.collect()} == shown


def test_idle_keys_leave_the_state_store(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[("a", 1, at(0))], [("b", 2, at(7200))], [("b", 3, at(7300))]]
    with ordered.with_state_store(spark):
        stream = stream_of(spark, tmp_path / "in", batches, "client_id string, request_id long, ts timestamp")
        flows.run_to_table(ordered.token_bucket(stream, ttl=60, delay="1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    kept = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "kept").load()
    assert {r.key.client_id for r in kept.select("key").collect()} == {"b"}


def test_files_stay_bounded_and_rows_whole(spark, tmp_path):
    target, draw, plain = str(tmp_path / "t"), random.Random(4), {}
    for number in range(50):
        touched = draw.sample(range(30), 3)
        for d in touched:
            # A document may shrink, to none as well.
            plain[d] = [(d, i, f"{number}-{i}") for i in range(draw.randint(0, 3))]
        rows = [r for d in touched for r in plain[d]]
        chunks = spark.createDataFrame(rows, "doc_id long, part long, text string")
        documents = spark.createDataFrame([(d,) for d in touched], "doc_id long")
        tiers.add_batch(chunks, documents, "s", number, target, fanout=3)
        if number == 20:
            early = tiers.latest(spark, target)
            early_rows = sorted(tuple(r) for r in early.collect())
            assert early_rows == sorted(r for v in plain.values() for r in v)
    version, entries = tiers.manifest(spark, target)
    assert version == 50 and len(tiers.parts_of(entries)) <= 2 * 4
    assert sorted(tuple(r) for r in tiers.latest(spark, target).collect()) == sorted(r for v in plain.values() for r in v)
    # A reader of an old version is not disturbed until that version is vacuumed.
    assert sorted(tuple(r) for r in early.collect()) == early_rows
    assert sorted(tuple(r) for r in tiers.latest(spark, target, version=21).collect()) == early_rows
    # A batch that comes again changes nothing; one of another stream is new.
    tiers.add_batch(chunks, documents, "s", 49, target, fanout=3)
    assert tiers.manifest(spark, target)[0] == 50
    tiers.add_batch(chunks, documents, "other", 0, target, fanout=3)
    assert tiers.manifest(spark, target)[0] == 51
    assert tiers.vacuum(spark, target, keep=1)
    named = {n for n, _ in tiers.parts_of(tiers.manifest(spark, target)[1])}
    assert {p.name for p in (tmp_path / "t" / "parts").iterdir()} == named
    assert len(list((tmp_path / "t" / "parts").rglob("*.parquet"))) <= 4 * 8
    assert sorted(tuple(r) for r in tiers.latest(spark, target).collect()) == sorted(r for v in plain.values() for r in v)


def test_no_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tiers.latest(spark, str(tmp_path / "none"))


def test_sketch_error_merge_and_odd_values(spark):
    draw = random.Random(5)
    rows = [(f"g{i % 3}", draw.choice((draw.lognormvariate(0, 3), -draw.lognormvariate(0, 2), 0.0))) for i in range(6000)]
    odd = [("g0", None), ("g0", float("nan")), ("g1", float("inf")), ("only", -float("inf")), ("one", 7.0)]
    values = spark.createDataFrame(rows + odd, "k string, x double").withColumn("half", F.rand(1) < 0.5)
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    parts = sketches.sketch(values, ["k", "half"], "x")
    got = {r.k: r for r in sketches.quantiles(sketches.merged(parts, ["k"]), ["k"], points).collect()}
    assert set(got) == {"g0", "g1", "g2", "one"}
    for k, r in got.items():
        exact = sorted(x for key, x in rows + odd if key == k and x is not None and abs(x) < float("inf"))
        assert r.n == len(exact)
        for name, p in points.items():
            true = exact[int(p * (len(exact) - 1))]
            assert abs(r[name] - true) <= 0.01 * abs(true) + 1e-9
    assert sketches.quantiles(sketches.sketch(values.limit(0), ["k"], "x"), ["k"], points).count() == 0
