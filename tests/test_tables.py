import json

import pytest
from pyspark.sql import functions as F

from lexspan.operators import evaluation as ev
from lexspan.operators import governance as gv
from lexspan.operators import grounding as gr
from lexspan.operators import integrity as ig
from lexspan.sources import tables as tb

ENTRY = "doc_id string, source_file string, source_checksum_sha256 string, aliases array<string>"


def test_registry_files(spark, tmp_path):
    entries = [{"doc_id": "a", "aliases": ["x"]}, {"doc_id": "b"}]
    (tmp_path / "object.json").write_text("﻿" + json.dumps({"documents": entries}))
    (tmp_path / "list.json").write_text(json.dumps(entries))
    for name in ("object.json", "list.json"):
        rows = tb.read_registry(spark, str(tmp_path / name), ENTRY).collect()
        assert [(r["idx"], r["doc_id"]) for r in rows] == [(0, "a"), (1, "b")]
    assert tb.read_registry(spark, str(tmp_path / "missing.json"), ENTRY).count() == 0


def test_json_lists_keep_bad_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"chunk_id": "a", "text": "t"}, {"text": "no id"}]))
    (tmp_path / "bad.json").write_text("[{")
    rows = tb.read_json_lists(spark, str(tmp_path), "chunk_id string, text string").cache()
    assert sorted(r["reason"] for r in tb.invalid_records(rows).collect()) == ["missing chunk_id", "unreadable"]


def test_eval_set(spark, tmp_path):
    (tmp_path / "e.json").write_text("﻿" + json.dumps({"dataset_name": "v", "cases": [{"case_id": "1", "query": "q"}]}))
    row = tb.read_eval_set(spark, str(tmp_path / "e.json"), "case_id string, query string").first()
    assert (row["dataset_name"], row["case_id"]) == ("v", "1")


def test_snapshot_swap_and_retention(spark, tmp_path):
    root = str(tmp_path / "snap")
    first = tb.publish_snapshot(spark.range(3), root, grace=0)
    second = tb.publish_snapshot(spark.range(5), root, expected_rows=5, grace=0)
    assert first != second and tb.read_snapshot(spark, root).count() == 5
    assert not (tmp_path / "snap" / f"snapshot={first}").exists()
    with pytest.raises(RuntimeError):
        tb.publish_snapshot(spark.range(2), root, expected_rows=9)
    assert tb.read_snapshot(spark, root).count() == 5


def test_publishers_spare_each_other(spark, tmp_path):
    root = str(tmp_path / "snap")
    spark.range(7).write.parquet(f"{root}/snapshot=of-another")  # written, not yet pointed to
    first = tb.publish_snapshot(spark.range(3), root)
    tb.publish_snapshot(spark.range(5), root)
    assert (tmp_path / "snap" / "snapshot=of-another").exists() and (tmp_path / "snap" / f"snapshot={first}").exists()
    assert tb.read_snapshot(spark, root).count() == 5


def test_upsert_leaves_one_row_for_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "z", 1), (1, "c", 3), (1, "y", 2), (3, None, 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in tb.upsert(old, new, ["k"], "n").select("k", "v").collect()) == [(1, "c"), (2, "b"), (3, None)]
    assert sorted(tuple(r) for r in tb.upsert(old, new.drop("n"), ["k"]).collect()) == [(1, "z"), (2, "b"), (3, None)]


def test_manifest_falls_back_and_fails_loudly(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    row = spark.range(1)
    assert tb.write_manifest(row, str(tmp_path / "file" / "no"), str(tmp_path / "other")) == str(tmp_path / "other")
    with pytest.raises(Exception, match="broken"):
        tb.write_manifest(row.select(F.raise_error(F.lit("broken"))), str(tmp_path / "good"), str(tmp_path / "other"))


def registry_row(**changes):
    row = dict(idx=0, doc_id="d", source_file="f", source_checksum_sha256="s", source_name="n", source_url="u", source_verified_at="2026-01-01",
               source_verification_status="official_verified", validity_status="dang_co_hieu_luc", source_of_validity="csdl_quoc_gia_vbpl",
               validity_basis="b", validity_confidence="high", validity_checked_at="2026-01-01", effective_from="2017-01-01", effective_to="", repeal_reason="")
    return {**row, **changes}


@pytest.mark.parametrize("changes, item, status, validity", [
    ({}, ("d", "x", "s"), "matched", "dang_co_hieu_luc"), ({}, ("other", "x", "zz"), "not_found", None),
    ({}, ("d", "x", "zz"), "checksum_mismatch", None), ({"source_url": ""}, ("d", "x", "s"), "incomplete_official_evidence", None),
    ({"validity_confidence": "low"}, ("d", "x", "s"), "matched", None)])
def test_registry_overlay(spark, changes, item, status, validity):
    registry = spark.createDataFrame([registry_row(**changes)])
    items = spark.createDataFrame([item], "doc_id string, source_file string, source_checksum_sha256 string")
    row = gv.apply_registry(items, registry).first()
    assert (row["source_registry_status"], row["validity_status"]) == (status, validity)


def test_empty_registry_is_reported(spark):
    empty = spark.createDataFrame([registry_row()]).where("false")
    assert [r["code"] for r in gv.registry_gate(empty).collect()] == ["empty_source_registry"]


def test_digest_ignores_order_and_depth_zero_is_plain(spark):
    import hashlib

    ids = [f"id{i}" for i in range(50)]
    a = spark.createDataFrame([(i,) for i in ids], "x string")
    b = spark.createDataFrame([(i,) for i in ids[::-1] + ids[:3]], "x string")
    assert ig.id_digest(a, "x").first() == ig.id_digest(b, "x").first()
    want = hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    assert ig.id_digest(a, "x", 0).first()["digest"] == want


def test_greedy_ndcg_uses_an_expectation_once(spark):
    cases = spark.createDataFrame([("a", 2), ("b", 0)], "case_id string, n_expected int")
    seen = spark.createDataFrame([("a", 1, "Điều 1"), ("a", 2, "Điều 1"), ("a", 3, "Điều 2")], "case_id string, rank int, citation string")
    want = spark.createDataFrame([("a", 0, "Điều 1"), ("a", 1, "Điều 2")], "case_id string, exp_no int, expected string")
    got = {r["case_id"]: r["ndcg"] for r in ev.ndcg(cases, ev.citation_pairs(seen, want, loose=False), seen).collect()}
    import math

    assert got["b"] == 1.0
    assert abs(got["a"] - (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) < 1e-9


def test_percentile_band_on_many_values(spark):
    values = spark.range(60_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 60_000).cast("double").alias("v"))
    row = ev.exact_percentiles(values, ["k"], "v", {"p95": 0.95, "p50": 0.5}).first()
    assert abs(row["p95"] - 59_999 * 0.95) < 1e-6 and abs(row["p50"] - 29_999.5) < 1e-6


def test_claims_and_gate(spark):
    claims = spark.createDataFrame([
        ("q", 0, "giao dịch vô hiệu do giả tạo", "", ["E1"]), ("q", 1, "thừa kế di chúc hợp pháp", "", ["E1"]),
        ("q", 2, "điều gì", "", ["E9"]), ("q", 3, "không căn cứ", "", [])],
        "query_id string, claim_no int, statement string, reasoning string, evidence_ids array<string>")
    proof = spark.createDataFrame([("q", "E1", "Giao dịch dân sự vô hiệu do giả tạo")], "query_id string, evidence_id string, text string")
    got = [tuple(r)[1:] for r in gr.check_claims(claims, proof).orderBy("claim_no").collect()]
    assert got == [(0, False, False, True, False), (1, False, False, False, True), (2, True, True, False, False), (3, False, True, False, False)]
    answers = spark.createDataFrame([("q", "high", True, False, False, 2), ("r", "high", False, False, False, 0), ("s", "high", False, False, False, 1)],
                                    "query_id string, level string, claims_without_evidence boolean, invalid_evidence_used boolean, short_answer_not_grounded boolean, citation_count int")
    gate = {r["query_id"]: r["grounding_gate_reasons"] for r in gr.grounding_gate(answers).collect()}
    assert gate == {"q": ["claims_without_evidence"], "r": ["no_legal_citation"], "s": []}


def test_publishers_at_once_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/many"
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(lambda n: tb.publish_snapshot(spark.range(n + 1), root, keep=6), range(6)))
        claimed = list(pool.map(lambda _: tb.claim_version(spark, root), range(8)))
    rows = tb._pointers(spark, root).orderBy("version").collect()
    assert [row.version for row in rows] == [1, 2, 3, 4, 5, 6] and {row.snapshot for row in rows} == set(names)
    assert tb.live_snapshot(spark, root) == rows[-1].snapshot
    assert sorted(claimed) == list(range(7, 15))
