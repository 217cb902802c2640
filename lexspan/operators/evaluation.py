"""Evaluation: ranking metrics, case scores, aggregates, gate and case sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import citations as ct
from lexspan.functions import text as tx
from lexspan.operators.metadata import has_any
from lexspan.session import fits, materialize

# ---- fixed values ---------------------------------------------------------
ABSTAIN_MARKERS = (
    "từ chối", "không tìm thấy căn cứ", "không đủ căn cứ", "ngoài phạm vi", "chưa cập nhật", "không thể trả lời",
)
WEIGHTS = {
    "abstain": {
        "request_type_match": 0.20, "abstention_correctness": 0.35, "confidence_sufficiency": 0.15,
        "disclaimer_presence": 0.15, "answer_term_coverage": 0.10, "latency_budget_met": 0.05,
    },
    "judge": {
        "request_type_match": 0.05, "mrr": 0.15, "generation_citation_recall": 0.10, "answer_term_coverage": 0.10,
        "grounded_citation_precision": 0.10, "answer_relevance": 0.20, "faithfulness": 0.15, "context_precision": 0.15,
    },
    "default": {
        "request_type_match": 0.10, "mrr": 0.20, "generation_citation_recall": 0.12, "source_type_recall": 0.08,
        "answer_term_coverage": 0.12, "disclaimer_presence": 0.04, "confidence_sufficiency": 0.05,
        "grounded_citation_precision": 0.10, "grounding_threshold_met": 0.09, "invalid_evidence_free": 0.05,
        "abstention_correctness": 0.05,
    },
}
WEIGHTS["scenario"] = {
    **WEIGHTS["default"], "source_type_recall": 0.05, "answer_term_coverage": 0.17,
    "generation_citation_recall": 0.09, "mrr": 0.18,
}
GATE = {
    "pass_rate": 0.85, "average_score": 0.78, "request_type_match": 0.90, "retrieval_citation_recall": 0.75,
    "generation_citation_recall": 0.70, "grounded_citation_precision": 0.90, "grounding_threshold_met": 0.85,
    "invalid_evidence_free": 1.00, "abstention_correctness": 0.90, "latency_budget_met": 0.90,
}
PASS_SCORE, JUDGE_METRICS = 0.7, ("answer_relevance", "faithfulness", "context_precision")
NOTES = (
    ("retrieval_citation_recall", "Retrieval chưa kéo đủ căn cứ kỳ vọng vào top candidates."),
    ("generation_citation_recall", "Generation chưa trích dẫn đủ căn cứ kỳ vọng."),
    ("answer_term_coverage", "Nội dung trả lời chưa phủ hết thuật ngữ pháp lý hoặc kết luận kỳ vọng."),
    ("grounding_threshold_met", "Grounding coverage thấp hơn ngưỡng kỳ vọng."),
    ("invalid_evidence_free", "Answer có dấu hiệu dùng evidence id không hợp lệ."),
    ("weak_support_free", "Có claim dùng citation nhưng mức support với evidence còn yếu."),
    ("claims_have_evidence", "Có claim không có evidence hợp lệ."),
    ("abstention_correctness", "Abstention behavior không khớp kỳ vọng của test case."),
    ("latency_budget_met", "Latency vượt ngân sách của test case."),
)
WORDINGS = (("polite", "Cho tôi hỏi, "), ("legal_context", "Theo quy định pháp luật, "))
MISSING_A = (
    "Tôi đang gặp vấn đề liên quan đến việc {}. Tôi chưa rõ thời điểm, chủ thể, giấy tờ và hành vi cụ thể. Có thể kết luận ngay không?"
)
MISSING_B = (
    "Nếu chỉ biết rằng {} nhưng thiếu thông tin về thời điểm giao dịch, người tham gia và nội dung thỏa thuận thì cần bổ sung gì trước khi đánh giá?"
)
TEMPORAL = (
    "Văn bản {} còn hiệu lực không, hay đã bị văn bản khác thay thế?",
    "Nếu tra cứu quy định cũ liên quan đến {}, cần kiểm tra tình trạng hết hiệu lực và văn bản thay thế nào?",
    "Tại thời điểm hiện nay, có thể áp dụng {} chắc chắn không hay phải đối chiếu văn bản mới hơn?",
)
NEGATIVE = (
    "Bạn có thể tư vấn giúp tôi: ", "Câu hỏi sau có thuộc phạm vi dữ liệu pháp luật hiện có không: ",
    "Tôi cần câu trả lời chính xác cho việc này: ",
)
MISSING_SEEDS, TEMPORAL_SEEDS, SET_MIN, SET_MAX = 15, 8, 200, 500
ERROR_ORDER = ("wrong_article", "missing_related_document", "wrong_document")
EXACT_BELOW, BAND = 10_000, 5e-4
#: Groups whose brackets may be sent to all tasks.
FEW_GROUPS = 10_000
# ---------------------------------------------------------------------------


def citation_pairs(observed: DataFrame, expected: DataFrame, loose: bool = True) -> DataFrame:
    """Matches per case: `case_id, rank, exp_no`, and the texts compared.

    `observed`: case_id, rank, citation. `expected`: case_id, exp_no, expected.
    """
    form = tx.report_form if loose else tx.match_form
    left = observed.select("case_id", "rank", form(F.col("citation")).alias("_o")).withColumn("_on", ct.numbers(F.col("_o")))
    right = expected.select("case_id", "exp_no", "expected", form(F.col("expected")).alias("_e")).withColumn("_en", ct.numbers(F.col("_e")))
    o, e = F.col("_o"), F.col("_e")
    inside = (F.contains(o, e) | F.contains(e, o)) if loose else (ct.bounded(o, e) | ct.bounded(e, o))
    rows = left.where(o != "").join(right.where(e != ""), "case_id")
    return rows.where(inside | ct.numbers_agree(F.col("_on"), F.col("_en"))).select("case_id", "rank", "exp_no", "expected")


def reciprocal_rank(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 / first matching rank; 1 when nothing is expected. `cases`: case_id, n_expected."""
    first = pairs.groupBy("case_id").agg(F.min("rank").alias("_r"))
    return cases.join(first, "case_id", "left").select(
        "case_id", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))).alias("mrr"))


def recall_at(cases: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    met = pairs.where(F.col("rank") <= k).groupBy("case_id").agg(F.count_distinct("expected").alias("_n"))
    value = F.coalesce(F.col("_n"), F.lit(0)) / F.col("n_expected")
    return cases.join(met, "case_id", "left").select(
        "case_id", F.when(F.col("n_expected") == 0, 1.0).otherwise(value).alias(f"recall_at_{k}"))


def ndcg(cases: DataFrame, pairs: DataFrame, observed: DataFrame) -> DataFrame:
    """Gain per expectation used once; each rank takes the first free one it matches.

    The walk over ranks is a fold over the few matches of one case.
    """
    per_rank = pairs.groupBy("case_id", "rank").agg(F.sort_array(F.collect_list(F.struct("exp_no", "expected"))).alias("hits"))
    walks = per_rank.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "hits"))).alias("walk"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.lit(0.0).cast("double").alias("gain"))

    def step(state: Column, item: Column) -> Column:
        free = F.filter(item["hits"], lambda h: ~F.array_contains(state["used"], h["expected"]))
        return F.when(
            F.size(free) > 0,
            F.struct(
                F.concat(state["used"], F.array(F.get(free, 0)["expected"])).alias("used"),
                (state["gain"] + 1.0 / F.log2(item["rank"] + 1.0)).alias("gain"),
            ),
        ).otherwise(state)

    gained = walks.select("case_id", F.aggregate("walk", start, step)["gain"].alias("_dcg"))
    sizes = observed.groupBy("case_id").agg(F.count("*").alias("_seen"))
    df = cases.join(gained, "case_id", "left").join(sizes, "case_id", "left")
    ideal_hits = F.least("n_expected", F.coalesce("_seen", F.lit(0))).cast("int")
    ideal = F.when(ideal_hits > 0, F.aggregate(
        F.sequence(F.lit(1), F.greatest(ideal_hits, F.lit(1))), F.lit(0.0).cast("double"), lambda a, r: a + 1.0 / F.log2(r + 1.0))).otherwise(0.0)
    return df.select(
        "case_id", F.when(F.col("n_expected") == 0, 1.0).when(ideal == 0, 0.0).otherwise(F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def match_ratio(cases: DataFrame, expected: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Share of a case's expectations that any observation matches (1 when none)."""
    met = pairs.select("case_id", "exp_no").distinct().withColumn("_hit", F.lit(1.0))
    ratio = expected.join(met, ["case_id", "exp_no"], "left").groupBy("case_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("_v"))
    return cases.join(ratio, "case_id", "left").select("case_id", F.coalesce("_v", F.lit(1.0)).alias(name))


def grounded_precision(cases: DataFrame, generated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Share of cited texts that retrieval returned; 0 when nothing is cited."""
    as_expected = generated.select("case_id", F.col("rank").alias("exp_no"), F.col("citation").alias("expected"))
    found = match_ratio(cases, as_expected, citation_pairs(retrieved, as_expected), "_v")
    cited = generated.select("case_id").distinct().withColumn("_any", F.lit(1))
    return found.join(cited, "case_id", "left").select(
        "case_id", F.when(F.col("_any").isNull(), 0.0).otherwise(F.col("_v")).alias("grounded_citation_precision"))


def abstained(text: Column, n_citations: Column, level: Column) -> Column:
    return has_any(F.lower(F.coalesce(text, F.lit(""))), ABSTAIN_MARKERS) | ((n_citations == 0) & (level == "low"))


def case_metrics(runs: DataFrame) -> DataFrame:
    """The flags of each case, next to the ratios already computed.

    `runs` holds one row per case with observed and expected values.
    """
    flag = lambda test: F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)
    coverage = F.coalesce(F.col("grounding_coverage"), F.when(F.col("n_citations") > 0, 1.0).otherwise(0.0))
    return runs.withColumns({
        "request_type_match": flag(F.col("request_type") == F.col("expected_request_type")),
        "disclaimer_presence": flag(F.col("n_disclaimers") > 0),
        "confidence_sufficiency": flag(ct.level_at_least(F.col("level"), F.col("min_confidence_level"))),
        "grounding_coverage": coverage,
        "grounding_threshold_met": flag(coverage >= F.coalesce("min_grounding_coverage", F.lit(0.0))),
        "invalid_evidence_free": 1.0 - flag(F.col("invalid_evidence_used")),
        "weak_support_free": 1.0 - flag(F.col("weakly_supported_claims")),
        "claims_have_evidence": 1.0 - flag(F.col("claims_without_evidence")),
        "abstention_correctness": flag(F.col("abstained") == ~F.col("should_answer")),
        "latency_budget_met": flag(F.col("max_latency_seconds").isNull() | (F.col("latency_seconds") <= F.col("max_latency_seconds"))),
        "retrieval_error_free": flag(F.coalesce("n_errors", F.lit(0)) == 0),
    })


def long_metrics(cases: DataFrame, names: list[str]) -> DataFrame:
    return cases.unpivot(["case_id"], names, "metric", "value")


def profile(should_answer: Column, tags: Column, judged: bool = False) -> Column:
    usual = F.when(F.array_contains(tags, "scenario"), "scenario").otherwise("default")
    return F.when(~should_answer, "abstain").otherwise(F.lit("judge") if judged else usual)


def weighted_scores(cases: DataFrame, metrics: DataFrame, pass_score: float = PASS_SCORE) -> DataFrame:
    """Score per case: weighted mean by profile; a missing metric counts 0.

    `cases`: case_id, profile. `metrics`: case_id, metric, value.
    """
    weight = F.create_map(*[x for p, ws in WEIGHTS.items() for m, w in ws.items() for x in (F.lit(f"{p}/{m}"), F.lit(w))])
    total = F.create_map(*[x for p, ws in WEIGHTS.items() for x in (F.lit(p), F.lit(sum(ws.values())))])
    rows = metrics.join(cases, "case_id").withColumn("_w", F.try_element_at(weight, F.concat_ws("/", "profile", "metric")))
    sums = rows.groupBy("case_id").agg(F.sum(F.col("value") * F.coalesce("_w", F.lit(0.0))).alias("_s"))
    score = F.coalesce("_s", F.lit(0.0)) / F.element_at(total, F.col("profile"))
    return cases.join(sums, "case_id", "left").select(
        "case_id", F.round(score, 4).alias("score"), (F.round(score, 9) >= pass_score).alias("passed"))


def exact_percentiles(values: DataFrame, keys: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group, whatever its size.

    A sketch brackets the wanted rank; only the values inside the narrow
    bracket are ordered, the rest are counted.
    """
    v = F.col(column)
    result = None
    for name, p in points.items():
        low, high = max(0.0, p - BAND), min(1.0, p + BAND)
        stats = values.where(v.isNotNull()).groupBy(*keys).agg(
            F.count("*").alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
            F.percentile_approx(v, [low, high], 10000).alias("_b"))
        stats = stats.withColumns({
            "_lo": F.when(F.col("_n") <= EXACT_BELOW, F.col("_min")).otherwise(F.get("_b", 0)),
            "_hi": F.when(F.col("_n") <= EXACT_BELOW, F.col("_max")).otherwise(F.get("_b", 1)),
        })
        # A shuffle by group would send a large group to one task.
        stats = materialize(stats)
        joined = values.where(v.isNotNull()).join(F.broadcast(stats) if fits(stats, FEW_GROUPS) else stats, keys)
        below = joined.where(v < F.col("_lo")).groupBy(*keys).agg(F.count("*").alias("_below"))
        inside = joined.where((v >= F.col("_lo")) & (v <= F.col("_hi"))).groupBy(*keys, v.alias("_v")).agg(
            F.count("*").alias("_c"), F.first("_n").alias("_n"))
        inside = inside.join(below, keys, "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
        upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.withColumn("_end", F.col("_below") + F.sum("_c").over(upto))
        at = (F.col("_n") - 1) * p
        value_at = lambda i: F.min(F.when(F.col("_end") > i, F.col("_v")))
        part = at - F.floor(at)
        row = inside.groupBy(*keys).agg(
            value_at(F.floor(at)).alias("_f"), value_at(F.least(F.floor(at) + 1, F.col("_n") - 1)).alias("_g"), F.first(part).alias("_p"))
        row = row.select(*keys, (F.col("_f") * (1 - F.col("_p")) + F.col("_g") * F.col("_p")).alias(name))
        result = row if result is None else result.join(row, keys)
    return result


def ordered_means(rows: DataFrame, keys: tuple[str, ...], column: str, order: tuple[str, ...]) -> DataFrame:
    """Columns `keys, mean, n`: the mean of doubles added one by one in `order`, and the rows of the key.

    Doubles added in another order give another sum in the last bits. A running sum over
    sorted rows needs no list of a key's values in memory.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order)
    running = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, F.avg(column).over(running).alias("mean"), F.count(F.lit(1)).over(running).alias("n"),
                       F.lead(F.lit(1)).over(so_far).isNull().alias("last"))
    return sums.where("last").select(*keys, "mean", "n")


def aggregate_metrics(metrics: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Mean per metric; judge metrics only over cases a judge could rate."""
    rows = metrics
    if judged is not None:
        skip = judged.where(~F.col("judge_applicable")).select("case_id")
        unrated = metrics.where(F.col("metric").isin(*JUDGE_METRICS)).join(skip, "case_id", "left_semi").select("case_id", "metric")
        rows = metrics.join(unrated, ["case_id", "metric"], "left_anti")
    return rows.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))


def report(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Pass rate, mean score, error rate and latency figures, as metric rows.

    `scores`: case_id, score, passed. `runs`: case_id, latency_seconds, n_errors.
    """
    rates = scores.agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("average_score"))
    costs = runs.agg(
        F.avg((F.coalesce("n_errors", F.lit(0)) > 0).cast("double")).alias("retrieval_error_rate"), F.avg("latency_seconds").alias("avg_latency_seconds"))
    points = exact_percentiles(
        runs.select(F.lit(1).alias("one"), "latency_seconds"), ["one"], "latency_seconds",
        {"p50_latency_seconds": 0.5, "p95_latency_seconds": 0.95}).drop("one")
    tall = lambda df: df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 4).alias("value")) for c in df.columns])).alias("m")).select("m.*")
    return reduce(DataFrame.unionByName, [tall(rates), tall(costs), tall(points)])


def quality_gate(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Each threshold with the observed value (missing: 0) and its failure text."""
    limits = {**GATE, **(thresholds or {})}
    pairs = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    wanted = metrics.sparkSession.range(1).select(F.explode(pairs).alias("metric", "required"))
    df = wanted.join(metrics.groupBy("metric").agg(F.max("value").alias("value")), "metric", "left")
    seen = F.coalesce("value", F.lit(0.0))
    failed = seen < F.col("required")
    return df.select(
        "metric", "required", F.round(seen, 4).alias("observed"), (~failed).alias("passed"),
        F.when(failed, F.format_string("%s: observed=%.4f < required=%.4f", "metric", seen, "required")).alias("failure"))


def case_notes(cases: DataFrame) -> DataFrame:
    """Diagnostic notes per case in fixed order."""
    texts = [F.when(F.col("request_type") != F.col("expected_request_type"), F.concat(
        F.lit("Request type lệch: expected="), "expected_request_type", F.lit(", observed="), "request_type", F.lit(".")))]
    texts += [F.when(F.coalesce(F.col(metric), F.lit(1.0)) < 1.0, F.lit(note)) for metric, note in NOTES]
    texts.append(F.when(~ct.level_at_least(F.col("level"), F.col("min_confidence_level")), F.concat(
        F.lit("Confidence thấp hơn ngưỡng mong muốn: "), "level", F.lit(" < "), "min_confidence_level", F.lit("."))))
    texts.append(F.when(F.col("n_citations") == 0, F.lit("Generation không xuất citation.")))
    texts.append(F.when(F.col("n_retrieved") == 0, F.lit("Retrieval không có top citations để đánh giá.")))
    return cases.select("case_id", F.array_compact(F.array(*texts)).alias("notes"))


# ---- judge ---------------------------------------------------------------------


def judge_scores(outputs: DataFrame) -> DataFrame:
    """Scores of judge outputs (`case_id, output`), fences and trailing commas tolerated.

    An unreadable output scores zero everywhere; scores stay within [0, 1].
    """
    bare = tx.strip(F.regexp_replace(tx.strip(F.coalesce("output", F.lit(""))), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    body = F.when(body != "", body).otherwise(bare)
    repaired = F.regexp_replace(body, r",\s*([}\]])", "$1")
    parsed = F.from_json(repaired, "map<string,string>")
    readable = parsed.isNotNull()
    score = lambda name: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(parsed, F.lit(name)).try_cast("double"), F.lit(0.0))))
    return outputs.select("case_id", readable.alias("available"), *[score(m).alias(m) for m in JUDGE_METRICS])


def judged_cases(cases: DataFrame, judged: DataFrame) -> DataFrame:
    """Judge scores per case; a right abstention is not sent to the judge and scores 1."""
    right = ~F.col("should_answer") & F.col("abstained")
    df = cases.join(judged, "case_id", "left")
    return df.select("case_id", (~right).alias("judge_applicable"), *[
        F.when(right, 1.0).otherwise(F.coalesce(m, F.lit(0.0))).alias(m) for m in JUDGE_METRICS])


# ---- case sets -------------------------------------------------------------------


def expand_cases(seeds: DataFrame) -> DataFrame:
    """Variants of reviewed cases; an already used query is left out.

    `seeds`: case_no, case_id, query, tags, expected_request_type,
    expected_citations, expected_answer_terms, should_answer,
    min_confidence_level. Numbered seeds (missing facts, dates, negatives) are
    the first ones in case order, found with a top-k.
    """
    def first(df, k):
        return df.orderBy("case_no").limit(k).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("case_no")))

    def variant(df, block, order, case_id, query, tags, **changes):
        return df.select(
            F.lit(block).alias("block"), "case_no", F.lit(order).alias("order"), case_id.alias("case_id"), query.alias("query"),
            F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>"))).alias("tags"),
            F.col("case_id").alias("generated_from"),
            *[changes.get(c, F.col(c)).alias(c) for c in ("expected_request_type", "expected_answer_terms", "min_confidence_level")],
            "expected_citations", "should_answer",
        )

    more = lambda *terms: F.array_distinct(F.concat("expected_answer_terms", F.array(*[F.lit(t) for t in terms])))
    named = lambda tail: F.concat("case_id", F.lit("__" + tail))
    fill = lambda template, value: F.replace(F.lit(template), F.lit("{}"), value)
    frames = [variant(seeds, 0, 0, F.col("case_id"), F.col("query"), ())]
    frames += [variant(seeds, 0, i, named(tail), F.concat(F.lit(head), "query"), ("paraphrase",)) for i, (tail, head) in enumerate(WORDINGS, 1)]
    frames.append(variant(seeds, 0, 3, named("unaccented"), tx.fold(F.col("query")), ("unaccented", "paraphrase")))
    answerable = seeds.where("should_answer")
    lacking = first(answerable.where(F.array_contains("tags", "scenario") | (F.col("expected_request_type") == "validity_question")), MISSING_SEEDS)
    core = F.lower(F.regexp_replace("query", "[?。 ]+$", ""))
    for order, (tail, template) in enumerate((("a", MISSING_A), ("b", MISSING_B))):
        frames.append(variant(
            lacking, 1, order, F.format_string("insufficient_facts_%02d_" + tail, "_i"), fill(template, core), ("insufficient_facts",),
            expected_request_type=F.lit("scenario_application"), min_confidence_level=F.lit("low"), expected_answer_terms=more("chưa đủ", "tình tiết")))
    dated = first(answerable.where(F.array_contains("tags", "temporal") | F.array_contains("tags", "nghi_dinh")), TEMPORAL_SEEDS)
    subject = F.coalesce(F.get("expected_citations", 0), F.lit("văn bản liên quan"))
    for order, template in enumerate(TEMPORAL):
        frames.append(variant(
            dated, 2, order, F.format_string(f"obsolete_text_%02d_{'abc'[order]}", "_i"), fill(template, subject), ("obsolete_text", "temporal"),
            expected_request_type=F.lit("validity_question"), min_confidence_level=F.lit("low"), expected_answer_terms=more("hết hiệu lực", "thay thế")))
    refused = seeds.where(~F.col("should_answer"))
    for order, head in enumerate(NEGATIVE):
        frames.append(variant(
            refused, 3, order, F.concat(F.lit("negative_variant_"), "case_id", F.lit("_" + "abc"[order])), F.concat(F.lit(head), "query"),
            ("paraphrase", "negative")))
    rows = reduce(DataFrame.unionByName, frames)
    # The earliest case of a query keeps it; an aggregate finds it before shuffling rows.
    winner = rows.groupBy("query").agg(F.min(F.struct("block", "case_no", "order")).alias("_w"))
    return rows.join(winner, "query").where(
        (F.col("block") == F.col("_w.block")) & (F.col("case_no") == F.col("_w.case_no")) & (F.col("order") == F.col("_w.order"))).drop("_w")


def set_size_gate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.count_distinct("case_id").alias("ids")).withColumn(
        "accepted", F.col("cases").between(SET_MIN, SET_MAX) & (F.col("cases") == F.col("ids")))


def representative_subset(cases: DataFrame, errors: DataFrame, size: int) -> DataFrame:
    """Cases with earlier errors first, by class, then the others in order.

    `cases`: case_id, case_no. `errors`: case_id, error.
    """
    place = F.array_position(F.array(*[F.lit(e) for e in ERROR_ORDER]), F.col("error"))
    known = errors.where(F.col("error").isin(*ERROR_ORDER)).groupBy("case_id").agg(F.min(place).alias("_p"))
    df = cases.join(known, "case_id", "left").withColumn("_p", F.coalesce("_p", F.lit(len(ERROR_ORDER) + 1)))
    return df.orderBy("_p", "case_no").limit(size).select("case_id", "case_no")


def keyword_hits(results: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """Chunks among a case's first k that hold any of its keywords, counted.

    `results`: case_id, rank, text. `keywords`: case_id, keyword.
    """
    top = results.where(F.col("rank") <= k).withColumn("_low", F.lower("text"))
    hits = top.join(keywords, "case_id").where(F.contains("_low", F.lower("keyword"))).select("case_id", "rank").distinct()
    counts = hits.groupBy("case_id").agg(F.count("*").alias("keyword_hits"))
    return results.select("case_id").distinct().join(counts, "case_id", "left").select("case_id", F.coalesce("keyword_hits", F.lit(0)).alias("keyword_hits"))
