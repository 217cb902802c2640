"""Evaluation queries: cases are orders, observations their line items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspan.catalog import text as tq
from lexspan.catalog.registry import query, table
from lexspan.operators import evaluation as ev

# Observed citations: parts of the order's line items by rank. Expected: two
# article numbers, one taken from the second line where there is one.
CASES_SQL = """
with ln as (select l_orderkey as case_id, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank from lineitem),
ob as (select case_id, rank, 'Bộ luật Dân sự, Điều ' || (l_partkey % 60) || ', Khoản 1' as citation from ln),
pick as (select case_id, max(l_partkey) filter (rank = 2) as second from ln group by 1),
ex0 as (select o_orderkey as case_id, 0 as exp_no, 'Điều ' || coalesce(second % 60, 61) as expected from orders left join pick on case_id = o_orderkey where o_orderkey % 7 > 0
  union all select o_orderkey, 1, 'Bộ luật Dân sự, Điều ' || (o_custkey % 60) || ', Khoản 1' from orders where o_orderkey % 7 > 0),
cs as (select o_orderkey as case_id, case when o_orderkey % 7 > 0 then 2 else 0 end as n_expected from orders),
obn as (select *, {norm_o} as o from ob), exn as (select *, {norm_e} as e from ex0),
pr as (select case_id, rank, exp_no, expected from obn join exn using (case_id) where contains(o, e) or contains(e, o) or {rules})
""".format(norm_o=tq.sql_report_form("citation"), norm_e=tq.sql_report_form("expected"), rules=tq.sql_number_rules("o", "e"))


def observed(spark, folder):
    place = Window.partitionBy("case_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").withColumn("case_id", F.col("l_orderkey")).withColumn("rank", F.row_number().over(place)).select(
        "case_id", "rank", "l_partkey", F.concat(F.lit("Bộ luật Dân sự, Điều "), F.col("l_partkey") % 60, F.lit(", Khoản 1")).alias("citation"))


def expected(spark, folder):
    second = observed(spark, folder).where("rank = 2").select("case_id", (F.col("l_partkey") % 60).alias("second"))
    orders = table(spark, folder, "orders").where("o_orderkey % 7 > 0").withColumn("case_id", F.col("o_orderkey"))
    first = orders.join(second, "case_id", "left").select("case_id", F.lit(0).alias("exp_no"), F.concat(F.lit("Điều "), F.coalesce("second", F.lit(61))).alias("expected"))
    return first.unionByName(orders.select("case_id", F.lit(1).alias("exp_no"), F.concat(F.lit("Bộ luật Dân sự, Điều "), F.col("o_custkey") % 60, F.lit(", Khoản 1")).alias("expected")))


def cases(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 7 > 0, 2).otherwise(0).alias("n_expected"))


def pairs(spark, folder):
    return ev.citation_pairs(observed(spark, folder), expected(spark, folder))


@query("evaluation_reciprocal_rank", CASES_SQL + """
, f as (select case_id, min(rank) as r from pr group by 1) select case_id, case when n_expected = 0 then 1.0 else coalesce(1.0 / r, 0) end::double as mrr from cs left join f using (case_id)""")
def reciprocal_rank(spark, folder):
    return ev.reciprocal_rank(cases(spark, folder), pairs(spark, folder))


@query("evaluation_recall_at_5", CASES_SQL + """
, f as (select case_id, count(distinct expected) as n from pr where rank <= 5 group by 1) select case_id, case when n_expected = 0 then 1.0 else coalesce(n, 0) / n_expected end::double as recall_at_5 from cs left join f using (case_id)""")
def recall_at_5(spark, folder):
    return ev.recall_at(cases(spark, folder), pairs(spark, folder), 5)


NDCG_SQL = CASES_SQL + """
, a as (select case_id, rank, bool_or(exp_no = 0) as m0, bool_or(exp_no = 1) as m1, count(distinct expected) as d from pr group by 1, 2),
seq as (select *, row_number() over (partition by case_id order by rank) as i from a),
first_hit as (select case_id, rank as r1, case when m0 then 0 else 1 end as took from seq where i = 1),
same as (select case_id, count(distinct expected) as kinds from ex0 group by 1),
second_hit as (select f.case_id, min(a.rank) as r2 from first_hit f join a on a.case_id = f.case_id and a.rank > r1 and (case when took = 0 then m1 else m0 end) join same s on s.case_id = f.case_id where kinds = 2 group by 1),
sz as (select case_id, count(*) as n from ob group by 1)
select cs.case_id, case when n_expected = 0 then 1.0 when n is null then 0.0 else (coalesce(1 / log2(r1 + 1), 0) + coalesce(1 / log2(r2 + 1), 0)) / case when n >= 2 then 1 + 1 / log2(3) else 1 end end::double as ndcg
from cs left join first_hit f on f.case_id = cs.case_id left join second_hit s on s.case_id = cs.case_id left join sz on sz.case_id = cs.case_id"""


@query("evaluation_ndcg", NDCG_SQL)
def ndcg(spark, folder):
    return ev.ndcg(cases(spark, folder), pairs(spark, folder), observed(spark, folder))


@query("evaluation_match_ratio", CASES_SQL + """
, f as (select case_id, count(distinct exp_no) as n from pr group by 1) select case_id, case when n_expected = 0 then 1.0 else coalesce(n, 0) / n_expected end::double as recall from cs left join f using (case_id)""")
def match_ratio(spark, folder):
    return ev.match_ratio(cases(spark, folder), expected(spark, folder), pairs(spark, folder), "recall")


@query("evaluation_grounded_precision", CASES_SQL + """
, f as (select case_id, count(distinct exp_no) as n from pr group by 1) select case_id, case when n_expected = 0 then 0.0 else coalesce(n, 0) / n_expected end::double as grounded_citation_precision from cs left join f using (case_id)""")
def grounded_precision(spark, folder):
    generated = expected(spark, folder).select("case_id", F.col("exp_no").alias("rank"), F.col("expected").alias("citation"))
    return ev.grounded_precision(cases(spark, folder), generated, observed(spark, folder))


@query("evaluation_abstention", """
select o_orderkey as case_id, o_orderkey % 3 = 0 or (o_custkey % 4 = 0 and o_orderkey % 2 = 0) as abstained from orders""")
def abstention(spark, folder):
    text = F.when(F.col("o_orderkey") % 3 == 0, "Câu hỏi NGOÀI phạm vi hỗ trợ").otherwise(F.col("o_orderpriority"))
    level = F.when(F.col("o_orderkey") % 2 == 0, "low").otherwise("high")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), ev.abstained(text, F.col("o_custkey") % 4, level).alias("abstained"))


RUNS_SQL = """
with r as (select o_orderkey as case_id, o_orderkey as k, o_custkey as c, o_totalprice / 100000 as latency_seconds from orders)
"""


def runs(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        k.alias("case_id"), F.when(k % 5 == 0, "a").otherwise("b").alias("request_type"), F.lit("b").alias("expected_request_type"),
        (c % 3).alias("n_disclaimers"), F.when(c % 2 == 0, "high").otherwise("low").alias("level"), F.lit("medium").alias("min_confidence_level"),
        F.when(k % 4 > 0, (c % 10) / F.lit(10.0)).alias("grounding_coverage"), (k % 6).alias("n_citations"), F.lit(0.5).alias("min_grounding_coverage"),
        (k % 11 == 0).alias("invalid_evidence_used"), (k % 13 == 0).alias("weakly_supported_claims"), (c % 17 == 0).alias("claims_without_evidence"),
        (k % 9 == 0).alias("abstained"), (k % 18 != 0).alias("should_answer"), (F.col("o_totalprice") / 100000).alias("latency_seconds"),
        F.when(k % 2 == 0, 2.0).alias("max_latency_seconds"), F.when(k % 8 == 0, 1).otherwise(0).alias("n_errors"),
        F.when(k % 3 == 0, F.array(F.lit("scenario"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        ((k % 4) / F.lit(3.0)).alias("mrr"), F.lit(0.5).alias("retrieval_citation_recall"), F.lit(1.0).alias("generation_citation_recall"),
        ((c % 2) * 1.0).alias("answer_term_coverage"), F.lit(1.0).alias("source_type_recall"), F.lit(0.75).alias("grounded_citation_precision"),
        (k % 5).alias("n_retrieved"))


FLAG_SQL = RUNS_SQL + """
, m as (select case_id, k, c, latency_seconds, (k % 5 <> 0)::int::double as request_type_match, (c % 3 > 0)::int::double as disclaimer_presence, (c % 2 = 0)::int::double as confidence_sufficiency,
 case when k % 4 > 0 then (c % 10) / 10.0 else (k % 6 > 0)::int end::double as grounding_coverage,
 (case when k % 4 > 0 then (c % 10) / 10.0 else (k % 6 > 0)::int end >= 0.5)::int::double as grounding_threshold_met, (k % 11 <> 0)::int::double as invalid_evidence_free,
 (k % 13 <> 0)::int::double as weak_support_free, (c % 17 <> 0)::int::double as claims_have_evidence, ((k % 9 = 0) = (k % 18 = 0))::int::double as abstention_correctness,
 (k % 2 <> 0 or latency_seconds <= 2)::int::double as latency_budget_met, (k % 8 <> 0)::int::double as retrieval_error_free, (k % 4) / 3.0::double as mrr, (c % 2)::double as answer_term_coverage from r)
"""
FLAGS = ["request_type_match", "disclaimer_presence", "confidence_sufficiency", "grounding_coverage", "grounding_threshold_met", "invalid_evidence_free",
         "weak_support_free", "claims_have_evidence", "abstention_correctness", "latency_budget_met", "retrieval_error_free"]
SCORED = FLAGS + ["mrr", "answer_term_coverage", "source_type_recall", "generation_citation_recall", "grounded_citation_precision", "retrieval_citation_recall"]


@query("evaluation_case_metrics", FLAG_SQL + f"""
select case_id, metric, value from (unpivot (select case_id, {', '.join(FLAGS)} from m) on {', '.join(FLAGS)} into name metric value value)""")
def case_metrics(spark, folder):
    return ev.long_metrics(ev.case_metrics(runs(spark, folder)), FLAGS)


def _sum_sql(weights):
    fixed = {"source_type_recall": "1.0", "generation_citation_recall": "1.0", "grounded_citation_precision": "0.75"}
    return "(" + " + ".join(f"{w} * {fixed.get(m, m)}" for m, w in weights.items()) + f") / {sum(weights.values())}"


SCORE_SQL = FLAG_SQL + f"""
, s as (select case_id, k, case when k % 18 = 0 then {_sum_sql(ev.WEIGHTS['abstain'])} when k % 3 = 0 then {_sum_sql(ev.WEIGHTS['scenario'])} else {_sum_sql(ev.WEIGHTS['default'])} end as score from m)
"""


def scores(spark, folder):
    wide = ev.case_metrics(runs(spark, folder))
    profiles = wide.select("case_id", ev.profile(F.col("should_answer"), F.col("tags")).alias("profile"))
    return ev.weighted_scores(profiles, ev.long_metrics(wide, SCORED))


@query("evaluation_weighted_scores", SCORE_SQL + "select case_id, round(score, 4) as score, round(score, 9) >= 0.7 as passed from s")
def weighted_scores(spark, folder):
    return scores(spark, folder)


@query("evaluation_aggregate", FLAG_SQL + " union all ".join(f"select '{f}' as metric, round(avg({f}), 4) as value from m" for f in FLAGS))
def aggregate(spark, folder):
    return ev.aggregate_metrics(ev.long_metrics(ev.case_metrics(runs(spark, folder)), FLAGS))


@query("evaluation_report", SCORE_SQL + """
, rep as (select 'pass_rate' as metric, avg((round(score, 9) >= 0.7)::int) as value from s union all select 'average_score', avg(round(score, 4)) from s
 union all select 'retrieval_error_rate', avg((k % 8 = 0)::int) from m union all select 'avg_latency_seconds', avg(latency_seconds) from m
 union all select 'p50_latency_seconds', quantile_cont(latency_seconds, 0.5) from m union all select 'p95_latency_seconds', quantile_cont(latency_seconds, 0.95) from m)
select metric, round(value, 4) as value from rep""")
def report(spark, folder):
    return ev.report(scores(spark, folder), runs(spark, folder))


@query("evaluation_percentiles", """
select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1
union all select 'all', quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.95) from lineitem""")
def percentiles(spark, folder):
    events = table(spark, folder, "events").select("event_type", "value")
    lines = table(spark, folder, "lineitem").select(F.lit("all").alias("event_type"), F.col("l_extendedprice").alias("value"))
    return ev.exact_percentiles(events.unionByName(lines), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("evaluation_quality_gate", FLAG_SQL + f"""
, a as ({' union all '.join(f"select '{f}' as metric, round(avg({f}), 4) as value from m" for f in FLAGS)}),
g as (select unnest([{', '.join(f"'{k}'" for k in ev.GATE)}]) as metric, unnest([{', '.join(f"{v}::double" for v in ev.GATE.values())}]) as required)
select metric, required, coalesce(value, 0)::double as observed, coalesce(value, 0) >= required as passed,
 case when coalesce(value, 0) < required then metric || format(': observed={{:.4f}} < required={{:.4f}}', coalesce(value, 0)::double, required) end as failure from g left join a using (metric)""")
def quality_gate(spark, folder):
    return ev.quality_gate(ev.aggregate_metrics(ev.long_metrics(ev.case_metrics(runs(spark, folder)), FLAGS)))


@query("evaluation_case_notes", FLAG_SQL + f"""
select case_id, array_to_string([n for n in [case when k % 5 = 0 then 'Request type lệch: expected=b, observed=a.' end, '{ev.NOTES[0][1]}',
 {', '.join(f"case when {metric} < 1 then '{note}' end" for metric, note in ev.NOTES[2:])},
 case when c % 2 <> 0 then 'Confidence thấp hơn ngưỡng mong muốn: low < medium.' end, case when k % 6 = 0 then 'Generation không xuất citation.' end,
 case when k % 5 = 0 then 'Retrieval không có top citations để đánh giá.' end] if n is not null], '|') as notes from m""")
def case_notes(spark, folder):
    return ev.case_notes(ev.case_metrics(runs(spark, folder))).select("case_id", F.array_join("notes", "|").alias("notes"))


SEEDS_SQL = r"""
with sd as (select o_orderkey as case_no, 's' || o_orderkey as case_id, o_orderpriority || ' Đề ' || (o_orderkey // 2) || '?' as query, o_orderkey % 9 > 0 as ans, o_custkey as c, o_orderkey as k from orders),
la as (select *, row_number() over (order by case_no) as i from sd where ans and k % 5 = 0), da as (select *, row_number() over (order by case_no) as i from sd where ans and k % 4 = 0),
al as (select 0 as block, case_no, 0 as o, case_id, query from sd union all select 0, case_no, 1, case_id || '__polite', 'Cho tôi hỏi, ' || query from sd
 union all select 0, case_no, 2, case_id || '__legal_context', 'Theo quy định pháp luật, ' || query from sd union all select 0, case_no, 3, case_id || '__unaccented', replace(replace(strip_accents(query), 'Đ', 'D'), 'đ', 'd') from sd
 union all select 1, case_no, 0, format('insufficient_facts_{:02d}_a', i), 'Tôi đang gặp vấn đề liên quan đến việc ' || lower(rtrim(query, '?')) || '. Tôi chưa rõ thời điểm, chủ thể, giấy tờ và hành vi cụ thể. Có thể kết luận ngay không?' from la where i <= 15
 union all select 1, case_no, 1, format('insufficient_facts_{:02d}_b', i), 'Nếu chỉ biết rằng ' || lower(rtrim(query, '?')) || ' nhưng thiếu thông tin về thời điểm giao dịch, người tham gia và nội dung thỏa thuận thì cần bổ sung gì trước khi đánh giá?' from la where i <= 15
 union all select 2, case_no, 0, format('obsolete_text_{:02d}_a', i), 'Văn bản Điều ' || c || ' còn hiệu lực không, hay đã bị văn bản khác thay thế?' from da where i <= 8
 union all select 2, case_no, 1, format('obsolete_text_{:02d}_b', i), 'Nếu tra cứu quy định cũ liên quan đến Điều ' || c || ', cần kiểm tra tình trạng hết hiệu lực và văn bản thay thế nào?' from da where i <= 8
 union all select 2, case_no, 2, format('obsolete_text_{:02d}_c', i), 'Tại thời điểm hiện nay, có thể áp dụng Điều ' || c || ' chắc chắn không hay phải đối chiếu văn bản mới hơn?' from da where i <= 8
 union all select 3, case_no, 0, 'negative_variant_' || case_id || '_a', 'Bạn có thể tư vấn giúp tôi: ' || query from sd where not ans
 union all select 3, case_no, 1, 'negative_variant_' || case_id || '_b', 'Câu hỏi sau có thuộc phạm vi dữ liệu pháp luật hiện có không: ' || query from sd where not ans
 union all select 3, case_no, 2, 'negative_variant_' || case_id || '_c', 'Tôi cần câu trả lời chính xác cho việc này: ' || query from sd where not ans),
r as (select *, row_number() over (partition by query order by block, case_no, o) as n from al)
"""


def seeds(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("case_no"), F.concat(F.lit("s"), k).alias("case_id"), F.concat("o_orderpriority", F.lit(" Đề "), F.floor(k / 2), F.lit("?")).alias("query"),
        F.array_compact(F.array(F.when(k % 5 == 0, "scenario"), F.when(k % 4 == 0, "temporal"))).alias("tags"), F.lit("x").alias("expected_request_type"),
        F.array(F.concat(F.lit("Điều "), "o_custkey")).alias("expected_citations"), F.array(F.lit("t")).alias("expected_answer_terms"),
        (k % 9 > 0).alias("should_answer"), F.lit("medium").alias("min_confidence_level"))


@query("evaluation_expand_cases", SEEDS_SQL + "select case_id, query from r where n = 1")
def expand_cases(spark, folder):
    return ev.expand_cases(seeds(spark, folder)).select("case_id", "query")


@query("evaluation_set_size", SEEDS_SQL + "select count(*) as cases, count(distinct case_id) as ids, count(*) between 200 and 500 as accepted from r where n = 1")
def set_size(spark, folder):
    return ev.set_size_gate(ev.expand_cases(seeds(spark, folder)))


@query("evaluation_judge_scores", """
select event_id as case_id, event_id % 4 <> 3 as available, case when event_id % 4 = 3 then 0 else least(1, greatest(0, value / 100 - 0.1)) end::double as answer_relevance,
 case when event_id % 4 = 3 then 0 else 1 end::double as faithfulness, 0::double as context_precision from events""")
def judge_scores(spark, folder):
    body = F.concat(F.lit('{"answer_relevance": '), F.col("value") / 100 - 0.1, F.lit(', "faithfulness": 7, "context_precision": "n/a",}'))
    k = F.col("event_id")
    rows = table(spark, folder, "events").select(k.alias("case_id"), F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                                                 .when(k % 4 == 2, F.concat(F.lit("Kết quả: "), body, F.lit(" hết"))).otherwise("no json").alias("output"))
    return ev.judge_scores(rows)


@query("evaluation_judged_cases", """
select event_id as case_id, not (event_id % 3 = 0 and event_id % 2 = 0) as judge_applicable, case when event_id % 3 = 0 and event_id % 2 = 0 then 1 when event_id % 5 = 0 then 0 else 0.5 end::double as faithfulness from events""")
def judged_cases(spark, folder):
    e = table(spark, folder, "events")
    cases_ = e.select(F.col("event_id").alias("case_id"), (F.col("event_id") % 3 != 0).alias("should_answer"), (F.col("event_id") % 2 == 0).alias("abstained"))
    judged = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("case_id"), *[F.lit(0.5).alias(m) for m in ev.JUDGE_METRICS])
    return ev.judged_cases(cases_, judged).select("case_id", "judge_applicable", "faithfulness")


@query("evaluation_level_order", """
select o_orderkey, case o_orderkey % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 0 end >= case o_custkey % 3 when 0 then 1 when 1 then 2 else 3 end as enough from orders""")
def level_order(spark, folder):
    from lexspan.functions import citations as ct

    pick = lambda items, k: F.element_at(F.array(*[F.lit(i) for i in items]), (k % len(items) + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", ct.level_at_least(
        pick(("low", "medium", "high", "none"), F.col("o_orderkey")), pick(("low", "medium", "high"), F.col("o_custkey"))).alias("enough"))


@query("evaluation_representative_subset", """
with e as (select o_orderkey as case_id, case o_custkey % 40 when 3 then 1 when 5 then 2 when 7 then 3 else 4 end as p from orders)
select case_id from (select *, row_number() over (order by p, case_id) as n from e) where n <= 500""")
def representative_subset(spark, folder):
    c = F.col("o_custkey") % 40
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("case_no"),
                                                   F.when(c == 3, "wrong_article").when(c == 5, "missing_related_document").when(c == 7, "wrong_document").alias("error"))
    return ev.representative_subset(orders.select("case_id", "case_no"), orders.select("case_id", "error"), 500).select("case_id")


@query("evaluation_keyword_hits", """
with t as (select conv_id as case_id, turn + 1 as rank, lower(text) as t from conversations)
select case_id, count(*) filter (rank <= 5 and (contains(t, 'the') or contains(t, 'qu'))) as keyword_hits from t group by 1""")
def keyword_hits(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("rank"), "text")
    words = turns.select("case_id").distinct().select("case_id", F.explode(F.array(F.lit("THE"), F.lit("qu"))).alias("keyword"))
    return ev.keyword_hits(turns, words)
