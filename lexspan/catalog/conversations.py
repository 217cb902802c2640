"""Conversation and feedback queries."""

from pyspark.sql import functions as F

from lexspan.catalog.registry import query, table
from lexspan.operators import conversations as cv


def heads(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("created_at")).withColumn("user_id", F.col("conversation_id") % 7)


def messages(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").alias("conversation_id"), F.concat_ws("_", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("message_id"),
        F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.col("turn").alias("created_at"),
        F.when(F.col("turn") % 3 == 0, "{bad").otherwise(F.concat(F.lit('{"short_answer": "a'), "turn", F.lit('"}'))).alias("msg_metadata"))


@query("conversations_of_user", """
with h as (select conv_id as conversation_id, max(turn) as created_at, conv_id % 7 as user_id from conversations group by conv_id)
select conversation_id, created_at from h where user_id = (select min(user_id) from h)""")
def of_user(spark, folder):
    rows = heads(spark, folder)
    first = rows.agg(F.min("user_id").alias("u")).scalar()
    return cv.of_user(rows, first).select("conversation_id", "created_at")


@query("conversations_messages", """
select conv_id as conversation_id, turn as created_at, case when role = 'assistant' then 'ai' else role end as role, md5(text) as digest,
 case when role = 'assistant' and turn % 3 <> 0 then 'a' || turn end as short_answer from conversations""")
def messages_in_order(spark, folder):
    rows = cv.messages_in_order(messages(spark, folder), "short_answer string")
    return rows.select("conversation_id", "created_at", "role", F.md5("content").alias("digest"), F.col("answer.short_answer").alias("short_answer"))


@query("conversations_history_tail", """
with r as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations)
select conv_id as conversation_id, md5(string_agg(case when role = 'assistant' then 'ai' else role end || ': ' || text, chr(10) order by turn)) as history from r where n <= 4 group by 1""")
def history_tail(spark, folder):
    return cv.history_tail(messages(spark, folder)).select("conversation_id", F.md5("history").alias("history"))


@query("conversations_delete", """
with gone as (select distinct conv_id from conversations where conv_id % 3 = 0 and conv_id % 2 = 0)
select 'conversations' as "table", count(distinct conv_id) as n from conversations where conv_id not in (select conv_id from gone)
union all select 'messages', count(*) from conversations where conv_id not in (select conv_id from gone)""")
def delete(spark, folder):
    rows = heads(spark, folder)
    wrong = F.when(F.col("conversation_id") % 2 == 0, F.col("user_id")).otherwise(F.lit(-1).cast("long"))
    requests = rows.where(F.col("conversation_id") % 3 == 0).select("conversation_id", wrong.alias("user_id"))
    kept, left = cv.delete_owned(rows, messages(spark, folder), requests)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
    return count(kept, "conversations").unionByName(count(left, "messages"))


@query("conversations_feedback", r"""
with f as (select event_id, case when event_id % 13 = 0 then null else event_id end as message_id, case when event_id % 17 = 0 then '' else event_type end as query,
 user_id % 5 - 2 as rating, case when event_id % 11 = 0 then repeat('x', 2001) else event_type || chr(10) || 'ok  ' end as comment from events),
c as (select *, case when message_id is null then 'missing_message_id' when query = '' then 'query_length' when rating not between -1 and 1 then 'rating_out_of_range' when length(comment) > 2000 then 'comment_length' end as reason from f)
select coalesce(reason, 'accepted') as outcome, coalesce(case when reason is null then trim(regexp_replace(regexp_replace(comment, '[\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g')) end, '') as comment, count(*) as n from c group by 1, 2""")
def feedback(spark, folder):
    k = F.col("event_id")
    rows = table(spark, folder, "events").select(
        F.when(k % 13 != 0, k).alias("message_id"), F.when(k % 17 == 0, "").otherwise(F.col("event_type")).alias("query"),
        (F.col("user_id") % 5 - 2).alias("rating"), F.when(k % 11 == 0, F.repeat(F.lit("x"), 2001)).otherwise(F.concat("event_type", F.lit("\nok  "))).alias("comment"))
    good, bad = cv.feedback_records(rows)
    both = good.select(F.lit("accepted").alias("outcome"), "comment").unionByName(bad.select(F.col("reason").alias("outcome"), F.lit("").alias("comment")))
    return both.groupBy("outcome", "comment").agg(F.count("*").alias("n"))


@query("conversations_query_length", "select doc_id, length(text) between 1 and 12000 as accepted from documents")
def query_length(spark, folder):
    return table(spark, folder, "documents").select("doc_id", cv.valid_query(F.col("text")).alias("accepted"))
