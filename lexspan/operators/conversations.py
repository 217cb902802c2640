"""Conversations, messages and feedback as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions import text as tx

# ---- fixed values ---------------------------------------------------------
HISTORY, QUERY_MAX, COMMENT_MAX, MESSAGE_ID_MAX = 4, 12_000, 2_000, 80
# ---------------------------------------------------------------------------


def of_user(conversations: DataFrame, user_id) -> DataFrame:
    """A user's conversations, newest first."""
    return conversations.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "conversation_id")


def messages_in_order(messages: DataFrame, payload_schema: str) -> DataFrame:
    """Messages by conversation and time; replies carry their parsed answer.

    Unreadable JSON leaves the answer empty and the message in place.
    """
    answer = F.when(F.col("role") == "ai", F.from_json("msg_metadata", payload_schema))
    return messages.withColumn("answer", answer).orderBy("conversation_id", "created_at", "message_id")


def history_tail(messages: DataFrame, last: int = HISTORY) -> DataFrame:
    """The last messages of each conversation as `role: content` lines."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    tail = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    line = F.concat("role", F.lit(": "), "content")
    return tail.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def delete_owned(conversations: DataFrame, messages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove requested conversations of their owners, with their messages.

    `requests`: conversation_id, user_id; a request by someone else does nothing.
    """
    granted = conversations.join(requests.distinct(), ["conversation_id", "user_id"], "left_semi").select("conversation_id")
    return (
        conversations.join(granted, "conversation_id", "left_anti"),
        messages.join(granted, "conversation_id", "left_anti"),
    )


def valid_query(text: Column) -> Column:
    return F.coalesce(F.length(text).between(1, QUERY_MAX), F.lit(False))


def feedback_records(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted feedback as sanitised records, and the rejected rows with a reason."""
    reason = F.coalesce(
        F.when(F.col("message_id").isNull(), "missing_message_id"), F.when(~valid_query(F.col("query")), "query_length"),
        F.when(~F.coalesce(F.col("rating").between(-1, 1), F.lit(False)), "rating_out_of_range"),
        F.when(F.length("comment") > COMMENT_MAX, "comment_length"),
    )
    checked = feedback.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        tx.log_value(F.col("message_id").cast("string"), MESSAGE_ID_MAX).alias("message_id"), "rating",
        tx.log_value(F.col("query")).alias("query"), tx.log_value(F.col("comment")).alias("comment"))
    return good, checked.where(F.col("reason").isNotNull())
