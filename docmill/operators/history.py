"""Conversation history: (id, session_id, question, answer, create_time), in order of id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import short_title

from docmill.rules import DEFAULTS


def recent(history: DataFrame, turns: int = DEFAULTS.history_turns, chars: int = DEFAULTS.history_chars) -> DataFrame:
    """Each session's last turns, the oldest dropped until the rest fits a number of characters."""
    last = Window.partitionBy("session_id").orderBy(F.desc("id"))
    size = F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    rows = history.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= turns)
    total = F.sum(size).over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_chars", total).filter(F.col("_chars") <= chars).drop("_n", "_chars")


def pairs(messages: DataFrame) -> DataFrame:
    """(session_id, id, question, answer) of (conv_id, turn, role, text): each user's turn with the answer right after."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    rows = rows.filter("role = 'user' AND _role = 'assistant'")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("text").alias("question"), F.col("_text").alias("answer"))


def messages(history: DataFrame) -> DataFrame:
    """(session_id, id, n, role, text): two rows for each turn."""
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return history.select("session_id", "id", F.posexplode(both).alias("n", "m")).select("session_id", "id", "n", "m.role", "m.text")


def listed(history: DataFrame, session_id, limit: int = 200) -> DataFrame:
    """A session's turns in order, from one to a thousand."""
    return history.filter(F.col("session_id") == session_id).orderBy("id").limit(max(1, min(limit, 1000)))


def session_list(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """The sessions (session_id, create_time, ...) begun last, a hundred at most."""
    return sessions.orderBy(F.desc("create_time"), "session_id").limit(max(1, min(limit, 100)))


def touched(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (session_id, title, updated) after turns (session_id, at, question): those spoken in come first, new ones
    among them; a first turn gives its session a title."""
    last = turns.filter("session_id is not null").groupBy("session_id").agg(F.max("at").alias("_at"), F.min_by("question", "at").alias("_first"))
    rows = sessions.join(last, "session_id", "full")
    title = F.coalesce("title", short_title(F.col("_first")))
    rows = rows.select("session_id", title.alias("title"), F.greatest("updated", "_at").alias("updated"))
    return rows.orderBy(F.desc("updated"), "session_id")
