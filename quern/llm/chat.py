r"""Chat formatting by event-sourced reconstruction.

A conversation log is a list of events. Each names a message (``turn``), has a
sequence number and a kind:

* ``message``: sets the role and text of its message
* ``delta``: appends to its message's text (streaming)
* ``edit``: replaces its message's text
* ``regenerate``: empties its message and drops all later messages up to here;
  the deltas or messages that follow fill it anew
* ``delete``: removes its message

The fold needs no loop: the state of a message follows from the events after its
last ``message``, ``edit``, ``regenerate`` or ``delete`` and after the last
``regenerate`` of an earlier message. Events are hashed by conversation once;
the aggregates by message, the window over messages and the final aggregate all
use that partitioning. A marker within a role or text is escaped by a backslash
(``<\|im_end|>``), so that no text can open or end a message.

The tables hold whole turns and no log. The query writes the log that a client
would have sent for them (streamed answers, some of them regenerated, edited
questions, withdrawn drafts) and folds that; its SQL reads the turns themselves.

Nulls and edges: events with a null conv_id or turn can't be placed and are
dropped. A null text counts as empty, and a message of which nothing but white
space is left isn't rendered. A null or unknown kind is ``message``. A null role
is ``user``; a message's role is that of its last event that names one. Rows
that are equal in all fields count once. Events of equal sequence number are
folded in the order of kind, role and text, so the result doesn't depend on the
order of rows. Extra columns are ignored. A conversation without any message
left has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate", "delete")
START, END = "<|im_start|>", "<|im_end|>"
MARKER, ESCAPED = "<|im_", "<\\|im_"
#: Characters of a streamed delta.
CHUNK = 80


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a client that sends whole turns (conv_id, turn, role, text). Where
    rows share a turn, the later ones set it anew; they come in the order of role and text.

    An answer of the assistant is streamed, every fourth after a half that is
    regenerated; of other turns every third is half the text at first and then
    edited; every fifth conversation's turns begin with a draft that is deleted."""
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    text, which = F.coalesce("text", F.lit("")), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(12))
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    event = lambda kind, what, role="role": F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else F.col(role)).alias("role"), what.alias("text"))
    none, empty = F.expr("cast(array() as array<struct<kind: string, role: string, text: string>>)"), F.lit("")
    deltas = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / CHUNK).cast("int")), lambda i: event("delta", F.substring(text, i * CHUNK + 1, F.lit(CHUNK)), None))
    streamed = F.concat(F.array(event("message", empty)), F.when(which % 4 == 0, F.array(event("delta", half, None), event("regenerate", empty))).otherwise(none), deltas)
    typed = F.when(which % 3 == 0, F.array(event("message", half), event("edit", text))).otherwise(F.array(event("message", text)))
    draft = F.when(F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0, F.array(event("message", F.lit("draft")), event("delete", empty, None))).otherwise(none)
    sent = F.concat(draft, F.when(F.col("role") == "assistant", streamed).otherwise(typed))
    out = rows.select("conv_id", "turn", "n", F.posexplode(sent).alias("step", "e"))
    # a turn's own rows are ordered among themselves, and turns among each other
    seq = F.struct(F.col("turn").cast("long").alias("turn"), F.col("n").cast("long").alias("n"), F.col("step").cast("long").alias("step"))
    return out.select("conv_id", seq.alias("seq"), "turn", "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of events (conv_id, seq, turn, kind, role, text)."""
    # one shuffle, by conversation, serves all steps
    e = events.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "seq", "turn", "kind", "role", "text").repartition("conv_id").distinct()
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message")
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    e = e.select("conv_id", "turn", F.struct("seq", order.alias("order"), F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t")).alias("at"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    by_message = Window.partitionBy("conv_id", "turn")
    sets = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(by_message)
    e = e.withColumn("last_set", sets)
    messages = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("regenerated"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.first("last_set").alias("last_set"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("message", "edit", "delta"), F.struct("at", "text")))).alias("parts"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("cut", F.max("regenerated").over(earlier))
    live = F.filter("parts", lambda p: (F.col("last_set").isNull() | (p["at"] >= F.col("last_set"))) & (F.col("cut").isNull() | (p["at"] > F.col("cut"))))
    messages = messages.withColumn("text", F.array_join(F.transform(live, lambda p: p["text"]), ""))
    return messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "text").where(F.trim(F.regexp_replace("text", r"\s", " ")) != "")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages, text: one row a conversation, its messages in the order of turns."""
    one = F.concat(F.lit(START), F.replace("role", F.lit(MARKER), F.lit(ESCAPED)), F.lit("\n"), F.replace("text", F.lit(MARKER), F.lit(ESCAPED)), F.lit(END + "\n"))
    rendered = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("m")))).alias("ms"))
    return rendered.select("conv_id", F.size("ms").alias("n_messages"), F.array_join(F.transform("ms", lambda m: m["m"]), "").alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(fold_events(log_of_turns(turns)))


SQL = {
    "op5_chat_format": rf"""
WITH e AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC NULLS LAST, text DESC NULLS LAST) AS k FROM e)
, m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, text FROM r WHERE k = 1 AND trim(regexp_replace(text, '\s', ' ', 'g')) <> '')
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
    string_agg('{START}' || replace(role, '{MARKER}', '{ESCAPED}') || chr(10) || replace(text, '{MARKER}', '{ESCAPED}') || '{END}' || chr(10), '' ORDER BY turn) AS text
FROM m GROUP BY conv_id""",
}
QUERIES = {"op5_chat_format": op5_chat_format}
