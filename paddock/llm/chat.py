"""Chat formatting from an event log, with DataFrame functions only.

A log row is an event of one message: ``delta`` appends streamed text,
``regenerate`` throws away what the message holds so far, ``edit`` replaces it
by its own text. The fold keeps, per message, the events from the last
``regenerate`` or ``edit`` on, and joins their texts by sequence number. It runs
per (conversation, message), with a max that combines before the shuffle, so a
conversation with a long log of deltas is spread over many tasks; only final
messages meet per conversation, whose rendering is one string by definition.

A turn is rendered as ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Control
strings inside roles and texts are escaped: a backslash becomes ``\\s``, and
``\\-`` goes after the first character of a control string. Both steps are
undone in the opposite order, so every text survives.

Defined results: a null text counts as empty, a null role as the empty string,
a null kind as ``delta``; rows with one (conversation, turn) are separate turns
ordered by role and text; a null conversation id is a conversation of its own;
rows that repeat exactly are separate turns too; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.llm.common import table

# The strings of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED = "assistant"


def escape(c: Column) -> Column:
    steps = [("\\", "\\s"), *[(x, x[0] + "\\-" + x[1:]) for x in CONTROL]]
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), steps, c)


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\-"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text) of a log
    (conv_id, turn, copy, seq, kind, role, text)."""
    key = ["conv_id", "turn", "copy"]
    restart = F.max(F.when(F.col("kind").isin("regenerate", "edit"), F.col("seq"))).alias("restart")
    event = F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return (events.groupBy(*key)
            .agg(restart, F.max("role").alias("role"), F.sort_array(F.collect_list(event)).alias("log"))
            .select(*key, F.coalesce("role", F.lit("")).alias("role"), F.array_join(
                F.transform(F.filter("log", lambda e: F.col("restart").isNull() | (e["seq"] >= F.col("restart"))),
                            lambda e: e["text"]), "").alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_mask``, the parts to learn from as
    (turn, offset in the turn, offset in the whole, length), all in code points from 0."""
    piece = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "body", F.lit(CLOSE))
    turns = messages.select("conv_id", "turn", "copy", (F.col("role") == LEARNED).alias("learned"),
                            escape(F.col("role")).alias("role"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", piece).withColumn(
        "start", F.char_length("role") + len(OPEN) + len(MIDDLE)).withColumn("length", F.char_length("body"))
    # running offsets and turn numbers within the conversation
    order = Window.partitionBy("conv_id").orderBy("turn", "copy")
    turns = turns.select(
        "conv_id", "piece", "learned", "start", "length", (F.row_number().over(order) - 1).alias("at"),
        (F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
         - F.char_length("piece")).alias("before"))
    span = F.struct(F.col("at").alias("turn"), "start", (F.col("before") + F.col("start")).alias("offset"), "length")
    return (turns.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda t: t["piece"]), "")
                 .alias("formatted"),
                 F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("loss_mask")))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (role, text) and learned texts, parsed from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.slice("pieces", F.lit(1), F.size("pieces") - 1)  # nothing follows the last closing string

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(inner, MIDDLE, 1)
        text = inner.substr(F.char_length(role) + len(MIDDLE) + 1, F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss_mask", lambda m: unescape(
        F.element_at("pieces", m["turn"] + 1).substr(m["start"] + 1, m["length"])))
    return (rendered.withColumn("pieces", F.split("formatted", CLOSE))
            .select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), learned.alias("learned")))


def as_events(rows: DataFrame, step: int = 200) -> DataFrame:
    """Derive a log from finished turns: the text arrives in deltas of ``step`` code points.
    Every third message starts with a draft (its text reversed) that a ``regenerate`` throws away;
    every third starts with one that an ``edit`` by the first part replaces."""
    twins = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(twins))
    way = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(step)), lambda s: F.struct(
        (s + 3).alias("seq"), F.when((way == 2) & (s == 0), "edit").otherwise("delta").alias("kind"),
        F.col("text").substr(s + 1, F.lit(step)).alias("text")))
    draft = F.when(way > 0, F.array(F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.reverse("text").alias("text"))))
    again = F.when(way == 1, F.array(F.struct(F.lit(2).alias("seq"), F.lit("regenerate").alias("kind"), F.lit("").alias("text"))))
    empty = F.filter(parts, lambda p: F.lit(False))
    log = F.concat(F.coalesce(draft, empty), F.coalesce(again, empty), parts)
    return rows.select("conv_id", "turn", "copy", "role", F.inline(log))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = read_back(render(fold_events(as_events(source.unionByName(tricky)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(c: str) -> str:
    for a, b in [("\\", "\\s"), *[(x, x[0] + "\\-" + x[1:]) for x in CONTROL]]:
        c = f"replace({c}, '{a}', '{b}')"
    return c


OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + MIDDLE + CLOSE)} + length({_sql_escape('role')}) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
