"""Chat formatting: every participant's view of a dialogue, that speaker as assistant and the others as named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratabar.llm.common import column, table

#: Turn numbers of one rendered row, and times that one of them repeats there; what a dialogue has more is continued in
#: further rows, in order of `block` and `part`.
TURNS_PER_BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A speaker of this name gives context only: it is no participant and is never trained on.
CONTEXT_ROLE = "system"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per dialogue, participant and block of TURNS_PER_BLOCK turn numbers: conv_id, perspective, block, part,
    n_turns, text, mask (array of the [start, end) character spans in text to train on), trained_chars. part is 0, but
    where a turn number repeats more than TURNS_PER_BLOCK times: further repeats are in parts 1, 2 and on, so no row holds
    more than TURNS_PER_BLOCK^2 turns.

    A span covers the text of a turn of the perspective's speaker and its closing mark. The blocks of a dialogue,
    concatenated in order of block and part, are the whole rendering. Marks inside texts and names are kept as they are:
    what is trained on is told by the spans, which such marks can't move. In a part, turns are ordered by turn number, then speaker, then
    text; repeated turns are kept. Null speakers are called "unknown", null texts are empty. A row without dialogue
    id or turn number stands for itself: a dialogue of one turn with block null. A dialogue without participants
    (only context) gives no rows, as nothing in it is to be trained on. Other columns are not carried.

    The text is shuffled once, by dialogue and block; repeats are numbered by a sort that can spill. A dialogue that holds
    very many turns is spread over its blocks.
    """
    alone = column(conv_col).isNull() | column(turn_col).isNull()
    rows = turns.select(
        column(conv_col).alias("conv_id"),
        column(turn_col).alias("turn"),
        F.floor(column(turn_col) / TURNS_PER_BLOCK).alias("block"),
        alone.alias("solo"),
        F.coalesce(column(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
    )
    repeats = Window.partitionBy("conv_id", "block", "turn").orderBy("speaker", "text")
    dealt = rows.filter(~F.col("solo")).repartition("conv_id", "block")  # numbering, grouping and join share this exchange
    grouped = dealt.withColumn("part", F.floor((F.row_number().over(repeats) - 1) / TURNS_PER_BLOCK))
    blocks = grouped.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    named = rows.filter(~F.col("solo") & (F.col("speaker") != CONTEXT_ROLE)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    views = rows.filter(~F.col("solo")).select("conv_id", "block").distinct().join(named, "conv_id")
    whole = blocks.join(views, ["conv_id", "block"]).select("conv_id", "perspective", "block", "part", "turns")
    single = rows.filter(F.col("solo") & (F.col("speaker") != CONTEXT_ROLE)).select(
        "conv_id", F.col("speaker").alias("perspective"), F.lit(None).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("part"), F.array(F.struct("turn", "speaker", "text")).alias("turns")
    )
    return _render(whole.unionByName(single))


def _header(speaker: Column, perspective: Column) -> Column:
    role = F.when(speaker == perspective, F.lit("assistant")).when(speaker == CONTEXT_ROLE, F.lit("system")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _render(views: DataFrame) -> DataFrame:
    me = F.col("perspective")
    parts = views.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(_header(t["speaker"], me).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == me).alias("mine"))),
    )
    sizes = parts.withColumn("sizes", F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"])))

    def span(p: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b) + F.length(p["head"])
        return F.when(p["mine"], F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))

    return sizes.select(
        "conv_id", "perspective", "block", "part",
        F.size("parts").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.filter(F.transform("parts", span), lambda s: s.isNotNull()).alias("mask"),
    ).withColumn("trained_chars", F.aggregate("mask", F.lit(0), lambda a, s: a + s["end"] - s["start"]))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text, start:end joined by commas, so that engines without nested types can compare it."""
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn(
        "mask", F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    )


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CAST(floor(turn / {TURNS_PER_BLOCK}.0) AS BIGINT) AS block, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {TURNS_PER_BLOCK} AS part
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), v AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{CONTEXT_ROLE}'
), s AS (
  SELECT t.*, v.perspective, speaker = perspective AS mine,
         '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{CONTEXT_ROLE}' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head,
         text || '{CLOSE.strip()}' || chr(10) AS body
  FROM t JOIN v USING (conv_id)
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block, part ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM s
)
SELECT conv_id, perspective, block, part, CAST(count(*) AS INT) AS n_turns, string_agg(head || body, '' ORDER BY turn, speaker, text) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT) END, ',' ORDER BY turn, speaker, text), '') AS mask,
       CAST(coalesce(sum(CASE WHEN mine THEN length(body) END), 0) AS INT) AS trained_chars
FROM o GROUP BY conv_id, perspective, block, part
"""
