"""Preference formatting: chosen and rejected conversations with a common prompt.

The longest common prefix of turns is rendered once, as the prompt; what follows in either conversation is a completion,
in which the assistant's turns are to be trained on. ``format_preferences`` gives a row a rendered turn with its place in
the prompt or completion, ``assemble`` joins them to strings with their masks, in blocks of turns: a usual
conversation is one block, and no conversation is too long for a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import table

#: Turns that are summed together before sums of sums are taken.
BLOCK = 64
TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _digest() -> Column:
    """What equal turns have in common: rows at one turn count as a multiset, told apart by two 64-bit hashes."""
    fields = (F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    parts = [F.count("*")]
    parts += [F.sum(F.xxhash64(F.lit(i), *fields).cast("decimal(20,0)")) for i in (0, 1)]
    return F.struct(*parts)


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, start, length, train, rendered), one row for each turn of prompts and completions.

    ``turns`` has pair_id, side, turn, role and text; other columns are left out, and so are rows whose side is neither
    chosen nor rejected. Part is prompt, chosen or rejected; start and length count code points within it. Rows of one
    turn number follow each other by role and text, repeated rows are all rendered. A pair without one side has an empty
    prompt; equal sides are all prompt. Null keys form a pair, null turn numbers come first, null roles and texts are
    rendered empty. Turns are equal if their counts and two sums of 64-bit hashes of their rows are, so that long texts
    are not shuffled twice.
    """
    turns = turns.where(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", "role", "text")
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    sides = turns.groupBy("pair_id", at.alias("at"), "side").agg(_digest().alias("d"))
    both = sides.groupBy("pair_id", "at").agg(*(F.max(F.when(F.col("side") == s, F.col("d"))).alias(s) for s in ("chosen", "rejected")))
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("at"))).alias("split"))
    split = split.select(F.col("pair_id").alias("pair"), F.coalesce("split", F.lit(1 << 62)).alias("split"))
    marked = turns.withColumn("at", at).join(split, F.col("pair_id").eqNullSafe(F.col("pair")))
    part = F.when(F.col("at") < F.col("split"), F.lit("prompt")).otherwise(F.col("side"))
    marked = marked.withColumn("part", part).where("part <> 'prompt' OR side = 'chosen'")
    text = rendered(F.col("role"), F.col("text"))
    rows = marked.select("pair_id", "part", "at", "turn", "role", F.floor(F.col("at") / BLOCK).alias("block"), text.alias("rendered"))
    rows = rows.withColumn("length", F.length("rendered").cast("long"))
    # starts within a block, and starts of blocks: no window holds more than a block's rows or a pair's blocks
    key = ["pair_id", "part"]
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "block").agg(F.sum("length").alias("size"))
    blocks = blocks.select(*(F.col(c).alias(f"__{c}") for c in (*key, "block")), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "block").orderBy("at", "role", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    same = [rows[c].eqNullSafe(blocks[f"__{c}"]) for c in (*key, "block")]
    train = (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return rows.join(blocks, same).select(*key, "turn", "role", (F.col("base") + F.col("within")).alias("start"), "length", train.alias("train"), "rendered")


def assemble(formatted: DataFrame) -> DataFrame:
    """(pair_id, part, block, start, text, mask): the strings of each part in blocks of turns, and what of them is trained.

    Blocks are numbered by turn number over BLOCK; start is the first code point of the block in its part. The mask lists
    start:end of the trained turns, counted from the start of the part, joined by commas.
    """
    rows = F.array_sort(F.collect_list(F.struct("start", "length", "train", "rendered")))
    trained = F.transform(F.filter("rows", lambda r: r["train"]), lambda r: F.concat_ws(":", r["start"].cast("string"), (r["start"] + r["length"]).cast("string")))
    grouped = formatted.groupBy("pair_id", "part", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK).alias("block")).agg(F.min("start").alias("start"), rows.alias("rows"))
    return grouped.select("pair_id", "part", "block", "start", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("text"), F.array_join(trained, ",").alias("mask"))


def last_turn_swapped(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations (conv_id, turn, role, text), as ``format_preferences`` takes them.

    A conversation is the chosen side of the pair of its id. The rejected side is the same with the text of its last
    assistant turn taken from the last one of conversation 2n + 1 for 2n and the other way round; that turn is missing
    where there is no such conversation. Without an assistant turn both sides are equal. Null ids have no partner.
    """
    answers = turns.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max("turn").alias("last"))
    texts = turns.where(F.col("role") == TRAINED).groupBy("conv_id", "turn").agg(F.max("text").alias("answer"))
    own = answers.select(F.col("conv_id").alias("own"), "last")
    given = answers.join(texts.withColumnRenamed("turn", "last"), ["conv_id", "last"]).select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("to"), "answer")
    swap = own.join(given, F.col("own") == F.col("to"), "left").select("own", "last", F.col("to").isNotNull().alias("given"), "answer")
    marked = turns.join(swap.select("own", "last"), F.col("conv_id") == F.col("own"), "left")
    chosen = marked.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = marked.where("last IS NULL OR turn IS NULL OR turn <> last").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = swap.where("given").select(F.col("own").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit(TRAINED).alias("role"), F.col("answer").alias("text"))
    return chosen.unionByName(kept).unionByName(swapped)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return assemble(format_preferences(last_turn_swapped(turns)))


ORACLE = r"""
WITH answers AS (SELECT conv_id, turn, max(text) AS answer, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
own AS (SELECT conv_id, last, answer FROM answers WHERE turn = last),
t AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 'rejected', turn, role, text FROM conversations c LEFT JOIN own USING (conv_id) WHERE last IS NULL OR turn <> last
  UNION ALL SELECT a.conv_id, 'rejected', a.last, 'assistant', b.answer FROM own a JOIN own b ON b.conv_id = xor(a.conv_id, 1)),
turns AS (SELECT pair_id, turn, list_sort(list({'r': role, 't': text}) FILTER (side = 'chosen')) AS c, list_sort(list({'r': role, 't': text}) FILTER (side = 'rejected')) AS r FROM t GROUP BY 1, 2),
cuts AS (SELECT pair_id, coalesce(min(turn) FILTER (c IS DISTINCT FROM r), 4611686018427387904) AS cut FROM turns GROUP BY 1),
parts AS (SELECT t.*, CASE WHEN turn < cut THEN 'prompt' ELSE side END AS part, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM t JOIN cuts USING (pair_id)),
placed AS (
  SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, length(rendered) AS n
  FROM parts WHERE part <> 'prompt' OR side = 'chosen')
SELECT pair_id, part, CAST(turn // 64 AS BIGINT) AS block, min(pos) AS start, string_agg(rendered, '' ORDER BY pos) AS text,
       coalesce(string_agg(pos || ':' || (pos + n), ',' ORDER BY pos) FILTER (part <> 'prompt' AND role = 'assistant'), '') AS mask
FROM placed GROUP BY ALL
"""
