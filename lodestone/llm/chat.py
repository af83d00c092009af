"""Chat formatting: cumulative snapshots collapse to their longest conversation, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one rendered part, and turn numbers that are hashed and counted together.
PART_TURNS = 256
#: Parts of the rolling hash: sums of 32-bit values, so that no sum overflows.
SEEDS = (11, 12, 13, 14)
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """A 32-bit value of a turn at its place: sums of these over the first turns stand for that prefix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "turn", "role", "text"), 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns. A null role is "unknown", a null text empty, a null turn -1; rows without a conversation go."""
    source = conversations.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return source.dropDuplicates(["conv_id", "turn", "role", "text"])


def _prefixes(turns: DataFrame) -> DataFrame:
    """The rolling hash after each row, in the order of turn, role, text: conv_id, turn, n (rows so far), h0 to h3, last (no row follows).

    Sums roll within parts of PART_TURNS turns, and over the parts' sums, so that no task needs all
    turns of a long conversation at once.
    """
    names = [f"h{k}" for k in range(len(SEEDS))]
    each = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / PART_TURNS).alias("part"), *(_turn_hash(s).alias(c) for s, c in zip(SEEDS, names, strict=True)))
    by_part = each.groupBy("conv_id", "part").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))
    over = Window.partitionBy("conv_id").orderBy("part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("conv_id", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["n", *names]), (F.lead("part").over(over).isNull()).alias("last_part"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    rolling = each.select("conv_id", "part", "turn", F.count("*").over(so_far).alias("n"), *(F.sum(c).over(so_far).alias(c) for c in names), F.lead("turn").over(within).isNull().alias("last_here"))
    joined = rolling.join(parts, ["conv_id", "part"])
    return joined.select("conv_id", "turn", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in ["n", *names]), (F.col("last_part") & F.col("last_here")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are not a prefix of a longer one, and of equal ones the smallest conv_id: conv_id, n."""
    key = ["n", *(f"h{k}" for k in range(len(SEEDS)))]
    prefixes = _prefixes(turns)
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", "n")


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, from 0, counted within parts of turn numbers and over the parts."""
    each = turns.withColumn("range", F.floor(F.col("turn") / PART_TURNS))
    over = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("conv_id", "range").count().select("conv_id", "range", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text"))
    return each.withColumn("within", within).join(before, ["conv_id", "range"]).withColumn("place", F.col("before") + F.col("within") - 1)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part (from 0), n_turns (of the conversation), text.

    A conversation is its turns in the order of turn, role, text; exactly repeated rows count once.
    It goes if all its turns are the first turns of a longer conversation, or if an equal one has a
    smaller conv_id. A part has up to PART_TURNS turns, so that no task gathers a whole long
    conversation, nor the many texts of one turn number. Texts stand as they are: markers in them
    aren't escaped. Null values: see ``turns_of``. An empty table gives no rows; other columns are
    ignored. DataFrame functions only.
    """
    turns = turns_of(conversations)
    kept = maximal(turns)
    part = F.floor(F.col("place") / PART_TURNS).cast("int")
    head, middle, tail = "<|im_start|>", "\n", "<|im_end|>\n"
    shown = F.concat(F.lit(head), "role", F.lit(middle), "text", F.lit(tail))
    rows = _numbered(turns.join(kept, "conv_id"))
    grouped = rows.groupBy("conv_id", part.alias("part"), F.col("n").alias("n_turns")).agg(F.sort_array(F.collect_list(F.struct("place", shown.alias("shown")))).alias("turns"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join(F.col("turns.shown"), "").alias("text"))


#: The same in DuckDB, with whole texts in place of hashes.
ORACLE_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(CAST(turn AS BIGINT), -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n, string_agg(turn || chr(1) || role || chr(2) || text || chr(3), '' ORDER BY turn, role, text) AS body FROM turns GROUP BY conv_id
), kept AS (
  SELECT conv_id, n FROM whole a WHERE NOT EXISTS (
    SELECT 1 FROM whole b WHERE b.conv_id <> a.conv_id AND starts_with(b.body, a.body) AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id))
)
SELECT conv_id, CAST(place // 256 AS INTEGER) AS part, n AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM turns JOIN kept USING (conv_id)) GROUP BY ALL
"""
