"""Preference formatting: one prompt and two masked completions for each pair of conversations.

Everything is DataFrame expressions over turns. The longest common prefix of a
pair is found by an outer join of both sides on the turn's place and the
smallest place at which they differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Layout of a turn: head, text, tail (parameters of the template).
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) derived from (conv_id, turn, role, text).

    chosen is the conversation up to its last assistant turn. rejected keeps
    the turns before one assistant turn (the first one for ids divisible by 3,
    else the last) and ends with the first half of that turn. A conversation
    without assistant turns stands unchanged on both sides.
    """
    c = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    w = Window.partitionBy("pair_id")
    at = F.when(F.col("role") == "assistant", F.col("turn"))
    c = c.withColumn("last", F.max(at).over(w)).withColumn("first", F.min(at).over(w))
    c = c.withColumn("cut", F.when(F.pmod("pair_id", F.lit(3)) == 0, F.col("first")).otherwise(F.col("last")))
    half = F.when((F.col("turn") == F.col("cut")) & (F.col("role") == "assistant"), F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.lit("chosen"), F.lit("rejected")))
    keep = F.col("last").isNull() | F.when(F.col("side") == "chosen", F.col("turn") <= F.col("last")).otherwise(F.col("turn") <= F.col("cut"))
    return c.withColumn("side", sides).where(keep).select("pair_id", "side", "turn", "role", F.when(F.col("side") == "rejected", half).otherwise(F.col("text")).alias("text"))


def _joined(value: Column) -> Column:
    """Values in the order of their places, in one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))), lambda x: x["value"]), "")


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, status), one row per pair.

    ``turns``: pair_id, side (chosen or rejected), turn, role, text. The common
    prefix is rendered once. A mask lists start-stop places (characters, stop
    excluded) of what is trained on in a completion: the assistant's texts with
    their end marks. status is ``ok``, ``identical`` (both sides equal, no
    completions) or ``one_sided`` (a side has nothing after the prompt). Null
    roles and texts count as empty, rows without pair_id or of other sides
    are left out; turns with the same number are ordered by role and text.
    One conversation is one training example: its turns meet in one row.
    """
    t = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select("pair_id", "side", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    # Both sides of a place in one row: one shuffle on the pair serves all that follows.
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = t.groupBy("pair_id", "place").agg(*(side(s, c).alias(f"{s}_{c}") for s in ("chosen", "rejected") for c in ("role", "text")))
    differ = ~(F.col("chosen_role").eqNullSafe(F.col("rejected_role")) & F.col("chosen_text").eqNullSafe(F.col("rejected_text")))
    whole = Window.partitionBy("pair_id")
    both = both.withColumn("split", F.coalesce(F.min(F.when(differ, F.col("place"))).over(whole), F.max("place").over(whole) + 1))
    upto = Window.partitionBy("pair_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def parts(s: str) -> list[Column]:
        line = F.concat(F.lit(HEAD), F.col(f"{s}_role"), F.lit(MIDDLE), F.col(f"{s}_text"), F.lit(TAIL))
        return [line.alias(f"{s}_line"), F.when(F.col("place") >= F.col("split"), F.length(line)).otherwise(0).alias(f"{s}_length")]

    lines = both.select("pair_id", "place", "split", "chosen_role", "rejected_role", *parts("chosen"), *parts("rejected"))

    def span(s: str) -> Column:
        before = F.coalesce(F.sum(f"{s}_length").over(upto), F.lit(0))
        start = before + F.length(F.concat(F.lit(HEAD), F.col(f"{s}_role"), F.lit(MIDDLE)))
        text = F.concat(start.cast("string"), F.lit("-"), (before + F.col(f"{s}_length")).cast("string"))
        return F.when((F.col("place") >= F.col("split")) & (F.col(f"{s}_role") == "assistant"), text).alias(f"{s}_span")

    lines = lines.select("*", span("chosen"), span("rejected"))
    after = F.col("place") >= F.col("split")

    def gathered(s: str) -> list[Column]:
        spans = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{s}_span").isNotNull(), F.struct("place", F.col(f"{s}_span").alias("value"))))), lambda x: x["value"]), ",")
        return [_joined(F.when(after, F.col(f"{s}_line"))).alias(s), spans.alias(f"{s}_mask")]

    out = lines.groupBy("pair_id").agg((F.min("split") - 1).cast("long").alias("n_prompt_turns"), _joined(F.when(~after, F.col("chosen_line"))).alias("prompt"), *gathered("chosen"), *gathered("rejected"))
    status = F.when((F.col("chosen") == "") & (F.col("rejected") == ""), "identical").when((F.col("chosen") == "") | (F.col("rejected") == ""), "one_sided").otherwise("ok")
    return out.withColumn("status", status)


ORACLE = """
WITH b AS (SELECT conv_id AS pair_id, turn, role, text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last,
    CASE WHEN conv_id % 3 = 0 THEN min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id)
         ELSE max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) END AS cut FROM conversations),
s AS (SELECT pair_id, 'chosen' AS side, turn, role, text FROM b WHERE last IS NULL OR turn <= last
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, CASE WHEN turn = cut AND role = 'assistant' THEN substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) ELSE text END
  FROM b WHERE last IS NULL OR turn <= cut),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS place FROM s),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place,
    c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext
  FROM (SELECT * FROM t WHERE side = 'chosen') c FULL JOIN (SELECT * FROM t WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.place = r.place),
p AS (SELECT *, coalesce(min(CASE WHEN crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN place END) OVER (PARTITION BY pair_id),
    max(place) OVER (PARTITION BY pair_id) + 1) AS split FROM j),
l AS (SELECT *, '<|' || crole || '|>' || chr(10) || ctext || '<|end|>' || chr(10) AS cline, '<|' || rrole || '|>' || chr(10) || rtext || '<|end|>' || chr(10) AS rline FROM p),
o AS (SELECT *, coalesce(sum(CASE WHEN place >= split THEN coalesce(length(cline), 0) ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(CASE WHEN place >= split THEN coalesce(length(rline), 0) ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM l),
g AS (SELECT pair_id, CAST(min(split) - 1 AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(cline, '' ORDER BY place) FILTER (WHERE place < split), '') AS prompt,
  coalesce(string_agg(cline, '' ORDER BY place) FILTER (WHERE place >= split), '') AS chosen,
  coalesce(string_agg(CAST(cb + length(crole) + 5 AS VARCHAR) || '-' || CAST(cb + length(cline) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place >= split AND crole = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(rline, '' ORDER BY place) FILTER (WHERE place >= split), '') AS rejected,
  coalesce(string_agg(CAST(rb + length(rrole) + 5 AS VARCHAR) || '-' || CAST(rb + length(rline) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place >= split AND rrole = 'assistant'), '') AS rejected_mask
  FROM o GROUP BY pair_id)
SELECT *, CASE WHEN chosen = '' AND rejected = '' THEN 'identical' WHEN chosen = '' OR rejected = '' THEN 'one_sided' ELSE 'ok' END AS status FROM g
"""
