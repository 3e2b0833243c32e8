"""Operator 4 (native): preference pairs in a chat template, with masked completions.

Input: turns of chosen and rejected conversations, (pair_id, side, turn, role, text), side 0 for
chosen and 1 for rejected. Turns are ordered by (turn, role, text). The longest common prefix of
turns, equal in role and text, is rendered once as the prompt; what follows on each side is a
completion with the spans of characters to train on: the text and end mark of assistant turns.
All else in a completion (role headers, user and system turns) is masked out.

One shuffle by pair gathers the turns; a pair's rendered text is one row of the result, so that
the largest group is the longest pair of conversations, whatever the number of pairs.

Defined results: a null role or text is rendered empty; nulls equal nulls. Template marks inside
texts are broken up, so that a text cannot end its own turn. A pair with one side only has the
empty prompt, null for the absent completion, and an empty mask. Equal conversations have empty
completions. Rows that repeat a turn are turns of their own. Rows with a null pair_id form one
pair, and rows with a null side count as chosen. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames

START, END = "<|im_start|>", "<|im_end|>"


def clean(c: str) -> F.Column:
    return F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans)."""
    own = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = (
        turns.select("pair_id", F.coalesce(F.col("side"), F.lit(0)).alias("side"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .withColumn("head", F.concat(F.lit(START), clean("role"), F.lit("\n")))
        .withColumn("line", F.concat("head", clean("text"), F.lit(END + "\n")))
        .withColumns({"nth": F.row_number().over(own), "to": F.sum(F.length("line")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
        .withColumn("at", F.col("to") - F.length("line"))
        .withColumn("t", F.struct("nth", "role", "text", "line", "at", (F.col("at") + F.length("head")).alias("body"), "to"))
    )
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("t")))).alias("r"),
    )
    common = (
        sides.withColumn("m", F.least(F.size("c"), F.size("r")))
        .withColumn("first_other", F.expr("array_position(zip_with(slice(c, 1, m), slice(r, 1, m), (x, y) -> x.role <=> y.role and x.text <=> y.text), false)"))
        .withColumn("n_prefix", F.expr("cast(if(first_other = 0, m, first_other - 1) as int)"))
        .withColumn("cut", F.expr("if(n_prefix = 0, 0L, c[n_prefix - 1].to)"))
    )
    rest = "slice({0}, n_prefix + 1, greatest(size({0}) - n_prefix, 0))"
    text = "if(size({0}) = 0, cast(null as string), array_join(transform(" + rest + ", x -> x.line), ''))"
    spans = "transform(filter(" + rest + ", x -> x.role = 'assistant'), x -> struct(cast(x.body - cut as int) as start, cast(x.to - cut - 1 as int) as end))"
    return common.select(
        "pair_id",
        "n_prefix",
        F.expr("array_join(transform(slice(c, 1, n_prefix), x -> x.line), '')").alias("prompt"),
        F.expr(text.format("c")).alias("chosen"),
        F.expr(text.format("r")).alias("rejected"),
        F.expr(spans.format("c")).alias("chosen_spans"),
        F.expr(spans.format("r")).alias("rejected_spans"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    """All of conversations: each even conv_id is a chosen side, the odd one after it the rejected.
    Turns without a conv_id are the chosen side of a pair without an id."""
    turns = frames.table(spark, sf_dir, "conversations").withColumns({"pair_id": F.shiftright("conv_id", 1), "side": F.pmod("conv_id", F.lit(2))})
    show = "array_join(transform({0}_spans, x -> concat(x.start, '-', x.end)), ',')"
    return preference_pairs(turns).select("pair_id", "n_prefix", "prompt", "chosen", "rejected", F.expr(show.format("chosen")).alias("chosen_mask"), F.expr(show.format("rejected")).alias("rejected_mask"))


SQL = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth,
  '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '< |im_') || chr(10) AS head, replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS body FROM conversations),
u AS (SELECT *, head || body AS line FROM t),
e AS (SELECT a.pair_id, min(a.nth) AS first_other FROM u a LEFT JOIN u b ON b.pair_id = a.pair_id AND b.side = 1 - a.side AND b.nth = a.nth AND b.role IS NOT DISTINCT FROM a.role AND b.text IS NOT DISTINCT FROM a.text
  WHERE b.pair_id IS NULL GROUP BY 1),
p AS (SELECT pair_id, coalesce(min(e.first_other) - 1, max(nth)) AS n_prefix FROM u LEFT JOIN e USING (pair_id) GROUP BY pair_id),
r AS (SELECT u.*, n_prefix, nth > n_prefix AS tail, sum(CASE WHEN nth > n_prefix THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY nth) AS upto FROM u JOIN p USING (pair_id)),
g AS (SELECT pair_id, side, coalesce(string_agg(line, '' ORDER BY nth) FILTER (tail), '') AS completion, coalesce(string_agg(line, '' ORDER BY nth) FILTER (NOT tail), '') AS prompt,
  coalesce(string_agg((upto - length(body)) || '-' || (upto - 1), ',' ORDER BY nth) FILTER (tail AND role = 'assistant'), '') AS mask FROM r GROUP BY 1, 2)
SELECT p.pair_id, CAST(n_prefix AS INTEGER) AS n_prefix, coalesce(c.prompt, '') AS prompt, c.completion AS chosen, j.completion AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(j.mask, '') AS rejected_mask
FROM p LEFT JOIN g c ON c.pair_id = p.pair_id AND c.side = 0 LEFT JOIN g j ON j.pair_id = p.pair_id AND j.side = 1
"""
