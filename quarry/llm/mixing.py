"""Mixing sources to target weights (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Table

#: Weight of a source is its share of tokens to this power: below 1, small sources gain.
TEMPERATURE = 0.7
#: Rows of one source in one range of keys; bounds what a task sorts.
ROWS_PER_RANGE = 50_000
SEED = 17

_WORD = r"[^ \t\n\r\f]+"


def count_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def random_key(doc_id: Column, seed: int = SEED) -> Column:
    """A number that is uniform in 0 .. 2^60 - 1 and depends on the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def plan_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokens: Column | None = None, seed: int = SEED, temperature: float = TEMPERATURE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """What is drawn: (doc_id, source, text_hash, tokens, epoch, start, take), a row for each time a document is drawn.

    ``budget`` (all tokens of the input unless given) is split by ``weights``,
    normalised over the sources that have tokens; without weights a source weighs
    its token count to the power ``temperature``. A source's share, rounded down,
    is cut exactly: documents are laid out in the order of their random keys,
    ``start`` is the tokens before the document in its epoch, every document is
    drawn once for each whole epoch that fits the share, and in the last, partial
    epoch those that start before the rest. ``take`` is min(tokens, rest - start)
    there, so that a source's takes add up to its share. A source without a weight
    gets none; a weight that is negative, infinite or NaN, or a negative budget, raises ValueError.

    Null texts have no tokens and are drawn only in whole epochs or before the
    cut; null sources are a source of their own; null ids share one key. Ties in
    the key go by id, nulls first, and then by hash of the text; repeated rows
    (same id, source and text) are drawn each. Empty input, or input without a
    token, gives no rows.

    Text never moves: rows of ids and counts are written once. Keys are uniform
    hashes, so equal ranges of keys are equal loads; each (source, range) is summed,
    the sums are turned into offsets over the small table of ranges, and the prefix
    sum within a range needs only the range. The hot source is thus spread over as
    many ranges as its rows need.
    """
    if budget is not None and budget < 0 or any(not 0 <= w < math.inf for w in (weights or {}).values()):
        raise ValueError("weights and budgets are finite numbers, 0 or more")
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.hash(text).alias("text_hash"),
        (count_tokens(F.col(text)) if tokens is None else tokens).alias("tokens"), random_key(F.col(doc_id), seed).alias("key"),
    ).withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    rows = Table(base, "mix-keys").df
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 0")
    if weights is None:
        weight = F.pow("total", F.lit(temperature))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    everything = Window.partitionBy()
    amount = F.sum("total").over(everything) if budget is None else F.lit(budget)
    # rounding makes the share independent of the order in which the weights were added
    share = F.floor(F.round(amount * F.col("weight") / F.sum("weight").over(everything), 3)).cast("bigint")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows_per_range))).cast("int")
    shares = totals.withColumn("weight", weight).where("weight > 0").select("source", "total", share.alias("share"), bits.alias("bits"))
    shares = Table(shares, "mix-shares").df

    keyed = rows.alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.total", "s.share", F.expr("shiftright(key, 60 - bits)").alias("range"))
    within = Window.partitionBy("source", "range")
    order = within.orderBy("key", "doc_id", "text_hash")
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = Table(sums.select("source", "range", before.alias("before")), "mix-offsets").df
    local = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = keyed.withColumn("local", local).alias("k").join(offsets.alias("o"), F.col("k.source").eqNullSafe(F.col("o.source")) & (F.col("k.range") == F.col("o.range"))).select("k.*", (F.col("o.before") + F.col("k.local")).alias("start"))
    whole, rest = F.expr("share div total"), F.col("share") % F.col("total")
    drawn = placed.withColumn("times", (whole + F.when(F.col("start") < rest, 1).otherwise(0)).cast("int")).where("times > 0")
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    take = F.when(F.col("epoch") < whole, F.col("tokens")).otherwise(F.least(F.col("tokens"), rest - F.col("start")))
    return drawn.select("doc_id", "source", "text_hash", "tokens", "epoch", "start", take.alias("take"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The drawn documents themselves: the columns of ``docs``, a row for each time one is drawn.

    Whole documents are returned, the one that crosses its source's cut included.
    Cases are those of :func:`plan_mix`, but that repeated rows are drawn as often
    as the first of them even if the cut falls among them: null and empty texts come
    only in whole epochs or before the cut, null sources are one source, null ids are
    drawn by their texts, texts of any length come whole, columns may have any names, and an empty table, or one
    without a token, gives no rows. The plan is reduced to times drawn per
    document before it meets the texts, which are shuffled once.
    """
    plan = plan_mix(docs, weights, budget, doc_id=doc_id, source=source, text=text, **options)
    times = plan.groupBy("doc_id", "source", "text_hash").agg((F.max("epoch") + 1).alias("times"))
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("t.doc_id")) & F.col(f"row.`{source}`").eqNullSafe(F.col("t.source")) & (F.hash(f"row.`{text}`") == F.col("t.text_hash"))
    joined = rows.join(times.select(F.struct("*").alias("t")).hint("shuffle_hash"), same)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("t.times")))).select("row.*")


#: The same in DuckDB, over ``documents`` with the default weights and budget.
SQL = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '{_WORD}')) AS tokens,
         cast('0x' || substring(md5('{SEED}:' || doc_id), 1, 15) AS BIGINT) AS key FROM documents),
totals AS (SELECT source, sum(tokens)::BIGINT AS total FROM base GROUP BY source HAVING sum(tokens) > 0),
shares AS (
  SELECT source, total, floor(round((sum(total) OVER ()) * pow(total, {TEMPERATURE}) / sum(pow(total, {TEMPERATURE})) OVER (), 3))::BIGINT AS share FROM totals),
placed AS (
  SELECT b.*, share, total, (sum(tokens) OVER (PARTITION BY b.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS start
  FROM base b JOIN shares USING (source)),
drawn AS (SELECT *, share // total AS whole, share % total AS rest FROM placed)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INT AS epoch, start,
       (CASE WHEN epoch < whole THEN tokens ELSE least(tokens, rest - start) END)::BIGINT AS take
FROM (SELECT *, unnest(range(0, whole + (start < rest)::INT)) AS epoch FROM drawn)
"""
