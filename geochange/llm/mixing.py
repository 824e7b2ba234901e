"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and made to add
up to 1 again. The exponent is the largest at which the mix has the wanted entropy, or the smallest at which no
source is repeated more often than allowed, whichever is larger; both are found by bisection. Each source then gets
its weight's share of the token budget, taken from its documents as permutation after permutation: blocks in an
order drawn anew for each repetition, documents in an order drawn within the block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rounds of bisection that one pass over the sources' totals does at once.
LEVELS = 4


@dataclass(frozen=True)
class Mix:
    """entropy: wanted share of the largest entropy possible, log of the number of sources; repeats: how often a token
    of a source may be used at most; budget: tokens in all, the corpus's own number if None; block: documents that a
    block is to hold about; seed: of the permutations."""

    entropy: float = 0.98
    repeats: float = 4.0
    budget: int | None = None
    block: int = 1000
    seed: str = "mix"


def doc_tokens(text: Column) -> Column:
    """Words as a document's tokens: runs of what is not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+")).cast("long")


def draw(*parts: Column) -> Column:
    """A number drawn from the parts, the same everywhere and in other engines: the first 15 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def _bisect(shares: DataFrame, value, goal: float, rounds: int = 32) -> float:
    """The exponent in [0, 1] up to which value, falling as the exponent grows, is at least goal; 1 if it always is."""
    lo, hi = 0.0, 1.0
    n = 2**LEVELS
    for i in range(rounds // LEVELS):
        at = [lo + (hi - lo) * k / n for k in range(1 if i else 0, n + (0 if i else 1))]
        got = list(shares.agg(*[value(a).alias(f"v{k}") for k, a in enumerate(at)]).first())
        if i == 0 and got[-1] is not None and got[-1] >= goal:
            return 1.0
        good = [a for a, v in zip(at, got, strict=True) if v is not None and v >= goal]
        top = max(good, default=lo)
        lo, hi = top, top + (hi - lo) / n
    return lo


def _entropy(a: float) -> Column:
    w = F.pow("p", F.lit(a))
    return F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w)


def exponent(shares: DataFrame, opts: Mix, budget: float) -> float:
    """From shares(source, tokens, p): see the module. Rounded to 6 digits. The totals stay in Spark; a pass sends back 16 sums."""
    n = shares.count()
    if n < 2:
        return 1.0
    by_entropy = _bisect(shares, _entropy, opts.entropy * math.log(n))

    def repeats(a: float) -> Column:
        """How often the most repeated source is used; falls as the exponent grows."""
        w = F.pow("p", F.lit(a))
        return F.max(w / F.col("tokens")) / F.sum(w) * F.lit(budget)

    by_repeats = _bisect(shares, repeats, opts.repeats)
    # Up to by_repeats the limit is passed; the next larger exponent of 6 digits keeps it.
    least = 0.0 if shares.agg(repeats(0.0)).first()[0] <= opts.repeats else min(1.0, math.ceil(by_repeats * 1e6) / 1e6)
    return max(math.floor(by_entropy * 1e6) / 1e6, least)


def mix_sources(docs: DataFrame, opts: Mix = Mix()) -> DataFrame:
    """Rows of docs with their columns, and mix_repeat (0, 1, ... as a document is repeated), mix_weight, mix_position.

    Needs doc_id, source and text. A null source is a source of its own; null texts count as empty, and documents
    without words, and sources of none but such, are not drawn. A document is drawn if its running sum of tokens in its
    source's order begins within the source's budget, so a source gets its budget or up to one document more.
    mix_position orders a source's rows as drawn. Columns of docs that are named like a new one are kept as
    `source_<name>`. Rows of a source that repeat a doc_id and text are drawn together, as one document of all their tokens.
    An empty table gives an empty result.

    No window runs over a source: it is cut into blocks whose number follows its rows, the running sums of the blocks
    come from one small row each, and only the block that the budget ends in needs the sums of its documents.
    """
    new = ("mix_repeat", "mix_weight", "mix_position")
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, common.renamed(docs.columns, new), strict=True)])
    columns = docs.columns
    # The digest sets apart texts that share a doc_id.
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.col("source"), key.alias("_key"), doc_tokens(F.col("text")).alias("_n")).where("_n > 0")
    rows = common.written(rows.groupBy("source", "_key").agg(F.sum("_n").alias("_n")), "mix")
    totals = common.written(rows.groupBy("source").agg(F.sum("_n").alias("tokens"), F.count("*").alias("rows")), "mix-totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = whole if opts.budget is None else opts.budget
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(whole or 1)))
    a = exponent(shares, opts, float(budget))
    norm = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.round(F.pow("p", F.lit(a)) / F.lit(norm), 9)
    plan = shares.withColumn("weight", weight).select(
        "source",
        "weight",
        "tokens",
        F.least(F.floor(F.col("weight") * F.lit(float(budget))), F.floor(F.col("tokens") * F.lit(float(opts.repeats)))).cast("long").alias("quota"),
        F.ceil(F.col("rows") / F.lit(float(opts.block))).cast("long").alias("blocks"),
    )
    seed = F.lit(opts.seed)
    at = F.pmod(draw(seed, F.col("_key")), F.col("blocks")).alias("_block")
    # The plan has a row for each source; the joins on source are dealt out by Spark, which splits a hot one.
    blocked = rows.join(plan.select(F.col("source").alias("_s"), "blocks"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "_key", "_n", at)
    sizes = blocked.groupBy("source", "_block").agg(F.sum("_n").alias("_size"))
    # One row for each block and repetition, with the tokens before it.
    turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("tokens")).cast("int") - 1))
    copies = sizes.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "_block", "_size", "weight", "tokens", "quota", F.explode(turns).alias("mix_repeat"))
    # A source's blocks are in the order of a draw, whose leading bits part them evenly.
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    copies = copies.withColumn("_part", named).withColumn("_draw", draw(seed, F.col("mix_repeat").cast("string"), F.col("_block").cast("string"))).withColumn("n", F.col("_size"))
    copies = common.sums_before(copies, ["_part", "mix_repeat"], "_draw", F.shiftright("_draw", 60 - common.BUCKET_BITS), ["_block"])
    copies = copies.withColumn("_before", F.col("mix_repeat") * F.col("tokens") + F.col("less")).where("_before < quota")
    drawn = blocked.join(copies.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "mix_repeat", "_before", "_size", "quota", "weight"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    inside = Window.partitionBy("source", "mix_repeat", "_block").orderBy(draw(seed, F.col("mix_repeat").cast("string"), F.col("_key")), "_key").rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    drawn = drawn.withColumn("mix_position", position).where("mix_position < quota")
    drawn = drawn.select(F.col("source").alias("_s"), F.col("_key").alias("_k"), "mix_repeat", F.col("weight").alias("mix_weight"), "mix_position")
    # The row travels as one column, so that no name of it meets one made here.
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source"), key.alias("_key"))
    out = full.join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *new)
