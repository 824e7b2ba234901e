"""Repeated runs of lines, by a suffix array over line ids. DataFrame functions only.

Each line gets an id, its rank among all lines' digests; the corpus is then a set of sequences of ids. Prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines: round k orders suffixes by the pair of their rank and the rank
of what follows 2^k lines on. Two suffixes share their first m lines exactly if the ranks of the two runs of 2^k lines
that cover these m lines agree, so each interval of the suffix array with a common prefix of at least m lines has
such a pair of ranks as its name. Intervals are looked up for the shortest runs of enough words, from each line on and
up to each line: together these cover every maximal repeated run of enough words, and nothing else. In each interval
the first run in the order of documents stays and the others are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common



def _lines(docs: DataFrame) -> DataFrame:
    """(d, t, pos, h1, h2, words) of each line; d and t name a document, h1 and h2 a line."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    return rows.select("d", "t", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("#"), line).alias("h2"), F.regexp_count(line, F.lit("\\S+")).alias("words"))


def suffix_ranks(lines: DataFrame, rounds: int) -> DataFrame:
    """lines with r0 .. r<rounds>: the rank of each suffix by its first 2^k lines, null where its sequence has fewer.

    lines: d, t, seq, pos, h1, h2, words; a sequence's lines follow one another in pos. A rank is how many suffixes
    are smaller, so equal prefixes have equal ranks, and order by rank is suffix order.
    """
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    # Digests are even, so their leading bits part them evenly.
    ids = common.sums_before(ids, [], "h1", F.shiftrightunsigned("h1", 64 - common.BUCKET_BITS), ["h2"]).select("h1", "h2", F.col("less").alias("r0"))
    now = common.written(lines.join(ids, ["h1", "h2"]).drop("h1", "h2"), "suffixes")
    total = now.count()
    width = max(1, -(-total >> common.BUCKET_BITS))
    along = Window.partitionBy("d", "t", "seq").orderBy("pos")
    for k in range(rounds):
        r, new = f"r{k}", f"r{k + 1}"
        both = now.withColumn("_next", F.lead(r, 1 << k).over(along))
        pairs = both.where("_next is not null").groupBy(r, "_next").agg(F.count("*").alias("n"))
        ranked = common.sums_before(pairs, [r], "_next", F.floor(F.col("_next") / width), []).select(r, "_next", (F.col(r) + F.col("less")).alias(new))
        after = common.written(both.join(ranked, [r, "_next"], "left").drop("_next"), "suffixes")
        common.dropped(now)
        now = after
    return now


def repeated_runs(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """(d, t, runs): for each document with any, the deleted ranges of lines [first, last], disjoint and in order."""
    lines = _lines(docs)
    # Only lines that occur twice can be in a repeated run; the others cut the sequences.
    # Written, as Spark splits the rows of a hot line only in a join that does nothing else in its stage.
    often = common.written(lines.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated-ids")
    kept = lines.join(often, ["h1", "h2"]).dropDuplicates(["d", "t", "pos"])
    along = Window.partitionBy("d", "t").orderBy("pos")
    kept = kept.withColumn("seq", F.col("pos") - F.row_number().over(along))
    # Words up to each line and from each line on, in its sequence; sequences of too few words hold no run.
    seq = Window.partitionBy("d", "t", "seq")
    kept = kept.withColumn("all", F.sum("words").over(seq)).where(F.col("all") >= min_words).drop("all")
    kept = common.written(kept, "repeated-lines")
    order = seq.orderBy("pos")
    upto = kept.withColumn("_up", F.sum("words").over(order)).withColumn("_from", F.sum("words").over(seq) - F.col("_up") + F.col("words"))
    first, last = F.min("pos").over(seq), F.max("pos").over(seq)
    # The shortest run of enough words that begins at a line, and the shortest that ends at it.
    ends = F.coalesce(F.min("pos").over(seq.orderBy("_from").rangeBetween(Window.unboundedPreceding, -min_words)) - 1, F.when(F.col("_from") >= min_words, last))
    begins = F.coalesce(F.max("pos").over(seq.orderBy("_up").rangeBetween(Window.unboundedPreceding, -min_words)) + 1, F.when(F.col("_up") >= min_words, first))
    both = upto.withColumn("_end", ends).withColumn("_begin", begins)
    spans = F.array(F.struct(F.col("pos").alias("a"), F.col("_end").alias("b")), F.struct(F.col("_begin").alias("a"), F.col("pos").alias("b")))
    runs = both.select("d", "t", "seq", F.explode(spans).alias("x")).select("d", "t", "seq", "x.a", "x.b").where("a is not null and b is not null").distinct()
    runs = common.written(runs.withColumn("m", F.col("b") - F.col("a") + 1).withColumn("k", F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int")), "runs")
    rounds = runs.agg(F.max("k")).first()[0] or 0
    ranks = suffix_ranks(kept, rounds)
    picked = [F.col(f"r{k}") for k in range(rounds + 1)]
    table = ranks.select("d", "t", "seq", "pos", F.array(*picked).alias("r"))
    left = runs.join(table.withColumnRenamed("pos", "a"), ["d", "t", "seq", "a"]).select("d", "t", "seq", "a", "b", "m", "k", F.col("r")[F.col("k")].alias("ra"), (F.col("b") + 1 - F.pow(F.lit(2.0), F.col("k")).cast("int")).alias("p2"))
    named = common.written(left.join(table.select("d", "t", "seq", F.col("pos").alias("p2"), F.col("r").alias("r2")), ["d", "t", "seq", "p2"]).select("d", "t", "a", "b", "m", "ra", F.col("r2")[F.col("k")].alias("rb")), "intervals")
    # An interval's first run in the order of documents stays.
    place = F.struct("d", "t", "a")
    least = common.written(named.groupBy("m", "ra", "rb").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "first-runs")
    later = named.join(least, ["m", "ra", "rb"]).where(place > F.col("_first")).select("d", "t", "a", "b")
    # Ranges that overlap or touch become one.
    before = Window.partitionBy("d", "t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upon = Window.partitionBy("d", "t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.when(F.col("a") > F.max("b").over(before) + 1, 1).otherwise(0)
    islands = later.withColumn("_new", new).withColumn("_i", F.sum("_new").over(upon)).groupBy("d", "t", "_i").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    return islands.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """Rows of docs with their columns, text without later copies of repeated runs, and n_lines, n_deleted.

    Needs doc_id and text. A run is a sequence of whole lines, split at newlines, within one document; runs are copies
    if all lines are equal, and count from min_words words on (runs of non-white-space), in maximal length. Of each
    run the first copy stays, in the order of doc_id, the hash of the text and the place; within a document too. A run
    may be one line. Null texts stay null, with no line; an empty text has one empty line. Rows that repeat a doc_id
    and text are one document and get one result each; a null doc_id comes first. A document of deleted lines only
    gets an empty text. Columns of docs that are named like a new one are kept as `source_<name>` (see common.renamed). An
    empty table gives an empty result.
    """
    new = ("n_lines", "n_deleted")
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, common.renamed(docs.columns, new), strict=True)])
    runs = common.written(repeated_runs(docs.select("doc_id", "text"), min_words), "deleted")
    # The row travels as one column, so that no name of it meets one made here.
    text = F.col("row.text")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))
    # One plan at every size: left to Spark, few runs would be broadcast and many not.
    both = keyed.join(runs.hint("merge"), ["d", "t"], "left")
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    size = F.when(text.isNull(), 0).otherwise(F.size(lines))
    gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0))
    cut = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(left, "\n"))
    return both.select(*[cut.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], size.alias("n_lines"), gone.alias("n_deleted"))
