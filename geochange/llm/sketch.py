"""Document fingerprints as invertible Bloom lookup sketches. DataFrame functions only.

A text is the set of its paragraphs' digests. Each digest goes into three cells, one of each third of a sketch; a cell
holds how many digests it has, and the exclusive or of them and of their checks. Sketches subtract cell by cell: what
two versions share is gone, and cells left with one digest give it away, which is then taken out of its other cells,
and so on. Where a pair of texts doesn't peel empty, it is retried with its digests dealt out to many more cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a sketch, in three thirds. It peels differences of up to about 35 digests.
CELLS = 48
#: Words that a paragraph's pieces have at most; the opening line is cut finer, so that a text of one line has several.
PIECE = 64
OPENING = (4, 8, 16, 32)
#: Digests of both sides that a sub-sketch of a retry is to hold about.
LOAD = 12
#: Characters of texts that a range of documents holds about, where the next document is looked up.
RANGE_CHARS = 4 << 20


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: its lines, those of over 2 * PIECE characters in pieces of PIECE
    words with the white space after them. The opening line, unless it begins with white space, is in pieces of OPENING
    words first, then of PIECE. An empty text has none."""
    lines = F.split(text, "\n", -1)
    words = rf"(?s)(?:\S+\s*){{1,{PIECE}}}|\s+"
    opening = F.element_at(lines, 1)
    # The k-th opening piece follows the words of those before it.
    ahead = [sum(OPENING[:k]) for k in range(len(OPENING))]
    first = [F.regexp_extract(opening, rf"(?s)^(?:\S+\s+){{{n}}}((?:\S+\s*){{1,{m}}})", 1) for n, m in zip(ahead, OPENING, strict=True)]
    rest = F.substring(opening, sum((F.length(x) for x in first), F.lit(1)), F.length(opening))
    pieces = F.concat(F.array(*first), F.regexp_extract_all(rest, F.lit(words), F.lit(0)))
    more = F.flatten(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.when(F.length(x) <= 2 * PIECE, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(words), F.lit(0)))))
    return F.array_distinct(F.transform(F.filter(F.concat(pieces, more), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _cell(key: Column, third: int, seed: int) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(100 * seed + third)), F.lit(CELLS // 3)) + third * (CELLS // 3)).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def sketch(keys: Column, seed: int = 0) -> Column:
    """CELLS cells of (n, key, check) of an array of distinct digests. keys must be a plain column: it is read in each cell."""
    size = CELLS // 3

    def cell(entries: Column, place: Column) -> Column:
        return F.aggregate(
            F.filter(entries, lambda e: e["c"] == place),
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check")),
            lambda s, e: F.struct((s["n"] + 1).alias("n"), s["key"].bitwiseXOR(e["k"]).alias("key"), s["check"].bitwiseXOR(e["h"]).alias("check")),
        )

    def cells_of(third: int) -> Column:
        entries = F.transform(keys, lambda k: F.struct(_cell(k, third, seed).alias("c"), k.alias("k"), _check(k).alias("h")))
        places = F.sequence(F.lit(third * size), F.lit(third * size + size - 1))
        # transform over an array of one element binds the entries, so that they are made once for all cells.
        return F.flatten(F.transform(F.array(entries), lambda es: F.transform(places, lambda c: cell(es, c))))

    return F.concat(*[cells_of(third) for third in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column, seed: int = 0, rounds: int = 12) -> Column:
    """Of a difference: (ours, theirs) digests recovered, and cells left that are not empty, 0 if it peeled."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("ours"), none.alias("theirs"), F.lit(True).alias("go"))

    def step(s: Column, _: Column) -> Column:
        def pure(n: int) -> Column:
            return F.array_distinct(F.transform(F.filter(s["cells"], lambda c: (c["n"] == n) & (c["check"] == _check(c["key"]))), lambda c: c["key"]))

        def taken(found: Column) -> Column:
            """found: (a, b) digests; the cells without them."""
            moves = F.concat(
                F.flatten(F.transform(found["a"], lambda k: F.array(*[F.struct(_cell(k, t, seed).alias("c"), F.lit(1).alias("n"), k.alias("k")) for t in range(3)]))),
                F.flatten(F.transform(found["b"], lambda k: F.array(*[F.struct(_cell(k, t, seed).alias("c"), F.lit(-1).alias("n"), k.alias("k")) for t in range(3)]))),
            )

            def without(ms: Column) -> Column:
                return F.transform(
                    s["cells"],
                    lambda c, i: F.aggregate(
                        F.filter(ms, lambda m: m["c"] == i),
                        c,
                        lambda x, m: F.struct((x["n"] - m["n"]).alias("n"), x["key"].bitwiseXOR(m["k"]).alias("key"), x["check"].bitwiseXOR(_check(m["k"])).alias("check")),
                    ),
                )

            return F.element_at(F.transform(F.array(moves), without), 1)

        both = F.array(F.struct(pure(1).alias("a"), pure(-1).alias("b")))
        after = F.element_at(
            F.transform(
                both,
                lambda f: F.struct(
                    taken(f).alias("cells"),
                    F.concat(s["ours"], f["a"]).alias("ours"),
                    F.concat(s["theirs"], f["b"]).alias("theirs"),
                    ((F.size(f["a"]) + F.size(f["b"])) > 0).alias("go"),
                ),
            ),
            1,
        )
        return F.when(s["go"], after).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        start,
        step,
        lambda s: F.struct(s["ours"].alias("ours"), s["theirs"].alias("theirs"), F.size(F.filter(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0))).alias("left")),
    )


def written_sketch(n_chars: Column, text: Column, cells: Column) -> Column:
    """The fingerprint as a string: length and hash of the text, then the cells that hold something. Equal texts have
    equal ones, and texts of equal paragraphs in another order differ in the hash alone."""
    held = F.transform(cells, lambda c, i: F.when(c["n"] != 0, F.concat_ws(".", F.hex(i), F.hex(c["n"]), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"].bitwiseAND(F.lit(0xFFFFFFFF)))))))
    return F.concat_ws(":", F.hex(n_chars), F.lower(F.hex(F.xxhash64(text))), F.array_join(held, ","))


def likeness(n_a: Column, n_b: Column, ours: Column, theirs: Column) -> Column:
    """Shared paragraphs over all of both, from the numbers of each text and of each side's recovered digests; 1 for two empty texts."""
    union = (n_a + n_b + ours + theirs) / 2
    return F.when(union == 0, 1.0).otherwise((union - ours - theirs) / union)


def differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For rows (id, digests a, digests b) that a single sketch failed for: id, ours, theirs, how many digests each
    side has alone. The digests are dealt out to sub-sketches of about LOAD; pairs that fail again are dealt anew, to
    twice as many, until all have peeled: what fails is digests that share their cells, which each dealing parts."""
    left, done, seed = pairs.select("id", F.col(a).alias("a"), F.col(b).alias("b")), None, 0
    left = common.written(left.withColumn("subs", F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / LOAD)).cast("long")), "sketch-retry")
    while True:
        seed += 1
        side = F.concat(F.transform("a", lambda k: F.struct(F.lit(1).alias("s"), k.alias("k"))), F.transform("b", lambda k: F.struct(F.lit(-1).alias("s"), k.alias("k"))))
        rows = left.select("id", "subs", F.explode(side).alias("e")).select("id", F.pmod(F.xxhash64("e.k", F.lit(7 * seed)), F.col("subs")).alias("sub"), F.col("e.s").alias("s"), F.col("e.k").alias("k"))
        # A sub-sketch holds a few digests of one pair.
        own = rows.groupBy("id", "sub").agg(F.collect_list(F.when(F.col("s") == 1, F.col("k"))).alias("x"), F.collect_list(F.when(F.col("s") == -1, F.col("k"))).alias("y"))
        cells = own.select("id", sketch(F.col("x"), seed).alias("x"), sketch(F.col("y"), seed).alias("y"))
        peeled = cells.select("id", peel(subtract(F.col("x"), F.col("y")), seed).alias("p"))
        found = peeled.groupBy("id").agg(F.sum(F.size("p.ours")).alias("ours"), F.sum(F.size("p.theirs")).alias("theirs"), F.max("p.left").alias("left"))
        found = common.written(found, "sketch-found")
        good = found.where("left = 0").drop("left")
        done = good if done is None else done.unionByName(good)
        bad = found.where("left > 0").select("id")
        again = common.written(left.join(bad, "id", "left_semi").withColumn("subs", F.col("subs") * 2), "sketch-retry")
        common.dropped(left)
        left = again
        if not left.limit(1).count():
            common.dropped(left)
            return done


def _passed(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts, in order, are at most value: first by groups of them, then in the group."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def among(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, x: n + (value >= x).cast("int"))

    firsts = among(F.lit([g[0] for g in groups]))
    # Bound once by a transform over one element.
    inner = F.transform(F.array(firsts), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + among(F.get(F.lit(groups), k - 1))))
    return F.get(inner, F.lit(0))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """docs(d, t, ...) with next_<c> of each column: of the row that follows in descending order of (d, t); the last
    row is followed by the first.

    No window runs over all rows: d's range is cut into buckets at sampled values, and the first row of each bucket is
    put at the end of the bucket before it too.
    """
    spark = docs.sparkSession
    cuts = sorted(set(docs.approxQuantile("d", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    bucket = _passed(F.col("d"), cuts)
    rows = docs.withColumn("_b", bucket)
    # One small row for each bucket; the last bucket in order is followed by the first.
    tops = sorted(tuple(r["top"]) + (r["_b"],) for r in docs.select("d", "t").withColumn("_b", bucket).groupBy("_b").agg(F.max(F.struct("d", "t")).alias("top")).collect())
    follows = [(d, t, tops[(i + 1) % len(tops)][2]) for i, (d, t, _) in enumerate(tops)]
    firsts = spark.createDataFrame(follows, "_d long, _t long, _to int")
    ghosts = rows.join(F.broadcast(firsts), (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t"))).dropDuplicates(["d", "t", "_to"])
    ghosts = ghosts.withColumn("_b", F.col("_to")).drop("_d", "_t", "_to")
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    order = Window.partitionBy("_b").orderBy("_ghost", F.desc("d"), F.desc("t"))
    # As many tasks as ranges, so that a task holds no more as the table grows.
    return both.repartition(buckets, "_b").select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not _ghost").drop("_ghost", "_b")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs, for its text, its edited text, and the next document in descending order of doc_id
    (after the last the first): doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and edits, how many paragraphs the two versions have alone.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next text's first, or all of
    them. Likeness is that of the sets of paragraphs, shared over all, from the digests that the sketches' difference
    gives back. Only doc_id and text are read. Null counts as empty; two empty texts have likeness 1. Rows that repeat
    a doc_id follow one another by the hash of their text; a null doc_id comes last. A single row is followed by
    itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # So many ranges that one holds no more as the table grows, each a row of the driver's, up to 65536.
    ranges = max(2 * common.shuffle_parts(spark), min(-(-chars // RANGE_CHARS), 65536))
    rows = with_next(rows.withColumn("a", paragraph_digests(F.col("text"))), ["text", "a"], ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "d", "t", n.cast("long").alias("n_chars"), F.xxhash64("text").alias("own"), "a", F.col("next_a").alias("c"), edited.alias("edited"))
    rows = rows.withColumn("b", paragraph_digests(F.col("edited"))).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_own", F.xxhash64("edited")).withColumn("edited_chars", F.length("edited"))
    # Written, as the sketches read the digests many times over.
    rows = common.written(rows.drop("edited").withColumn("id", F.monotonically_increasing_id()), "digests")
    cells = rows.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("b")).alias("sb"), sketch(F.col("c")).alias("sc"))
    shown = [written_sketch(F.col("n_chars"), F.col("own"), F.col("sa")).alias("fingerprint"), written_sketch(F.col("edited_chars"), F.col("edited_own"), F.col("sb")).alias("edited_fingerprint")]
    sizes = [F.size(x).alias(f"n_{x}") for x in "abc"]
    peeled = cells.select("id", "doc_id", "n_chars", "edited_sha256", *shown, *sizes, peel(subtract(F.col("sa"), F.col("sb"))).alias("e"), peel(subtract(F.col("sa"), F.col("sc"))).alias("n"))
    sides = [c for x in "en" for c in (F.size(f"{x}.ours").cast("long").alias(f"{x}_ours"), F.size(f"{x}.theirs").cast("long").alias(f"{x}_theirs"), F.col(f"{x}.left").alias(f"{x}_left"))]
    counts = common.written(peeled.select("id", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_a", "n_b", "n_c", *sides), "peeled")
    failed = rows.select("id", "a", "b", "c").join(counts.where("e_left > 0 or n_left > 0").select("id", "e_left", "n_left"), "id")
    pairs = failed.select(F.explode(F.array(F.when(F.col("e_left") > 0, F.struct((F.col("id") * 2).alias("id"), "a", F.col("b").alias("b"))), F.when(F.col("n_left") > 0, F.struct((F.col("id") * 2 + 1).alias("id"), "a", F.col("c").alias("b"))))).alias("p"))
    again = common.written(differences(pairs.where("p is not null").select("p.*"), "a", "b"), "peeled-again")
    common.dropped(rows)
    found = again.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(*[F.max(F.when(F.col("id") % 2 == k, F.col(c))).alias(f"{x}_{c}_2") for k, x in enumerate("en") for c in ("ours", "theirs")])
    # Only rows that were retried are dealt out for it; the others, with their fingerprints, stay where they are.
    retried = F.expr("e_left > 0 or n_left > 0")
    both = counts.where(~retried).unionByName(counts.where(retried).join(found, "id"), allowMissingColumns=True)
    part = {f"{x}_{c}": F.coalesce(f"{x}_{c}_2", F.col(f"{x}_{c}")) for x in "en" for c in ("ours", "theirs")}
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("n_a"), F.col("n_b"), part["e_ours"], part["e_theirs"]).alias("near_edited"),
        likeness(F.col("n_a"), F.col("n_c"), part["n_ours"], part["n_theirs"]).alias("near_next"),
        (part["e_ours"] + part["e_theirs"]).alias("edits"),
    )
