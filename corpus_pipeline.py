"""A training corpus from raw documents: quality, repeated lines, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geochange.llm import bpe, common, line_dedup, mixing, near_copies, quality, queries


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled among them, doesn't reject. Needs doc_id and text;
    null texts are scored as empty, a null doc_id is never learned from; an empty table stays empty."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = docs.select("doc_id", "text").where(~common.held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id")
    return quality.filter_quality(docs, quality.fit_quality(learned))


def _beside(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, and the others as one column, so that no name of theirs meets one that a stage makes."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in columns] or [F.lit(0)]).alias("others"))


def _again(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from what _beside made."""
    held = set(found.columns) - {"others"}
    return found.select(*[(F.col(c) if c in held else F.col(f"others.`{c}`")).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents that consist of nothing else; n_chars follows.
    Needs doc_id, text and n_chars; null texts stay, an empty table stays empty."""
    found = line_dedup.line_dedup(_beside(docs, "doc_id", "text", "n_chars")).where("n_deleted < n_lines or n_deleted = 0")
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _again(found.withColumn("n_chars", chars).drop("n_lines", "n_deleted"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, rows without one last, then by the text's hash.

    Near copies are of the stage's own definition (five words, 0.8), not of op7's, and are found by op7's method: see near_copies. Needs doc_id, text,
    source and lang. Null and blank texts are copies of one another; an empty table stays empty."""
    rows = near_copies.grouped(docs.select("doc_id", "text"))
    # Rows are told apart by doc_id and text. The key has no nulls for the join and the window: the texts are shuffled once.
    first = rows.groupBy("root").agg(F.min(F.struct((F.col("d") == -(2**63)).alias("last"), "d", "t")).alias("k"))
    stay = first.select("k.d", "k.t")
    one = Window.partitionBy("d", "t").orderBy("source", "lang")
    kept = _beside(docs, "doc_id", "text", "source", "lang").withColumns({"d": common.row_key(), "t": common.text_key()}).join(stay, ["d", "t"], "left_semi")
    return _again(kept.withColumn("place", F.row_number().over(one)).where("place = 1").drop("d", "t", "place"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their weights; a document that is drawn again is a row again. Needs doc_id, text and source; a null
    source is one of its own, documents without words (null texts too) aren't drawn; an empty table stays empty."""
    found = mixing.mix_sources(_beside(docs, "doc_id", "text", "source"))
    return _again(found.drop("mix_repeat", "mix_weight", "mix_position"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and digests in place of its text (see bpe.encode); null texts have none."""
    return bpe.encode(docs, queries.tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

#: A compression classifier can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, "stage")
    return docs
