"""The corpus pipeline: documents through five operators of samewise.llm, each stage written and read again.

Each stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents, whatever further columns docs
has and whatever their names are: a stage's operator sees doc_id, text and one struct of all others.
Null and empty texts, null ids, repeated rows and empty tables have a defined result in each stage; see there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.llm.queries import table, toxicity_model
from samewise.session import drop_written, written

CORPUS_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rest, a struct of all other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(True).alias("none")])).alias("rest"))


def _as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the model is learnt from the labelled documents of the stage's input.

    Each row is judged by its text alone: repeated rows stay or go together, null and empty texts score alike, rows without
    doc_id are judged but not learnt from. Where no labelled document is toxic, or all are, every text has the smoothed share of
    toxic labels as its score. An empty table gives an empty result.
    """
    from samewise.llm.toxicity import toxicity

    return _as_before(toxicity(_packed(docs), toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)).where("score < 0.5"), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer, trained on this stage's input, takes for good.

    Each row is judged by its text alone; repeated rows stay or go together, and null texts are judged as empty ones, which are poor. An
    empty table gives an empty result.
    """
    from samewise.llm.quality import fit, quality

    return _as_before(quality(_packed(docs), fit(docs.select("text"))).where("predicted = 1"), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of least doc_id.

    Rows of one doc_id but other texts are documents of their own. Of rows with equal doc_id and equal text one stays, the one whose columns
    have the least hash. Texts without words, null texts and documents without doc_id are no duplicates; of the latter each row stays.
    An empty table gives an empty result.
    """
    from samewise.llm.minhash_dedup import near_duplicates

    texts = docs.select("doc_id", "text")
    kept = near_duplicates(texts).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = _packed(docs).withColumns({"id": F.col("doc_id").cast("long"), "hash": F.xxhash64("text"), "order": F.xxhash64("text", "rest")})
    first = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy("order"))).where("nth = 1")
    return _as_before(first, docs).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words that a document of smaller doc_id has; n_chars follows the text.

    Each row stays, if only with an empty text. Rows of one doc_id don't shorten one another, and a null doc_id counts as greater than all
    others. A text that loses nothing stays as it is, null included, with its n_chars. An empty table gives an empty result.
    """
    from samewise.llm.substring_dedup import substring_dedup

    kept = substring_dedup(_packed(docs))
    shorter = kept.select("doc_id", "text", "rest", "n_removed")
    out = shorter.select(*[F.col(c) if c in ("doc_id", "text") else (F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest").getField(c)).alias(c) for c in docs.columns])
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences: a row for each piece, of each row of docs.

    Null and empty texts have one piece, the end id alone. An empty table gives an empty result.
    """
    from samewise.llm.packing import best_fit_packing

    return best_fit_packing(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("minhash_near_dedup", one_of_each),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: Learnt models, signatures and tokenizers can't be stated in SQL; tests/llm holds each stage, and all of them, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = written(out, name)
        if before is not None:
            drop_written(before)
        before = docs
    return docs
