"""A training-corpus pipeline: quality, line dedup, near-dedup, source mix, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``. All stages but the last return the columns of
``documents``. Columns of ``docs`` beyond those are carried along, whatever
their names, but for ones that begin with two underscores. Empty tables give
empty tables; a null text is an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm import bpe, linededup, mixing, quality, simhash_dedup
from braidlog.llm.common import cut, small_batches, work_dir
from braidlog.llm.queries import good_labels, tokenizer


#: Names of the key that joins a stage's decisions with its rows, of how often a key is met, and of a row carried whole.
ROW, N, WHOLE = "__row", "__n", "__whole"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that is never null and equal only for rows equal in all columns."""
    parts = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumn(ROW, F.xxhash64(*parts))


def once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed ``docs`` joined with ``keys`` ``(ROW, N, ...)``; of the ``N`` rows of a repeated key, one.

    Only the rows of repeated keys are grouped to be told apart.
    """
    met = docs.join(keys, ROW)
    return met.where(F.col(N) == 1).unionByName(met.where(F.col(N) > 1).dropDuplicates([ROW]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled ones among ``docs``.

    Each row has its own verdict, whatever its id: of rows that share an id some
    may stay, rows with a null id are judged, and equal rows have equal verdicts.
    """
    small_batches(spark)
    rows = keyed(docs).withColumn(WHOLE, F.struct(*docs.columns))
    judged = quality.resample(rows, good_labels(spark, sf_dir), key_col=ROW, carry=(WHOLE,))
    return judged.where("kept").select(*(F.col(WHOLE)[c].alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them only. A text left without any word goes.

    Rows with the same id are one document when its lines are counted, and each
    keeps its own text without them; rows with a null id lose nothing. A row
    that loses no line keeps its text as it is.
    """
    small_batches(spark)
    lines = F.col("__lines")
    text = F.when(lines["n_dropped"] > 0, lines["kept"]).otherwise(F.col("text"))
    out = linededup.cleaned(docs).withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
    return out.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles at a Jaccard similarity of 0.8) one row stays.

    It is a row of the smallest id, null ids last; rows that share an id or are
    equal in all columns are told apart like any others.
    """
    small_batches(spark)
    rows = keyed(docs)
    found = simhash_dedup.near_duplicates(rows, ROW, similarity=0.8).select(ROW, "component_id")
    of = found.groupBy(ROW, "component_id").agg(F.count("*").alias("n")).join(rows.select(ROW, "doc_id").distinct(), ROW)
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW, "n")).alias("x"))
    return once(rows, cut(first.select(F.col(f"x.{ROW}").alias(ROW), F.col("x.n").alias(N)))).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three copies of a row.

    Rows that share an id have their own copies; of equal rows the copies are summed.
    """
    rows = keyed(docs)
    taken = cut(mixing.mix(rows, ROW).groupBy(ROW).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias(N)).where(F.col("__copies") > 0))
    return once(rows, taken).withColumn(N, F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each text of the mix."""
    small_batches(spark)
    path, pattern = tokenizer()
    return bpe.encode(docs, path, pattern, digest=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", neardup_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: The classifier, the fingerprints' hash and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
