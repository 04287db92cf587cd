"""From documents to packed training sequences: stages that each write what they keep."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm.catalog import WEIGHTS, estimated_tokens, source_path
from segue.llm.line_dedup import delete_repeated_lines
from segue.llm.mixing import mix
from segue.llm.packing import pack_documents
from segue.llm.simhash import near_duplicates
from segue.llm.toxicity import score_toxicity
from segue.session import record_written, shared_folder


REST = "_segue_rest"


def _bare(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text and those named ``also``, and all other columns as fields of one: so no column of the
    documents can clash with one that an operator makes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *also, F.struct(F.lit(0).alias(REST), *rest).alias(REST))


def _restored(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` as they were, but for the text and those ``changed``."""
    named = {c: rows[c] if c in ("doc_id", "text") else rows[REST].getField(c) for c in docs.columns}
    return rows.select(*[c.alias(name) for name, c in (named | {k: c for k, c in changed.items() if k in named}).items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay, as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _restored(score_toxicity(_bare(docs), labels).where("predicted = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words or more are deleted; n_chars follows the text. Documents
    of which no line with a word is left go, those that had none before stay."""
    kept = delete_repeated_lines(_bare(docs), min_words=50)
    changed = F.size("removed_lines") > 0
    kept = kept.where(~changed | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    if "n_chars" not in docs.columns:
        return _restored(kept, docs)
    before = F.col(REST).getField("n_chars")
    return _restored(kept, docs, n_chars=F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least doc_id stays; of several rows with that
    doc_id in the group, one."""
    groups = near_duplicates(docs.select("doc_id", "text"), words=5, max_bits=2, similarity=0.8)
    first = groups.groupBy("class_id").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select(F.col("x.doc_id").alias("first_doc"), F.col("x.tag").alias("first_tag"))
    rows = _bare(docs).withColumn("tag", F.xxhash64("text"))
    met = rows.join(first, rows["doc_id"].cast("long").eqNullSafe(first["first_doc"]) & (rows["tag"] == first["first_tag"]), "left_semi")
    return _restored(met.dropDuplicates(["doc_id", "tag"]), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three quarters of the tokens, by the target weights, each document once at most. The document at
    which a source's budget ends stays whole."""
    mixed = mix(_bare(docs, "lang", "source"), source_path(), WEIGHTS, estimated_tokens(), share=0.75, max_epochs=1, seed=17)
    empty = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) == 0)  # they cost nothing
    return _restored(mixed.where("tokens > 0"), docs).unionByName(empty)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens lies in the training sequences."""
    return pack_documents(docs.select("doc_id", "text"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing), ("best-fit packing", packing),
]
#: Compression lengths and tokenizers can't be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = record_written(f"{shared_folder(spark).rstrip('/')}/segue/pipeline-{uuid.uuid4().hex}")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
