"""Five stages from raw documents to token digests: language, near duplicates, benchmark leaks, secrets, encoding.

Each stage reads all that its predecessor kept. All but the last give the columns of documents; the last gives a row
for each document that is left. Extra columns of the input pass through. Null texts: their language is undetermined,
so stage 1 rejects them. Rows are judged by doc_id and text together, so rows that share a doc_id, or have none, stand or
fall by their own texts; a row is known by both, and of rows that are alike in both stage 2 keeps one. An empty table
gives an empty result. No stage samples or caps rows.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, langid, piece_bpe, secret_scan, simhash
from memlake.llm._shared import byte_slices, drop_written, scratch, table, written

#: Least calibrated probability of the predicted language.
LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (no letters) or predicted with less than LEAST_SCORE; lang becomes the prediction."""
    model = langid.train_on_documents(docs)
    names, at, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(at), rows=256):
                cut = batch.slice(a, b - a)
                found, score = model.predict(cut.column(at).to_pylist())
                columns = [pa.array(found, pa.string()) if i == lang else cut.column(i) for i in range(len(names))]
                keep = pa.array([x != langid.UNDETERMINED and s >= LEAST_SCORE for x, s in zip(found, score.tolist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _decisions(df: DataFrame, tag: str) -> DataFrame:
    """Decisions on rows, written, to be joined to the rows by a shuffle of both: their number grows with the corpus, and so they are joined alike at every size."""
    return written(df, tag).hint("merge")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: of its smallest doc_id (null only where it has no other), then of the smallest digest."""
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _digest().alias("digest")))
    judged = simhash.components(keyed.select("_key", "text"), "_key")
    judged = judged.groupBy(F.col("_key")).agg(F.first(F.col("_key") == F.col("component_id")).alias("_keep"), F.count("*").alias("_n"))
    marked = keyed.join(_decisions(judged.where("not _keep or _n > 1"), "judged"), "_key", "left")
    single, repeated = marked.where("_keep is null"), marked.where("_keep").dropDuplicates(["_key"])
    return single.unionByName(repeated).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, by their texts alone."""
    keyed = docs.withColumn("_digest", _digest())
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), "_digest").select("_digest").distinct()
    return keyed.join(_decisions(found, "leaks"), "_digest", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets, and n_chars by the new length; keeps every document."""
    ledger = secret_scan.Ledger(spark)
    held = secret_scan.versions(docs)
    ledger.update(held)
    found = _decisions(ledger.findings().withColumnsRenamed({"blob": "_blob", "found": "_found"}), "findings")
    marked = docs.withColumn("_blob", _digest()).join(found, "_blob", "left")
    marked = marked.withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(secret_scan.redact("text", "_found")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col("_found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return marked.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    return piece_bpe.digests(piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language", keep_known_language),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: No SQL expresses these stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go when its output is written, and so does its input
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
