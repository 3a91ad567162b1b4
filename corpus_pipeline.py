"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import best_fit_packing, jaccard_dedup, language_id, line_dedup, source_mixing
from docquarry.llm.common import Workspace


#: The tables behind the result of the stage called last. A stage's rows are written before the next one is called, which drops them.
_open: list[Workspace] = []


def workspace(spark: SparkSession, name: str, last: bool = False) -> Workspace:
    """For a stage's tables; those of the last stage stay until the application ends."""
    while _open:
        _open.pop().close()
    ws = Workspace(spark, name)
    if not last:
        _open.append(ws)
    return ws


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: texts without a letter, and those far from every learned centroid."""
    return language_id.identify(docs, docs.columns).where(~F.col("rejected")).select("kept.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has. No document goes; n_chars follows the text."""
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    found = line_dedup.dedup_lines(docs, ws=workspace(spark, "lines"))
    return found.select(*[made[c].alias(c) if c in made else F.col("kept").getField(c).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by op4's fingerprints or a similarity of 0.8 of five-word shingles, that of the smallest doc_id."""
    return jaccard_dedup.dedup(docs, workspace(spark, "dedup"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes no, one or more copies of each document, so that sources reach their target weights."""
    return source_mixing.mixed(docs, workspace(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, and their places in sequences of 4096 tokens."""
    packed = best_fit_packing.pack(docs, best_fit_packing.tokenizer_path(), ws=workspace(spark, "pack", last=True))
    return packed.withColumnRenamed("payload", "ids")


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mix", mix_sources),
    ("pack", pack),
]

#: SQL has neither the classifier nor fingerprints nor the tokenizer: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
