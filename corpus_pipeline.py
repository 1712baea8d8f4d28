"""The corpus pipeline: each stage works on all that the stage before it kept.

Each stage takes the columns of ``documents`` (others are left out), with nulls in any of them, empty and very long texts,
repeated rows and ids, and empty tables; what becomes of such rows is in the docstring of its operator.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Intermediate tables that the results of stages still read, by session and stage.
_MADE: dict[tuple[int, str], list[DataFrame]] = {}


def _stage(function):
    """A stage that deletes the intermediate tables of the stages before it.

    Its documents are the written result of the stage before, so the tables that this result was made of are needed no more. Those of
    the same stage, of later ones and of other sessions stay, as do tables that ``docs`` itself still reads; so results of one
    stage on several inputs can be read side by side until a later stage is called.
    """
    name = function.__name__

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from depgraph.llm.common import discard, recorded

        order = [f.__name__ for _, f in STAGES]
        read = docs.inputFiles()
        for key in [k for k in _MADE if k[0] == id(spark) and order.index(k[1]) < order.index(name)]:
            held = _MADE.pop(key)
            kept = [t for t in held if any(t.stored_at.split("://")[-1] in f for f in read)]
            discard(*(t for t in held if t not in kept))
            if kept:
                _MADE[key] = kept
        with recorded() as made:
            out = function(spark, docs, sf_dir)
        _MADE.setdefault((id(spark), name), []).extend(made)
        return out

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality classifier doesn't reject."""
    from depgraph.llm.quality import classify

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, host=F.col("source"), path=F.col("lang")).where("keep").select(COLUMNS)


@_stage
def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without later copies of repeated runs of lines; n_chars counts what is left."""
    from depgraph.llm.line_dedup import dedup_lines

    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates one row, that with the smallest doc_id (null last), then hash of text.

    Rows are told apart by their places in the files they are read from (64 bits of hashes), as doc_ids may be null or
    repeat. Rows that come from no files are written first. Texts without words all stay.
    """
    from depgraph.llm.common import written
    from depgraph.llm.jaccard_join import near_duplicates

    if not docs.inputFiles():
        docs = written(docs.select(COLUMNS), "read-again")
    docs = docs.select(*COLUMNS, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"))
    groups = near_duplicates(docs, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    first = groups.join(docs.select("row", order.alias("place")), "row").groupBy("component_id").agg(F.min("place").alias("place"))
    return docs.join(first.select(F.col("place.row").alias("row")), "row", "left_semi").select(COLUMNS)


@_stage
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the benchmark's windows don't cover beyond the limit; what is hit in others is cut out."""
    from depgraph.llm.decontaminate import decontaminate

    cut = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids and decoded text of each document that is left, as digests."""
    from depgraph.llm.queries import byte_bpe_digests

    return byte_bpe_digests(docs)


STAGES = [
    ("quality", keep_good),
    ("lines", delete_lines),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", keep_uncontaminated),
    ("encode", encode_texts),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written as Parquet in the shared folder and read again."""
    from depgraph.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
