"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm._store import cut
from axisframe.llm.decontaminate import decontaminate
from axisframe.llm.jaccard_join import jaccard_components
from axisframe.llm.line_dedup import dedup_lines
from axisframe.llm.queries import tokenizer_path
from axisframe.llm.toxicity import toxicity_scores
from axisframe.llm.unigram import encode_pieces


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with numbers of their rows, and the numbers' column: stages decide by row, whatever the ids are.

    A row of a file table has the file's number and its place in the file, which are the same in every job. Any other
    table is written once with numbers.
    """
    row, file, place = "row", "file", "place"
    while {row, file, place} & set(docs.columns):
        row, file, place = f"{row}_", f"{file}_", f"{place}_"
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # not a table of files
        return cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    # as many rows as files, whose list the driver has already
    names = sorted(r[0] for r in placed.select(file).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{file} string, {row} long")
    numbered = placed.join(F.broadcast(files), file).withColumn(row, F.shiftleft(F.col(row), 40) + F.col(place))
    return numbered.select(*docs.columns, row), row


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select(row), row, "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs, row = _numbered(docs)
    return _without(docs, row, toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents that have nothing else."""
    return dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the row with the smallest id stays (null ids last, then by row); documents without words stay."""
    docs, row = _numbered(docs)
    found = jaccard_components(docs, id_col=row).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    found = cut(found.join(docs.select(row, F.col("doc_id").alias("own_id")), row), "components")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("null"), "own_id", F.col(row).alias("row"))).alias("first"))
    return _without(docs, row, found.join(first, "component_id").where(F.col(row) != F.col("first.row")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    docs, row = _numbered(docs)
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).where("n_hit > 0")
    return _without(docs, row, hit.select(F.col("doc_id").alias(row)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and whether they read back as the text."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL expresses neither the classifier nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
