"""The shared folder, lineage cuts and bounded bitmaps used by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key bitmap. Fixed, so what is collected never grows with the data (512 KB).
BITMAP_BITS = 1 << 22
#: Most bits of a bitmap that is sized by its keys (8 MB).
MOST_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh local one only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Bytes and rows of an Arrow batch, at most: what a task and its Python worker hold at a time, texts of more bytes aside.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to those above, where they are wider; they never change a result."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = re.match(r"-?\d+", spark.conf.get(name))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(name, most)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing before it."""
    path = new_folder(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bits_for(keys: int) -> int:
    """Bits of a bitmap that lets about one in 16 other keys through, within the bounds of what may be sent to every task."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (16 * max(1, keys) - 1).bit_length()))


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> Column:
    """A scalar subquery holding a bitmap of fixed size over the long ``column``; test it with :func:`may_hold`.

    A one-sided filter: no false negatives. It drops rows before a shuffle join, and rows it lets
    through in error are dropped by that join, so results never depend on ``bits``.
    """
    bit = F.pmod(F.col(column), F.lit(bits))
    found = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    words = hashes.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").alias("w")).join(found, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")).scalar()


def may_hold(bitmap: Column, value: Column, bits: int = BITMAP_BITS) -> Column:
    bit = F.pmod(value, F.lit(bits))
    word = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def prefixed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select ``columns`` (new name -> old name) only, so that extra columns can't clash with working names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
