"""Frames in Parquet with their shape beside the schema, directory listings, and path functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.frame import TensorFrame
from axisframe.shape import Shape

_KEY = "axisframe.shape"


def save(tf: TensorFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write the frame; its shape goes into the metadata of the first column that the files hold, so no side file can be lost."""
    first = next(c for c in tf.df.columns if c not in (partition_by or []))
    df = tf.df.withMetadata(first, {_KEY: tf.dims.to_json(), "values": list(tf.values)})
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def load(spark: SparkSession, path: str | list[str], components: list[str] | None = None) -> TensorFrame:
    """Read frames written by :func:`save`, whole or some of their components; columns and row groups are pruned by what is used of them.

    A folder of saved frames that share their dimensions can be read at once, as can a list of such folders.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    meta = next(f.metadata for f in df.schema.fields if _KEY in f.metadata)
    dims, values = Shape.from_json(meta[_KEY]), list(meta["values"])
    unknown = set(components or ()) - set(values)
    if unknown:
        raise ValueError(f"no components {sorted(unknown)} among {values}")
    values = values if components is None else components
    return TensorFrame(df.select(*dims.names, *values), dims, tuple(values))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, size and time of the files below a folder, listed by Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), r"(?<=[^/])/+$", "")


def splitext(path: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)
    return F.substr(path, F.lit(1), F.length(path) - F.length(ext)), ext


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), "(?<!:)/+", "/")


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def list_directories(spark: SparkSession, folder: str) -> DataFrame:
    """The folders that hold files somewhere below ``folder``."""
    return list_files(spark, folder).select(dirname(F.col("path")).alias("path")).distinct()


def split_path(path: Column) -> tuple[Column, Column]:
    return dirname(path), basename(path)


def split_drive(path: Column) -> tuple[Column, Column]:
    """Paths have no drive here."""
    return F.when(path.isNotNull(), F.lit("")), path


def normalize_case(path: Column) -> Column:
    return path


def normalize_path(path: Column) -> Column:
    """Without empty and "." parts, each ".." with the part before it; an empty path is "."."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    step = lambda a, p: (
        F.when((p == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
        .when((p == "..") & absolute, a)
        .otherwise(F.array_append(a, p))
    )
    kept = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), kept)).otherwise(F.when(kept == "", F.lit(".")).otherwise(kept))


def relative_path(path: Column, start: Column) -> Column:
    """From ``start`` to ``path``, both absolute."""
    split = lambda c: F.filter(F.split(normalize_path(c), "/"), lambda p: p != "")
    a, b = split(path), split(start)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])
    up = F.transform(F.slice(b, same + 1, F.size(b)), lambda p: F.lit(".."))
    out = F.array_join(F.concat(up, F.slice(a, same + 1, F.size(a))), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def common_prefix(paths: DataFrame, path: str) -> DataFrame:
    """The longest common beginning of all paths: that of the least and the greatest one."""
    ends = paths.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    n = F.length(F.regexp_extract(F.concat("a", F.lit("\x00"), "b"), r"^(.*).*\x00\1", 1))
    return ends.select(F.substr("a", F.lit(1), n).alias("prefix"))


def common_path(paths: DataFrame, path: str) -> DataFrame:
    """The longest common folder of all paths."""
    whole = common_prefix(paths.select(F.concat(F.rtrim(F.col(path), F.lit("/")), F.lit("/")).alias("p")), "p")
    return whole.select(F.regexp_replace(F.regexp_extract("prefix", r"^(.*/)?", 1), r"(?<=.)/$", "").alias("folder"))
