"""Contractions, sparse matrices as coordinate rows, and least-squares fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from axisframe.operators.scan import key_of
from axisframe.plans.lineage import cut


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot_arrays(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def sum_duplicates(coo: DataFrame, row: str, col: str, value: str = "value") -> DataFrame:
    return coo.groupBy(row, col).agg(F.sum(value).alias(value))


def products(a: DataFrame, b: DataFrame, inner: str) -> int:
    """How many products of entries a multiplication takes: a bound of the result's entries, from two counts for each inner index."""
    n, m = (x.groupBy(inner).agg(F.count("*").alias(c)) for x, c in ((a, "__n"), (b, "__m")))
    return int(n.join(m, inner).agg(F.sum(F.col("__n").cast("decimal(38,0)") * F.col("__m"))).first()[0] or 0)


#: Entries of an inner index that one array holds; ranges of rows and of columns at most, so that their pairs' sizes can be gathered; inner indices that their number is chosen by.
PART_ENTRIES, MOST_RANGES, RANGE_SAMPLE = 1024, 256, 1 << 13


def _range_of(m: DataFrame, count: int) -> Callable[[DataFrame], DataFrame]:
    """Adds the range (b) of the index (i), of about equally many entries; indices that aren't numbers are dealt by hash. No result depends on the bounds."""
    if not isinstance(m.schema["i"].dataType, NumericType):
        return lambda df: df.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(count)).cast("int"))
    place = F.col("i").cast("double")
    bounds = m.where(~F.isnan(place)).agg(F.percentile_approx(place, [n / count for n in range(1, count)], 10 * count)).first()[0] or [0.0]
    from pyspark.ml.feature import Bucketizer

    at = Bucketizer(splits=[float("-inf"), *sorted({x for x in bounds if abs(x) < float("inf")} or {0.0}), float("inf")], inputCol="__x", outputCol="__b", handleInvalid="keep")
    return lambda df: at.transform(df.withColumn("__x", place)).withColumn("b", F.least(F.col("__b"), F.lit(count - 1)).cast("int")).drop("__x", "__b")


def _fewest(sizes: list, fine: int, tasks: int) -> int:
    """The fewest ranges at which no pair of a range of rows and one of columns has more products than a task's even share; or all."""
    x, y, n = (np.array([r[c] for r in sizes], np.float64) for c in range(3))
    for ranges in sorted({min(fine, round(2 ** (i / 2))) for i in range(2 * fine.bit_length())}):
        pair = (x * ranges // fine) * ranges + y * ranges // fine
        if not len(n) or np.bincount(pair.astype(np.int64), n).max() <= n.sum() / tasks:
            return ranges
    return fine


def matmul(a: DataFrame, b: DataFrame, row: str, inner: str, col: str, left: str = "a", right: str = "b", most_products: int | None = None) -> DataFrame:
    """Product of coordinate matrices a(row, inner, left) and b(inner, col, right).

    The entries of an inner index go as arrays to the pairs of a range of rows and one of columns that they meet in,
    and are multiplied and summed there, so that no product is shuffled. An entry is copied to as many pairs as its
    inner index has ranges on the other side; there are as few ranges as give the tasks their shares. Where the
    result is so small that each task's sums are fewer than its entries, entries are dealt by the inner index, and sums
    are shuffled. A frequent inner index is several arrays. With ``most_products`` products are counted first, and more of them raise.
    """
    if most_products is not None and (count := products(a, b, inner)) > most_products:
        raise ValueError(f"{count} products are more than {most_products}")
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = min(MOST_RANGES, 1 << (2 * tasks - 1).bit_length())
    a = cut(a.where(F.col(inner).isNotNull()).select(F.col(inner).alias("k"), F.col(row).alias("i"), F.col(left).alias("v")), "left")
    b = cut(b.where(F.col(inner).isNotNull()).select(F.col(inner).alias("k"), F.col(col).alias("i"), F.col(right).alias("v")), "right")
    a_range, b_range = _range_of(a, fine), _range_of(b, fine)
    size, other = (m.agg(F.count("*").alias("n"), F.approx_count_distinct("k").alias("k"), F.approx_count_distinct("i").alias("i")).first() for m in (a, b))
    few = size.i * other.i * tasks <= size.n + other.n  # a task's sums are fewer than its entries
    share = max(1, size.k // RANGE_SAMPLE)
    held = lambda m, at, x, n: at(m.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0)).groupBy("k", F.col("b").alias(x)).agg(F.count("*").cast("double").alias(n))
    sizes = held(a, a_range, "x", "n").join(held(b, b_range, "y", "m"), "k").groupBy("x", "y").agg(F.sum(F.col("n") * F.col("m")))
    ranges = 1 if few else _fewest(sizes.collect(), fine, tasks)

    def entries(m: DataFrame, at: Callable[[DataFrame], DataFrame], x: str, name: str) -> DataFrame:
        part = F.floor((F.row_number().over(Window.partitionBy("k").orderBy("b", "i")) - 1) / PART_ENTRIES)
        m = at(m).withColumn("b", F.floor(F.col("b") * ranges / fine).cast("int")).withColumn("part", part)
        m = m.groupBy("k", F.col("b").alias(x), "part").agg(F.collect_list(F.struct("i", "v")).alias("e"))
        return m.select("k", x, F.col("e.i").alias(f"{name}i"), F.col("e.v").alias(f"{name}v"))

    met = entries(a, a_range, "x", "l").join(entries(b, b_range, "y", "r"), "k").repartitionByRange(tasks, *(["k"] if few else ["x", "y"])).drop("k")
    made = met.select("x", "y", F.posexplode("li").alias("p", "i"), "lv", "ri", "rv").select("x", "y", "i", F.get("lv", "p").alias("s"), "ri", "rv")
    made = made.select("x", "y", "i", "s", F.posexplode("ri").alias("p", "j"), "rv")
    return made.groupBy(*([] if few else ["x", "y"]), "i", "j").agg(F.sum(F.col("s") * F.get("rv", "p")).alias("value")).select(F.col("i").alias(row), F.col("j").alias(col), "value")


def matvec(a: DataFrame, x: DataFrame, row: str, inner: str, value: str, vec: str) -> DataFrame:
    return a.join(x, inner).groupBy(row).agg(F.sum(F.col(value) * F.col(vec)).alias(vec))


#: Columns that one array of a compressed row spans.
ROW_BLOCK = 1 << 16


def to_csr(coo: DataFrame, row: str, col: str, value: str, width: int = ROW_BLOCK) -> DataFrame:
    """A row's entries in arrays in column order, one for each block of ``width`` columns that has any, so that a full row is no one array."""
    return coo.groupBy(row, F.floor(F.col(col) / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("col"), F.col(value).alias("value")))).alias("entries"))


def from_csr(csr: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return csr.select(row, F.explode("entries").alias("e")).select(row, F.col("e.col").alias(col), F.col("e.value").alias(value))


def fit_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of each group's least-squares line."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def fit_hyperplane(df: DataFrame, keys: list[str], xs: list[str], y: str, weight: str | None = None) -> DataFrame:
    """Weights (an array, in order of ``xs``) and intercept of each group's least-squares plane.

    One aggregation of moments about the group's means, then Gauss elimination on columns. Singular groups get NaN;
    null keys are a key.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [*xs, y]
    df = df.withColumn("__k", key_of(keys))
    grouped = lambda t: t.groupBy("__k")
    means = grouped(df).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"__m{i}") for i, c in enumerate(names)])
    moved = df.join(means, "__k")
    c = [F.col(n) - F.col(f"__m{i}") for i, n in enumerate(names)]
    n = len(xs)
    sums = [F.sum(w * c[i] * c[j]).alias(f"__s{i}_{j}") for i in range(n) for j in range(i, n + 1)]
    a = grouped(moved).agg(*sums, *[F.first(f"__m{i}").alias(f"__m{i}") for i in range(n + 1)])
    at = lambda i, j: F.col(f"__s{min(i, j)}_{max(i, j)}")
    # elimination, a step of columns at a time, so that expressions stay small
    cells = {(i, j): at(i, j) for i in range(n) for j in range(n + 1)}
    a = a.withColumns({f"__a{i}_{j}": v for (i, j), v in cells.items()})
    nan = F.lit(float("nan"))
    for k in range(n):
        pivot = F.col(f"__a{k}_{k}")
        share = {i: F.when(pivot != 0, F.col(f"__a{i}_{k}") / F.when(pivot != 0, pivot)).otherwise(nan) for i in range(n) if i != k}
        a = a.withColumns({f"__f{i}": f for i, f in share.items()})
        a = a.withColumns({f"__a{i}_{j}": F.col(f"__a{i}_{j}") - F.col(f"__f{i}") * F.col(f"__a{k}_{j}") for i in share for j in range(n + 1)})
    weights = [F.when(F.col(f"__a{i}_{i}") != 0, F.col(f"__a{i}_{n}") / F.when(F.col(f"__a{i}_{i}") != 0, F.col(f"__a{i}_{i}"))).otherwise(nan) for i in range(n)]
    a = a.withColumn("weights", F.array(*weights))
    intercept = F.col(f"__m{n}")
    for i in range(n):
        intercept = intercept - F.get("weights", i) * F.col(f"__m{i}")
    return a.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "weights", intercept.alias("intercept"))
