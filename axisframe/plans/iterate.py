"""Driver loops over DataFrames: fixed numbers of steps, conjugate gradients, and BiCGStab for nonsymmetric systems."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.operators.linalg import matvec
from axisframe.operators.scan import key_of
from axisframe.plans.lineage import BROADCAST_ROWS, cut


class NotConverged(RuntimeError):
    """A system that isn't solved within the steps."""


class Diverged(NotConverged):
    """A system whose residual grew beyond bounds, or whose method broke down."""


def iterate(step: Callable[[DataFrame], DataFrame], start: DataFrame, steps: int, cut_every: int = 8) -> DataFrame:
    """Apply ``step`` so often; the lineage is cut by a written table every ``cut_every`` steps."""
    out = start
    for i in range(1, steps + 1):
        out = step(out)
        if i % cut_every == 0 and i < steps:
            out = cut(out, "iterate")
    return out


def conjugate_gradient(matrix: DataFrame, rhs: DataFrame, row: str, col: str, value: str = "value", tolerance: float = 1e-6, max_steps: int = 100) -> DataFrame:
    """Solve A x = y for a symmetric definite coordinate matrix; ``rhs`` is (row, y). Returns (row, x).

    State stays distributed; only scalars (two dot products a step) reach the driver.
    """
    s = cut(rhs.select(F.col(row), F.lit(0.0).alias("x"), F.col("y").alias("r"), F.col("y").alias("p")), "cg")
    rr = s.agg(F.sum(F.col("r") ** 2)).first()[0] or 0.0
    stop = tolerance**2 * max(rr, 1e-300)
    for _ in range(max_steps):
        if rr <= stop:
            break
        ap = matvec(matrix, s.select(F.col(row).alias(col), "p"), row, col, value, "p").withColumnRenamed("p", "ap")
        s = cut(s.join(ap, row, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), "cg")
        alpha = rr / s.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        s = s.select(row, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = s.agg(F.sum(F.col("r") ** 2)).first()[0]
        s = s.withColumn("p", F.col("r") + (new / rr) * F.col("p"))
        rr = new
    return s.select(row, "x")


def bicgstab(matrix: DataFrame, rhs: DataFrame, row: str, col: str, value: str = "value", batch: list[str] | None = None, tolerance: float = 1e-8, max_steps: int = 100, jacobi: bool = True) -> DataFrame:
    """Solve A x = y for any square coordinate matrix by BiCGStab (van der Vorst, 1992); returns (batch, row, x).

    ``rhs`` is (batch, row, y); ``matrix`` has the ``batch`` columns for a system of its own in each batch, or not
    for one that all share. Repeated entries add up, rows without a right-hand side count as 0. The
    preconditioner divides by the diagonal where there is one. Each batch has scalars and a residual of its own
    and rests once that is below ``tolerance`` times its right-hand side. Vectors stay distributed; a few sums
    of each batch reach the driver, of at most ``BROADCAST_ROWS`` batches. Raises :class:`NotConverged` after
    ``max_steps``, and :class:`Diverged` when a residual leaves the numbers or grows by 10^8. Null batches are a batch.
    """
    keys = batch or []
    own = all(b in matrix.columns for b in keys) and bool(keys)
    k = key_of(keys)
    entries = matrix.select(*([k.alias("__k")] if own else []), F.col(row).alias("__row"), F.col(col).alias("__col"), F.col(value).cast("double").alias("__a"))
    by = ["__k"] if own else []
    entries = cut(entries.groupBy(*by, "__row", "__col").agg(F.sum("__a").alias("__a")), "bicgstab-matrix")
    diagonal = entries.where((F.col("__row") == F.col("__col")) & (F.col("__a") != 0)).select(*by, "__row", F.col("__a").alias("d"))
    y = rhs.select(k.alias("__k"), F.col(row).alias("__row"), F.col("y").cast("double").alias("y")).groupBy("__k", "__row").agg(F.sum("y").alias("y"))
    # the unknowns are the rows and columns that appear
    named = entries.select(*by, "__row").union(entries.select(*by, "__col")).distinct()
    named = named if own else y.select("__k").distinct().crossJoin(named) if keys else named.withColumn("__k", F.lit(None).cast(y.schema["__k"].dataType) if keys else key_of([]))
    s = named.unionByName(y.select("__k", "__row")).distinct().join(y, ["__k", "__row"], "left")
    s = s.join(diagonal, [*by, "__row"], "left") if jacobi else s.withColumn("d", F.lit(1.0))
    zero, r = F.lit(0.0), F.coalesce("y", F.lit(0.0))
    s = cut(s.select("__k", "__row", F.coalesce("d", F.lit(1.0)).alias("d"), zero.alias("x"), r.alias("r"), r.alias("h"), zero.alias("p"), zero.alias("v")), "bicgstab")

    def times(state: DataFrame, vector: str, name: str) -> DataFrame:
        """The state with A times a vector of it, divided by the diagonal first."""
        moved = state.select("__k", F.col("__row").alias("__col"), (F.col(vector) / F.col("d")).alias("__x"))
        product = entries.join(moved, [*by, "__col"]).groupBy("__k", "__row").agg(F.sum(F.col("__a") * F.col("__x")).alias(name))
        return state.drop(name).join(product, ["__k", "__row"], "left").withColumn(name, F.coalesce(name, zero))

    def sums(state: DataFrame, **products: Column) -> dict:
        rows = state.groupBy("__k").agg(*[F.sum(c).alias(n) for n, c in products.items()]).limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS:
            raise ValueError(f"at most {BROADCAST_ROWS} batches at a time")
        return {r["__k"]: r.asDict() for r in rows}

    def with_scalars(state: DataFrame, scalars: dict, *names: str) -> DataFrame:
        """The state with each batch's numbers as columns; not literals, for which each step would be compiled anew."""
        kind = state.schema["__k"].dataType
        table = state.sparkSession.createDataFrame([(key, *(float(x[n]) for n in names)) for key, x in scalars.items()], f"__k {kind.simpleString()}, " + ", ".join(f"{n} double" for n in names))
        return state.join(F.broadcast(table), "__k")

    at = {key: {**x, "rr": x["rho"], "first": x["rho"], "alpha": 1.0, "omega": 1.0, "old": 1.0, "done": x["rho"] == 0.0} for key, x in sums(s, rho=F.col("h") * F.col("r")).items()}
    for step in range(max_steps + 1):
        for key, x in at.items():
            rr, rho = x["rr"], x["rho"]
            if not x["done"] and (not math.isfinite(rr) or rr > 1e16 * x["first"]):
                raise Diverged(f"the residual of batch {key} grew to {math.sqrt(rr) if rr >= 0 and math.isfinite(rr) else rr} in {step} steps")
            x["done"] = x["done"] or rr <= tolerance**2 * x["first"]
            x["beta"] = 0.0 if x["done"] else (rho / x["old"]) * (x["alpha"] / x["omega"])
            x["go"] = 0.0 if x["done"] else 1.0
            if not x["done"] and rho == 0:
                raise Diverged(f"the method breaks down in batch {key} after {step} steps")
        if all(x["done"] for x in at.values()):
            return s.select(*[F.col(f"__k.{b}").alias(b) for b in keys], F.col("__row").alias(row), "x")
        if step == max_steps:
            break
        s = with_scalars(s, at, "beta", "omega", "go").withColumn("p", F.col("go") * (F.col("r") + F.col("beta") * (F.col("p") - F.col("omega") * F.col("v")))).drop("beta", "omega", "go")
        s = cut(times(s, "p", "v"), "bicgstab")
        for key, x in sums(s, hv=F.col("h") * F.col("v")).items():
            if not at[key]["done"] and x["hv"] == 0:
                raise Diverged(f"the method breaks down in batch {key} after {step} steps")
            at[key]["alpha"] = 0.0 if at[key]["done"] else at[key]["rho"] / x["hv"]
        s = with_scalars(s, at, "alpha").withColumn("r", F.col("r") - F.col("alpha") * F.col("v")).withColumn("x", F.col("x") + F.col("alpha") * F.col("p") / F.col("d")).drop("alpha")
        s = cut(times(s, "r", "t"), "bicgstab")
        for key, x in sums(s, **{a + b: F.col(a) * F.col(b) for a, b in ("tr", "tt", "rr", "hr", "ht")}).items():
            now = at[key]
            now["omega"] = w = 0.0 if now["done"] or x["tt"] == 0 else x["tr"] / x["tt"]
            # of the new residual r - w t
            now["old"], now["rho"], now["rr"] = now["rho"], x["hr"] - w * x["ht"], max(0.0, x["rr"] - 2 * w * x["tr"] + w * w * x["tt"])
        s = with_scalars(s, at, "omega").withColumn("x", F.col("x") + F.col("omega") * F.col("r") / F.col("d")).withColumn("r", F.col("r") - F.col("omega") * F.col("t")).drop("omega", "t")
        for x in at.values():
            x["omega"] = x["omega"] or 1e-300  # of an exact half step: the residual is 0 then
    raise NotConverged(f"{sum(not x['done'] for x in at.values())} of {len(at)} systems are open after {max_steps} steps")


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda d, f: f(d), steps, df)
