"""Order statistics by rank: counts narrow a range until few values are left; no value is buffered.

A round takes a sketch of the values between the bounds of each group, of fixed size, reads off
two bounds around the rank, and counts exactly what lies below and between them.  A round leaves
about one value in sixty, so a trillion values need five; the last few thousand are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.operators.topk import cut_lineage

#: Values of a group that are sorted in the end; cells of a sketch and its precision.
FEW, CELLS, PRECISION = 4096, 256, 4096


def order_statistic(
    rows: DataFrame, groups: list[str], value: str, rank: Callable[[Column], Column], name: str = "value", few: int = FEW,
) -> DataFrame:
    """(groups..., ``name``, n): the value at the 1-based ``rank(n)`` in ascending order of each group's ``n`` values.

    Nulls are not counted; a group without values has no row; NaN is the largest value.
    """
    by = [f"_g{i}" for i in range(len(groups))]
    # Null is a group like any other, so groups are joined by equal-or-null.
    data = rows.where(F.col(value).isNotNull()).select(*[F.col(g).alias(b) for g, b in zip(groups, by)], F.col(value).cast("double").alias("_v"))
    state = data.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = cut_lineage(state.withColumn("all", F.col("n")).withColumn("r", rank(F.col("n")).cast("bigint")))

    def inside(open_: DataFrame) -> DataFrame:
        """Values between the bounds of their group, with the group's state."""
        named = open_.withColumnsRenamed({b: f"s{b}" for b in by})
        met = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
        for b in by:
            met = met & F.col(b).eqNullSafe(F.col(f"s{b}"))
        return data.join(named, met).drop(*[f"s{b}" for b in by])

    grid = [i / CELLS for i in range(CELLS + 1)]
    while (state.where("lo < hi").agg(F.max("n").alias("n")).collect()[0].n or 0) > few:
        open_ = state.where(f"lo < hi AND n > {few}")
        cuts = inside(open_).groupBy(*by, "lo", "hi", "r", "n", "all").agg(F.percentile_approx("_v", grid, PRECISION).alias("cuts"))
        at = F.floor(F.col("r") * CELLS / F.col("n")).cast("int")
        cuts = cuts.withColumn("to", F.when(at < 2, F.col("lo")).otherwise(F.get("cuts", at - 2)))
        cuts = cut_lineage(cuts.withColumn("up", F.when(at + 2 > CELLS, F.col("hi")).otherwise(F.get("cuts", at + 2))).drop("cuts"))
        below, held = F.count_if(F.col("_v") < F.col("to")), F.count_if((F.col("_v") >= F.col("to")) & (F.col("_v") <= F.col("up")))
        counted = inside(cuts).groupBy(*by, "r", "all", "to", "up").agg(below.alias("below"), held.alias("n"))
        narrowed = cut_lineage(counted.select(*by, "n", F.col("to").alias("lo"), F.col("up").alias("hi"), "all", (F.col("r") - F.col("below")).alias("r")))
        if not narrowed.where("r < 1 OR r > n").isEmpty():
            raise ArithmeticError("a sketch missed a rank by more than its precision")
        state = cut_lineage(state.where(f"lo >= hi OR n <= {few}").unionByName(narrowed))
    done = state.where("lo >= hi").select(*by, F.col("lo").alias("_v"), "all")
    last = inside(state.where("lo < hi"))
    order = Window.partitionBy(*by).orderBy("_v") if by else Window.partitionBy(F.lit(0)).orderBy("_v")
    picked = last.withColumn("at", F.row_number().over(order)).where(F.col("at") == F.col("r")).select(*by, "_v", "all")
    return done.unionByName(picked).select(
        *[F.col(b).alias(g) for b, g in zip(by, groups)], F.col("_v").alias(name), F.col("all").alias("n"))
