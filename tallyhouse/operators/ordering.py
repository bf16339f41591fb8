"""Places of rows within groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group is cut into, at most.
RANGES = 128


def _range_of(value: Column, bounds: list) -> Column:
    """Number of the bounds below a value, by halving; a null is before all."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= F.lit(bounds[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return F.when(value.isNull(), -1).otherwise(pick(0, len(bounds)))


def placed(rows: DataFrame, keys: list[str], by: str, *ties: str, place: str = "place", ranges: int = RANGES) -> DataFrame:
    """``rows`` with the place of each in its group, from 0, by ``by`` (nulls first), then ``ties``.

    All rows are cut into ranges at quantiles of ``by``, so no task orders more of a group than one range of it.  Rows of
    a group are numbered inside their range; what lies before the range comes from counts, one for each group and range.
    The quantiles are at most ``ranges`` numbers that the driver reads first.
    """
    if not keys:
        raise ValueError("a group needs a key")
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx(by, shares, 20 * ranges)).first()[0] or []))
    cut = rows.withColumn("_range", _range_of(F.col(by), bounds))
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.asc_nulls_first(by), *ties)) - 1
    numbered = cut.withColumn("_inside", inside).join(starts, [*keys, "_range"])
    return numbered.withColumn(place, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")
