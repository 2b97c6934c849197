"""Sums of doubles that don't depend on the order of the rows.

Each value is cut into whole numbers at a scale of its own magnitude (steps of 16 binary digits), which are
added as decimals: exact, whatever partial sums tasks make.  A group has at most 131 scales, whose totals are
added as big integers and rounded once, to the nearest double.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Binary digits of a step between scales; digits kept in the upper and the lower part.
STEP, UPPER, LOWER = 16, 20, 33


@F.pandas_udf(DoubleType())
def _rounded(scales: pd.Series) -> pd.Series:
    """The double next to the sum of all (scale, hi, lo)."""

    def one(parts) -> float:  # noqa: ANN001
        least = min((p["scale"] for p in parts), default=0)
        total = sum((int(p["hi"]) * 2**LOWER + int(p["lo"])) << (STEP * (p["scale"] - least)) for p in parts)
        digits = STEP * least - UPPER - LOWER
        try:
            return float(total << digits) if digits >= 0 else total / (1 << -digits)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return scales.map(one)


def sums(rows: DataFrame, part: list[str], **values: Column) -> DataFrame:
    """One row for each group: of every value the sum, rounded once; nulls add nothing, no values give 0.

    Values that aren't finite add up as doubles do, which no order changes.
    """
    n = len(values)
    one = rows.select(*part, F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), v.cast("double").alias("_x")) for i, v in enumerate(values.values())))).alias("_v")).select(*part, "_v.*")
    x = F.col("_x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    scale = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / STEP)).cast("int")
    half = F.pow(F.lit(2.0), F.col("_s") * (-STEP // 2))  # applied twice: no power of two leaves the range of doubles
    y = x * half * half * float(2**UPPER)
    hi = F.floor(y)
    lo = (y - hi.cast("double")) * float(2**LOWER)
    cut = one.withColumn("_s", scale).withColumns({"_hi": F.when(F.col("_s").isNotNull(), hi.cast("decimal(20,0)")), "_lo": F.when(F.col("_s").isNotNull(), lo.cast("long").cast("decimal(20,0)")), "_odd": F.when(x.isNotNull() & ~finite, x)})
    per = cut.groupBy(*part, "_i", "_s").agg(F.sum("_hi").alias("hi"), F.sum("_lo").alias("lo"), F.sum("_odd").alias("odd"))
    scales = F.collect_list(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("scale"), F.col("hi").cast("string").alias("hi"), F.col("lo").cast("string").alias("lo"))))
    total = per.groupBy(*part, "_i").agg(scales.alias("p"), F.sum("odd").alias("odd")).withColumn("t", F.coalesce("odd", _rounded("p")))
    pick = lambda i: F.coalesce(F.max(F.when(F.col("_i") == i, F.col("t"))), F.lit(0.0))
    return total.groupBy(*part).agg(*(pick(i).alias(name) for i, name in zip(range(n), values, strict=True)))
