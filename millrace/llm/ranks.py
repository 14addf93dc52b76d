"""Row numbers along a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with a column name: 0, 1, 2... along keys, which tell all rows apart.

    Rows are dealt into ranges of the keys, sorted in each, and numbered there; the counts of the ranges, one number for
    each, give where a range begins. The sorted rows are written to the shared folder once, so that both looks at them see
    the same ranges."""
    at = f"_at_{name}"
    spread = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33).alias("_part")
    counts = sorted((r["_part"], r["n"]) for r in spread.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, upto = [], 0
    for p, n in counts:
        starts.append((p, upto))
        upto += n
    if not starts:
        return spread.withColumn(name, F.col(at)).drop(at)
    begins = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _from long"))
    return spread.withColumn("_part", F.shiftright(at, 33)).join(begins, "_part").withColumn(name, F.col("_from") + F.expr(f"{at} & {(1 << 33) - 1}")).drop("_part", "_from", at)
