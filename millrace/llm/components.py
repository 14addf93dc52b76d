"""Connected components of links, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component), for the nodes of links (a, b: bigint).

    Every round takes the smallest label among neighbours, then the label of that label, so that long chains shorten to
    half or less. A node of very many links is pre-aggregated, and its join is a skewed join that AQE splits."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = cut(new.join(of.hint("merge"), "comp").select("node", "old", F.least("comp", "up").alias("comp")))
        label = new.select("node", "comp")
        if new.where("old != comp").isEmpty():
            return label
