"""Variants of a node merged into its canonical one, through chains of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import stored

FEW = 1_000_000


def closed(mapping: DataFrame) -> DataFrame:
    """variant, canonical: where each variant's chain ends. mapping: variant, canonical; of a variant with several the
    smallest counts, and one to itself is none. Every round doubles the way that a row has gone, so a chain of n links takes
    log n rounds. Variants that come to a circle have no end and are left out: nothing is merged for them."""
    to = mapping.where("variant != canonical").groupBy("variant").agg(F.min("canonical").alias("canonical"))
    to = stored(to)
    far, steps, n = to, 1, to.count()
    while True:
        nxt = far.select(F.col("variant").alias("canonical"), F.col("canonical").alias("next"))
        far = stored(far.join(nxt.hint("merge"), "canonical", "left").select("variant", F.coalesce("next", "canonical").alias("canonical"), F.col("next").isNotNull().alias("moved")))
        steps *= 2
        if far.where("moved").isEmpty():
            return far.select("variant", "canonical")
        if steps > n:  # longer than any chain: what still moves goes round
            return far.join(to.select(F.col("variant").alias("canonical")).hint("merge"), "canonical", "left_anti").select("variant", "canonical")
        far = far.select("variant", "canonical")


def merged(edges: DataFrame, mapping: DataFrame, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """edges with both ends at their canonical nodes, each once; those that have become loops are gone, and
    so are those without an end. The mapping is
    broadcast if it has at most FEW rows."""
    ways = closed(mapping)
    few, columns = ways.count() <= FEW, edges.columns
    for end in ends:
        own = ways.select(F.col("variant").alias(end), F.col("canonical").alias("_to"))
        edges = edges.join(F.broadcast(own) if few else own.hint("merge"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where(F.col(ends[0]) != F.col(ends[1])).select(columns).distinct()
