"""Mixing sources to target weights by entropy balancing.

Every document starts with a rate of one copy. Of all rates that give each source its target of words, those nearest to one
copy in relative entropy are exponentials in the document's size, exp(lambda * size), cut off at the most copies allowed; the
lambda of a source is where the convex dual's gradient is zero, the words that the rates give less the target. Newton steps
for all sources at once find it: a step is a sum over cells (source, size, number of documents), which are as many as there
are different sizes, not documents. Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_name, numbered
from millrace.llm.ranks import in_order

WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
#: Most sources, or cells, that are broadcast; more are joined by a shuffle.
FEW = 200_000
#: A source's lambda is found when its words are so near to the target; what is left is made up for in rounding.
NEAR, ROUNDS = 1e-7, 100
EXACT = "decimal(38,6)"  # sums of these don't depend on the order of their terms, so reruns agree


def _with(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    return left.join(F.broadcast(right) if rows <= FEW else right.hint("merge"), on)


def targets(per: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """per (source, source_size, n) with target: percent of all words shared by weight, weights dealt to the sources in
    order and again from the first; a source stops at most times its size, and its excess goes to the others by weight,
    until none is above: each gets the smaller of its limit and level * weight, and the level rises until it fits."""
    per = cut(in_order(per, [F.col("source").asc()], "no").withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights)).cast("int"))))
    most_ = F.col("source_size") * most
    share = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]) * percent / 100
    level, held = share / max(per.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"], 1e-300), -1
    while True:
        over = F.col("weight") * level > most_
        got = per.agg(F.coalesce(F.sum(F.when(over, most_)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(over).alias("n")).first()
        if got["n"] == held or not got["open"]:
            break
        held, level = got["n"], (share - got["full"]) / got["open"]
    return per.select("source", "source_size", "n", F.least(most_.cast("double"), F.col("weight") * level).alias("target"))


def tilts(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources with lam and mean: the rate of a document is least(most, exp(lam * size / mean)).

    A Newton step is taken on the logarithm of the words that the rates give, which is nearly straight in lam; bounds on
    lam, from the signs seen so far, catch a step that goes too far. cells: source, size, n."""
    count = sources.count()
    sources = sources.withColumn("mean", F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)))
    full, none = F.col("target") >= F.col("source_size") * most, F.col("target") <= 0
    wide = 1000 * (F.col("mean") + 1)  # at this lam, rates are most or 0 for any size
    fixed = sources.where(full | none).withColumn("lam", F.when(none, -wide).otherwise(wide))
    state = cut(sources.where(~full & ~none).select("*", F.log(F.col("target") / F.col("source_size")).alias("lam"), (-wide).alias("lo"), wide.alias("hi"), F.lit(False).alias("found")))
    known = ["source_size", "n", "target", "mean", "lam", "lo", "hi"]
    for _ in range(ROUNDS):
        open_ = state.where("not found")
        if open_.isEmpty():
            break
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.col("lam") * z)
        words = F.col("cell_n") * F.col("size")
        at = _with(cells.withColumnRenamed("n", "cell_n"), open_, ["source"], count)
        sums = at.groupBy("source").agg(*[F.min(c).alias(c) for c in known], F.sum((words * F.least(raw, F.lit(float(most)))).cast(EXACT)).cast("double").alias("f"), F.coalesce(F.sum(F.when(raw < most, words * z * raw).cast(EXACT)), F.lit(0)).cast("double").alias("slope"))
        low = F.col("f") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        step = F.col("lam") - F.log(F.greatest("f", F.lit(1e-6)) / F.col("target")) * F.col("f") / F.greatest("slope", F.lit(1e-9))
        found = F.abs(F.col("f") - F.col("target")) <= F.greatest(F.col("target") * NEAR, F.lit(1e-3))
        stuck = hi - lo <= 1e-12 * wide
        sums = sums.select("source", "source_size", "n", "target", "mean", F.when(found, F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2).alias("lam"), lo.alias("lo"), hi.alias("hi"), (found | stuck).alias("found"))
        state = cut(state.where("found").unionByName(sums))
    return fixed.unionByName(state.drop("lo", "hi", "found"))


def copies(cells: DataFrame, tilted: DataFrame, most: int = MOST) -> DataFrame:
    """source, size, whole, extra, rate: documents of a cell have whole copies each, and extra of them one more.

    A source's cells are rounded from the largest size down, and what rounding gives or takes goes on to the next smaller
    size; so the words miss the target by less than half of the smallest sizes that still have room. A group here has a row
    for each different size in a source, bounded by the longest text, not by the number of documents."""

    def rounded(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("size", ascending=False)
        lam, mean, target = float(cell["lam"].iloc[0]), float(cell["mean"].iloc[0]), float(cell["target"].iloc[0])
        rate = [min(float(most), math.exp(min(lam * s / mean, 50.0))) for s in cell["size"]]
        carry = target - math.fsum(r * s * n for r, s, n in zip(rate, cell["size"], cell["n"]))
        whole, extra = [], []
        for r, size, n in zip(rate, cell["size"].tolist(), cell["n"].tolist()):
            took = 0
            if size:
                want = carry / size + r * n
                took = min(max(math.floor(want + 0.5), 0), most * n)
                carry = (want - took) * size
            whole.append(took // n)
            extra.append(took % n)
        return pd.DataFrame({"source": cell["source"], "size": cell["size"], "whole": whole, "extra": extra, "rate": rate})

    at = _with(cells, tilted.select("source", "target", "lam", "mean"), ["source"], tilted.count())
    return at.groupBy("source").applyInPandas(rounded, "source string, size long, whole long, extra long, rate double")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, size (words between ASCII white space), source_size, target (its source's), taken
    (copies * size), copies, rate (before rounding).

    Sources are in order of their code points; a null source is one of its own, behind all others. Null and empty texts have
    no words; a source without words has target 0. Of the documents of one source and size those with the smallest hash of
    the id get the additional copy, ties by id (null last) and row; so reruns agree, and repeated ids are rows like others.
    An empty table gives an empty result. Other columns, whatever their names, aren't read. No text has more than most
    copies. One very large document may be all of a source: then its words are a multiple of it, and the target is missed.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    return _planned(rows, weights, percent, most).drop("row").withColumnRenamed("id", id_col)


def _planned(rows: DataFrame, weights: tuple, percent: int, most: int) -> DataFrame:
    """What mixed gives, and row; rows: id, source, text, row."""
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = cut(rows.select("id", source.alias("source"), size.alias("size"), "row"))
    cells = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = cut(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")), weights, percent, most))
    plan = copies(cells, cut(tilts(cells, sources, most)), most)
    order = [F.col("source").asc(), F.col("size").asc(), F.xxhash64("id").asc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    ordered = in_order(sized, order, "nth")
    first = ordered.groupBy("source", "size").agg(F.min("nth").alias("first"))
    plan = cut(_with(plan.join(first, ["source", "size"]), sources.select("source", "source_size", "target"), ["source"], sources.count()))
    out = _with(ordered, plan, ["source", "size"], plan.count())
    n = F.col("whole") + F.when(F.col("nth") - F.col("first") < F.col("extra"), 1).otherwise(0)
    return out.select("id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "rate", "row")


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: the rows of docs, with all their columns, as often as mixed says. Rows are told apart by number."""
    row, on, often = (free_name(docs, c) for c in ("row_number", "mixed_row", "mixed_copies"))
    docs = numbered(docs, row)
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), docs[text_col].alias("text"), F.col(row).alias("row"))
    plan = _planned(rows, weights, percent, most).where("copies > 0").select(F.col("row").alias(on), F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(often))
    return docs.join(plan, F.col(row) == F.col(on)).withColumn(often, F.explode(often)).drop(row, on, often)


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
