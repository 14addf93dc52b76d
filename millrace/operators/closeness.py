"""Close names by matching blocks: the longest common block, then those to its left and right, and so on; the ratio is twice
the letters in blocks by the letters of both names.

Candidates meet by equality of pieces. With a ratio of t, names of n and m letters have at least t (n + m) / 2 letters in
blocks; blocks are parted by letters outside of them, so that they share at least (1.5 t - 1)(n + m) - 1 pairs of letters.
All but so few pairs of the asked name are therefore enough to meet every close name, and the rarest ones are taken; very
short names meet by letters. Letter counts rule most candidates out; the rest get their blocks, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import stored

FEW = 200_000


def _block(a: Column, b: Column) -> Column:
    """(size, place in a, place in b) of the longest common block; the first in a, then in b; size 0 without one."""
    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    sizes = F.sequence(F.least(F.length(a), F.length(b)), F.lit(1), F.lit(-1))

    def of_size(size: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.length(a) - size + 1), lambda i: F.struct(size.alias("size"), i.alias("i"), F.call_function("locate", F.substring(a, i, size), b).alias("j")))
        return F.coalesce(F.get(F.filter(at, lambda x: x["j"] > 0), F.lit(0)), none)

    return F.aggregate(sizes, none, lambda acc, size: F.when(acc["size"] > 0, acc).otherwise(of_size(size)))


def matched(a: Column, b: Column) -> Column:
    """Letters in matching blocks of a and b."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    start = F.struct(F.lit(0).alias("n"), F.array(pair(a, b)).alias("todo"))

    def step(acc: Column, _: Column) -> Column:
        last = F.element_at(acc["todo"], -1)
        rest = F.slice(acc["todo"], 1, F.size(acc["todo"]) - 1)

        def split(m: Column) -> Column:
            end = lambda s, k: F.substring(s, k + m["size"], F.length(s))
            parts = F.array(pair(F.substring(last["a"], F.lit(1), m["i"] - 1), F.substring(last["b"], F.lit(1), m["j"] - 1)), pair(end(last["a"], m["i"]), end(last["b"], m["j"])))
            open_ = F.filter(parts, lambda p: (p["a"] != "") & (p["b"] != ""))
            return F.struct((acc["n"] + m["size"]).alias("n"), F.when(m["size"] > 0, F.concat(rest, open_)).otherwise(rest).alias("todo"))

        # a fold over one block gives it a name, so that it is looked for once
        found = F.element_at(F.transform(F.array(_block(last["a"], last["b"])), split), 1)
        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(found)

    both = (a != "") & (b != "")
    return F.when(both, F.aggregate(F.sequence(F.lit(1), F.length(a) + F.length(b) + 1), start, step)["n"]).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * matched(a, b) / total).otherwise(1.0)


def _tokens(c: Column, size: int) -> Column:
    """All pieces of size letters, repeats counted: (piece, how many before)."""
    p = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, 1, i), lambda y: y == x)).cast("string")))


def close_names(queries: DataFrame, names: DataFrame, least: float, most: int) -> DataFrame:
    """q, name, ratio: of each query (q, text) the most names (name) with a ratio of at least `least`, best first; of equal
    ratios the later name. The blocks are those of the name against the text, in this order, which matters where several
    blocks are equally long. Null and empty texts and names match nothing. Names with the text's letters are few for any
    text, whatever the number of names; a very frequent piece is only met where a text has no rarer one."""
    q = stored(queries.select("q", "text").where("length(text) > 0").distinct().withColumn("n", F.length("text")))
    n = stored(names.select("name").where("length(name) > 0").distinct().withColumn("m", F.length("name")))
    shared = F.ceil((1.5 * least - 1) * F.col("n") * 2 / (2 - least) - 1 - 1e-9)  # pairs that a close name has at least
    letters = F.ceil(least * F.col("n") / (2 - least) - 1e-9)
    met = None
    for size, some, need in ((2, q.where(shared >= 1), shared), (1, q.where(shared < 1), letters)):
        index = stored(n.select("name", "m", F.explode(_tokens(F.col("name"), size)).alias("piece")))
        often = index.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
        own = some.withColumn("need", need).select("q", "text", "n", "need", F.explode(_tokens(F.col("text"), size)).alias("piece"))
        by_text = own.join(often, "piece", "left").groupBy("q", "text", "n", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece"))).alias("pieces"))
        rare = by_text.select("q", "text", "n", F.explode(F.slice("pieces", 1, F.greatest(F.size("pieces") - F.col("need") + 1, F.lit(1)).cast("int"))).alias("p"))
        rare = rare.select("q", "text", "n", F.col("p.piece").alias("piece"))
        rare = F.broadcast(rare) if q.count() <= FEW // 20 else rare.hint("merge")
        pairs = index.join(rare, "piece").where((2 * F.least("n", "m")) >= (least - 1e-9) * (F.col("n") + F.col("m"))).select("q", "text", "name").distinct()
        met = pairs if met is None else met.unionByName(pairs)
    bag = F.size(F.array_intersect(_tokens(F.col("text"), 1), _tokens(F.col("name"), 1)))
    total = F.length("text") + F.length("name")
    near = met.where(2.0 * bag / total >= least).withColumn("ratio", ratio(F.col("name"), F.col("text"))).where(F.col("ratio") >= least)
    best = near.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ratio", "name")))), 1, most).alias("best"))
    return best.select("q", F.explode("best").alias("b")).select("q", "b.name", "b.ratio")
