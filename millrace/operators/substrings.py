"""Substring joins: which texts contain which needles, by an index of short pieces instead of a product.

A needle is looked up by the one of its three-letter pieces that the fewest texts have; only texts with that piece are
tested for the whole needle. Both sides meet by equality of pieces, so neither is held as a list or compared with all of
the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.resolve import first_tier
from millrace.sources.scratch import spread, stored

GRAM = 3
#: Most needles that are broadcast.
FEW = 100_000


def pieces(text: Column, size: int) -> Column:
    """The distinct pieces of size letters; none of shorter texts. One pass of a matcher that looks ahead from every place: a
    substring from place k would walk through k letters each time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def contains_join(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """text_id, needle: the distinct pairs where the text contains the needle. texts: text_id (distinct), text; needles:
    needle. Null and empty needles and null texts match nothing; capitals matter.

    Needles of one or two letters are pieces themselves. If there are few needles, they are broadcast and a text is tested
    where it lies; else pieces are joined by a shuffle, in which a frequent piece is only the key of needles that have no
    rarer one, and texts are joined to the pairs that are left."""
    needles = stored(needles.select("needle").where("length(needle) > 0").distinct())
    short, sizes = needles.where(F.length("needle") < GRAM), [r["n"] for r in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect()]
    texts = spread(texts.select("text_id", "text").where("text is not null"))
    few = needles.count() <= FEW
    grams = F.concat(*[pieces(F.col("text"), n) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    wanted = needles.where(F.length("needle") >= GRAM).select("needle", F.explode(pieces(F.col("needle"), GRAM)).alias("gram"))
    kinds = wanted.select("gram").distinct()
    kinds = F.broadcast(kinds) if few else kinds
    in_texts = texts.select("text_id", F.explode(grams).alias("gram"))
    often = in_texts.join(kinds, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("needle", "r.gram")
    keys = rarest.unionByName(short.select("needle", F.col("needle").alias("gram")))
    if few:
        found = texts.select("text_id", "text", F.explode(grams).alias("gram")).join(F.broadcast(keys), "gram").where(F.col("text").contains(F.col("needle")))
        return found.select("text_id", "needle")
    found = in_texts.join(keys.hint("merge"), "gram").select("text_id", "needle")
    return found.join(texts.hint("merge"), "text_id").where(F.col("text").contains(F.col("needle"))).select("text_id", "needle")


def first_tokens(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """text_id, entity, token: the texts (text_id, text) that contain a token of an entity (entity, tokens: array); the first
    of its tokens that they contain."""
    tokens = entities.select("entity", F.posexplode("tokens").alias("at", "needle"))
    found = contains_join(texts, tokens).join(tokens, "needle")
    return found.groupBy("text_id", "entity").agg(F.min(F.struct("at", "needle")).alias("f")).select("text_id", "entity", F.col("f.needle").alias("token"))


# --- Fixed values: lengths from which mentions are looked for -----------------------------------------------------------
LEAST_MENTION, LEAST_INSIDE, STEM = 4, 6, 6
# --- End of fixed values ---------------------------------------------------------------------------------------------


def mention_nodes(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """mention, exclude, name, tier of mentions (mention, exclude: a name that can't be meant, or null), by the first of four
    tiers: the name itself; a name that begins with the mention; from six letters on, a name with the mention in it or with
    its first six letters; a name whose ingredient or that itself contains it. known: name, ingredient. Capitals don't
    matter; of several names the first one counts. The excluded name, if it is the mention itself, closes it without one."""
    m = stored(mentions.select("mention", "exclude").distinct().withColumn("low", F.lower(F.trim("mention"))).where(F.length("low") >= LEAST_MENTION).withColumn("q", F.struct("mention", "exclude")))
    n = known.select("name", F.lower("name").alias("key"), F.lower(F.coalesce("ingredient", F.lit(""))).alias("inside")).distinct()
    n = stored(n)
    other = (F.col("exclude").isNull()) | (F.col("name") != F.col("exclude"))
    starts = n.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda k: F.substring("key", F.lit(1), k))).alias("low"))
    stems = n.select("name", F.substring("key", 1, STEM).alias("stem")).where(F.length("stem") == STEM)

    def inside(d: DataFrame, column: str) -> DataFrame:
        found = contains_join(n.select(F.col(column).alias("text_id"), F.col(column).alias("text")).distinct(), d.select(F.col("low").alias("needle")))
        return d.join(found.withColumnRenamed("needle", "low"), "low").join(n.withColumnRenamed(column, "text_id").select("text_id", "name"), "text_id").where(other)

    def by_part(d: DataFrame) -> DataFrame:
        d = d.where(F.length("low") >= LEAST_INSIDE)
        stem = d.withColumn("stem", F.substring("low", 1, STEM)).join(stems, "stem").where(other)
        return inside(d, "key").select("q", "name").unionByName(stem.select("q", "name"))

    first = lambda d: d.groupBy("q").agg(F.min("name").alias("entity"))
    tiers = [
        lambda d: first(d.join(n.withColumnRenamed("key", "low"), "low")),
        lambda d: first(d.where(F.length("low") > 0).join(starts, "low").where(other)),
        lambda d: first(by_part(d)),
        lambda d: first(inside(d, "inside").select("q", "name").unionByName(inside(d, "key").select("q", "name"))),
    ]
    found = first_tier(m, tiers, keep=stored).select(F.col("q.mention").alias("mention"), F.col("q.exclude").alias("exclude"), F.col("entity").alias("name"), "tier")
    return found.where(F.col("exclude").isNull() | (F.col("name") != F.col("exclude")))
