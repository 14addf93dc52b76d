"""Names of free text to entities, by tiers: of every query the first tier that finds something counts. Tiers are joins by
equality (of ids, whole names, first words, ingredients, words); what they leave goes on to the next one, so the dear ones
at the end see few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import canonical_id, normalized_name
from millrace.operators.closeness import close_names
from millrace.sources.scratch import stored

#: Least similarity of ingredients and of names, and the most that are taken of each.
INGREDIENT_RATIO, INGREDIENTS, NAME_RATIO, NAMES = 0.82, 3, 0.80, 5
GRAM = 2
MOST_PROFILES = 100_000


def first_tier(queries: DataFrame, tiers: list, key: str = "q", keep=lambda d: d) -> DataFrame:
    """key, entity, tier: tiers are functions from the queries still open to (key, entity). A tier that finds something for
    a query closes it. keep: what is done with the rows of a tier, such as writing them, so that later tiers don't find them
    again."""
    found = []
    for number, tier in enumerate(tiers, 1):
        hits = keep(tier(queries).distinct().withColumn("tier", F.lit(number)))
        found.append(hits)
        queries = queries.join(hits.select(key).distinct(), key, "left_anti")
    return reduce(DataFrame.unionByName, found)


def grams(c: Column) -> Column:
    """The distinct pairs of letters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(GRAM))))


def registry(documents: DataFrame, name: str = "name", ingredient: str = "ingredient", file: str = "file", unknown: str = "Bilinmeyen İlaç") -> DataFrame:
    """entity (canonical id), name, slug, ingredient: of documents with a known name the first file of each id."""
    d = documents.select(F.trim(name).alias("name"), F.lower(F.trim(F.coalesce(ingredient, F.lit("")))).alias("ingredient"), F.col(file).alias("file"))
    d = d.where((F.col("name") != "") & (F.col("name") != unknown)).withColumn("entity", canonical_id(F.col("name")))
    first = d.groupBy("entity").agg(F.min(F.struct("file", "name", "ingredient")).alias("f"))
    return first.select("entity", "f.name", F.regexp_replace(normalized_name(F.col("f.name")), r"\s+", "_").alias("slug"), "f.ingredient")


def resolved(queries: DataFrame, known: DataFrame) -> DataFrame:
    """q, entity, tier by six tiers: id, whole name, names that begin with the first word, ingredient (whole, a word of it,
    a similar word), similar names, names that contain the first word. queries: q (text); known: what registry gives."""
    known = stored(known)
    q = queries.select("q").where(F.trim("q") != "").distinct().withColumn("slug", F.regexp_replace(normalized_name(F.col("q")), r"\s+", "_")).withColumn("first", F.split_part("slug", F.lit("_"), F.lit(1))).withColumn("inn", F.lower(F.trim("q")))
    slugs = known.select("entity", "slug", F.split_part("slug", F.lit("_"), F.lit(1)).alias("k_first"))
    words = known.select("entity", F.explode(F.filter(F.split("ingredient", r"\s+"), lambda w: F.length(w) >= 5)).alias("word")).distinct()

    def by_prefix(d: DataFrame) -> DataFrame:
        """First words of names that begin with that of the query: by equality of all beginnings of a name's first word."""
        starts = slugs.select("entity", F.explode(F.transform(F.sequence(F.lit(1), F.length("k_first")), lambda n: F.substring("k_first", F.lit(1), n))).alias("first")).distinct()
        return d.where("length(first) > 0").join(starts, "first").select("q", "entity")

    def by_ingredient(d: DataFrame) -> DataFrame:
        whole = d.join(known.where("ingredient != ''").select("entity", F.col("ingredient").alias("inn")), "inn").select("q", "entity")
        word = d.join(words.withColumnRenamed("word", "inn"), "inn").select("q", "entity")
        return first_tier(d, [lambda x: whole.join(x.select("q"), "q", "left_semi"), lambda x: word.join(x.select("q"), "q", "left_semi"), by_similar_word], keep=stored).select("q", "entity")

    def by_similar_word(d: DataFrame) -> DataFrame:
        near = close_names(d.select("q", F.col("inn").alias("text")), words.select(F.col("word").alias("name")), INGREDIENT_RATIO, INGREDIENTS)
        return near.join(words.select(F.col("word").alias("name"), "entity"), "name").select("q", "entity")

    def by_similar_name(d: DataFrame) -> DataFrame:
        near = close_names(d.select("q", F.col("slug").alias("text")), slugs.select(F.col("slug").alias("name")), NAME_RATIO, NAMES)
        return near.join(slugs.select(F.col("slug").alias("name"), "entity"), "name").select("q", "entity")

    return first_tier(
        stored(q),
        [
            lambda d: d.join(known.select(F.col("entity").alias("q"), "entity"), "q").select("q", "entity"),
            lambda d: d.join(slugs.select("entity", "slug"), "slug").select("q", "entity"),
            by_prefix,
            by_ingredient,
            by_similar_name,
            lambda d: _contains(d, slugs),
        ],
        keep=stored,
    )


def _contains(d: DataFrame, slugs: DataFrame) -> DataFrame:
    """Names that contain the first word of the query: joined by three letters that both have, then tested."""
    three = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda k: F.substring(c, k, F.lit(3))))
    asked = d.where("length(first) > 0").select("q", "first", F.substring("first", 1, 3).alias("gram"))
    long_ = asked.where("length(first) >= 3").join(slugs.select("entity", "slug", F.explode(three(F.col("slug"))).alias("gram")), "gram").where(F.col("slug").contains(F.col("first")))
    letters = slugs.select("entity", "slug", F.explode(F.concat(F.array_distinct(F.split("slug", "")), grams(F.col("slug")))).alias("first")).distinct()
    short = asked.where("length(first) < 3").join(letters, "first")
    return long_.select("q", "entity").union(short.select("q", "entity")).distinct()


def one_each(found: DataFrame, known: DataFrame) -> DataFrame:
    """q, entity, tier: of each query the first entity by name."""
    named = found.join(known.select("entity", "name"), "entity")
    return named.groupBy("q").agg(F.min(F.struct("tier", "name", "entity")).alias("f")).select("q", "f.entity", "f.tier")


def same_ingredient(known: DataFrame, ingredient: str) -> DataFrame:
    return known.where(F.col("ingredient") == ingredient.lower().strip())


def canonical_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """q, name, tier of asked (q): the same normalised name; the same but for decimal signs and spaces around hyphens; names
    that begin with the query or contain it; names that have all its words; the query itself."""
    loose = lambda c: F.regexp_replace(F.replace(normalized_name(c), F.lit(","), F.lit(".")), r"\s*-\s*", "-")
    q = asked.select("q").distinct().withColumn("norm", normalized_name(F.col("q"))).withColumn("loose", loose(F.col("q")))
    n = known.select("name").distinct().withColumn("norm", normalized_name(F.col("name"))).withColumn("loose", loose(F.col("name")))

    def by_part(d: DataFrame) -> DataFrame:
        words = n.select("name", F.col("loose").alias("n_loose"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("loose") - 2, F.lit(1))), lambda k: F.substring("loose", k, F.lit(3))))).alias("gram"))
        return d.select("q", "loose", F.substring("loose", 1, 3).alias("gram")).join(words, "gram").where(F.col("n_loose").contains(F.col("loose"))).select("q", F.col("name").alias("entity"))

    def by_words(d: DataFrame) -> DataFrame:
        has = n.select("name", F.explode(F.array_distinct(F.split("loose", " "))).alias("w"))
        ask = d.select("q", F.array_distinct(F.split("loose", " ")).alias("ws")).select("q", F.size("ws").alias("k"), F.explode("ws").alias("w")).where("w != ''")
        return ask.join(has, "w").groupBy("q", "k", "name").agg(F.count(F.lit(1)).alias("c")).where("c = k").select("q", F.col("name").alias("entity"))

    tiers = [
        lambda d: d.join(n.select("norm", F.col("name").alias("entity")), "norm").select("q", "entity"),
        lambda d: d.join(n.select("loose", F.col("name").alias("entity")), "loose").select("q", "entity"),
        by_part,
        by_words,
        lambda d: d.select("q", F.col("q").alias("entity")),
    ]
    return first_tier(q, tiers).withColumnRenamed("entity", "name")


def similar_names(queries: DataFrame, known: DataFrame) -> DataFrame:
    """q, entity (name), tier: a profile's name by equality, by one containing the other, or by an equal first word. The
    table of known profiles is broadcast if it has at most MOST_PROFILES rows; a larger one is refused."""
    q = queries.select("q", F.lower(F.trim("q")).alias("low")).distinct()
    if known.count() > MOST_PROFILES:
        raise ValueError("too many profiles to compare each query with")
    n = F.broadcast(known.select(F.col("name").alias("entity"), F.lower("name").alias("k")))
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return first_tier(
        q,
        [
            lambda d: d.join(n, F.col("low") == F.col("k")).select("q", "entity"),
            lambda d: d.join(n, F.col("low").contains(F.col("k")) | F.col("k").contains(F.col("low"))).select("q", "entity"),
            lambda d: d.join(n, word(F.col("low")) == word(F.col("k"))).select("q", "entity"),
        ],
    )
