"""A property graph in tables: nodes (id and properties), edges (src, dst, severity, ...), mentions (src, name). Sinks give
the table as it is to be after an upsert or a delete; expansions are joins by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.extraction import ingredient_words
from millrace.sources.scratch import MOST_GROUPS, dealt, groups

UNKNOWN = "unknown"
LEVELS = ("contraindicated", "severe", "moderate", "mild")
MENTION_CHARS, PEERS, PEER_CONFIDENCE, LATE_CONFIDENCE = 100, 50, 0.7, 0.85


def level(severity: Column) -> Column:
    """0 for the worst; others come last."""
    out = F.lit(len(LEVELS))
    for k, name in enumerate(LEVELS):
        out = F.when(severity == name, k).otherwise(out)
    return out


# --- sinks -----------------------------------------------------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame, key: str, on_create: list[str], on_match: list[str]) -> DataFrame:
    """old and new nodes by key: new ones get on_create and on_match, known ones only what of on_match isn't null."""
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in (*on_create, *on_match)])
    both = old.join(n, F.col(key) == F.col("n_key"), "full")
    fresh = F.col(key).isNull()
    rest = [c for c in old.columns if c not in {key, *on_create, *on_match}]
    return both.select(
        F.coalesce(key, "n_key").alias(key),
        *[F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in on_create],
        *[F.coalesce(f"n_{c}", c).alias(c) for c in on_match],
        *rest,
    )


def merged_edges(old: DataFrame, new: DataFrame, latest: bool = False) -> DataFrame:
    """src, dst, severity: a known severity stays; with latest a known one of new takes its place."""
    o = old.select("src", "dst", F.col("severity").alias("o"), F.lit(None).cast("string").alias("n"))
    n = new.select("src", "dst", F.lit(None).cast("string").alias("o"), F.col("severity").alias("n"))
    both = o.unionByName(n)
    both = dealt(both, groups(both), "src", "dst").groupBy("src", "dst").agg(F.max("o").alias("o"), F.max(F.when(F.col("n") != UNKNOWN, F.col("n"))).alias("n"))
    known = F.when(F.col("o") != UNKNOWN, F.col("o"))
    return both.select("src", "dst", F.coalesce(*((F.col("n"), known) if latest else (known, F.col("n"))), F.lit(UNKNOWN)).alias("severity"))


def added_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """src, name: names are cut at 100 characters; each pair once."""
    cut = lambda d: d.select("src", F.substring("name", 1, MENTION_CHARS).alias("name"))
    return cut(old).union(cut(new)).where("name != ''").distinct()


def without(edges: DataFrame, provenance: str | None = None) -> DataFrame:
    """edges without those of a provenance; without any where none is named. The schema stays."""
    return edges.where(F.lit(False)) if provenance is None else edges.where(~F.col("provenance").eqNullSafe(F.lit(provenance)))


def duplicate_keys(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their number; null keys do."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def routed(mentions: DataFrame, entities: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """mentions (src, name, severity) in three: of classes (name), of entities (name, entity) as edges, and the others."""
    of_class = mentions.join(classes.select("name").distinct(), "name", "left_semi")
    rest = mentions.join(classes.select("name").distinct(), "name", "left_anti")
    edges = rest.join(entities.select("name", F.col("entity").alias("dst")), "name").select("src", "dst", "severity")
    return of_class, edges, rest.join(entities.select("name").distinct(), "name", "left_anti")


def repaired(mentions: DataFrame, edges: DataFrame, new_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions left, edges after): mentions (src, name) of an entity that has come later (name, entity) become edges of
    confidence 0.85 and unknown severity, unless the edge is there; what has become an edge is no mention any more."""
    e = new_entities.select(F.lower("name").alias("k"), "entity").distinct()
    hit = mentions.withColumn("k", F.lower("name")).join(e, "k").where("src != entity")
    found = hit.select("src", F.col("entity").alias("dst")).distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    more = found.select("src", "dst", F.lit(UNKNOWN).alias("severity"), F.lit(LATE_CONFIDENCE).alias("confidence"))
    left = mentions.join(e.select("k").distinct(), F.lower(mentions["name"]) == F.col("k"), "left_anti")
    return left, edges.select("src", "dst", "severity", "confidence").unionByName(more)


# --- expansions ------------------------------------------------------------------------------------------------------


def neighbours(edges: DataFrame, sources: DataFrame, most: int = 60) -> DataFrame:
    """src, dst, severity, rank: of each source (src) the worst edges first, then by name; at most most."""
    w = W.partitionBy("src").orderBy(level(F.col("severity")), "dst")
    return edges.join(sources.select("src").distinct(), "src", "left_semi").select("src", "dst", "severity", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def among(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (id)."""
    m = members.select("id").distinct()
    return edges.join(m.select(F.col("id").alias("src")), "src", "left_semi").join(m.select(F.col("id").alias("dst")), "dst", "left_semi")


def of_classes(edges: DataFrame, classes: DataFrame, most: int = 20) -> DataFrame:
    """src, class, severity, rank: edges whose end is a class (id, class), worst first, at most most for a source."""
    w = W.partitionBy("src").orderBy(level(F.col("severity")), "class")
    return edges.join(classes.select(F.col("id").alias("dst"), "class"), "dst").select("src", "class", "severity", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def with_condition(nodes: DataFrame, column: str, condition: str) -> DataFrame:
    """Nodes whose column contains a condition, in any case."""
    return nodes.where(F.lower(column).contains(condition.lower()))


def _dealt_members(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, bool]:
    """(src, g, own; whether a member is in several groups): members (src, group) with the distinct ends of their edges (src,
    dst) as an array (null: none), dealt by group; members without a number are left out. Each edge is sent twice, once by its source and once in an array by the
    group, whose number g is short: that of its first member, or the group itself where members are in several. What reads
    src, g and own reads the same exchange, so ends of groups are made, and met, where their members lie."""
    members = members.where("src is not null")
    several = not members.groupBy("src").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").isEmpty()
    n, least = groups(edges), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = least if n >= MOST_GROUPS else max(n, least)  # rows that are no files have no size
    own = edges.repartition(n, "src").groupBy("src").agg(F.collect_set("dst").alias("own"))
    if several:
        known = members.where("group is not null").select("src", F.col("group").alias("g"))
    else:
        known = members.join(members.groupBy("group").agg(F.min("src").alias("g")), "group").select("src", "g")
    return known.join(own, "src", "left").repartition(n, "g"), several


def _ends(dealt_: DataFrame, own: Column) -> DataFrame:
    """g, dst, peer: the distinct ends of each group, with the first member that has it. Where nothing reads peer the exchange
    would lose src, and be made once more."""
    # outer: a filter of members without ends would be pushed below the exchange, which would be another one then
    return dealt_.select("g", "src", F.explode_outer(own).alias("dst")).where("dst is not null").groupBy("g", "dst").agg(F.min("src").alias("peer"))


def _met(members: DataFrame, several: bool, ends: DataFrame, test: Column, **least: Column) -> DataFrame:
    """src, dst, columns of least: members (src, g, ...) with all ends (g, dst, ...; each once) of their group that pass a
    test. There are as many rows as members times ends, so they are neither sent nor sorted, but for those of members in
    several groups, of which each pair stays once with its least values."""
    if not several:
        return members.join(ends, "g").where(test).select("src", "dst", *[c.alias(n) for n, c in least.items()])
    m = members.withColumn("groups", F.count(F.lit(1)).over(W.partitionBy("src")))
    met = m.join(ends, "g").where(test)
    one = met.where("groups = 1").select("src", "dst", *[c.alias(n) for n, c in least.items()])
    more = met.where("groups > 1").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(n) for n, c in least.items()]).drop("n")
    return one.unionByName(more)


def _lacks() -> Column:
    return ~F.coalesce(F.array_contains("own", F.col("dst")), F.lit(False))


def lacking(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst: for each row of members (src, group) the ends of its group's edges (src, dst) that it hasn't; neither sent
    nor sorted. A null end is none."""
    mine, _ = _dealt_members(edges, members.select("src", "group"))
    return mine.join(_ends(mine, F.col("own")), "g").where(_lacks() & F.col("peer").isNotNull()).select("src", "dst")


def peers(edges: DataFrame, members: DataFrame, most: int = PEERS) -> DataFrame:
    """src, dst, peer, confidence: edges of a group's other members that a member hasn't; at most most from each peer, by
    name. members: id, group. A pair comes from its first peer; a member that is an end's first peer has that end, so for
    all members that lack it the first peer of the group is another one. A null end is none."""
    mine, several = _dealt_members(edges, members.select(F.col("id").alias("src"), "group").distinct())
    ends = _ends(mine, F.slice(F.array_sort("own"), 1, most))
    met = _met(mine, several, ends, _lacks() & (F.col("src") != F.col("dst")), peer=F.col("peer"))
    return met.select("src", "dst", "peer", F.lit(PEER_CONFIDENCE).alias("confidence"))


def propagated(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, confidence: in groups where some members have edges (either way) and some have none, those without get all
    the group's ends. members: id, group. A null end is none."""
    # an edge without an end is an edge all the same, so that its member has some
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    mine, several = _dealt_members(both, members.select(F.col("id").alias("src"), "group").distinct())
    ends = _ends(mine, F.col("own"))
    met = _met(mine, several, ends, F.col("own").isNull() & (F.col("src") != F.col("dst")) & F.col("peer").isNotNull())
    return met.select("src", "dst", F.lit(PEER_CONFIDENCE).alias("confidence"))


def first_profile(static: DataFrame, graph: DataFrame, names: DataFrame) -> DataFrame:
    """name, roles, source: of each name the static table's roles, else the graph's; names with neither are left out."""
    s, g = static.select("name", F.col("roles").alias("s")), graph.select("name", F.col("roles").alias("g"))
    got = names.select("name").distinct().join(s, "name", "left").join(g, "name", "left").where("s is not null or g is not null")
    return got.select("name", F.coalesce("s", "g").alias("roles"), F.when(F.col("s").isNotNull(), "static").otherwise("graph").alias("source"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by label, edges by type, and the totals."""
    by = lambda d, kind, c: d.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda d, kind: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("total").alias("name"), "n")
    return by(nodes, "node", "label").unionByName(by(edges, "edge", "type")).unionByName(total(nodes, "node")).unionByName(total(edges, "edge"))


def graph_context(targets: DataFrame, edges: DataFrame, classes: DataFrame, warnings: DataFrame, most: int = 20) -> DataFrame:
    """src, kind, what, severity: what the graph says of each target (src): its edges, its classes' edges, its warnings
    (src, text)."""
    t = targets.select("src").distinct()
    one = neighbours(edges, t, most).select("src", F.lit("edge").alias("kind"), F.col("dst").cast("string").alias("what"), "severity")
    two = of_classes(edges, classes, most).join(t, "src", "left_semi").select("src", F.lit("class").alias("kind"), F.col("class").alias("what"), "severity")
    three = warnings.join(t, "src", "left_semi").select("src", F.lit("warning").alias("kind"), F.col("text").alias("what"), F.lit(None).cast("string").alias("severity"))
    return one.unionByName(two).unionByName(three)


# --- groups ----------------------------------------------------------------------------------------------------------


def ingredient_groups(nodes: DataFrame) -> DataFrame:
    """token, name: nodes (name, ingredient) by the longest of their ingredient's words (of equally long ones the first by
    alphabet), where at least two names have it. Names are joined to the tokens that are left, so that no group is
    collected; nodes without such a word are in none."""
    words = F.transform(ingredient_words(F.col("ingredient")), lambda w: F.struct(F.negative(F.length(w)).alias("n"), w.alias("w")))
    own = nodes.select("name", F.get(F.array_sort(words), F.lit(0))["w"].alias("token")).where("token is not null").distinct()
    shared = own.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.join(shared, "token", "left_semi").select("token", "name")
