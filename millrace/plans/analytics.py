"""Graph, resolution, deterministic analytics and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators.closeness import close_names
from millrace.operators.merging import merged
from millrace.operators.substrings import contains_join
from millrace.plans.registry import query
from millrace.sources.scratch import dealt, groups

#: Two parts of one order are an edge; how often decides the severity.
EDGES = "edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'major' WHEN count(*) = 2 THEN 'moderate' ELSE 'minor' END AS severity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"
LEVEL = "CASE severity WHEN 'major' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END"


def edges(t, *by: str):
    """The edges; dealt by src alone, those of a part meet without another exchange."""
    l = t.lineitem.select("l_orderkey", "l_partkey")  # noqa: E741
    n = groups(l)
    l = dealt(l, n, "l_orderkey")  # noqa: E741
    pairs = l.withColumnRenamed("l_partkey", "src").join(l.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst").select("src", "dst")
    return dealt(pairs, 2 * n, *(by or ("src", "dst"))).groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("severity", F.expr("case when n >= 3 then 'major' when n = 2 then 'moderate' else 'minor' end"))


@query("graph_edges", f"WITH {EDGES} SELECT * FROM edges")
def graph_edges(t):
    return edges(t)


@query("one_hop_top", f"WITH {EDGES} SELECT src, dst, severity, row_number() OVER (PARTITION BY src ORDER BY {LEVEL}, dst) AS rank FROM edges QUALIFY rank <= 5")
def one_hop_top(t):
    w = W.partitionBy("src").orderBy(F.expr(LEVEL), "dst")
    return edges(t, "src").select("src", "dst", "severity", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("severity_distribution", f"WITH {EDGES} SELECT severity, count(*) AS n FROM edges GROUP BY 1")
def severity_distribution(t):
    return edges(t).groupBy("severity").agg(F.count("*").alias("n"))


@query("both_endpoints", f"WITH {EDGES}, s AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') SELECT src, dst, severity FROM edges WHERE src IN (SELECT * FROM s) AND dst IN (SELECT * FROM s)")
def both_endpoints(t):
    s = t.part.where("p_brand = 'Brand#1'")
    e = edges(t)
    return e.join(s.select(F.col("p_partkey").alias("src")), "src", "left_semi").join(s.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst", "severity")


@query("mention_anti", f"WITH {EDGES} SELECT DISTINCT l_suppkey AS supp, l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT src FROM edges WHERE severity = 'moderate')")
def mention_anti(t):
    known = edges(t).where("severity = 'moderate'").select(F.col("src").alias("l_partkey")).distinct()
    return t.lineitem.join(known, "l_partkey", "left_anti").select(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part")).distinct()


@query("optional_counts", "SELECT p_partkey, coalesce(n, 0) AS lines, coalesce(s, 0) AS suppliers FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def optional_counts(t):
    c = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s"))
    return t.part.join(c, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("zero_degree", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def zero_degree(t):
    return t.part.join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


RAW = "(SELECT p_partkey AS id, p_name AS q FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'x' || p_name FROM part WHERE p_partkey % 3 = 2)"
NAMES = "(SELECT p_name AS name, min(p_partkey) AS cid, split_part(p_name, ' ', 1) AS base FROM part GROUP BY 1)"


@query("tiered_resolve", f"WITH r AS {RAW}, n AS {NAMES}, h AS (SELECT id, cid, 1 AS tier FROM r JOIN n ON q = name UNION ALL SELECT id, cid, 2 FROM r JOIN n ON q = base UNION ALL SELECT id, cid, 3 FROM r JOIN n ON contains(q, name)) SELECT id, min(tier) AS tier, min(cid) FILTER (tier = m) AS cid FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS m FROM h) GROUP BY 1")
def tiered_resolve(t):
    """Exact name, else base name, else a name contained in the text: the first tier that gives something."""
    p = t.part.select("p_partkey", "p_name")
    raw = p.select(F.col("p_partkey").alias("id"), F.expr("case p_partkey % 3 when 0 then p_name when 1 then split_part(p_name, ' ', 1) else 'x' || p_name end").alias("q"))
    n = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("cid")).withColumn("base", F.expr("split_part(name, ' ', 1)"))
    base = n.groupBy("base").agg(F.min("cid").alias("cid"))
    exact, short = raw.join(n, raw.q == n.name).select("id", "cid", F.lit(1).alias("tier")), raw.join(base, raw.q == base.base).select("id", "cid", F.lit(2).alias("tier"))
    left = raw.join(exact.union(short).select("id").distinct(), "id", "left_anti")
    found = contains_join(left.select(F.col("q").alias("text_id"), F.col("q").alias("text")).distinct(), n.select(F.col("name").alias("needle")))
    inside = left.join(found.select(F.col("text_id").alias("q"), F.col("needle").alias("name")), "q").join(n, "name").select("id", "cid", F.lit(3).alias("tier"))
    return exact.union(short).union(inside).groupBy("id").agg(F.min(F.struct("tier", "cid")).alias("b")).select("id", "b.tier", "b.cid")


#: The longest common block, the first in a, then in b.
BLOCK = "coalesce(list_filter(flatten(list_transform(range(least(length({a}), length({b})), 0, -1), lambda s: list_transform(range(1, length({a}) - s + 2), lambda i: {{'s': s, 'i': i, 'j': instr({b}, substring({a}, i, s))}}))), lambda z: z.j > 0)[1], {{'s': 0, 'i': 0, 'j': 0}})"


@query("fuzzy_match", f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL), p AS (SELECT left(m.name, 2) || 'h' || substring(m.name, 3) AS q, n.name FROM n m, n),
seg AS (SELECT q, name, {BLOCK.format(a='name', b='q')} AS m, name AS a, q AS b FROM p UNION ALL SELECT q, name, {BLOCK.format(a='x.a', b='x.b')}, x.a, x.b FROM (SELECT q, name, unnest([{{'a': a[1:m.i - 1], 'b': b[1:m.j - 1]}}, {{'a': substring(a, m.i + m.s), 'b': substring(b, m.j + m.s)}}]) AS x FROM seg WHERE m.s > 0) WHERE x.a <> '' AND x.b <> ''),
r AS (SELECT q, name, 2 * sum(m.s)::DOUBLE / (length(q) + length(name)) AS ratio FROM seg GROUP BY 1, 2)
SELECT q, max(CASE WHEN ratio >= 0.8 THEN {{'r': ratio, 'n': name}} END).n AS name FROM r GROUP BY 1""")
def fuzzy_match(t):
    """The closest distinct name by matching blocks (0.8 at least) for distorted names."""
    names = t.part.where("p_name is not null").select(F.col("p_name").alias("name")).distinct()
    asked = names.select(F.concat(F.expr("left(name, 2)"), F.lit("h"), F.expr("substring(name, 3)")).alias("q")).distinct()
    return asked.join(close_names(asked.withColumn("text", F.col("q")), names, 0.8, 1), "q", "left").select("q", "name")


@query("propagate_group_edges", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), g AS (SELECT DISTINCT p_name, p_brand, dst FROM e JOIN part ON src = p_partkey) SELECT p_partkey AS src, dst, 0.7 AS confidence FROM part JOIN g USING (p_name, p_brand) WHERE (p_partkey, dst) NOT IN (SELECT src, dst FROM e)")
def propagate_group_edges(t):
    """Ends of a group's edges that a member of the group hasn't."""
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    members = t.part.where("p_name is not null and p_brand is not null").select(F.col("p_partkey").alias("src"), F.struct("p_name", "p_brand").alias("group"))
    return G.lacking(e, members).select("src", "dst", F.expr("cast(0.7 as decimal(2, 1))").alias("confidence"))


@query("retroactive_resolve", "SELECT l_orderkey, l_linenumber, p_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def retroactive_resolve(t):
    new = t.part.where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(new, "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))


@query("merge_variants", "WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS c FROM part) SELECT DISTINCT c AS part, l_suppkey AS supp FROM lineitem JOIN m ON l_partkey = p_partkey")
def merge_variants(t):
    c = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("c"))
    m = t.part.join(c, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("l_partkey"), "c")
    return t.lineitem.join(m, "l_partkey").select(F.col("c").alias("part"), F.col("l_suppkey").alias("supp")).distinct()


@query("merge_chains", """WITH RECURSIVE m AS (SELECT p_partkey AS v, p_partkey // 2 AS c FROM part WHERE p_size % 3 <> 0 AND p_partkey > 1), w AS (SELECT v, c FROM m UNION ALL SELECT w.v, m.c FROM w JOIN m ON w.c = m.v),
e AS (SELECT v, c FROM w WHERE c NOT IN (SELECT v FROM m)), l AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 7 + l_linenumber AS dst FROM lineitem)
SELECT DISTINCT coalesce(a.c, src) AS src, coalesce(b.c, dst) AS dst FROM l LEFT JOIN e a ON a.v = src LEFT JOIN e b ON b.v = dst WHERE coalesce(a.c, src) <> coalesce(b.c, dst)""")
def merge_chains(t):
    """Edges rewired to canonical parts, which variants reach over chains of several links."""
    mapping = t.part.where("p_size % 3 <> 0 and p_partkey > 1").select(F.col("p_partkey").alias("variant"), F.expr("p_partkey div 2").alias("canonical"))
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("dst")).distinct()
    return merged(edges, mapping)


@query("enzyme_conflict", "WITH r AS (SELECT DISTINCT l_suppkey AS enzyme, l_orderkey AS o, l_returnflag AS role FROM lineitem) SELECT enzyme, sum(a.n * b.n)::BIGINT AS pairs, CASE WHEN a.role = 'R' THEN 'critical' WHEN a.role = 'A' THEN 'caution' ELSE 'competitive' END AS result FROM (SELECT enzyme, role, count(*) AS n FROM r GROUP BY ALL) a JOIN (SELECT enzyme, count(*) AS n FROM r WHERE role = 'N' GROUP BY ALL) b USING (enzyme) GROUP BY enzyme, result")
def enzyme_conflict(t):
    """Pairs by role and enzyme, from counts of roles: no pair of a hot enzyme is made."""
    r = t.lineitem.select(F.col("l_suppkey").alias("enzyme"), "l_orderkey", F.col("l_returnflag").alias("role")).distinct()
    a = r.groupBy("enzyme", "role").agg(F.count("*").alias("n"))
    b = a.where("role = 'N'").select("enzyme", F.col("n").alias("m"))
    return a.join(b, "enzyme").select("enzyme", (F.col("n") * F.col("m")).alias("pairs"), F.expr("case role when 'R' then 'critical' when 'A' then 'caution' else 'competitive' end").alias("result"))


@query("role_pivot", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def role_pivot(t):
    p = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count()
    return p.select("l_suppkey", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "ANR"])


CATEGORIES = [("qt", "tion"), ("bleeding", "ing"), ("renal", "eau"), ("hepatic", "ung")]


@query("cumulative_risk", "SELECT c AS category, source, count(DISTINCT doc_id) AS n, CASE WHEN count(DISTINCT doc_id) >= 3 THEN 'critical' ELSE 'caution' END AS severity FROM (" + " UNION ALL ".join(f"SELECT doc_id, source, '{c}' AS c FROM documents WHERE contains(text, '{k}')" for c, k in CATEGORIES) + ") GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def cumulative_risk(t):
    hit = F.filter(F.array(*[F.when(F.col("text").contains(k), c) for c, k in CATEGORIES]), lambda x: x.isNotNull())
    d = t.documents.select("doc_id", "source", F.explode(hit).alias("category"))
    return d.groupBy("category", "source").agg(F.countDistinct("doc_id").alias("n")).where("n >= 2").withColumn("severity", F.when(F.col("n") >= 3, "critical").otherwise("caution"))


LIMITS = [("click", 5.0, 30.0), ("view", 2.0, 20.0), ("error", 1.0, 10.0)]


@query("lab_status", "SELECT event_id, CASE WHEN lo IS NULL THEN 'unknown' WHEN value >= hi THEN 'high' WHEN value <= lo THEN 'low' ELSE 'normal' END AS status FROM events LEFT JOIN (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, a, b in LIMITS) + ") l(k, lo, hi) ON event_type = k")
def lab_status(t):
    l = t.spark.createDataFrame(LIMITS, "event_type string, lo double, hi double")  # noqa: E741
    return t.events.join(F.broadcast(l), "event_type", "left").select("event_id", F.expr("case when lo is null then 'unknown' when value >= hi then 'high' when value <= lo then 'low' else 'normal' end").alias("status"))


BANDS = "CASE WHEN value >= 90 THEN 'G1' WHEN value >= 60 THEN 'G2' WHEN value >= 45 THEN 'G3a' WHEN value >= 30 THEN 'G3b' WHEN value >= 15 THEN 'G4' ELSE 'G5' END"


@query("stage_bands", f"SELECT {BANDS} AS stage, count(*) AS n FROM events GROUP BY 1")
def stage_bands(t):
    return t.events.groupBy(F.expr(BANDS).alias("stage")).agg(F.count("*").alias("n"))


@query("session_merge", "SELECT user_id, max_by(value, event_id) AS last_value, bool_or(event_type = 'error') AS any_error, count(*) AS n FROM events GROUP BY 1")
def session_merge(t):
    return t.events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.count("*").alias("n"))


@query("page_asof", "SELECT e.event_id, max(v.event_id) AS page FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND v.event_id <= e.event_id GROUP BY 1")
def page_asof(t):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    e = t.events.where("event_type in ('error', 'view')").select("event_id", "event_type", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(w).alias("page"))
    return e.where("event_type = 'error'").select("event_id", "page")


@query("nearest_position", "SELECT user_id, max(event_id) FILTER (event_id < 500) AS before, min(event_id) FILTER (event_id >= 500) AS after FROM events GROUP BY 1")
def nearest_position(t):
    return t.events.groupBy("user_id").agg(F.max(F.expr("case when event_id < 500 then event_id end")).alias("before"), F.min(F.expr("case when event_id >= 500 then event_id end")).alias("after"))


@query("coverage_gap", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_gap(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "lang")


@query("incremental_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def incremental_anti(t):
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("exists_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exists_semi(t):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("collection_stats", "SELECT 'lang' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'total', 'total', count(*) FROM documents")
def collection_stats(t):
    by = lambda k, c: t.documents.groupBy(c.alias("name")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "name", "n")
    return by("lang", F.col("lang")).union(by("source", F.col("source"))).union(t.documents.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("total"), "n"))


@query("nan_mean", "SELECT event_type, round(avg(CASE WHEN value < 50 THEN value END), 4) AS mean, count(*) FILTER (value < 50) AS n FROM events GROUP BY 1")
def nan_mean(t):
    v = F.when(F.col("value") < 50, F.col("value")).otherwise(F.lit(float("nan")))
    ok = F.when(~F.isnan(v), v)
    return t.events.groupBy("event_type").agg(F.round(F.avg(ok), 4).alias("mean"), F.count(ok).alias("n"))


@query("subset_match", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'bolt'])")
def subset_match(t):
    return t.part.where(F.size(F.array_except(F.array(F.lit("red"), F.lit("bolt")), F.split("p_name", " "))) == 0).select("p_partkey")


@query("topk_caps", f"WITH {EDGES} SELECT src, least(count(*), 5) AS shown, greatest(count(*) - 5, 0) AS more FROM edges GROUP BY 1")
def topk_caps(t):
    return edges(t).groupBy("src").agg(F.count("*").alias("n")).select("src", F.least("n", F.lit(5)).cast("long").alias("shown"), F.greatest(F.col("n") - 5, F.lit(0)).cast("long").alias("more"))


@query("multi_hot_flags", "SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic, lang = 'en' AS english FROM labels JOIN documents USING (doc_id)")
def multi_hot_flags(t):
    flags = F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("lang") == "en", "english"))
    has = lambda f: F.coalesce(F.array_contains(F.array_compact("f"), f), F.lit(False)).alias(f)
    return t.labels.join(t.documents, "doc_id").select("doc_id", flags.alias("f")).select("doc_id", has("good"), has("toxic"), has("english"))


@query("critical_bypass", "SELECT event_id FROM events WHERE event_type = 'error' OR value > 20")
def critical_bypass(t):
    return t.events.where(F.when(F.col("event_type") == "error", True).otherwise(F.col("value") > 20)).select("event_id")


@query("profile_priority_filter", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P' QUALIFY rank <= 10")
def profile_priority_filter(t):
    w = W.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), "o_orderkey")
    return t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 10")


@query("ordered_union", "SELECT p_partkey, array_to_string(list_distinct([split_part(p_name, ' ', 1)]) || list_filter([split_part(p_name, ' ', 2)], lambda x: x <> split_part(p_name, ' ', 1)), ',') AS names FROM part")
def ordered_union(t):
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.split("p_name", " ")), ",").alias("names"))


@query("edge_in_out_union", f"WITH {EDGES} SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges")
def edge_in_out_union(t):
    e = edges(t)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()


@query("shared_members", "WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey FROM lineitem) SELECT s.a, u.a AS b, count(*) AS shared FROM s JOIN s u ON u.l_partkey = s.l_partkey AND s.a < u.a GROUP BY 1, 2")
def shared_members(t):
    """How many parts any two suppliers share."""
    s = t.lineitem.select(F.col("l_suppkey").alias("a"), "l_partkey")
    n = groups(s)
    s = dealt(s, n, "l_partkey").distinct()
    pairs = s.join(s.withColumnRenamed("a", "b"), "l_partkey").where("a < b").select("a", "b")
    return dealt(pairs, n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("most_severe_merge", "SELECT o_custkey, min(o_orderpriority) AS worst, min_by(o_orderkey, o_orderpriority || lpad(o_orderkey::VARCHAR, 12, '0')) AS order_id FROM orders GROUP BY 1")
def most_severe_merge(t):
    return t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderpriority").alias("worst"), F.col("m.o_orderkey").alias("order_id"))


@query("status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders")
def status_counts(t):
    return t.orders.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("done", "o_orderstatus = 'F'"), ("open", "o_orderstatus = 'O'"), ("other", "o_orderstatus not in ('F', 'O')"))])


@query("route_split", "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'mention' WHEN p_size > 40 THEN 'class' ELSE 'resolved' END AS route FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'ECONOMY') ON l_partkey = p_partkey")
def route_split(t):
    p = t.part.where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return t.lineitem.join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.expr("case when p_size is null then 'mention' when p_size > 40 then 'class' else 'resolved' end").alias("route"))


@query("upsert_merge", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END, 'unknown'), 'NEW') ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END END AS segment FROM customer")
def upsert_merge(t):
    """Old rows and updates (of even keys) by key: a known value stays, unknown is replaced."""
    old = t.customer.select("c_custkey", "c_name", F.expr("case when c_mktsegment = 'BUILDING' then 'unknown' else c_mktsegment end").alias("segment"), F.lit(0).alias("age"))
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.lit("NEW").alias("segment"), F.lit(1).alias("age"))
    both = old.unionByName(new).groupBy("c_custkey").agg(F.min("c_name").alias("c_name"), F.min_by("segment", F.when(F.col("segment") != "unknown", F.col("age"))).alias("known"))
    return both.select("c_custkey", "c_name", F.coalesce("known", F.lit("unknown")).alias("segment"))


@query("severity_normalize", "SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'critical' WHEN contains(lower(o_orderpriority), 'high') THEN 'major' WHEN contains(lower(o_orderpriority), 'medium') THEN 'moderate' WHEN contains(lower(o_orderpriority), 'low') THEN 'minor' ELSE 'unknown' END AS severity FROM orders")
def severity_normalize(t):
    p, out = F.lower("o_orderpriority"), F.lit("unknown")
    for word, level in (("low", "minor"), ("medium", "moderate"), ("high", "major"), ("urgent", "critical")):
        out = F.when(p.contains(word), level).otherwise(out)
    return t.orders.select("o_orderkey", out.alias("severity"))


@query("parse_props_json", "SELECT event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def parse_props_json(t):
    p = F.from_json("props", "key bigint, k bigint")
    return t.events.select("event_id", F.coalesce(p["key"], p["k"]).alias("k"))


@query("ingredient_tokens", "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4))[1:5], ',') AS toks FROM part")
def ingredient_tokens(t):
    return t.part.select("p_partkey", F.array_join(F.slice(F.sort_array(F.filter(F.split("p_name", " "), lambda x: F.length(x) >= 4)), 1, 5), ",").alias("toks"))


@query("severity_node_pick", "SELECT l_partkey, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS pick FROM lineitem GROUP BY 1")
def severity_node_pick(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("pick"))
