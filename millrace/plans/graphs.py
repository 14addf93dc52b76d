"""Graph sinks and expansions over the tables: parts are nodes, two parts of one order an edge, suppliers mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import patients as P
from millrace.operators import graph as G
from millrace.plans.registry import query
from millrace.sources.scratch import dealt, groups

SEVERITY = "CASE WHEN {n} % 4 = 0 THEN 'unknown' WHEN {n} % 4 = 1 THEN 'mild' WHEN {n} % 4 = 2 THEN 'severe' ELSE 'contraindicated' END"
OLD = f"old AS (SELECT src, dst, {SEVERITY.format(n='k')} AS severity FROM (SELECT l_partkey AS src, l_suppkey AS dst, min(l_orderkey) AS k FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2))"
NEW = f"new AS (SELECT src, dst, {SEVERITY.format(n='k')} AS severity FROM (SELECT l_partkey AS src, l_suppkey AS dst, max(l_orderkey) AS k FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2))"


def _edges(t, flag: str, pick) -> object:
    g = t.lineitem.where(F.col("l_returnflag") != flag).groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(pick("l_orderkey").alias("k"))
    return g.select("src", "dst", F.expr(SEVERITY.format(n="k")).alias("severity"))


def _old(t):
    return _edges(t, "N", F.min)


def _new(t):
    return _edges(t, "A", F.max)


def _old_and_new(t):
    """_old and _new out of one exchange of the lines."""
    l = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey", "l_returnflag")  # noqa: E741
    l = dealt(l, groups(l), "src", "dst")  # noqa: E741

    def side(flag: str, pick):
        of = F.col("l_returnflag") != flag
        g = l.groupBy("src", "dst").agg(pick(F.when(of, F.col("l_orderkey"))).alias("k"), F.count_if(of).alias("n")).where("n > 0")
        return g.select("src", "dst", F.expr(SEVERITY.format(n="k")).alias("severity"))

    return side("N", F.min), side("A", F.max)


def _merge_sql(first: str, second: str) -> str:
    return f"WITH {OLD}, {NEW} SELECT src, dst, coalesce(nullif({first}.severity, 'unknown'), nullif({second}.severity, 'unknown'), 'unknown') AS severity FROM old FULL JOIN new USING (src, dst)"


@query("edges_keep_known", _merge_sql("old", "new"))
def edges_keep_known(t):
    """A known severity stays, an unknown one is replaced."""
    return G.merged_edges(*_old_and_new(t))


@query("edges_latest_known", _merge_sql("new", "old"))
def edges_latest_known(t):
    """A known severity of the new edges takes the place of the old one."""
    return G.merged_edges(*_old_and_new(t), latest=True)


@query("node_upsert", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.created ELSE o.created END AS created, coalesce(n.name, o.name) AS name FROM (SELECT c_custkey AS id, c_mktsegment AS created, c_name AS name FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS id, 'new' AS created, CASE WHEN c_custkey % 5 <> 0 THEN upper(c_mktsegment) END AS name FROM customer WHERE c_custkey % 2 = 0) n ON o.id = n.id")
def node_upsert(t):
    """Properties that are set when a node is made, and those that are set whenever they are given."""
    old = t.customer.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("created"), F.col("c_name").alias("name"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("created"), F.expr("case when c_custkey % 5 != 0 then upper(c_mktsegment) end").alias("name"))
    return G.upserted(old, new, "id", ["created"], ["name"])


@query("mention_upsert", "SELECT DISTINCT source AS src, left(text, 100) AS name FROM documents WHERE left(text, 100) <> ''")
def mention_upsert(t):
    """Mentions are cut at 100 characters; each pair once."""
    d = t.documents.select(F.col("source").alias("src"), F.col("text").alias("name"))
    return G.added_mentions(d, d)


@query("provenance_delete", "SELECT o_orderkey AS src, o_custkey AS dst, o_orderpriority AS provenance FROM orders WHERE o_orderpriority <> '1-URGENT'")
def provenance_delete(t):
    e = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_orderpriority").alias("provenance"))
    return G.without(e, "1-URGENT")


@query("duplicate_keys", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t):
    """Names that break a uniqueness constraint."""
    return G.duplicate_keys(t.part.select(F.col("p_name").alias("name")), "name")


MENTIONS = "m AS (SELECT DISTINCT l_suppkey + 1000000 AS src, upper(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'), e AS (SELECT DISTINCT l_suppkey + 1000000 AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT p_name AS name, min(p_partkey) AS entity FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0)"


def _late(t):
    part = t.part.select("p_partkey", "p_name")
    m = t.lineitem.where("l_returnflag = 'A'").join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") + 1000000).alias("src"), F.upper("p_name").alias("name")).distinct()
    e = t.lineitem.where("l_returnflag = 'R'").select((F.col("l_suppkey") + 1000000).alias("src"), F.col("l_partkey").alias("dst")).distinct().select("src", "dst", F.lit("mild").alias("severity"), F.lit(1.0).alias("confidence"))
    n = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity")).where("entity % 2 = 0")
    return G.repaired(m, e, n)


@query("late_entities_edges", f"WITH {MENTIONS} SELECT src, dst, 'mild' AS severity, 1.0::DOUBLE AS confidence FROM e UNION ALL (SELECT DISTINCT src, entity, 'unknown', 0.85::DOUBLE FROM m JOIN n ON lower(m.name) = lower(n.name) WHERE (src, entity) NOT IN (SELECT src, dst FROM e))")
def late_entities_edges(t):
    """Mentions of entities that come later become edges."""
    return _late(t)[1]


@query("late_entities_mentions", f"WITH {MENTIONS} SELECT src, name FROM m WHERE lower(name) NOT IN (SELECT lower(name) FROM n)")
def late_entities_mentions(t):
    """What has become an edge is no mention any more."""
    return _late(t)[0].select("src", "name")


WORST = "CASE severity WHEN 'contraindicated' THEN 0 WHEN 'severe' THEN 1 WHEN 'moderate' THEN 2 WHEN 'mild' THEN 3 ELSE 4 END"


@query("worst_neighbours", f"WITH {OLD} SELECT src, dst, severity, row_number() OVER (PARTITION BY src ORDER BY {WORST}, dst) AS rank FROM old WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 25) QUALIFY rank <= 60")
def worst_neighbours(t):
    return _rank(G.neighbours(_old(t), t.part.where("p_size > 25").select(F.col("p_partkey").alias("src"))))


def _rank(d):
    return d.withColumn("rank", F.col("rank").cast("long"))


@query("class_edges", f"WITH {OLD} SELECT src, s_name AS class, severity, row_number() OVER (PARTITION BY src ORDER BY {WORST}, s_name) AS rank FROM old JOIN supplier ON dst = s_suppkey WHERE s_nationkey < 12 QUALIFY rank <= 20")
def class_edges(t):
    classes = t.supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("class"))
    return _rank(G.of_classes(_old(t), classes))


@query("condition_nodes", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt')")
def condition_nodes(t):
    return G.with_condition(t.part, "p_name", "BOLT").select("p_partkey")


PEERS = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 10000000 AS dst FROM lineitem), g AS (SELECT p_partkey AS id, p_name || p_brand AS grp FROM part)"


@query("peer_edges", f"WITH {PEERS}, c AS (SELECT src AS peer, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 50) SELECT m.id AS src, c.dst, min(c.peer) AS peer, 0.7::DOUBLE AS confidence FROM c JOIN g p ON p.id = c.peer JOIN g m ON m.grp = p.grp AND m.id <> c.peer WHERE (m.id, c.dst) NOT IN (SELECT src, dst FROM e) GROUP BY 1, 2")
def peer_edges(t):
    """Edges of a group's other members, at most 50 from each."""
    return G.peers(*_members(t))


def _members(t):
    e = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10000000).alias("dst"))
    return e, t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("group"))


@query("group_propagation", f"WITH {PEERS}, x AS (SELECT * FROM e WHERE src % 3 = 0), b AS (SELECT src AS id, dst AS other FROM x UNION SELECT dst, src FROM x), h AS (SELECT g.id, grp, g.id IN (SELECT id FROM b) AS has FROM g), o AS (SELECT grp FROM h GROUP BY 1 HAVING bool_or(has) AND bool_or(NOT has)) SELECT DISTINCT h.id AS src, other AS dst, 0.7::DOUBLE AS confidence FROM h JOIN g p ON p.grp = h.grp JOIN b ON b.id = p.id WHERE NOT has AND h.grp IN (SELECT grp FROM o) AND h.id <> other")
def group_propagation(t):
    """Members without edges get the ends of their group, edges taken either way."""
    e, members = _members(t)
    return G.propagated(e.where("src % 3 = 0"), members)


@query("profile_precedence", "SELECT n_name AS name, coalesce(s.roles, g.roles) AS roles, CASE WHEN s.roles IS NOT NULL THEN 'static' ELSE 'graph' END AS source FROM nation n LEFT JOIN (SELECT r_regionkey, r_name AS roles FROM region WHERE r_regionkey < 2) s ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS roles FROM supplier GROUP BY 1) g ON n_nationkey = s_nationkey WHERE s.roles IS NOT NULL OR g.roles IS NOT NULL")
def profile_precedence(t):
    """The static table comes before the graph."""
    static = t.nation.join(t.region.where("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("roles"))
    graph = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("roles")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "roles")
    return G.first_profile(static, graph, t.nation.select(F.col("n_name").alias("name")))


@query("graph_totals", f"WITH {OLD}, n AS (SELECT 'part' AS label FROM part UNION ALL SELECT 'supplier' FROM supplier), k AS (SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', severity, count(*) FROM old GROUP BY 2) SELECT * FROM k UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM k GROUP BY kind")
def graph_totals(t):
    nodes = t.part.select(F.lit("part").alias("label")).unionByName(t.supplier.select(F.lit("supplier").alias("label")))
    return G.graph_stats(nodes, _old(t).select(F.col("severity").alias("type")))


CONTEXT = f"""{OLD}, tg AS (SELECT p_partkey AS src FROM part WHERE p_size = 10),
a AS (SELECT src, 'edge' AS kind, dst::VARCHAR AS what, severity FROM old WHERE src IN (SELECT src FROM tg) QUALIFY row_number() OVER (PARTITION BY src ORDER BY {WORST}, dst) <= 20),
b AS (SELECT src, 'class' AS kind, s_name AS what, severity FROM old JOIN supplier ON dst = s_suppkey WHERE s_nationkey < 12 AND src IN (SELECT src FROM tg) QUALIFY row_number() OVER (PARTITION BY src ORDER BY {WORST}, s_name) <= 20)"""


@query("graph_context", f"WITH {CONTEXT} SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT p_partkey, 'warning', p_type, NULL FROM part WHERE p_partkey IN (SELECT src FROM tg)")
def graph_context(t):
    """Edges, classes and warnings of each target."""
    classes = t.supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("class"))
    targets = t.part.where("p_size = 10").select(F.col("p_partkey").alias("src"))
    return G.graph_context(targets, _old(t), classes, t.part.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("text")))


@query("mention_routes", "WITH m AS (SELECT l_orderkey AS src, p_name AS name, p_type, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT DISTINCT p_name FROM part WHERE p_size = 1), k AS (SELECT p_name, min(p_partkey) AS e FROM part WHERE p_size > 20 GROUP BY 1) SELECT CASE WHEN m.name IN (SELECT * FROM c) THEN 'class' WHEN k.e IS NOT NULL THEN 'edge' ELSE 'mention' END AS route, count(*) AS n FROM m LEFT JOIN k ON k.p_name = m.name GROUP BY 1")
def mention_routes(t):
    """Three sinks for a mention: a class, an entity, or none of these; here their sizes."""
    part = t.part.select("p_partkey", "p_name", "p_size")
    m = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("src"), F.col("p_name").alias("name"), F.lit("mild").alias("severity"))
    classes = part.where("p_size = 1").select(F.col("p_name").alias("name"))
    known = part.where("p_size > 20").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity"))
    a, b, c = G.routed(m, known, classes)
    size = lambda d, r: d.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(r).alias("route"), "n")
    return size(a, "class").unionByName(size(b, "edge")).unionByName(size(c, "mention"))


LAB = "(VALUES " + ", ".join(f"({k}, '{n}', {x[0] or 'NULL'}::DOUBLE, {x[1] or 'NULL'}::DOUBLE, {x[2] or 'NULL'}::DOUBLE, {x[3] or 'NULL'}::DOUBLE)" for k, (n, x) in enumerate(P.LAB_LIMITS.items())) + ") l(k, name, upper, times, above, below)"
STATUS = "CASE WHEN name IS NULL THEN 'bilinmiyor' WHEN times IS NOT NULL THEN CASE WHEN v >= upper * times THEN 'kritik_yüksek' WHEN v > upper THEN 'yüksek' ELSE 'normal' END WHEN v >= above THEN 'kritik_yüksek' WHEN v <= below THEN 'kritik_düşük' ELSE 'normal' END"
EVENTS = f"ev AS (SELECT event_id, user_id, coalesce(name, 'X') AS lab, floor(value * CASE WHEN times IS NOT NULL THEN 10 ELSE 1 END) AS v, name, upper, times, above, below FROM events LEFT JOIN {LAB} ON event_id % 13 = k)"


def _labs(t):
    name = F.lit("X")
    for k, n in enumerate(P.LAB_LIMITS):
        name = F.when(F.col("event_id") % 13 == k, n).otherwise(name)
    enzyme = [n for n, x in P.LAB_LIMITS.items() if x[1]]
    return t.events.select("event_id", "user_id", name.alias("lab"), "value").select("event_id", "user_id", "lab", F.floor(F.col("value") * F.when(F.col("lab").isin(enzyme), 10.0).otherwise(1.0)).cast("double").alias("v"))


@query("lab_limits", f"WITH {EVENTS} SELECT event_id, lab, v, {STATUS} AS status FROM ev")
def lab_limits(t):
    """All twelve limits, and a name that has none."""
    return _labs(t).withColumn("status", P.lab_status(F.col("lab"), F.col("v"))).select("event_id", "lab", "v", "status")


@query("abnormal_values", f"WITH {EVENTS}, z AS (SELECT user_id, lab, {STATUS} AS status, v FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, lab ORDER BY event_id DESC) = 1) SELECT user_id, count(*) AS n, string_agg(lab || ':' || status, ',' ORDER BY lab) AS found FROM z WHERE status NOT IN ('normal', 'bilinmiyor') GROUP BY 1")
def abnormal_values(t):
    """The abnormal ones among the last values of each user, out of a map."""
    last = _labs(t).groupBy("user_id", "lab").agg(F.max_by("v", "event_id").alias("v"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lab", "v")))).alias("labs"))
    found = maps.select("user_id", P.abnormal_labs(F.col("labs")).alias("a")).where("size(a) > 0")
    return found.select("user_id", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda r: F.concat_ws(":", r["name"], r["status"])), ",").alias("found"))
