"""Names, chunks, sections and text checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.extraction import severity
from millrace.operators.substrings import contains_join, first_tokens, mention_nodes
from millrace.plans.registry import query

NORM = "upper(trim(regexp_replace(translate(replace(regexp_replace(coalesce({}, ''), '[®™©]', '', 'g'), 'ß', 'SS'), 'ğüşıöçĞÜŞİÖÇ', 'gusiocGUSIOC'), '\\s+', ' ', 'g')))"
N = NORM.format("p_name")


@query("normalize_names", f"SELECT p_partkey AS id, 'part' AS kind, {N} AS name FROM part UNION ALL SELECT c_custkey, 'customer', {NORM.format('c_name')} FROM customer")
def normalize_names(t):
    one = lambda d, i, n, k: d.select(F.col(i).alias("id"), F.lit(k).alias("kind"), X.normalized_name(F.col(n)).alias("name"))
    return one(t.part, "p_partkey", "p_name", "part").union(one(t.customer, "c_custkey", "c_name", "customer"))


@query("canonical_ids", f"SELECT p_partkey, {N} AS name, sha1({N})[1:12] AS canonical_id, left(lower(replace(p_name, ' ', '_')), 30) || '_' || md5(p_name || p_type)[1:12] AS chunk_id FROM part")
def canonical_ids(t):
    name = F.col("p_name")
    slug = F.substring(F.lower(F.replace(name, F.lit(" "), F.lit("_"))), 1, 30)
    return t.part.select("p_partkey", X.normalized_name(name).alias("name"), X.canonical_id(name).alias("canonical_id"), F.concat(slug, F.lit("_"), F.substring(F.md5(F.concat(name, "p_type")), 1, 12)).alias("chunk_id"))


@query("base_name_groups", f"SELECT split_part({N}, ' ', 1) AS base, count(*) AS n, count(DISTINCT p_name) AS names, min(p_partkey) AS first_id, string_agg(DISTINCT split_part({N}, ' ', 2), ',' ORDER BY split_part({N}, ' ', 2)) AS members FROM part GROUP BY 1 HAVING count(*) > 1")
def base_name_groups(t):
    p = t.part.select("p_partkey", "p_name", X.base_name(F.col("p_name")).alias("base"), F.split_part(X.normalized_name(F.col("p_name")), F.lit(" "), F.lit(2)).alias("rest"))
    return p.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("names"), F.min("p_partkey").alias("first_id"), F.array_join(F.sort_array(F.collect_set("rest")), ",").alias("members")).where("n > 1")


TOK = "list_filter(string_split_regex(" + NORM.format("text") + ", '[\\s,;:.!?()\\[\\]/\\-]+'), lambda x: length(x) >= 2)"


@query("tokenize_docs", f"SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOK}) AS tok FROM documents) GROUP BY 1")
def tokenize_docs(t):
    d = t.documents.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("tok")).groupBy("tok", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return d.groupBy("tok").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("split_paragraphs", "SELECT doc_id, pos, left(md5(doc_id || '_' || pos || '_' || p), 12) AS chunk_id, length(p) AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE length(trim(p)) >= 20")
def split_paragraphs(t):
    d = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p")).where(F.length(F.trim("p")) >= 20)
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.substring(F.md5(F.concat_ws("_", "doc_id", "pos", "p")), 1, 12).alias("chunk_id"), F.length("p").cast("long").alias("size"))


@query("pack_paragraphs")
def pack_paragraphs(t):
    """Lines packed into chunks of at most 2,200 characters, order kept."""
    d = t.documents.select("doc_id", F.posexplode(X.packed(F.split("text", "\n"), 2200)).alias("pos", "chunk"))
    return d.select("doc_id", "pos", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


@query("fixed_windows", "SELECT doc_id, k * 3500 AS start, md5(substring(text, (k * 3500 + 1)::BIGINT, 4000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 500) / 3500)::BIGINT, 1))) AS k FROM documents)")
def fixed_windows(t):
    d = t.documents.select("doc_id", F.explode(X.windows(F.col("text"), 4000, 500)).alias("w"))
    return d.select("doc_id", F.col("w.start").cast("long").alias("start"), F.md5("w.text").alias("digest"))


@query("section_spans", """WITH s AS (SELECT page_id, length(html) AS total, unnest(string_split(html, '<p>')) AS part, generate_subscripts(string_split(html, '<p>'), 1) - 1 AS no FROM pages),
o AS (SELECT page_id, no, total, coalesce(sum(length(part) + 3) OVER (PARTITION BY page_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT page_id, no, start, lead(start, 1, total) OVER (PARTITION BY page_id ORDER BY no) AS stop FROM o""")
def section_spans(t):
    s = t.pages.select("page_id", F.length("html").cast("long").alias("total"), F.posexplode(F.split("html", "<p>")).alias("no", "part"))
    w = W.partitionBy("page_id").orderBy("no")
    s = s.withColumn("start", F.coalesce(F.sum(F.length("part") + 3).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return s.select("page_id", F.col("no").cast("long").alias("no"), "start", F.coalesce(F.lead("start").over(w), "total").alias("stop"))


@query("clean_text", r"SELECT page_id, md5(x) AS digest, length(x) AS size FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages)")
def clean_text(t):
    x = t.pages.select("page_id", X.strip_tags(F.col("html")).alias("x"))
    return x.select("page_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("size"))


TIERS = [("major", "tion"), ("moderate", "ing"), ("minor", "ent")]


@query("severity_windows", "SELECT doc_id, CASE WHEN contains(w, 'tion') THEN 'major' WHEN contains(w, 'ing') THEN 'moderate' WHEN contains(w, 'ent') THEN 'minor' ELSE 'unknown' END AS severity, length(w) AS size FROM (SELECT doc_id, CASE WHEN i > 0 THEN substring(text, greatest(i - 150, 1), i + 4 + 150 - greatest(i - 150, 1)) ELSE text END AS w FROM (SELECT doc_id, text, instr(text, 'ther') AS i FROM documents))")
def severity_windows(t):
    w = t.documents.select("doc_id", X.around(F.col("text"), "ther", 150).alias("w"))
    return w.select("doc_id", X.tier(F.col("w"), TIERS, "unknown").alias("severity"), F.length("w").cast("long").alias("size"))


@query("regex_extract_distinct", "SELECT doc_id, m FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS m FROM documents) WHERE length(m) >= 4")
def regex_extract_distinct(t):
    return t.documents.select("doc_id", F.explode(F.array_distinct(F.transform(F.expr("regexp_extract_all(text, '[A-Z][a-z]{3,}', 0)"), F.lower))).alias("m")).where(F.length("m") >= 4)


@query("leading_summary", r"SELECT doc_id, trim(left(regexp_replace(text, '\s+', ' ', 'g'), 300)) AS summary FROM documents")
def leading_summary(t):
    return t.documents.select("doc_id", F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300)).alias("summary"))


@query("reason_sentence", "SELECT doc_id, coalesce(list_filter(s, lambda x: contains(x, 'tion'))[1], list_filter(s, lambda x: length(x) > 30)[1]) AS reason FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents)")
def reason_sentence(t):
    s = F.split("text", "\\. ")
    first = lambda p: F.get(F.filter(s, p), F.lit(0))
    return t.documents.select("doc_id", F.coalesce(first(lambda x: x.contains("tion")), first(lambda x: F.length(x) > 30)).alias("reason"))


@query("chunk_window", "SELECT doc_id, md5(left(text, CASE lang WHEN 'en' THEN 1200 WHEN 'de' THEN 800 ELSE 600 END)) AS digest, least(length(text), CASE lang WHEN 'en' THEN 1200 WHEN 'de' THEN 800 ELSE 600 END) AS size FROM documents")
def chunk_window(t):
    most = F.expr("case lang when 'en' then 1200 when 'de' then 800 else 600 end")
    return t.documents.select("doc_id", F.md5(F.substring("text", F.lit(1), most)).alias("digest"), F.least(F.length("text"), most).cast("long").alias("size"))


@query("line_compress", "SELECT doc_id, CASE WHEN length(text) < 1200 OR len(l) < 4 OR length(k) < 0.3 * length(text) THEN text ELSE k END AS body FROM (SELECT doc_id, text, l, array_to_string(list_filter(l, lambda x: contains(lower(x), 'tion')), chr(10)) AS k FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))")
def line_compress(t):
    l = F.split("text", "\n")  # noqa: E741
    d = t.documents.select("doc_id", "text", F.size(l).alias("n"), F.array_join(F.filter(l, lambda x: F.lower(x).contains("tion")), "\n").alias("k"))
    return d.select("doc_id", F.when((F.length("text") < 1200) | (F.col("n") < 4) | (F.length("k") < 0.3 * F.length("text")), F.col("text")).otherwise(F.col("k")).alias("body"))


@query("section_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY 1")
def section_concat(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("body"), F.count(F.lit(1)).alias("turns"))


FLAGS = [("short", "length(text) < 200"), ("long", "length(text) > 20000"), ("junk", "text rlike '[#$%&*]{3}'"), ("shouting", "text = upper(text)"), ("one_line", "instr(text, chr(10)) = 0"), ("digits", "text rlike '[0-9]{4}'")]
SQL_FLAGS = [(n, c.replace("text rlike '[#$%&*]{3}'", "regexp_matches(text, '[#$%&*]{3}')").replace("text rlike '[0-9]{4}'", "regexp_matches(text, '[0-9]{4}')")) for n, c in FLAGS]


@query("quality_gate", "SELECT doc_id, array_to_string(f, ',') AS flags, len(f) AS n_flags, round(greatest(0, 1 - 0.15 * len(f))::DOUBLE, 4) AS score, len(f) >= 2 AS quarantine FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in SQL_FLAGS) + "], lambda x: x IS NOT NULL) AS f FROM documents)")
def quality_gate(t):
    flags = F.filter(F.array(*[F.when(F.expr(c), n) for n, c in FLAGS]), lambda x: x.isNotNull())
    d = t.documents.select("doc_id", flags.alias("f"))
    return d.select("doc_id", F.array_join("f", ",").alias("flags"), F.size("f").cast("long").alias("n_flags"), F.round(F.greatest(F.lit(0.0), 1 - 0.15 * F.size("f")), 4).alias("score"), (F.size("f") >= 2).alias("quarantine"))


@query("near_dupe_first_wins", "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def near_dupe_first_wins(t):
    """First wins by the digest of a chunk; the key may be hot, so it is pre-aggregated, without a window over the group."""
    return t.documents.groupBy("source", F.unhex(F.sha2("text", 256)).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("source_list", "SELECT lang, string_agg(source, '; ' ORDER BY source) AS sources, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def source_list(t):
    return t.documents.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), "; ").alias("sources"), F.countDistinct("source").alias("n"))


@query("eval_text_prep", r"SELECT conv_id, left(trim(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g')), 1500) AS answer, turn FROM conversations WHERE role = 'assistant'")
def eval_text_prep(t):
    x = F.trim(F.regexp_replace(F.regexp_replace("text", r"\[[^\]]*\]", ""), r"\s+", " "))
    return t.conversations.where("role = 'assistant'").select("conv_id", F.substring(x, 1, 1500).alias("answer"), "turn")


@query("rows_from_lines", "SELECT page_id, k, max_by(v, i) AS v FROM (SELECT page_id, i, regexp_extract(l, 'href=\"/([^\"]*)\">([^<]*)', 1) AS k, regexp_extract(l, 'href=\"/([^\"]*)\">([^<]*)', 2) AS v FROM (SELECT page_id, unnest(string_split(html, '<li>')) AS l, generate_subscripts(string_split(html, '<li>'), 1) AS i FROM pages)) WHERE k <> '' GROUP BY 1, 2")
def rows_from_lines(t):
    p = 'href="/([^"]*)">([^<]*)'
    l = t.pages.select("page_id", F.posexplode(F.split("html", "<li>")).alias("i", "l"))  # noqa: E741
    return l.select("page_id", "i", F.regexp_extract("l", p, 1).alias("k"), F.regexp_extract("l", p, 2).alias("v")).where("k <> ''").groupBy("page_id", "k").agg(F.max_by("v", "i").alias("v"))


@query("tag_uncited", "SELECT conv_id, turn, string_agg(CASE WHEN length(s) >= 35 AND regexp_matches(lower(s), 'tion|eau|ung') AND NOT contains(s, '[') THEN s || ' [?]' ELSE s END, '. ' ORDER BY i) AS answer FROM (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS i FROM conversations WHERE role = 'assistant') GROUP BY 1, 2")
def tag_uncited(t):
    tag = lambda s: F.when((F.length(s) >= 35) & F.lower(s).rlike("tion|eau|ung") & ~s.contains("["), F.concat(s, F.lit(" [?]"))).otherwise(s)
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.array_join(F.transform(F.split("text", "\\. "), tag), ". ").alias("answer"))


@query("numeric_claims", "WITH n AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS num FROM documents), s AS (SELECT source, num, min(doc_id) AS a, max(doc_id) AS b FROM n GROUP BY 1, 2) SELECT doc_id, num, a <> b AS supported FROM n JOIN s USING (source, num)")
def numeric_claims(t):
    n = t.documents.select("doc_id", "source", F.explode(F.array_distinct(F.expr("regexp_extract_all(text, '[0-9]{2,}', 0)"))).alias("num"))
    s = n.groupBy("source", "num").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return n.join(s, ["source", "num"]).select("doc_id", "num", (F.col("a") != F.col("b")).alias("supported"))


@query("verdict_alignment", "SELECT doc_id, claimed, supported, claimed > supported AS overclaims FROM (SELECT doc_id, CASE WHEN contains(h, 'tion') THEN 3 WHEN contains(h, 'ing') THEN 2 WHEN contains(h, 'and') THEN 1 ELSE 0 END AS claimed, CASE WHEN contains(b, 'tion') THEN 3 WHEN contains(b, 'ing') THEN 2 WHEN contains(b, 'and') THEN 1 ELSE 0 END AS supported FROM (SELECT doc_id, lower(left(text, 200)) AS h, lower(substring(text, 201)) AS b FROM documents))")
def verdict_alignment(t):
    level = lambda c: F.when(c.contains("tion"), 3).when(c.contains("ing"), 2).when(c.contains("and"), 1).otherwise(0)
    d = t.documents.select("doc_id", level(F.lower(F.substring("text", 1, 200))).alias("claimed"), level(F.lower(F.expr("substring(text, 201)"))).alias("supported"))
    return d.select("*", (F.col("claimed") > F.col("supported")).alias("overclaims"))


@query("direction_check", "SELECT doc_id, count(*) AS lines, sum((up AND down)::INT)::BIGINT AS contradictory FROM (SELECT doc_id, regexp_matches(l, 'tion') AS up, regexp_matches(l, 'ing') AS down FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS l FROM documents)) GROUP BY 1")
def direction_check(t):
    l = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("l"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("l").contains("tion") & F.col("l").contains("ing")).cast("long")).alias("contradictory"))


@query("keyword_group_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'fr' OR list_has_any([contains(text, 'worthless'), contains(text, 'reer'), contains(text, 'eau')], [true])")
def keyword_group_filter(t):
    """Texts with a keyword of the group; an unknown condition (here: fr) has no keywords and keeps all."""
    keys = F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("worthless", "reer", "eau"))))
    return t.documents.where((F.size(keys) == 0) | F.exists(keys, lambda k: F.col("text").contains(k))).select("doc_id", "lang")


@query("token_contains_join", "SELECT doc_id, tok FROM documents, (SELECT DISTINCT split_part(p_name, ' ', 1) AS tok FROM part) WHERE contains(text, tok)")
def token_contains_join(t):
    """Texts that have a name's token in them."""
    found = contains_join(t.documents.select(F.col("doc_id").alias("text_id"), "text"), t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("needle")))
    return found.select(F.col("text_id").alias("doc_id"), F.col("needle").alias("tok"))


LINK_TIERS = (("major", ["tion"]), ("moderate", ["ing"]), ("minor", ["ent"]))


@query("ingredient_links", """WITH e AS (SELECT DISTINCT p_name, unnest(range(1, 3)) AS i, list_sort(list_transform(string_split(p_name, ' '), lambda w: {'n': length(w), 'w': w})) AS ws FROM part),
k AS (SELECT doc_id, lower(text) AS x, p_name, min_by(ws[i].w, i) AS tok FROM documents, e WHERE i <= len(ws) AND contains(lower(text), ws[i].w) GROUP BY 1, 2, 3),
w AS (SELECT doc_id, p_name, tok, substring(x, greatest(instr(x, tok) - 1500, 1), instr(x, tok) + length(tok) + 1500 - greatest(instr(x, tok) - 1500, 1)) AS w FROM k)
SELECT doc_id, p_name, tok, CASE WHEN contains(w, 'tion') THEN 'major' WHEN contains(w, 'ing') THEN 'moderate' WHEN contains(w, 'ent') THEN 'minor' ELSE 'unknown' END AS severity FROM w""")
def ingredient_links(t):
    """Texts with a token of a name, shortest tokens first: the first one that a text has decides the severity."""
    names = t.part.where("p_name is not null").select(F.col("p_name").alias("entity")).distinct()
    tokens = F.transform(F.array_sort(F.transform(F.split("entity", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), lambda x: x["w"])
    texts = t.documents.select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    found = first_tokens(texts, names.withColumn("tokens", tokens)).join(texts, "text_id")
    return found.select(F.col("text_id").alias("doc_id"), F.col("entity").alias("p_name"), F.col("token").alias("tok"), severity(F.col("text"), F.col("token"), tiers=LINK_TIERS).alias("severity"))


MENTIONS = "(SELECT p_partkey, lower(CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, 5) WHEN 2 THEN substring(p_name, 3, 6) WHEN 3 THEN left(p_name, 6) || 'zz' WHEN 4 THEN substring(p_type, 2, 4) ELSE left(p_name, 3) END) AS mention, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS exclude FROM part)"


@query("mention_cascade", f"""WITH m AS (SELECT DISTINCT mention, exclude, trim(mention) AS low FROM {MENTIONS} WHERE length(trim(mention)) >= 4), n AS (SELECT p_name AS name, min(lower(p_type)) AS inn, lower(p_name) AS key FROM part GROUP BY 1),
h AS (SELECT mention, exclude, name, CASE WHEN key = low THEN 1 WHEN name IS NOT DISTINCT FROM exclude THEN NULL WHEN starts_with(key, low) THEN 2 WHEN length(low) >= 6 AND (contains(key, low) OR starts_with(key, low[1:6])) THEN 3 WHEN contains(inn, low) OR contains(key, low) THEN 4 END AS tier FROM m, n),
f AS (SELECT mention, exclude, min(tier) AS tier, min_by(name, tier::VARCHAR || name) AS name FROM h WHERE tier IS NOT NULL GROUP BY 1, 2)
SELECT mention, exclude, name, tier FROM f WHERE name IS DISTINCT FROM exclude""")
def mention_cascade(t):
    """Mentions to names: whole, beginning, part, ingredient; the source's own name is no answer."""
    mention = F.expr("lower(case p_partkey % 6 when 0 then p_name when 1 then left(p_name, 5) when 2 then substring(p_name, 3, 6) when 3 then left(p_name, 6) || 'zz' when 4 then substring(p_type, 2, 4) else left(p_name, 3) end)")
    m = t.part.select(mention.alias("mention"), F.expr("case when p_partkey % 4 = 0 then p_name end").alias("exclude"))
    return mention_nodes(m, t.part.groupBy(F.col("p_name").alias("name")).agg(F.min(F.lower("p_type")).alias("ingredient")))


@query("question_types", "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, 'tion') THEN 'dose' END, CASE WHEN regexp_matches(text, 'eau|ung') THEN 'interaction' END, CASE WHEN regexp_matches(text, '[?]') THEN 'direct' END], lambda x: x IS NOT NULL), ',') AS types FROM conversations WHERE role = 'user'")
def question_types(t):
    kinds = F.array(F.when(F.col("text").rlike("tion"), "dose"), F.when(F.col("text").rlike("eau|ung"), "interaction"), F.when(F.col("text").rlike("[?]"), "direct"))
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.array_join(kinds, ",").alias("types"))


SYNONYMS = [("tion", "action|process"), ("eau", "water"), ("ung", "state"), ("ing", "doing")]


@query("synonym_expand", "SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{k}') THEN '{v}' END" for k, v in SYNONYMS) + "], lambda x: x IS NOT NULL), '|') AS terms FROM conversations WHERE role = 'user'")
def synonym_expand(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat_ws("|", *[F.when(F.col("text").contains(k), v) for k, v in SYNONYMS]).alias("terms"))


@query("list_union_ci", r"SELECT conv_id, string_agg(w, ',' ORDER BY k) AS names FROM (SELECT conv_id, lower(w) AS k, min_by(w, turn * 100000 + i) AS w FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{8,}'), 1) AS i FROM conversations) GROUP BY 1, 2) GROUP BY 1")
def list_union_ci(t):
    w = t.conversations.select("conv_id", "turn", F.posexplode(F.expr("regexp_extract_all(text, '[A-Za-z]{8,}', 0)")).alias("i", "w"))
    w = w.groupBy("conv_id", F.lower("w").alias("k")).agg(F.min_by("w", F.col("turn") * 100000 + F.col("i")).alias("w"))
    return w.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), ",").alias("names"))
