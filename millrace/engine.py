"""The library as one object: search, answer, ingest, evaluate, and reports on the corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import checks as K
from millrace.operators import models as M
from millrace.operators import search as S
from millrace.operators.fanout import CRITICAL, fan_out
from millrace.sources.tables import append_history, append_new, read_chunks

#: Score floor, what an exact target adds, contexts and characters of each that an evaluation takes, and its bands.
FLOOR, BOOST, CONTEXTS, CONTEXT_CHARS, GOOD, FAIR, LOW = 0.50, 0.05, 9, 4000, 0.75, 0.60, 0.5
STEP, QUARANTINE_FLAGS = 0.15, 2


def citation(name: Column, section: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit(" | Madde "), section, F.lit("]"))


def prompt(question: Column, contexts: Column) -> Column:
    """The question under the contexts (array of name, section, text), each under its citation."""
    parts = F.transform(contexts, lambda c: F.concat(citation(c["name"], c["section"]), F.lit("\n"), c["text"]))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n\nSoru: "), question)


def extract(question: Column, contexts: Column) -> Column:
    """An answer without a model: the first sentence of each of the first three contexts, with its citation."""
    first = lambda c: F.concat(F.get(F.split(F.trim(c["text"]), r"(?<=[.!?])\s+"), F.lit(0)), F.lit(" "), citation(c["name"], c["section"]))
    return F.concat(F.lit("## SONUÇ\n"), F.array_join(F.transform(F.slice(contexts, 1, 3), first), "\n"))


def with_sources(answer: Column, contexts: Column) -> Column:
    """answer with its list of sources: a list that is there gives way to the distinct names of the contexts, in order."""
    names = F.array_distinct(F.transform(contexts, lambda c: F.concat(F.lit("- "), c["name"], F.lit(" | Madde "), c["section"])))
    body = F.rtrim(F.get(F.split(answer, r"\n*## KAYNAKLAR"), F.lit(0)))
    return F.concat(body, F.lit("\n\n## KAYNAKLAR\n"), F.array_join(names, "\n"))


def evaluated(records: DataFrame) -> DataFrame:
    """records (id, question, answer, contexts, truth) with lexical stand-ins for a judge's metrics: faithfulness (the share
    of the answer's tokens that the contexts have), utilization (of the contexts' first ones that the answer has) and
    recall (of the truth's tokens that the contexts have), their mean, and whether any is low."""
    some = F.transform(F.slice("contexts", 1, CONTEXTS), lambda c: F.when(F.length(c) > CONTEXT_CHARS, F.concat(F.substring(c, 1, CONTEXT_CHARS), F.lit("…"))).otherwise(c))
    d = records.withColumn("all", F.array_join(some, " "))
    d = d.withColumn("faithfulness", M.overlap(F.col("answer"), F.col("all"))).withColumn("recall", M.overlap(F.col("truth"), F.col("all")))
    d = d.withColumn("utilization", M.overlap(F.get(some, F.lit(0)), F.col("answer"))).drop("all")
    three = [F.col(c) for c in ("faithfulness", "utilization", "recall")]
    known = F.filter(F.array(*three), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 4))
    return d.withColumn("mean", mean).withColumn("low", F.exists(known, lambda x: x < LOW))


def verdict(scored: DataFrame) -> DataFrame:
    """metric means (four digits; nulls and NaN left out), their mean, and its band."""
    ok = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 4).alias(c)
    d = scored.agg(ok("faithfulness"), ok("utilization"), ok("recall"))
    d = d.withColumn("overall", F.round((F.col("faithfulness") + F.col("utilization") + F.col("recall")) / 3, 4))
    return d.withColumn("band", F.when(F.col("overall") >= GOOD, "good").when(F.col("overall") >= FAIR, "fair").otherwise("poor"))


@dataclass
class Engine:
    """chunks: chunk_id, name, section, text, vec, flags (array). Models are callables (see operators.models)."""

    spark: SparkSession
    chunks: DataFrame
    embed: M.Embedder | None = None
    score: M.Scorer | None = None
    answer_with: M.Answerer | None = None
    imagine: M.Answerer | None = None

    def search(self, questions: DataFrame, k: int = M.KEPT, sections=None, names=None, flags=None) -> DataFrame:
        """q, query, item, name, section, text, score, rank: vector and BM25 ranks of questions (q, text, and vec where there
        is no embedder), fused; items found by words only have no similarity and fall under the floor like all below it.
        The similarity, with the boost for wanted names, orders the pool that is reranked; a base chunk is left out where a
        better one of its section came first. Chunks without one of flags are left out, but for critical sections."""
        asked = M.hypothetical(questions, "text", self.imagine)
        if self.embed is not None:
            asked = M.embedded(asked, "search_text", self.embed, M.QUERY, "vec")
        tests = S.where(sections, names)
        if flags:
            tests = tests & (F.col("section").isin(*CRITICAL) | F.arrays_overlap("flags", F.array(*map(F.lit, flags))))
        corpus = self.chunks.where(tests)
        dense = S.vector_search(asked.select("q", F.col("vec").alias("q_vec")), corpus.select(F.col("chunk_id").alias("item"), "vec"), M.POOL)
        words = self.chunks.select(F.col("chunk_id").alias("item"), "text", "section", "name")
        sparse = S.bm25_search(questions.select("q", "text"), words, M.POOL, sections, names)
        found = S.fuse(dense, sparse).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 4)).where(F.col("score") >= FLOOR)
        found = found.join(words, "item").join(questions.select("q", F.col("text").alias("query")), "q")
        boost = F.when(F.col("name").isin(list(names)), BOOST).otherwise(0.0) if names else F.lit(0.0)
        w = W.partitionBy("q").orderBy(F.round(F.least(F.lit(1.0), F.col("score") + boost), 6).desc(), F.col("fused").desc(), "item")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= M.POOL)
        best = M.reranked(found.drop("score"), self.score, M.POOL, M.POOL)
        return self._once(best, k)

    def retrieve(self, plans: DataFrame, k: int = M.KEPT) -> DataFrame:
        """The same for the plans of questions (q, plan, text, name, sections, flags, kinds, and vec where there is no
        embedder): all searches of all plans in one scan, see operators.fanout."""
        asked = plans if self.embed is None else M.embedded(plans, "text", self.embed, M.QUERY, "vec")
        part = F.regexp_extract(F.col("chunk_id").cast("string"), "_(part[0-9]+)_", 1)
        corpus = self.chunks.select(F.col("chunk_id").alias("item"), "name", "section", part.alias("part"), "vec", "text", "flags")
        pool = fan_out(asked.withColumnRenamed("vec", "q_vec"), corpus).drop("score")
        pool = pool.join(corpus.select("item", "text"), "item").join(plans.groupBy("q").agg(F.min_by("text", "plan").alias("query")), "q")
        return M.reranked(pool, self.score, M.POOL, k)

    @staticmethod
    def _once(found: DataFrame, k: int) -> DataFrame:
        """Without base chunks (ids with no part) of a section of which a part came before."""
        is_part = F.col("item").cast("string").rlike("_part[0-9]+_")
        w = W.partitionBy("q", "name", "section").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        seen = F.coalesce(F.max(is_part.cast("int")).over(w), F.lit(0)) == 1
        kept = found.withColumn("drop", seen & ~is_part).where("not drop").drop("drop")
        return kept.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("rank"))).where(F.col("rank") <= k)

    def answer(self, questions: DataFrame, **how) -> DataFrame:
        """q, query, answer, format: answers out of what search finds, checked, with their sources."""
        found = self.search(questions, **how)
        chunk = F.struct("rank", "section", "name", "text")
        packed = found.groupBy("q", "query").agg(F.array_sort(F.collect_list(chunk)).alias("c"))  # at most k chunks a question
        packed = packed.withColumn("contexts", F.transform("c", lambda c: F.struct(c["section"].alias("section"), c["name"].alias("name"), c["text"].alias("text"))))
        if self.answer_with is None:
            said = packed.withColumn("answer", extract(F.col("query"), F.col("contexts")))
        else:
            said = M.answered(packed.withColumn("prompt", prompt(F.col("query"), F.col("contexts"))), "prompt", self.answer_with)
        done = K.checked(said, "answer", "query", "contexts")
        return done.select("q", "query", with_sources(F.col("answer"), F.col("contexts")).alias("answer"), "format")

    def ingest(self, folder: str, table: str, flags: Callable[[DataFrame], Column] | None = None) -> DataFrame:
        """Reads the JSON documents of a folder, sends chunks with too many flags to table-rejects and appends the others
        that table doesn't have; gives status and n."""
        chunks = read_chunks(self.spark, folder)
        bad = flags(chunks) if flags else F.array_compact(F.array(F.when(F.length(F.trim("text")) < 20, "short"), F.when(F.col("section").isNull(), "no_section")))
        marked = chunks.withColumn("problems", bad).withColumn("quality", F.greatest(F.lit(0.0), 1 - STEP * F.size("problems")))
        rejected = marked.where(F.size("problems") >= QUARANTINE_FLAGS)
        n_bad = append_new(rejected, f"{table}-rejects", "chunk_id")
        n_new = append_new(marked.where(F.size("problems") < QUARANTINE_FLAGS), table, "chunk_id")
        return self.spark.createDataFrame([("added", n_new), ("quarantined", n_bad)], "status string, n long")

    def evaluate(self, records: DataFrame, history: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(scored records, verdict); the verdict goes to the history where one is named."""
        scored = evaluated(records)
        end = verdict(scored)
        if history:
            append_history(end, history)
        return scored, end

    def health(self) -> DataFrame:
        return self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("name").alias("names"))

    def stats(self) -> DataFrame:
        by = lambda c: self.chunks.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), "key", "n")
        return by("name").unionByName(by("section")).orderBy("kind", "key")

    def quarantined(self, table: str) -> DataFrame:
        """name, file, problems of the rejects; the name is the file's stem up to the first word with a digit."""
        stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
        words = F.split(F.translate(stem, "_", " "), " ")
        first = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike("[0-9]"))
        upto = F.coalesce(F.get(first, F.lit(0))["i"], F.size(words))
        return self.spark.read.parquet(f"{table}-rejects").select(F.array_join(F.slice(words, 1, upto), " ").alias("name"), "file", "problems").distinct()
