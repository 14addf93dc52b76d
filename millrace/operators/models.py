"""Models as callables: embeddings, rerankers, answers and extractions. Each has a default that needs no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import tokens

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]
Answerer = Callable[[str], str]
PASSAGE, QUERY = "passage: ", "query: "
#: Seconds between calls, attempts and the base of the wait after a failed one.
PAUSE, ATTEMPTS, BASE = 2.1, 4, 2.0
POOL, KEPT = 30, 15


def embedded(df: DataFrame, text: str, embed: Embedder, prefix: str = PASSAGE, name: str = "embedding") -> DataFrame:
    """df with the embeddings of a text column (with a prefix, as the model was trained), a batch at a time. A null text is
    an empty one."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed([prefix + (t or "") for t in texts])])

    return df.withColumn(name, run(F.col(text)))


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that a text has: the default score of a pair."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def reranked(found: DataFrame, score: Scorer | None = None, pool: int = POOL, kept: int = KEPT) -> DataFrame:
    """found (q, query, item, text, rank) with a score of four digits, ranked anew: of the first pool of each query the best
    kept. Equal scores keep their order. A scorer that fails leaves the order as it was, with score null."""
    some = found.where(F.col("rank") <= pool)
    if score is None:
        scored = some.withColumn("score", F.round(overlap(F.col("query"), F.col("text")), 4))
    else:

        @F.pandas_udf("double")
        def run(query: pd.Series, text: pd.Series) -> pd.Series:
            try:
                return pd.Series([round(float(s), 4) for s in score(list(zip(query, text)))])
            except Exception:
                return pd.Series([None] * len(query), dtype=float)

        scored = some.withColumn("score", run("query", "text"))
    w = W.partitionBy("q").orderBy(F.col("score").desc_nulls_last(), "rank")
    return scored.withColumn("new", F.row_number().over(w)).where(F.col("new") <= kept).drop("rank").withColumnRenamed("new", "rank")


def with_retries(call: Answerer, pause: float = PAUSE, attempts: int = ATTEMPTS, base: float = BASE, sleep: Callable[[float], None] = time.sleep) -> Answerer:
    """call, at most once every pause seconds, again after base ** n seconds where it fails; the last failure is raised."""
    last = [float("-inf")]

    def run(prompt: str) -> str:
        for n in range(attempts):
            sleep(max(0.0, pause - (time.monotonic() - last[0])))
            last[0] = time.monotonic()
            try:
                return call(prompt)
            except Exception:
                if n + 1 == attempts:
                    raise
                sleep(base**n)
        raise ValueError("attempts must be 1 or more")

    return run


def answered(prompts: DataFrame, prompt: str, answer: Answerer, name: str = "answer") -> DataFrame:
    """prompts with an answer column; a prompt whose calls all fail has null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return answer(t or "")
            except Exception:
                return None

        return texts.map(one)

    return prompts.withColumn(name, run(F.col(prompt)))


def hypothetical(questions: DataFrame, question: str, write: Answerer | None = None, name: str = "search_text") -> DataFrame:
    """questions with the text to search by: a document that write makes up for it, else the question."""
    if write is None:
        return questions.withColumn(name, F.col(question))
    return answered(questions, question, write, name).withColumn(name, F.coalesce(name, question))
