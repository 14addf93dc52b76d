"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams of a bounded sample of trusted documents are counted by Spark, smoothed, and dealt into shards by the hash of
the n-gram; each shard is a table of bounded size, against which the n-grams of every document are joined where the
documents are. A document's perplexity is held against a limit for its language: a quantile of the perplexities of all
trusted documents which the model has not seen, times a margin. Only the model rests on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NONSPACE, Lookup, chunks, cut, free_name, lean, mix, numbered, without_rows

#: Bound of the sample of trusted documents; every fifth of them isn't learnt from, so that small tables have limits too.
TRUSTED, SHARDS, ORDER = 1500, 8, 3
#: The quantile, the factor on its logarithm's scale (perplexity), and the documents of a language that it takes.
QUANTILE, MARGIN, LEAST = 0.99, 1.5, 30
_END, _START, _K = np.uint64(0x5E4D0F7E9A3B1C27), np.uint64(0x1B2A3C4D5E6F7081), np.uint64(0x9E3779B97F4A7C15)


def grams(w, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Row of each token, hashes of its n-grams of order 1, 2, ... (0: it reaches over the start), and of each token its
    predecessors' words. A text's tokens are its words and an end; one start symbol stands before them."""
    first = w.first + 2 * np.arange(w.rows + 1)
    seq = np.full(first[-1], _END, np.uint64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    seq[inner] = w.hash
    seq[first[:-1]] = _START
    of = np.repeat(np.arange(w.rows), np.diff(first))
    place = np.arange(len(seq)) - first[of]
    out, h = [], np.zeros(len(seq), np.uint64)
    for n in range(order):  # h of order n + 1: the words from n back to here
        back = np.zeros(len(seq), np.uint64)
        back[n:] = seq[: len(seq) - n] if n else seq
        h = np.where(place >= n, mix(h * _K + back + np.uint64(n + 1)), 0) if n else mix(back + np.uint64(1))
        out.append(h)
    real = place > 0
    history = []  # hash of the n words before a token
    for n in range(order - 1):
        x = np.zeros(len(seq), np.uint64)
        x[1:] = out[n][:-1]
        history.append(np.where(place >= n + 1, x, 0)[real])
    return of[real], [x[real] for x in out], history


class KneserNey:
    """shards: of each a table from n-gram to (log10 probability), and from history to log10 of its backoff weight."""

    def __init__(self, counts: list[dict[str, np.ndarray]]):
        """counts[n - 1]: gram, history, lower (the gram without its first word), n; of all n-grams of that order."""
        tables, weights = [], []
        base_p: dict[str, np.ndarray] | None = None
        for order, c in enumerate(counts, 1):
            n = c["n"].astype(float)
            if order < len(counts):  # how many words stand before it; raw counts where only the start does
                up, before = np.unique(counts[order]["lower"], return_counts=True)
                at = Lookup(up)(c["gram"])
                n = np.where(at >= 0, before[at], n)
            times = [max(int((n == k).sum()), 1) for k in (1, 2, 3, 4)]
            y = times[0] / (times[0] + 2 * times[1])
            d = np.array([0.0, *[min(max(k - (k + 1) * y * times[k] / times[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]])
            cut = d[np.minimum(n, 3).astype(int)]
            keys, at = np.unique(c["history"], return_inverse=True)
            total = np.bincount(at, n)
            left = np.bincount(at, np.minimum(cut, n)) / total
            p = np.maximum(n - cut, 0) / total[at]
            if base_p is None:
                lower = np.full(len(p), 1 / (len(p) + 1))
                self.unknown = float(np.log10(left[0] / (len(p) + 1))) if len(left) else 0.0
            else:
                lower = base_p["p"][Lookup(base_p["gram"])(c["lower"])]
            p = p + left[at] * lower
            base_p = {"gram": c["gram"], "p": p}
            tables.append((c["gram"], np.log10(p)))
            if order > 1:
                weights.append((keys, np.log10(np.maximum(left, 1e-12))))
        self.tables, self.weights = [self._deal(*t) for t in tables], [self._deal(*t) for t in weights]

    @staticmethod
    def _deal(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        shard = (keys >> np.uint64(61)).astype(int) % SHARDS
        return [(keys[shard == s], values[shard == s].astype(np.float32)) for s in range(SHARDS)]

    def ready(self) -> None:
        if not hasattr(self, "find"):
            self.find = [[(Lookup(k), v) for k, v in t] for t in (*self.tables, *self.weights)]

    def join(self, table: int, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NaN where there is none, shard by shard."""
        out = np.full(len(keys), np.nan)
        shard = (keys >> np.uint64(61)).astype(int) % SHARDS
        for s, (at, values) in enumerate(self.find[table]):
            mine = np.flatnonzero(shard == s)
            if len(values) and len(mine):
                k = at(keys[mine])
                out[mine] = np.where(k >= 0, values[k], np.nan)
        return out

    def score(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and the log10 probability of the text."""
        self.ready()
        of, found, history = grams(w, len(self.tables))
        p = self.join(0, found[0])
        p[np.isnan(p)] = self.unknown
        for n in range(1, len(self.tables)):
            back = self.join(len(self.tables) + n - 1, history[n - 1])
            p += np.where(np.isnan(back), 0, back)
            higher = self.join(n, found[n])
            p = np.where(np.isnan(higher), p, higher)
        return np.bincount(of, minlength=w.rows), np.bincount(of, p, w.rows)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "find"}


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, w in chunks(batch.column(1), NONSPACE):
            _, found, history = grams(w)
            for n in range(ORDER):
                some = found[n] != 0
                gram, at, k = np.unique(found[n][some], return_index=True, return_counts=True)
                past = history[n - 1][some][at] if n else np.zeros(len(gram), np.uint64)
                lower = _lower(w, n)[some][at] if n else past
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), n + 1, np.int32)), *[pa.array(x.view(np.int64)) for x in (gram, past, lower)], pa.array(k)], names=["ord", "gram", "history", "lower", "n"])


def _lower(w, n: int) -> np.ndarray:
    """The hash of each token's n-gram of order n (one word fewer than order n + 1)."""
    return grams(w, n)[1][n - 1]


def train(docs: DataFrame) -> KneserNey:
    """docs: id, text; a bounded sample."""
    got = docs.mapInArrow(lean(count_grams), "ord int, gram bigint, history bigint, lower bigint, n bigint").groupBy("ord", "gram").agg(F.first("history").alias("history"), F.first("lower").alias("lower"), F.sum("n").alias("n")).toArrow()
    ords = got["ord"].to_numpy()
    columns = {c: got[c].to_numpy().view(np.uint64) for c in ("gram", "history", "lower")} | {"n": got["n"].to_numpy()}
    return KneserNey([{c: v[ords == n] for c, v in columns.items()} for n in range(1, ORDER + 1)])


def perplexities(rows: DataFrame, shared) -> DataFrame:
    """id, row, lang, n_tokens, log10_p, perplexity; rows: id, lang, text, row. shared: a broadcast model."""

    def run(batches):
        for batch in batches:
            for begin, w in chunks(batch.column(2), NONSPACE):
                n, p = shared.value.score(w)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(begin, w.rows) for k in (0, 3, 1)], pa.array(n.astype(np.int64)), pa.array(p), pa.array(10 ** np.minimum(-p / n, 300))], names=["id", "row", "lang", "n_tokens", "log10_p", "perplexity"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, row bigint, lang string, n_tokens bigint, log10_p double, perplexity double")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """id, lang, n_tokens, log10_p, perplexity, most (the limit), keep: one row per row of docs.

    labels: label_id, quality, toxic; trusted are documents of quality 1 that are not toxic (null: not). The sample is
    the TRUSTED of them with the smallest hashes of their ids; four fifths of it are learnt from, and all other trusted
    documents set the limits. A language (null is one) with fewer than LEAST of these takes the limit of all. Null and
    empty texts have one token, the end, and are not kept; a text of any length is one row of work. Equal perplexities
    are kept or not alike: a document on its limit stays. Without trusted documents all others are kept. Repeated rows
    are each judged. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    return _judged(rows, labels.select(F.col(label_id).alias("id"), "quality", "toxic")).drop("row").withColumnRenamed("id", id_col)


def _judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """What judge_quality gives, and row; rows: id, lang, text, row; labels: id, quality, toxic."""
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("id").where("id is not null").distinct()
    sample = trusted.withColumn("o", F.xxhash64(F.col("id"), F.lit(1))).orderBy("o", "id").limit(TRUSTED)
    learnt = cut(sample.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) != 0).select("id"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows.join(F.broadcast(learnt), "id").select("id", "text")))
    judged = cut(perplexities(rows, model))
    model.destroy()
    unseen = trusted.join(F.broadcast(learnt), "id", "left_anti")
    seen = judged.where("n_tokens > 1").join(unseen, "id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("lang"), "perplexity")
    most = (F.percentile("perplexity", F.lit(QUANTILE)) * MARGIN).alias("t_most")
    limits = cut(seen.groupBy(F.col("lang").alias("t_lang")).agg(most, F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).drop("n"))
    limit = F.coalesce("t_most", F.lit(seen.agg(most).first()["t_most"]).cast("double"))
    out = judged.join(F.broadcast(limits), F.coalesce("lang", F.lit("")) == F.col("t_lang"), "left").withColumn("most", limit).drop("t_lang", "t_most")
    keep = (F.col("n_tokens") > 1) & (F.col("most").isNull() | (F.col("perplexity") <= F.col("most")))
    return out.withColumn("keep", keep)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns, whatever their names. Rows are told apart by
    number: only the numbers of rejected rows are sent."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    marks = _judged(docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.col(row).alias("row")), labels.select(F.col(label_id).alias("id"), "quality", "toxic"))
    return without_rows(docs, row, cut(marks.where("not keep").select(F.col("row").alias(row))))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
