"""Target-distribution importance resampling: documents whose hashed 1- and 2-grams look like a target's are drawn more often.

Two passes over Arrow batches. In the first every task counts the buckets of its features with np.bincount into one vector,
and treeReduce adds the vectors up; what reaches the driver is a few vectors of BUCKETS numbers, however many documents there
are. The gains of the buckets go out as a broadcast, and the second pass sums them by document with a weighted bincount.
Noise from a hash of the id makes the draw a sample without replacement: the highest scores are the drawn documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, Words, chunks, cut, lean
from millrace.llm.ranks import in_order

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Words of up to so many bytes are hashed together; longer ones one by one.
TOGETHER = 48


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_TABLE = _table()


def _over_zeros() -> np.ndarray:
    """[n, k, b]: the state that n zero bytes make of the state whose k-th byte is b, others 0. CRC-32 is linear: that of a
    state is the xor of those of its bytes."""
    out = np.zeros((TOGETHER + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, TOGETHER + 1):
        out[n] = _TABLE[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_ZEROS = _over_zeros()


def _carried(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after n zero bytes each."""
    b = state.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    return _ZEROS[n, 0, b[:, 0]] ^ _ZEROS[n, 1, b[:, 1]] ^ _ZEROS[n, 2, b[:, 2]] ^ _ZEROS[n, 3, b[:, 3]]


ONES = np.uint32(0xFFFFFFFF)


def _states(w: Words) -> np.ndarray:
    """CRC-32 states (before the last xor) of all words, byte place by byte place."""
    size = w.end - w.start
    order = np.argsort(-np.minimum(size, TOGETHER + 1), kind="stable")
    longest = int(np.searchsorted(-size[order], -TOGETHER, "left"))  # words over TOGETHER come first
    state = np.full(len(size), ONES)
    for k in order[:longest].tolist():
        state[k] = np.uint32(zlib.crc32(w.data[w.start[k] : w.end[k]])) ^ ONES
    order = order[longest:]
    start, size, now = w.start[order], size[order], np.full(len(order), ONES)
    for j in range(TOGETHER):
        live = int(np.searchsorted(-size, -j, "left"))  # those of more than j bytes
        if not live:
            break
        now[:live] = _step(now[:live], w.data[start[:live] + j].astype(np.uint32))
    state[order] = now
    return state


def features(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every 1-gram and 2-gram: CRC-32 of its UTF-8 bytes, modulo buckets."""
    one, of, size = _states(w), w.of, w.end - w.start
    pair = np.flatnonzero(of[1:] == of[:-1]) + 1 if len(of) else np.zeros(0, np.int64)  # words with one before them
    before = _step(one[pair - 1], np.full(len(pair), 32, np.uint32))
    n = size[pair]
    short = n <= TOGETHER
    two = np.empty(len(pair), np.uint32)
    at, m = pair[short], n[short]
    # the second word from the state of the first: both are carried over its bytes, apart from what its own bytes give
    two[short] = _carried(before[short], m) ^ one[at] ^ _carried(np.full(len(at), ONES), m)
    for k in np.flatnonzero(~short).tolist():
        two[k] = np.uint32(zlib.crc32(w.data[w.start[pair[k]] : w.end[pair[k]]], int(before[k] ^ ONES))) ^ ONES
    return np.concatenate([of, of[pair]]), (np.concatenate([one, two]) ^ ONES).astype(np.int64) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, w in chunks(batch.column(0), ALNUM):
                total += np.bincount(features(w, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(docs[text_col]).mapInArrow(lean(count), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, row, n_features, weight (floored mean of gains, none: 0) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select(docs[id_col].alias("id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight")).schema

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, w in chunks(batch.column(1), ALNUM):
                of, bucket = features(w, len(g))
                n[first : first + w.rows] = np.bincount(of, minlength=w.rows)
                total[first : first + w.rows] = np.bincount(of, weights=g[bucket], minlength=w.rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "row", "n_features", "weight"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(lean(weigh), schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: its id, n_features, weight, score, rank (null: not drawn).

    The words of a text are its runs of letters a-z (A-Z are lower-cased), digits and all that isn't ASCII. Of the N rows
    with at least least_words words the floor(percent * N / 100) highest scores are drawn; of equal scores the smaller id,
    then the earlier row. score is weight plus Gumbel noise from sha256("seed:id"), so a rerun draws the same rows. Null and
    empty texts have no features and weight 0. A null id has the noise of "seed:" and stands behind all others; repeated ids
    share their noise. With an empty target, every gain favours buckets that docs rarely have. An empty table gives an empty
    result. Other columns aren't read. A feature's sum is exact as long as a document's gains add up to less than 2^53.

    The k-th score is found in a histogram of scores: gains are bounded, so there are at most some 10^5 different scores,
    whatever the number of rows. Only rows down to it are sorted, by ranges.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    drift = F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    got = cut(weighted(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + drift))
    enough = F.col("n_features") >= 2 * least_words - 1
    per = got.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, n = per["score"].to_numpy(), per["n"].to_numpy()
    order = np.argsort(-score)
    upto = np.cumsum(n[order])
    k = int(percent * int(n.sum()) // 100)
    if not k:
        return got.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    limit = int(score[order][np.searchsorted(upto, k, "left")])
    near = enough & (F.col("score") >= limit)
    ranked = in_order(got.where(near), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()], "nth")
    drawn = ranked.select("id", "n_features", "weight", "score", F.when(F.col("nth") < k, F.col("nth") + 1).alias("rank"))
    rest = got.where(~near).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
OP12_SQL = rf"""
WITH t AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS tab FROM (SELECT unnest(range(0, 256))::BIGINT AS b)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
wanted AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM q),
b AS (SELECT f, {_CRC} % 10000 AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM grams UNION ALL SELECT f FROM wanted)), t),
s AS (SELECT b, count(*) AS s FROM grams JOIN b USING (f) GROUP BY 1),
u AS (SELECT b, count(*) AS t FROM wanted JOIN b USING (f) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM grams) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN u USING (b)),
e AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM grams JOIN b USING (f) JOIN g USING (b) GROUP BY 1),
x AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS enough, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN e USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE enough)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM x WHERE enough) THEN rank END AS rank FROM x LEFT JOIN k USING (r)
"""
