"""Sharding by sampled splitters: quantiles of a size-weighted key sample bound the ranges, records go to their range.
Ranges are then measured: an overfull one gets splitters from a sample of its own, until none is overfull, and a key that
has more bytes than a group may have gets subranges by record. Ranges are laid end to end and cut into shards of equal bytes."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, free_name, numbered

LEAST_RANGES, ROWS_PER_RANGE, MOST_RANGES, SAMPLE_PER_RANGE = 50, 1_000_000, 16_384, 24
#: A range is overfull with more than so many times its share of the bytes.
OVERFULL = 2.0


def sampled(keyed: DataFrame, step: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and how often each is drawn from keyed (key, size, row): once for every step of its rows' bytes, by a
    hash of the row's number. So total / step keys come to the driver."""
    chance = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("size") / step + chance).cast("int")
    got = keyed.select("key", times.alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times")).toArrow()
    keys, times = got["key"].to_numpy(), got["times"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def quantiles(keys: np.ndarray, times: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 keys that cut a sample into equal parts."""
    if not len(keys):
        return np.zeros(0, np.int64)
    upto = np.cumsum(times)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, "left")
    return keys[np.minimum(at, len(keys) - 1)]


def heavy_keys(keyed: DataFrame, keys: np.ndarray, times: np.ndarray, step: float, limit: float) -> dict[int, int]:
    """The keys whose rows have more than limit bytes together, with these bytes: at most total / limit keys. The sample
    names the candidates, and only these are measured."""
    likely = keys[times * step > limit / 2]
    if not len(likely):
        return {}
    few = F.broadcast(keyed.sparkSession.createDataFrame([(int(k),) for k in likely], "key long"))
    got = keyed.join(few, "key").groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > float(limit))
    return {r["key"]: r["bytes"] for r in got.collect()}


def splitters(keyed: DataFrame, total: int, ranges: int, limit: float = 0) -> np.ndarray:
    """Keys that cut the bytes of keyed (key, size, row) into about equal ranges, measured and subdivided where a range is
    overfull. A key stands among them once, and so lies in one range, however full; only a key of more than limit bytes
    has several, by record, and stands there once more than it has ranges."""
    share = total / ranges
    step = max(1.0, share / SAMPLE_PER_RANGE)
    keys, times = sampled(keyed, step, 11)
    heavy = heavy_keys(keyed, keys, times, step, limit)
    own = [np.full(int(-(-size // share)) + 1, k) for k, size in heavy.items() if size > share]
    cuts = np.unique(quantiles(keys, times, ranges))
    for salt in range(12, 1 << 30):
        light = cuts[~np.isin(cuts, [k[0] for k in own])] if own else cuts
        placed = np.sort(np.concatenate([light, *own]).astype(np.int64))
        ranged = in_ranges(keyed, placed)
        got = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).where((F.col("bytes") > OVERFULL * share) & (F.col("low") < F.col("high"))).toArrow()
        if not got.num_rows:
            break
        full = ranged.join(F.broadcast(ranged.sparkSession.createDataFrame([(int(r),) for r in got["range"].to_pylist()], "range int")), "range", "left_semi")
        keys, times = sampled(full, step, salt)
        more = []
        for low, high, size in zip(got["low"].to_pylist(), got["high"].to_pylist(), got["bytes"].to_pylist()):
            mine = slice(np.searchsorted(keys, low), np.searchsorted(keys, high, "right"))
            more += [quantiles(keys[mine], times[mine], int(-(-size // share))), [high]]  # a full last key gets a range of its own
        new = np.unique(np.concatenate([cuts, *more]).astype(np.int64))
        if len(new) == len(cuts):
            break
        cuts = new
    return placed


def in_ranges(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    """keyed with a column range. A key that is a splitter m > 1 times has m ranges, dealt by the row's hash."""
    names, first, times = (lambda u: (u[0], u[1], u[2]))(np.unique(cuts, return_index=True, return_counts=True)) if len(cuts) else (cuts, cuts, cuts)

    @F.pandas_udf("int")
    def number(key: pd.Series, row: pd.Series) -> pd.Series:
        k = key.to_numpy()
        out = np.searchsorted(cuts, k, "right")
        if len(names):
            at = np.minimum(np.searchsorted(names, k), len(names) - 1)
            heavy = (names[at] == k) & (times[at] > 1)
            out = np.where(heavy, first[at] + 1 + (row.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(times[at] - 1, 1), out)
        return pd.Series(out.astype(np.int32))

    return keyed.withColumn("range", number("key", "row"))


def measured(rows: DataFrame) -> DataFrame:
    """id, size, text_crc32, key (a hash of the text, so that equal texts are neighbours), row. Cut from its lineage."""
    text = F.coalesce("text", F.lit(""))
    return cut(rows.select("id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), "row"))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs.

    Law bytes: shards hold equal bytes, up to the larger of the largest record and 1/50 of a shard. A group of equal texts
    of at most that size lies in one shard; a larger one may be cut, since it would leave shards unequal. slot numbers a shard's records from 0 without gaps.
    A null text has no bytes and counts as empty, null and repeated ids are records like others, ties in the key are
    ordered by id and row; an empty table gives an empty result, and fewer records than shards leave shards empty.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    return _placed(rows, shards).drop("row").withColumnRenamed("id", id_col)


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """What assign_shards gives, and row; rows: id, text, row."""
    all_ = measured(rows)
    total, rows, largest = all_.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(shards * LEAST_RANGES, rows // ROWS_PER_RANGE)))
    limit = float(max(largest, total / shards / 50))
    ranged = in_ranges(all_, splitters(all_, total, ranges, limit))
    order = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_first(), "row")
    group = Window.partitionBy("range", "key")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(
        "*", (F.row_number().over(order) - 1).alias("nth"), (F.sum("size").over(upto) - F.col("size")).alias("before"), F.sum("size").over(group).alias("group"),
    ).withColumn("group_from", F.min("before").over(group))
    placed = cut(placed)
    spans = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))  # at most MOST_RANGES rows
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.coalesce(1).select("range", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("from"))
    whole = F.col("group") <= F.lit(limit)
    middle = F.when(whole, F.col("from") + F.col("group_from") + F.col("group") / 2).otherwise(F.col("from") + F.col("before") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(total, 1))))).cast("int")
    placed = placed.join(F.broadcast(spans), "range").withColumn("shard", shard)
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("low"))  # ranges + shards rows
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("low")).alias("shift"))
    return placed.join(F.broadcast(counts), ["shard", "range"]).select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs, with columns shard and slot, as Parquet folders shard=k. Rows are told apart by number, so ids may
    repeat or be null; columns of docs that have these names already are refused by Spark."""
    row, on = free_name(docs, "row_number"), free_name(docs, "shard_row")
    docs = numbered(docs, row)
    plan = _placed(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.col(row).alias("row")), shards).select(F.col("row").alias(on), "shard", "slot")
    docs.join(plan, F.col(row) == F.col(on)).drop(row, on).write.partitionBy("shard").parquet(path)


def op6_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
