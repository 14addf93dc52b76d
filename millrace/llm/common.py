"""What the operators share: tables cut from their lineage, and vectorised work on the bytes of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where that is unset, in local
    tests, it is a new temporary folder; a cluster without the setting is refused, since its executors would not see it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Writes df; the files of its shuffles go when it is written, and not only when the driver collects garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later stages don't recompute it, and a lost
    executor costs nothing, since the files belong to none."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    write_parquet(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by cut. No plan that is still to run may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.millrace_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Nodes of a plan that gives the same rows in the same partitions whenever it is run.
_STEADY = {"Relation", "LocalRelation", "Project", "Filter", "Range", "LogicalRDD"}
#: Most rows of one number each that are broadcast.
BROADCAST_ROWS = 2_000_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column name that numbers its rows, the same whenever it is read: a plan that isn't a plain read of
    tables is first written to the shared folder."""
    nodes = re.findall(r"^[\s:+\-!]*([A-Za-z]\w*)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    if set(nodes) <= _STEADY:
        return df.withColumn(name, F.monotonically_increasing_id())
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def without_rows(df: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose number (in column name) is in gone, a table made by cut with that one column; drops the
    numbers. Only the numbers are sent, as long as they are few enough."""
    few = gone.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone.hint("merge"), name, "left_anti").drop(name)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker serves many tasks and would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """run (of batches) that gives memory back when its partition is done."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- words of Arrow text columns -------------------------------------------------------------------------------------

#: Bytes of words: digits, a-z and everything that is not ASCII (after A-Z are lower-cased).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Bytes of words between ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit: multiplications, and the upper half onto the lower."""
    shape, h = np.shape(h), np.atleast_1d(np.multiply(h, np.uint64(0xFF51AFD7ED558CCD)))
    for factor in (0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25):
        half = h.reshape(-1).view(np.uint32).reshape(-1, 2)
        half[:, 0] ^= half[:, 1]
        h *= np.uint64(factor)
    half = h.reshape(-1).view(np.uint32).reshape(-1, 2)
    half[:, 0] ^= half[:, 1]
    return h.reshape(shape)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_P, _Q)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW


class Words:
    """The words of some texts, as arrays: start and end (bytes of data), hash (64 bits), of (row), first (of each row
    its first word; one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        is_word = kind[data]
        self.data, self.offsets, self.rows = FOLD[data], offsets, len(offsets) - 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # no word goes on over the end of a text
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = is_word[:-1]
        starts = is_word & (~before | edge[:-1])
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = is_word[1:]
        ends = is_word & (~after | edge[1:])
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = _powers(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
            self._hash = mix((total[self.end] - total[self.start]) * down[self.start])
        return self._hash

    def text(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def hash_word(word: str) -> int:
    """The hash that Words gives to a word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(Words(b, np.array([0, len(b)]), np.ones(256, bool)).hash[0]) if len(b) else 0


def chunks(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, Words]]:
    """(number of the first row, Words) for runs of rows of about limit bytes; a longer text has a run of its own.
    Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    large = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):  # at most 32,768 rows at once
        to = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        to = min(to, row + 32_768, len(texts))
        yield row, Words(data[off[row] : off[to]], off[row : to + 1] - off[row], kind)
        row = to


class Tally:
    """Sums of counts by 64-bit keys, in bounded memory: full() tells that it is time to give out what is there."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        keys, n = (lambda u: (u[0], u[1]))(np.unique(keys, return_counts=True)) if counts is None else (keys, counts)
        self.parts.append((keys, n.astype(np.int64)))
        self.size += len(keys)
        if self.size > self.most and len(self.parts) > 1:
            self.parts = [self.sums()]
            self.size = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([n for _, n in self.parts])[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        return keys[at], np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)

    def full(self) -> bool:
        return self.size > self.most * 0.7 and len(self.parts) == 1

    def clear(self) -> None:
        self.parts, self.size = [], 0


class Lookup:
    """Where in a table of distinct 64-bit keys each of many keys is, by open addressing. Slots hold the keys' places (four
    bytes, two to four slots a key), not the keys: a worker has such tables beside a broadcast model."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys).view(np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.at = keys, np.full(1 << bits, -1, np.int32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            self.probes += 1
            free = self.at[place] < 0
            self.at[place[free]] = left[free]  # of several for one place the last stays
            won = self.at[place] == left
            left, place = left[~won], (place[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key isn't in the table."""
        keys = np.ascontiguousarray(keys).view(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = self._home(keys)
        at = self.at[place]
        out = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        left = np.flatnonzero((out < 0) & (at >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            place[left] = (place[left] + 1) & self.mask
            at = self.at[place[left]]
            hit = (at >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = at[hit]
            left = left[(at >= 0) & ~hit]
        return out.astype(np.int64)
