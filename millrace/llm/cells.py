"""Numbers dealt into shards, as cells: what one stretch of input has for one shard, as packed columns in one value.

A shuffle of single n-grams costs some thirty bytes for each; in cells they take five or six. A shard is what one task
holds at once, and shards are as many as the size asks for, so memory doesn't grow with the input as long as no single state
has more events than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from millrace.llm.common import give_back

#: Numbers that are dealt out at once, and that a shard has on average.
STRETCH, SHARD = 1 << 19, 3 << 18
#: Shards that a task works on, one after the other, where there are enough for all cores.
SHARDS_A_TASK = 4


def shards_for(n: int) -> int:
    return max(1, -(-int(n) // SHARD))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length and of 1, 4 or 8 bytes a number, byte planes apart, so that small numbers pack well. The
    first column (integers, such as rows in their order) goes as the differences of each from the one before."""
    n = len(columns[0])
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    head = np.array([n, len(columns)], np.int64).tobytes() + b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    kinds, pos, out = [raw[16 + 4 * j : 20 + 4 * j].strip().decode() for j in range(k)], 16 + 4 * k, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, pos).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        pos += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


class Dealer:
    """Takes columns of numbers and their shards; gives cells out when there are enough."""

    def __init__(self, shards: int, stretch: int = STRETCH):
        self.shards, self.stretch, self.parts, self.size = shards, stretch, [], 0

    def add(self, shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        if len(shard):
            self.parts.append((shard, columns))
            self.size += len(shard)
        if self.size >= self.stretch:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.size:
            return
        shard = np.concatenate([s for s, _ in self.parts])
        columns = [np.concatenate(c) for c in zip(*[c for _, c in self.parts])]
        self.parts, self.size = [], 0
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        columns = [c[order] for c in columns]
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
            yield int(shard[a]), pack([c[a:b] for c in columns])


def dealt(df: DataFrame, shards: int) -> DataFrame:
    """df (with columns shard and kind) with the rows of each shard together, by kind. A task has several shards, of which
    it holds one at once."""
    tasks = max(min(shards, 2 * df.sparkSession.sparkContext.defaultParallelism), -(-shards // SHARDS_A_TASK))
    return df.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(shard, its rows) of a partition made by dealt; column 0 is the shard. One shard is held at once."""
    now, held = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
            if held and shard[a] != now:
                yield now, held
                held = []
                give_back()
            now = int(shard[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held
    give_back()


def joined(payloads: list[bytes]) -> list[np.ndarray]:
    """The columns of several cells, one after the other."""
    parts, out = [unpack(p) for p in payloads], []
    for _ in range(len(parts[0])):
        out.append(np.concatenate([p.pop(0) for p in parts]))
    return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows told apart by all keys (integers): (a row of each group, the group of each row)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of
