"""Conversation prefix trie by an LCP-aware merge sort.

Conversations become strings of turn digests. They are dealt into ranges of their order; a task sorts what comes to it in
runs, each with the longest common prefix (LCP) of every string and the one before, and merges the runs with a loser tree
that compares by LCP first, so that shared turns are not compared again. Along the merged stream the nodes of the current
path lie on a stack: the LCP of the next string says which of them are finished, and these are given out. Only the nodes on
the first and last path of a range may have members in other ranges; they go on, as paths with sums, to the same stack one
level up, where a task has the edges of FAN ranges, until one task has all that are left. So a task holds a range of bounded
size or FAN edges, and a group of equal or commonly begun conversations, however large, is spread over ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, lean

#: Bytes of a turn's digest; bytes of strings in a range; ranges whose edges one task merges; most edge nodes broadcast.
TURN, RANGE_BYTES, FAN, FEW = 16, 4 << 20, 256, 200_000
NONE = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that a and b have in common at their beginning; the first known ones are."""
    at, end, step = known * TURN, min(len(a), len(b)), TURN
    while at < end:
        if a[at : at + step] == b[at : at + step]:
            at += step
            step *= 2
        elif step == TURN:
            break
        else:
            step = TURN
    return min(at, end) // TURN


class Run:
    """A sorted run: strings with their ids and sizes, and of each string the LCP with the one before."""

    def __init__(self, rows: list[tuple[bytes, int, bytes]]):
        self.rows = sorted(rows, key=lambda r: r[:2])
        self.lcps = [0, *(lcp(a[0], b[0]) for a, b in zip(self.rows, self.rows[1:]))]
        self.at = 0


def merged(runs: list[Run]) -> Iterator[tuple[int, tuple[bytes, int, bytes]]]:
    """(LCP with the row before, row) of all runs in order, by a loser tree. Each run's head has its LCP with the last row
    given out: the head with the longer one is the smaller, and only at a tie are turns compared, from there on."""
    k = len(runs)
    heads: list = [(0, r.rows[0], i) if r.rows else None for i, r in enumerate(runs)]

    def duel(a, b):
        """(winner, loser); the loser's LCP becomes that with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        n = lcp(a[1][0], b[1][0], a[0])
        next_a, next_b = (x[1][0][n * TURN : (n + 1) * TURN] for x in (a, b))  # nothing is there where a string ends
        if (next_a, a[1][1]) <= (next_b, b[1][1]):
            return a, (n, *b[1:])
        return b, (n, *a[1:])

    losers: list = [None] * k

    def play(node: int):
        if node >= k:
            return heads[node - k]
        win, losers[node] = duel(play(2 * node), play(2 * node + 1))
        return win

    win = play(1) if k > 1 else (heads[0] if k else None)
    while win is not None:
        yield win[0], win[1]
        run = runs[i := win[2]]
        run.at += 1
        win = (run.lcps[run.at], run.rows[run.at], i) if run.at < len(run.rows) else None
        node = (i + k) >> 1
        while node:
            win, losers[node] = duel(win, losers[node])
            node >>= 1


class Node:
    __slots__ = ("children", "edge", "ends", "far", "kids", "leaves", "low", "n", "saved", "size")

    def __init__(self, size: int, edge: bool):
        #: far: ids of members that end here are in the chunks of a lower level; edge: on the first path of the task
        self.size, self.edge, self.far, self.low, self.n, self.kids, self.leaves, self.saved = size, edge, False, NONE, 0, 0, 0, 0
        self.ends: list[int] = []
        self.children: list[tuple] = []


def names(key: bytes) -> list[bytes]:
    """The ids of the nodes on a path, the root's first."""
    out = [hashlib.blake2b(b"root", digest_size=TURN).digest()]
    for at in range(0, len(key), TURN):
        out.append(hashlib.blake2b(out[-1] + key[at : at + TURN], digest_size=TURN).digest())
    return out


NODE, OPEN, EDGE, ENDS = range(4)
SCHEMA = "kind int, part long, place int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, payload binary"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("place", pa.int32()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("payload", pa.binary())])


class Stack:
    """The nodes of the current path; finished ones go to out, as rows of SCHEMA. top: nothing lies outside of this task."""

    def __init__(self, part: int, top: bool):
        self.part, self.top, self.out, self.first, self.key = part, top, [], None, b""
        self.path: list[Node] = []
        self.names: list[bytes] | None = None  # of the current path, where rows carry them
        self.left: dict[int, Node] = {}

    def add(self, key: bytes, sizes: np.ndarray, shared: int) -> list[Node]:
        """Goes on to a path, of which shared turns are those of the last one; its nodes, the root first."""
        if self.first is None:
            self.first, shared = key, 0
            self.path = [Node(0, not self.top)]
            edge = not self.top
        else:
            edge = False
            while len(self.path) > shared + 1:
                self.pop()
        for d in range(len(self.path), len(key) // TURN + 1):
            self.path.append(Node(int(sizes[d - 1]), edge))
        self.key = key
        return self.path

    def row(self, node: Node, depth: int, name: bytes | None) -> tuple:
        sha = None if node.far else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY
        return (node.low, depth, node.n, node.kids, node.leaves, node.saved, sha, name)

    def give(self, rows: list[tuple], parent: int | None, name: bytes | None) -> None:
        kind = NODE if name is None else OPEN
        self.out += [(kind, self.part, None, low, depth, parent, n, kids, leaves, saved, sha, own, name, None) for low, depth, n, kids, leaves, saved, sha, own in rows]

    def pop(self) -> None:
        depth, node = len(self.path) - 1, self.path.pop()
        if node.edge:
            self.left[depth] = node
            return
        self.close(node, depth)
        up = self.path[-1]
        up.n, up.low, up.kids = up.n + node.n, min(up.low, node.low), up.kids + 1
        up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
        up.children.append(self.row(node, depth, self.names[depth] if self.names else None))

    def close(self, node: Node, depth: int) -> None:
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size if depth else 0
        self.give(node.children, node.low, None)

    def finish(self) -> None:
        if self.first is None:
            return
        if self.top:
            while len(self.path) > 1:
                self.pop()
            self.close(root := self.path[0], 0)
            self.give([self.row(root, 0, self.names[0] if self.names else None)], None, None)
            return
        last = {d: node for d, node in enumerate(self.path) if not node.edge}
        first = self.left | {d: node for d, node in enumerate(self.path) if node.edge}
        for place, (key, nodes) in enumerate(((self.first, first), (self.key, last))):
            if not nodes:
                continue
            ids = names(key)
            for d, node in nodes.items():
                self.give(node.children, None, ids[d])
                if node.ends:
                    self.out.append((ENDS, self.part, None, *[None] * 8, ids[d], None, ",".join(map(str, node.ends)).encode()))
            low = min(nodes)
            sums = np.array([(x.size, x.low, x.n, x.kids, x.leaves, x.saved, x.far or bool(x.ends)) for x in (nodes[d] for d in range(low, len(key) // TURN + 1))], np.int64)
            sizes = np.array([self.sizes_of(first, last, d) for d in range(1, len(key) // TURN + 1)], np.int64) if place else sums[1:, 0]
            self.out.append((EDGE, self.part, place, None, low, *[None] * 6, key, sizes.tobytes(), sums.tobytes()))

    @staticmethod
    def sizes_of(first: dict[int, Node], last: dict[int, Node], d: int) -> int:
        return (last[d] if d in last else first[d]).size


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _grown(stack: Stack, least: int = 20_000) -> Iterator[pa.RecordBatch]:
    if len(stack.out) >= least:
        rows, stack.out = stack.out, []
        for at in range(0, len(rows), 20_000):
            yield _batch(rows[at : at + 20_000])


def nodes_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of conversations (conv_id, key, sizes): finished nodes, and what goes on to the next level."""
    runs = []
    for b in batches:
        if b.num_rows:
            runs.append(Run(list(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist()))))
    stack = Stack(TaskContext.get().partitionId(), False)
    for shared, (key, conv, sizes) in merged(runs):
        end = stack.add(key, np.frombuffer(sizes, "<i8"), shared)[-1]
        end.n, end.low = end.n + 1, min(end.low, conv)
        end.ends.append(conv)
        yield from _grown(stack)
    stack.finish()
    yield from _grown(stack, 1)


def nodes_of_edges(top: bool):
    """The same of edges, which come in order, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for b in batches:
            for group, key, low, sizes, sums in zip(*[b.column(c).to_pylist() for c in ("group", "node", "depth", "parent", "payload")]):
                if stack is None or stack.part != group:
                    if stack is not None:
                        stack.finish()
                        yield from _grown(stack, 1)
                    stack = Stack(group, top)
                path = stack.add(key, np.frombuffer(sizes, np.int64), lcp(stack.key, key))
                stack.names = names(key)
                for node, (_, least, n, kids, leaves, saved, far) in zip(path[low:], np.frombuffer(sums, np.int64).reshape(-1, 7).tolist()):
                    node.low, node.n, node.kids = min(node.low, least), node.n + n, node.kids + kids
                    node.leaves, node.saved, node.far = node.leaves + leaves, node.saved + saved, node.far or bool(far)
                yield from _grown(stack)
        if stack is not None:
            stack.finish()
            yield from _grown(stack, 1)

    return run


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 of chunks of ids (node, payload), sorted by node and range: a chunk is held at a time."""
    node, sha, done = None, None, []
    for b in batches:
        for name, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != node:
                if sha:
                    done.append((node, sha.hexdigest()))
                node, sha = name, hashlib.sha256(chunk)
            else:
                sha.update(b",")
                sha.update(chunk)
    if sha:
        done.append((node, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "sha"])


def trie(strings: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per distinct beginning of strings (conv_id: long, key: digests of TURN bytes a turn, sizes: a long a turn):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is told by conv_id and depth: it is the beginning of that conversation, so its text can be looked up. Rows that
    repeat an id count as members of their own. An empty table gives an empty result, without a root."""
    spark = strings.sparkSession
    strings = cut(strings)
    total = strings.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0)).alias("b")).first()["b"]
    ranges = max(1, -(-total // range_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 16))))
    level = cut(strings.select("conv_id", "key", "sizes").repartitionByRange(int(ranges), "key", "conv_id").mapInArrow(lean(nodes_of_range), SCHEMA))
    chunks, found = level.where(F.col("kind") == ENDS), [level]
    while True:
        edges = level.where(F.col("kind") == EDGE).withColumn("group", F.floor(F.col("part") / FAN).cast("long"))
        groups = edges.agg(F.max("group").alias("g")).first()["g"]
        top = not groups
        level = cut(edges.repartition("group").sortWithinPartitions("group", "part", "place").select("group", "node", "depth", "parent", "payload").mapInArrow(lean(nodes_of_edges(top)), SCHEMA))
        found.append(level)
        if top:
            break
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.where(F.col("kind").isin(NODE, OPEN))
    met = cut(rows.where("node is not null").select("node", F.col("conv_id").alias("up")))  # nodes that lay on an edge
    ends = cut(chunks.select("node", "payload", "part").repartition("node").sortWithinPartitions("node", "part").select("node", "payload").mapInArrow(lean(hashed), "node binary, sha string"))
    few = lambda d: F.broadcast(d) if d.count() <= FEW else d.hint("merge")
    rows = rows.join(few(met.withColumnRenamed("node", "parent")), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return rows.join(few(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha")).select(columns)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, digest (of role and text, null as empty), size (code points of the text). Texts go no further.
    Rows without a conversation belong to none and are left out."""
    c = conversations
    role, text = F.coalesce(c[role_col], F.lit("")), F.coalesce(c[text_col], F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return c.where(c[conv_col].isNotNull()).select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].alias("turn"), F.substring(F.unhex(F.sha2(whole, 256)), 1, TURN).alias("digest"), F.length(text).cast("long").alias("size"))


def strings(turned: DataFrame, home: str = "conv_id", heads=lambda conv: 0) -> DataFrame:
    """conv_id, key, sizes of turns, in the order of turn (null first; ties by digest). A conversation begins with the first
    heads(id) turns of conversation home (an expression of conv_id), and goes on with its own after as many; home's
    conversations lie in one partition, with the one they begin with before the others, so each is read once. A task holds
    one conversation and the head of another, TURN + 8 bytes a turn."""

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, head, parts = None, None, (b"", b""), []

        def done() -> tuple[int, bytes, bytes]:
            nonlocal base, head
            key, sizes = b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)
            home_, conv = now
            if base != home_:
                base, head = home_, (b"", b"")
            if conv == home_:
                head = (key[: MOST_HEAD * TURN], sizes[: MOST_HEAD * 8])
                return conv, key, sizes
            h = heads(conv)
            return conv, head[0][: h * TURN] + key[h * TURN :], head[1][: h * 8] + sizes[h * 8 :]

        for b in batches:
            home_, conv, size = (b.column(c).to_numpy() for c in (0, 1, 3))
            digests = b"".join(b.column(2).to_pylist())
            at = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (home_[1:] != home_[:-1])]) if len(conv) else np.zeros(0, int)
            out = []
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(conv)]):
                if now is not None and now != (int(home_[a]), int(conv[a])):
                    out.append(done())
                    parts = []
                now = (int(home_[a]), int(conv[a]))
                parts.append((digests[a * TURN : z * TURN], size[a:z].astype("<i8").tobytes()))
            if out:
                yield _strings(out)
        if now is not None:
            yield _strings([done()])

    def _strings(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], names=["conv_id", "key", "sizes"])

    own = turned.select(F.expr(home).alias("home"), "conv_id", "digest", "size", "turn")
    dealt = own.repartition("home").sortWithinPartitions("home", F.col("conv_id") != F.col("home"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return dealt.select("home", "conv_id", "digest", "size").mapInArrow(lean(rebuilt), "conv_id long, key binary, sizes binary")


#: Turns of a home conversation that others may begin with.
MOST_HEAD = 64


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are: what trie() gives.

    Turns are in the order of turn_col, null first, ties by digest; null roles and texts are empty. Rows without a
    conversation are left out. Turns are equal if role and text are, by the first 16 bytes of their SHA-256. Very long texts
    only leave their digest; a conversation takes 24 bytes a turn in one task. Other columns aren't read."""
    return trie(strings(turns(conversations, conv_col, turn_col, role_col, text_col)))


def heads_of(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % 6


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(strings(turns(conversations), "conv_id - conv_id % 100", heads_of))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 's': size}} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS home, {_CRC} % 6 AS h FROM o),
r AS (SELECT h.conv_id, CASE WHEN home = h.conv_id THEN h.own ELSE coalesce(o.own, [])[1:h] || h.own[h + 1:] END AS p FROM h LEFT JOIN o ON home = o.conv_id),
b AS (SELECT conv_id, len(p) AS l, unnest(range(0, len(p) + 1)) AS d, p FROM r),
n AS (SELECT p[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256, (count(*) - 1) * coalesce(any_value(p[d].s), 0) AS saved FROM b GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
u AS (SELECT p[1:e] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (p) LEFT JOIN f g ON g.d = f.d - 1 AND g.p = f.p[1:f.d - 1]
"""
