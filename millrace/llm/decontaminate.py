"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton reads the words of a document and keeps the length of the longest suffix read that occurs in an item.
Where that length reaches the window length, or a shorter whole item ends, the words are marked. The automaton is walked
only over runs of words that all occur in items (in any other place it is in its start state), and a run shorter than
every window is skipped; both leave the result as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, Lookup, chunks, cut, free_name, hash_word, lean, numbered

WINDOW = 10
#: Words of items that go into one automaton; more items are gone through in blocks.
BLOCK_WORDS = 400_000


class Automaton:
    """Generalised suffix automaton over word sequences. ids[s], for states that a window ends in, are the items that
    have the window; short[s] maps a length to the items which are, as a whole, the suffix of that length."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        self.window, self.next, self.link, self.len = window, [{}], [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.ids: list[set[int] | None] = [None] * len(self.next)
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, words in items:
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    at = self.at(state, window)
                    self.ids[at] = (self.ids[at] or set()) | {item}
            if 0 < len(words) < window:
                self.short.setdefault(self.at(state, len(words)), {}).setdefault(len(words), set()).add(item)
        shorts = [n for x in self.short.values() for n in x]
        self.least = min([window, *shorts])
        # every state's short items along its suffix links, so that one look tells all that end here
        self.ends: list[tuple[tuple[int, frozenset], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            own = tuple((n, frozenset(x)) for n, x in self.short.get(s, {}).items())
            self.ends[s] = own + self.ends[self.link[s]]

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def step(self, state: int, length: int, w: str) -> tuple[int, int]:
        """The state and matching length after one more word."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.len[state]
        return (nxt[state][w], length + 1) if w in nxt[state] else (0, 0)

    def at(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (from, to) of windows that occur in words, and the items that have them."""
        state, length, spans, found = 0, 0, [], set()
        for k, w in enumerate(words, 1):
            state, length = self.step(state, length, w)
            if length >= self.window:
                spans.append((k - self.window, k))
                found |= self.ids[self.at(state, self.window)] or set()
            for n, items in self.ends[state] if length else ():
                if n <= length:
                    spans.append((k - n, k))
                    found |= items
        return spans, found


def words_of(text: str | None) -> list[str]:
    return [w.text(k) for _, w in chunks(pa.array([text or ""]), ALNUM) for k in range(len(w.start))]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[str]]]]:
    """The items, a block of about BLOCK_WORDS words at a time; one block is on the driver at once."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    yield block


def marks(rows: DataFrame, block: list[tuple[str, list[str]]]) -> DataFrame:
    """id, row, n_words, hit (runs of words hit, as numbers from, to, from, to, ...), items (sorted); rows: id, text, row."""
    shared = rows.sparkSession.sparkContext.broadcast(Automaton(block))
    vocabulary = np.unique(np.array([hash_word(w) for w in {w for _, ws in block for w in ws}], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, in_items = shared.value, Lookup(vocabulary)
        for batch in batches:
            for row, w in chunks(batch.column(1), ALNUM):
                known = in_items(w.hash) >= 0
                same = np.zeros(len(known), bool)
                same[1:] = known[1:] & known[:-1]
                first = w.first[:-1]
                same[first[first < len(known)]] = False
                starts = np.flatnonzero(known & ~same)
                stop = np.flatnonzero(np.r_[~same[1:], True]) + 1 if len(known) else starts
                ends = stop[np.searchsorted(stop, starts, "right")] if len(starts) else starts
                hits: dict[int, tuple[list, set]] = {}
                for a, b in zip(starts.tolist(), ends.tolist()):
                    if b - a >= automaton.least:
                        got, items = automaton.scan([w.text(k) for k in range(a, b)])
                        if got:
                            doc = int(np.searchsorted(w.first, a, "right")) - 1
                            old = hits.setdefault(doc, ([], set()))
                            old[0].extend((a + x, a + y) for x, y in got)
                            old[1].update(items)
                pairs, items = [], []
                for doc in range(w.rows):
                    merged: list[list[int]] = []
                    for x, y in sorted(hits[doc][0]) if doc in hits else ():
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    zero = int(w.first[doc])
                    pairs.append([v - zero for m in merged for v in m])
                    items.append(sorted(hits[doc][1]) if doc in hits else [])
                out = [batch.column(0).slice(row, w.rows), batch.column(2).slice(row, w.rows), pa.array(w.count, pa.int64()), pa.array(pairs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "row", "n_words", "hit", "items"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, row bigint, n_words bigint, hit array<int>, items array<string>")


def _hits(rows: DataFrame, blocks: Iterable[list[tuple[str, list[str]]]]) -> DataFrame:
    """What marks gives, over all blocks; rows: id, text, row. Hits of several blocks are put together by row."""
    parts = []
    for block in blocks:
        if parts:
            parts[-1] = cut(parts[-1])  # one automaton is in use at once
        parts.append(marks(rows, block))
    if len(parts) == 1:
        return parts[0]
    parts[-1] = cut(parts[-1])
    hit = None
    for p in parts:
        some = p.where("size(hit) > 0").select("row", "hit", "items")
        hit = some if hit is None else hit.unionByName(some)
    runs = F.array_sort(F.flatten(F.collect_list(F.expr("transform(sequence(0, size(hit) - 2, 2), k -> struct(hit[k] as a, hit[k + 1] as b))"))))
    hit = hit.groupBy("row").agg(runs.alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = """aggregate(runs, cast(array() as array<int>), (out, x) -> case
        when size(out) > 0 and x.a <= element_at(out, -1) then concat(slice(out, 1, size(out) - 1), array(greatest(element_at(out, -1), x.b)))
        else concat(out, array(x.a, x.b)) end)"""
    hit = hit.select("row", F.expr(merged).alias("hit"), "items")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    return parts[0].select("id", "row", "n_words").join(hit, "row", "left").select("id", "row", "n_words", none("hit", "int"), none("items", "string"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs.

    Null and empty texts have no words, and no hits; an empty benchmark hits nothing. Items without words are left out;
    repeated items count once by id. Ids of docs may repeat or be null: hits belong to rows, told apart by number, also
    where the items take several automata. Other columns are not read. An empty table gives an empty result.
    """
    rows = numbered(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "row")
    n_hit = F.expr("aggregate(hit, cast(0 as bigint), (a, x) -> x - a)")  # of pairs from, to: to - (from - sum)
    items = F.array_sort("items")
    return _hits(rows, blocks_of(benchmark, item_col, item_text)).select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def _without(text: str, runs: Iterable[tuple[int, int]]) -> str:
    """text without the words numbered from, to - 1 of each run and what stands between them."""
    (_, w), *_ = chunks(pa.array([text]), ALNUM, 1 << 62)
    raw, keep, pos = text.encode(), [], 0
    for a, b in runs:
        keep.append(raw[pos : w.start[a]])
        pos = int(w.end[b - 1])
    return b"".join([*keep, raw[pos:]]).decode()


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = 0.5) -> DataFrame:
    """docs without the words of test items: runs of hit words are taken out of the text, until no window of an item is
    left; a document of which hit words are the share coverage or more at first goes. All columns stay as they are,
    n_chars follows the text if there is such a column.

    Null and empty texts stay. Repeated rows, and null or repeated ids, are treated row by row. With more items than one
    automaton takes, hits of all are found first, then the text is cut once, then looked at again: coverage is that of
    all items together, so results don't depend on the blocks.
    """
    n_chars = "n_chars" if "n_chars" in docs.columns else None
    blocks = [*islice(blocks_of(benchmark, item_col, item_text), 2)]
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(blocks[0]))
        return docs.mapInArrow(lean(_remover(shared, docs.columns.index(text_col), docs.columns.index(n_chars) if n_chars else None, coverage)), docs.schema)
    row, schema = free_name(docs, "row_number"), docs.schema
    docs = numbered(docs, row)
    changed, left, again = None, docs.select(docs[text_col].alias("text"), F.col(row).alias("row")), False

    def cut_out(batches):
        for batch in batches:
            texts = [_without(t, _pairs(h)) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    while True:
        hits = cut(_hits(left.select(F.col("row").alias("id"), "text", "row"), blocks_of(benchmark, item_col, item_text)).where("size(hit) > 0").select("row", "n_words", "hit"))
        if hits.isEmpty():
            break
        size = F.expr("aggregate(hit, cast(0 as bigint), (a, x) -> x - a)")
        if not again:
            gone = cut(hits.where(size >= F.lit(coverage) * F.col("n_words")).select(F.col("row").alias(row)))
            hits = hits.where(size < F.lit(coverage) * F.col("n_words"))
        left = cut(left.join(hits.select("row", "hit"), "row").select("row", "text", "hit").mapInArrow(cut_out, "row bigint, text string"))
        changed = left if changed is None else cut(changed.join(left.select("row"), "row", "left_anti").unionByName(left))
        again = True
    if not again:
        return docs.drop(row)
    new = changed.select(F.col("row").alias("new_row"), F.col("text").alias("new_text"))
    docs = docs.join(gone.hint("merge"), row, "left_anti").alias("d").join(new.alias("new"), F.col(f"d.{row}") == F.col("new.new_row"), "left")
    text = F.when(F.col("new.new_row").isNotNull(), F.col("new.new_text")).otherwise(F.col(f"d.{text_col}"))
    size = lambda c: F.when(F.col("new.new_row").isNotNull(), F.length("new.new_text")).otherwise(F.col(f"d.{c}"))
    return docs.select(*[(text if c == text_col else size(c).cast(schema[c].dataType) if c == n_chars else F.col(f"d.`{c}`")).alias(c) for c in schema.names])


def _remover(shared, at: int, n_chars: int | None, coverage: float):
    def clean(automaton: Automaton, text: str) -> str | None:
        again = False
        while True:
            (_, w), *_ = [*chunks(pa.array([text]), ALNUM, 1 << 62)] or [(0, None)]
            spans, _ = automaton.scan([w.text(k) for k in range(len(w.start))])
            if not spans:
                return text
            runs: list[list[int]] = []
            for a, b in sorted(spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            if not again and sum(b - a for a, b in runs) >= coverage * len(w.start):
                return None
            text, again = _without(text, runs), True

    def run(batches):
        automaton = shared.value
        in_items = Lookup(np.unique(np.array([hash_word(w) for w in automaton.next[0]], np.uint64)))
        for batch in batches:
            texts, keep, changed = batch.column(at), np.ones(batch.num_rows, bool), {}
            for row, w in chunks(texts, ALNUM):
                known = np.r_[0, np.cumsum(in_items(w.hash) >= 0)]
                n = automaton.least
                full = known[n:] - known[:-n] == n if len(known) > n else np.zeros(0, bool)
                for doc in np.unique(np.searchsorted(w.first, np.flatnonzero(full), "right") - 1).tolist():
                    old = texts[row + doc].as_py()
                    new = clean(automaton, old)
                    if new is None:
                        keep[row + doc] = False
                    elif new != old:
                        changed[row + doc] = new
            if changed:
                values = texts.to_pylist()
                for k, v in changed.items():
                    values[k] = v
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, texts.type))
                if n_chars is not None:
                    sizes = batch.column(n_chars).to_pylist()
                    for k, v in changed.items():
                        sizes[k] = len(v)
                    batch = batch.set_column(n_chars, batch.schema.field(n_chars), pa.array(sizes, batch.column(n_chars).type))
            yield batch.filter(pa.array(keep))

    return run


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len(w[i:i + {WINDOW - 1}]) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, n, item FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
