"""Near-duplicate detection by BagMinHash: signatures of weighted Jaccard similarity over multisets of word shingles.

A shingle of weight w takes part with the unit intervals (0,1], (1,2], ... up to w. Intervals are arranged by octaves,
(0,1], (1,2], (2,4], (4,8] ..., each with a Poisson process of a rate equal to its length; every point has a place in its
octave and a component of the signature, and counts if its place is below w. A component keeps its first point. So two
documents agree in a component with a probability of exactly the weighted Jaccard similarity, and as the octaves'
processes are drawn point by point only until they pass the signature's largest value, a document takes about as many
draws as it has shingles.

Documents with equal shingle multisets are one node. Nodes that agree in a band are compared with the band's hub, the
node that shares most with others. Then nodes of a band that are not in their hub's component are held against all
others there: one by one in small bands, by an exact prefix join of shingles in larger ones. So no pair of a band that
could join two components is left out, and a band of thousands of copies costs thousands of comparisons. A comparison
counts the overlap of the two multisets exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ALNUM, Words, chunks, cut, free_name, lean, mix, numbered, without_rows
from millrace.llm.components import components

WORDS, SIMILARITY = 5, 0.8
PRINTS = ["n", "f1", "f2"]
BANDS, ROWS = 25, 5
SIZE = 128
#: Bands of up to so many nodes are compared node by node; both ways are exact.
SMALL = 32
#: Buckets in which shingles are counted to put rare ones first, and the ratio of the classes of multisets' sizes.
BUCKETS, RATIO = 1 << 20, 1.08
BROADCAST_IDS = 2_000_000


def shingles(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit shingle and weight, sorted. A text of fewer than n words, but not none, is one shingle."""
    h, count, first = w.hash, w.count, w.first[:-1]
    of = w.of
    if len(h):
        left = count[of] - (np.arange(len(h)) - first[of])  # words from here to the text's end
    else:
        left = of
    s = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: max(len(h) - k, 0)] = h[k:]
        s = np.where(left > k, mix(s * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1)), s) if k else mix(part + np.uint64(1))
    whole = (left >= n) | ((left == count[of]) & (count[of] < n)) if len(h) else np.zeros(0, bool)
    key = np.sort((of[whole].astype(np.uint64) << np.uint64(48)) | (s[whole] >> np.uint64(16)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    weight = np.diff(np.r_[at, len(key)])
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """rows x size first points; infinite for a row without shingles."""
    sig = np.full(rows * size, np.inf)
    docs, seeds, rates, lows, tops = [], [], [], [], []
    for octave in range(int(weight.max()).bit_length() + 1 if len(weight) else 0):
        low = 0 if octave == 0 else 1 << (octave - 1)
        on = weight > low
        if not on.any():
            break
        docs.append(row[on])
        seeds.append(mix(shingle[on] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(octave)))
        rates.append(np.full(on.sum(), float(max(low, 1))))
        lows.append(np.full(on.sum(), low))
        tops.append(weight[on])
    if not docs:
        return sig.reshape(rows, size)
    doc, seed, rate, low, top = (np.concatenate(x) for x in (docs, seeds, rates, lows, tops))
    # of a long text only points before this can stay, but for one text in 400, which is then drawn in full
    until = size * (np.log(size) + 6) / np.maximum(np.bincount(row, weight, rows), 1)
    _draw(sig, size, doc, seed, rate, low, top, until)
    again = (sig.reshape(rows, size).max(axis=1) > until)[doc]
    if again.any():
        _draw(sig, size, *(x[again] for x in (doc, seed, rate, low, top)), np.full(rows, np.inf))
    return sig.reshape(rows, size)


def _uniform(r: np.ndarray) -> np.ndarray:
    return (r.astype(np.float64) + 0.5) * 2.0**-64


def _draw(sig: np.ndarray, size: int, doc: np.ndarray, seed: np.ndarray, rate: np.ndarray, low: np.ndarray, top: np.ndarray, until: np.ndarray) -> None:
    """Puts the points before until into sig, as long as they can still change it."""
    least = np.exp(-until)[doc]
    least[rate != 1] **= rate[rate != 1]
    go = np.flatnonzero(_uniform(mix(seed)) > least)  # the first point is before until
    doc, seed, rate, low, top = (x[go] for x in (doc, seed, rate, low, top))
    until = until[doc]
    t, done = np.zeros(len(doc)), 0
    while len(doc):
        points = 1 if len(doc) > 4096 else min(256, max(4, 4096 // len(doc)))
        number = np.arange(done, done + points, dtype=np.uint64)
        r = mix(seed[:, None] + number * np.uint64(0x9E3779B97F4A7C15))
        at = np.cumsum(np.concatenate([t[:, None], -np.log(_uniform(r)) / rate[:, None]], axis=1), axis=1)[:, 1:]
        r = mix(r ^ np.uint64(0xA0761D6478BD642F))
        place = low[:, None] + ((r >> np.uint64(40)).astype(np.float64) * 2.0**-24) * rate[:, None]
        cell = doc[:, None] * size + (r & np.uint64(0xFFFFFF)).astype(np.int64) % size
        on = place < top[:, None]
        np.minimum.at(sig, cell[on], at[on])
        t, done = at[:, -1], done + points
        last = sig.reshape(-1, size).max(axis=1)
        go = t < np.minimum(last[doc], until)
        doc, seed, rate, low, top, until, t = (x[go] for x in (doc, seed, rate, low, top, until, t))


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64)
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * rows, b * rows + rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, k])
        out[:, b] = h
    return out


def prints(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each row its number of shingles, and two sums of hashes that tell its multiset."""
    edge, sums = np.searchsorted(row, np.arange(rows + 1)), []
    for salt in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
        total = np.r_[np.uint64(0), np.cumsum(mix(shingle ^ np.uint64(salt)) * weight.astype(np.uint64))]
        sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return np.bincount(row, weight, rows).astype(np.int64), sums


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, row, n (shingles), f1, f2 (of the multiset), bands; of rows id, text, row."""
    for batch in batches:
        for begin, w in chunks(batch.column(1), ALNUM):
            row, shingle, weight = shingles(w)
            sig = signatures(row, shingle, weight, w.rows)
            n, sums = prints(row, shingle, weight, w.rows)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(w.rows + 1, dtype=np.int32) * BANDS), pa.array(bands_of(sig).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, w.rows), batch.column(2).slice(begin, w.rows), pa.array(n), *[pa.array(x) for x in sums], bands],
                names=["id", "row", "n", "f1", "f2", "bands"],
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, weights)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][ia], b[1][ib]).sum()
    return float(common) / float(max(a[1].sum() + b[1].sum() - common, 1))


def _multisets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, w in chunks(texts, ALNUM):
        row, shingle, weight = shingles(w)
        edge = np.searchsorted(row, np.arange(w.rows + 1))
        out += [(shingle[x:y], weight[x:y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return out


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows a, b, text of a, text of b those whose similarity is high enough."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            ok = [overlap(x, y) >= SIMILARITY for x, y in zip(_multisets(part.column(2)), _multisets(part.column(3)))]
            yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def print_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, w in chunks(batch.column(1), ALNUM):
            n, sums = prints(*shingles(w), w.rows)
            yield pa.RecordBatch.from_arrays([pa.array(n), *[pa.array(x) for x in sums], batch.column(1).slice(begin, w.rows)], names=["n", "f1", "f2", "text"])


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, f1, f2, items: the multiset as a set, in which the second, third, ... occurrence of a shingle is another item."""
    for batch in batches:
        for _, w in chunks(batch.column(1), ALNUM):
            row, shingle, weight = shingles(w)
            n, sums = prints(row, shingle, weight, w.rows)
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            items = mix(np.repeat(shingle, weight) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(items.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(n), *[pa.array(x) for x in sums], lists], names=["n", "f1", "f2", "items"])


def _bucket(items: np.ndarray) -> np.ndarray:
    return (items.view(np.uint64) >> np.uint64(44)).astype(np.int64) % BUCKETS


def count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n: of column items, summed up for the partition."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        np.add.at(total, _bucket(batch.column(0).flatten().to_numpy(zero_copy_only=False)), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _classes() -> np.ndarray:
    """Smallest sizes of the classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


def prefixes(counts) -> object:
    """A function from rows node, comp, odd, items to node, comp, odd, n, item, at (its place in the order by counts),
    own, other (classes of its size and of a partner's). Two multisets of n and m items with a similarity of 0.8 share at
    least 4/9 (n + m); if at is the place of the first shared item, they share at most n - at. So an item takes part for a
    class of partners only where that is enough, and the first shared item of such a pair takes part on both sides."""
    low = _classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part, out = batch.slice(begin, 64), []
                for k, items in enumerate(part.column(3)):
                    x = items.values.to_numpy(zero_copy_only=False)
                    times, n = counts.value[_bucket(x)], len(x)
                    order = np.lexsort((x, times))
                    x, times = x[order], times[order]
                    own, *span = (np.searchsorted(low, (n, -(-4 * n // 5), 5 * n // 4), "right") - 1).tolist()
                    for other in range(span[0], span[1] + 1):
                        least = max(int(low[other]), -(-4 * n // 5))
                        at = np.arange(n - -(-4 * (n + least) // 9) + 1)
                        at = at[times[at] > 1]  # others are in no other multiset
                        out.append((np.full(len(at), k), np.full(len(at), n), x[at], at, np.full(len(at), own), np.full(len(at), other)))
                of, *rest = (np.concatenate(c).astype(np.int64) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 6
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(of)) for c in range(3)], *[pa.array(c) for c in rest]], names=["node", "comp", "odd", "n", "item", "at", "own", "other"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (smallest id of the class), class_size, kept (true on one row of a class): one row per row of docs.

    A class is a connected component of links between documents whose multisets of five-word shingles (words: runs of
    ASCII letters and digits, any case, and of other characters) have a weighted Jaccard similarity of at least 0.8.
    Texts of one to four words are one shingle. Null texts and texts without words are classes of their own. Repeated
    rows are in one class, of which one stays. A null id is larger than any other. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row"))
    return _marked(rows).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each class, with all its columns, whatever their names. Rows are told apart by number, so that
    repeated and null ids do no harm."""
    row = free_name(docs, "row_number")
    docs = numbered(docs, row)
    marks = _marked(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.col(row).alias("row")))
    return without_rows(docs, row, cut(marks.where("not kept").select(F.col("row").alias(row))))


def _marked(docs: DataFrame) -> DataFrame:
    """row, id, class_id, class_size, kept; docs: id, text, row."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(lean(features), f"id {kind}, row bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")
    rows = cut(rows.withColumn("none", F.col("id").isNull()))
    nodes = cut(rows.where("n > 0").groupBy(*PRINTS).agg(F.min(F.struct("none", "id", "row")).alias("first"), F.count(F.lit(1)).alias("copies")).select(*PRINTS, F.col("first.row").alias("node"), F.col("first.id").alias("id"), "copies"))
    firsts = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = cut(firsts.select(F.explode("bands").alias("key"), F.col("row").alias("node")))
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = cut(banded.join(counts.hint("merge"), "key"))
    known = crowded.groupBy("node").agg(F.sum("n").alias("known"))
    hubs = crowded.join(known, "node").groupBy("key").agg(F.max(F.struct("known", F.negative("node").alias("node"))).alias("hub")).select("key", F.negative("hub.node").alias("hub"))
    shared = cut(crowded.join(hubs.hint("merge"), "key"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b those that are similar enough. Multisets of which one is smaller than 0.8 of the other can't be."""
        for k in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")), k)
        near = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
        return cut(_verified(docs, nodes, cut(pairs.where(near).select("a", "b"))))

    links = compared(shared.where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    comps = components(links)
    # the nodes of a band that are not in its hub's component
    inside = shared.join(comps.select(F.col("node").alias("l"), "comp"), F.col("node") == F.col("l"), "left").select("key", "n", "node", "hub", F.coalesce("comp", "node").alias("comp"))
    inside = inside.join(comps.select(F.col("node").alias("l"), F.col("comp").alias("of_hub")), F.col("hub") == F.col("l"), "left").select("key", "n", "node", "hub", "comp", (F.col("comp") != F.coalesce("of_hub", "hub")).alias("odd"))
    inside = cut(inside)
    open_ = inside.where("odd").select("key").distinct()
    inside = cut(inside.join(open_.hint("merge"), "key", "left_semi"))
    few = inside.where(F.col("n") <= SMALL)
    pairs = few.where("odd").join(few.select("key", F.col("node").alias("o_node"), F.col("comp").alias("o_comp"), F.col("odd").alias("o_odd")), "key")
    # odd ones with the hub are known, and two odd ones are one pair
    pairs = pairs.where((F.col("comp") != F.col("o_comp")) & (F.col("o_node") != F.col("hub")) & (~F.col("o_odd") | (F.col("node") < F.col("o_node"))))
    more = compared(pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct())
    many = cut(inside.where(F.col("n") > SMALL).groupBy("node").agg(F.first("comp").alias("comp"), F.max("odd").alias("odd")))
    if not many.isEmpty():
        more = more.union(_prefix_joined(docs, nodes, many))
    if not more.isEmpty():
        comps = components(links.union(more))
    classes = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least")
    sizes = classes.groupBy("comp").agg(least, F.sum("copies").alias("class_size"))
    classes = cut(classes.select(*PRINTS, "comp").join(sizes, "comp").select(*PRINTS, F.col("least.id").alias("class_id"), F.col("least.node").alias("stays"), "class_size"))
    grouped = rows.where("n > 0").select("row", "id", *PRINTS).join(classes.hint("merge"), PRINTS).select("row", "id", "class_id", "class_size", (F.col("row") == F.col("stays")).alias("kept"))
    alone = rows.where("n = 0").select("row", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def _read(docs: DataFrame, nodes: DataFrame, some: DataFrame, run, column: str, kind: str) -> DataFrame:
    """node, column: of the nodes in some (node, distinct). Only their texts are read and sent."""
    wanted = cut(nodes.join(some, "node", "left_semi").select(*[F.col(c).alias(f"w_{c}") for c in (*PRINTS, "id", "node")]))
    ids = wanted.select(F.col("w_id").alias("w"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    found = docs.join(ids, F.col("id").eqNullSafe(F.col("w")), "left_semi")
    found = found.select("id", "text").mapInArrow(lean(run), f"n bigint, f1 bigint, f2 bigint, {column} {kind}")
    return cut(found.join(wanted, [found[c] == wanted[f"w_{c}"] for c in PRINTS]).select(F.col("w_node").alias("node"), column).dropDuplicates(["node"]))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b of nodes) those that are similar enough."""
    texts = _read(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), print_texts, "text", "string")
    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean(verify), "a bigint, b bigint")


def _prefix_joined(docs: DataFrame, nodes: DataFrame, many: DataFrame) -> DataFrame:
    """All pairs a, b of nodes of many (node, comp, odd) that are similar enough, in two components, one of them odd."""
    sets = _read(docs, nodes, many.select("node"), elements, "items", "array<bigint>")
    got = sets.select("items").mapInArrow(count_items, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    kind = "node bigint, comp bigint, odd boolean, n bigint, item bigint, at bigint, own bigint, other bigint"
    firsts = cut(many.join(sets, "node").select("node", "comp", "odd", "items").mapInArrow(prefixes(counts), kind))
    others = firsts.select("item", F.col("other").alias("own"), F.col("own").alias("other"), F.col("node").alias("o_node"), F.col("comp").alias("o_comp"), F.col("odd").alias("o_odd"), F.col("n").alias("o_n"), F.col("at").alias("o_at"))
    enough = 9 * F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at")) >= 4 * (F.col("n") + F.col("o_n"))
    pairs = firsts.where("odd").hint("merge").join(others, ["item", "own", "other"]).where((F.col("comp") != F.col("o_comp")) & enough)
    pairs = cut(pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct())
    a, b = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return cut(pairs.join(a, "a").join(b, "b").where(9 * common >= 4 * (F.size("items_a") + F.size("items_b"))).select("a", "b"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
