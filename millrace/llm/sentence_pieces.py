"""SentencePiece encoding and decoding through a relational lattice.

The words of a text (runs that no piece goes beyond) are encoded once each for the whole table. A word's substrings of
bounded length are exploded and joined with the piece table; the edges found are grouped by word, and a higher-order
aggregate folds them into the word's segmentation. The public model is a BPE model: its segmentation is that of merges in
the order of the pieces' ranks, which the best sum of scores (Viterbi) doesn't give. So for BPE models the fold applies
the edges by rank to a set of boundaries. For unigram models the fold is Viterbi's.

Texts are read in stretches. Each asks for its distinct words, which are joined with their packed ids; words and texts
of a stretch then meet in one group of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, give_back, lean, numbered

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longest word that the lattice takes: its boundaries are bits of a number. Longer ones are merged by a queue, each once.
LONGEST = 48
#: Bytes of a stretch, but for a longer text, which is one of its own; and the texts of one at most.
STRETCH, STRETCH_TEXTS = 1 << 24, 1 << 16
#: Words with their ids that a task packs for their stretches at once.
ANSWERS = 1 << 18
#: Of zstd, for texts, words and their ids that are sent.
LEVEL = 3


class Pieces:
    """The piece table of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        same = {}
        self.rank = {p: same.setdefault(s, len(same)) for p, s in sorted(self.scores.items(), key=lambda x: -x[1])}
        self.unit = self._unit()

    def _unit(self) -> re.Pattern:
        """A merge needs a piece with both characters at its seam. So a character in no longer piece stands alone, and
        if no piece goes from a letter to another character, nor from any other character to a space mark, a word ends
        there."""
        pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:])}
        joins = {c for pair in pairs for c in pair}
        letters = {c for c in joins if c.isalpha()}
        kind = lambda chars: "".join(map(re.escape, sorted(chars)))
        other = joins - letters - {SPACE}
        if any(a in letters and b not in letters or b == SPACE != a for a, b in pairs) or not letters or not other:
            return re.compile(f"{SPACE}+[^{SPACE}]*")
        rest, letter = kind(other), kind(letters)
        return re.compile(f"{SPACE}*(?:[{rest}]*[{letter}]+|[{rest}]+)|{SPACE}+|[^{SPACE}{rest}{letter}]")

    def units(self, text: str | None) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def ids_of(self, parts: list[str]) -> list[int]:
        out = list(map(self.ids.get, parts))
        if None in out:
            out = [k for p in parts for k in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]
        return out

    @cached_property
    def late(self) -> set[str]:
        """The pieces that the merges of better ranks don't bring to two parts; only these can fit anew after a merge of no
        better rank. Between the two ends of any other piece the better merges were done before that merge, and had left
        nothing but the piece's own. The public model has thirteen, runs of space marks that share one rank."""
        return {p for p, r in self.rank.items() if len(p) > 1 and len(self.cuts(p, r)) != 3}

    def cuts(self, word: str, below: float = float("inf")) -> list[int]:
        """Where a word that is too long for the lattice's bits is cut: a queue of merges, best rank first, leftmost of
        equal ones; only those of ranks below below."""
        after, before, queue = list(range(1, len(word) + 1)), list(range(-1, len(word))), []

        def look(a: int) -> None:
            if a >= 0 and (b := after[a]) < len(word) and (r := self.rank.get(word[a : after[b]])) is not None and r < below:
                heapq.heappush(queue, (r, a, b, after[b]))

        for k in range(len(word) - 1):
            look(k)
        gone = bytearray(len(word))
        while queue:
            _, a, b, end = heapq.heappop(queue)
            if not gone[a] and after[a] == b and b < len(word) and after[b] == end:
                gone[b], after[a], before[end] = 1, end, a
                look(before[a])
                look(a)
        return [*(k for k in range(len(word)) if not gone[k]), len(word)]

    def ids_between(self, word: str, cuts: Sequence[int]) -> list[int]:
        return self.ids_of([word[a:b] for a, b in zip(cuts, cuts[1:])])

    def decode(self, ids: Sequence[int], bare: bool = False) -> str:
        """The text; bare: with its space marks and the one in front."""
        out, raw = [], bytearray()
        if self.byte_of.keys().isdisjoint(ids):
            out, ids = [self.pieces[k] for k in ids], ()
        for k in ids:
            if (b := self.byte_of.get(k)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.pieces[k])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out) if bare else "".join(out).replace(SPACE, " ")[1:]


def segmented(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, mask: bit k is set where the word is cut before its character k, or ends; null for words of more than LONGEST
    characters.

    words: word, one row each. The piece table (its size is the model's) is broadcast, so edges stay where their word is.
    An edge fits if both its ends and one place between them are boundaries: its two parts are pieces as they stand. The
    edges are numbers that sort by rank, then by their beginnings. The fold takes each edge that fits when its turn comes; in
    words with an edge of a late piece, it takes the first fitting edge of all, at most once for each edge."""
    table = words.sparkSession.createDataFrame([(p, r, p in pieces.late) for p, r in pieces.rank.items() if len(p) > 1], "piece string, rank long, late boolean")
    size = F.when(F.length("word") <= LONGEST, F.length("word")).otherwise(1)
    spots = words.where("length(word) > 0").select("word", size.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0)))).alias("s"))
    least = F.when(F.col("s") == 0, 1).otherwise(2)  # the first character stands for its word where no piece is found
    spans = spots.select("word", "s", F.explode(F.sequence(least, F.greatest(least, F.least(F.lit(pieces.longest), F.col("n") - F.col("s"))))).alias("l"))
    subs = spans.select("word", "s", "l", F.substring("word", F.col("s") + 1, F.col("l")).alias("piece"))
    edge = F.col("rank") * 4096 + F.col("s") * 64 + F.col("s") + F.col("l")
    edges = subs.join(F.broadcast(table), "piece", "left").where("rank is not null or s = 0 and l = 1").select("word", edge.alias("edge"), "late")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.max("late").alias("late"))
    start, end = "cast(shiftright(x, 6) & 63 as int)", "cast(x & 63 as int)"
    inner = f"(shiftleft(shiftleft(1L, {end} - {start} - 1) - 1, {start} + 1))"
    ends = f"(shiftright(m, {start}) & shiftright(m, {end}) & 1) = 1"
    fits = f"{ends} and bit_count(m & {inner}) = 1"
    all_ = "shiftleft(1L, length(word) + 1) - 1"
    # st: the boundaries m, and the edges es whose ends both still are; none are left where none fits
    best = f"slice(filter(st.es, x -> {fits.replace('(m', '(st.m')}), 1, 1)"
    after = f"transform(transform({best}, x -> st.m & ~{inner}), m -> struct(m as m, filter(st.es, x -> {ends}) as es))"
    step = f"coalesce(get({after}, 0), struct(st.m as m, slice(st.es, 1, 0) as es))"
    mask = f"aggregate(edges, struct({all_} as m, edges as es), (st, i) -> {step}, st -> st.m)"
    mask = f"if(late, {mask}, aggregate(edges, {all_}, (m, x) -> if({fits}, m & ~{inner}, m)))"
    return grouped.select("word", F.expr(f"case when length(word) <= {LONGEST} then {mask} end").alias("mask"))


def viterbi(edges: DataFrame) -> DataFrame:
    """word, cuts: the path of the best sum of scores, of equal ones the one whose last piece is longest. edges: word,
    n (characters), s, e, score. Characters without an edge of their own must have been given one."""
    best = F.expr(
        """aggregate(array_sort(collect), array(struct(cast(0 as double) as score, array(0) as cuts)),
             (acc, x) -> case when size(acc) <= x.e then concat(acc, array(struct(acc[x.s].score + x.score as score, concat(acc[x.s].cuts, array(x.e)) as cuts)))
               when acc[x.s].score + x.score > acc[x.e].score then concat(slice(acc, 1, x.e), array(struct(acc[x.s].score + x.score as score, concat(acc[x.s].cuts, array(x.e)) as cuts)))
               else acc end)"""
    )
    grouped = edges.groupBy("word", "n").agg(F.collect_list(F.struct("e", "s", "score")).alias("collect"))
    return grouped.withColumn("best", best).select("word", F.element_at("best", -1)["cuts"].alias("cuts"), F.element_at("best", -1)["score"].alias("score"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, rows) of the stretches of a task: of rows id, text, in the order in which they stand."""
    number, held, chars, texts = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        at = 0
        for k, n in enumerate(sizes.to_pylist()):
            if texts and (chars + n > STRETCH or texts >= STRETCH_TEXTS):
                yield number, [*held, batch.slice(at, k - at)]
                number, held, chars, texts, at = number + 1, [], 0, 0, k
            chars, texts = chars + n, texts + 1
        held.append(batch.slice(at))
    if texts:
        yield number, held


def _asked(units: Callable[[str | None], list[str]]):
    """stretch, word: the distinct words of each stretch."""

    def run(batches):
        for number, held in _stretches(batches):
            words: set[str] = set()
            for batch in held:
                for text in batch.column(1):
                    words.update(units(text.as_py()))
            some = sorted(words)
            for k in range(0, len(some), 10_000):
                part = some[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(part, pa.string())], names=["stretch", "word"])

    return run


def _strings(values: pa.Array) -> bytes:
    """Strings in one compressed value; null as a length of -1."""
    sizes = pc.fill_null(pc.binary_length(values), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pc.fill_null(values.cast(pa.binary()), b"")), b"")[0].as_py()
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.int64(len(sizes)).tobytes() + sizes.tobytes() + joined)


def _parts(payload: bytes, kind: pa.DataType) -> list:
    """The values of _strings, as strings or bytes."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int32, n, 8)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.maximum(sizes, 0), out=ends[1:])
    known = pa.array(sizes >= 0)
    return pa.Array.from_buffers(kind, n, [known.buffers()[1], pa.py_buffer(ends), pa.py_buffer(raw)[8 + 4 * n :]]).to_pylist()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stretch, ids, texts (in one value): the texts of each stretch, some at a time."""
    for number, held in _stretches(batches):
        for batch in held:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([_strings(part.column(1))], pa.binary())], names=["stretch", "ids", "texts"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stretch, words, ids (both many in one value) of word, stretch, ids: what a task has for each stretch."""
    held, rows = [], 0

    def out():
        table = pa.Table.from_batches(held)
        stretch = table["stretch"].to_numpy()
        order = np.argsort(stretch, kind="stable")
        table, stretch = table.take(pa.array(order)).combine_chunks(), stretch[order]
        at = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]).tolist()
        for a, b in zip(at, [*at[1:], len(stretch)]):
            part = table.slice(a, b - a).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([stretch[a]]), *[pa.array([_strings(part[c].chunk(0))], pa.binary()) for c in ("word", "ids")]], names=["stretch", "words", "ids"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ANSWERS:
            yield from out()
            held, rows = [], 0
            give_back()
    if rows:
        yield from out()


def _packed(table, digest: bool):
    """word, ids (packed, four bytes each; with digest as _said) of word, mask."""

    def run(batches):
        p = table.value
        for batch in batches:
            out = []
            for word, mask in zip(*[c.to_pylist() for c in batch.columns]):
                cuts = p.cuts(word) if mask is None else [k for k in range(len(word) + 1) if mask >> k & 1]
                ids = p.ids_between(word, cuts)
                out.append(_said(p, word, ids) if digest else np.array(ids, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["word", "ids"])

    return run


def _said(p: Pieces, word: str, ids: list[int]) -> bytes:
    """What a word adds to its texts' digests: its ids, comma-joined; behind them, where some are bytes or decoding doesn't
    give the word back, a semicolon, the number of bytes, a semicolon, and 1 if it does."""
    n_bytes, whole = sum([k in p.byte_of for k in ids]), p.decode(ids, bare=True) == word
    return (",".join(map(str, ids)) + (f";{n_bytes};{int(whole)}" if n_bytes or not whole else "")).encode()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, digest: bool = False) -> DataFrame:
    """id, ids (array<int>), or with digest: id, n_pieces, n_bytes (pieces that are bytes), ids_sha256 (of the ids,
    comma-joined), round_trip (decoding gives the text back). One row per row of docs.

    Ids are those that the model's own library gives. Null and empty texts have no pieces (round_trip: true). Texts with
    the space mark itself don't come back as they were. Repeated rows, and ids, are each encoded. Words of any length are
    encoded whole. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    pieces = Pieces(model)
    docs = numbered(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "row").select("id", "text")  # read twice alike
    table, id_type = sc.broadcast(pieces), docs.select("id").limit(0).toArrow().schema.field(0).type
    asked = cut(docs.mapInArrow(lean(_asked(pieces.units)), "stretch bigint, word string"))
    words = cut(segmented(asked.select("word").groupBy("word").agg(F.lit(1).alias("x")).select("word"), pieces).mapInArrow(lean(_packed(table, digest)), "word string, ids binary"))
    known = cut(asked.join(words.hint("merge"), "word").select("stretch", "word", "ids").mapInArrow(lean(_answers), "stretch bigint, words binary, ids binary"))
    discard(asked, words)

    def run(key, left, right):
        out = encoded(left, right)
        give_back()
        return out

    def encoded(left, right):
        p = table.value
        give_back()
        said: dict = {}
        for ws, xs in zip(right.column("words"), right.column("ids")):
            said.update(zip(_parts(ws.as_py(), pa.string()), _parts(xs.as_py(), pa.string() if digest else pa.binary())))
        texts = (t for payload in left.column("texts") for t in _parts(payload.as_py(), pa.string()))
        names = pa.chunked_array([x.values.cast(id_type) for x in left.column("ids") if len(x)], id_type)
        if not digest:
            said = {w: np.frombuffer(x, np.int32).tolist() for w, x in said.items()}
            ids = [[k for w in p.units(t) for k in said[w]] for t in texts]
            return pa.table({"id": names, "ids": pa.array(ids, pa.list_(pa.int32()))})
        odd = {w: x.split(";") for w, x in said.items() if ";" in x}
        said.update((w, x[0]) for w, x in odd.items())
        columns: list[list] = [[], [], [], []]
        for t in texts:
            words = p.units(t)
            ids = ",".join(map(said.__getitem__, words))
            some = [] if odd.keys().isdisjoint(words) else [odd[w] for w in words if w in odd]
            whole = all(x[2] == "1" for x in some) and SPACE not in (t or "")
            for c, x in zip(columns, (ids.count(",") + bool(ids), sum(int(x[1]) for x in some), hashlib.sha256(ids.encode()).hexdigest(), whole)):
                c.append(x)
        types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.table({"id": names} | {n: pa.array(c, k) for n, c, k in zip(("n_pieces", "n_bytes", "ids_sha256", "round_trip"), columns, types)})

    texts = docs.mapInArrow(lean(_texts), f"stretch bigint, ids array<{kind}>, texts binary")
    out = "n_pieces bigint, n_bytes bigint, ids_sha256 string, round_trip boolean" if digest else "ids array<int>"
    both = texts.groupBy("stretch").cogroup(known.groupBy("stretch"))
    return both.applyInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column text. Null ids give an empty text."""
    table = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: table.value.decode(list(x)) if x is not None and len(x) else "")

    return encoded.withColumn("text", text(ids_col))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
