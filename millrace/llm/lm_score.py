"""Language-model scoring with a weighted backoff automaton.

States are the empty history, all words and all pairs of words of the training text; an arc reads a word, a failure arc
leads from a history to the next shorter one at the price of its backoff weight. There is no cutoff: every n-gram of the
training text is an arc, so that the automaton grows with the corpus. It is never in one place: its states are dealt into
shards. A token of a document is an event (its two predecessors and itself), which goes to the shard of its state, finds
its arc or the failure arc there, and goes on along the failure arc; what it picks up is summed by document. Events of
training texts are what the shards count, so counting and scoring take one shuffle.

The states of a pair of words and of the second of them lie in one shard, and those of a very frequent second word in
shards of their own by pair; its single state is then dealt by the next word. Only a bounded table of frequent words is
broadcast; the price of any other word in the empty history is found in the shard of that word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.cells import Dealer, by_shard, dealt, groups, joined, shards_for, unpack
from millrace.llm.common import NONSPACE, Lookup, Tally, Words, chunks, cut, discard, mix

END, START = np.uint64(0x5E4D0F7E9A3B1C27), np.uint64(0x1B2A3C4D5E6F7081)
#: Least share of all tokens of a word with a short code. Its inverse bounds the broadcast; no result rests on it.
WORD_SHARE, ORDER = 2.5e-7, 3
#: Events from which on a word with a short code counts as hot. No result rests on it.
HOT = 1 << 18
#: Sums by document that a task holds at once.
MERGED = 3 << 18
#: An n-gram's count less this goes to its arc, the rest of the mass to the failure arc.
DISCOUNT = 0.6


def held_out(ids: Column) -> Column:
    """crc32 of the id as text mod 10 is 0; never for null."""
    return F.coalesce(F.crc32(ids.cast("string")) % 10 == 0, F.lit(False))


def with_ends(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end token; where each text begins (and one more entry)."""
    first = w.first + np.arange(w.rows + 1)
    out = np.full(first[-1], END, np.uint64)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    out[inner] = w.hash
    return out, first


def _emit(tally: Tally, learnt: Tally) -> Iterator[pa.RecordBatch]:
    for t, what in ((tally, "seen"), (learnt, "n")):
        keys, n = t.sums()
        zero = pa.array(np.zeros(len(n), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *((pa.array(n), zero) if what == "n" else (zero, pa.array(n)))], names=["key", "n", "seen"])
        t.clear()


def count_words(batches):
    """key, n (in training texts), seen (in all): of columns held, text."""
    seen, learnt = Tally(1_500_000), Tally(1_500_000)
    for batch in batches:
        held = batch.column(0).to_numpy(zero_copy_only=False)
        for row, w in chunks(batch.column(1), NONSPACE, 1 << 20):
            tokens, first = with_ends(w)
            out = np.repeat(held[row : row + w.rows], np.diff(first))
            learnt.add(tokens[~out])
            if out.any():
                seen.add(tokens[out])
            if learnt.full() or seen.full():
                yield from _emit(seen, learnt)
    yield from _emit(seen, learnt)


@dataclass
class Model:
    """words: sorted hashes of frequent words and the start symbol; counts: of them in training texts; events: in all."""

    words: np.ndarray
    counts: np.ndarray
    events: np.ndarray
    tokens: int = 0
    distinct: int = 0
    discount: float = 0.5
    unknown: float = 0.0
    logp: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "by_code")}  # built where they are needed

    def ready(self) -> None:
        """codes by rank: counts, probabilities and whether hot, in the order of codes."""
        if not hasattr(self, "at"):
            order = np.argsort(-self.events, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.at, self.by_code = (Lookup(self.words), rank), (self.counts[order], self.p1(self.counts[order]), self.events[order] >= HOT)

    def code(self, tokens: np.ndarray) -> np.ndarray:
        """Of a frequent word its rank by count, of others the hash with the sign bit set (so no code is a rank too)."""
        self.ready()
        at = self.at[0](tokens)
        return np.where(at >= 0, self.at[1][at], (tokens | np.uint64(1 << 63)).view(np.int64))

    def p1(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words in the empty history."""
        return np.where(counts > 0, np.maximum(counts - self.discount, 1e-9) / max(self.tokens, 1), 10**self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 0.1) - np.log10(self.tokens + 0.1 * (self.distinct + 1))

    @property
    def pad(self) -> int:
        """What stands for the first word of a pair where there is none."""
        return len(self.words)

    def read(self, w: Words, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Row of each token; codes of the two words before it and its own. The first is pad where no pair stands before
        the token, and everywhere for order 2."""
        tokens, first = with_ends(w)
        word, starts = self.code(tokens), first[:-1]
        one, two = np.empty_like(word), np.full(len(word), self.pad)
        one[1:] = word[:-1]
        one[starts] = self.code(np.array([START]))[0]
        if order > 2:
            two[1:] = one[:-1]
            two[starts] = self.pad
        return np.repeat(np.arange(w.rows), np.diff(first)), [two, one, word]


def train(docs: DataFrame, word_share: float = WORD_SHARE) -> tuple[Model, DataFrame]:
    """Frequent words with what holds for all, and the table key, n, seen of all words. docs: id, text."""
    id_, text = docs.columns
    counted = docs.select(held_out(F.col(id_)).alias("held"), F.col(text).alias("text")).mapInArrow(count_words, "key bigint, n bigint, seen bigint")
    words = cut(counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") + F.col("seen")).alias("events")))
    count = lambda k: F.sum((F.col("n") == k).cast("long"))
    row = words.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long")), count(1), count(2), F.sum("events")).first()
    total, distinct, ones, twos, events = (int(x or 0) for x in row)
    got = words.where(F.col("events") >= word_share * events).toArrow()
    keys, n, seen = got["key"].to_numpy(), got["n"].to_numpy(), got["events"].to_numpy()
    end = keys.view(np.uint64) == END
    keys, n, seen = np.r_[keys.view(np.uint64), START], np.r_[n, n[end].sum()], np.r_[seen, seen[end].sum()]
    order_ = np.argsort(keys)
    model = Model(keys[order_], n[order_], seen[order_], total, distinct)
    model.discount = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones and twos else 0.5))
    model.unknown = float(np.log10(model.discount * max(distinct, 1) / total if total else 1.0))
    model.logp = np.log10(model.p1(model.counts))
    return model, words


#: Kinds of rows: documents; cells for the shards of a hot word's single state; cells for the shards of words without a
#: short code; cells of sums for the shards of documents.
DOCS, NEXT, ROOT, PART = 0, 1, 2, 3
NAMES = ["shard", "kind", "payload", "row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"]


class Out:
    """Makes record batches of cells and documents."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind

    def cells(self, kind: int, cells) -> Iterator[pa.RecordBatch]:
        for shard, payload in cells:
            yield self._batch(1, {"shard": pa.array([shard], pa.int32()), "kind": pa.array([kind], pa.int32()), "payload": pa.array([payload], pa.binary())})

    def docs(self, shards: int, row: np.ndarray, **columns) -> pa.RecordBatch:
        n = len(row)
        return self._batch(n, {"shard": pa.array((row % shards).astype(np.int32)), "kind": pa.array(np.full(n, DOCS, np.int32)), "row": pa.array(row)} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    def _batch(self, n: int, given: dict) -> pa.RecordBatch:
        kinds = dict(zip(NAMES, [pa.int32(), pa.int32(), pa.binary(), pa.int64(), self.kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]))
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, t) for k, t in kinds.items()], names=NAMES)


def _spread(*codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = mix(h + c.view(np.uint64) + np.uint64(1))
    return h


def events(shared, order: int, shards: int):
    """Of columns id, held, text: a row for each text (known and base only of words with a short code), and cells row,
    learnt, u, v, w, n: the n-grams of each text."""

    def run(batches):
        model: Model = shared.value
        model.ready()
        count, _, hot = model.by_code
        part, seen, dealer = TaskContext.get().partitionId(), 0, Dealer(shards)
        for batch in batches:
            out = Out(batch.schema.field(0).type)
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for begin, w in chunks(batch.column(2), NONSPACE, 1 << 20):
                of, grams = model.read(w, order)
                word = grams[2]
                short = word >= 0
                c = np.where(short, count[np.where(short, word, 0)], 0)
                rows = (part << 36) + seen + np.arange(w.rows)
                sum_ = lambda x: np.bincount(of, x, w.rows)
                yield out.docs(
                    shards, rows, id=batch.column(0).slice(begin, w.rows), held_out=batch.column(1).slice(begin, w.rows), n_tokens=np.bincount(of, minlength=w.rows).astype(np.int64),
                    n_known=sum_(c > 0).astype(np.int64), base_score=sum_(np.where(short, model.base(c), 0.0)),
                )
                _, at, n = np.unique(_spread(of, *grams), return_index=True, return_counts=True)
                back = np.argsort(at)
                at, n = at[back], n[back]
                u, v, word = (g[at] for g in grams)
                is_hot = (v >= 0) & hot[np.where(v >= 0, v, 0)]
                shard = (np.where(is_hot, _spread(v, u), _spread(v)) % np.uint64(shards)).astype(np.int64)
                learnt = ~held[begin + of[at]]
                yield from out.cells(NEXT, dealer.add(shard, [rows[of[at]], learnt.astype(np.uint8), u, v, word, n.astype(np.int32)]))
                seen += w.rows
        yield from Out(kind_of.value).cells(NEXT, dealer.flush())

    class kind_of:  # the type of ids, for cells given out last
        value = pa.null()

    def typed(kind: pa.DataType):
        kind_of.value = kind
        return run

    return typed


def _share(count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an arc has of its own, and the price of the failure arc. A history that the training text doesn't have costs
    nothing to leave."""
    some = total > 0
    t = np.where(some, total, 1)
    return np.where(some, np.maximum(count - DISCOUNT, 0) / t, 0.0), np.where(some, kinds * DISCOUNT / t, 1.0)


def _arcs(history: tuple, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each event the count of its arc (history, word), its history's arcs' counts and their number; n: how often the
    training text has the event."""
    first, of = groups(*history, word)
    count = np.bincount(of, n, len(first))
    _, state = groups(*[h[first] for h in history])
    states = int(state.max()) + 1 if len(state) else 0
    total, kinds = np.bincount(state, count, states), np.bincount(state, count > 0, states)
    return count[of], total[state][of], kinds[state][of]


class Sums:
    """Sums by document, as cells for the documents' shards: row, known, base, score. Those of all of a task's shards are
    put together, as far as MERGED sums go."""

    def __init__(self, out: Out, shards: int):
        self.out, self.shards, self.dealer, self.parts, self.size = out, shards, Dealer(shards), [], 0

    def add(self, row: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._keep(self._summed(row, known, base, score))
        if self.size > MERGED:
            self._merge()
            if self.size > MERGED // 2:
                yield from self._deal()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            yield from self._deal()
        yield from self.out.cells(PART, self.dealer.flush())

    @staticmethod
    def _summed(row: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        rows, of = np.unique(row, return_inverse=True)
        return [rows, *(np.bincount(of, x, len(rows)) for x in values)]

    def _keep(self, part: list[np.ndarray]) -> None:
        if len(part[0]):
            self.parts.append(part)
            self.size += len(part[0])

    def _merge(self) -> None:
        if len(self.parts) > 1:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts, self.size = [], 0
            self._keep(self._summed(*columns))

    def _deal(self) -> Iterator[pa.RecordBatch]:
        rows, known, base, score = self.parts.pop()
        self.size = 0
        yield from self.out.cells(PART, self.dealer.add(rows % self.shards, [rows, np.rint(known).astype(np.int64), base, score]))


class Ends:
    """What is done with events that have come to the empty history: those of words with a short code are summed, the
    others are dealt by word. Their probability is own + left * that of the word."""

    def __init__(self, model: Model, out: Out, shards: tuple[int, int]):
        self.model, self.out, self.shards, self.dealer, self.sums = model, out, shards[0], Dealer(shards[0]), Sums(out, shards[1])

    def add(self, row, learnt, word, n, own, left) -> Iterator[pa.RecordBatch]:
        short = word >= 0
        p = own[short] + left[short] * self.model.by_code[1][word[short]]
        none = np.zeros(len(p))
        yield from self.sums.add(row[short], none, none, n[short] * np.log10(p))
        rest = ~short
        at = (_spread(word[rest]) % np.uint64(self.shards)).astype(np.int64)
        yield from self.out.cells(ROOT, self.dealer.add(at, [x[rest] for x in (row, learnt, word, n, own, left)]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.out.cells(ROOT, self.dealer.flush())
        yield from self.sums.flush()


def at_pairs(shared, kind: pa.DataType, next_shards: int, end_shards: tuple[int, int]):
    """The shards of pairs of words and, but for hot words, of single words."""

    def run(batches):
        model: Model = shared.value
        model.ready()
        out, hot = Out(kind), model.by_code[2]
        ends, onward = Ends(model, out, end_shards), Dealer(next_shards)
        for _, held in by_shard(batches):
            payloads = []
            for batch in held:
                is_cell = batch.column(1).to_numpy() == NEXT
                if not is_cell.all():
                    yield batch.filter(pa.array(~is_cell))
                payloads += batch.column(2).filter(pa.array(is_cell)).to_pylist()
            if not payloads:
                continue
            row, learnt, u, v, word, n = joined(payloads)
            times = n * learnt
            c3, t3, k3 = _arcs((u, v), word, times)
            t3 = np.where(u == model.pad, 0, t3)
            is_hot = (v >= 0) & hot[np.where(v >= 0, v, 0)]
            if is_hot.any():
                to = (_spread(v[is_hot], word[is_hot]) % np.uint64(next_shards)).astype(np.int64)
                yield from out.cells(NEXT, onward.add(to, [x[is_hot] for x in (row, learnt, v, word, n, c3.astype(np.int64), t3.astype(np.int64), k3.astype(np.int64))]))
            row, learnt, v, word, n, times, c3, t3, k3 = (x[~is_hot] for x in (row, learnt, v, word, n, times, c3, t3, k3))
            own, left = _share(c3, t3, k3)
            own2, left2 = _share(*_arcs((v,), word, times))
            yield from ends.add(row, learnt, word, n, own + left * own2, left * left2)
        yield from out.cells(NEXT, onward.flush())
        yield from ends.flush()

    return run


def hot_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, total, kinds: of hot words, what a shard (of pairs of the word and the next one) has."""
    for _, held in by_shard(batches):
        _, learnt, v, word, n, *_ = joined([p for b in held for p in b.column(2).to_pylist()])
        first, of = groups(v, word)
        count = np.bincount(of, n * learnt, len(first))
        some, state = np.unique(v[first], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(state, count).astype(np.int64)), pa.array(np.bincount(state, count > 0).astype(np.int64))], names=["v", "total", "kinds"])


def at_hot_words(shared, kind: pa.DataType, states, end_shards: tuple[int, int]):
    """The shards of the single states of hot words. states: a broadcast of v, total, kinds, in the order of v."""

    def run(batches):
        model: Model = shared.value
        model.ready()
        out, (known, total, kinds) = Out(kind), states.value
        ends = Ends(model, out, end_shards)
        for _, held in by_shard(batches):
            row, learnt, v, word, n, c3, t3, k3 = joined([p for b in held for p in b.column(2).to_pylist()])
            first, of = groups(v, word)
            at = np.searchsorted(known, v)
            own, left = _share(c3, t3, k3)
            own2, left2 = _share(np.bincount(of, n * learnt, len(first))[of], total[at], kinds[at])
            yield from ends.add(row, learnt, word, n, own + left * own2, left * left2)
        yield from ends.flush()

    return run


def at_root(shared, kind: pa.DataType, shards: int):
    """The shards of words without a short code, in the empty history."""

    def run(batches):
        model, out = shared.value, Out(kind)
        sums = Sums(out, shards)
        for _, held in by_shard(batches):
            row, learnt, word, n, own, left = joined([p for b in held for p in b.column(2).to_pylist()])
            first, of = groups(word)
            count = np.bincount(of, n * learnt, len(first))[of]
            yield from sums.add(row, np.where(count > 0, n, 0), n * model.base(count), n * np.log10(own + left * model.p1(count)))
        yield from sums.flush()

    return run


def at_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, held_out, n_tokens, n_known, base_score, score: the documents of each shard with all their sums."""
    for _, held in by_shard(batches):
        docs, payloads = [], []
        for batch in held:
            is_doc = batch.column(1).to_numpy() == DOCS
            docs.append(batch.filter(pa.array(is_doc)))
            payloads += batch.column(2).filter(pa.array(~is_doc)).to_pylist()
        docs = pa.Table.from_batches(docs).combine_chunks()
        if not docs.num_rows:
            continue
        row = docs["row"].to_numpy()
        order = np.argsort(row)
        sums = [docs["n_known"].to_numpy().copy(), docs["base_score"].to_numpy().copy(), np.zeros(len(row))]
        for payload in payloads:
            of, *parts = unpack(payload)
            at = order[np.searchsorted(row, of, sorter=order)]
            for k, part in enumerate(parts):
                sums[k] = sums[k] + np.bincount(at, part, len(row))
        for batch in docs.select(["id", "held_out", "n_tokens"]).append_column("n_known", pa.array(np.rint(sums[0]).astype(np.int64))).append_column("base_score", pa.array(sums[1])).append_column("score", pa.array(sums[2])).to_batches():
            yield batch


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Null texts count as empty: their one token is the end. A null id is never held out. Repeated rows are each scored
    (and each learnt from). Where nothing is held for training the model gives every token probability 1 and the base
    is that of no counts. Other columns are not read. An empty table gives an empty result.
    """
    type_ = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    model, words = train(docs)
    all_ = int(words.agg(F.sum("events")).first()[0] or 0)
    discard(words)
    spark, hot = docs.sparkSession, model.events >= HOT
    shared, kind = spark.sparkContext.broadcast(model), docs.select("id").limit(0).toArrow().schema.field(0).type
    schema = f"shard int, kind int, payload binary, row bigint, id {type_}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    shards, hot_shards = shards_for(all_), shards_for(model.events[hot].sum())
    root_shards = shards_for(all_ - model.events.sum() + model.events[model.words == START].sum())
    read = docs.select("id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(events(shared, order, shards)(kind), schema)
    pairs = cut(dealt(read, shards).mapInArrow(at_pairs(shared, kind, hot_shards, (root_shards, shards)), schema))
    of = lambda d, k: d.where(F.col("kind") == k).select("shard", "kind", "payload")
    parts, root = of(pairs, PART), of(pairs, ROOT)
    if hot.any():
        onward = dealt(of(pairs, NEXT), hot_shards)
        sums = cut(onward.mapInArrow(hot_states, "v bigint, total bigint, kinds bigint").groupBy("v").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")))  # shuffled cells go
        got = sums.orderBy("v").toArrow()  # words with a short code only
        states = spark.sparkContext.broadcast([got[c].to_numpy() for c in ("v", "total", "kinds")])
        hots = cut(onward.mapInArrow(at_hot_words(shared, kind, states, (root_shards, shards)), schema))
        parts, root = parts.unionByName(of(hots, PART)), root.unionByName(of(hots, ROOT))
    parts = parts.unionByName(of(dealt(root, root_shards).mapInArrow(at_root(shared, kind, shards), schema), PART))
    both = pairs.where(F.col("kind") == DOCS).unionByName(parts, allowMissingColumns=True)
    out = dealt(both, shards).mapInArrow(at_documents, f"id {type_}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
