"""Language-model scoring by a hierarchical Pitman-Yor model.

Every word has a restaurant whose customers are the words seen after it. The tables of all restaurants of words with one
ending are the customers of that class's restaurant, the tables of all classes those of the root, whose base is uniform over
the vocabulary and one unknown word. Seatings are a chain of Gibbs samples: in a sweep each pair's number of tables is drawn
given all others of the last sweep. After each sweep the tables of every restaurant are counted anew, and a sample predicts
with its own counts, so its probabilities sum to one. The predictions of several samples are averaged.

Texts are read in chunks, and what moves is each chunk's different pairs of a word and its context with their counts, once.
Words are dealt by hash: all pairs that order one word are in one task, which can therefore seat them without a model that is
sent around; what a task can't know, the tables of its contexts, other tasks are asked for. Hot words, of which there are
few, are dealt by word and class, and their counts at the root are told to all. Scores go back to the chunks, one for each
pair in the order in which it came, and the texts are read again to add them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import drop
from .common import fresh_path, stash
from .words import Batch, mix, slices, split, tidy

#: A word that makes up at least one of so many training tokens is hot.
HOT = 1000
#: Classes of words by their ending; the beginning of a text is one more.
CLASSES = 1023
KINDS = CLASSES + 1
HELD_OUT_MOD, HELD_OUT_REST = 7, 2
#: Tokens of the texts that are read together, and tokens whose pairs one task seats.
CHUNK_TOKENS, TASK_TOKENS = 1_000_000, 2_000_000
#: Sweeps before samples are taken; samples whose predictions are averaged.
BURN_IN, SAMPLES = 1, 2
CONCENTRATION = 1.0
#: Up to so many customers, table counts are drawn from their exact conditional distribution.
EXACT = 1024
#: Parallel seatings of dishes with more customers.
LANES = 32
SEED = 7151

#: The end of a text: a name that no word's hash is likely to have.
END = np.uint64(0xE5D0F7E87E5D0F7E)
#: Contexts are named by 48 bits: their class and 38 bits of their hash. This is the beginning of a text.
CLASS_SHIFT = np.uint64(38)
BEGIN = np.uint64(CLASSES << 38)


@dataclass(frozen=True)
class State:
    """What everyone knows of a sample: tokens N, vocabulary V, discounts of root, classes and words, by class its customers
    and tables, the root's customers and tables, and those of each hot word at the root."""

    tokens: int
    vocabulary: int
    d0: float
    d1: float
    d2: float
    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with so many customers and tables."""
        base = (CONCENTRATION + self.d0 * self.root_tables) / (self.vocabulary + 1)
        return (np.maximum(customers - self.d0 * tables, 0) + base) / (CONCENTRATION + self.root_customers)


def _tokens(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and ending's class of every token, the end of each text after its words."""
    n = len(b.bounds) - 1
    at = np.arange(len(b.start)) + b.doc()  # a word moves up by the ends before it
    ends = b.first[1:] + np.arange(n)
    tok = np.empty(len(b.start) + n, np.uint64)
    doc, kind = np.empty(len(tok), np.int64), np.zeros(len(tok), np.int64)
    tok[at], tok[ends] = b.hashes(), END
    doc[at], doc[ends] = b.doc(), np.arange(n)
    last = b.data[b.end - 1].astype(np.int64)
    before = np.where(b.end - b.start > 1, b.data[np.maximum(b.end - 2, 0)], 0).astype(np.int64)
    kind[at] = ((last | 32) * 31 + (before | 32) * 257) % CLASSES
    return tok, doc, kind


# Chunks of texts and their pairs


@dataclass
class Chunk:
    """Texts read together: their ids and flags, and for each token its text, hash and context."""

    number: int
    doc_id: pa.Array
    held: np.ndarray
    doc: np.ndarray
    tok: np.ndarray
    context: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of (doc_id, text, held), cut alike whenever the same rows are read in the same parts."""
    part, seq = TaskContext.get().partitionId(), 0
    rows: list[pa.RecordBatch] = []
    parts: list[tuple[np.ndarray, ...]] = []
    size = texts = 0

    def close() -> Chunk:
        tok, doc, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        name = kind.astype(np.uint64) << CLASS_SHIFT | tok >> np.uint64(64 - 38)
        context = np.concatenate((name[:1], name[:-1]))
        context[_runs(doc)] = BEGIN
        held = np.concatenate([np.array(r.column("held"), bool) for r in rows])
        return Chunk(part << 32 | seq, pa.concat_arrays([r.column("doc_id") for r in rows]), held, doc, tok, context)

    for batch in (x for whole in batches for x in slices(whole, 1)):
        tok, doc, kind = _tokens(split(batch.column(1), lower=True))
        rows.append(batch.select(["doc_id", "held"]))
        parts.append((tok, (doc + texts).astype(np.int32), kind.astype(np.int16)))
        size, texts = size + len(tok), texts + batch.num_rows
        if size >= CHUNK_TOKENS:
            yield close()
            rows, parts, size, texts, seq = [], [], 0, 0, seq + 1
    if rows:
        yield close()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether a place differs from the one before in any key."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _is_in(x: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among sorted ones, and its place there."""
    if not len(sorted_):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


def _owner(x: np.ndarray, tasks: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held) to (word, n): how often each word and the end occur in texts that aren't held out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            found, counts = np.unique(chunk.tok[~chunk.held[chunk.doc]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(chunk: Chunk, hot: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(task, word, context) of a chunk's different pairs, in that order, and the pair of each token."""
    order = np.lexsort((chunk.context, chunk.tok))
    tok, context = chunk.tok[order], chunk.context[order]
    new = _runs(tok, context)
    number = np.cumsum(new) - 1
    tok, context = tok[new], context[new]
    spread = np.where(_is_in(tok, hot)[0], mix(tok + (context >> CLASS_SHIFT) * np.uint64(0x9E3779B97F4A7C15)), tok)
    task = _owner(spread, tasks)
    by = np.argsort(task, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    pair = np.empty(len(order), np.int32)
    pair[order] = place[number]
    return task[by], tok[by], context[by], pair


def _names(x: np.ndarray) -> bytes:
    """Names of contexts, six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _read_names(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


COUNTED = "task int, chunk long, words binary, per_word binary, contexts binary, n binary"


def _count(docs: DataFrame, hot: np.ndarray, tasks: int) -> DataFrame:
    """For each chunk and task the chunk's pairs that are the task's, with how often they occur in training texts."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            task, word, context, pair = _pairs(chunk, shared.value, tasks)
            n = np.bincount(pair[~chunk.held[chunk.doc]], minlength=len(task)).astype(np.uint32)
            new = _runs(task, word)
            starts = np.flatnonzero(new)
            per_word = np.diff(np.concatenate((starts, [len(task)]))).astype(np.uint32)
            cuts = np.flatnonzero(_runs(task)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(task)], strict=True):
                a, b = np.searchsorted(starts, (s, e)).tolist()
                yield _rows(COUNTED, [(int(task[s]), chunk.number, word[starts[a:b]].tobytes(), per_word[a:b].tobytes(), _names(context[s:e]), n[s:e].tobytes())])

    return docs.mapInArrow(run, COUNTED)


PACKED = "task int, chunks array<bigint>, sizes binary, inverse binary, hot binary, per_word binary, up binary, n binary, names binary"


def _gather(counted: DataFrame, hot: np.ndarray) -> tuple[DataFrame, str]:
    """Brings the rows of a task together: its words, the pairs of each, the contexts' names, and where each chunk's pairs went.

    hot: the word's place among hot words, or -1. per_word: pairs of each word. up: each pair's context as a place in names.
    n: its count. sizes and inverse: pairs of each chunk, as differences of rising places among the task's pairs.
    """
    shared = counted.sparkSession.sparkContext.broadcast(hot)

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for i in range(table.num_rows):
            get = lambda name, t: np.frombuffer(table[name][i].as_py(), t)  # noqa: B023, E731
            parts.append((np.repeat(get("words", np.uint64), get("per_word", np.uint32)), _read_names(table["contexts"][i].as_py()), get("n", np.uint32)))
        sizes = np.array([len(p[0]) for p in parts], np.uint32)
        word, context, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        new = _runs(word, context)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        n = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        word, context = word[new], context[new]
        steps = np.diff(inverse, prepend=0)
        first = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))[:-1]))
        steps[first] = inverse[first]
        names, up = np.unique(context, return_inverse=True)
        starts = np.flatnonzero(_runs(word))
        is_hot, at = _is_in(word[starts], shared.value)
        per_word = np.diff(np.concatenate((starts, [len(word)])))
        blobs = (sizes, steps.astype(np.uint32), np.where(is_hot, at, -1).astype(np.int16), per_word.astype(np.uint32), up.astype(np.uint32), n.astype(np.uint32))
        return pa.Table.from_batches([_rows(PACKED, [(table["task"][0].as_py(), table["chunk"].to_pylist(), *(x.tobytes() for x in blobs), _names(names))])])

    path = fresh_path(counted.sparkSession, "lm-pairs")
    counted.groupBy("task").applyInArrow(run, PACKED).write.option("compression", "zstd").parquet(path)
    return counted.sparkSession.read.schema(PACKED).parquet(path), path


# Seating


@lru_cache(4)
def _log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t): the weight of all seatings of c customers at t tables."""
    s = np.full((n + 1, n + 2), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(1, n + 1)
            s[c + 1, 1 : n + 1] = np.logaddexp(s[c, 0:n], s[c, 1 : n + 1] + np.log(np.maximum(c - t * d, 0)))
    return s[:, : n + 1]


def _draw(c: int, lanes: int, p: np.ndarray, others: np.ndarray, d: float, theta: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """`lanes` draws each of the tables of dishes with c customers, from their exact conditional distribution."""
    steps = np.log((theta + d * others)[:, None] + d * np.arange(c)) + np.log(p)[:, None]
    weight = np.cumsum(steps, 1) + stirling[c, 1 : c + 1]
    total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
    out = np.empty((len(p), lanes), np.int64)
    for j in range(lanes):
        out[:, j] = 1 + (total < (rng.random(len(p)) * total[:, -1])[:, None]).sum(1)
    return out


def _pick(t: np.ndarray, weight: np.ndarray, lanes: int, rng: np.random.Generator) -> np.ndarray:
    """Lanes drawn anew by their log weights, dish by dish."""
    total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
    point = (np.arange(lanes) + rng.random((len(t), 1))) / lanes * total[:, -1:]
    at = np.stack([(total < point[:, j : j + 1]).sum(1) for j in range(lanes)], 1)
    return np.take_along_axis(t, np.minimum(at, t.shape[1] - 1), 1)


def sample_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, theta: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, given the parent's probability p and the restaurant's other tables.

    The weight of t tables is S(c, t) p**t times the product of theta + d (others + i) over i < t. As many customers as
    stirling knows are seated at once. Larger dishes begin with so many; then the others come in, in groups a 64th as large
    as those seated, in LANES parallel seatings, of which those that got too likely are drawn anew by their weights.
    """
    most = len(stirling) - 1
    t = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    sizes, starts = np.unique(c[order], return_index=True)
    for n, at, end in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)][: len(sizes)], strict=True):
        if 2 <= n <= most:
            block = max(1, (1 << 20) // n)
            for s in range(at, end, block):
                own = order[s : min(s + block, end)]
                t[own] = _draw(n, 1, p[own], others[own], d, theta, stirling, rng)[:, 0]
    many = order[np.searchsorted(c[order], most, "right") :]
    for s in range(0, len(many), 1 << 10):
        own = many[s : s + (1 << 10)]
        lanes, n = _draw(most, LANES, p[own], others[own], d, theta, stirling, rng), most
        weight = np.zeros(lanes.shape)
        again = 1.25 * n
        while len(own):
            group = np.minimum(max(n // 64, 1), c[own] - n)[:, None]
            a = (theta + d * (others[own][:, None] + lanes)) * p[own][:, None]
            before = lanes
            lanes = lanes + rng.binomial(group, a / (a + n - d * lanes))
            middle = (before + lanes) / 2
            weight += group * np.log((theta + d * (others[own][:, None] + middle)) * p[own][:, None] + n + (group - 1) / 2 - d * middle)
            n += max(n // 64, 1)
            done = c[own] <= n
            if done.any():
                t[own[done]] = _pick(lanes[done], weight[done], 1, rng)[:, 0]
                own, lanes, weight = own[~done], lanes[~done], weight[~done]
            if n >= again and len(own):
                lanes, weight, again = _pick(lanes, weight, LANES, rng), np.zeros(lanes.shape), 1.25 * n
    return t


class Restaurants:
    """A task's pairs, by word and then by context: n customers and t tables of each, in context up of names.

    Pairs of one word whose contexts are of one class have a pair of class and word above them, `over`; words is the word of
    each of those and kinds its class. Above them is the root, which for hot words is seated elsewhere.
    """

    def __init__(self, row: pa.RecordBatch, i: int):
        get = lambda name, t: np.frombuffer(row.column(name)[i].as_py(), t)
        self.task = row.column("task")[i].as_py()
        self.names, self.up, self.n = _read_names(row.column("names")[i].as_py()), get("up", np.uint32).astype(np.int64), get("n", np.uint32).astype(np.int64)
        self.hot = get("hot", np.int16).astype(np.int64)
        self.word = np.repeat(np.arange(len(self.hot)), get("per_word", np.uint32))
        kind = (self.names >> CLASS_SHIFT).astype(np.int64)[self.up]
        new = _runs(self.word, kind)
        self.over, self.words, self.kinds = np.cumsum(new) - 1, self.word[new], kind[new]
        self.multi = np.flatnonzero(self.n > 1)
        self.is_hot = self.hot >= 0
        self.t = np.minimum(self.n, 1)
        self._settle()
        self.ct = np.minimum(self.cc, 1)
        self.rt = np.minimum(self._by_word(self.ct), 1)

    def _by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.words, x, minlength=len(self.hot)).astype(np.int64)

    def _settle(self) -> None:
        """Customers of the classes' pairs."""
        self.cc = np.bincount(self.over, self.t, minlength=len(self.words)).astype(np.int64)

    def _root_counts(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word at the root."""
        c, t = self._by_word(self.ct), self.rt.copy()
        c[self.is_hot], t[self.is_hot] = s.hot_customers[self.hot[self.is_hot]], s.hot_tables[self.hot[self.is_hot]]
        return c, t

    def _class_probability(self, s: State, at: np.ndarray, own: np.ndarray | int, root: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The classes' probability of pairs `at` above, without so many customers of theirs."""
        c = self.cc[at] - own
        t = np.minimum(self.ct[at], c)
        gone = self.ct[at] - t
        word, k = self.words[at], self.kinds[at]
        left = np.maximum(root[0][word] - gone, 0)
        p0 = s.root(left, np.minimum(root[1][word], left))
        return (np.maximum(c - s.d1 * t, 0) + (CONCENTRATION + s.d1 * np.maximum(s.tables[k] - gone, 0)) * p0) / (CONCENTRATION + np.maximum(s.customers[k] - own, 0))

    def sweep(self, s: State, tables: np.ndarray, rng: np.random.Generator) -> None:
        """Reseats every pair given the rest, then the classes, then the words at the root. tables: those of the contexts."""
        m, own = self.multi, self.t[self.multi]
        p = self._class_probability(s, self.over[m], own, self._root_counts(s))
        self.t[m] = sample_tables(self.n[m], p, np.maximum(tables[self.up[m]] - own, 0), s.d2, CONCENTRATION, _log_stirling(s.d2), rng)
        self._settle()
        self.ct = np.clip(self.ct, np.minimum(self.cc, 1), self.cc)
        m = np.flatnonzero(self.cc > 1)
        own = self.ct[m]
        c, t = self._root_counts(s)
        left = np.maximum(c[self.words[m]] - own, 0)
        p = s.root(left, np.minimum(t[self.words[m]], left))
        self.ct[m] = sample_tables(self.cc[m], p, np.maximum(s.tables[self.kinds[m]] - own, 0), s.d1, CONCENTRATION, _log_stirling(s.d1), rng)
        c = self._by_word(self.ct)
        base = np.full(len(c), 1 / (s.vocabulary + 1))
        self.rt = sample_tables(c, base, np.maximum(s.root_tables - np.minimum(self.rt, c), 0), s.d0, CONCENTRATION, _log_stirling(s.d0), rng)

    def predictive(self, s: State, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The probability of every pair's word after its context; s, customers and tables are of the sample itself."""
        p = self._class_probability(s, np.arange(len(self.words)), 0, self._root_counts(s))[self.over]
        return (np.maximum(self.n - s.d2 * self.t, 0) + (CONCENTRATION + s.d2 * tables[self.up]) * p) / (CONCENTRATION + customers[self.up])

    def totals(self, n_hot: int) -> np.ndarray:
        """What is summed over tasks: customers and tables of classes; hot words' customers at the root; the root's customers
        and tables of the other words; ones and twos among customers of words, classes and the root."""
        c, cool = self._by_word(self.ct), ~self.is_hot
        ones = [((x == 1).sum(), (x == 2).sum()) for x in (self.n, self.cc, c[cool])]
        hot = np.bincount(self.hot[self.is_hot], c[self.is_hot], minlength=n_hot)
        return np.concatenate((np.bincount(self.kinds, self.cc, minlength=KINDS), np.bincount(self.kinds, self.ct, minlength=KINDS), hot, [c[cool].sum(), self.rt[cool].sum()], *ones)).astype(np.int64)

    def seats(self) -> tuple[bytes, ...]:
        return self.t[self.multi].astype(np.uint32).tobytes(), self.ct.astype(np.uint32).tobytes(), self.rt.astype(np.uint32).tobytes()

    def sit(self, t: bytes, ct: bytes, rt: bytes) -> None:
        self.t[self.multi] = np.frombuffer(t, np.uint32)
        self._settle()
        self.ct, self.rt = np.frombuffer(ct, np.uint32).astype(np.int64), np.frombuffer(rt, np.uint32).astype(np.int64)

    def local_tables(self) -> np.ndarray:
        return np.bincount(self.up, self.t, minlength=len(self.names)).astype(np.uint32)


def _read(path: str, name: str, value: int, columns: list[str], order: str | None = None) -> list[dict]:
    """The rows in the folder name=value of a table, none if there is no such folder."""
    fs, where = pyarrow.fs.FileSystem.from_uri(path)
    where = f"{where}/{name}={value}"
    if fs.get_file_info(where).type == pyarrow.fs.FileType.NotFound:
        return []
    rows = pq.read_table(where, columns=[*columns, *([order] if order else [])], filesystem=fs)
    return (rows.sort_by(order) if order else rows).to_pylist()


ASKED = "owner int, task int, names binary, a binary, b binary"


def _ask(task: int, names: np.ndarray, a: np.ndarray, b: np.ndarray, tasks: int) -> Iterator[tuple]:
    """Rows of ASKED: for each owner the names of a task's contexts and two numbers that the task knows of each.

    Names begin with the class, so owners follow the hash of a name; within an owner names keep their order.
    """
    owner = _owner(mix(names), tasks)
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(tasks + 1))
    for k, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if s < e:
            at = by[s:e]
            yield k, task, _names(names[at]), a[at].astype(np.uint32).tobytes(), b[at].astype(np.uint32).tobytes()


def _answer(asked: DataFrame, name: str) -> str:
    """The numbers of each name summed over the tasks that ask for it, in a folder for each task."""

    def run(table: pa.Table) -> pa.Table:
        names = [_read_names(x) for x in table["names"].to_pylist()]
        _, at = np.unique(np.concatenate(names), return_inverse=True)
        cuts, columns = np.cumsum([len(x) for x in names])[:-1], []
        for column in ("a", "b"):
            total = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint32) for x in table[column].to_pylist()]))[at]
            columns.append(pa.array([x.astype(np.uint32).tobytes() for x in np.split(total, cuts)], pa.binary()))
        return pa.table([table["owner"], table["task"], *columns], names=["owner", "task", "a", "b"])

    path = fresh_path(asked.sparkSession, name)
    answers = asked.groupBy("owner").applyInArrow(run, "owner int, task int, a binary, b binary")
    answers.repartition("task").write.option("compression", "zstd").partitionBy("task").parquet(path)
    return path


def _told(path: str, names: np.ndarray, task: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers to _ask() for the same names."""
    rows = _read(path, "task", task, ["a", "b"], "owner")
    by = np.argsort(_owner(mix(names), tasks), kind="stable")
    out = np.zeros((2, len(names)), np.int64)
    for j, column in enumerate("ab"):
        out[j, by] = np.concatenate([np.frombuffer(r[column], np.uint32) for r in rows]) if rows else 0
    return out[0], out[1]


@dataclass(frozen=True)
class Round:
    """A sample: the folders of its seats and of its contexts' tables, and its state."""

    seats: str | None
    answers: str
    state: State


def _contexts(r: Restaurants, rounds: list[Round], tasks: int, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers, and tables in the last of rounds, of a task's contexts; and which may have other tables in another sample.

    The first round told customers and tables of all contexts. Those in which every customer orders a dish of its own have a
    table for each, always; later rounds tell of the others.
    """
    customers, tables = _told(rounds[0].answers, r.names, r.task, tasks)
    active = np.flatnonzero(customers > tables)
    if len(rounds) > 1:
        tables[active] = _told(rounds[-1].answers, r.names[active], r.task, tasks)[0]
    return customers, tables, active


SAID = "what int, owner int, task int, names binary, a binary, b binary"


class Model:
    """The pairs of a corpus and samples of their seating, in the shared folder."""

    def __init__(self, docs: DataFrame):
        """docs: (doc_id, text, held)."""
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs
        counts = stash(word_counts(docs), "lm-counts")
        self.tokens, self.vocabulary = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
        rows = counts.where(F.col("n") * HOT >= F.lit(self.tokens)).collect() if self.tokens else []  # at most HOT
        rows.sort(key=lambda r: np.int64(r[0]).view(np.uint64))
        self.hot = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        self.hot_count = np.array([r[1] for r in rows], np.int64)
        self.tasks = max(1, -(-self.tokens * HELD_OUT_MOD // ((HELD_OUT_MOD - 1) * TASK_TOKENS)))
        self.packed, self.path = _gather(_count(docs, self.hot, self.tasks), self.hot)
        self.rounds: list[Round] = []
        for number in range(1 + BURN_IN + SAMPLES):
            self._round(number)
        self.samples = self.rounds[-SAMPLES:]

    def _state(self, said: DataFrame, before: State | None, number: int) -> State:
        """The state from the totals that tasks tell, (what = 0)."""

        def numbers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows:
                x = [np.frombuffer(b, np.int64) for b in row.column("a").to_pylist()]
                if x:
                    total = np.sum(x, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

        told = said.where("what = 0").select("a").mapInArrow(numbers, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        n_hot = len(self.hot)
        x = np.zeros(2 * KINDS + n_hot + 8)
        x[told["k"].to_numpy()] = told["v"].to_numpy()
        hot = x[2 * KINDS : 2 * KINDS + n_hot].astype(np.int64)
        root_c, root_t, *ones = x[2 * KINDS + n_hot :]
        d2, d1, d0 = (float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a + b else 0.5 for a, b in zip(ones[::2], ones[1::2], strict=True))
        hot_t = np.minimum(hot, 1)
        if before is not None and n_hot:
            rng = np.random.Generator(np.random.PCG64([SEED, number]))
            others = np.maximum(before.root_tables - before.hot_tables, 0)
            hot_t = sample_tables(hot, np.full(n_hot, 1 / (self.vocabulary + 1)), others, before.d0, CONCENTRATION, _log_stirling(before.d0), rng)
        return State(self.tokens, self.vocabulary, d0, d1, d2, x[:KINDS], x[KINDS : 2 * KINDS], root_c + hot.sum(), root_t + hot_t.sum(), hot, hot_t)

    def _round(self, number: int) -> None:
        """One sweep of all tasks and the exchange of what it changed; round 0 is one table for each pair."""
        tasks, n_hot = self.tasks, len(self.hot)
        rounds = self.spark.sparkContext.broadcast(self.rounds)

        @tidy
        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = Restaurants(batch, i)
                    if number:
                        last = rounds.value[-1]
                        _, tables, active = _contexts(r, rounds.value, tasks)
                        if last.seats:
                            r.sit(*_read(f"{last.seats}/what=1", "task", r.task, ["a", "b", "names"])[0].values())
                        r.sweep(last.state, tables, np.random.Generator(np.random.PCG64([SEED, number, r.task])))
                        t, ct, rt = r.seats()
                        yield _rows(SAID, [(1, -1, r.task, rt, t, ct)])
                        found = r.local_tables()[active]
                        yield _rows(SAID, [(2, *x) for x in _ask(r.task, r.names[active], found, np.zeros(len(active), np.uint32), tasks)])
                    yield _rows(SAID, [(0, -1, r.task, None, r.totals(n_hot).tobytes(), None)])

        path = fresh_path(self.spark, "lm-said")
        self.packed.mapInArrow(seat, SAID).write.option("compression", "zstd").partitionBy("what", "task").parquet(path)
        said = self.spark.read.schema(SAID).parquet(path)
        state = self._state(said, self.rounds[-1].state if number else None, number)
        if number:
            asked = said.where("what = 2")
        else:

            @tidy
            def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        r = Restaurants(batch, i)
                        yield _rows(ASKED, list(_ask(r.task, r.names, np.bincount(r.up, r.n, minlength=len(r.names)), r.local_tables(), tasks)))

            asked = self.packed.mapInArrow(ask, ASKED)
        self.rounds.append(Round(path if number else None, _answer(asked.select("owner", "task", "names", "a", "b"), "lm-answers"), state))

    def scores(self, precise: bool) -> str:
        """For each chunk a folder of rows (task, count of each of its words, log10 probability of each of its pairs)."""
        shared = self.spark.sparkContext.broadcast((self.rounds[0], self.samples, self.hot_count))
        tasks = self.tasks

        @tidy
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, samples, hot_count = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    r = Restaurants(batch, i)
                    p = np.zeros(len(r.n))
                    for sample in samples:
                        customers, tables, _ = _contexts(r, [first, sample], tasks)
                        r.sit(*_read(f"{sample.seats}/what=1", "task", r.task, ["a", "b", "names"])[0].values())
                        p += r.predictive(sample.state, customers, tables)
                    log_p = np.log10(p / len(samples))
                    told = log_p.astype(np.float64 if precise else np.float32)
                    count = np.bincount(r.word, r.n, minlength=len(r.hot)).astype(np.int64)
                    count[r.is_hot] = hot_count[r.hot[r.is_hot]]
                    sizes = np.frombuffer(batch.column("sizes")[i].as_py(), np.uint32).tolist()
                    steps, at = np.frombuffer(batch.column("inverse")[i].as_py(), np.uint32).astype(np.int64), 0
                    for chunk, size in zip(batch.column("chunks")[i].as_py(), sizes, strict=True):
                        pair = np.cumsum(steps[at : at + size])
                        at += size
                        word = r.word[pair]
                        yield _rows("chunk long, task int, counts binary, scores binary", [(chunk, r.task, count[word[_runs(word)]].astype(np.uint64).tobytes(), told[pair].tobytes())])

        path = fresh_path(self.spark, "lm-scores")
        scored = self.packed.mapInArrow(score, "chunk long, task int, counts binary, scores binary")
        scored.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
        return path


def score_documents(docs: DataFrame, precise: bool = False, token_scores: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row a document.

    Training texts are those whose crc32(doc_id as text) leaves another rest than HELD_OUT_REST when divided by
    HELD_OUT_MOD; a null doc_id counts as an empty text and trains. A null text is empty: its end is its only token.
    base_score is the add-one unigram model's, score the hierarchical model's log10 probability of the whole text, each
    token's to the precision of 32-bit floats or, if asked, of 64-bit ones. Rows that repeat count as often as they occur. Texts of any length are read
    whole. Without a training token the vocabulary is empty and all there is is the unknown word, so every score is 0. An
    empty table gives no rows. Other columns are not read. token_scores adds a list of the tokens' log10 probabilities.

    docs are read three times and have to come in the same parts each time, as a table or a written DataFrame does; it is an
    error if they don't.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held"))
    model = Model(docs)
    path = model.scores(precise)
    for gone in (model.path, *(r.seats for r in model.rounds if r.seats), *(r.answers for r in model.rounds)):
        drop(docs.sparkSession, gone)  # the scores say it all
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)
    tasks, tokens, vocabulary = model.tasks, model.tokens, model.vocabulary
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            task, word, _, pair = _pairs(chunk, shared.value, tasks)
            rows = _read(path, "chunk", chunk.number, ["counts", "scores"], "task")
            new = _runs(task, word)
            found = np.concatenate([np.frombuffer(r["scores"], np.float64 if precise else np.float32) for r in rows]) if rows else np.zeros(0)
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
            if len(found) != len(task) or len(counts) != new.sum():
                raise ValueError("the documents were read in other parts than before; write them to a table first")
            n = len(chunk.held)
            c = counts[np.cumsum(new) - 1]
            base = np.log10((c + 1.0) / (tokens + vocabulary + 1.0))
            p = found.astype(np.float64)[pair]
            sums = [np.bincount(chunk.doc, x, minlength=n) for x in (None, (c > 0)[pair], base[pair], p)]
            columns = [chunk.doc_id, pa.array(chunk.held), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(np.full(n, tokens)), *(pa.array(x) for x in sums[2:])]
            if token_scores:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sums[0]))), pa.int32()), pa.array(p)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *["token_scores"] * token_scores])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", token_scores array<double>" * token_scores
    return docs.mapInArrow(finish, schema)
