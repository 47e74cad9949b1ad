"""Language-model scores by logistic context mixing.

A text is read as its lower-cased words, each followed by a space, and an end byte. Each bit of each byte is predicted
by counters in seven contexts: the last 1, 2, 3 and 4 bytes of the word; the class of the text so far with 3 bytes; the
word so far; the class with the word so far. Their stretched probabilities are added under weights that a gate picks
(bit position, how often the word so far was seen, whether this class has seen it); a probability map refines the sum.
The class is that of the last words before: the likeliest component of a small mixture of word distributions, so that
the model follows the language of a text.

The contexts of a byte end where its word begins, so a word's probability depends on the word and the class only.
Hence every distinct (word, class) of the corpus is scored once, in Spark:

* words and their uses by class are counted over all documents; their number grows with the corpus;
* the words are range-partitioned into sorted runs of bounded size. In sorted order the uses that share the bits so far
  stand together, so the counters of the word so far are sums over stretches of a run; what stretches share across the
  ends of runs is added up from the runs' first and last stretches, so counts are exact and do not depend on the runs;
* the counters of short contexts are hashed into tables of fixed size, summed in Spark;
* within a run, the bytes that words share in front are mixed once for each class;
* texts look up the commonest words in a bounded broadcast and join the rest.

Everything is learned from all training texts, whole. The classes are a mixture fitted by rounds over the counts of
frequent words in each text. Weights and map take every training use of every word, taken out of its own counters: as
all uses of a word after a class have the same inputs, a pass over the sorted runs, weighted by uses, is one over all
texts. A pass adds up slopes and curvatures for each gate in Spark; a few Newton steps follow from them.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_text, slices, table

CLASSES = 6  # 0: no known word so far
CLASS_WORDS, HISTORY = 1000, 64  # words that tell classes; words looked back at
CLASS_SHARE = 1 / 20_000  # of the training words that a word which tells classes has at least
ANCHORS = 100  # the commonest of them: which words they share texts with gives the classes to begin with
ROUNDS = 25  # over the training texts, at most, in which classes settle
STEPS = 20  # passes over the training uses, at most, in which weights settle
SETTLED = 1e-3  # share of the code length that another step would save
PRIOR = 10  # uses that the first weights count as
COMMON = 200_000  # words that are broadcast with their scores, at most
RUN = 65_536  # distinct words of a sorted run
LONG = 64  # bytes of a word that are scored at once: longer words are read in pieces
DEPTH = 16  # bytes of the word so far that are told apart
ORDERS = (1, 2, 3, 4)
TABLE_BITS = (16, 19, 20, 20, 20)  # slots of the short contexts' tables: the orders, then class with 3 bytes
OFFSET = np.r_[0, np.cumsum([1 << b for b in TABLE_BITS])]
INPUTS = len(TABLE_BITS) + 2
DELTA = 0.4
GATES = 8 * 8 * 2
BUCKETS = 33
BITS = np.arange(8)
NODE = ((1 << BITS) | (np.arange(256)[:, None] >> (8 - BITS))).astype(np.uint32)  # of each byte, the bits before each bit
SALT = NODE * np.uint32(0x9E3779B9)
BIT = (np.arange(256)[:, None] >> (7 - BITS)) & 1
WORD, PART, DIGEST = 0, 1, 2  # kinds of counted units: whole words, pieces of long ones, long ones by digest
END, NEXT, BY_DIGEST = b"\xff", b"\xfe", b"\xfd"  # bytes that no text holds


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def units_of(word: bytes) -> list[tuple[bytes, int]]:
    """The units that a word is scored and counted as: the word and its space; a long word in pieces, and its digest."""
    if word == END:
        return [(END, WORD)]
    spelled = word + b" "
    if len(word) <= LONG:
        return [(spelled, WORD)]
    cuts = range(0, len(spelled), LONG)
    return [((NEXT if i else b"") + spelled[i : i + LONG], PART) for i in cuts] + [(BY_DIGEST + hashlib.sha256(word).digest()[:16], DIGEST)]


# --- classes ---------------------------------------------------------------------------------------------------------


def summed(rows: DataFrame, fn: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """Sum, over all rows, of the arrays of a given size that fn makes of them: tasks add theirs up, Spark those of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for row in rows_of(b):
                total += fn(row)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    got = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # a row a cell
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def frequent_words(train: DataFrame, most: int = 100_000) -> list[bytes]:
    """Every word that has CLASS_SHARE of all words, and others.

    A word that has this share of the whole has it in one of the stretches at least that tasks cut their texts into, so
    a stretch tells only of such words, 1 / CLASS_SHARE at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            least = CLASS_SHARE * n.total()
            return pa.RecordBatch.from_arrays([pa.array([w for w, m in n.items() if m >= least], pa.binary())], names=["w"])

        for b in batches:
            for part in slices(b, "text"):
                for t in part.column("text").to_pylist():
                    n.update(words_of(t))
                if len(n) > most:
                    yield flush()
                    n.clear()
        yield flush()

    return sorted(bytes(r["w"]) for r in train.select("text").mapInArrow(run, "w binary").distinct().toLocalIterator())


def count_words(texts: list[list[bytes]], at: dict[bytes, int]) -> dict:
    """Of some texts, a row: where each begins in `word` and `n`, its different words that are in `at` and their uses;
    and the number of all words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter(map(at.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(sizes.sum()))
    code, n = np.unique((np.repeat(np.arange(len(texts)), sizes) * len(at) + ids)[ids >= 0], return_counts=True)
    text, word = np.divmod(code, max(len(at), 1))
    _, begins = np.unique(text, return_index=True)
    return {"begins": begins.astype(np.int32).tobytes(), "word": word.astype(np.int32).tobytes(), "n": n.astype(np.int32).tobytes(), "words": int(sizes.sum())}


def counts_in(row: dict, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and uses of a row of count_words, for the words that have a column."""
    begins, word, n = (np.frombuffer(row[c], np.int32) for c in ("begins", "word", "n"))
    text = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(word)]))
    word = column[word]
    keep = word >= 0
    return text[keep], word[keep], n[keep].astype(np.int64)


def uses_of_words(row: dict, size: int) -> np.ndarray:
    return np.r_[np.bincount(np.frombuffer(row["word"], np.int32), np.frombuffer(row["n"], np.int32), size), row["words"]]


def texts_shared(row: dict, column: np.ndarray, anchors: int, size: int) -> np.ndarray:
    """Number of texts in which each of the first words stands with each word."""
    text, word, _ = counts_in(row, column)
    out = np.zeros((anchors, size))
    for s in range(0, int(text.max(initial=-1)) + 1, 1024):
        a, z = np.searchsorted(text, [s, s + 1024])
        there = np.zeros((1024, size), np.float32)
        there[text[a:z] - s, word[a:z]] = 1
        out += there[:, :anchors].T @ there
    return out.ravel()


def shares_of(s: np.ndarray) -> np.ndarray:
    share = np.exp(s - s.max(1, keepdims=True))
    return share / share.sum(1, keepdims=True)


def uses_by_class(row: dict, column: np.ndarray, evidence: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Uses of each word by the classes of its texts, then texts by class, in whole steps of 1/65536: sums of any order
    are the same. Texts of fewer than 5 of the words are left aside."""
    text, word, n = counts_in(row, column)
    of, begins = np.unique(text, return_index=True)
    out = np.zeros((len(evidence) + 1, len(prior)))
    if len(of):
        share = shares_of(np.add.reduceat(evidence[word] * n[:, None], begins) / 1024 + prior)
        share = np.where(np.add.reduceat(n, begins)[:, None] >= 5, np.rint(share * 65536), 0)
        each = np.repeat(share, np.diff(np.r_[begins, len(n)]), 0) * n[:, None]
        out[:-1] = np.stack([np.bincount(word, x, len(evidence)) for x in each.T], 1)
        out[-1] = share.sum(0)
    return out.ravel()


def evidence_of(uses: np.ndarray) -> np.ndarray:
    """Evidence of each class (column) for each word, from uses by class; a class without texts has that of no class."""
    common = uses.sum(1, keepdims=True) + 0.05
    p = uses + 0.05 * len(uses) * common / common.sum()
    p = np.log(p / p.sum(0))
    return np.rint((p - p.mean(1, keepdims=True)) * 1024).astype(np.int64)


def first_uses(shared: np.ndarray, classes: int) -> np.ndarray:
    """Uses by class to begin with: the anchors parted into classes by the words that they share texts with."""
    unit = shared / np.linalg.norm(shared, axis=1, keepdims=True)
    heads = [int(shared.sum(1).argmax())]
    while len(heads) < classes:  # the anchor least like those chosen
        heads.append(int((unit @ unit[heads].T).max(1).argmin()))
    share = shares_of(8 * unit @ unit[heads].T)
    for _ in range(ROUNDS):
        uses = shared.T @ share
        share = shares_of(shared @ evidence_of(uses) / 1024 + np.log(share.sum(0) + 1))
    return shared.T @ share


class Gate:
    """What the words of a text say of its class: evidence of each class for the commonest words, in steps of 1/1024 of a natural logarithm."""

    def __init__(self, texts: list[list[bytes]], classes: int = CLASSES - 1):
        names = sorted({w for ws in texts for w in ws if w != END})
        row = count_words(texts, {w: i for i, w in enumerate(names)})
        self._fit(names, lambda fn, size: fn(row), classes)

    @classmethod
    def of(cls, train: DataFrame) -> Gate:
        """From all texts of a table."""
        names = frequent_words(train)
        sent = train.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, "text"):
                    row = count_words([words_of(t) for t in part.column("text").to_pylist()], sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row.values()], names=list(row))

        rows = materialize(train.select("text").mapInArrow(run, "begins binary, word binary, n binary, words long"), "class-words")
        out = cls.__new__(cls)
        out._fit(names, partial(summed, rows), CLASSES - 1)
        return out

    def _fit(self, names: list[bytes], gather: Callable[[Callable[[dict], np.ndarray], int], np.ndarray], classes: int) -> None:
        n = gather(partial(uses_of_words, size=len(names)), len(names) + 1)
        top = sorted((i for i in range(len(names)) if n[i] >= CLASS_SHARE * n[-1]), key=lambda i: (-n[i], names[i]))[:CLASS_WORDS]
        self.at = {names[i]: k for k, i in enumerate(top)}
        self.evidence = np.zeros((len(top), classes), np.int32)
        if not top:
            return
        column = np.full(len(names), -1)
        column[top] = np.arange(len(top))
        anchors = min(ANCHORS, len(top))
        shared = gather(partial(texts_shared, column=column, anchors=anchors, size=len(top)), anchors * len(top))
        uses, prior = first_uses(shared.reshape(anchors, -1), classes), np.zeros(classes)
        for _ in range(ROUNDS):
            evidence = evidence_of(uses)
            got = gather(partial(uses_by_class, column=column, evidence=evidence, prior=prior), (len(top) + 1) * classes).reshape(-1, classes) / 65536
            uses, prior = got[:-1], np.log(got[-1] + 1)
            moved = np.abs(evidence_of(uses) - evidence).mean(1)
            if (moved * n[top]).sum() <= 10 * n[top].sum():  # a hundredth of a logarithm
                break
        self.evidence = evidence_of(uses).astype(np.int32)

    @property
    def rows(self) -> np.ndarray:
        """Evidence of each word, and at -1 that of all others: none."""
        return np.concatenate([self.evidence, np.zeros((1, self.evidence.shape[1]), np.int32)])


def classes_of(evidence: np.ndarray, known: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class before each token, from the evidence of the tokens of its text (begins: first token of each) before it."""
    n = len(known)
    low = np.maximum(np.repeat(begins, np.diff(np.r_[begins, n])), np.arange(n) - HISTORY)
    seen = np.r_[0, np.cumsum(known)]
    best, out = None, np.ones(n, np.int64)
    for k in range(evidence.shape[1]):
        total = np.zeros(n + 1, np.int32)
        np.cumsum(evidence[:, k], dtype=np.int32, out=total[1:])  # may wrap; differences do not
        total = total[:-1] - total.take(low)
        if k:
            out[total > best] = k + 1
        best = np.maximum(best, total) if k else total
    out[seen[:-1] <= seen.take(low)] = 0
    return out


class Lookup(dict):
    """word -> its row in `table` (evidence) and `marks`; words that come up get a row each, or row 0 where they are
    not to be kept."""

    def __init__(self, gate: Gate, words: list[bytes] = (), grow: bool = False):
        super().__init__()
        self.gate, self.words = gate, [] if grow else [None, *words]
        self.table, self.marks = np.empty((0, gate.evidence.shape[1]), np.int32), np.empty(0, bool)
        self.grow = False
        self.update((w, i + 1) for i, w in enumerate(words))
        self._settle()
        self.grow = grow

    def __missing__(self, word: bytes) -> int:
        if not self.grow:
            return 0
        self[word] = i = len(self.words)
        self.words.append(word)
        return i

    def _settle(self) -> None:
        new = self.words[len(self.table) :]
        at = np.fromiter(map(self.gate.at.get, new, repeat(-1)), np.int64, len(new))
        self.marks = np.r_[self.marks, at >= 0]
        self.table = np.concatenate([self.table, self.gate.rows[at]])

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of the texts (an end after each): rows; the classes before them; first token of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        self._settle()
        return ids, classes_of(self.table[ids], self.marks[ids], begins), begins


# --- counting --------------------------------------------------------------------------------------------------------


def count_units(docs: DataFrame, gate: Gate, most: int = 300_000) -> DataFrame:
    """(key, kind, n0.., mask) of every unit: uses in training documents by class, and the classes it occurs in."""
    sent = docs.sparkSession.sparkContext.broadcast(gate)
    names = [f"n{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, uses, seen = Lookup(sent.value, grow=True), np.zeros(0, np.int64), np.zeros(0, bool)

        def flush() -> pa.RecordBatch:
            n, there = uses.reshape(-1, CLASSES), seen.reshape(-1, CLASSES)
            masks = (there << np.arange(CLASSES)).sum(1)
            long = [(*u, i) for i, w in enumerate(look.words) if len(w) > LONG for u in units_of(w)]
            short = [i for i, w in enumerate(look.words) if len(w) <= LONG]
            rows = np.r_[np.array(short, np.int64), np.array([i for _, _, i in long], np.int64)]
            keys = [END if w == END else w + b" " for w in look.words if len(w) <= LONG]
            columns = [pa.array([*keys, *(u for u, _, _ in long)], pa.binary()), pa.array(np.r_[np.full(len(short), WORD), [k for _, k, _ in long]].astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in n[rows].T), pa.array(masks[rows].astype(np.int32))], names=["key", "kind", *names, "mask"])

        for b in batches:
            for part in slices(b, "text"):
                texts = [[*words_of(t), END] for t in part.column("text").to_pylist()]
                ids, classes, begins = look.read(texts)
                train = np.repeat(np.array(part.column("train").to_pylist(), bool), np.diff(np.r_[begins, len(ids)]))
                code, size = ids * CLASSES + classes, len(look.words) * CLASSES
                uses = np.bincount(code[train], minlength=size) + np.r_[uses, np.zeros(size - len(uses), np.int64)]
                seen = (np.bincount(code, minlength=size) > 0) | np.r_[seen, np.zeros(size - len(seen), bool)]
                if len(look) > most:
                    yield flush()
                    look, uses, seen = Lookup(sent.value, grow=True), np.zeros(0, np.int64), np.zeros(0, bool)
        if look:
            yield flush()

    found = docs.select("text", "train").mapInArrow(run, f"key binary, kind int, {', '.join(f'{n} long' for n in names)}, mask int")
    return found.groupBy("key").agg(F.max("kind").alias("kind"), *[F.sum(n).alias(n) for n in names], F.bit_or("mask").alias("mask"))


# --- sorted runs -----------------------------------------------------------------------------------------------------


def shared_bits(keys: list[bytes]) -> np.ndarray:
    """Leading bits that each key shares with the one before, of the first DEPTH bytes; -1 for the first."""
    m = np.frombuffer(b"".join(k[:DEPTH].ljust(DEPTH, b"\0") for k in keys), ">u8").reshape(len(keys), -1).astype(np.uint64)
    out = np.full(len(keys), -1, np.int64)
    x = m[1:] ^ m[:-1]
    high = lambda v: 63 - np.frexp((v & ~(v >> np.uint64(1))).astype(np.float64))[1] + 1  # noqa: E731  leading zeros
    out[1:] = np.where(x[:, 0] > 0, high(x[:, 0]), np.where(x[:, 1] > 0, 64 + high(x[:, 1]), 8 * DEPTH))
    return out


class Run:
    """Sorted keys with their uses by class; `head` and `tail` hold the uses of the whole corpus that share each number
    of bits with the first and the last key."""

    def __init__(self, keys: list[bytes], kind: np.ndarray, n: np.ndarray, mask: np.ndarray):
        self.keys, self.kind, self.n, self.mask = keys, kind, n, mask
        self.until = np.concatenate([np.zeros((1, CLASSES), np.int64), np.cumsum(np.where((kind == DIGEST)[:, None], 0, n), 0)])
        self.all_until = self.until.sum(1)
        self.shared = shared_bits(keys)
        self.head = self.tail = None

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Uses by class within the run that share 0, 1, .. bits with the first and with the last key."""
        depth = np.arange(8 * DEPTH + 1)
        from_first = np.minimum.accumulate(np.r_[8 * DEPTH, self.shared[1:]])
        to_last = np.minimum.accumulate(np.r_[8 * DEPTH, self.shared[:0:-1]])
        reach = lambda x: len(x) - np.searchsorted(x[::-1], depth)  # noqa: E731  keys that share so many bits
        return self.until[reach(from_first)], self.until[-1] - self.until[len(self.keys) - reach(to_last)]

    def sizes(self, depth: int, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uses in the corpus that share the first `depth` bits of each of some keys: of all classes, of a given one."""
        begins = np.flatnonzero(self.shared < depth)
        group = np.searchsorted(begins, rows, side="right") - 1
        low, high = begins[group], np.r_[begins[1:], len(self.keys)][group]
        out = self.all_until[high] - self.all_until[low], self.until.ravel()[high * CLASSES + classes] - self.until.ravel()[low * CLASSES + classes]
        if self.head is not None:  # rows are sorted: those of the first and the last stretch stand at the two ends
            first, last = np.searchsorted(group, [1, len(begins) - 1])
            for at, end in ((slice(0, first), self.head[depth]), (slice(last, None), self.tail[depth])):
                out[0][at], out[1][at] = end.sum(), end[classes[at]]
        return out

    def pack(self) -> dict:
        first, last = self.ends()
        return {
            "first": self.keys[0][:DEPTH], "last": self.keys[-1][:DEPTH], "head": first.tobytes(), "tail": last.tobytes(), "blob": b"".join(self.keys),
            "lengths": np.array([len(k) for k in self.keys], np.uint8).tobytes(), "kind": self.kind.astype(np.uint8).tobytes(), "n": self.n.astype(np.int64).tobytes(), "mask": self.mask.astype(np.uint8).tobytes(),
        }

    @classmethod
    def unpack(cls, row: dict) -> Run:
        ends = np.cumsum(np.frombuffer(row["lengths"], np.uint8), dtype=np.int64)
        blob = row["blob"]
        keys = [blob[a:z] for a, z in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
        return cls(keys, np.frombuffer(row["kind"], np.uint8), np.frombuffer(row["n"], np.int64).reshape(-1, CLASSES), np.frombuffer(row["mask"], np.uint8))


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: each is a run, which need not stand beside the others in memory."""
    return ({n: b.column(n)[i].as_py() for n in b.schema.names} for i in range(b.num_rows))


PACKED = "first binary, last binary, head binary, tail binary, blob binary, lengths binary, kind binary, n binary, mask binary"


def sorted_runs(units: DataFrame, count: int, size: int = RUN) -> DataFrame:
    """The units in key order, packed into one row for each run of at most `size`."""
    names = [f"n{k}" for k in range(CLASSES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack(t: pa.Table) -> pa.RecordBatch:
            n = np.stack([t.column(c).to_numpy() for c in names], 1)
            row = Run(t.column("key").to_pylist(), t.column("kind").to_numpy(), n, t.column("mask").to_numpy()).pack()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row.values()], names=list(row))

        for b in batches:
            if b.num_rows:
                held.append(b)
            while sum(x.num_rows for x in held) >= size:
                whole = pa.Table.from_batches(held)
                yield pack(whole.slice(0, size))
                held = [x for x in whole.slice(size).to_batches() if x.num_rows]
        if held:
            yield pack(pa.Table.from_batches(held))

    parts = max(1, math.ceil(count / size))
    return units.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, PACKED)


def join_ends(rows: list[dict]) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Of each run (by its first key), what its first and last stretches come to in the whole corpus."""
    rows = sorted(rows, key=lambda r: (r["first"], r["last"]))
    head, tail = (np.frombuffer(b"".join(r[c] for r in rows), np.int64).reshape(len(rows), 8 * DEPTH + 1, CLASSES) for c in ("head", "tail"))
    depth = np.arange(8 * DEPTH + 1)
    meets = [shared_bits([rows[i]["last"], rows[i + 1]["first"]])[1] >= depth for i in range(len(rows) - 1)]
    whole = [shared_bits([r["first"], r["last"]])[1] >= depth for r in rows]
    before, after = head * 0, head * 0  # uses in the runs before and after that go on into this one
    for i in range(1, len(rows)):
        before[i] = np.where(meets[i - 1][:, None], tail[i - 1] + np.where(whole[i - 1][:, None], before[i - 1], 0), 0)
    for i in range(len(rows) - 2, -1, -1):
        after[i] = np.where(meets[i][:, None], head[i + 1] + np.where(whole[i + 1][:, None], after[i + 1], 0), 0)
    return {
        (r["first"], r["last"]): (head[i] + before[i] + np.where(whole[i][:, None], after[i], 0), tail[i] + after[i] + np.where(whole[i][:, None], before[i], 0))
        for i, r in enumerate(rows)
    }


# --- short contexts --------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def slots_of(context: int, value: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Index, in all tables, of the eight counters on the way to a byte after a context: (n, 8)."""
    h = (_mix(value.astype(np.uint64) + (np.uint64(context + 1) << np.uint64(50))) >> np.uint64(16)).astype(np.uint32)
    inner = (h[:, None] ^ SALT[byte]) * np.uint32(0xED558CCD)
    return OFFSET[context] + (inner >> np.uint32(32 - TABLE_BITS[context])).astype(np.int64)


class Bytes:
    """The bytes that units are scored by, flattened: owner unit, byte, its place in the unit, and the bytes before."""

    def __init__(self, keys: list[bytes]):
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        raw = np.frombuffer(b"".join(b"\0\0\0 " + k for k in keys), np.uint8)
        g = np.zeros(len(raw), np.int64)
        for k in range(5):
            g[k:] |= raw[: len(raw) - k].astype(np.int64) << (8 * k)
        begins = np.cumsum(sizes + 4) - sizes
        self.owner = np.repeat(np.arange(len(keys)), sizes)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.gram = g[begins[self.owner] + self.place]  # five bytes, the one to predict lowest
        given = np.fromiter((k[:1] == NEXT for k in keys), bool, len(keys))
        keep = ~(given[self.owner] & (self.place == 0))  # a continuation mark is not coded
        self.owner, self.place, self.gram = self.owner[keep], self.place[keep], self.gram[keep]
        self.byte = self.gram & 0xFF

    def context(self, c: int, classes: np.ndarray) -> np.ndarray:
        if c < len(ORDERS):
            return (self.gram >> 8) & ((1 << 8 * ORDERS[c]) - 1)
        return (self.gram >> 8) & 0xFFFFFF | classes[self.owner].astype(np.int64) << 24


class Nodes(Bytes):
    """The bytes of some keys of a run (rows, ascending, each after a class), but those in front that the key before
    with the same class has too only once: all that a byte is mixed from is the same there. `unit` and `node` tell of
    each byte of the keys its key and where it is found."""

    def __init__(self, run: Run, rows: np.ndarray, classes: np.ndarray):
        super().__init__([run.keys[i] for i in rows.tolist()])
        sizes = np.fromiter(map(len, run.keys), np.int64, len(run.keys))[rows]
        same = np.zeros(len(rows), np.int64)  # bytes shared with the key before
        for k in range(CLASSES):
            of = np.flatnonzero(classes == k)
            if len(of):
                same[of] = np.minimum.reduceat(run.shared, np.r_[0, rows[of[:-1]] + 1]) // 8
                same[of[1:]] = np.minimum(same[of[1:]], sizes[of[:-1]])
        new = self.place >= same[self.owner]
        order = np.argsort((self.place * CLASSES + classes[self.owner]).astype(np.uint16), kind="stable")  # keys one after another, by place and class
        first = new[order]
        self.node = np.empty(len(order), np.int64)
        self.node[order] = (np.cumsum(new) - 1)[order[first]][np.cumsum(first) - 1]
        self.unit = self.owner
        self.owner, self.place, self.gram, self.byte = self.owner[new], self.place[new], self.gram[new], self.byte[new]


def short_tables(runs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones counted in each slot of the short contexts, from the packed runs."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in rows_of(b):
                run = Run.unpack(row)
                keep = run.kind != DIGEST
                data = Bytes([k for k, x in zip(run.keys, keep.tolist(), strict=True) if x])
                n = run.n[keep][data.owner]
                found = [(0, data.gram, n.sum(1))] + [(1, data.gram & 0xFFFFFFFF | k << 32, n[:, k]) for k in range(CLASSES)]
                for c, code, m in found:
                    code, m = code[m > 0], m[m > 0]
                    at, g = pd.factorize(code)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"c": np.full(len(g), c, np.int32), "g": g, "n": np.bincount(at, m, len(g)).astype(np.int64)}), preserve_index=False)

    level = runs.mapInArrow(grams, "c int, g long, n long").groupBy("c", "g").agg(F.sum("n").alias("n"))
    level = materialize(level, "grams")
    one = level.where("c = 1").select(F.lit(len(ORDERS)).alias("c"), "g", "n")
    level = level.where("c = 0")
    for c in range(len(ORDERS) - 1, -1, -1):  # each shorter context from the counts of the longer one
        g = F.col("g").bitwiseAND(F.lit((1 << 8 * (ORDERS[c] + 1)) - 1))
        level = level.groupBy(g.alias("g")).agg(F.sum("n").alias("n"))
        one = one.union(level.select(F.lit(c).alias("c"), "g", "n"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, OFFSET[-1]))
        for b in batches:
            for c, part in b.groupby("c"):
                g, n = part["g"].to_numpy(), part["n"].to_numpy()
                at, bit = slots_of(c, g >> 8, g & 0xFF), BIT[g & 0xFF]
                each = np.broadcast_to(n[:, None], at.shape)
                for v in (0, 1):
                    np.add.at(total[v], at[bit == v], each[bit == v])
        slot = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"slot": slot, "z": total[0][slot].astype(np.int64), "o": total[1][slot].astype(np.int64)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [b["slot"].to_numpy(np.int32).tobytes() + b[["z", "o"]].to_numpy(np.float32).T.tobytes()]})

    # At most one row a slot is packed, whatever the corpus.
    slots = one.mapInPandas(fill, "slot long, z long, o long").groupBy("slot").agg(F.sum("z").alias("z"), F.sum("o").alias("o"))
    out = np.zeros((2, OFFSET[-1]), np.float32)
    for r in slots.mapInPandas(pack, "x binary").toLocalIterator():
        at, n = np.frombuffer(r["x"], np.int32, len(r["x"]) // 12), np.frombuffer(r["x"], np.float32)
        out[:, at] = n[len(at) :].reshape(2, -1)
    return out[0], out[1]


# --- mixing ----------------------------------------------------------------------------------------------------------


def stretched(same: np.ndarray, total: np.ndarray, bit: np.ndarray, less: int) -> np.ndarray:
    """ln(p1/p0) of counters with `total` uses, `same` of them by the bit that came; `less` uses of it taken out."""
    d = np.log((np.maximum(same - less, 0) + DELTA).astype(np.float32)) - np.log((total - same + DELTA).astype(np.float32))
    return np.where(bit == 1, d, -d)


def long_inputs(run: Run, rows: np.ndarray, classes: np.ndarray, data: Bytes, less: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the word so far, without and with class: stretched inputs (2, n, 8); and the gates (n, 8)."""
    x = np.zeros((2, len(data.byte), 8), np.float32)
    gate = np.zeros((len(data.byte), 8), np.uint8)
    for d in range(min(DEPTH, int(data.place.max(initial=-1)) + 1)):
        at = np.flatnonzero(data.place == d)
        if not len(at):
            continue
        r, k = rows[data.owner[at]], classes[data.owner[at]]
        uses = np.array([run.sizes(8 * d + j, r, k) for j in range(9)])  # (bit, without or with class, byte)
        bit = BIT[data.byte[at]].T
        for c in (0, 1):
            x[c, at] = stretched(uses[1:, c], uses[:-1, c], bit, less).T
        seen = np.maximum(uses[:-1] - less, 0).astype(np.float32)
        gate[at] = (2 * np.minimum(7, np.log2(1 + seen[:, 0]).astype(np.uint8)) + (seen[:, 1] > 0)).T
    return x, gate + (BITS * 16).astype(np.uint8)


class Mixer:
    """Weights by gate, and the map (apm) that refines what they give, by the bits of the byte so far."""

    def __init__(self):
        self.w = np.full((GATES, INPUTS + 1), 0.15, np.float32)
        self.w[:, -2], self.w[:, -1] = 0.4, 0
        self.sums = np.zeros((2, 256 * BUCKETS + 1))

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.w.T)
        st = w[-1].take(gate)
        for k, each in enumerate(x):
            st += each * w[k].take(gate)
        return np.clip(st, -11.9, 11.9)

    @staticmethod
    def cells(byte: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (st + np.float32(12)) * np.float32((BUCKETS - 1) / 24)
        low = at.astype(np.int32)
        return NODE[byte].astype(np.int32) * BUCKETS + low, at - low.astype(np.float32)

    def settle(self) -> None:
        prior = 1 / (1 + np.exp(-(np.arange(256 * BUCKETS + 1) % BUCKETS * (24 / (BUCKETS - 1)) - 12)))
        self.apm = ((self.sums[1] + 8 * prior) / (self.sums[0] + self.sums[1] + 8)).astype(np.float32)

    def probability(self, x: np.ndarray, gate: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Probability of a one at each bit of the bytes."""
        st = self.mix(x, gate)
        at, share = self.cells(byte, st)
        a = self.apm.take(at)
        p = np.float32(0.5) * (1 / (1 + np.exp(-st)) + a + (self.apm.take(at + 1) - a) * share)
        return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))


SLOPES = np.cumsum([GATES * (INPUTS + 1), GATES * (INPUTS + 1) ** 2, GATES, 2 * (256 * BUCKETS + 1)])


def stretched_without_own(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln(p1/p0) of each slot with one use taken out, of a zero and of a one: at twice the slot, and the place after."""
    less = lambda n: np.log(np.maximum(n - 1, 0) + DELTA)
    return np.stack([np.log(ones + DELTA) - less(zeros), less(ones) - np.log(zeros + DELTA)], 1).ravel()


def slopes(run: Run, short: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Over the training uses of a run, each taken out of its own counters: by gate, slopes and curvatures of the code
    length by the weights, and the length; then what the map counts."""
    rows, classes = np.nonzero((run.n > 0) & (run.kind != DIGEST)[:, None])
    data = Nodes(run, rows, classes)
    n = np.bincount(data.node, run.n[rows, classes][data.unit], len(data.byte))
    longer, gates = long_inputs(run, rows, classes, data, 1)
    contexts = [data.context(c, classes) for c in range(len(TABLE_BITS))]
    slope, curve, length = np.zeros((GATES, INPUTS + 1)), np.zeros((GATES, INPUTS + 1, INPUTS + 1)), np.zeros(GATES)
    sums = np.zeros(2 * (256 * BUCKETS + 1))
    for s in range(0, len(n), 4096):
        part = slice(s, s + 4096)
        byte = data.byte[part]
        bit = BIT[byte]
        x = np.ones((INPUTS + 1, len(byte), 8), np.float32)
        for c, value in enumerate(contexts):
            x[c] = short.take(2 * slots_of(c, value[part], byte) + bit)
        x[-3:-1] = longer[:, part]
        gate = gates[part]
        st = mixer.mix(x[:-1], gate.astype(np.int64))
        uses = np.broadcast_to(n[part, None], bit.shape)
        at, share = mixer.cells(byte, st)
        at, high = (at + bit * (len(sums) // 2)).ravel(), (share * uses).ravel()
        sums += np.bincount(at, uses.ravel() - high, len(sums)) + np.bincount(at + 1, high, len(sums))
        sign = np.float32(2) * bit.astype(np.float32) - 1
        miss = 1 / (1 + np.exp(sign * st))
        length -= np.bincount(gate.ravel(), (uses * np.log1p(-miss)).ravel(), GATES)
        # Far from the middle the true curvature vanishes, and steps by it would overshoot: a miss counts there too.
        bend = (uses * np.maximum(miss * (1 - miss), miss / (np.abs(st) + 4))).astype(np.float32).ravel()
        miss = (uses * (sign * miss * (np.abs(st) < 11.89))).astype(np.float32).ravel()
        order = np.argsort(gate.ravel(), kind="stable")
        cut = np.searchsorted(gate.ravel()[order], np.arange(GATES + 1))
        x, miss, bend = x.reshape(INPUTS + 1, -1).take(order, 1), miss[order], bend[order]
        bent = x * bend
        for j in np.flatnonzero(np.diff(cut)).tolist():
            of = slice(cut[j], cut[j + 1])
            slope[j] += x[:, of] @ miss[of]
            curve[j] += bent[:, of] @ x[:, of].T
    return np.concatenate([slope.ravel(), curve.ravel(), length, sums])


def learn_weights(runs: DataFrame, ends: dict, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
    """Weights and map of all training uses: Newton steps for each gate until another would save next to nothing."""
    mixer = Mixer()
    first = mixer.w.astype(np.float64)
    w = before = first
    least = np.full(GATES, np.inf)
    sent = runs.sparkSession.sparkContext.broadcast((ends, stretched_without_own(zeros, ones).astype(np.float16)))
    for i in range(STEPS):
        mixer.w = w.astype(np.float32)

        def pass_over(row: dict, mixer: Mixer = mixer) -> np.ndarray:
            ends, short = sent.value
            run = Run.unpack(row)
            run.head, run.tail = ends[row["first"], row["last"]]
            return slopes(run, short, mixer)

        slope, curve, length, sums, _ = np.split(summed(runs, pass_over, int(SLOPES[-1])), SLOPES)
        mixer.sums = sums.reshape(2, -1)
        slope = slope.reshape(w.shape) - PRIOR * (w - first)
        curve = curve.reshape(GATES, INPUTS + 1, INPUTS + 1) + PRIOR * np.eye(INPUTS + 1)
        cost = length + PRIOR / 2 * ((w - first) ** 2).sum(1)
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        rose = cost > least
        left = np.where(rose, cost - least, (step * slope).sum(1) / 2).sum()
        if left <= SETTLED * length.sum() or i == STEPS - 1:
            break
        # A gate that a step made worse goes half the way back.
        w, before, least = np.where(rose[:, None], (w + before) / 2, w + step), np.where(rose[:, None], before, w), np.minimum(cost, least)
    sent.destroy()
    mixer.settle()
    return mixer


def score_units(run: Run, short: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 probability of each unit after each class that it occurs with: (n, CLASSES), 0 elsewhere."""
    out = np.zeros((len(run.keys), CLASSES))
    rows, classes = np.nonzero((run.mask[:, None] >> np.arange(CLASSES)) & 1 & (run.kind != DIGEST)[:, None])
    data = Nodes(run, rows, classes)
    longer, gates = long_inputs(run, rows, classes, data, 0)
    contexts = [data.context(c, classes) for c in range(len(TABLE_BITS))]
    logs = np.empty(len(data.byte))
    for s in range(0, len(logs), 4096):  # so that the arrays of a step stay in the cache
        part = slice(s, s + 4096)
        byte = data.byte[part]
        x = [short.take(slots_of(c, value[part], byte)) for c, value in enumerate(contexts)]
        p = mixer.probability([*x, longer[0, part], longer[1, part]], gates[part].astype(np.int64), byte)
        logs[part] = np.where(BIT[byte] == 1, p, 1 - p).prod(1, dtype=np.float64)
    out[rows, classes] = np.bincount(data.unit, np.log10(logs)[data.node], len(rows))
    return out


def word_scores(runs: DataFrame, ends: dict, short: np.ndarray, mixer: Mixer) -> DataFrame:
    """(key, kind, c, n0.. as s0..) of every unit: uses in training, and its log10 probability after each class."""
    sent = runs.sparkSession.sparkContext.broadcast((ends, short, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, short, mixer = sent.value
        short = short.astype(np.float32)
        for b in batches:
            for row in rows_of(b):
                run = Run.unpack(row)
                run.head, run.tail = ends[row["first"], row["last"]]
                s = score_units(run, short, mixer)
                yield pa.RecordBatch.from_arrays([pa.array(run.keys, pa.binary()), pa.array(run.kind.astype(np.int32)), pa.array(run.n.sum(1)), *(pa.array(c) for c in s.T)], names=["key", "kind", "c", *(f"s{k}" for k in range(CLASSES))])

    return runs.mapInArrow(run, f"key binary, kind int, c long, {', '.join(f's{k} double' for k in range(CLASSES))}")


# --- texts -----------------------------------------------------------------------------------------------------------


def _hash(key: bytes) -> int:
    h = xxhash.xxh64_intdigest(key, 42)  # as xxhash64() of the same bytes
    return h - (1 << 64) * (h >> 63)


def score_texts(docs: DataFrame, common: int = COMMON, run_size: int = RUN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text.

    Null and empty texts are one end token. Documents with a null id are neither held out nor trained on. Rows map
    one to one; repeated rows stay, and ids of any size pass as they are. Extra columns are left aside. Rare words are
    told apart by a 64-bit hash. With nothing to train on, known counts are zero and both scores are those of empty
    models. Scores do not depend on how rows are dealt to partitions.
    """
    spark = docs.sparkSession
    fold: Column = F.crc32(F.col("doc_id").cast("string")) % 10
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.coalesce(fold != 0, F.lit(False)).alias("train"), "text")
    gate = Gate.of(d.where("train"))
    units = materialize(count_units(d, gate), "units")
    tokens = units.where(F.col("kind") != PART)
    uses = sum(F.col(f"n{k}") for k in range(CLASSES))
    total, distinct = tokens.agg(F.coalesce(F.sum(uses), F.lit(0)), F.count_if(uses > 0)).first()
    runs = materialize(sorted_runs(units, units.count(), run_size), "runs")
    ends = join_ends([r.asDict() for r in runs.select("first", "last", "head", "tail").collect()])  # 12 KB a run
    zeros, ones = short_tables(runs)
    mixer = learn_weights(runs, ends, zeros, ones)
    short = (np.log(ones + DELTA) - np.log(zeros + DELTA)).astype(np.float16)
    words = materialize(word_scores(runs, ends, short, mixer), "word-scores")
    # The least count from which on words are at most `common`: counts are few, so this is a small table.
    at, least = 0, 1
    for c, many in words.where(F.col("kind") == WORD).groupBy("c").agg(F.count("*").alias("m")).orderBy(F.desc("c")).limit(common).toLocalIterator():
        at += many
        if at > common:
            least = c + 1
            break
    scores = [f"s{k}" for k in range(CLASSES)]
    often = (F.col("kind") == WORD) & (F.col("c") >= least)
    top = words.where(often).toPandas()
    sent = spark.sparkContext.broadcast(([bytes(k) for k in top["key"]], top["c"].to_numpy(), top[scores].to_numpy(np.float64), gate))
    kept: list = []

    def read(texts: list[str | None]) -> list[tuple]:
        if not kept:
            keys, c, s, gate = sent.value
            words = [k if k == END else k[:-1] for k in keys]
            held = set(words)
            more = [w for w in gate.at if w not in held]  # words that tell classes, rare as they may be
            pad = np.zeros((1, CLASSES)), np.zeros((len(more), CLASSES))
            log_c = np.r_[0.0, np.log10(c + 0.1), np.zeros(len(more))]
            there = np.r_[False, np.ones(len(c), bool), np.zeros(len(more), bool)]
            kept.append((Lookup(gate, [*words, *more]), there, np.concatenate([pad[0], s, pad[1]]), log_c, np.r_[0, c, np.zeros(len(more), np.int64)] > 0))
        look, there, score, log_c, known = kept[0]
        split = [[*words_of(t), END] for t in texts]
        ids, classes, begins = look.read(split)
        sums = lambda x: np.add.reduceat(x, begins).tolist()  # noqa: E731  every text has its end at least
        rare, flat = np.flatnonzero(~there[ids]), begins.tolist()
        rest: list[Counter] = [Counter() for _ in split]
        for p, t, k in zip(rare.tolist(), (np.searchsorted(begins, rare, side="right") - 1).tolist(), classes[rare].tolist(), strict=True):
            for u, kind in units_of(split[t][p - flat[t]]):
                rest[t][_hash(u), k, kind] += 1
        sizes = [len(b" ".join(ws)) for ws in split]
        cols = map(len, split), sums(known[ids].astype(np.int64)), sums(log_c[ids]), sums(score[ids, classes]), sizes, ([{"w": w, "k": k, "m": m} for (w, k, _), m in r.items()] for r in rest)
        return list(zip(*cols, strict=True))

    added = "n_tokens long, n_common long, common_log double, common_score double, n_bytes long, rest array<struct<w:long,k:int,m:long>>"
    seen = materialize(per_text(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), "text", read, added), "scored")
    rest = seen.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    rare = words.where(~often).select(F.xxhash64("key").alias("w"), "kind", "c", F.array(*scores).alias("s"))
    rest = rest.join(rare.hint("shuffle_merge"), "w")
    base = F.col("kind") != PART
    rest = rest.groupBy("row").agg(
        F.sum(F.when(base, F.col("m") * F.log10(F.col("c") + 0.1)).otherwise(0.0)).alias("rest_log"), F.sum(F.when(base & (F.col("c") > 0), F.col("m")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("m") * F.get("s", F.col("k"))).alias("rest_score"),
    )
    out = seen.drop("rest").join(rest.hint("shuffle_merge"), "row", "left")
    score = F.col("common_score") + F.coalesce("rest_score", F.lit(0.0))
    base_score = F.col("common_log") + F.coalesce("rest_log", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + 0.1 * (distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
