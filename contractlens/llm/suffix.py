"""Removal of repeated byte strings by sorting suffixes, deep and shallow.

A byte goes if a string of 100 bytes that covers it also starts earlier. Whole copies of a text are settled by its
hash. For the rest, each 100-byte window is stood for by its least 32-byte gram (leftmost on ties), so equal windows
have equal grams at equal offsets, and only grams that occur again in the corpus are looked at. Around each of them
the suffix to the right and the reversed prefix to the left are sorted within the gram's group: a multikey sort by
eight-byte symbols to a shallow depth, then a blind trie for what is still tied. The common prefix lengths of
neighbours give, for every split of a window into left and right part, the classes of equal windows; all but the
first of a class (by document, then position) are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

LENGTH, GRAM = 100, 32
OFFSETS = LENGTH - GRAM + 1  # window starts that a gram can stand for
LEFT, RIGHT = OFFSETS - 1, LENGTH  # bytes kept around a gram's start
SHALLOW = 2  # eight-byte symbols sorted by before tries take over
PIECE = 1 << 22  # bytes hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    power, k = BASE, 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = h[:-k] * power + h[k:]
            power, k = power * power, 2 * k
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, least offset, largest offset) of the grams that stand for the windows of a text."""
    parts = []
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        raw = np.frombuffer(data, np.uint8)[at : at + PIECE + LENGTH - 1]
        if len(raw) < LENGTH:
            continue
        h = gram_hashes(raw)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= OFFSETS:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[: len(low) - (OFFSETS - k)], low[OFFSETS - k :])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[begins[1:], len(place)] - 1
        p = place[begins]
        parts.append((h[p].view(np.int64), p + at, p - ends, p - begins))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4


def multikey_sort(group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then symbol by symbol; and for each in order, the symbols shared with the one before (-1: none
    of its group)."""
    order = np.lexsort([*symbols.T[::-1], group])
    g, s = group[order], symbols[order]
    same = np.r_[False, g[1:] == g[:-1]]
    shared = np.where(same, 0, -1)
    for k in range(symbols.shape[1]):
        same = same & np.r_[False, s[1:, k] == s[:-1, k]]
        shared += same
    return order, shared


class BlindTrie:
    """Sorts strings of one length that share a long prefix: inner nodes know a depth and branch on one byte; the
    strings are compared only at the leaf that a blind descent ends in."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf is the index of its first string
        self.same: dict[int, list[int]] = {0: [0]}
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while type(node) is list:
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        if s == other:
            self.same[node].append(i)
            return
        x = int.from_bytes(s) ^ int.from_bytes(other)
        depth = len(s) - (x.bit_length() + 7) // 8
        self.same[i] = [i]
        parent, node = None, self.root
        while type(node) is list and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = i
            return
        new = [depth, {other[depth]: node, s[depth]: i}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the bytes that each shares with the one before."""
        order, shared, size = [], [], len(self.strings[0])
        todo: list[tuple] = [(self.root, 0)]
        while todo:
            node, lcp = todo.pop()
            if type(node) is list:
                keys = sorted(node[1])
                todo += [(node[1][k], node[0] if n else lcp) for n, k in reversed(list(enumerate(keys)))]
            else:
                for n, i in enumerate(self.same[node]):
                    order.append(i)
                    shared.append(size if n else lcp)
        return order, shared


def sort_suffixes(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings within their groups, and each one's common prefix with the one before (-1: none)."""
    size = len(strings[0])
    raw = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, size)
    shallow = min(SHALLOW, size // 8)
    symbols = np.ascontiguousarray(raw[:, : 8 * shallow]).view(">u8").astype(np.uint64)
    order, shared = multikey_sort(group, symbols)
    lcp = np.empty(len(order), np.int64)
    begins = np.flatnonzero(shared < shallow)
    for b, e in zip(begins.tolist(), np.r_[begins[1:], len(order)].tolist(), strict=True):
        if b and shared[b] >= 0:
            x = int.from_bytes(strings[order[b]][: 8 * shallow]) ^ int.from_bytes(strings[order[b - 1]][: 8 * shallow])
            lcp[b] = 8 * shallow - (x.bit_length() + 7) // 8
        else:
            lcp[b] = -1
        if e - b > 1:
            deep, common = BlindTrie([strings[i] for i in order[b:e]]).walk()
            first = lcp[b]
            order[b:e] = order[b:e][deep]
            lcp[b:e] = common
            lcp[b] = first
    return order, lcp


def covered(group: np.ndarray, left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(row, first offset, last offset) of the runs of windows that an earlier row of the group has too. Rows come in
    the order that says which is earlier."""
    n = len(group)
    ids, ends = [], []
    for strings in (left, right):
        order, lcp = sort_suffixes(group, strings)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        ids.append(back)
        ends.append(lcp)
    again = np.zeros((n, OFFSETS + 1), bool)
    for off in range(OFFSETS):
        rows = np.flatnonzero((least <= off) & (off <= most))
        if len(rows) < 2:
            continue
        lc = np.cumsum(ends[0] < off)[ids[0][rows]]
        rc = np.cumsum(ends[1] < LENGTH - off)[ids[1][rows]]
        codes, found = pd.factorize(lc * (n + 1) + rc)
        first = np.full(len(found), n, np.int64)
        np.minimum.at(first, codes, rows)
        again[rows, off] = rows > first[codes]
    step = np.diff(again.astype(np.int8), axis=1, prepend=0)
    row, a = np.nonzero(step == 1)
    _, z = np.nonzero(step == -1)
    return np.stack([row, a, z - 1], axis=1)


def _first_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with place and hash, and (k, h, first): whether each is the first of its text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), F.xxhash64("text", F.lit(5)).alias("h"), "doc_id", "text")
    light = d.select("k", "h", F.xxhash64(F.lit(9), "text").alias("h2"))
    lead = light.groupBy("h", "h2").agg(F.min("k").alias("lead"))
    flags = light.distinct().join(lead.hint("shuffle_merge"), ["h", "h2"]).select("k", "h", (F.col("k") == F.col("lead")).alias("first"))
    return d, flags


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty; texts below 100 bytes lose nothing. Null ids come last; rows of equal id are ordered by a hash
    of the text, and rows equal in both are treated alike, so that neither removes the other. Extra columns are left
    aside.
    """
    d, flags = _first_texts(docs)
    texts = d  # each use joins on (k, h): one exchange that the others reuse

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h, text in zip(b["k"], b["h"], b["text"], strict=True):
                gram, place, least, most = anchors(text.encode("utf-8", "surrogatepass"))
                out.append(pd.DataFrame({"gram": gram, "k": k, "h": h, "at": place << 14 | least << 7 | most}))
            yield pd.concat(out) if out else pd.DataFrame({"gram": [], "k": [], "h": [], "at": []}, dtype="int64")

    whole = texts.join(flags.where("first").hint("shuffle_merge"), ["k", "h"], "left_semi")
    grams = whole.mapInPandas(find, "gram long, k long, h long, at long")
    again = grams.withColumn("n", F.count("*").over(Window.partitionBy("gram"))).where("n > 1").drop("n")
    marks = again.groupBy("k", "h").agg(F.collect_set(F.struct("gram", "at")).alias("marks"))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h, text, marks in zip(b["k"], b["h"], b["text"], b["marks"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    p = m["at"] >> 14
                    # Just the bytes of the windows that the gram stands for.
                    rows.append((m["gram"], k, h, m["at"], data[p - (m["at"] & 127) : p + LENGTH - (m["at"] >> 7 & 127)]))
            yield pd.DataFrame(rows, columns=["gram", "k", "h", "at", "context"])

    contexts = texts.join(marks.hint("shuffle_merge"), ["k", "h"]).mapInPandas(around, "gram long, k long, h long, at long, context binary")
    contexts = contexts.repartition("gram").sortWithinPartitions("gram", "k", "h", "at")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None

        def done(part: pd.DataFrame) -> pd.DataFrame:
            part = part.drop_duplicates(["gram", "k", "h", "at"])  # of rows equal in id and text
            at = part["at"].to_numpy()
            cuts = list(zip(part["context"], (at & 127).tolist(), strict=True))
            left, right = [c[:n][::-1].ljust(LEFT, b"\0") for c, n in cuts], [c[n:].ljust(RIGHT, b"\0") for c, n in cuts]
            runs = covered(part["gram"].to_numpy(), left, right, at >> 7 & 127, at & 127)
            row = runs[:, 0]
            p = at[row] >> 14
            return pd.DataFrame({"k": part["k"].to_numpy()[row], "h": part["h"].to_numpy()[row], "s": p - runs[:, 2], "e": p - runs[:, 1] + LENGTH})

        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            last = b["gram"] == b["gram"].iloc[-1]  # the group that the next batch may go on with
            kept = b[last].reset_index(drop=True)
            part = b[~last].reset_index(drop=True)
            if len(part):
                yield done(part)
        if kept is not None and len(kept) > 1:
            yield done(kept)

    found = contexts.mapInPandas(spans, "k long, h long, s long, e long")
    per = found.groupBy("k", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for text, first, spans in zip(*(b.column(c).to_pylist() for c in ("text", "first", "spans")), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    runs: list[list[int]] = [] if first or len(data) < LENGTH else [[0, len(data)]]
                    for s, e in sorted((x["s"], x["e"]) for x in spans) if first and spans is not None else ():
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(e, runs[-1][1])
                        else:
                            runs.append([s, e])
                    at, kept = 0, []
                    for s, e in runs:
                        kept.append(data[at:s])
                        at = e
                    kept = b"".join([*kept, data[at:]])
                    rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = texts.join(flags.hint("shuffle_merge"), ["k", "h"]).join(per.hint("shuffle_merge"), ["k", "h"], "left")
    return out.select("doc_id", "text", "first", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
