"""Benchmark decontamination: rare n-gram seeds, a join, then Smith-Waterman alignment.

The documents are read once for their word n-grams that a test item may hold (a bitset of bounded size passes few
others), whatever the number of items. The hits say how many documents hold each n-gram of an item. Its seeds are the
rare ones: those that no more than twice as many documents hold as the rarest around them, so every stretch of an item
keeps seeds however often it leaked, and common phrases fall away. Hits join the seeds; the words around each are
aligned with the item, and the alignment's share of the best possible score is the pair's score. Words around a seed
that share too few words with the item to reach the threshold in any order are not aligned, which loses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

SEED = 3  # words of an n-gram
STRETCH = 4  # neighbouring n-grams of an item of which the rarest sets the measure
RARER = 2  # times the documents of the rarest that a seed may have
BITS = 1 << 27  # of the set that is broadcast, at most
SALTS = 8
MATCH, MISS, GAP = 2, -1, -1
THRESHOLD = 0.4
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SEED)], np.uint64).view(np.int64)  # n-gram codes wrap around
EDGE = ".,;:!?\"'()[]{}|%&*#$"


class Words(dict):
    """token -> code of its word (a 64-bit hash), 0 for tokens without one. Keeps up to `most` tokens."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) > self.most:
            self.clear()
        w = token.strip(EDGE)
        code = 0
        if w:
            code = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
            code -= (1 << 64) * (code >> 63)
        self[token] = code
        return code

    def read(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return codes[codes != 0]


def grams_of(codes: np.ndarray, size: int = SEED) -> np.ndarray:
    """Code of the n-gram that ends at each word; the first ones have fewer words."""
    out = np.zeros(len(codes), np.int64)
    for k in range(min(size, len(codes))):
        out[k:] += codes[: len(codes) - k] * POWERS[k]
    return out


def slot_of(grams: np.ndarray, bits: int) -> np.ndarray:
    x = grams.view(np.uint64)
    return ((x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(47))) & np.uint64(bits - 1)).astype(np.int64)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score and its first and last word in the window (end exclusive)."""
    n = len(window)
    steps = np.arange(n + 1) * -GAP
    h = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for a in item:
        diag = h[:-1] + np.where(window == a, MATCH, MISS)
        row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = h + GAP
        row[1:], origin[1:] = np.where(diag >= up[1:], diag, up[1:]), np.where(diag >= up[1:], start[:-1], start[1:])
        origin = np.where(row > 0, origin, np.arange(n + 1))
        row = np.maximum(row, 0)
        run = np.maximum.accumulate(row + steps)  # a gap costs the same per word, so a running maximum carries it
        from_left = run - steps
        source = np.maximum.accumulate(np.where(row + steps == run, np.arange(n + 1), 0))
        take = from_left > row
        h, start = np.where(take, from_left, row), np.where(take, origin[source], origin)
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k)
    return best


def best_leak(item: np.ndarray, codes: np.ndarray, places: list[tuple[int, int]], threshold: float) -> tuple[float, int, int] | None:
    """(score, first word, end word) of the best alignment of an item with a document's words around the places (last
    word in the document, in the item) of its seeds, if it reaches the threshold."""
    size, spans = len(item), []
    for p, j in sorted(places):
        lo = max(0, p - math.ceil(1.4 * j) - 4)
        hi = min(len(codes), p + math.ceil(1.4 * (size - j)) + 4)
        if spans and lo <= spans[-1][1] and max(hi, spans[-1][1]) - min(lo, spans[-1][0]) <= 4 * size + 32:
            spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    words, most = np.unique(item, return_counts=True)
    found = []
    for lo, hi in spans:
        window = codes[lo:hi]
        at = np.minimum(np.searchsorted(words, window), len(words) - 1)
        shared = np.minimum(np.bincount(at[words[at] == window], minlength=len(words)), most).sum()
        if shared / size < threshold:  # a match a word at most
            continue
        score, s, e = align(item, window)
        found.append((score / (MATCH * size), lo + s, lo + e))
    best = max(found, key=lambda x: (x[0], -x[1]), default=None)
    return best if best and best[0] >= threshold else None


def item_grams(items: DataFrame) -> DataFrame:
    """(item, gram, place, size, slots) of the n-grams of items; an item of fewer words is one n-gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            rows = []
            for key, text in zip(b["item"], b["text"], strict=True):
                codes = words.read(text)
                first = max(0, min(SEED, len(codes)) - 1)
                g = grams_of(codes)[first:]
                rows.append(pd.DataFrame({"item": key, "gram": g, "place": np.arange(first, len(codes)), "size": len(codes), "slot": slot_of(g, BITS)}))
            yield pd.concat(rows) if rows else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("item", "gram", "place", "size", "slot")})

    return items.mapInPandas(run, "item long, gram long, place long, size long, slot long")


def gram_set(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitset of the n-grams' slots, of 32 bits for each but BITS in all at most; and the numbers of words below SEED
    that items have."""
    n = grams.count()
    bits = min(BITS, 1 << max(16, (32 * n).bit_length()))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << 15, bool)
        block[part["slot"].to_numpy() & ((1 << 15) - 1)] = True
        return pd.DataFrame({"block": [part["slot"].iloc[0] >> 15], "x": [np.packbits(block).tobytes()]})

    slots = grams.select(F.col("slot").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()
    blocks = slots.groupBy(F.shiftright("slot", 15)).applyInPandas(pack, "block long, x binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():  # 4,096 rows of 4,096 bytes at most
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["x"], np.uint8)
    short = sorted(r["size"] for r in grams.where(F.col("size") < SEED).select("size").distinct().collect())
    return out, short


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two columns that tell their rows apart by id and text."""
    return docs.withColumns({"_leak_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_leak_h": F.xxhash64(F.coalesce("text", F.lit("")), F.lit(11))})


KEY = ["_leak_k", "_leak_h"]


def gram_hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(key.., gram, at) of the documents' n-grams (at: last word) that are likely an item's: one pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(gram_set(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, short = sent.value
        words = Words()
        for whole in batches:
            for b in slices(whole, "text"):
                row, gram, at = [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    codes = words.read(text)
                    for size in (*short, SEED):
                        g = grams_of(codes, size)
                        slot = slot_of(g, len(seen) * 8)
                        hit = np.flatnonzero(seen[slot >> 3] >> (7 - (slot & 7)) & 1)
                        hit = hit[hit >= size - 1]
                        if len(hit):
                            row.append(np.full(len(hit), i))
                            gram.append(g[hit])
                            at.append(hit)
                if row:
                    pick = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in KEY), pa.array(np.concatenate(gram)), pa.array(np.concatenate(at).astype(np.int64))], names=[*KEY, "gram", "at"])

    d = _keyed(docs).select(*KEY, F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, "_leak_k long, _leak_h long, gram long, at long").distinct()


def rare_seeds(grams: DataFrame, hits: DataFrame) -> DataFrame:
    """(item, gram, place) of the n-grams that some document holds and that are rare in their stretch of the item."""
    df = hits.select(*KEY, "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    g = grams.join(df.hint("shuffle_merge"), "gram").withColumn("stretch", F.floor(F.col("place") / STRETCH))
    least = g.groupBy("item", "stretch").agg(F.min("df").alias("least"))
    return g.join(least.hint("shuffle_merge"), ["item", "stretch"]).where(F.col("df") <= RARER * F.col("least")).select("item", "gram", "place")


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key.., found array) of the documents that hold a seed, with the items and where the seeds stand."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
    grams = materialize(item_grams(items.select("item", "text")), "item-grams")
    hits = materialize(gram_hits(docs, grams), "gram-hits")
    seeds = rare_seeds(grams, hits)
    # A gram that very many documents hold is dealt to several tasks, each with its seeds.
    seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = hits.withColumn("salt", F.pmod(F.col("_leak_h"), F.lit(SALTS))).join(seeds.hint("shuffle_merge"), ["gram", "salt"])
    pairs = met.groupBy(*KEY, "item").agg(F.collect_set(F.struct("at", "place")).alias("places"))
    pairs = pairs.join(items.hint("shuffle_hash"), "item")
    return pairs.groupBy(*KEY).agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"), "places")).alias("_leak_found"))


LEAK = "array<struct<item_id:long,score:double,first_word:long,end_word:long>>"


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """(key.., doc_id, leaks) of the documents that hold a seed."""
    met = _keyed(docs).select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = met.join(candidates(docs, benchmark).hint("shuffle_merge"), KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for text, found in zip(b.column("text").to_pylist(), b.column("_leak_found").to_pylist(), strict=True):
                    codes, leaks = words.read(text), []
                    for f in found:
                        if best := best_leak(words.read(f["item_text"]), codes, [(p["at"], p["place"]) for p in f["places"]], threshold):
                            leaks.append({"item_id": f["item_id"], "score": best[0], "first_word": best[1], "end_word": best[2]})
                    rows.append(leaks)
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "doc_id")), pa.array(rows, kind)], names=[*KEY, "doc_id", "leaks"])

    return met.mapInArrow(run, f"_leak_k long, _leak_h long, doc_id long, leaks {LEAK}")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every pair whose best alignment reaches the threshold.

    Null and empty texts and items match nothing. Repeated documents give a row each; repeated items count once per
    item_id and text. Words are what is left of lower-cased tokens without edge punctuation; they and n-grams are told
    apart by 64-bit hashes. Ids pass as they are, null or not; extra columns are left aside.
    """
    return _leaks(docs, benchmark, threshold).select("doc_id", F.explode("leaks").alias("f")).select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a copy of an item; all columns stay, as do null and empty texts and null ids."""
    gone = materialize(_leaks(docs, benchmark, threshold).where("size(leaks) > 0").select(*KEY).distinct(), "contaminated")
    return _keyed(docs).join(gone.hint("shuffle_merge"), KEY, "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
