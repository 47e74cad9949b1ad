"""Toxicity through a noisy channel.

Disguised tokens (leetspeak, repeated letters, letters set apart) become character lattices, which a Viterbi search
decodes under a character trigram model counted over all documents. The restored text is what is scored: a word's
evidence is the share of toxic training documents among those that hold one of its features (word starts and the whole
word); a logistic model over the strongest evidences, their number and the length of the text gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, map_texts, materialize, per_text, slices, table

SAMPLE = 20_000  # labelled documents of each class that the classifier is fitted on, at most
PREFIXES = (3, 4, 5, 6)
PRIOR = 2.0  # clean documents that each feature is taken to have besides those seen
LEAST = 3  # toxic documents that a feature needs
THRESHOLD = 0.7
STRONG = 0.5  # evidence that is counted
RAREST = 1e-6  # share of all trigrams that a trigram needs to be kept: at most a million are
# Characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
BETWEEN = "._-*~'`^"
REPEATED = re.compile(r"(.)\1{3,}", re.S)
ODD = re.compile(r"[0-9@$!|+€£(._\-*~'`^]|(.)\1\1|(.)\2.*(.)\3")
APART = re.compile(r"(?<![^\s])[\"'(]?[^\W_](?:[ ._*~-]{1,3}[^\W_]){2,}(?![^\W_])", re.U)
TRAILING = "%&*#$!.,|?;:+\"')("


def clean(token: str) -> str:
    return token.rstrip(TRAILING).lstrip("%&*#.,|?;:\"'(")


def features(token: str) -> list[str]:
    w = clean(token)
    return [w[:k] for k in PREFIXES if len(w) > k] + ["=" + w] if len(w) >= 3 else []


class CharModel:
    """Interpolated character trigrams of words, `^` before and `$` after."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri = trigrams
        self.bi, self.uni = Counter(), Counter()
        for g, n in trigrams.items():
            self.bi[g[:2]] += n
            self.uni[g[2]] += n
        self.mid = Counter()
        for g, n in trigrams.items():
            self.mid[g[1:]] += n
        self.one = Counter()
        for g, n in self.mid.items():
            self.one[g[0]] += n
        self.total = sum(self.uni.values()) or 1

    def cost(self, a: str, b: str, c: str) -> float:
        p = 0.02 * (self.uni[c] + 0.5) / (self.total + 100)
        if n := self.one[b]:
            p += 0.28 * self.mid[b + c] / n
        if n := self.bi[a + b]:
            p += 0.7 * self.tri.get(a + b + c, 0) / n
        return -math.log(p)


def restore(token: str, model: CharModel) -> str:
    """The likeliest plain words behind a token or a run of letters set apart: exact Viterbi over its lattice, a state
    being the last two characters emitted. Edges: a letter as it is; a stand-in as one of its letters, or dropped if it
    may be punctuation; a repeated character dropped; a separator dropped, or a space kept as the end of a word. '' if
    a character has no edge."""
    token = REPEATED.sub(r"\1\1\1", token)  # further copies would be dropped at the same cost on every path
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    last = ""
    for x in token:
        edges: list[tuple[str, float]] = []
        if x.isalpha():
            edges.append((x, 0.0))
        edges += [(y, 0.4) for y in LEET.get(x, "")]
        if x in LEET and not x.isalnum():
            edges.append(("", 1.0))
        if x == last or x.isalpha() and x in LEET.get(last, "") or last.isalpha() and last in LEET.get(x, ""):
            edges.append(("", 0.7))
        if x in BETWEEN or x == " ":
            edges.append(("", 0.1))
        if x == " ":
            edges.append((" ", 0.4))
        if not edges:
            return ""
        new: dict[str, tuple[float, tuple]] = {}
        for s, (cost, out) in states.items():
            for y, extra in edges:
                if not y:
                    t, c, o = s, cost + extra, out
                elif y == " ":
                    t, c, o = "^^", cost + extra + model.cost(s[0], s[1], "$"), (out, y)
                else:
                    t, c, o = s[1] + y, cost + extra + model.cost(s[0], s[1], y), (out, y)
                if t not in new or c < new[t][0]:
                    new[t] = (c, o)
        states, last = new, x
    _, path = min(((c + model.cost(s[0], s[1], "$"), o) for s, (c, o) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, y = path
        letters.append(y)
    return "".join(reversed(letters))


class Restorer(dict):
    """token -> word as restored: suspect tokens are decoded, others stay. Keeps up to `most` tokens."""

    def __init__(self, model: CharModel, most: int = 1_000_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, token: str) -> str:
        if len(self) > self.most:
            self.clear()
        core = clean(token)
        suspect = len(core) >= 3 and ODD.search(core) and any(c.isalpha() for c in core)
        self[token] = word = suspect and restore(core, self.model) or core
        return word

    def runs(self, low: str) -> list[str]:
        """The words of runs of letters set apart."""
        return [w for m in APART.finditer(low) for w in restore(m[0].strip("\"'("), self.model).split()]

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text, of runs of letters set apart too."""
        low = text.lower()
        return {*map(self.__getitem__, set(low.split())), *self.runs(low)}


class Evidence(dict):
    """token -> evidence of its word as restored. Keeps up to `most` tokens."""

    def __init__(self, lexicon: dict[str, float], restorer: Restorer, most: int = 1_000_000):
        super().__init__()
        self.lexicon, self.restorer, self.most = lexicon, restorer, most

    def of(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) > self.most:
            self.clear()
        self[token] = e = self.of(self.restorer[token])
        return e

    def read(self, text: str) -> list[float]:
        """What the classifier reads of a text: the evidences of its distinct restored words, and how many tokens."""
        low = text.lower()
        tokens = set(low.split())
        found = {self.restorer[t]: self[t] for t in tokens if self[t]}
        found |= {w: e for w in self.restorer.runs(low) if (e := self.of(w))}
        return _design(sorted(found.values(), reverse=True), len(tokens))


def _design(found: list[float], words: int) -> list[float]:
    return [1.0, *(found + [0.0, 0.0, 0.0])[:3], math.log1p(sum(e >= STRONG for e in found)), math.log1p(words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def trigram_codes(words: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of `^^word$`, three 21-bit code points in a number, and how often each is used."""
    c = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    inside = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(sizes - 2, sizes)
    at = np.flatnonzero(inside)
    found, code = pd.factorize(c[at] << 42 | c[at + 1] << 21 | c[at + 2]) if len(at) else (at, at)
    return code, np.bincount(found, np.repeat(uses, sizes)[at], len(code)).astype(np.int64)


def char_trigrams(docs: DataFrame, rarest: float = RAREST, most: int = 300_000) -> dict[str, int]:
    """How often each character trigram stands in the words (of letters alone) of all documents."""

    def count(batches: Iterator) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            known = [(w, n) for t, n in words.items() if (w := clean(t)).isalpha()]
            words.clear()
            code, n = trigram_codes([w for w, _ in known], np.array([n for _, n in known], np.int64))
            grams = ["".join(chr(c >> k & 0x1FFFFF) for k in (42, 21, 0)) for c in code.tolist()]
            return pa.RecordBatch.from_pydict({"g": grams, "n": n}, pa.schema([("g", pa.string()), ("n", pa.int64())]))

        for b in batches:
            for part in slices(b, "text"):
                for text in part.column("text").to_pylist():
                    words.update((text or "").lower().split())
                if len(words) > most:
                    yield flush()
        yield flush()

    counts = materialize(docs.select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")), "trigrams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") >= total * rarest).toPandas()
    return dict(zip(rows["g"], rows["n"].tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, int], np.ndarray]:
    """Lexicon, trigrams and weights. Trigrams are of all documents; the classifier is fitted on labelled rows outside
    the held-out third, at most `sample` of each class."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.where(~is_held_out())
    n = dict(rows.groupBy("toxic").count().collect())
    picked = [first_by_hash(rows.where(F.col("toxic") == y), ["doc_id"], sample, n.get(y, 0)) for y in (0, 1)]
    train_docs = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # 2 * sample ids at most
    train_docs = materialize(train_docs.select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")
    trigrams = char_trigrams(docs)
    sent = docs.sparkSession.sparkContext.broadcast(trigrams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(CharModel(sent.value))
        for b in batches:
            n = (Counter(), Counter())
            for text, y in zip(b["text"], b["toxic"], strict=True):
                n[y].update({f for w in restorer.words(text) for f in features(w)})
            keys = list(n[0] | n[1])
            yield pd.DataFrame({"f": keys, "c": [n[0][k] for k in keys], "t": [n[1][k] for k in keys]})

    counts = train_docs.mapInPandas(count, "f string, c long, t long").groupBy("f").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    lex = counts.where(f"t >= {LEAST} and t >= 0.3 * (t + c + {PRIOR})").toPandas()  # bounded by the sample
    counted = {f: (c, t) for f, c, t in zip(lex["f"], lex["c"], lex["t"], strict=True)}
    # Evidence of training documents leaves the document itself out of the counts.
    full = {f: t / (t + c + PRIOR) for f, (c, t) in counted.items()}
    less = [{f: t / (t + c - 1 + PRIOR) if c else full[f] for f, (c, t) in counted.items()}, {f: (t - 1) / (t - 1 + c + PRIOR) for f, (c, t) in counted.items()}]
    both = docs.sparkSession.sparkContext.broadcast((less, trigrams))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        less, trigrams = both.value
        restorer = Restorer(CharModel(trigrams))
        ev = [Evidence(x, restorer) for x in less]
        for b in batches:
            yield pd.DataFrame({"x": [ev[y].read(t) for t, y in zip(b["text"], b["toxic"], strict=True)], "y": b["toxic"].to_numpy()})

    seen = train_docs.mapInPandas(weigh, "x array<double>, y int").toPandas()  # six numbers for each sampled row
    x, y = np.array(seen["x"].tolist(), float).reshape(-1, len(_design([], 0))), seen["y"].to_numpy(float)
    return full, trigrams, fit_logistic(x, y) if len(x) else np.array([-4.0, 0, 0, 0, 0, 0])


class Judge:
    """Score and evidences of texts, with a trained lexicon, trigrams and weights."""

    def __init__(self, lexicon: dict[str, float], trigrams: dict[str, int], weights: np.ndarray):
        self.evidence, self.weights = Evidence(lexicon, Restorer(CharModel(trigrams))), weights

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([self.evidence.read(t or "") for t in texts], float).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), x


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the text's evidences m1..m3, for every row.

    Null and empty texts score as texts without evidence. Rows map one to one; repeated rows stay; null ids count as
    held out false. With no labels every text gets the same low score. Extra columns are left aside.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    kept: list[Judge] = []

    def run(texts: list[str | None]) -> list[tuple]:
        if not kept:
            kept.append(Judge(*sent.value))
        score, x = kept[0].score(texts)
        return list(zip(score.tolist(), (score >= THRESHOLD).astype(int).tolist(), *x[:, 1:4].T.tolist(), strict=True))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "text")
    return per_text(d, "text", run, "score double, predicted int, m1 double, m2 double, m3 double")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that score as toxic; null and empty texts, null ids and repeated rows stay as they are; all
    columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    kept: list[Judge] = []

    def keep(texts: list[str | None]) -> list[bool]:
        if not kept:
            kept.append(Judge(*sent.value))
        return (kept[0].score(texts)[0] < THRESHOLD).tolist()

    return map_texts(docs, keep=keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
