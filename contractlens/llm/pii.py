"""Personal data: base rules, and a character tagger that adds what the rules miss.

A bidirectional LSTM with CRF transitions learns from labelled passages of a bounded sample, most of them rewritten
into forms that the rules do not know (`name at host dot com`, `(at)`, other digit grouping, `10 . 0 . 0 . 1`). A span is
added where its content fits its kind and no base span is touched. Its windows cover every character that such a
content can hold, with room on both sides: what `fits` takes for an address is an `at` between pieces that dots join,
and for a number a stretch with digits and without letters, each however long (`regions`). A tag outside of
these could not become a span. Each window is decoded by Viterbi; each character takes the tag of the window in whose
middle it lies, and the runs of tags over the whole text become spans.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, per_text, share_by_hash, table
from .spans import Span, digest, joined, ordered
from .tagger import BiLstmCrf, classes

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside a run of digits fails as its first digit does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{]\s*(?:at|AT|At)\s*[)\]}]|(?<![^\W_])(?:at|AT|At)(?=\s[^\n]{1,40}?\s(?:dot|DOT|Dot)\s)")
DOT = re.compile(r"\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+|\s*\.\s*", re.I)
AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+|\s*@\s*", re.I)
NUMBER = re.compile(r"[0-9][^A-Za-z]*")
AT_CORE = re.compile(r"@|[(\[{]\s*at\s*[)\]}]|(?<=\s)at(?=\s)", re.I)
PIECES = r"\s*(?:\s*(?:\.|[()\[\]{{}}]\s*{0}\s*[()\[\]{{}}]|(?<=\s){0}(?=\s))\s*|[{1}])*"
HOST, EMAN = re.compile(PIECES.format("dot", r"\w-"), re.I), re.compile(PIECES.format("tod", r"\w%+-"), re.I)  # the name is read backwards
WINDOW, STRIDE, REACH = 64, 32, 24
SPREAD = 25  # documents looked at for each passage
SAMPLE = 600  # passages that the tagger learns from, at most
WINDOWS = 4096  # windows that it learns from, at most


def _octet(digits: str) -> bool:
    """Whether digits, however many zeros lead, are at most 255."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL_CHARS:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", s, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(_octet(x) for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ordered(out, KINDS)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of all that contents which fit a kind can lie in: stretches of digits and whatever is no ASCII letter,
    and an `at` of any form with the pieces of a name before it and of a host after it."""
    done = 0
    for m in NUMBER.finditer(text):
        s = m.start()
        while s > done and not ("a" <= text[s - 1] <= "z" or "A" <= text[s - 1] <= "Z"):
            s -= 1
        done = m.end()
        yield s, done
    back = None
    for m in AT_CORE.finditer(text):
        host = HOST.match(text, m.end())
        if sum(map(bool, DOT.split(host[0].strip()))) < 2:
            continue
        back = back or text[::-1]
        yield len(text) - EMAN.match(back, len(text) - m.start()).end(), host.end()


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every region, and the surroundings of every trigger."""
    starts: list[int] = []
    end = -1  # what is covered with room on the right
    for a, z in sorted({*regions(text), *((m.start(), m.end()) for m in TRIGGER.finditer(text))}):
        lo, hi = max(0, a - REACH), min(len(text), z + REACH)
        if hi <= end:
            continue
        s = max(lo, end - STRIDE) if starts and lo < end else lo
        while True:
            starts.append(s)
            end = s + WINDOW
            if end >= hi:
                break
            s += STRIDE
    return starts


def _cut(cls: np.ndarray, s: int) -> np.ndarray:
    w = np.zeros(WINDOW, np.int16)
    part = cls[s : s + WINDOW]
    w[: len(part)] = part
    return w


# Ends of host names, and ways to write `@` and the dots of an address.
TLDS = ["com", "org", "net", "de", "fr", "es", "io", "info", "edu", "co.uk"]
AT_DOT = [(" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", " . ")]


def _disguise(kind: str, v: str, words: list[str], r: random.Random) -> str:
    """A value of a kind as someone may write it to hide it, often with other names or numbers in it."""
    if kind == "email":
        left, right = r.choice(AT_DOT)
        if words and r.random() < 0.8:
            name = r.choice([".", "", "_", "dot"]).join(r.choices(words, k=r.choice([1, 2, 2]))) + r.choice(["", "", str(r.randint(1, 99))])
            v = f"{name}@{r.choice(words)}{r.choice(['', str(r.randint(1, 9))])}.{r.choice(['', r.choice(words) + '.'])}{r.choice(TLDS)}"
        name, host = v.split("@")
        return (name.replace(".", right) if r.random() < 0.3 else name) + left + host.replace(".", right)
    if kind == "phone":
        v = "".join(str(r.randint(0, 9)) if c.isdigit() else c for c in v)
        return r.choice(["00" + v[1:], "00" + v[1:], v.replace(" ", "-"), v.replace(" ", "."), v.replace("-", " ")])
    if kind == "card":
        d = re.sub("[^0-9]", "", v)
        return r.choice([".", " ", "-", "  "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    return ".".join(str(r.randint(0, 255)) for _ in range(4)).replace(".", r.choice([" . ", "[.]", "(.)", " dot "]))


def _rewrite(text: str, spans: list[Span], r: random.Random) -> tuple[str, list[Span]]:
    """The text with most of its spans disguised, and decoys: numbers, dates and a plain `at` between its words."""
    words = re.findall(r"(?<![^\s])[a-z]{2,12}(?![^\s])", text)
    decoy = lambda: r.choice(["at", "dot", "at " + " ".join(r.choices(words or ["x"], k=3)) + " dot", str(r.randint(1, 10**6)), f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}"])
    out, moved, at = [], [], 0
    size = 0
    for k, s, e in spans:
        if s < at:
            continue
        before, v = text[at:s], text[s:e]
        if r.random() < 0.4 and " " in before:
            cut = r.choice([i for i, c in enumerate(before) if c == " "])
            before = f"{before[:cut]} {decoy()}{before[cut:]}"
        if r.random() < 0.75:
            v = _disguise(k, v, words, r)
        out += [before, v]
        size += len(before)
        moved.append((k, size, size + len(v)))
        size += len(v)
        at = e
    return "".join([*out, text[at:]]), moved


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> BiLstmCrf | None:
    """A tagger from the rule spans of at most `sample` passages of a share of the documents chosen by hash (about SPREAD
    documents a passage are looked at); None if there are none."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                if not text or not (spans := base_spans(text)):
                    continue
                for _, s, e in spans:
                    lo, hi = max(0, s - 120), e + 120
                    rows.append((text[lo:hi], [f"{k2}:{a - lo}:{z - lo}" for k2, a, z in spans if a >= lo and z <= hi]))
            yield pd.DataFrame(rows, columns=["text", "spans"])

    few = share_by_hash(docs.select("doc_id", "text"), ["doc_id", "text"], SPREAD * sample, docs.count()).select("text")
    found = few.mapInPandas(label, "text string, spans array<string>").distinct()
    rows = found.withColumn("h", F.xxhash64("text")).orderBy("h", "text").limit(sample).collect()
    r = random.Random(5)
    x, y = [], []
    for row in rows:
        text, spans = row["text"], [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in row["spans"])]
        for again in range(14 if any(k == "email" for k, _, _ in spans) else 5):  # the form with most ways to hide it
            t, sp = _rewrite(text, spans, r) if again else (text, spans)
            cls = classes(t)
            tags = np.zeros(len(t), np.int8)
            for k, a, z in sp:
                n = 1 + 2 * KINDS.index(k)
                tags[a:z] = n + 1
                tags[a] = n
            for a in [sp[0][1] - r.randint(4, 40) if sp else 0, r.randint(0, max(0, len(t) - WINDOW))]:
                a = max(0, a)
                x.append(_cut(cls, a))
                y.append(_cut(tags, a))
    if not x:
        return None
    order = list(range(len(x)))
    r.shuffle(order)
    order = order[:windows]
    model = BiLstmCrf(1 + 2 * len(KINDS))
    model.fit(np.array([x[i] for i in order], np.int64), np.array([y[i] for i in order], np.int64))
    return model


def fits(kind: str, v: str) -> bool:
    digits = re.sub("[^0-9]", "", v)
    if kind == "email":
        halves = AT.split(v)
        host = DOT.split(halves[-1])
        name = "".join(DOT.split(halves[0]))
        return len(halves) == 2 and len(host) >= 2 and bool(re.fullmatch(r"[\w%+-]+", name)) and all(re.fullmatch(r"[\w-]+", h) for h in host) and len(host[-1]) >= 2
    if kind == "ip":
        parts = re.findall("[0-9]+", v)
        return len(parts) == 4 and all(map(_octet, parts)) and not re.search("[A-Za-z]", v)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", v)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", v) or v.startswith("+")) and not re.search("[A-Za-z]", v)


class Finder:
    """Base and added spans of texts, a batch at a time."""

    def __init__(self, model: BiLstmCrf | None):
        self.model = model

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        base = [base_spans(t) for t in texts]
        if not self.model:
            return [(b, b) for b in base]
        todo = [(n, s) for n, t in enumerate(texts) for s in windows_of(t)]
        votes: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            tags = self.model.decode(np.array([_cut(classes(texts[n][s : s + WINDOW]), 0) for n, s in part], np.int64))
            for (n, s), row in zip(part, tags, strict=True):
                if not row.any():
                    continue
                weight, tag = votes.setdefault(n, ({}, {}))
                for i in np.flatnonzero(row):
                    w = min(i, WINDOW - 1 - i)
                    if w >= weight.get(s + i, 0):
                        weight[s + i], tag[s + i] = w, int(row[i])
        out = []
        for n, b in enumerate(base):
            spans = list(b)
            if n in votes:
                for k, s, e in self._runs(votes[n][1]):
                    s, e = int(s), min(int(e), len(texts[n]))
                    while e > s and texts[n][e - 1] in " .,-":
                        e -= 1
                    while s < e and texts[n][s] in " .,-":
                        s += 1
                    v = texts[n][s:e]
                    kind = k if fits(k, v) else "phone" if v.startswith("00") and fits("phone", v) else None
                    if kind and not any(a < e and s < z for _, a, z in b):
                        spans.append((kind, s, e))
            out.append((b, ordered(spans, KINDS)))
        return out

    @staticmethod
    def _runs(tag: dict[int, int]) -> list[Span]:
        out: list[list] = []
        for i in sorted(tag):
            k, begins = KINDS[(tag[i] - 1) // 2], tag[i] % 2 == 1
            if out and out[-1][2] == i and out[-1][0] == k and not begins:
                out[-1][2] = i + 1
            else:
                out.append([k, i, i + 1])
        return [tuple(x) for x in out]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones as one) replaced by the kind of the first in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and n_added.

    Null and empty texts have no spans. Rows map one to one; repeated rows stay; ids pass as they are, null or not.
    Extra columns are left aside. Digits may run on for as long as they like.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[tuple]:
        finder, rows = Finder(sent.value), []
        for lo in range(0, len(texts), 500):
            for base, spans in finder.find([t or "" for t in texts[lo : lo + 500]]):
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS), digest(base), joined(spans), len(spans), len(spans) - len(base)))
        return rows

    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"
    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", run, added)


def redact_documents(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """docs with all spans, base and added, replaced by their kind; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def change(texts: list[str | None]) -> list[str | None]:
        finder, out = Finder(sent.value), []
        for lo in range(0, len(texts), 500):
            part = texts[lo : lo + 500]
            out += [None if t is None else redact(t, spans) for t, (_, spans) in zip(part, finder.find([t or "" for t in part]), strict=True)]
        return out

    return map_texts(docs, change=change)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train(docs))
