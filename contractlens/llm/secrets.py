"""Secret candidates and how widely each one is owned.

Rules find candidates in each text. Their values, lower-cased, are hashed, and the hashes are counted over the whole
corpus by distinct repository and owner: a value that many owners hold is a copied example, one that few hold is likely
live. Besides the base rules, bare tokens of 20 characters and more with letters and digits are candidates (kind
`live`). The corpus decides on them: one becomes a span if few own it and it is either a secret by the base rules
somewhere else (a credential copied without its key, or in other letters) or of mixed case and high entropy.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_text, table
from .spans import Span, digest

KINDS = ["assign", "access", "hex", "live"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more are the runs that stay
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENTROPY = 3.5  # bits a character
OWNERS = 2  # a value with more owners than this is an example


def base_spans(text: str) -> list[tuple[Span, str]]:
    """The base spans with the secret value of each, in order."""
    found = [(("assign", m.start(), m.end()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(("access", m.start(), m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(("hex", m.start(), m.end()), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def extra_spans(text: str, base: list[Span]) -> list[tuple[Span, str]]:
    """Bare tokens with a letter and a digit that no base span touches."""
    out = []
    starts = sorted((s, e) for _, s, e in base)
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(starts) and starts[at][1] <= m.start():
            at += 1
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(s < m.end() and m.start() < e for s, e in starts[at : at + 3]):
            out.append((("live", m.start(), m.end()), m[0]))
    return out


def looks_random(v: str) -> bool:
    return bool(re.search("[a-z]", v) and re.search("[A-Z]", v)) and entropy(v) >= ENTROPY


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One small row per document: base counts and digest, and the candidates (hash, kind, start, end) with owner."""

    def run(texts: list[str | None]) -> list[tuple]:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            spans = [s for s, _ in base]
            n = Counter(k for k, _, _ in spans)
            both = [{"hash": hashlib.sha256(v.lower().encode()).hexdigest(), "kind": k, "start": s, "end": e, "random": k != "live" or looks_random(v)} for (k, s, e), v in base + extra_spans(text, spans)]
            rows.append((n["assign"], n["access"], n["hex"], digest(spans), both))
        return rows

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), "text")
    return per_text(d, "text", run, "n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<hash:string,kind:string,start:int,end:int,random:boolean>>")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, uses, repositories, owners, named (a base rule found it somewhere), verdict. First counted per (hash, repo,
    owner), so a value that a third of all rows hold is summed map-side and reaches the second step once per owner."""
    per = candidates.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"), F.max(F.col("kind") != "live").alias("named"))
    out = per.groupBy("hash").agg(F.sum("n").alias("uses"), F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"), F.max("named").alias("named"))
    return out.withColumn("verdict", F.when(F.col("owners") > OWNERS, "example").otherwise("live"))


def find_secrets(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, their verdicts (joined likewise: live or example), the
    number of spans by verdict, and the most owners and repositories of any.

    owner and repo say who holds a document: its source, and its source and language, where the table has these columns
    and none are given. Null and empty texts have no spans. Rows map one to one, repeated rows stay, ids pass as they
    are; null owners count as none. Extra columns are left aside.
    """
    has = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")]
    owner = has[0] if owner is None else owner
    repo = F.concat_ws("/", *has) if repo is None else repo
    rows = materialize(scan(docs, owner, repo), "secrets")
    cands = rows.select("row", "repo", "owner", F.explode("candidates").alias("c")).select("row", "repo", "owner", "c.*")
    known = ownership(cands)
    judged = cands.select("row", "hash", "kind", "start", "end", "random").join(known.hint("shuffle_merge"), "hash")
    judged = judged.where((F.col("kind") != "live") | (F.col("verdict") == "live") & (F.col("random") | F.col("named")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kept = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "verdict")))
    of = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    per = judged.groupBy("row").agg(kept.alias("s"), of("live"), of("example"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    per = per.select("row", text.alias("spans"), F.array_join("s.verdict", ",").alias("verdicts"), "n_live", "n_example", "most_owners", "most_repositories")
    out = rows.join(per.hint("shuffle_merge"), "row", "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("spans", "verdicts")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", *text, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

