"""SimHash near-duplicates by vantage-point trees.

Only distinct fingerprints are searched. A vantage-point tree over a bounded sample deals them into shards: a node
with vantage v and radius m sends x to its inner child if d(x, v) <= m + t and to its outer child if d(x, v) > m.
For any pair within t, if both ends are at most m away they meet inside; if both are further, outside; else the far
end is within m + t by the triangle inequality and so meets the near one inside. The overlap is one-sided, so each
level copies about a fifth of the points rather than two fifths. Shards that stay too large are split again by
trees over samples of their own. Inside a shard the same split goes on down to small leaves, which are compared in
full. What leaves a shard is a star per group (each fingerprint and the least one it links to), never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, first_by_hash, materialize, per_text, table

LINK_BITS = 2
SHARD = 2048  # fingerprints that a shard should hold
SHARD_MOST = 32768  # above this a shard is split again
SAMPLE = 65536  # fingerprints a tree is built from, at most
LEAF = 192


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    k = min(words_per_shingle, n)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(text: str | None) -> tuple[int]:
    fp = fingerprint(text)
    return (fp - (1 << 64) * (fp >> 63),)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long. Null and word-less texts have fingerprint 0."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_text(d, "text", lambda texts: list(map(_signed, texts)), "fp long")


def _apart(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, t: int) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """Vantage, radius and the two children's points; None if no vantage tried shrinks both sides."""
    best = None
    for v in points[:: max(1, len(points) // 5)][:5]:
        d = _apart(points, v)
        m = int(np.partition(d, len(d) // 2)[len(d) // 2]) - 1
        inner, outer = int((d <= m + t).sum()), int((d > m).sum())
        if best is None or max(inner, outer) < best[0]:
            best = max(inner, outer), v, m
    if best[0] > 0.9 * len(points):
        return None
    d = _apart(points, best[1])
    return best[1], best[2], points[d <= best[2] + t], points[d > best[2]]


def build_tree(sample: np.ndarray, leaf: int, t: int = LINK_BITS) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); a leaf is None. Node 0 is the root."""
    nodes: list[tuple | None] = [None]
    todo = [(0, sample)]
    while todo:
        at, points = todo.pop()
        if len(points) <= leaf or (cut := _split(points, t)) is None:
            continue
        nodes[at] = (cut[0], cut[1], len(nodes), len(nodes) + 1)
        todo += [(len(nodes), cut[2]), (len(nodes) + 1, cut[3])]
        nodes += [None, None]
    return nodes


def route(points: np.ndarray, nodes: list[tuple], t: int = LINK_BITS) -> list[tuple[int, np.ndarray]]:
    out, todo = [], [(0, points)]
    while todo:
        at, p = todo.pop()
        if not len(p):
            continue
        if nodes[at] is None:
            out.append((at, p))
            continue
        v, m, inner, outer = nodes[at]
        d = _apart(p, v)
        todo += [(inner, p[d <= m + t]), (outer, p[d > m])]
    return out


def _labels(points: np.ndarray, t: int) -> np.ndarray:
    """Of each point, the index of the least one in its group, comparing all points block by block."""
    lab = np.arange(len(points))
    while True:
        new = lab.copy()
        for s in range(0, len(points), 1024):
            near = np.bitwise_count(points[s : s + 1024, None] ^ points[None, :]) <= t
            new[s : s + 1024] = np.where(near, lab[None, :], len(points)).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def links_in_shard(points: np.ndarray, t: int = LINK_BITS) -> np.ndarray:
    """Star edges (a, b) of the groups among points: an (n, 2) array."""
    out, todo = [], [points]
    while todo:
        p = todo.pop()
        if len(p) > LEAF and (cut := _split(p, t)) is not None:
            todo += [cut[2], cut[3]]
        elif len(p) > 1:
            lab = _labels(p, t)
            hit = lab != np.arange(len(p))
            if hit.any():
                out.append(np.stack([p[hit], p[lab[hit]]], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)


def by_blocks(points: DataFrame, shards: list[str], t: int) -> DataFrame:
    """points with the shards that no vantage point parts dealt by the pigeonhole: of t + 1 blocks of bits, two
    fingerprints within t bits have one block alike, so they meet there."""
    cuts = [64 * i // (t + 1) for i in range(t + 2)]
    keys = [F.concat_ws("/", "shard", F.lit(i), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (z - a)) - 1))) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    return points.select(F.explode(F.when(F.col("shard").isin(*shards), F.array(*keys)).otherwise(F.array("shard"))).alias("shard"), "fp")


def link_fingerprints(distinct: DataFrame, t: int = LINK_BITS, shard: int = SHARD, shard_most: int = SHARD_MOST, sample: int = SAMPLE) -> DataFrame:
    """Star edges (a, b) of the links among distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    n = distinct.count()
    points = distinct.select(F.lit("").alias("shard"), "fp")
    large, sizes = {"": n}, n
    for depth in itertools.count():
        if not large or n <= shard:
            break
        found = points.where(F.col("shard").isin(*large)) if depth else points
        rows = first_by_hash(found, ["fp", "shard"], sample, sizes).toPandas()  # `sample` rows at most
        trees = {}
        for key, part in rows.groupby("shard"):
            nodes = build_tree(part["fp"].to_numpy().view(np.uint64), max(16, int(len(part) * shard / large[key])), t)
            if len(nodes) > 1:
                trees[key] = nodes
        if not trees:
            points = by_blocks(points, list(large), t)
            break
        sent = spark.sparkContext.broadcast(trees)

        def deal(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, part in b.groupby("shard"):
                    fp = part["fp"].to_numpy().view(np.uint64)
                    if key not in sent.value:
                        yield part
                        continue
                    for leaf, p in route(fp, sent.value[key], t):
                        yield pd.DataFrame({"shard": f"{key}.{leaf}", "fp": p.view(np.int64)})

        points = materialize(points.mapInPandas(deal, "shard string, fp long"), f"shards{depth}")
        counts = {r["shard"]: r["n"] for r in points.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_most).collect()}
        stuck = [k for k, v in counts.items() if v >= 0.9 * large.get(k.rpartition(".")[0], v + 1)]
        if stuck:
            points = materialize(by_blocks(points, stuck, t), f"blocks{depth}")
        large = {k: v for k, v in counts.items() if k not in stuck}
        sizes = sum(large.values())

    def search(part: pd.DataFrame) -> pd.DataFrame:
        e = links_in_shard(np.unique(part["fp"].to_numpy().view(np.uint64)), t)
        return pd.DataFrame({"a": e[:, 0].view(np.int64), "b": e[:, 1].view(np.int64)}) if len(e) else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return points.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = LINK_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) of every row.

    Links join fingerprints that differ in t bits or fewer. Null, empty and word-less texts have the zero
    fingerprint and link to each other. Rows with a null id keep a row; they take part in links but never name a
    component unless all ids in it are null. Repeated rows stay. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_components(link_fingerprints(least.select("fp"), t))
    named = least.join(groups.hint("shuffle_merge"), least["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(heads.hint("shuffle_merge"), "component").select("fp", "component_id")
    return fps.join(of_fp.hint("shuffle_merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id (null ids last), of repeated rows any one.

    All columns stay. Null and empty texts have the zero fingerprint and are one component. An empty table stays empty.
    """
    key = "simhash_row_key"
    d = docs.withColumn(key, F.monotonically_increasing_id()).withColumn("simhash_text", F.col("text"))
    d = materialize(per_text(d, "simhash_text", lambda texts: list(map(_signed, texts)), "simhash_fp long"), "keyed")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("lead")
    least = materialize(d.groupBy(F.col("simhash_fp").alias("fp")).agg(lead), "leads")
    groups = connected_components(link_fingerprints(least.select("fp"), LINK_BITS))
    named = least.join(groups.hint("shuffle_merge"), least["fp"] == groups["node"], "left").select(F.coalesce("component", "fp").alias("component"), "lead")
    kept = named.groupBy("component").agg(F.min("lead").alias("lead")).select(F.col(f"lead.{key}").alias(key))
    return d.join(kept.hint("shuffle_merge"), key, "left_semi").select(docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
