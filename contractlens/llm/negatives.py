"""Hard negatives by exact search of STR-packed R-trees.

Rows are dealt to shards by sort-tile-recursive cuts (label first, then the coordinates by spread) learned from a
bounded sample, and every shard is packed into leaves the same way. A leaf's minimum bounding box gives an interval for
each product of a coordinate with the anchor's, and their sums bound every inner product in it. Each anchor holds a
queue of boxes, best upper bound first. It passes over a box whose interval misses all its score windows, and ends at
the first box strictly below the kth score found so far; a box at the kth score may still hold a smaller id. The queues
advance together, so that anchors which stand at one leaf are scored in one product.

Anchors go out in groups of bounded size, and every task keeps its best k for each slot over all its shards, so what
it hands on follows the anchors and not the rows. Searching the sample first gives each slot a kth score to prune by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import first_by_hash, materialize, table

SCALE = 256
MOST = 1 << 26  # components are held within this, so that scores of up to 1,024 components fit a long
POSITIVES, NEGATIVES = 5, 10
SHARD, LEAF = 4096, 64  # rows of a shard (about) and of a leaf (at most)
SAMPLE = 16384  # rows the cuts are learned from and kth scores start from, at most
GROUP_BYTES = 32 << 20  # anchors that are sent to all tasks at once
NEVER = -(1 << 62)


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (moved on by one of ten where vec_id is divisible by 7) and q, the components' floor(scale * x).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return d.select("vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"), whole.alias("q"))


def matrix(lists: list | np.ndarray, dims: int) -> np.ndarray:
    """Rows of integers as one array; missing components at the end count as 0."""
    if len(lists) and all(len(x) == dims for x in lists):
        return np.asarray(np.concatenate(list(lists)), np.int64).reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floats where no sum can leave the range in which they are exact."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) >= 1 << 53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def slabs_of(parts: int, levels: int) -> int:
    return max(2, int(np.ceil(parts ** (1 / max(1, min(levels, int(np.ceil(np.log2(parts))))))))) if parts > 1 else 1


def axes_of(keys: np.ndarray) -> list[int]:
    """Column 0 (the label) first, then the others by spread."""
    return [0, *(1 + np.argsort(-keys[:, 1:].std(axis=0), kind="stable")).tolist()] if len(keys) else [0]


@dataclass
class Cut:
    """Slabs of one axis: (value, tie) where each but the first begins. Ties part rows of one value."""

    axis: int
    values: np.ndarray
    ties: np.ndarray
    below: list[Cut | None]
    first: int = 0  # number of the first tile
    tiles: int = 1


def cuts(keys: np.ndarray, ties: np.ndarray, parts: int, axes: list[int], first: int = 0) -> Cut | None:
    """Sort-tile-recursive cuts into about `parts` tiles."""
    if parts <= 1 or len(keys) < 2 * parts or not axes:
        return None
    slabs = min(parts, 16) if axes[0] == 0 else min(parts, slabs_of(parts, len(axes)))
    order = np.lexsort((ties, keys[:, axes[0]]))
    pieces = [p for p in np.array_split(order, slabs)]
    cut = Cut(axes[0], keys[[p[0] for p in pieces[1:]], axes[0]], ties[[p[0] for p in pieces[1:]]], [], first, 0)
    for p in pieces:
        below = cuts(keys[p], ties[p], round(parts / slabs), axes[1:], first + cut.tiles)
        cut.below.append(below)
        cut.tiles += below.tiles if below else 1
    return cut


def tiles(keys: np.ndarray, ties: np.ndarray, cut: Cut | None) -> np.ndarray:
    """The tile of each row."""
    out = np.zeros(len(keys), np.int64)
    todo = [(np.arange(len(keys)), cut)]
    while todo:
        rows, c = todo.pop()
        if c is None or not len(rows):
            continue
        x, t = keys[rows, c.axis], ties[rows]
        slab = np.zeros(len(rows), np.int64)
        for v, tie in zip(c.values, c.ties, strict=True):
            slab += (x > v) | (x == v) & (t >= tie)
        at = c.first
        for i, below in enumerate(c.below):
            out[rows[slab == i]] = at
            todo.append((rows[slab == i], below))
            at += below.tiles if below else 1
    return out


def packed_leaves(keys: np.ndarray, ties: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf, in sort-tile-recursive order."""
    out = []

    def pack(rows: np.ndarray, axes: list[int]) -> None:
        parts = -(-len(rows) // size)
        if parts <= 1 or not axes:
            out.extend(rows[i : i + size] for i in range(0, len(rows), size))
            return
        slabs = min(parts, 16) if axes[0] == 0 else slabs_of(parts, len(axes))
        each = -(-parts // slabs) * size
        rows = rows[np.lexsort((ties[rows], keys[rows, axes[0]]))]
        for i in range(0, len(rows), each):
            pack(rows[i : i + each], axes[1:])

    pack(np.arange(len(keys)), axes_of(keys))
    return out


@dataclass
class Tree:
    """Rows in the order of the leaves, where each leaf starts, and the boxes of the leaves."""

    points: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        keys = np.column_stack([self.labels, self.points])
        self.low, self.high = (f.reduceat(keys, self.starts[:-1], axis=0) for f in (np.minimum, np.maximum))

    @classmethod
    def of(cls, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
        leaves = packed_leaves(np.column_stack([labels, points]), ids)
        order = np.concatenate(leaves)
        return cls(points[order], ids[order], labels[order], np.concatenate([[0], np.cumsum([len(x) for x in leaves])]))


@dataclass
class Search:
    """Anchors and their slots, sorted by anchor: the best k rows with low <= score <= high, of the anchor's own label
    or of others. `floor` is a score that the kth of a slot is known to reach."""

    anchors: np.ndarray
    labels: np.ndarray
    same: bool
    owner: np.ndarray  # the anchor of each slot
    low: np.ndarray
    high: np.ndarray
    k: int
    floor: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.score = np.full((len(self.owner), self.k), NEVER)
        self.ids = np.full((len(self.owner), self.k), NEVER)
        self.need = self.low if self.floor is None else np.maximum(self.low, self.floor)
        self.begin = np.searchsorted(self.owner, np.arange(len(self.anchors) + 1))
        self.least, self.most = np.full(len(self.anchors), 1 << 62), np.full(len(self.anchors), NEVER)
        np.minimum.at(self.least, self.owner, self.need)
        np.maximum.at(self.most, self.owner, self.high)

    def take(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges found rows into the slots: higher scores first, ties by smaller id."""
        t = np.unique(slots)
        slot = np.concatenate([np.repeat(t, self.k), slots])
        score, found = np.concatenate([self.score[t].ravel(), scores]), np.concatenate([self.ids[t].ravel(), ids])
        order = np.lexsort((found, -score, slot))
        best = order[np.searchsorted(slot[order], t)[:, None] + np.arange(self.k)]
        self.score[t], self.ids[t] = score[best], found[best]
        self.need[t] = np.maximum(self.need[t], self.score[t, -1])
        touched = np.unique(self.owner[t])
        self.least[touched] = np.minimum.reduceat(self.need[self.begin[touched[0]] :], self.begin[touched] - self.begin[touched[0]])

    def run(self, tree: Tree, block: int = 2048) -> None:
        for at in range(0, len(self.anchors), block):
            self._run(tree, np.arange(at, min(at + block, len(self.anchors))))

    def _run(self, tree: Tree, who: np.ndarray) -> None:
        who = who[self.begin[who + 1] > self.begin[who]]
        up, down = np.maximum(self.anchors[who], 0), np.minimum(self.anchors[who], 0)
        most = products(up, tree.high[:, 1:]) + products(down, tree.low[:, 1:])
        least = products(up, tree.low[:, 1:]) + products(down, tree.high[:, 1:])
        mine, first, last = self.labels[who, None], tree.low[:, 0], tree.high[:, 0]
        can = (first <= mine) & (mine <= last) if self.same else (first != last) | (first != mine)
        most[~can] = NEVER
        queue = np.argsort(-most, axis=1, kind="stable")
        alive = np.arange(len(who))
        for turn in range(queue.shape[1]):
            leaf = queue[alive, turn]
            bound = most[alive, leaf]
            stays = (bound >= self.least[who[alive]]) & (bound > NEVER)  # boxes further down the queue bound less still
            alive, leaf = alive[stays], leaf[stays]
            if not len(alive):
                break
            meets = least[alive, leaf] <= self.most[who[alive]]
            found = [self._score(tree, x, who[alive[meets & (leaf == x)]]) for x in np.unique(leaf[meets])]
            slots, scores, ids = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            if len(slots):
                self.take(slots, scores, ids)

    def _score(self, tree: Tree, leaf: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of a leaf's rows that may enter the slots of some anchors."""
        rows = slice(tree.starts[leaf], tree.starts[leaf + 1])
        score = products(self.anchors[who], tree.points[rows])
        fits = (tree.labels[None, rows] == self.labels[who, None]) == self.same
        score = np.where(fits, score, NEVER)
        n = self.begin[who + 1] - self.begin[who]
        of = np.repeat(np.arange(len(who)), n)
        slots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[who], n)
        hit, column = np.nonzero((score[of] >= self.need[slots, None]) & (score[of] <= self.high[slots, None]) & (score[of] > NEVER))
        return slots[hit], score[of[hit], column], tree.ids[rows][column]


def _pack(rows: pa.Table, dims: int) -> Tree:
    return Tree.of(matrix(rows["q"].to_numpy(), dims), rows["vec_id"].to_numpy(), rows["label"].to_numpy())


def shards(rows: DataFrame, sample: pa.Table, n: int, dims: int) -> DataFrame:
    """One row for each shard: its rows as bytes in the order of its leaves."""
    keys = np.column_stack([sample["label"].to_numpy(), matrix(sample["q"].to_numpy(), dims)])
    tie = sample["tie"].to_numpy()
    cut = cuts(keys, tie, min(-(-n // SHARD), len(keys) // 16), axes_of(keys))
    more = max(1, -(-n // (SHARD * (cut.tiles if cut else 1))))  # tiles the sample is too small to part are dealt by hash

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.column_stack([b["label"].to_numpy(), matrix(b["q"].to_numpy(zero_copy_only=False), dims)])
            yield b.append_column("tile", pa.array(tiles(k, b["tie"].to_numpy(), cut) * more + b["tie"].to_numpy() % more, pa.int64()))

    def pack(group: pa.Table) -> pa.Table:
        t = _pack(group, dims)
        return pa.table({"points": [t.points.astype(np.int32).tobytes()], "ids": [t.ids.tobytes()], "labels": [t.labels.tobytes()], "starts": [t.starts.tobytes()]})

    schema = "vec_id long, label long, q array<int>, tie long, tile long"
    return rows.mapInArrow(deal, schema).groupBy("tile").applyInArrow(pack, "points binary, ids binary, labels binary, starts binary")


def search_shards(packed: DataFrame, search: Search, numbers: np.ndarray, dims: int) -> DataFrame:
    """(slot, score, found): the best k of every task for each slot, with numbers for the slots."""
    sent = packed.sparkSession.sparkContext.broadcast((search, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, number = sent.value
        mine = Search(s.anchors, s.labels, s.same, s.owner, s.low, s.high, s.k, s.floor)
        for b in batches:
            for r in b.to_pylist():
                ids, labels, starts = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "starts"))
                mine.run(Tree(np.frombuffer(r["points"], np.int32).reshape(len(ids), dims).astype(np.int64), ids, labels, starts))
        slot, column = np.nonzero(mine.score > NEVER)
        yield pa.RecordBatch.from_arrays([pa.array(number[slot], pa.int64()), pa.array(mine.score[slot, column]), pa.array(mine.ids[slot, column])], ["slot", "score", "found"])

    return packed.mapInArrow(run, "slot long, score long, found long")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "found"))).where(F.col("r") <= k)


def mine_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id is divisible by
    `every`, and each of its best rows of the same label, the best rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score.

    Scores are exact whole numbers; all rows are searched. Rows of an id that stands several times count as rows of
    their own: each is an anchor, and the others may be its positives. Vectors of several lengths meet as if padded with
    zeros, those without components score 0, and components beyond 2^26 after scaling are held there. Empty tables and
    anchors without a positive or a negative give no rows. Other columns are left aside.
    """
    spark = embeddings.sparkSession
    rows = materialize(quantised(embeddings).withColumn("tie", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit((1 << 63) - 1))), "vectors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    sample = first_by_hash(rows, ["tie", "vec_id"], SAMPLE, n).toArrow()
    packed = materialize(shards(rows, sample, n, dims), "shards")
    # The least score that the kth row of a slot can have, found in the sample by the tasks that hold the anchors.
    sent = spark.sparkContext.broadcast(sample)
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id())
    anchors = materialize(_with_floor(anchors, sent, dims, True, positives + 1), "anchors")
    found, groups = [], max(1, -(-anchors.count() * 8 * (dims + 8) // GROUP_BYTES))
    for g in range(groups):
        a = anchors.where(F.pmod("anchor", F.lit(groups)) == g).toArrow()
        s = Search(matrix(a["q"].to_numpy(), dims), a["label"].to_numpy(), True, np.arange(len(a)), np.full(len(a), NEVER), np.full(len(a), 1 << 62), positives + 1, np.array([x[0] for x in a["floor"].to_pylist()], np.int64))
        found.append(materialize(_best(search_shards(packed, s, a["anchor"].to_numpy(), dims), positives + 1), f"positives-{g}"))
    of = anchors.select("anchor", "vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x.cast("long")).alias("own"))
    best = _union(found).withColumnRenamed("slot", "anchor").join(of.hint("shuffle_merge"), "anchor")
    # One row of the anchor's id and of its own score is the anchor itself: which of several does not show.
    self_at = F.min(F.when((F.col("found") == F.col("vec_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(Window.partitionBy("anchor"))
    best = best.withColumn("me", F.coalesce(self_at, F.lit(positives + 1))).where("r <> me")
    best = materialize(best.select("anchor", F.col("vec_id").alias("anchor_id"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window of scores for each distinct score of a positive; those of negative scores hold nothing.
    windows = best.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    windows = anchors.select("anchor", "label", "q", "tie", "vec_id").join(windows.hint("shuffle_merge"), "anchor")
    bounds = lambda p: (-(-low * p // 100), high * p // 100)
    windows = materialize(_with_floor(windows, sent, dims, False, negatives, bounds), "windows")
    found = []
    for g in range(groups):
        a = windows.where(F.pmod("anchor", F.lit(groups)) == g).toArrow()
        s = _window_search(matrix(a["q"].to_numpy(), dims), a["label"].to_numpy(), a["scores"].to_pylist(), bounds, negatives, [x for f in a["floor"].to_pylist() for x in f])
        hit = _best(search_shards(packed, s, np.arange(len(s.owner)), dims), negatives)
        slots = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(s.owner)), "anchor": a["anchor"].to_numpy()[s.owner], "positive_score": np.concatenate([[], *a["scores"].to_pylist()]).astype(np.int64)}), "slot long, anchor long, positive_score long")
        found.append(materialize(hit.join(slots.hint("shuffle_merge"), "slot").select("anchor", "positive_score", F.col("r").alias("rank"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score")), f"negatives-{g}"))
    hit = best.join(_union(found).hint("shuffle_merge"), ["anchor", "positive_score"])
    return hit.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _window_search(anchors: np.ndarray, labels: np.ndarray, scores: list[list[int]], bounds, k: int, floor: list[int] | None = None) -> Search:
    owner = np.repeat(np.arange(len(anchors)), [len(s) for s in scores]).astype(np.int64)
    least, most = (np.array([bounds(p)[i] for s in scores for p in s], np.int64) for i in (0, 1))
    return Search(anchors, labels, False, owner, least, most, k, None if floor is None else np.array(floor, np.int64))


def _with_floor(df: DataFrame, sent, dims: int, same: bool, k: int, bounds=None) -> DataFrame:
    """df with `floor`: the kth score of each slot among the sample's rows."""
    schema = StructType([*df.schema, *StructType.fromDDL("floor array<bigint>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            tree = tree or _pack(sent.value, dims)
            q, labels = matrix(b["q"].to_numpy(zero_copy_only=False), dims), b["label"].to_numpy()
            s = Search(q, labels, True, np.arange(len(q)), np.full(len(q), NEVER), np.full(len(q), 1 << 62), k) if same else _window_search(q, labels, b["scores"].to_pylist(), bounds, k)
            s.run(tree)
            yield b.append_column("floor", pa.array([s.score[x:y, -1].tolist() for x, y in zip(s.begin[:-1], s.begin[1:], strict=True)], pa.list_(pa.int64())))

    return df.mapInArrow(run, schema)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(table(spark, sf_dir, "embeddings"))


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10"""
