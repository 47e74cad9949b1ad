"""Graph operators. All loops share one frontier step: join, keep what is new, write it out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlens.functions.columns import semantic_value, upper_camel
from contractlens.operators.relational import EVIDENCE, SHOWN, classify_domains, resolve_calls, unique_or_null
from contractlens.sources.scratch import materialize


def _merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def numbered_roots(roots: DataFrame) -> DataFrame:
    """(root, word, bit): each distinct root has one bit of one word of 64."""
    ids = roots.select("root").distinct().withColumn("_id", F.monotonically_increasing_id())
    return materialize(ids.select("root", F.shiftright("_id", 6).alias("word"), (F.col("_id") % 64).cast("int").alias("bit")), "graph-roots")


def reach_sets(edges: DataFrame, numbered: DataFrame, max_depth: int = 64, max_nodes: int | None = None, partial: bool = False, merge: int = 8, starts: DataFrame | None = None) -> DataFrame:
    """(node, word, depth, bits): the roots of each word that first reach a node at a depth, as bits.

    A search from all roots at once: a level holds one row for each node and word, not one for each root, and sets are
    united by bit_or where they arise, before they are sent. A root starts from itself, or from its nodes in starts (node,
    word, bit). The other parameters are those of `reachable`."""
    e = materialize(edges.select("source", "target").distinct(), "graph-edges")
    starts = numbered.select(F.col("root").alias("node"), "word", "bit") if starts is None else starts
    front = starts.groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    front = materialize(front.select("node", "word", F.lit(0).alias("depth"), "bits"), "reach-0")
    parts, kept, per = [front], [front], per_root(front)
    for depth in range(1, max_depth + (1 if partial else 2)):
        seen = _merged(kept).groupBy("node", "word").agg(F.bit_or("bits").alias("seen"))
        if len(kept) > merge:
            seen = materialize(seen, f"reach-seen-{depth}")
            kept = [seen.withColumnRenamed("seen", "bits").select("node", "word", F.lit(0).alias("depth"), "bits")]
        step = front.join(e, front["node"] == e["source"]).groupBy("target", "word").agg(F.bit_or("bits").alias("bits")).withColumnRenamed("target", "node")
        new = step.join(seen, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        front = materialize(new.where("bits <> 0").select("node", "word", F.lit(depth).alias("depth"), "bits"), f"reach-{depth}")
        if front.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"{_some_root(numbered, front)} reaches nodes beyond depth {max_depth}")
        parts, kept = [*parts, front], [*kept, front]
        if max_nodes:
            per = materialize(per.union(per_root(front)).groupBy("word", "bit").agg(F.sum("n").alias("n")), f"reach-counts-{depth}")
            if over := per.where(F.col("n") > max_nodes).join(numbered, ["word", "bit"]).first():
                raise ValueError(f"{over['root']} reaches more than {max_nodes} nodes")
    return _merged(parts)


def _some_root(numbered: DataFrame, sets: DataFrame) -> str:
    one = sets.select("word", "bits").limit(1)
    return one.join(numbered, "word").where("shiftright(bits, bit) & 1L = 1").first()["root"]


def per_root(sets: DataFrame, *by: str) -> DataFrame:
    """(by.., word, bit, n): the nodes in the sets of each root, summed for 64 roots in a row."""
    sums = [F.sum(F.expr(f"shiftright(bits, {i}) & 1L")).alias(f"_{i}") for i in range(64)]
    each = sets.groupBy(*by, "word").agg(*sums).select(*by, "word", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(64)])).alias("bit", "n"))
    return each.where("n > 0")


def unpacked(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(root, node, depth, word, bit) of packed sets. The names of a word's roots are written out as one row, so that their
    size is known to the join, and rows of (root, node) only arise after it."""
    names = materialize(numbered.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", "root"))).alias("names")), "graph-names")
    met = sets.join(names, "word").withColumn("_n", F.explode(F.expr("filter(names, n -> shiftright(bits, n.bit) & 1L = 1)")))
    return met.select("_n.root", "node", "depth", "word", "_n.bit")


def reach_counts(edges: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """(root, depth, nodes): how many nodes each root reaches first at each depth, the root itself at 0.

    Roots whose edges lead to the same nodes reach the same, but for themselves: one search from those nodes counts for
    all of them, a level later, and a root is taken off the level where the search meets it. So the work grows with the
    different sets of first nodes, not with the roots."""
    e = materialize(edges.select("source", "target").distinct(), "graph-edges")
    mine = materialize(roots.select("root").distinct().join(e, F.col("root") == e["source"]).select("root", "target"), "first-nodes")
    # Sets of one size and two hashes are compared with those of the first such root; who differs stands alone.
    marks = mine.groupBy("root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("target")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "target")).alias("y"))
    first = materialize(marks.withColumn("like", F.min("root").over(Window.partitionBy("n", "x", "y"))), "first-like")
    same = mine.join(first.where("root <> like").select("root", "like", "n"), "root").join(mine.withColumnsRenamed({"root": "like"}), ["like", "target"])
    same = same.groupBy("root", "like", "n").agg(F.count("*").alias("met")).where("met = n").select("root", "like")
    classes = materialize(first.select("root").join(same, "root", "left").withColumn("like", F.coalesce("like", "root")), "root-classes")
    numbered = numbered_roots(classes.select(F.col("like").alias("root")))
    starts = mine.join(numbered, "root").select(F.col("target").alias("node"), "word", "bit")
    sets = reach_sets(e, numbered, max_depth, starts=starts)
    found = materialize(per_root(sets, "depth"), "class-counts")
    of = materialize(classes.join(numbered.withColumnRenamed("root", "like"), "like").select("root", "word", "bit"), "root-bits")
    own = of.join(sets.withColumnRenamed("node", "root"), ["root", "word"]).where("shiftright(bits, bit) & 1L = 1").select("root", "depth", F.lit(1).alias("self"))
    later = of.join(found, ["word", "bit"]).join(own.hint("shuffle_merge"), ["root", "depth"], "left")
    later = later.select("root", (F.col("depth") + 1).alias("depth"), (F.col("n") - F.coalesce("self", F.lit(0))).alias("nodes")).where("nodes > 0")
    later = materialize(later, "root-counts")
    if over := later.where(F.col("depth") > max_depth).first():
        raise ValueError(f"{over['root']} reaches nodes beyond depth {max_depth}")
    return roots.select("root").distinct().select("root", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("nodes")).union(later)


def _ranked(level: DataFrame, bounded: bool) -> DataFrame:
    """level (root, node, p(rank, node)) with `rank`, by (p.rank, node) within each root. A root of no known bound is not
    sorted in one task: rows are dealt by ranges, counted by range, and numbered within."""
    if bounded:
        return level.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("p.rank", "node")).cast("long"))
    dealt = materialize(level.repartitionByRange("root", F.col("p.rank"), "node").withColumn("_part", F.spark_partition_id()), "graph-ranges")
    before = dealt.groupBy("root", "_part").agg(F.count("*").alias("n"))
    before = before.select("root", "_part", F.coalesce(F.sum("n").over(Window.partitionBy("root").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("root", "_part").orderBy("p.rank", "node"))
    return dealt.join(before.hint("shuffle_merge"), ["root", "_part"]).withColumn("rank", F.col("_before") + at).drop("_part", "_before")


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int = 64, max_nodes: int | None = 25_000, partial: bool = False, merge: int = 8) -> DataFrame:
    """G1: (root, node, parent, depth, rank) of all that roots reach. A node's parent is the earliest ranked one of the
    level above; ranks go by (parent rank, node). A root that reaches more than max_nodes nodes is an error, and
    so are nodes beyond max_depth, unless the caller asks for the first levels only (partial).

    Depths come from reach_sets, which searches from all roots together. Parents need a row for each root and node, so
    they are found in a second pass, in which each level knows beforehand what it holds; who only needs depths takes
    `unpacked(reach_sets(..))`."""
    numbered = numbered_roots(roots)
    e = materialize(edges.select("source", "target").distinct(), "graph-edges")
    sets = reach_sets(e, numbered, max_depth, max_nodes, partial, merge)
    deepest = sets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    front = materialize(numbered.select("root", "word", "bit", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank")), "reach-root")
    levels = [front]
    for depth in range(1, deepest + 1):
        here = sets.where(F.col("depth") == depth).select(F.col("node").alias("target"), "word", "bits")
        step = front.join(e, front["node"] == e["source"]).select("root", "word", "bit", "target", F.struct("rank", "node").alias("p"))
        step = step.groupBy("root", "word", "bit", "target").agg(F.min("p").alias("p")).join(here, ["target", "word"])
        step = step.where(F.expr("shiftright(bits, bit) & 1L = 1")).select("root", "word", "bit", F.col("target").alias("node"), "p")
        ranked = _ranked(step, max_nodes is not None)
        front = materialize(ranked.select("root", "word", "bit", "node", F.col("p.node").alias("parent"), F.lit(depth).alias("depth"), "rank"), f"parents-{depth}")
        levels.append(front)
    return _merged(levels).drop("word", "bit")


def reachable_resolved(edges: DataFrame, calls: DataFrame, methods: DataFrame, roots: DataFrame) -> DataFrame:
    """Reachability over given edges and those that call resolution adds."""
    more = resolve_calls(calls, methods).where("method_id is not null").select(F.col("caller").alias("source"), F.col("method_id").alias("target"))
    return reachable(edges.select("source", "target").union(more), roots)


def pair_depths(edges: DataFrame, roots: DataFrame, max_depth: int = 64, max_nodes: int = 25_000) -> DataFrame:
    """(root, node, depth), as `reachable` has them, for roots that share little of what they reach, like classes and their
    ancestors: a row for each pair from the start, so that bits and ranks, which such roots gain nothing from, are not made."""
    e = materialize(edges.select("source", "target").distinct(), "graph-edges")
    front = materialize(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "pairs-0")
    parts = [front]

    def bounded(pairs: DataFrame) -> DataFrame:
        if over := pairs.groupBy("root").count().where(F.col("count") > max_nodes).first():
            raise ValueError(f"{over['root']} reaches more than {max_nodes} nodes")
        return pairs

    for depth in count(1):
        step = front.join(e, front["node"] == e["source"]).select("root", F.col("target").alias("node")).distinct()
        new = step.join(_merged(parts).select("root", "node"), ["root", "node"], "left_anti")
        front = materialize(new.withColumn("depth", F.lit(depth)), f"pairs-{depth}")
        if front.isEmpty():
            return bounded(_merged(parts))
        if depth > max_depth:
            raise ValueError(f"{front.first()['root']} reaches nodes beyond depth {max_depth}")
        parts.append(front)
        if len(parts) > 8:
            parts = [bounded(materialize(_merged(parts), f"pairs-to-{depth}"))]


def pair_parents(edges: DataFrame, roots: DataFrame, max_depth: int = 64, max_nodes: int = 25_000) -> DataFrame:
    """(root, node, parent, depth, rank) as `reachable` has them, for roots that share little of what they reach, like
    operations and the methods they call: a row for each pair from the start, so one pass finds depths and parents."""
    e = materialize(edges.select("source", "target").where("source is not null and target is not null"), "graph-edges")
    front = materialize(roots.select("root", F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank")).distinct(), "pairs-0")
    levels, key = [front], ["_h", "root", "node"]
    for depth in count(1):
        step = front.join(e, _by_name(F.col("node"), F.col("source"))).select("root", F.col("target").alias("node"), F.struct("rank", "node").alias("p"))
        seen = _merged(levels).select(F.xxhash64("root", "node").alias("_h"), "root", "node")
        step = step.withColumn("_h", F.xxhash64("root", "node")).groupBy(*key).agg(F.min("p").alias("p")).join(seen, key, "left_anti")
        turn = Window.partitionBy(F.xxhash64("root"), "root").orderBy("p.rank", "node")
        front = step.select("root", "node", F.col("p.node").alias("parent"), F.lit(depth).alias("depth"), F.row_number().over(turn).cast("long").alias("rank"))
        front = materialize(front, f"pairs-{depth}")
        if front.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"{front.first()['root']} reaches nodes beyond depth {max_depth}")
        levels.append(front)
        # The last rank is a level's size, so the greatest ranks add up to no less than any root has.
        if sum(level.agg(F.max("rank")).first()[0] or 0 for level in levels) > max_nodes:
            if over := _merged(levels).groupBy("root").count().where(F.col("count") > max_nodes).first():
                raise ValueError(f"{over['root']} reaches more than {max_nodes} nodes")
    return _merged(levels)


def nearest_owner(reach: DataFrame, owners: DataFrame) -> DataFrame:
    """The owner (node, owner) at the least depth of each root, if it is the only one there."""
    return unique_or_null(reach.join(owners, "node").select("root", "owner", "depth").distinct(), ["root"], [F.col("depth")])


def paths(reach: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`root => … => node` of each reached node, level by level along parents, down to max_depth or to the
    deepest node."""
    if max_depth is None:
        max_depth = reach.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    level = reach.where("depth = 0").select("root", "node", F.col("node").alias("path"))
    out = level
    for d in range(1, max_depth + 1):
        level = reach.where(F.col("depth") == d).join(level.withColumnsRenamed({"node": "parent", "path": "up"}), ["root", "parent"]).select("root", "node", F.concat("up", F.lit(" => "), "node").alias("path"))
        out = out.union(level)
    return out


def _by_name(left: Column, right: Column) -> Column:
    """Equal names, as join keys that sort by a hash first: names of one kind begin alike, which makes sorting them slow."""
    return (F.xxhash64(left) == F.xxhash64(right)) & (left == right)


def _hanging(e: DataFrame, joints: DataFrame, deepest: int) -> list[DataFrame]:
    """Levels of (top, node, way): nodes that one edge alone leads to hang below the joint (id, node) that all ways to them
    cross; way holds the names from there down to the node. The first level is the joints, each with an empty way."""
    hang = materialize(e.join(joints, _by_name(F.col("target"), F.col("node")), "left_anti"), "graph-hanging")
    left = hang.count()
    levels = [joints.select(F.col("id").alias("top"), "node", F.array().cast("array<string>").alias("way"))]
    while left and len(levels) <= deepest:
        step = levels[-1].join(hang, _by_name(F.col("node"), F.col("source"))).select("top", F.array_append("way", F.col("target")).alias("way"))
        level = materialize(step, f"hanging-{len(levels)}")
        if not (n := level.count()):
            break
        left -= n
        levels.append(level.select("top", F.element_at("way", -1).alias("node"), "way"))
    return levels


def _weighted_sets(core: DataFrame, numbered: DataFrame, max_depth: int, partial: bool, merge: int = 8) -> dict[int, DataFrame]:
    """reach_sets over edges (source, target, weight), by depth: a node is settled at its least depth, and depths at which
    none is settled are passed over."""
    start = numbered.groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    depth, pending = 0, None
    levels = {0: materialize(start, "reach-0")}
    kept = [levels[0]]
    while True:
        seen = _merged(kept).groupBy("node", "word").agg(F.bit_or("bits").alias("seen"))
        if len(kept) > merge:
            seen = materialize(seen, f"reach-seen-{depth}")
            kept = [seen.withColumnRenamed("seen", "bits")]
        front = levels[depth]
        step = front.join(core, front["node"] == core["source"]).select(F.col("target").alias("node"), "word", (F.col("weight") + depth).alias("depth"), "bits")
        if partial:
            step = step.where(F.col("depth") <= max_depth)
        step = step.groupBy("node", "word", "depth").agg(F.bit_or("bits").alias("bits"))
        if pending is not None:
            step = step.union(pending.where(F.col("depth") > depth))
        step = step.join(seen, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        pending = materialize(step.where("bits <> 0").drop("seen"), f"reach-next-{depth}")
        depth = pending.agg(F.min("depth")).first()[0]
        if depth is None:
            return levels
        levels[depth] = materialize(pending.where(F.col("depth") == depth).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), f"reach-{depth}")
        kept.append(levels[depth])
        if depth > max_depth:
            raise ValueError(f"{_some_root(numbered, levels[depth])} reaches nodes beyond depth {max_depth}")


def shortest_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 64, partial: bool = False) -> DataFrame:
    """G4 from the edges: (root, node, depth, path, way), the rows that `paths` makes of `reachable`, whose parents are
    those of the least way: ranks go by (parent rank, node), so they order nodes as their ways do, name by name. way holds
    the names that path joins.

    Only joints, which are roots and nodes that more than one edge leads to, are searched. All other nodes hang below a
    joint: whoever reaches it reaches them, by one way. Of the ways from joint to joint the shortest and least counts, as
    one edge with a weight. Levels are packed sets. Ways are written only for joints that lead on to a new one or bear
    hanging nodes; the ways of all others, mostly the bulk, arise when they are read. Only where several edges of one root
    meet are ways compared."""
    e = materialize(edges.select("source", "target").where("source is not null and target is not null"), "graph-edges")
    numbered = numbered_roots(roots)
    # An edge given twice makes its target a joint, which changes the work, not the result.
    joints = e.groupBy("target").count().where("count > 1").select(F.col("target").alias("node")).union(numbered.select("root")).distinct()
    joints = materialize(joints.select("node", F.monotonically_increasing_id().alias("id")), "graph-joints")
    numbered = materialize(numbered.join(joints, F.col("root").eqNullSafe(F.col("node"))).select("root", F.col("id").alias("node"), "word", "bit"), "path-roots")
    hanging = _hanging(e, joints, max_depth if partial else max_depth + 1)
    meeting = e.join(joints, _by_name(F.col("target"), F.col("node"))).select("source", "id")
    core = _merged(hanging).join(meeting, _by_name(F.col("node"), F.col("source"))).where("top <> id").groupBy("id", "top").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("s"))
    core = core.join(joints, "id").select(F.col("top").alias("source"), F.col("id").alias("target"), (F.col("s.n") + 1).alias("weight"), F.array_append("s.way", F.col("node")).alias("tail"))
    core = materialize(core, "graph-core")
    levels = _weighted_sets(core, numbered, max_depth, partial)
    sets = materialize(_merged([x.withColumn("depth", F.lit(d)) for d, x in levels.items()]), "path-sets")
    if not partial and max(levels) + len(hanging) - 1 > max_depth:
        ends = _merged([x.groupBy("top").agg(F.lit(i).alias("below")) for i, x in enumerate(hanging)])
        if over := sets.join(ends, F.col("node") == F.col("top")).where(F.col("depth") + F.col("below") > max_depth).drop("node", "top").first():
            raise ValueError(f"{_some_root(numbered, sets.sparkSession.createDataFrame([over]))} reaches nodes beyond depth {max_depth}")
    bearing = materialize(_merged(hanging[1:2] or [hanging[0].limit(0)]).select(F.col("top").alias("node")).distinct(), "graph-bearing")
    weights = {r["weight"] for r in core.select("weight").distinct().collect()}
    show = lambda level: level.select(F.col("way")[0].alias("root"), F.element_at("way", -1).alias("node"), (F.size("way") - 1).alias("depth"), F.array_join("way", " => ").alias("path"), "way")
    ways = {0: numbered.select("node", "word", "bit", F.array("root").alias("way"))}
    out = [show(ways[0])]
    for d in list(levels)[1:]:
        lead = levels[d].join(core.withColumnsRenamed({"target": "node", "source": "parent"}), "node")
        above = sets.withColumnsRenamed({"node": "parent", "bits": "above"})
        lead = lead.join(above, ["parent", "word"]).where(F.col("depth") + F.col("weight") == d)
        lead = materialize(lead.select("node", "word", "bits", "parent", "tail", F.col("bits").bitwiseAND(F.col("above")).alias("over")).where("over <> 0"), f"lead-{d}")
        meet = lead.groupBy("node", "word").agg((F.sum(F.bit_count("over")) > F.max(F.bit_count("bits"))).alias("several"))
        on = sets.withColumnRenamed("node", "target").join(core, "target").where(F.col("depth") - F.col("weight") == d)
        on = on.select(F.col("source").alias("node"), "word", "bits").union(levels[d].join(bearing, "node", "left_semi")).groupBy("node", "word").agg(F.bit_or("bits").alias("on"))
        lead = materialize(lead.join(meet, ["node", "word"]).join(on, ["node", "word"], "left").withColumn("on", F.coalesce("on", F.lit(0).cast("long"))), f"leads-{d}")
        before = _merged([x for at, x in ways.items() if d - at in weights]).withColumnRenamed("node", "parent")
        level = {}
        for goes, mask in ((True, F.col("on")), (False, F.bitwise_not("on"))):
            some = lead.withColumn("over", F.col("over").bitwiseAND(mask)).where("over <> 0")
            each = some.join(before, ["parent", "word"]).where("shiftright(over, bit) & 1L = 1")
            each = each.select("node", "word", "bit", F.concat("way", "tail").alias("way"), "several")
            level[goes] = each.where("not several").drop("several").union(each.where("several").groupBy("node", "word", "bit").agg(F.min("way").alias("way")))
        ways[d] = materialize(level[True], f"ways-{d}")
        out += [show(ways[d]), show(level[False])]
    if len(hanging) > 1:
        tops = _merged(list(ways.values())).join(bearing, "node", "left_semi").groupBy(F.col("node").alias("top"), "word").agg(F.collect_list("way").alias("ways"))
        below = _merged(hanging[1:]).join(materialize(tops, "graph-tops"), "top")
        if partial:
            below = below.withColumn("ways", F.expr(f"filter(ways, w -> size(w) + size(way) <= {max_depth + 1})"))
        out.append(show(below.withColumn("_up", F.explode("ways")).select(F.concat("_up", "way").alias("way"))))
    return _merged(out)


def schema_closure(fields: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """Schemas that a schema's fields (schema, field, ref) reach."""
    return reachable(fields.where("ref is not null").select(F.col("schema").alias("source"), F.col("ref").alias("target")), roots, max_depth)


def expand_paths(roots: DataFrame, fields: DataFrame, max_depth: int = 32) -> DataFrame:
    """(root, path, schema) of nested fields (schema, field, ref, is_list; kind `map` or `page` where the table says),
    max_depth levels deep; a schema never repeats on its path. Lists add `[]`, the value of a map keeps the map's own
    path, the items of a page stand under `list[]`."""
    kind = F.coalesce(F.col("kind"), F.lit("field")) if "kind" in fields.columns else F.lit("field")
    level = roots.select("root", F.lit("").alias("path"), F.col("root").alias("schema"), F.array("root").alias("up"))
    out = level
    for d in range(max_depth):
        step = level.join(fields.withColumn("_kind", kind), "schema").where("ref is not null and not array_contains(up, ref)")
        dot = lambda a, b: F.concat(F.when(a == "", "").otherwise(F.concat(a, F.lit("."))), b)
        name = dot(F.col("path"), F.concat("field", F.when(F.col("is_list"), "[]").otherwise("")))
        name = F.when(F.col("_kind") == "page", dot(dot(F.col("path"), F.col("field")), F.lit("list[]"))).otherwise(name)
        level = materialize(step.select("root", name.alias("path"), F.col("ref").alias("schema"), F.array_append("up", F.col("ref")).alias("up")), f"paths-{d}")
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("root", "path", "schema").distinct()


def flatten_inheritance(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of each class (class, parent), (class, field, pos, type): those of ancestors first; a field that is
    defined again comes at its nearest definition."""
    up = classes.where("parent is not null").select(F.col("class").alias("source"), F.col("parent").alias("target"))
    chain = pair_depths(up, classes.select(F.col("class").alias("root")))
    all_fields = chain.select("root", F.col("node").alias("class"), "depth").join(fields, "class")
    w = Window.partitionBy("root", "field").orderBy("depth")
    near = all_fields.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return near.select("root", "field", "type", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("depth"), "pos", "field")).alias("position"))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (source, target) that lie on a cycle; nodes of one component reach each other.

    First the graph is made small: nodes without an edge in or out are on no cycle, and a node with one edge in and one
    out is on a cycle exactly if the two neighbours are in one component, so it gives way to an edge between them. Of
    such nodes side by side, those that come first by a hash of the round go, about a third, so a chain or ring of any
    length is gone after rounds that grow with its logarithm. What is left is coloured: the greatest node that reaches a
    node is its colour, and of a colour the nodes that reach the greatest one back are its component."""
    left = materialize(edges.select("source", "target").where("source is not null and target is not null").distinct(), "cycle-edges")
    chains, own, found = [], [left.where("source = target").select(F.col("source").alias("node"))], []
    left = left.where("source <> target")
    for turn in count():
        ends = left.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("target").alias("to"), F.lit(None).cast("string").alias("of"))
        ends = ends.union(left.select("target", F.lit(0), F.lit(1), F.lit(None).cast("string"), "source"))
        nodes = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("to").alias("to"), F.max("of").alias("of"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)
        chain = nodes.where("o = 1 and i = 1")
        beside = chain.select(F.col("to").alias("node"), F.col("node").alias("by")).union(chain.select("of", "node")).groupBy("node").agg(F.max(rank(F.col("by"))).alias("most"))
        nodes = nodes.join(beside, "node", "left")
        first = (F.col("o") == 1) & (F.col("i") == 1) & (F.col("most").isNull() | (rank(F.col("node")) > F.col("most")))
        out = nodes.withColumn("dead", (F.col("o") == 0) | (F.col("i") == 0)).where(F.col("dead") | first).select("node", "dead", "to", "of")
        out = materialize(out, f"cycle-out-{turn}")
        if out.isEmpty():
            break
        off = lambda df, c, rows: df.join(rows.select(F.col("node").alias(c)), c, "left_anti")
        dead, gone = out.where("dead"), out.where("not dead").select("node", "to", "of")
        kept = off(off(left, "source", out), "target", out).select("source", "target")
        # A dead neighbour leaves in the same round: the edge over a node that gives way needs both of its ends.
        over = off(off(gone.select(F.col("of").alias("source"), F.col("to").alias("target")), "source", dead), "target", dead).select("source", "target")
        left = materialize(kept.union(over).distinct(), f"cycle-left-{turn}")
        own.append(left.where("source = target").select(F.col("source").alias("node")))
        chains.append(gone)
        left = left.where("source <> target")
    while not left.isEmpty():
        colour = materialize(left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            more = left.join(colour, left["source"] == colour["node"]).select(F.col("target").alias("node"), "colour").union(colour).groupBy("node").agg(F.max("colour").alias("colour"))
            more = materialize(more, "colours")
            grew = more.withColumnRenamed("colour", "now").join(colour, "node").where("now <> colour").limit(1).count()
            colour = more
            if not grew:
                break
        named = left.join(colour.withColumnsRenamed({"node": "source", "colour": "a"}), "source").join(colour.withColumnsRenamed({"node": "target", "colour": "b"}), "target")
        inner = materialize(named.where("a = b").select("source", "target", F.col("a").alias("colour")), "colour-edges")
        front = colour.where("node = colour")
        parts = [front]
        while True:
            step = inner.join(front.withColumnsRenamed({"node": "target"}), ["target", "colour"]).select(F.col("source").alias("node"), "colour").distinct()
            front = materialize(step.join(_merged(parts), ["node", "colour"], "left_anti"), "colour-back")
            if front.isEmpty():
                break
            parts.append(front)
            if len(parts) > 8:
                parts = [materialize(_merged(parts), "colour-seen")]
        # A greatest node that nothing but itself reaches back is on no cycle: loops of one node were taken out above.
        comp = _merged(parts).withColumn("n", F.count("*").over(Window.partitionBy("colour"))).where("n > 1").select("node", F.col("colour").alias("component"))
        comp = materialize(comp, "components")
        found.append(comp)
        seen = colour.where("node = colour").select("node").union(comp.select("node")).distinct()
        left = materialize(inner.join(seen.withColumnRenamed("node", "source"), "source", "left_anti").join(seen.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"), "cycle-left")
    # A node that came to a loop of its own is on a cycle; it is its own component unless it lies in a greater one, which
    # shows when it comes back between its neighbours.
    alone = materialize(_merged(own).distinct().withColumn("component", F.col("node")), "cycle-alone")
    comp = _merged(found) if found else alone.where("false")
    rest = alone.join(comp.select("node"), "node", "left_anti")
    for gone in chains:
        rest = rest.join(gone.select("node"), "node", "left_anti")
    comp = materialize(comp.union(rest), "components")
    for gone in reversed(chains):
        a, b = (comp.withColumnsRenamed({"node": n, "component": c}) for n, c in (("of", "a"), ("to", "b")))
        back = gone.join(a, "of").join(b, "to").where("a = b").select("node", F.col("a").alias("component"))
        looped = alone.join(gone.select("node"), "node", "left_semi").join(back.select("node"), "node", "left_anti")
        comp = materialize(comp.union(back).union(looped), "components")
    return comp


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (source, target): nodes of one component hang together, whichever way edges point.

    Each round every node goes to its least neighbour by a hash of the round, unless it is less itself, and on to where
    that one goes. So rounds grow with the logarithm of a component, and what is left shrinks by more than half in each."""
    left, maps = materialize(edges.select("source", "target").where("source <> target").distinct(), "weak-edges"), []
    for turn in count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))
        ends = left.select(F.col("source").alias("node"), rank("target").alias("to")).union(left.select("target", rank("source")))
        least = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", rank("node"))["n"].alias("to"))
        hop = materialize(least, f"weak-hop-{turn}")
        if hop.isEmpty():
            break
        further = hop.join(hop.select(F.col("node").alias("to"), F.col("to").alias("on")).where("to <> on").hint("shuffle_merge"), "to", "left")
        hop = materialize(further.select("node", F.coalesce("on", "to").alias("to")), f"weak-to-{turn}")
        maps.append(hop)
        moved = left.join(hop.select(F.col("node").alias("source"), F.col("to").alias("a")).hint("shuffle_merge"), "source").join(hop.select(F.col("node").alias("target"), F.col("to").alias("b")).hint("shuffle_merge"), "target")
        left = materialize(moved.where("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct(), f"weak-left-{turn}")
    comp = left.select(F.col("source").alias("node"), F.col("target").alias("component"))
    for hop in reversed(maps):
        comp = hop.join(comp.withColumnRenamed("node", "to").hint("shuffle_merge"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return materialize(comp, "weak-components")


def _cycles(heads: dict[str, set]) -> list[list[str]]:
    """The strongly connected components of heads (node: its successors), those that flow into others last."""
    found, index, low, stack, on = [], {}, {}, [], set()
    for root in heads:
        todo = [] if root in index else [(root, iter(heads[root]))]
        if todo:
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    stack.append(y)
                    on.add(y)
                    todo.append((y, iter(heads.get(y, ()))))
                    break
                if y in on:
                    low[x] = min(low[x], index[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == index[x]:
                    found.append([stack.pop()])
                    while found[-1][-1] != x:
                        found[-1].append(stack.pop())
                    on.difference_update(found[-1])
    return found


def _settled(rows: list[tuple]) -> Iterator[tuple]:
    """(slot, domain) of one group's rows (slot, from_slot, domain): a row with neither is a slot of the operation."""
    mine, bound, has, heads = set(), set(), {}, {}
    for slot, source, domain in rows:
        mine.add(slot)
        if source is not None:
            heads.setdefault(source, set()).add(slot)
            bound.add(slot)
        elif domain is not None:
            has.setdefault(slot, set()).add(domain)
            bound.add(slot)
    for slot in mine - bound:
        has[slot] = {"unknown"}
    for part in reversed(_cycles(heads)):
        here = set().union(*(has.get(x, ()) for x in part))
        if len(part) > 1 or part[0] in heads.get(part[0], ()):
            here.add("unknown")
        for x in part if here else ():
            has[x] = here
        for y in set().union(*(heads.get(x, ()) for x in part)).difference(part) if here else ():
            has.setdefault(y, set()).update(here)
    for slot in mine:
        for domain in has.get(slot, ()):
            yield slot, domain


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Domains of sorted rows (operation, component, slot, from_slot, domain), group after group."""
    key, rows, out = None, [], ([], [], [])

    def close() -> None:
        for slot, domain in _settled(rows):
            out[0].append(key[0]), out[1].append(slot), out[2].append(domain)
        rows.clear()

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["operation", "slot", "domain"])
        for c in out:
            c.clear()
        return b

    for b in batches:
        for operation, component, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (operation, component) != key:
                close()
                key = (operation, component)
                if len(out[0]) > 50_000:
                    yield flush()
            rows.append(row)
    close()
    yield flush()


GROUP_ROWS = 20_000  # rows of a component that one task may hold


def propagate_domains(slots: DataFrame, arguments: DataFrame, reach: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(operation, slot, domain): what calls within an operation's reach bind to the slots of reached methods.

    slots has (slot, method), the parameters; arguments has a row for each argument of a resolved call: (caller, method,
    slot, from_slot, domain), from_slot where a parameter of the caller is passed on, else the domain of the expression
    (null: unknown); reach is G1's or G2's result. Calls of a method by itself and callers outside the reach bind
    nothing. A slot that nothing binds and every slot on a cycle of flows is `unknown`, and unknown flows on like any
    domain. Flows longer than max_rounds are an error.

    Slots that no flow connects, in whichever operation, have nothing to do with each other. So slots are parted into
    components once, and a component of at most GROUP_ROWS rows is settled in one task for each operation; the rows of greater
    ones flow between tasks, and all do where max_rounds counts the rounds."""
    method_of = materialize(reach.select(F.col("root").alias("operation"), "node").where("root is not null and node is not null").distinct(), "domain-reach")
    calls = materialize(arguments.where("caller <> method").select("caller", "slot", "from_slot", F.when(F.col("from_slot").isNull(), F.coalesce("domain", F.lit("unknown"))).alias("domain")).distinct(), "arguments")
    if max_rounds is not None:
        return _flowing_domains(slots, calls, method_of, max_rounds)
    flows = calls.where("from_slot is not null").select(F.col("from_slot").alias("source"), F.col("slot").alias("target"))
    parts = weak_components(flows).select(F.col("node").alias("slot"), "component")
    none = F.lit(None).cast("string")
    rows = calls.unionByName(slots.select(F.col("method").alias("caller"), "slot", none.alias("from_slot"), none.alias("domain"))).where("slot is not null")
    rows = materialize(rows.join(parts.hint("shuffle_merge"), "slot", "left").select("caller", F.coalesce("component", "slot").alias("component"), "slot", "from_slot", "domain"), "domain-rows")
    great = materialize(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("component"), "domain-great")
    more = None
    if not great.isEmpty():
        of = rows.join(great.hint("shuffle_hash"), "component", "left_semi").drop("component")
        own = of.where("from_slot is null and domain is null").select("slot", F.col("caller").alias("method"))
        more = _flowing_domains(own, of.where("from_slot is not null or domain is not null"), method_of, None)
        rows = rows.join(great.hint("shuffle_hash"), "component", "left_anti")
    active = rows.join(method_of.withColumnRenamed("node", "caller").hint("shuffle_merge"), "caller").select("operation", "component", "slot", "from_slot", "domain")
    dealt = active.repartition("operation", "component").sortWithinPartitions("operation", "component")
    out = dealt.mapInArrow(_settle, "operation string, slot string, domain string")
    return out.union(more) if more is not None else out


def _flowing_domains(slots: DataFrame, calls: DataFrame, method_of: DataFrame, max_rounds: int | None) -> DataFrame:
    """The least fixpoint: slots of one cycle share their domains, so cycles are folded into one slot each, and rows of
    (operation, slot, domain) flow along what is left."""
    active = materialize(calls.join(method_of.withColumnRenamed("node", "caller"), "caller").select("operation", "slot", "from_slot", "domain").distinct(), "arguments-active")
    mine = slots.select("slot", F.col("method").alias("node")).join(method_of, "node").select("operation", "slot").union(active.select("operation", "slot")).distinct()
    # Cycles that no operation cuts are found on all flows at once; within them, what each operation reaches decides.
    flows = calls.where("from_slot is not null").select(F.col("from_slot").alias("source"), F.col("slot").alias("target"))
    around = cyclic_components(flows)
    of = lambda n, c: around.withColumnsRenamed({"node": n, "component": c})
    within = active.where("from_slot is not null").join(of("from_slot", "a"), "from_slot").join(of("slot", "b"), "slot").where("a = b")
    key = lambda c: F.concat("operation", F.lit("\0"), c)
    cycles = cyclic_components(within.select(key("from_slot").alias("source"), key("slot").alias("target")))
    part = lambda c, i: F.split(c, "\0")[i]
    cycles = materialize(cycles.select(part(F.col("node"), 0).alias("operation"), part(F.col("node"), 1).alias("slot"), part(F.col("component"), 1).alias("fold")), "cycles")
    folded = lambda df, slot, out: df.join(cycles.withColumnsRenamed({"slot": slot, "fold": "_f"}), ["operation", slot], "left").withColumn(out, F.coalesce("_f", slot)).drop("_f")
    edges = folded(folded(active.where("from_slot is not null"), "from_slot", "a"), "slot", "b").where("a <> b")
    edges = materialize(edges.select("operation", F.col("a").alias("source"), F.col("b").alias("target")).distinct(), "flows")
    bound = folded(active.where("domain is not null"), "slot", "at").select("operation", "at", "domain")
    lost = mine.join(active.select("operation", "slot"), ["operation", "slot"], "left_anti").select("operation", F.col("slot").alias("at")).union(cycles.select("operation", "fold"))
    front = materialize(bound.union(lost.withColumn("domain", F.lit("unknown"))).distinct(), "domains-0")
    parts = [front]
    for turn in count(1):
        step = front.withColumnRenamed("at", "source").join(edges, ["operation", "source"]).select("operation", F.col("target").alias("at"), "domain").distinct()
        front = materialize(step.join(_merged(parts), ["operation", "at", "domain"], "left_anti"), f"domains-{turn}")
        if front.isEmpty():
            break
        if max_rounds and turn > max_rounds:
            raise ValueError(f"{front.first()['at']} lies beyond {max_rounds} flows")
        parts.append(front)
        if len(parts) > 8:
            parts = [materialize(_merged(parts), f"domains-to-{turn}")]
    at = folded(mine, "slot", "at")
    return at.join(_merged(parts).hint("shuffle_merge"), ["operation", "at"]).select("operation", "slot", "domain")


def chains(reach: DataFrame, targets: DataFrame, names: DataFrame) -> DataFrame:
    """(root, node, chain): the names (node, name) on the way from a root to each target (root, node), joined by ` => `;
    nodes without a name are left out. Levels go up from the targets first, so only nodes on some way are named."""
    key, last = ["_h", "root", "node"], reach.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    pair = lambda df, node, *more: df.select(F.xxhash64("root", node).alias("_h"), "root", F.col(node).alias("node"), *more)
    want, levels = [pair(targets, "node", F.lit(True).alias("asked"))], []
    for d in range(last, -1, -1):
        asked = _merged(want).groupBy(*key).agg(F.max("asked").alias("asked"))
        level = materialize(pair(reach.where(F.col("depth") == d), "node", "parent").join(asked.hint("shuffle_merge"), key).drop("_h"), f"chain-{d}")
        levels.append(level)
        want.append(pair(level.where("parent is not null"), "parent", F.lit(False).alias("asked")))
    named = names.select(F.col("node").alias("_of"), "name")
    spelt = lambda level: level.join(named, _by_name(F.col("node"), F.col("_of")), "left")
    up = spelt(levels.pop()).select("root", "node", F.array_compact(F.array("name")).alias("way"), "asked")
    out = up
    while levels:
        above = pair(up, "node", F.col("way").alias("above")).withColumnRenamed("node", "parent")
        up = levels.pop().withColumn("_h", F.xxhash64("root", "parent")).join(above.hint("shuffle_merge"), ["_h", "root", "parent"])
        up = spelt(up).select("root", "node", F.concat("above", F.array_compact(F.array("name"))).alias("way"), "asked")
        out = out.union(up)
    return out.where("asked").select("root", "node", F.array_join("way", " => ").alias("chain"))


NO_DOMAIN = "struct<enum_fqn:string,accessor:string,complete:boolean,external:array<string>,unknown:array<string>,literals:array<string>,transformed:boolean,values:array<string>>"


def field_lineage(reach: DataFrame, nodes: DataFrame, fields: DataFrame, calls: DataFrame, sites: DataFrame, unresolved: DataFrame, bindings: DataFrame, domains: DataFrame) -> DataFrame:
    """Verdict on each field (operation, field, setter; null if the setter is not indexed) over the write sites that
    its operation reaches: A3's columns, with operation and field for the target.

    reach is G1's or G2's result, nodes has (node, name, file). Indexed setter calls (caller, setter, line, column) take
    the nearest parsed site (caller, setter, line, column, source, slot) of their line (J9). Three kinds of unknown
    writes come beside them: calls without a site, sites on lines without an indexed call (J10), and references
    (caller, setter, line, column) that the index could not resolve. The domains of a site are those that its slot has
    within the operation (operation, slot, domain; G8), looked up in the table of domains (domain, enum_fqn, accessor,
    complete, external, unknown, literals, transformed, values); a domain that is not there is unknown by its name. A
    slot with several domains is one site. Evidence tells where a field is written and the chain of calls to there."""
    on, to, no = ["_h", "caller", "setter", "line"], ["_h", "caller", "setter"], F.lit(None).cast("string")
    # Setters of no field are left out. What does not depend on the operation is settled first; all that comes of a caller
    # and setter is sent once, and a hash of the names is the key to sort by.
    setters = materialize(fields.where("setter is not null").select("setter").distinct(), "lineage-setters")
    tables = ((0, sites, "slot", "source"), (1, calls, no, no), (2, unresolved, no, no))
    parts = [df.join(setters, "setter", "left_semi").select(F.xxhash64("caller", "setter").alias("_h"), "caller", "setter", "line", "column", F.lit(kind).alias("kind"), (F.col(x) if kind == 0 else x).alias("slot"), (F.col(y) if kind == 0 else y).alias("source")) for kind, df, x, y in tables]
    rows = _merged(parts).repartition(*to)
    # The nearest site of a call is J9's, told from the sites before and after it; a line without a call is J10's.
    # Of one position sites come first on the way down and last on the way up, so sites see all calls of their line.
    known, is_site, site = F.col("line").isNotNull() & F.col("column").isNotNull(), F.col("kind") == 0, F.struct(F.col("column").alias("c"), "slot", "source")
    line = Window.partitionBy(*on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down, up = line.orderBy("column", F.desc(is_site), F.desc(site)), line.orderBy(F.desc("column"), is_site, F.desc(site))
    last, call = F.last(F.when(is_site & known, site), ignorenulls=True), F.max((F.col("kind") == 1) & F.col("line").isNotNull())
    rows = rows.select("*", last.over(down).alias("before"), call.over(down).alias("called")).select("*", last.over(up).alias("after"), call.over(up).alias("later")).where(~is_site | ~(F.col("called") | F.col("later")))
    near = F.when(F.col("after").isNull() | (F.col("column") - F.col("before.c") <= F.col("after.c") - F.col("column")), F.col("before")).otherwise(F.col("after"))
    rows = rows.withColumn("site", F.when((F.col("kind") == 1) & known, near))
    why = F.when(F.col("kind") == 2, "unresolved setter call:").when(is_site, "unindexed setter call:").when(F.col("site").isNull(), "unindexed setter argument at ")
    rows = rows.select(*on, "column", F.col("site.slot").cast("string").alias("slot"), F.col("site.source").cast("string").alias("source"), why.alias("why"))
    # Of an operation's first pieces of evidence and unknowns, each is among the first ones of its caller, setter and slot.
    rows = rows.distinct().withColumn("order", F.when(F.col("why").isNotNull(), F.concat("why", "line", F.lit(":"), "column")))
    turn = Window.partitionBy(*to, F.col("why").isNull(), F.col("source").isNull(), "slot").orderBy("order", F.when(F.col("why").isNull(), F.struct("line", "column", "source")))
    rows = rows.withColumn("_r", F.dense_rank().over(turn)).where(F.col("_r") <= F.when(F.col("why").isNull(), EVIDENCE).otherwise(SHOWN)).drop("order", "_r")
    mine = reach.select(F.col("root").alias("operation"), F.col("node").alias("caller")).join(nodes.select("node", "file"), _by_name(F.col("caller"), F.col("node"))).drop("node")
    mine = mine.join(fields.where("setter is not null").select(F.col("operation").alias("_of"), "field", "setter"), _by_name(F.col("operation"), F.col("_of"))).drop("_of")
    met = materialize(mine.withColumn("_h", F.xxhash64("caller", "setter")).join(rows.hint("shuffle_merge"), to).drop("setter", "_h"), "lineage-met")
    # The domains of one slot are one row: branches of an expression are merged before the verdict.
    none, key, slot = F.array().cast("array<string>"), ["operation", "field"], ["_h", "operation", "slot"]
    hashed = lambda df, *names: df.withColumn("_h", F.xxhash64(*names))
    dom = materialize(domains.select("domain", F.struct("enum_fqn", "accessor", "complete", "external", "unknown", "literals", "transformed", "values").cast(NO_DOMAIN).alias("d")), "lineage-domains")
    named = F.when(F.col("d.enum_fqn").isNotNull(), F.struct("d.enum_fqn", "d.accessor", "d.complete", "d.values"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    lone = F.coalesce("d.unknown", F.array(F.coalesce("domain", F.lit("unknown"))))
    of_slot = hashed(bindings.join(dom, "domain", "left"), "operation", "slot").groupBy(*slot).agg(F.min(named).alias("e"), F.max(named).alias("z"), flat(F.coalesce("d.external", none)).alias("external"), flat(lone).alias("unknown"), flat(F.coalesce("d.literals", none)).alias("literals"), F.bool_or(F.coalesce("d.transformed", F.lit(False))).alias("transformed"))
    by_slot = hashed(met.where("why is null"), "operation", "slot").groupBy(*slot, "field").agg(F.min(F.struct("file", "line", "column")).alias("position"))
    by_slot = by_slot.join(of_slot.hint("shuffle_merge"), slot, "left").withColumn("unknown", F.coalesce("unknown", F.array(F.lit("unknown"))))
    clash = ~F.struct("e.enum_fqn", "e.accessor").eqNullSafe(F.struct("z.enum_fqn", "z.accessor"))
    told = F.when(clash, F.array_append("unknown", F.concat(F.lit("conflicting enum projections:"), "e.enum_fqn", F.lit(":"), "z.enum_fqn"))).otherwise(F.col("unknown"))
    rows = by_slot.select(*key, "position", "e.enum_fqn", "e.accessor", F.coalesce(F.col("e.complete") & ~clash, F.lit(False)).alias("complete"), F.coalesce("external", none).alias("external"), told.alias("unknown"), F.coalesce("literals", none).alias("literals"), F.coalesce("transformed", F.lit(False)).alias("transformed"), F.coalesce("e.values", none).alias("values"))
    whole = F.lit(None).cast(NO_DOMAIN)
    why = F.array(F.concat("why", "file", F.lit(":"), "line", F.lit(":"), "column"))
    bare = met.where("why is not null").select(*key, F.lit(None).cast(rows.schema["position"].dataType).alias("position"), whole["enum_fqn"].alias("enum_fqn"), whole["accessor"].alias("accessor"), F.lit(False).alias("complete"), none.alias("external"), why.alias("unknown"), none.alias("literals"), F.lit(False).alias("transformed"), none.alias("values"))
    rows = materialize(rows.unionByName(bare).select(F.struct(*key).alias("target"), *rows.columns[2:]), "lineage-rows")
    # Evidence: the write of each site, then the way to its caller.
    targets = materialize(met.where("why is null").select(F.col("operation").alias("root"), F.col("caller").alias("node")).distinct(), "lineage-callers")
    way = chains(reach, targets, nodes).withColumnsRenamed({"root": "operation", "node": "caller"})
    at = ["operation", "caller"]
    proofs = hashed(met.where("why is null"), *at).join(hashed(way, *at).hint("shuffle_merge"), ["_h", *at], "left")
    write = F.struct(F.lit(0).alias("at"), F.concat(F.lit("write:"), "file", F.lit(":"), "line", F.lit(":"), "column", F.lit(":"), "source").alias("text"))
    chain = F.struct(F.lit(1).alias("at"), F.concat(F.lit("chain:"), F.coalesce("chain", F.lit(""))).alias("text"))
    proofs = proofs.select(F.struct(*key).alias("target"), F.struct("file", "line", "column").alias("position"), F.explode(F.array(write, chain)).alias("x")).select("target", "position", "x.*")
    verdict = classify_domains(rows, proofs)
    out = fields.join(verdict.select("target.*", *verdict.columns[1:]).hint("shuffle_merge"), ["operation", "field"], "left")
    why = F.when(F.col("setter").isNull(), "setter not indexed").when(F.col("status").isNull(), "no operation-reachable write site").otherwise(F.col("warning"))
    return out.select("operation", "field", F.coalesce("status", F.lit("unresolved")).alias("status"), "enum_fqn", "accessor", "values", "unknowns", "evidence", why.alias("warning"))


def enum_domains(constants: DataFrame, accessors: DataFrame) -> DataFrame:
    """Constants (enum, constant, position, value), accessors (enum, accessor, position): whether every constant has
    a value of its own, and the values."""
    j = constants.select("enum", "constant").distinct().join(accessors, "enum").join(constants.select("enum", "constant", "position", "value"), ["enum", "constant", "position"], "left")
    g = j.groupBy("enum", "accessor").agg(F.count("*").alias("n"), F.count("value").alias("has"), F.count_distinct("value").alias("d"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    return g.select("enum", "accessor", ((F.col("n") == F.col("has")) & (F.col("n") == F.col("d"))).alias("complete"), "values")


def link_enums(fields: DataFrame, domains: DataFrame) -> DataFrame:
    """(field, enums array, accessors array) with the first enum's first accessor whose domain is complete."""
    a = fields.select("field", F.get("enums", F.lit(0)).alias("enum"), F.posexplode("accessors").alias("pos", "accessor"))
    hit = a.join(domains.where("complete and values <> ''").hint("shuffle_merge"), ["enum", "accessor"])
    return hit.groupBy("field").agg(F.min_by(F.struct("enum", "accessor", "values"), "pos").alias("x")).select("field", "x.*")


def pair_schemas(old: DataFrame, new: DataFrame, seeds: DataFrame) -> DataFrame:
    """Walks two schema tables (schema, field, ref) side by side by field name from (old, new) seeds, to the end;
    the first pairing of an old schema wins, so the walk ends however the schemas turn back on themselves."""
    o = materialize(old.where("ref is not null").select("schema", "field", "ref"), "pair-old")
    n = materialize(new.where("ref is not null").select(F.col("schema").alias("new"), "field", F.col("ref").alias("new_ref")), "pair-new")
    front = materialize(seeds.groupBy("old").agg(F.min("new").alias("new")).withColumn("depth", F.lit(0)), "pairs")
    parts = [front]
    for d in count(1):
        step = front.join(o, front["old"] == o["schema"]).join(n, ["new", "field"]).groupBy("ref").agg(F.min("new_ref").alias("new")).select(F.col("ref").alias("old"), "new", F.lit(d).alias("depth"))
        front = materialize(step.join(_merged(parts).select("old"), "old", "left_anti"), f"pairs-{d}")
        if front.isEmpty():
            return _merged(parts)
        parts.append(front)
        if len(parts) > 8:
            parts = [materialize(_merged(parts), f"paired-{d}")]


def infer_names(*sources: DataFrame) -> DataFrame:
    """(old, new) tables in order of precedence: one new name for each old one."""
    out = None
    for i, s in enumerate(sources):
        s = s.select("old", "new", F.lit(i).alias("priority"))
        out = s if out is None else out.union(s)
    return out.groupBy("old").agg(F.min_by("new", F.struct("priority", "new")).alias("new"), F.min("priority").alias("priority"))


def shortest_unique_names(seeds: DataFrame, reserved: DataFrame) -> DataFrame:
    """(id, parts) -> the shortest unique suffix of the parts that is not reserved; for the rest, in the order of
    ids, the full name with the first number that makes it one that nobody has."""
    left = materialize(seeds.select("id", "parts"), "names")
    most = left.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    taken = reserved.select("name").distinct()
    done = left.select("id", F.lit("").alias("name")).where("false")
    for depth in range(1, most + 1):
        named = left.withColumn("name", upper_camel(F.array_join(F.slice("parts", F.greatest(F.size("parts") - depth + 1, F.lit(1)), depth), " ")))
        one = named.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").join(taken, "name", "left_anti").select("id", "name")
        one = materialize(one, f"names-{depth}")
        done, taken = done.union(one), taken.union(one.select("name"))
        left = materialize(left.join(one, "id", "left_anti"), f"left-{depth}")
    left = left.select("id", upper_camel(F.array_join("parts", " ")).alias("full"))
    while not left.isEmpty():
        want = left.groupBy("full").agg(F.count("*").alias("n"))
        # A name that is taken may be any of its starts with the digits that follow.
        digits = F.length(F.regexp_extract("name", "([0-9]*)$", 1))
        used = taken.withColumn("k", F.explode(F.when(digits > 0, F.sequence(F.lit(1), digits)).otherwise(F.array().cast("array<int>"))))
        used = used.select(F.expr("left(name, length(name) - k)").alias("full"), F.expr("right(name, k)").alias("text")).where("text not like '0%' and length(text) < 19").select("full", F.col("text").cast("long").alias("number")).distinct()
        used = materialize(used.join(want.select("full"), "full", "left_semi"), "used-numbers")
        free = want.join(used.groupBy("full").agg(F.count("*").alias("u")).hint("shuffle_merge"), "full", "left").select("full", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("u", F.lit(0)))).alias("number"))
        free = free.join(used.hint("shuffle_merge"), ["full", "number"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("full").orderBy("number")))
        ranked = left.withColumn("r", F.row_number().over(Window.partitionBy("full").orderBy("id")))
        named = ranked.join(free.hint("shuffle_merge"), ["full", "r"]).select("id", "full", F.concat("full", F.col("number").cast("string")).alias("name"))
        # `AB1` and 2, `AB` and 12 are one name: the lesser id keeps it, the others try again.
        named = materialize(named.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("id"))), "numbered")
        kept = named.where("_r = 1").select("id", "name")
        done, taken = done.union(kept), taken.union(kept.select("name"))
        left = named.where("_r > 1").select("id", "full")
    return done


def operation_aliases(reach: DataFrame, patches: DataFrame, names: DataFrame) -> DataFrame:
    """For operations with a closed patch, an alias of every schema they reach that no base name has."""
    closed = patches.where("status = 'closed'").select(F.col("operation").alias("root")).distinct()
    seeds = reach.join(closed, "root", "left_semi").select(F.concat_ws("|", "root", "node").alias("id"), F.array("root", "node").alias("parts"))
    return shortest_unique_names(seeds, names)


def root_schema(tokens: DataFrame, types: DataFrame, wrappers: list[str]) -> DataFrame:
    """(owner, depth, pos, name) tokens: the outermost resolvable class that is no wrapper or enum; last argument
    first."""
    hit = tokens.where(~F.col("name").isin(wrappers)).join(types.where("kind <> 'enum'").select(F.col("simple").alias("name"), "id").hint("shuffle_merge"), "name")
    return hit.groupBy("owner").agg(F.min_by("id", F.struct("depth", -F.col("pos"))).alias("schema"))


def type_tokens(df: DataFrame, key: str, sig: Column, wrappers: list[str] | None = None) -> DataFrame:
    """tokens of a type signature with nesting depth, position and array depth (`[]` and `...` after a name or after
    its closing bracket). Wrappers with one argument around all are taken off, however many."""
    for_wrapper = "|".join(wrappers or [])
    text = F.regexp_replace(F.regexp_replace(sig, r"\?\s*(?:extends|super)\s+|\?", ""), r"\s+", "")
    if for_wrapper:
        text = F.aggregate(F.sequence(F.lit(1), F.lit(32)), text, lambda acc, _: F.when(split_top_level_size(F.regexp_extract(acc, rf"^(?:[\w.$:]*[.:])?(?:{for_wrapper})<(.*)>$", 1)) == 1, F.regexp_extract(acc, rf"^(?:[\w.$:]*[.:])?(?:{for_wrapper})<(.*)>$", 1)).otherwise(acc))
    t = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"[\w$:]+(?:\.[\w$:]+)*|\[\]|\.\.\.|[<>,]"), F.lit(0))).alias("at", "token"))
    w = Window.partitionBy(key).orderBy("at")
    t = t.withColumn("depth", F.sum(F.when(F.col("token") == "<", 1).when(F.col("token") == ">", -1).otherwise(0)).over(w))
    t = t.withColumn("_name", F.col("token").rlike(r"^[\w$:]")).withColumn("_array", F.col("token").isin("[]", "..."))
    # An array mark belongs to the last name before it at its own depth.
    at_depth = Window.partitionBy(key, "depth").orderBy("at")
    t = t.withColumn("_owner", F.last(F.when(F.col("_name"), F.col("at")), ignorenulls=True).over(at_depth.rowsBetween(Window.unboundedPreceding, 0)))
    marks = t.withColumn("array_depth", F.count_if("_array").over(Window.partitionBy(key, "_owner", "depth")).cast("int"))
    return marks.where("_name").select(key, F.row_number().over(w).alias("pos"), F.col("token").alias("name"), "depth", "array_depth")


def split_top_level(c: Column) -> Column:
    """Parts of a text between commas outside brackets: one pass over its brackets, commas and what lies between, that
    carries the depth, the place and the commas at depth 0."""
    tokens = F.regexp_extract_all(c, F.lit(r"[<(\[]|[>)\]]|,|[^<>()\[\],]+"), F.lit(0))
    state = lambda depth, at, cuts: F.struct(depth.alias("depth"), at.alias("at"), cuts.alias("cuts"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.isin("<", "(", "["), 1).when(t.isin(">", ")", "]"), -1).otherwise(0)
        cuts = F.when((t == ",") & (acc["depth"] <= 0), F.array_append(acc["cuts"], acc["at"])).otherwise(acc["cuts"])
        return state(depth, acc["at"] + F.length(t), cuts)

    def parts(acc: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), acc["cuts"], F.array(F.length(c)))
        return F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda x, i: F.trim(F.substring(c, x + 2, F.get(bounds, i + 1) - x - 1)))

    return F.aggregate(tokens, state(F.lit(0), F.lit(0), F.array().cast("array<int>")), step, parts)


def split_top_level_size(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(split_top_level(c)))


def parameter_types(signature: Column) -> Column:
    """the types of a method signature's parameters: what stands before the last space of each part between the
    brackets; parts without a space are left out."""
    inner = F.regexp_extract(signature, r"^[^(]*\((.*)\)", 1)
    typed = F.filter(split_top_level(inner), lambda p: p.rlike(r"\S\s+\S"))
    return F.transform(typed, lambda p: F.regexp_replace(p, r"\s+\S+$", ""))


def generate_rows(operations: DataFrame, schema: DataFrame, links: DataFrame, n: int, seed: int, max_depth: int = 32) -> DataFrame:
    """M1: (operation, row, document): n seeded samples of each operation's schema (operation, node), each one JSON text.

    schema has (node, type, format, fixed, options, ref): the JSON of an example, default or constant; the JSON texts of
    an enum; the node that a reference names. links has (node, kind, name, position, child) with kinds property, items
    and allOf. Precedence: fixed, enum, ref, allOf, type (object where properties exist and none is said, else string).
    Arrays have two items (texts where no item is said); below max_depth, and for a reference that is already on the
    path, the value is null; objects without properties are empty; allOf is one object of its parts' properties, later
    parts over earlier ones, without the parts that are no objects. Values hang on (seed, operation, row, path) alone, so
    they are the same however the job is split.

    Schemas are laid out level by level, and the values folded upwards the same way: each level joins what its children
    came to, so no task sees more than one value and its parts."""
    has = links.groupBy("node").agg(F.max(F.col("kind") == "allOf").alias("merged"), F.max(F.col("kind") == "property").alias("props"), F.max(F.col("kind") == "items").alias("listed"))
    off = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    s = schema.join(has.hint("shuffle_merge"), "node", "left").select("node", "format", "fixed", "options", "ref", off("merged"), off("listed"), F.coalesce("type", F.when(off("props"), "object").otherwise("string")).alias("type"))
    s = materialize(s, "sample-schema")
    part = ["operation", "row", "id", "parent", "name", "position"]
    front = operations.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("operation", "row", F.lit("").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("position"), F.lit("").alias("path"), "node", F.array().cast("array<string>").alias("refs"))
    of = materialize(links.select("node", "kind", F.col("name").alias("name_"), F.col("position").cast("int").alias("position_"), "child"), "sample-links")
    known = s.withColumnRenamed("node", "_at").withColumn("_in", F.lit(True))
    levels = []
    for depth in range(max_depth + 2):
        if depth > max_depth:
            j = front.withColumns({"rule": F.lit("null"), "type": F.lit("null"), "format": F.lit(None).cast("string"), "fixed": F.lit(None).cast("string"), "options": F.array().cast("array<string>"), "ref": F.lit(None).cast("string"), "listed": F.lit(False)})
        else:
            rule = (
                F.when(F.col("node").isNull(), "leaf").when(F.col("fixed").isNotNull(), "fixed").when(F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0, "enum")
                .when(F.col("ref").isNotNull(), F.when(F.array_contains("refs", F.col("ref")), "null").otherwise("ref")).when(F.col("merged"), "allOf")
                .when(F.col("type").isin("object", "array"), F.col("type")).otherwise("leaf")
            )
            # Values without a node find none, but meet the join by a key of their own each.
            lone = F.concat_ws("\0", F.lit(""), "operation", F.col("row").cast("string"), "id")
            j = front.withColumn("_key", F.coalesce("node", lone)).join(known.hint("shuffle_merge"), F.col("_key") == F.col("_at"), "left").where("node is null or _in")
            j = j.withColumns({"rule": rule, "type": F.when(F.col("node").isNull(), "string").otherwise(F.col("type"))}).drop("merged", "_key", "_at", "_in")
        j = materialize(j.withColumn("value", _sample(seed)), f"sample-{depth}")
        if depth and j.isEmpty():
            break
        levels.append(j.select(*part, "rule", "value"))
        below = F.concat_ws("/", "id", "position_")
        to_ref = j.where("rule = 'ref'").withColumn("position_", F.lit(0)).select("operation", "row", below.alias("id"), F.col("id").alias("parent"), F.lit(None).cast("string").alias("name"), "position_", "path", F.col("ref").alias("node"), F.array_append("refs", F.col("ref")).alias("refs"))
        down = j.where("rule in ('allOf', 'object')").select("operation", "row", "id", "path", "node", "refs", "rule").join(of, "node").where("rule = 'allOf' and kind = 'allOf' or rule = 'object' and kind = 'property'")
        inner = F.when(F.col("rule") == "object", F.concat_ws(".", F.nullif("path", F.lit("")), "name_")).otherwise(F.col("path"))
        down = down.select("operation", "row", below.alias("id"), F.col("id").alias("parent"), F.when(F.col("rule") == "object", F.col("name_")).alias("name"), "position_", inner.alias("path"), F.col("child").alias("node"), "refs")
        lists = j.where("rule = 'array'").join(of.where("kind = 'items'").select("node", "child"), "node", "left").withColumn("position_", F.explode(F.array(F.lit(0), F.lit(1))))
        lists = lists.select("operation", "row", below.alias("id"), F.col("id").alias("parent"), F.lit(None).cast("string").alias("name"), "position_", F.concat("path", F.lit("["), "position_", F.lit("]")).alias("path"), F.col("child").alias("node"), "refs")
        front = to_ref.union(down).union(lists).withColumnRenamed("position_", "position")
    values = None
    for depth, level in reversed(list(enumerate(levels))):
        values = materialize(_folded(level, values), f"sample-value-{depth}")
    return values.select("operation", "row", F.col("json").alias("document"))


def _sample(seed: int) -> Column:
    """The JSON of a value that has no parts below it."""
    h = F.pmod(F.xxhash64(F.lit(seed), "operation", "row", "path"), F.lit(1_000_000_007))
    text = F.to_json(F.array(semantic_value(F.regexp_replace("path", r"\[[0-9]\]", ""), F.col("format"), h)))
    made = (
        F.when(F.col("type") == "integer", (h % 100 + 1).cast("string")).when(F.col("type") == "number", (h % 1000 + 1).cast("string"))
        .when(F.col("type") == "boolean", (h % 2 == 0).cast("string")).when(F.col("type") == "null", "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))
    )
    return F.when(F.col("rule") == "fixed", F.col("fixed")).when(F.col("rule") == "enum", F.get("options", (h % F.size("options")).cast("int"))).when(F.col("rule") == "leaf", made).otherwise("null")


ENTRIES = "array<struct<name:string,json:string>>"


def _folded(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """(operation, row, parent, name, position, json, entries): the values of a level, with the properties of those that
    are objects, from the values of the level below."""
    none = F.lit(None).cast(ENTRIES)
    none_below = F.lit(None).cast(f"array<struct<position:int,name:string,json:string,entries:{ENTRIES}>>").alias("parts")
    if below is None:
        level = level.select("*", none_below)
    else:
        parts = below.groupBy("operation", "row", F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "name", "json", "entries"))).alias("parts"))
        # Only what may have parts is sent to meet them.
        whole = F.col("rule").isin("object", "allOf", "ref", "array")
        met = level.where(whole).join(parts.hint("shuffle_merge"), ["operation", "row", "id"], "left")
        level = met.unionByName(level.where(~whole).select("*", none_below))
    parts = F.coalesce("parts", F.array().cast(f"array<struct<position:int,name:string,json:string,entries:{ENTRIES}>>"))
    own = F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["json"].alias("json")))
    merged = F.aggregate(F.transform(parts, lambda p: p["entries"]), F.array().cast(ENTRIES), lambda acc, more: F.when(more.isNull(), acc).otherwise(F.concat(F.filter(acc, lambda a: ~F.exists(more, lambda m: m["name"] == a["name"])), more)))
    given = F.from_json(F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")), "map<string,variant>")
    written = F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("json")))
    entries = F.when(F.col("rule") == "object", own).when(F.col("rule") == "allOf", merged).when(F.col("rule") == "ref", F.get(parts, F.lit(0))["entries"]).when(F.col("rule").isin("fixed", "enum"), written).otherwise(none)
    level = level.withColumn("entries", F.array_sort(entries.cast(ENTRIES)))
    braces = F.expr("concat('{', array_join(transform(entries, e -> concat(substring(to_json(array(e.name)), 2, length(to_json(array(e.name))) - 2), ':', e.json)), ','), '}')")
    brackets = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["json"]), ","), F.lit("]"))
    json = F.when(F.col("rule").isin("object", "allOf"), braces).when(F.col("rule") == "array", brackets).when(F.col("rule") == "ref", F.get(parts, F.lit(0))["json"]).otherwise(F.col("value"))
    return level.select("operation", "row", "parent", "name", "position", json.alias("json"), "entries")
