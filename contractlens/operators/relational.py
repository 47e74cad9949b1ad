"""Joins, aggregates, windows, limits and set operations over contract tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlens.sources.scratch import materialize

BROADCAST_ROWS = 100_000  # a side is broadcast only if it is counted to hold no more


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small; without one otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# --- windows ---------------------------------------------------------------------------------------------------------
def unique_or_null(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key, only if no other row ties with it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.rank().over(w)).where("_r = 1").withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n = 1").drop("_r", "_n")


def label_spans(matches: DataFrame, doc: str, start: str, end: str, text: str) -> DataFrame:
    """label = text between this match's end and the next match's start."""
    nxt = F.lead(start).over(Window.partitionBy(doc).orderBy(start))
    return matches.withColumn("label", F.substring(F.col(text), F.col(end) + 1, F.coalesce(nxt, F.length(text)) - F.col(end)))


def consecutive_only(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """The rows of keys whose ordinals rise by exactly one."""
    step = F.col(ord_col) - F.lag(ord_col).over(Window.partitionBy(key).orderBy(ord_col))
    df = df.withColumn("_ok", F.coalesce(step == 1, F.lit(True)))
    return df.withColumn("_all", F.bool_and("_ok").over(Window.partitionBy(key))).where("_all").drop("_ok", "_all")


def dedupe(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def strip_blocks(lines: DataFrame, doc: str, pos: str, line: str, opener: str, closer: str) -> DataFrame:
    """Lines outside marked blocks. An opener is removed with its block only if its close comes before the next
    opener."""
    after = Window.partitionBy(doc).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    df = lines.withColumn("_o", F.col(line).rlike(opener)).withColumn("_c", F.col(line).rlike(closer))
    df = df.withColumn("_nc", F.min(F.when(F.col("_c"), F.col(pos))).over(after)).withColumn("_no", F.min(F.when(F.col("_o"), F.col(pos))).over(after))
    df = df.withColumn("_until", F.when(F.col("_o") & F.col("_nc").isNotNull() & (F.col("_no").isNull() | (F.col("_nc") < F.col("_no"))), F.col("_nc")))
    df = df.withColumn("_in", F.max("_until").over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    return df.where(F.col("_in").isNull() | (F.col(pos) > F.col("_in"))).drop("_o", "_c", "_nc", "_no", "_until", "_in")


# --- joins -----------------------------------------------------------------------------------------------------------
def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def contained(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Children of a kind of each parent, numbered by line, column and name (then id)."""
    at = [F.coalesce(F.col(n), F.lit(0)).alias(n) if n in nodes.columns else F.lit(0).alias(n) for n in ("start_line", "start_column")]
    kids = edges.where("kind = 'contains'").join(nodes.where(F.col("kind") == kind).select(F.col("id").alias("target"), "name", *at), "target")
    order = Window.partitionBy("source").orderBy("start_line", "start_column", "name", "target")
    return kids.select(F.col("source").alias("parent"), F.col("target").alias("child"), "name", F.row_number().over(order).alias("position"))


def resolve_names(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Refs (ref_id, name, file, scope, package), types (id, fqn, simple), imports (file, fqn): the type of the
    first tier that has one. Tiers: exact, import, enclosing scopes from the innermost, package, a simple name that is
    unique everywhere."""
    scopes = F.split("scope", r"\.")
    steps = F.transform(F.sequence(F.lit(0), F.size(scopes) - 1), lambda i: F.concat(F.array_join(F.slice(scopes, 1, F.size(scopes) - i), "."), F.lit("."), F.col("name")))
    c = refs.select("ref_id", "name", F.col("name").alias("fqn"), F.lit(1).alias("tier"), F.lit(0).alias("pos"))
    c = c.union(refs.join(imports.withColumnRenamed("fqn", "imported"), "file").where(F.col("imported").endswith(F.concat(F.lit("."), F.col("name")))).select("ref_id", "name", "imported", F.lit(2), F.lit(0)))
    c = c.union(refs.where("scope <> ''").select("ref_id", "name", F.posexplode(steps)).select("ref_id", "name", "col", F.lit(3), "pos"))
    c = c.union(refs.select("ref_id", "name", F.concat("package", F.lit("."), "name"), F.lit(4), F.lit(0)))
    hits = c.join(types.select("id", "fqn").hint("shuffle_merge"), "fqn").select("ref_id", "id", "tier", "pos")
    only = types.groupBy("simple").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    hits = hits.union(refs.join(only, refs["name"] == only["simple"]).select("ref_id", "id", F.lit(5), F.lit(0)))
    best = hits.groupBy("ref_id").agg(F.min_by("id", F.struct("tier", "pos", "id")).alias("type_id"))
    return refs.join(best.hint("shuffle_merge"), "ref_id", "left")


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls (call_id, owner, name, arity) to methods (id, owner, name, arity): a single candidate or none; an
    unknown arity fits any."""
    m = methods.select(F.col("id").alias("method_id"), "owner", "name", F.col("arity").alias("takes"))
    hit = calls.join(m, ["owner", "name"]).where("arity is null or takes is null or arity = takes")
    one = hit.groupBy("call_id").agg(F.count("*").alias("n"), F.min("method_id").alias("method_id")).where("n = 1").select("call_id", "method_id")
    return calls.join(one, "call_id", "left")


def resolve_receivers(calls: DataFrame, parameters: DataFrame, fields: DataFrame, variables: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """The owner of each call (call_id, file, class_id, scope, package, method, receiver, name, arity, exact, at):
    its own class without a receiver or for `this` and `super`; else the type that the receiver names if it is
    capitalised, or that a parameter (method, name, type), a field (class_id, name, type) or the last variable
    (file, name, at, type) declared before it has. A receiver with brackets has no owner. Without `exact` the number of
    arguments says nothing."""
    r = F.regexp_replace("receiver", r"^this\.", "")
    c = calls.withColumn("_r", r).withColumn("_own", F.col("receiver").isNull() | F.col("_r").isin("this", "super"))
    c = c.withColumn("_free", ~F.col("_own") & ~F.col("_r").rlike("[()]"))
    first = lambda df, on, n: df.groupBy(*on).agg(F.min("type").alias(n)).withColumnRenamed("name", "_r")
    c = c.join(first(parameters, ["method", "name"], "_param"), ["method", "_r"], "left").join(first(fields, ["class_id", "name"], "_field"), ["class_id", "_r"], "left")
    c = as_of(c, variables.select("file", F.col("name").alias("_r"), F.col("at").alias("_site"), F.col("type").alias("_declared")), ["file", "_r"], "at", "_site", "_declared")
    named = F.when(F.col("_r").rlike("^[A-Z]"), F.col("_r")).otherwise(F.coalesce("_param", "_field", "last__declared"))
    c = c.withColumn("_type", F.when(F.col("_free"), F.regexp_extract(named, r"^[\w.$]+", 0)))
    refs = c.where("_type <> ''").select(F.col("call_id").alias("ref_id"), F.col("_type").alias("name"), "file", "scope", "package")
    found = resolve_names(refs, types, imports).select(F.col("ref_id").alias("call_id"), "type_id")
    c = c.join(found, "call_id", "left").withColumn("owner", F.when(F.col("_own"), F.col("class_id")).otherwise(F.col("type_id")))
    return c.select(*[x for x in calls.columns if x not in ("arity", "owner")], F.when(F.col("exact"), F.col("arity")).alias("arity"), "owner")


def apply_routes(operations: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """Operations with the last route of their keys by ordinal; others stay placeholders."""
    last = dedupe(routes.where("path is not null"), keys, [F.desc("ordinal")]).drop("ordinal")
    return operations.join(last, keys, "left").withColumn("route_status", F.when(F.col("path").isNull(), "placeholder").otherwise("resolved"))


def diff_snapshots(old: DataFrame, new: DataFrame, key: str, loc: str, name: str) -> DataFrame:
    """What became of each old key; keys that only the new side has are not reported."""
    n = new.select(key, F.col(loc).alias("_loc"), F.col(name).alias("_name"), F.lit(True).alias("_there"))
    moved, renamed = ~F.col(loc).eqNullSafe(F.col("_loc")), ~F.col(name).eqNullSafe(F.col("_name"))
    change = F.when(F.col("_there").isNull(), "removed").when(moved & renamed, "moved-and-renamed").when(moved, "moved").when(renamed, "renamed").otherwise("unchanged")
    return old.join(n, key, "left").select(old[key], change.alias("change"), F.col("_loc").alias("new_location"), F.col("_name").alias("new_name"))


def replace_symbols(old: DataFrame, new: DataFrame, inferred: DataFrame) -> DataFrame:
    """Each old (symbol, location) with the new one (symbol, location): under its own name if that is still there, else
    under the inferred one (symbol, new_symbol). A name of exactly one new location is unchanged, moved, renamed or
    moved-and-renamed, any other removed."""
    at = new.groupBy("symbol").agg(F.count("*").alias("n"), F.min("location").alias("to"))
    named = lambda s, n, to: at.withColumnsRenamed({"symbol": s, "n": n, "to": to})
    j = old.distinct().join(named("symbol", "n1", "l1"), "symbol", "left").join(inferred.groupBy("symbol").agg(F.min("new_symbol").alias("new_symbol")), "symbol", "left").join(named("new_symbol", "n2", "l2"), "new_symbol", "left")
    own = F.col("n1").isNotNull()
    ok = F.coalesce(F.when(own, F.col("n1")).otherwise(F.col("n2")) == 1, F.lit(False))
    name, to = F.when(own, F.col("symbol")).otherwise(F.col("new_symbol")), F.when(own, F.col("l1")).otherwise(F.col("l2"))
    moved, renamed = to != F.col("location"), name != F.col("symbol")
    status = F.when(~ok, "removed").when(moved & renamed, "moved-and-renamed").when(moved, "moved").when(renamed, "renamed").otherwise("unchanged")
    return j.select("symbol", F.col("location").alias("old_location"), F.when(ok, name).alias("new_symbol"), F.when(ok, to).alias("new_location"), status.alias("status"))


STOP_WORDS = ["type", "code", "status", "enum", "request", "response", "req", "resp"]  # fixed values


def name_words(c: Column) -> Column:
    """Distinct lower-case words of a name, split before capitals; one-letter and stop words dropped."""
    ws = F.transform(F.split(F.regexp_replace(c, "([A-Z])", " $1"), "[^A-Za-z0-9]+"), lambda w: F.lower(w))
    return F.array_distinct(F.filter(ws, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def match_by_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, name, value_set) on both sides: the new row that shares most words, if it is the only best one. Ranked
    by (same value set, shared words); one shared word is enough with the same set, else two are needed.

    Names of the same set and words are one class, whose size tells whether it can be the only best one. Classes that
    share two words meet under a word, each side without its most frequent one: of two shared words one is not it. Names
    of one set that share a single word are never paired: for each (set, word) the new names are counted, and a name for
    which these counts come to one has found the only one. So a word that very many names share brings nobody together."""
    side = lambda df, c: df.select("id", F.struct("value_set", F.array_sort(name_words(F.col("name"))).alias("words")).alias(c))
    named = side(old, "old_c").withColumnRenamed("id", "old_id")
    o = named.select("old_c").distinct()
    n = side(new, "new_c").groupBy("new_c").agg(F.count("*").alias("copies"), F.min("id").alias("new_id"))
    spread = lambda df, c: df.select("*", F.explode(f"{c}.words").alias("word"))
    often = spread(o, "old_c").select("word").union(spread(n, "new_c").select("word")).groupBy("word").agg(F.count("*").alias("uses"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        ranked = spread(df, c).join(often.hint("shuffle_merge"), "word")
        w = Window.partitionBy(c).orderBy(F.desc("uses"), F.desc("word"))
        return ranked.withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r", "uses")

    same = F.col("old_c.value_set").eqNullSafe(F.col("new_c.value_set"))
    met = rare(o, "old_c").join(rare(n, "new_c").hint("shuffle_merge"), "word").drop("word").distinct()
    pairs = met.select("old_c", "new_id", "copies", F.size(F.array_intersect("old_c.words", "new_c.words")).cast("long").alias("shared"), same.alias("same")).where("shared >= 2")
    uses = spread(n, "new_c").groupBy(F.col("new_c.value_set").alias("set"), "word").agg(F.sum("copies").alias("copies"), F.min("new_id").alias("new_id"))
    single = spread(o, "old_c").join(uses.withColumnRenamed("word", "w").hint("shuffle_merge"), F.col("old_c.value_set").eqNullSafe(F.col("set")) & (F.col("word") == F.col("w")))
    single = single.groupBy("old_c").agg(F.min("new_id").alias("new_id"), F.sum("copies").alias("copies")).select("*", F.lit(1).cast("long").alias("shared"), F.lit(True).alias("same"))
    best = unique_or_null(pairs.unionByName(single), ["old_c"], [F.desc("same"), F.desc("shared")]).where("copies = 1")
    return named.join(best.hint("shuffle_merge"), "old_c").select("old_id", "new_id", "shared", "same")


KEY_BUCKETS, HOT_ROWS = 65_536, 1 << 18  # hashes by which rows of a key are counted; rows that one task sorts without a thought


def _beside(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, value: Column, strict: bool = False) -> DataFrame:
    """_row (a left row), and the structs (p, v) of the last right row at or before it (before it if strict) and of the
    first one at or after it, of the same keys. Of right rows at one position the least value counts.

    Keys are sent whole to a task, once, and sorted there. Those of very many rows, found by counting hashes, are dealt by
    ranges instead (`_beside_ranges`)."""
    keys, rest = [f"_k{i}" for i in range(len(on))], [c for c in left.columns if c not in (*on, left_pos)]
    r = right.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(right_pos).alias("_p"), value.alias("_v")).dropna(subset=[*keys, "_p"])
    lefts = left.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(left_pos).alias("_p"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(rest)])
    sides = (0, 1) if strict else (1, 0)
    both = lefts.withColumn("_side", F.lit(sides[0])).unionByName(r.withColumn("_side", F.lit(sides[1])), allowMissingColumns=True)
    both = materialize(both, "beside")
    is_left, bucket = F.col("_side") == sides[0], F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    counts = both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("mean", F.sum("n").over(Window.partitionBy(F.lit(0))) / KEY_BUCKETS)
    hot = [x["bucket"] for x in counts.where(F.col("n") > F.greatest(F.lit(HOT_ROWS), F.col("mean") * 8)).collect()]
    hit = F.when(~is_left, F.struct(F.col("_p").alias("p"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.where(~bucket.isin(hot)) if hot else both
    near = near.withColumn("_before", F.last(hit, ignorenulls=True).over(w.orderBy("_p", "_side", F.desc("_v")))).withColumn("_after", F.last(hit, ignorenulls=True).over(w.orderBy(F.desc("_p"), F.desc("_side") if strict else "_side", F.desc("_v"))))
    near = near.where(is_left).drop("_side", "_v")
    if hot:
        near = near.unionByName(_beside_ranges(both.where(bucket.isin(hot)), keys, sides, strict))
    types = {f.name: f.dataType for f in left.schema}
    named = dict(zip(on, keys, strict=True)) | {left_pos: "_p"} | {c: f"_x{i}" for i, c in enumerate(rest)}
    return near.select(F.struct(*[F.col(named[c]).cast(types[c]).alias(c) for c in left.columns]).alias("_row"), "_before", "_after")


def _beside_ranges(both: DataFrame, keys: list[str], sides: tuple[int, int], strict: bool) -> DataFrame:
    """Rows are dealt by ranges of (keys, position), so a key of very many rows lies in several buckets. Each bucket finds
    its neighbours by itself; what it lacks at its ends comes from the nearest bucket of the key that has a right row,
    and for that only one row for each key and bucket is passed on."""
    is_left = F.col("_side") == sides[0]
    r = both.where(~is_left).groupBy(*keys, "_p", "_side").agg(F.min("_v").alias("_v"))
    both = both.where(is_left).unionByName(r, allowMissingColumns=True).withColumn("_n", F.monotonically_increasing_id())
    hit = F.when(~is_left, F.struct(F.col("_p").alias("p"), F.col("_v").alias("v")))
    both = materialize(both.withColumn("_hit", hit).repartitionByRange(*keys, "_p", "_side", "_n").withColumn("_part", F.spark_partition_id()), "beside-ranges")
    within = Window.partitionBy(*keys, "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_before", F.last("_hit", ignorenulls=True).over(within.orderBy("_p", "_side"))).withColumn("_after", F.last("_hit", ignorenulls=True).over(within.orderBy(F.desc("_p"), F.desc("_side") if strict else "_side")))
    ends = both.where(~is_left).groupBy(*keys, "_part").agg(F.max("_hit").alias("last"), F.min("_hit").alias("first"))
    # Every bucket of the key asks, those without a right row too.
    ends = both.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    others = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_up", F.last("last", ignorenulls=True).over(others.orderBy("_part"))).withColumn("_down", F.last("first", ignorenulls=True).over(others.orderBy(F.desc("_part"))))
    out = near.where(is_left).join(ends.select(*keys, "_part", "_up", "_down").hint("shuffle_merge"), [*keys, "_part"], "left")
    return out.withColumn("_before", F.coalesce("_before", "_up")).withColumn("_after", F.coalesce("_after", "_down")).drop("_n", "_hit", "_part", "_up", "_down", "_side", "_v")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, right_id: str) -> DataFrame:
    """Each left row with the id of the closest right row of the same keys; the earlier one on ties, the lesser id at
    one position. Left rows without one have a null, those with a null key or position too; repeated rows stay."""
    near = _beside(left, right, on, left_pos, right_pos, F.col(right_id))
    at = F.col(f"_row.{left_pos}")
    pick = F.when(F.col("_after").isNull() | (at - F.col("_before.p") <= F.col("_after.p") - at), F.col("_before.v")).otherwise(F.col("_after.v"))
    return near.select("_row.*", F.when(at.isNotNull(), pick).alias("nearest_id"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_pos: str, right_pos: str, value: str) -> DataFrame:
    """J9 backward: each left row with the value of the last right row before it, the least value at one position; null
    without one. Repeated left rows stay."""
    near = _beside(left, right, on, left_pos, right_pos, F.col(value), strict=True)
    return near.select("_row.*", F.when(F.col(f"_row.{left_pos}").isNotNull(), F.col("_before.v")).alias(f"last_{value}"))


def gaps(observed: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Observed sites that are not known."""
    return observed.join(known, on, "left_anti")


def dangling_refs(refs: DataFrame, defs: DataFrame, ref: str, definition: str) -> DataFrame:
    """Distinct references without a definition."""
    d = defs.select(F.col(definition).alias(ref)).distinct()
    return refs.select(ref).distinct().join(d.hint("shuffle_merge"), ref, "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, bulk_error: str | None = None) -> DataFrame:
    """(name, version) expected and found, with status and detail. An error of the listing as a whole says why
    names are missing, and only that."""
    a = actual.select("name", F.col("version").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("version"), "installed").otherwise("version-mismatch")
    detail = F.when(F.col("found").isNull(), F.lit(bulk_error or "missing from the listing")).when(F.col("found") != F.col("version"), F.concat(F.lit("expected "), "version", F.lit(", got "), "found"))
    return expected.join(a, "name", "left").withColumn("status", status).withColumn("detail", detail)


def changed_keys(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose fingerprint (exists, hash) is not the one before."""
    a = after.select(*key, F.struct("exists", "hash").alias("_a"))
    return before.join(a, key, "left").where(~F.struct("exists", "hash").eqNullSafe(F.col("_a"))).select(*key)


def map_members(old: DataFrame, new: DataFrame, inferred: DataFrame) -> DataFrame:
    """Old and new (target, wire, member) with inferred (target, new_target): members of one wire value; targets
    named alike come first, one row for each (target, wire)."""
    pairs = old.select("target").distinct().withColumn("new_target", F.col("target")).withColumn("prio", F.lit(0)).unionByName(inferred.withColumn("prio", F.lit(1)))
    j = old.join(pairs, "target").join(new.select(F.col("target").alias("new_target"), "wire", F.col("member").alias("new_member")), ["new_target", "wire"])
    return dedupe(j, ["target", "wire"], [F.col("prio"), F.col("new_target"), F.col("new_member")]).drop("prio")


# What calls a tool directly, what only may lead to it, and what makes a line worth a look at all.
DIRECT = {"nvm": ["nvm use", "nvm exec", "nvm.sh"], "fnm": ["fnm env", "fnm use", "fnm exec"]}
DYNAMIC = {"nvm": ["NVM_DIR", ".nvm"], "fnm": ["FNM_DIR", ".fnm", "fnm_multishells", "FNM_MULTISHELL_PATH"], "pnpm": ["PNPM_HOME"]}
MARKERS = [".nvm", ".fnm", "fnm_multishells", "FNM_MULTISHELL_PATH", "nvm use", "nvm exec", "fnm env", "fnm use", "fnm exec"]
TOOL_PATHS = ["/node", "/npm", "/npx", "/pnpm", "/pnpx"]
ROOTS = 200_000  # roots of one automaton, about
HELD, HELD_BYTES = 500_000, 64 << 20  # lines, and bytes of them, that one task holds for its automata in turn


def impact_scan(lines: DataFrame, roots: DataFrame, tools: tuple[str, ...] = ("nvm", "fnm", "pnpm"), candidates: bool = False, home: str = "/home/user") -> DataFrame:
    """Lines (doc_id, pos, line) and roots (ordinal, root): the first root that a line names makes it affected,
    then direct commands of the tools; their dynamic variables leave it uncertain. Comments and the rest are unaffected.
    With `candidates` only lines that may speak of a tool are judged, the others are left out.

    Any number of roots is looked for in one pass over the lines, by an automaton that each task builds of the roots it
    was sent. Beyond ROOTS there is more than one automaton; a task holds one of them at a time, and HELD lines. Lines are
    never shuffled."""
    t = F.trim("line")
    has = lambda parts: F.coalesce(*[F.when(F.contains(t, F.lit(p)), True) for p in parts], F.lit(False)) if parts else F.lit(False)
    pick = lambda table: [p for tool in tools for p in table.get(tool, [])]
    if candidates:
        lines = lines.where(has(MARKERS) | has(TOOL_PATHS))
    full = F.replace(F.replace(F.replace(t, F.lit("${HOME}"), F.lit(home)), F.lit("$HOME"), F.lit(home)), F.lit("~"), F.lit(home))
    note = F.startswith(t, F.lit("#"))
    df = lines.select("doc_id", "pos", F.when(note, None).otherwise(full).alias("_t"), note.alias("_note"), has(pick(DIRECT)).alias("_direct"), has(pick(DYNAMIC)).alias("_dynamic"), F.left(t, F.lit(240)).alias("excerpt"))
    df = first_roots(df, "_t", roots)
    impact = F.when(F.col("_note"), "unaffected").when(F.col("root").isNotNull() | F.col("_direct"), "affected").when(F.col("_dynamic"), "uncertain").otherwise("unaffected")
    return df.select("doc_id", "pos", impact.alias("impact"), "root", "excerpt")


def first_roots(df: DataFrame, text: str, roots: DataFrame) -> DataFrame:
    """df with `root`: of the roots (ordinal, root) that a text contains, the first by ordinal, then by name. Roots are
    packed in groups by tasks and sent compressed; one Python pass takes the groups one after another."""
    known = roots.where("root is not null and root <> ''").groupBy("root").agg(F.min("ordinal").cast("long").alias("ordinal"))
    known = materialize(known, "scan-roots")
    groups = max(1, -(-known.count() // ROOTS))
    dealt = known.withColumn("_g", F.pmod(F.xxhash64("root"), F.lit(groups)))
    packs = dealt.groupBy("_g").applyInArrow(_packed, "pack binary")
    sent = df.sparkSession.sparkContext.broadcast([bytes(r["pack"]) for r in packs.toLocalIterator()])
    return df.mapInArrow(partial(_scan, text=text, sent=sent), T.StructType([*df.schema, T.StructField("root", T.StringType())]))


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.select(["root", "ordinal"]).sort_by("root").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return pa.table({"pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _scan(batches: Iterator[pa.RecordBatch], text: str, sent) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    def automaton(pack: bytes):
        rows = pa.ipc.open_stream(pack).read_all()
        found = ahocorasick.Automaton()
        for root, ordinal in zip(rows["root"].to_pylist(), rows["ordinal"].to_pylist(), strict=True):
            found.add_word(root, (ordinal, root))
        found.make_automaton()
        return found

    def judged(held: list[pa.RecordBatch], one) -> Iterator[pa.RecordBatch]:
        first = [[None] * b.num_rows for b in held]
        for pack in sent.value:
            found = one or automaton(pack)
            for best, b in zip(first, held, strict=True):
                for i, t in enumerate(b[text].to_pylist()):
                    at = min((at for _, at in found.iter(t)), default=None) if t else None
                    if at is not None and (best[i] is None or at < best[i]):
                        best[i] = at
            del found
        for best, b in zip(first, held, strict=True):
            yield b.append_column("root", pa.array([at and at[1] for at in best], pa.string()))

    one = automaton(sent.value[0]) if len(sent.value) == 1 else None
    held, rows, size = [], 0, 0
    for b in batches:
        held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if one or rows >= HELD or size >= HELD_BYTES:
            yield from judged(held, one)
            held, rows, size = [], 0, 0
    if held:
        yield from judged(held, one)


def plan_rewrites(imports: DataFrame, replacements: DataFrame) -> DataFrame:
    """Imports (file, statement, symbol, source), replacements (source, symbol, new_symbol, new_source): the names
    each statement has to take from each new source; removed ones as unresolved."""
    r = replacements.select("source", "symbol", "new_symbol", "new_source", F.lit(True).alias("_hit"))
    j = imports.join(r, ["source", "symbol"], "left")
    target = F.when(F.col("_hit").isNull(), F.col("source")).otherwise(F.coalesce("new_source", F.lit("<unresolved>")))
    name = F.when(F.col("_hit").isNull() | F.col("new_symbol").isNull() | (F.col("new_symbol") == F.col("symbol")), F.col("symbol")).otherwise(F.concat("new_symbol", F.lit(" as "), "symbol"))
    return j.groupBy("file", "statement", target.alias("target")).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))


# --- aggregates ------------------------------------------------------------------------------------------------------
def name_index(nodes: DataFrame) -> DataFrame:
    """A1: ids of each name in the order of qualified name and id."""
    return nodes.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("qualified_name", "id"))), lambda x: x["id"]).alias("ids"))


def latest_versions(packages: DataFrame, key: Column) -> DataFrame:
    """A2: highest version of each name (ties: last by provider), and all that provide the name."""
    return packages.groupBy("name").agg(F.max_by("version", F.struct(key, F.col("provider"), F.col("version"))).alias("version"), F.array_sort(F.collect_set("provider")).alias("providers"))


EVIDENCE, SHOWN = 20, 4  # pieces of evidence kept, unknowns told in the warning


def least_texts(rows: DataFrame, key: list[str], text: str, order: list[str], n: int) -> DataFrame:
    """(key, texts): the first n distinct texts of each key in an order, ties by text. Texts are made distinct by key and
    text, in as many tasks as there are; each keeps its first n of a key, and only those meet."""
    first = rows.groupBy(F.xxhash64(*key, text).alias("_g"), *key, text).agg(F.min(F.struct(*order)).alias("_o")).drop("_g") if order else rows.select(*key, text).distinct().withColumn("_o", F.lit(0))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_o", text))).where(F.col("_r") <= n)
    return kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("texts"))


def classify_domains(sites: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """A3: verdict of each target over its write sites (target, enum_fqn, accessor, complete, external, unknown,
    literals, transformed; values, evidence and position where known).

    (target, status, enum_fqn, accessor, values, unknowns, evidence, warning): enum, accessor and values are those of the
    first site that has an enum, values only where closed. Every site with another enum or accessor adds an unknown.
    The first EVIDENCE pieces of evidence in the order of sites, and the first SHOWN unknowns in their own order. Who has
    pieces of evidence apart from the sites gives them as proofs (target, position, at, text)."""
    none = F.array().cast("array<string>")
    for name, default in (("values", none), ("evidence", none), ("position", F.struct("enum_fqn", "accessor"))):
        if name not in sites.columns:
            sites = sites.withColumn(name, default)
    some = lambda c: F.size(c) > 0
    has = F.col("enum_fqn").isNotNull()
    pure = ~some("unknown") & ~some("literals") & ~F.col("transformed")
    named = F.struct("enum_fqn", "accessor")
    # A hash of the target is the key to sort by, which a target's parts, alike at their beginnings, are slow at.
    sites, key = sites.withColumn("_h", F.xxhash64("target")), ["_h", "target"]
    g = sites.groupBy(*key).agg(
        F.bool_and(has & F.col("complete") & ~some("external") & pure).alias("c"), F.bool_or(has).alias("k"), F.bool_and(some("external") & pure).alias("x"),
        F.min_by(F.when(has, F.struct("enum_fqn", "accessor", "values")), F.when(has, F.struct("position", "enum_fqn", "accessor"))).alias("f"), (F.min(named) == F.max(named)).alias("one"),
    )
    other = sites.where(has).groupBy(*key, "enum_fqn", "accessor").agg(F.lit(1)).join(g.select(*key, "f").hint("shuffle_merge"), key)
    other = other.where(~named.eqNullSafe(F.struct("f.enum_fqn", "f.accessor"))).select(*key, F.concat(F.lit("conflicting enum projections:"), "f.enum_fqn", F.lit(":"), "enum_fqn").alias("text"))
    unknown = sites.select(*key, F.explode("unknown").alias("text")).union(other)
    unknown = least_texts(unknown, key, "text", [], SHOWN).withColumnRenamed("texts", "unknowns")
    evidence = sites.select(*key, "position", F.posexplode("evidence").alias("at", "text")) if proofs is None else proofs.withColumn("_h", F.xxhash64("target"))
    evidence = least_texts(evidence, key, "text", ["position", "at"], EVIDENCE).withColumnRenamed("texts", "evidence")
    out = g.join(unknown.hint("shuffle_merge"), key, "left").join(evidence.hint("shuffle_merge"), key, "left").fillna(False, ["one"])
    status = F.when(F.col("c") & F.col("one"), "closed").when(F.col("k"), "known").when(F.col("x"), "external").otherwise("unresolved")
    out = out.withColumn("status", status).withColumn("unknowns", F.coalesce("unknowns", none)).withColumn("evidence", F.coalesce("evidence", none))
    warning = F.when(F.col("status") == "closed", None).when(F.col("status") == "known", WARNINGS["known"]).when(F.col("status") == "external", WARNINGS["external"])
    warning = warning.when(F.size("unknowns") > 0, F.concat(F.lit(WARNINGS["unresolved"] + ": "), F.array_join("unknowns", ", "))).otherwise(WARNINGS["unresolved"])
    return out.select("target", "status", "f.enum_fqn", "f.accessor", F.when(F.col("status") == "closed", F.col("f.values")).alias("values"), "unknowns", "evidence", warning.alias("warning"))


# Fixed values.
WARNINGS = {
    "known": "enum evidence does not prove a complete field domain",
    "external": "field value stops at an external boundary",
    "unresolved": "field domain unresolved",
}


def dominant_pair(df: DataFrame, group: list[str], a: str, b: str, default: tuple[str, str] | None = None) -> DataFrame:
    """A4: most frequent (a, b) of rows that have both; the larger pair on ties. Groups without any, and a table without
    any if there is no group, take the default."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = df.groupBy(*group, a, b).agg(F.count_if(both).alias("n"))
    best = n.groupBy(*group).agg(F.max_by(F.struct(a, b), F.struct("n", a, b), ).alias("p"), F.max("n").alias("m"))
    pick = lambda c, d: F.when(F.col("m") > 0, F.col(f"p.{c}")).otherwise(F.lit(d)).alias(c)
    d = default or (None, None)
    out = best.select(*group, pick(a, d[0]), pick(b, d[1]))
    return out if default else out.where(F.col(a).isNotNull())


def common_prefix(df: DataFrame, group: str, path: str) -> DataFrame:
    """A5: longest common leading steps of a group's distinct paths, empty steps aside; a single path is itself, others end
    in `share`."""
    d = df.select(group, path).distinct()
    steps = d.select(group, path, F.posexplode(F.filter(F.split(path, "/"), lambda x: x != "")))
    n = d.groupBy(group).agg(F.count("*").alias("paths"), F.min(path).alias("only"))
    per = steps.groupBy(group, "pos").agg(F.count_distinct("col").alias("k"), F.count("*").alias("m"), F.min("col").alias("step")).join(n.hint("shuffle_merge"), group)
    bad = per.groupBy(group).agg(F.min(F.when((F.col("k") > 1) | (F.col("m") < F.col("paths")), F.col("pos"))).alias("stop"))
    kept = per.join(bad.hint("shuffle_merge"), group).where("stop is null or pos < stop").groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]), "/").alias("prefix"))
    return n.join(kept.hint("shuffle_merge"), group, "left").select(group, F.when(F.col("paths") == 1, F.col("only")).otherwise(F.concat_ws("/", F.nullif("prefix", F.lit("")), F.lit("share"))).alias("prefix"))


def cap_with_omitted(df: DataFrame, group: list[str], order: list[Column], n: int, note: str | None = None) -> DataFrame:
    """L2: first n rows of each group with their rank, and the number left out. With `note`, the name of a text column,
    groups that lose rows get one more row, ranked n + 1, whose note says how many."""
    w = Window.partitionBy(*group)
    kept = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(w) - n, F.lit(0))).where(F.col("rank") <= n)
    if not note:
        return kept
    lost = df.groupBy(*group).agg((F.count("*") - n).alias("omitted")).where("omitted > 0")
    return kept.unionByName(lost.withColumn("rank", F.lit(n + 1)).withColumn(note, omitted_note(F.col("omitted"))), allowMissingColumns=True)


def omitted_note(n: Column) -> Column:
    return F.concat(F.lit("... "), n.cast("string"), F.lit(" additional diagnostic(s) omitted"))


def diagnostic_summary(diags: DataFrame) -> DataFrame:
    """Errors and shown and omitted lines of each file; at most 50 are shown."""
    g = diags.groupBy("file").agg(F.count_if(F.col("severity") == 2).alias("errors"), F.count("*").alias("total"))
    return g.withColumn("shown", F.least("errors", F.lit(50))).withColumn("omitted", F.col("errors") - F.col("shown"))


def diagnostic_lines(diags: DataFrame, totals: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` errors (run, ordinal, file, line, column, severity, rule, message) of each run as text, in
    input order, and a last row with what is left out of the run's total (run, error_count)."""
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    rule = F.when(F.coalesce(F.col("rule"), F.lit("")) != "", F.concat(F.lit(" ["), "rule", F.lit("]"))).otherwise("")
    file = F.when(F.coalesce(F.col("file"), F.lit("")) == "", "<unknown>").otherwise(F.col("file"))
    text = F.concat(file, F.lit(":"), one("line").cast("string"), F.lit(":"), one("column").cast("string"), F.lit(" error"), rule, F.lit(" "), F.coalesce("message", F.lit("")))
    rank = F.row_number().over(Window.partitionBy("run").orderBy("ordinal"))
    shown = diags.where("severity = 2").select("run", rank.alias("rank"), text.alias("text")).where(F.col("rank") <= limit)
    left = totals.groupBy("run").agg(F.sum("error_count").alias("e")).join(shown.groupBy("run").agg(F.count("*").alias("s")), "run", "left")
    left = left.withColumn("o", F.col("e") - F.coalesce("s", F.lit(0))).where("o > 0")
    return shown.union(left.select("run", (F.coalesce("s", F.lit(0)) + 1).cast("int"), omitted_note(F.col("o"))))


def coverage_table(rows: DataFrame, metrics: list[str], skip_full: bool) -> DataFrame:
    """Rows with the total first; files that are full in every metric may be left out."""
    total = rows.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("All files").alias("file"), *metrics, F.lit(0).alias("position"))
    full = F.forall(F.array(*metrics), lambda x: x == 100)
    return total.unionByName((rows.where(~full) if skip_full else rows).select("file", *metrics, F.lit(1).alias("position")))


def coverage_report(summary: DataFrame, metrics: list[str], skip_full: bool) -> DataFrame:
    """(run, file, a text for each metric) of coverage summaries to rows in order, the one named `total` first. A
    metric is a finite number or `Unknown`. A run without a valid total is one error row; a file with another value is
    an error row in its place; files that are full everywhere may be left out, the total never is."""
    fine = lambda m: F.col(m).try_cast("double").isNotNull() & ~F.isnan(F.col(m).try_cast("double")) & (F.abs(F.col(m).try_cast("double")) < float("inf")) | (F.col(m) == "Unknown")
    valid = F.coalesce(F.forall(F.array(*[F.coalesce(fine(m), F.lit(False)) for m in metrics]), lambda x: x), F.lit(False))
    full = F.forall(F.array(*[F.coalesce(F.col(m).try_cast("double") == 100, F.lit(False)) for m in metrics]), lambda x: x)
    r = summary.withColumn("_ok", valid).withColumn("_total", F.col("file") == "total")
    good = F.max(F.col("_total") & F.col("_ok")).over(Window.partitionBy("run"))
    r = r.withColumn("_good", good)
    bad = r.where("not _good").select("run").distinct().select("run", F.lit("All files").alias("file"), F.lit("no valid total").alias("error"), *[F.lit(None).cast("string").alias(m) for m in metrics], F.lit(0).alias("position"))
    rows = r.where("_good").where(F.col("_total") | ~F.col("_ok") | ~full) if skip_full else r.where("_good")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("_total"), "file")) - 1
    error = F.when(~F.col("_ok"), F.lit("invalid metrics"))
    rows = rows.select("run", F.when(F.col("_total"), "All files").otherwise(F.col("file")).alias("file"), error.alias("error"), *[F.when(F.col("_ok"), F.col(m)).alias(m) for m in metrics], rank.alias("position"))
    return rows.union(bad)


def run_summary(**tables: DataFrame) -> DataFrame:
    """A counter for each table, in one row each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = row if out is None else out.union(row)
    return out


def run_verdict(operations: DataFrame, schemas: DataFrame, patches: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of operations (with route_status), schemas, patches (with status), closed ones, placeholders and
    warnings; a run with any diagnostic is complete-with-warnings."""
    count = lambda df, n, c="true": df.agg(F.count_if(F.expr(c)).alias(n))
    out = operations.agg(F.count("*").alias("operations"), F.count_if(F.col("route_status") == "placeholder").alias("placeholders"))
    for one in (count(schemas, "schemas"), patches.agg(F.count("*").alias("patches"), F.count_if(F.col("status") == "closed").alias("closed_patches")), count(diagnostics, "warnings")):
        out = out.crossJoin(one)  # of one row and one row
    return out.withColumn("status", F.when(F.col("warnings") == 0, "complete").otherwise("complete-with-warnings"))


def assert_single_value(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value, as error rows."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("found")).where("n > 1")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """A10: keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def table_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """One fingerprint of a table whatever its row order: eight sums, modulo 2^61, of 32-bit pieces of the rows'
    SHA-256, each weighed by another piece of the same hash. Sums are combined map-side and nothing is gathered."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in cols]), 256)
    piece = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = [(F.sum(piece(i) * piece((i + 3) % 8) + piece(i)) % (1 << 61)).cast("string") for i in range(8)]
    return df.select(h.alias("h")).agg(F.sha2(F.concat_ws(",", *sums, F.count("*").cast("string")), 256).alias("fingerprint"), F.count("*").alias("rows"))


def schema_usage(reach: DataFrame, operations: DataFrame) -> DataFrame:
    """Directories of the operations that reach a schema."""
    return reach.join(operations, "root").groupBy("node").agg(F.array_sort(F.collect_set("dir")).alias("dirs"))


def release_summary(packages: DataFrame) -> DataFrame:
    """Packages of each ecosystem (node, rust), the workspace plugins that more than one of them asks for, and path
    -> version of each repo. A path that several packages share is an error: no versions, and the first such path."""
    per = packages.groupBy("repo", "path").agg(F.min("version").alias("version"), F.count("*").alias("_n"), F.count_if(F.col("type") == "node").alias("node"), F.count_if(F.col("type") == "rust").alias("rust"))
    g = per.groupBy("repo").agg(F.sum("node").alias("node"), F.sum("rust").alias("rust"), F.sort_array(F.collect_list(F.struct("path", "version"))).alias("versions"), F.min(F.when(F.col("_n") > 1, F.col("path"))).alias("_shared"))
    plugins = F.array_compact(F.array(F.when(F.col("node") > 1, "node-workspace"), F.when(F.col("rust") > 1, "cargo-workspace")))
    return g.select("repo", "node", "rust", F.when(F.col("_shared").isNull(), F.map_from_entries("versions")).alias("versions"), plugins.alias("plugins"), F.concat(F.lit("packages share release path "), "_shared").alias("error"))


def first_non_empty(df: DataFrame, group: list[str], order: Column, col: str) -> DataFrame:
    """First text that is not blank in scan order."""
    return df.where(F.trim(F.coalesce(F.col(col), F.lit(""))) != "").groupBy(*group).agg(F.min_by(F.trim(col), order).alias(col))


def tag_revision(refs: DataFrame) -> DataFrame:
    """(tag, reference, revision): what `refs/tags/<tag>` points at in the end, else the tag itself. A revision that
    is no 40 or 64 hex digits, or a reference to anything else, makes the tag an error."""
    direct = F.concat(F.lit("refs/tags/"), F.col("tag").cast("string"))
    peeled = F.col("reference") == F.concat(direct, F.lit("^{}"))
    ok, known = F.bool_and(F.col("revision").rlike("^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")), F.bool_and(peeled | (F.col("reference") == direct))
    best = F.coalesce(F.max(F.when(peeled, F.col("revision"))), F.max(F.when(~peeled, F.col("revision"))))
    return refs.groupBy("tag").agg(F.when(ok & known, best).alias("revision"), F.when(~ok, "bad-hash").when(~known, "unexpected-reference").otherwise("ok").alias("status"))


def output_units(operations: DataFrame) -> DataFrame:
    """(unit, name, key): members of each output unit by key, and whether two of them share a name."""
    g = operations.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "name"))), lambda x: x["name"]).alias("names"))
    return g.withColumn("collides", F.size(F.array_distinct("names")) < F.size("names"))


# --- predicates over tables ------------------------------------------------------------------------------------------
def prefixes_of(path: Column) -> Column:
    """The path cut after each of its steps, itself last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def select_contracts(nodes: DataFrame, sources: DataFrame, roots: DataFrame, suffix: str, marker: str) -> DataFrame:
    """Interfaces (id, kind, name, file_path) of a suffix under a root whose source holds the marker. A file is under
    a root if one of its own path's prefixes is that root: an equi join."""
    picked = nodes.where((F.col("kind") == "interface") & F.endswith(F.col("name"), F.lit(suffix)))
    files = picked.select("file_path").distinct()
    under = files.select("file_path", F.explode(prefixes_of(F.col("file_path"))).alias("root")).where("root <> file_path")
    under = under.join(roots.select("root").distinct().hint("shuffle_hash"), "root", "left_semi").select("file_path").distinct()
    marked = sources.where(F.contains(F.col("text"), F.lit(marker))).select("file_path")
    return picked.join(under.hint("shuffle_merge"), "file_path", "left_semi").join(marked, "file_path", "left_semi")


def assign_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Longest root that a path is under, step by step; null if none. One equi join on the path's own prefixes."""
    hits = paths.select("path").distinct().select("path", F.explode(prefixes_of(F.col("path"))).alias("root")).join(roots.select("root").distinct().hint("shuffle_hash"), "root")
    best = hits.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best.hint("shuffle_merge"), "path", "left")


def split_by_globs(df: DataFrame, col: str, include: list[str], exclude: list[str]) -> DataFrame:
    """P5: adds `selected`. `**` spans steps, `*` and `?` stay within one, braces list choices."""

    def regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            else:
                c = glob[i]
                out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, "\\" + c if c in ".()+|^$[]\\" else c)
                i += 1
        return f"^{out}$"

    joined = lambda gs: "|".join(map(regex, gs))
    keep = F.col(col).rlike(joined(include)) if include else F.lit(True)
    return df.withColumn("selected", keep & ~F.col(col).rlike(joined(exclude)) if exclude else keep)


def classify_packages(df: DataFrame, excluded: list[str], valid_name: Column, exact: Column) -> DataFrame:
    """Packages but the excluded ones, with the reason that makes one unusable."""
    reason = F.when(~valid_name, "bad-name").when(~exact, "inexact-version").when(F.col("source") != "registry", "not-registry")
    return df.where(~F.col("name").isin(excluded)).withColumn("reason", F.coalesce(reason, F.lit("usable")))


# Where packages may be published, managers and the lock files that tell of them.
NPM_REGISTRY, CARGO_REGISTRY = "https://registry.npmjs.org", "crates-io"
MANAGERS, OTHER_MANAGERS = ["npm", "pnpm"], ["yarn", "bun"]
NPM_LOCK, PNPM_LOCK = "package-lock.json", "pnpm-lock.yaml"
OTHER_LOCKS, DENO = ["yarn.lock", "bun.lock", "bun.lockb"], ["deno.json", "deno.lock"]


def package_catalog(manifests: DataFrame) -> DataFrame:
    """(path, manifest json; ecosystem `node` or `rust` if the table says) -> publishable or the reason why not.

    node: private must be a boolean; name and version are needed; a registry must be the public one; a repository is a
    text or an object with a url. rust: an empty publish list is private, others must name the public registry."""
    from contractlens.functions.columns import semver_valid

    eco = F.col("ecosystem") if "ecosystem" in manifests.columns else F.lit("node")
    m = manifests.withColumn("_e", eco).withColumn("_v", F.try_parse_json("manifest"))
    raw = lambda p: F.to_json(F.try_variant_get("_v", p, "variant"))
    text = lambda p: F.when(F.startswith(raw(p), F.lit('"')), F.try_variant_get("_v", p, "string"))
    full = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    node, rust = F.col("_e") == "node", F.col("_e") == "rust"
    private, publish, registry = raw("$.private"), raw("$.publish"), raw("$.publishConfig.registry")
    listed = F.from_json(publish, "array<string>")
    repository = F.when(node & F.startswith(raw("$.repository"), F.lit("{")), text("$.repository.url")).otherwise(text("$.repository"))
    reason = (
        F.when(F.col("_v").isNull(), "bad-manifest")
        .when(node & (private == "true"), "private").when(node & private.isNotNull() & (private != "false"), "bad-private")
        .when(rust & publish.isNotNull() & ~F.startswith(publish, F.lit("[")) & (publish != "null"), "bad-publish").when(rust & (F.size(listed) == 0) & (publish == "[]"), "private")
        .when(rust & F.exists(F.coalesce(listed, F.array().cast("array<string>")), lambda x: ~x.eqNullSafe(F.lit(CARGO_REGISTRY))), "bad-registry")
        .when(~full(text("$.name")), "no-name").when(~F.coalesce(semver_valid(text("$.version")), F.lit(False)), "bad-version")
        .when(node & registry.isNotNull() & ~F.coalesce(F.rtrim(text("$.publishConfig.registry"), F.lit("/")) == NPM_REGISTRY, F.lit(False)), "bad-registry")
        .when(~full(repository), "no-repository")
    )
    return m.select("path", text("$.name").alias("name"), text("$.version").alias("version"), F.coalesce(reason, F.lit("publishable")).alias("status"))


def package_manager(projects: DataFrame) -> DataFrame:
    """(path, declared packageManager or null, files beside the manifest) -> the manager, or the error in choosing."""
    from contractlens.functions.columns import semver_valid

    name, version = F.substring_index("declared", "@", 1), F.substring(F.col("declared"), F.instr("declared", "@") + 1, F.length("declared"))
    has = lambda fs: F.arrays_overlap(F.col("files"), F.array(*map(F.lit, fs)))
    npm, pnpm = has([NPM_LOCK]), has([PNPM_LOCK])
    said = F.when(F.trim("declared") == "", "error: empty").when(F.instr("declared", "@") == 0, "error: no version").when(~semver_valid(version), "error: bad version").when(name.isin(MANAGERS), name).otherwise("error: not supported")
    found = F.when(npm & pnpm, "error: several lockfiles").when(pnpm, "error: pnpm needs packageManager").when(npm, "npm").when(has(OTHER_LOCKS), "error: not supported").when(has(DENO), "error: deno").otherwise("npm")
    return projects.select("path", F.when(F.col("declared").isNotNull(), said).otherwise(found).alias("manager"))


def find_roots(files: DataFrame, ancestor: str, layout: str | None = None) -> DataFrame:
    """P10: nearest ancestor of that name above each file; nested roots are dropped."""
    return check_roots(files, ancestor, layout).where("status = 'ok'").select("root").distinct()


def check_roots(files: DataFrame, ancestor: str, layout: str | None = None) -> DataFrame:
    """P10: (path, root, status) of each file: `no-root` without such an ancestor, `outside-layout` if the root does not
    hold the layout's path, `nested` if another root lies above it, else `ok`."""
    root = F.regexp_extract("path", f"^((?:.*/)?{ancestor})/[^/]", 1)
    f = files.select("path", F.nullif(root, F.lit("")).alias("root"))
    roots = f.where("root is not null").select("root").distinct()
    above = roots.select("root", F.explode(prefixes_of(F.col("root"))).alias("up")).where("up <> root")
    nested = above.join(roots.withColumnRenamed("root", "up").hint("shuffle_hash"), "up", "left_semi").select("root").distinct().withColumn("_n", F.lit(True))
    f = f.join(nested.hint("shuffle_merge"), "root", "left")
    outside = ~F.contains(F.col("root"), F.lit(layout)) if layout else F.lit(False)
    return f.select("path", "root", F.when(F.col("root").isNull(), "no-root").when(outside, "outside-layout").when(F.col("_n"), "nested").otherwise("ok").alias("status"))


def pick_request(params: DataFrame, known: DataFrame, context_types: list[str]) -> DataFrame:
    """(operation, pos, type): the last parameter of a known type that is no context; several give a warning."""
    ok = params.where(~F.col("type").isin(context_types)).join(known.select("type").distinct(), "type", "left_semi")
    return ok.groupBy("operation").agg(F.max_by("type", "pos").alias("request"), (F.count("*") > 1).alias("several"))


# --- sets and sources ------------------------------------------------------------------------------------------------
def union_inventory(*dfs: DataFrame) -> DataFrame:
    """U1."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def collect_inventory(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(packages, diagnostics (message)) of each provider to one table of either, with the provider's name."""
    named = lambda i: union_inventory(*[p[i].withColumn("provider", F.lit(n)) for n, p in parts.items()])
    return named(0), named(1)


def ordered(df: DataFrame, keys: list[str | Column], tie: list[str] | None = None) -> DataFrame:
    """L1: rows in the total order of the keys (range-partitioned, so sorted in parallel); by all other columns on ties."""
    named = {k for k in keys if isinstance(k, str)}
    return df.orderBy(*keys, *(tie if tie is not None else [c for c in df.columns if c not in named]))


def stale(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Keys of before that are gone."""
    return previous.join(current, key, "left_anti").select(*key)


def same_value_set(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides with whether their value sets are equal."""
    s = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    return s(a, "_a").join(s(b, "_b"), key).select(key, (F.col("_a") == F.col("_b")).alias("same"))


def restrict(df: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is allowed."""
    return df.join(allowed, key, "left_semi")


def reconcile_manifest(planned: DataFrame, previous: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each path, from its planned, recorded and present content hash."""
    j = planned.select("path", F.col("hash").alias("p")).join(previous.select("path", F.col("hash").alias("m")), "path", "full").join(current.select("path", F.col("hash").alias("c")), "path", "full")
    ours = F.col("m").isNotNull() & F.col("c").eqNullSafe(F.col("m")) | F.lit(force)
    action = (
        F.when(F.col("p").isNotNull(), F.when(F.col("c").isNull(), "create").when(F.col("c") == F.col("p"), "unchanged").when(ours, "overwrite").otherwise("conflict"))
        .when(F.col("m").isNotNull(), F.when(F.col("c").isNull(), "already_gone").when(ours, "remove_stale").otherwise("conflict_stale"))
    )
    return j.select("path", action.alias("action")).where("action is not null")


def require_columns(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Df, or an error that lists what it lacks, before any job runs."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def require_metadata(meta: DataFrame, key: str, expected: str) -> DataFrame:
    """S3: tenants whose (tenant, key, value) metadata does not say what is expected."""
    return meta.groupBy("tenant").agg(F.max(F.when(F.col("key") == key, F.col("value"))).alias("value")).where(~F.col("value").eqNullSafe(F.lit(expected)))


def find_key(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, value) of the first value called `name` in each JSON text, at any depth: an object's own entry comes
    before those of its children, which come in their order. Texts as they are, all else as JSON; nulls count as
    missing, and texts that are no JSON have none. A level of nesting at a time, down to the last."""
    level = df.select(key, F.array().cast("array<int>").alias("at"), F.to_json(F.try_parse_json(text)).alias("v")).where("v is not null")
    found = None
    for depth in count():
        v = level.withColumn("p", F.parse_json("v"))
        own = F.when(F.startswith("v", F.lit("{")), F.variant_get("p", f"$.{name}", "variant"))
        shown = F.when(F.startswith(F.to_json(own), F.lit('"')), F.try_variant_get(own, "$", "string")).otherwise(F.to_json(own))
        hits = v.select(key, "at", shown.alias("value"), F.to_json(own).alias("j")).where("j is not null and j <> 'null'").select(key, "at", "value")
        found = hits if found is None else found.union(hits)
        down = v.where("v like '{%' or v like '[%'").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("p").outer()))
        level = materialize(down.select(F.col(key), F.array_append("at", F.col("pos")).alias("at"), F.to_json("value").alias("v")).where("v like '{%' or v like '[%'"), f"json-{depth}")
        if level.isEmpty():
            break
    best = found.groupBy(key).agg(F.min_by("value", "at").alias("value"))
    return df.select(key).join(best.hint("shuffle_merge"), key, "left")


# --- checks ----------------------------------------------------------------------------------------------------------
def run_checks(df: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each check gives one row (status, message). One that raises, while planned or while run, that gives no row or
    another status has failed; every check is told of, by name. Each check's own aggregate runs here, so that one that
    breaks does not take the others along; a row a check is all that reaches the driver."""
    rows = []
    for name in sorted(checks):
        try:
            row = checks[name](df).select("status", "message").first()
        except Exception as e:  # a broken check must not hide the others
            row = ("failed", str(e)[:200])
        status, message = row or ("failed", "no result")
        rows.append((name, status if status in ("passed", "warning", "failed") else "failed", message))
    return df.sparkSession.createDataFrame(rows, "check string, status string, message string")


def combine_results(results: DataFrame, already_continued: bool = False) -> DataFrame:
    """Failures block (once), warnings alone are a message, else silence."""
    said = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.concat_ws(": ", "check", "message"))))
    g = results.agg(said("failed").alias("f"), said("warning").alias("w"))
    decision = F.when(F.size("f") > 0, "message" if already_continued else "block").when(F.size("w") > 0, "message").otherwise("silent")
    return g.select(decision.alias("decision"), F.array_join(F.concat("f", "w"), "; ").alias("text"))


def accept_gate(snapshot: DataFrame) -> DataFrame:
    """Reasons against each (snapshot, commit, expected_commit, operations, expected_operations, placeholders,
    unresolved, hash, expected_hash)."""
    why = F.array_compact(F.array(F.when(F.col("commit") != F.col("expected_commit"), "commit"), F.when(F.col("operations") != F.col("expected_operations"), "count"), F.when(F.col("placeholders") > 0, "placeholders"), F.when(F.col("unresolved") > 0, "unresolved"), F.when(F.col("hash") != F.col("expected_hash"), "hash")))
    return snapshot.select("snapshot", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("accepted"))


BUCKETS = 65_536


def bucket_sums(df: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows, sum) of a table's rows, dealt by a hash of the whole row; equal tables have equal sums."""
    h = F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])  # nulls alone leave no trace in the hash
    return df.select(h.alias("h")).groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum"))


def revalidate(previewed: DataFrame, fresh: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """C4: rows that only one of the two plans has, as often as it has them more.

    Both are first compared by the sums of their buckets, which tasks add up before anything is sent. Only rows of
    buckets that differ (at most `buckets` numbers, so they are broadcast) are compared themselves: of two tables of any
    size that differ in one row, the rows of two buckets."""
    sums = bucket_sums(previewed, buckets).withColumnsRenamed({"rows": "r", "sum": "s"}).join(bucket_sums(fresh, buckets).hint("shuffle_merge"), "bucket", "full")
    differ = F.broadcast(materialize(sums.where(~(F.col("rows").eqNullSafe(F.col("r")) & F.col("sum").eqNullSafe(F.col("s")))).select("bucket"), "differing"))
    part = lambda df: df.withColumn("_b", F.pmod(F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns]), F.lit(buckets))).join(differ.withColumnRenamed("bucket", "_b"), "_b", "left_semi").select(*df.columns)
    one, two = part(previewed), part(fresh)
    return one.exceptAll(two).withColumn("only_in", F.lit("previewed")).union(two.exceptAll(one).withColumn("only_in", F.lit("fresh")))


def diagnostics(**parts: DataFrame) -> DataFrame:
    """(subject, message) tables named stage_code_level as diagnostic rows."""
    out = None
    for name, df in parts.items():
        stage, code, level = name.split("_")
        row = df.select(F.lit(level).alias("level"), F.lit(stage).alias("stage"), F.lit(code).alias("code"), "subject", "message")
        out = row if out is None else out.union(row)
    return out


def effective_values(fields: DataFrame, patches: DataFrame, linked: DataFrame, declared: DataFrame) -> DataFrame:
    """Values of each field: closed patch, else linked enum, else declared, else its plain type."""
    out = fields
    for n, df in (("patch", patches), ("linked", linked), ("declared", declared)):
        out = out.join(df.select("field", F.col("values").alias(n)), "field", "left")
    origin = F.when(F.col("patch").isNotNull(), "patch").when(F.col("linked").isNotNull(), "linked").when(F.col("declared").isNotNull(), "declared").otherwise("type")
    return out.select("field", F.coalesce("patch", "linked", "declared", "type").alias("values"), origin.alias("origin"))


def envelope(payload: Column, code_field: str, data_field: str, code: str) -> Column:
    """M3: the payload in its envelope, as JSON; the code is a number if it reads as one."""
    shown = code if code.lstrip("-").isdigit() else json.dumps(code, ensure_ascii=False)
    return F.concat(F.lit("{" + f"{json.dumps(code_field)}:{shown},{json.dumps(data_field)}:"), payload, F.lit("}"))


def success_schema(responses: DataFrame) -> DataFrame:
    """M4: (operation, status, schema): that of 200, 201, 202 or 204, whichever comes first."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("200", "201", "202", "204")]), F.col("status"))
    return responses.where(order > 0).groupBy("operation").agg(F.min_by("schema", order).alias("schema"))
