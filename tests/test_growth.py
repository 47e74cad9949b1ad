"""Work that grows with the input: results against plain versions, and what is written or held on the way."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from contractlens.operators import graph as G
from contractlens.operators import relational as R
from contractlens.streaming import edits as E
from contractlens.streaming.state import close_fold


def random_edges(seed, n, m):
    r = random.Random(seed)
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]


def table(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def depths(edges, root):
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    seen, todo = {root: 0}, deque([root])
    while todo:
        x = todo.popleft()
        for y in to[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


@pytest.fixture
def written(monkeypatch):
    rows, write = Counter(), G.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name.split("-")[0]] += out.count()
        return out

    monkeypatch.setattr(G, "materialize", counted)
    return rows


def test_shortest_paths_are_those_of_reachable(spark):
    for seed, n, m, k in ((1, 12, 30, 5),):
        edges = random_edges(seed, n, m) + [("a", "a b"), ("a", "a"), ("a b", "n1"), ("a", "n1")]
        e, roots = table(spark, edges, "source target"), table(spark, [(f"n{i}",) for i in range(k)] + [("a",), ("lone",)], "root")
        want = G.paths(G.reachable(e, roots)).select("root", "node", "path").collect()
        got = G.shortest_paths(e, roots).select("root", "node", "path").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), seed
        first = G.paths(G.reachable(e, roots, 2, None, partial=True), 2).select("root", "node", "path").collect()
        assert sorted(map(tuple, G.shortest_paths(e, roots, 2, partial=True).select("root", "node", "path").collect())) == sorted(map(tuple, first)), seed


def test_paths_of_many_roots_are_not_written_for_each_pair(spark, written):
    edges = [(f"r{i}", "hub") for i in range(30)] + [("hub", f"x{i}") for i in range(500)]
    got = G.shortest_paths(table(spark, edges, "source target"), table(spark, [(f"r{i}",) for i in range(30)], "root"))
    assert got.count() == 30 * 502
    assert sum(written.values()) < 4000  # not the 15,060 pairs


def least_ways(edges, roots, deepest=64):
    rows = []
    for root in roots:
        level, seen = {root: [root]}, {}
        while level:
            seen |= level
            ways = [(y, [*level[x], y]) for x, y in edges if x in level and y is not None and y not in seen]
            level = {y: min(w for z, w in ways if z == y) for y, _ in ways} if len(next(iter(level.values()))) <= deepest else {}
        rows += [(root, node, len(way) - 1, " => ".join(way)) for node, way in seen.items()]
    return sorted(rows)


def shortest(e, roots, *more):
    return sorted(map(tuple, G.shortest_paths(e, roots, *more).select("root", "node", "depth", "path").collect()))


def test_nodes_that_one_edge_leads_to_are_not_searched(spark, written):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r1", "r3")]
    trees = [(f"r{i}", f"c{i}-{j}") for i in range(5) for j in range(20)] + [(f"c{i}-{j}", f"o{i}-{j}-{k}") for i in range(5) for j in range(20) for k in range(3)]
    got = shortest(table(spark, ring + trees, "source target"), table(spark, [(f"r{i}",) for i in range(5)], "root"))
    assert got == least_ways(ring + trees, [f"r{i}" for i in range(5)])
    assert written["reach"] < 100  # the ring alone, not 405 nodes at several depths


def test_paths_through_hanging_nodes_are_the_least(spark):
    for seed, *more in ((0,), (2, 3, True)):
        r = random.Random(seed)
        edges = random_edges(seed, 8, 10) + [(f"n{r.randrange(8)}", f"t{i}") for i in range(5)] + [(f"t{i % 5}", f"u{i}") for i in range(10)]
        edges += [(f"{r.choice('tu')}{r.randrange(5)}", f"n{r.randrange(8)}") for _ in range(8)] + [("lost", "lost too"), ("n1", None), (None, "n2"), ("u7", "u7"), ("n0", "t1")]
        roots = ["n0", "n5", "t2", "u9", "alone"]
        assert shortest(table(spark, edges, "source target"), table(spark, [(x,) for x in roots], "root"), *more) == least_ways(edges, roots, *more[:1]), seed
    line = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("z", "y"), ("y", "y1"), ("y1", "y2"), ("y2", "y3"), ("y3", "y4")]
    e = table(spark, line, "source target")
    assert shortest(e, table(spark, [("a",)], "root"), 3) == least_ways(line, ["a"])
    with pytest.raises(ValueError, match="a reaches nodes beyond depth 2"):
        G.shortest_paths(e, table(spark, [("a",), ("y3",)], "root"), 2)


def test_counts_of_roots_with_the_same_first_nodes_share_a_search(spark, written):
    ring = [(f"n{i}", f"n{(i + 1) % 64}") for i in range(64)]
    for edges, roots in (
        (random_edges(3, 15, 25) + [(f"r{i}", "n1") for i in range(9)] + [("n2", "r3"), ("r4", "r4"), ("r5", "r4")], [f"n{i}" for i in range(15)] + [f"r{i}" for i in range(9)] + ["lone"]),
        (ring, ["n0", "n9"]),
    ):
        want = {(r, d, n) for r in roots for d, n in Counter(depths(edges, r).values()).items()}
        assert {tuple(x) for x in G.reach_counts(table(spark, edges, "source target"), table(spark, [(r,) for r in roots], "root")).collect()} == want
    written.clear()
    many = [(f"r{i}", "hub") for i in range(2000)] + [("hub", f"x{i}") for i in range(100)]
    got = G.reach_counts(table(spark, many, "source target"), table(spark, [(f"r{i}",) for i in range(2000)], "root")).groupBy("depth").agg(F.sum("nodes")).collect()
    assert {tuple(x) for x in got} == {(0, 2000), (1, 2000), (2, 200_000)}
    assert written["reach"] < 400  # one search of 101 nodes, not 2,000 roots in 32 words
    with pytest.raises(ValueError, match="beyond depth 3"):
        G.reach_counts(table(spark, ring, "source target"), table(spark, [("n0",)], "root"), 3)


def test_groups_of_roots_are_scanned_in_one_python_pass(spark, monkeypatch):
    monkeypatch.setattr(R, "ROOTS", 7)
    monkeypatch.setattr(R, "HELD", 5)
    r = random.Random(4)
    roots = [(r.randrange(9), "".join(r.choice("abc") for _ in range(r.randint(1, 5)))) for _ in range(60)]
    lines = [(i, "".join(r.choice("abcd") for _ in range(12)) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(lines, "doc_id int, t string").repartition(3)
    got = R.first_roots(df, "t", spark.createDataFrame(roots, "ordinal int, root string"))
    first = lambda t: min(((o, x) for o, x in roots if x in t), default=(0, None))[1] if t else None
    assert {(x["doc_id"], x["root"]) for x in got.collect()} == {(i, first(t)) for i, t in lines}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one worker holds one automaton


def test_small_turns_close_in_one_pass_over_sorted_rows(spark):
    r, rows = random.Random(6), []
    for i in range(400):
        stop = r.random() < 0.3
        rows.append((f"s{r.randrange(20)}" if i % 50 else None, f"t{r.randrange(6)}", i, stop, None if stop else f"f{r.randrange(4)}", r.choice(["failed", "passed", "warning", "none"]) if stop else None, stop and r.random() < 0.2))
    want = []
    for key in {x[:2] for x in rows}:
        want += [(*key, *out) for out in close_fold([x[2:] for x in rows if x[:2] == key], set(), False)[0]]
    df = E.close_turns(spark.createDataFrame(rows, "session_id string, turn_id string, event_id long, stop boolean, path string, status string, continued boolean").repartition(3))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()  # no Python call for each turn


def test_pairs_are_written_once(spark, written):
    n = 12
    fields = [(f"s{i}", "f", f"s{i + 1}") for i in range(n)] + [("s3", "back", "s0")]
    new = [(f"t{i}", f, f"t{r[1:]}") for i, (_, f, r) in enumerate(fields[:n])]
    got = G.pair_schemas(table(spark, fields, "schema field ref"), table(spark, new, "schema field ref"), table(spark, [("s0", "t0")], "old new"))
    assert {tuple(r) for r in got.select("old", "new", "depth").collect()} == {(f"s{i}", f"t{i}", i) for i in range(n + 1)}
    assert written["paired"] <= 2 * n  # not all pairs again in each round


def test_depths_of_pairs_are_those_of_reachable_without_ranks(spark, written):
    edges = random_edges(5, 14, 20) + [("n1", "n1")]
    e, roots = table(spark, edges, "source target"), table(spark, [(f"n{i}",) for i in range(14)] + [("lone",)], "root")
    want = {(r, n, d) for r in [f"n{i}" for i in range(14)] + ["lone"] for n, d in depths(edges, r).items()}
    assert {tuple(x) for x in G.pair_depths(e, roots).collect()} == want
    with pytest.raises(ValueError, match="more than 2 nodes"):
        G.pair_depths(e, roots, max_nodes=2)
    with pytest.raises(ValueError, match="beyond depth 1"):
        G.pair_depths(table(spark, [("a", "b"), ("b", "c")], "source target"), table(spark, [("a",)], "root"), 1)
    written.clear()
    G.flatten_inheritance(table(spark, [("C", "B"), ("B", "A"), ("A", None)], "class parent"), spark.createDataFrame([("A", "x", 1, "int")], "class string, field string, pos int, type string"))
    assert not written["parents"] and not written["reach"]


def test_samples_write_each_level_once(spark, monkeypatch):
    names, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: names.append(name) or write(df, name))
    schema = spark.createDataFrame([("L", "array"), ("O", "object"), ("x", "integer")], "node string, type string").selectExpr("node", "type", "cast(null as string) as format", "if(node = 'x', '5', null) as fixed", "cast(null as array<string>) as options", "cast(null as string) as ref")
    links = spark.createDataFrame([("O", "property", "a", 0, "x"), ("O", "property", "b", 1, "L"), ("O", "property", "gone", 2, "nowhere")], "node string, kind string, name string, position int, child string")
    got = G.generate_rows(spark.createDataFrame([("op", "O")], "operation string, node string"), schema, links, 1, 3).first()["document"]
    assert got.startswith('{"a":5,"b":["') and "gone" not in got and got.count('"') == 8  # two texts for items without a schema
    assert not [n for n in names if n.startswith("sample-front")] and names.count("sample-1") == 1


def test_sites_of_a_lineage_are_read_once_and_evidence_is_the_first_of_many(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    lines = [("c", "set", i, 5) for i in range(30)] + [("d", "set", 7, 5)]
    calls = spark.createDataFrame(lines, "caller string, setter string, line int, column int").mapInPandas(counted, "caller string, setter string, line int, column int")
    sites = spark.createDataFrame([(*x, "src", f"p{x[2] % 3}") for x in lines if x[2] != 29] + [("c", "set", 99, 1, "src", "p0")], "caller string, setter string, line int, column int, source string, slot string")
    lost = spark.createDataFrame([("c", "set", i, 1) for i in range(40, 50)], "caller string, setter string, line int, column int")
    reach = table(spark, [("op", "op", None), ("op", "c", "op"), ("op", "d", "op")], "root node parent").withColumn("depth", F.when(F.col("node") == "op", 0).otherwise(1))
    nodes = table(spark, [("op", "Op", "a"), ("c", "C", "f"), ("d", "D", "f")], "node name file")
    domains = spark.createDataFrame([("d0", "E", "get", True, [], [], [], False, ["v"])], "domain string, enum_fqn string, accessor string, complete boolean, external array<string>, unknown array<string>, literals array<string>, transformed boolean, values array<string>")
    got = G.field_lineage(reach, nodes, table(spark, [("op", "f", "set")], "operation field setter"), calls, sites, lost, table(spark, [("op", f"p{i}", "d0") for i in range(2)], "operation slot domain"), domains).collect()
    assert [(x["status"], x["enum_fqn"]) for x in got] == [("known", "E")]
    writes = [f"write:f:{i}:5:src" for i in range(29)]
    assert got[0]["evidence"] == [writes[0], "chain:Op => C", *writes[1:8], "chain:Op => D", *writes[8:18]]
    assert got[0]["unknowns"] == ["unindexed setter argument at f:29:5", "unindexed setter call:f:99:1", "unknown", "unresolved setter call:f:40:1"]
    assert reads.value == len(lines)


def test_rows_beside_are_the_same_for_keys_dealt_by_ranges(spark, monkeypatch):
    r = random.Random(4)
    left = spark.createDataFrame([(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(60)]), i) for i in range(400)], "k string, at int, tag int")
    right = spark.createDataFrame([(r.choice(["hot", "hot", "a", "b"]), r.randrange(60), r.randrange(9)) for _ in range(200)], "k string, pos int, id int")
    both = lambda: [sorted(map(str, f(left, right, ["k"], "at", "pos", "id").collect())) for f in (R.nearest, R.as_of)]
    whole = both()
    dealt, ranges = [], R._beside_ranges
    monkeypatch.setattr(R, "_beside_ranges", lambda *a: (dealt.append(1), ranges(*a))[1])
    monkeypatch.setattr(R, "HOT_ROWS", 150)
    assert both() == whole and len(dealt) == 2


def test_long_flows_are_settled_without_a_round_for_each_step(spark, monkeypatch):
    names, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: (names.append(name), write(df, name))[1])
    n = 60
    calls = [(f"m{i}", f"m{i + 1}", f"s{i + 1}", f"s{i}", None) for i in range(n)] + [("e", "m0", "s0", None, "D"), (f"m{n}", f"m{n - 1}", f"s{n - 1}", f"s{n}", None)]
    slots = table(spark, [(f"s{i}", f"m{i}") for i in range(n + 1)] + [("lone", "e")], "slot method")
    reach = table(spark, [("op", m) for m in ["e", *(f"m{i}" for i in range(n + 1))]] + [("cut", f"m{i}") for i in range(3)], "root node")
    got = {tuple(x) for x in G.propagate_domains(slots, table(spark, calls, "caller method slot from_slot domain"), reach).collect()}
    want = {("op", f"s{i}", "D") for i in range(n + 1)} | {("op", f"s{i}", "unknown") for i in (n - 1, n)} | {("op", "lone", "unknown")} | {("cut", f"s{i}", "unknown") for i in range(4)}
    assert got == want
    assert len(names) < n


def test_great_components_give_what_small_ones_give(spark, monkeypatch):
    r = random.Random(6)
    calls = []
    for i in range(60):
        a, b = r.randrange(40), r.randrange(40)
        source = f"s{a}" if r.random() < 0.6 else None
        calls.append((f"m{a}", f"m{b}", f"s{b}", source, None if source else r.choice(["A", "B", None])))
    slots = table(spark, [(f"s{i}", f"m{i}") for i in range(40)], "slot method")
    reach = table(spark, [(op, f"m{i}") for op in "xy" for i in range(40) if r.random() < 0.8], "root node")
    run = lambda: sorted(map(tuple, G.propagate_domains(slots, table(spark, calls, "caller method slot from_slot domain"), reach).collect()))
    whole = run()
    monkeypatch.setattr(G, "GROUP_ROWS", 8)
    assert run() == whole


def test_parents_of_pairs_are_those_of_reachable(spark):
    edges = random_edges(7, 12, 30) + [("n1", "n1"), ("a", "n2"), ("a", "n2"), ("n3", None)]
    e, roots = table(spark, edges, "source target"), table(spark, [("n0",), ("n4",), ("a",), ("alone",), ("a",)], "root")
    rows = lambda df: sorted(map(str, df.select("root", "node", "parent", "depth", "rank").collect()))
    assert rows(G.pair_parents(e, roots)) == rows(G.reachable(e.where("target is not null"), roots))
    with pytest.raises(ValueError, match="a reaches more than 3 nodes"):
        G.pair_parents(table(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("x", "y")], "source target"), table(spark, [("a",), ("x",)], "root"), max_nodes=3)
    with pytest.raises(ValueError, match="reaches nodes beyond depth 1"):
        G.pair_parents(table(spark, [("a", "b"), ("b", "d")], "source target"), table(spark, [("a",)], "root"), 1)


def test_lineage_writes_what_fields_may_meet_and_deals_domains_whole(spark, written):
    lines = [("c", "set", 5, i, f"p{i}") for i in range(4)] + [("c", "other", i, i, "p0") for i in range(300)]
    calls = spark.createDataFrame([x[:4] for x in lines], "caller string, setter string, line int, column int")
    sites = spark.createDataFrame([(c, s, at, col + (1 if col == 3 else 0), "src", p) for c, s, at, col, p in lines] + [("c", "set", 5, 2, "src", "p9"), ("c", "set", 6, 2, "src", "p9")], "caller string, setter string, line int, column int, source string, slot string")
    reach = table(spark, [("op", "op", None), ("op", "c", "op")], "root node parent").withColumn("depth", F.when(F.col("node") == "op", 0).otherwise(1))
    nodes = table(spark, [("op", "Op", "a"), ("c", "C", "f")], "node name file")
    domains = spark.createDataFrame([("d0", "E", "get", True, [], [], [], False, ["v"])], "domain string, enum_fqn string, accessor string, complete boolean, external array<string>, unknown array<string>, literals array<string>, transformed boolean, values array<string>")
    got = G.field_lineage(reach, nodes, table(spark, [("op", "f", "set"), ("op", "g", "unused"), ("op", "h", None)], "operation field setter"), calls, sites, calls.where("false"), table(spark, [("op", f"p{i}", "d0") for i in range(4)], "operation slot domain"), domains).collect()
    got = {x["field"]: x for x in got}
    assert got["f"]["evidence"] == ["write:f:5:0:src", "chain:Op => C", "write:f:5:1:src", "write:f:5:2:src", "write:f:5:3:src"]
    assert (got["f"]["status"], got["f"]["unknowns"]) == ("known", ["unindexed setter call:f:6:2"])
    assert [got[x]["warning"] for x in "gh"] == ["no operation-reachable write site", "setter not indexed"]
    assert written["lineage"] < 50  # not the 600 rows of a setter that no field has
