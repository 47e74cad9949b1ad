"""Components, argument domains, as-of joins, verdicts and lineage against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contractlens.operators import graph as G
from contractlens.operators import relational as R
from contractlens.sources import readers as S


def closure(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for a in list(out):
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[a] = seen
    return reach


def plain_components(edges):
    reach = closure(edges)
    groups = {frozenset(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}
    return groups


def found_components(spark, edges):
    got = G.cyclic_components(spark.createDataFrame(edges, "source string, target string")).collect()
    assert len({r["node"] for r in got}) == len(got)
    groups = defaultdict(set)
    for r in got:
        groups[r["component"]].add(r["node"])
    return {frozenset(g) for g in groups.values()}


def test_components_are_those_of_a_plain_search(spark):
    for seed, n, m in ((2, 60, 75), (3, 8, 20)):
        r = random.Random(seed)
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
        assert found_components(spark, edges) == plain_components(edges), seed
    two = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "x"), ("x", "y"), (None, "a"), ("a", "b")]
    assert found_components(spark, two) == {frozenset("ab"), frozenset("cde"), frozenset("x")}
    assert found_components(spark, [("a", "b")]) == set() == found_components(spark, [])


def test_a_ring_of_ten_thousand_ends(spark):
    n = 10_000
    ring = spark.range(n).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), (F.col("id") + 1) % n).alias("target"))
    tail = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("source"), F.concat(F.lit("t"), F.col("id") + 1).alias("target"))
    got = G.cyclic_components(ring.union(tail)).agg(F.count("*").alias("n"), F.count_distinct("component").alias("c"), F.count_if(F.col("node").startswith("t")).alias("t")).first()
    assert tuple(got) == (n, 1, 0)


def plain_domains(slots, arguments, reach):
    out = set()
    for op in {r for r, _ in reach}:
        nodes = {n for r, n in reach if r == op}
        active = [a for a in arguments if a[0] in nodes and a[0] != a[1]]
        mine = {s for s, m in slots if m in nodes} | {a[2] for a in active}
        flows = {(a[3], a[2]) for a in active if a[3]}
        reached = closure(flows)
        seeds = {(a[2], a[4] or "unknown") for a in active if not a[3]}
        seeds |= {(s, "unknown") for s in mine - {a[2] for a in active}} | {(s, "unknown") for s in reached if s in reached[s]}
        out |= {(op, s, d) for s, d in seeds if s in mine} | {(op, t, d) for s, d in seeds for t in reached.get(s, ()) if t in mine}
    return out


def test_domains_within_the_reach_of_each_operation(spark):
    for seed in (1,):
        r = random.Random(seed)
        methods = [f"m{i}" for i in range(8)]
        slots = [(f"{m}.{i}", m) for m in methods for i in range(2)]
        arguments = []
        for _ in range(28):
            caller, (slot, method) = r.choice(methods), r.choice(slots)
            passed = r.choice([None, f"{caller}.{r.randrange(2)}", f"{caller}.{r.randrange(2)}"])
            arguments.append((caller, method, slot, passed, None if passed else r.choice(["A", "B", None])))
        reach = [(op, m) for op in ("x", "y", "z") for m in methods if r.random() < 0.7]
        got = G.propagate_domains(
            spark.createDataFrame(slots, "slot string, method string"), spark.createDataFrame(arguments, "caller string, method string, slot string, from_slot string, domain string"), spark.createDataFrame(reach, "root string, node string")
        ).collect()
        assert Counter(map(tuple, got)) == Counter(plain_domains(slots, arguments, reach)), seed


def test_calls_of_a_method_by_itself_bind_nothing(spark):
    slots = spark.createDataFrame([("a", "A"), ("x", "X")], "slot string, method string")
    calls = spark.createDataFrame([("M", "A", "a", None, "D"), ("A", "X", "x", "a", None), ("X", "X", "x", "x", None)], "caller string, method string, slot string, from_slot string, domain string")
    reach = spark.createDataFrame([("op", n) for n in "MAX"], "root string, node string")
    assert {tuple(r) for r in G.propagate_domains(slots, calls, reach).collect()} == {("op", "a", "D"), ("op", "x", "D")}


def test_nearest_and_as_of_rows_of_any_bucket(spark):
    r = random.Random(5)
    keys = ["hot"] * 300 + ["a", "b", None] * 20
    left = [(r.choice(keys), r.choice([None, *range(400)]), i % 50) for i in range(500)] + [("hot", 7, 1)] * 40 + [("none", 3, 0)]
    right = [(r.choice(keys), r.choice([None, *range(0, 400, 3)]), r.randrange(9)) for _ in range(250)]
    lf, rt = spark.createDataFrame(left, "k string, at int, tag int"), spark.createDataFrame(right, "k string, pos int, id int")
    near, last = [], []
    for k, at, tag in left:
        mine = [(p, i) for kk, p, i in right if kk == k and k is not None and None not in (p, at)]
        near.append((k, at, tag, min(mine, key=lambda x: (abs(x[0] - at), x[0], x[1]))[1] if mine else None))
        before = [x for x in mine if x[0] < at]
        last.append((k, at, tag, min(i for p, i in before if p == max(before)[0]) if before else None))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert Counter(map(tuple, R.nearest(lf, rt, ["k"], "at", "pos", "id").collect())) == Counter(near)
        assert Counter(map(tuple, R.as_of(lf, rt, ["k"], "at", "pos", "id").collect())) == Counter(last)
        # One key of all rows lies in several buckets.
        many = spark.range(20000).select(F.lit("k").alias("k"), F.col("id").alias("at"))
        got = R.as_of(many, many.where("at % 1000 = 0").select("k", F.col("at").alias("pos")), ["k"], "at", "pos", "pos").where("at > 0")
        assert got.where("last_pos <> floor((at - 1) / 1000) * 1000").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


SITE = "target string, position int, enum_fqn string, accessor string, complete boolean, external array<string>, unknown array<string>, literals array<string>, transformed boolean, values array<string>, evidence array<string>"


def test_verdicts_and_their_evidence(spark):
    many = [f"e{i:02}" for i in range(30)]
    rows = [
        ("closed", 2, "E", "get", True, [], [], [], False, ["x"], ["b"]), ("closed", 1, "E", "get", True, [], [], [], False, ["y"], ["c", "b"]),
        ("clash", 1, "B", "get", True, [], [], [], False, [], []), ("clash", 2, "A", "get", True, [], [], [], False, [], []),
        ("part", 1, "E", "get", False, [], ["hole"], [], False, [], many), ("ext", 1, None, None, False, ["rpc"], [], [], False, [], []),
        ("open", 1, None, None, False, ["rpc"], [f"u{i}" for i in range(9)], [], False, [], []), ("lit", 1, None, None, False, [], [], ["1"], False, [], []), ("changed", 1, "E", "get", True, [], [], [], True, [], []),
    ]
    got = {r["target"]: r for r in R.classify_domains(spark.createDataFrame(rows, SITE)).collect()}
    show = lambda t: (got[t]["status"], got[t]["enum_fqn"], got[t]["values"], got[t]["unknowns"], got[t]["warning"])
    assert show("closed") == ("closed", "E", ["y"], [], None) and got["closed"]["evidence"] == ["c", "b"] and got["closed"]["accessor"] == "get"
    assert show("clash") == ("known", "B", None, ["conflicting enum projections:B:A"], R.WARNINGS["known"])
    assert show("part")[0] == "known" and got["part"]["evidence"] == many[:20]
    assert show("ext") == ("external", None, None, [], R.WARNINGS["external"])
    assert show("open") == ("unresolved", None, None, ["u0", "u1", "u2", "u3"], "field domain unresolved: u0, u1, u2, u3")
    assert show("lit") == ("unresolved", None, None, [], "field domain unresolved")
    assert show("changed")[0] == "known"


def test_long_signatures_are_split_in_one_pass(spark):
    part = "Map<String, List<a.B<C, int[]>>> p"
    text = "void f(" + ", ".join(f"{part}{i}" for i in range(600)) + ")"
    assert len(text) > 20_000
    got = spark.createDataFrame([(text,), ("void g()",), ("x h(int a, B<C, D> b)",)], "s string").select(G.parameter_types(F.col("s")).alias("p")).collect()
    assert got[0]["p"] == ["Map<String, List<a.B<C, int[]>>>"] * 600 and got[1]["p"] == [] and got[2]["p"] == ["int", "B<C, D>"]
    odd = ["", "a", "a,b", "(a,b),c", "a>b,c", ",", "é<ü,ö>, ß"]
    want = [[""], ["a"], ["a", "b"], ["(a,b)", "c"], ["a>b", "c"], ["", ""], ["é<ü,ö>", "ß"]]
    assert [r["p"] for r in spark.createDataFrame([(x,) for x in odd], "s string").select(G.split_top_level(F.col("s")).alias("p")).collect()] == want


def test_roots_of_any_number_give_the_same_answer(spark, monkeypatch):
    r = random.Random(4)
    lines = [(i, 0, " ".join(f"/r{r.randrange(400)}/x" for _ in range(3))) for i in range(200)] + [(900, 0, "# /r1/x"), (901, 0, None), (902, 0, "")]
    roots = [(r.randrange(50), f"/r{i}") for i in range(400)] + [(0, ""), (1, None), (3, "/r1"), (2, "/r1")]
    want = {}
    for doc, _, line in lines:
        hit = [(o, x) for o, x in roots if x and line and not line.startswith("#") and x in line]
        want[doc] = min(hit)[1] if hit else None
    scan = lambda n: {x["doc_id"]: x["root"] for x in R.impact_scan(spark.createDataFrame(lines, "doc_id int, pos int, line string"), spark.createDataFrame(n, "ordinal int, root string")).collect()}
    assert scan(roots) == want
    monkeypatch.setattr(R, "ROOTS", 90)  # several automata
    assert scan(roots) == want
    assert set(scan([]).values()) == {None}


def test_tables_are_compared_by_buckets(spark):
    a = spark.range(3000).selectExpr("id", "if(id % 10 = 0, null, concat('x', id)) AS v", "if(id % 7 = 0, null, 'x') AS w")
    b = a.where("id <> 5").union(spark.sql("SELECT 7L, 'changed', 'x'")).union(a.where("id = 9"))
    want = lambda x, y: Counter([(*r, "previewed") for r in x.exceptAll(y).collect()] + [(*r, "fresh") for r in y.exceptAll(x).collect()])
    assert Counter(map(tuple, R.revalidate(a, b).collect())) == want(a, b)
    assert R.revalidate(a, a.orderBy(F.desc("id"))).count() == 0
    swapped = a.selectExpr("id", "w AS v", "v AS w")
    assert Counter(map(tuple, R.revalidate(a, swapped, 8).collect())) == want(a, swapped)


def test_publishing_survives_a_break_between_data_and_manifest(spark, tmp_path, monkeypatch):
    base, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(f'{{"id": {10 * i + k}}}' for k in range(4)))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source))
    real, calls = S._promote, []

    def broken(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed between data and manifest")
        real(*args)

    monkeypatch.setattr(S, "_promote", broken)
    with pytest.raises(Exception):
        S.publish_stream(stream, base, str(tmp_path / "checkpoint"), [F.col("id") >= 0]).awaitTermination(120)
    assert S.read_published(spark, base, stream.schema).count() == 4
    S.publish_stream(stream, base, str(tmp_path / "checkpoint"), [F.col("id") >= 0]).awaitTermination(120)
    got = [r["id"] for r in S.read_published(spark, base, stream.schema).collect()]
    assert sorted(got) == [10 * i + k for i in range(3) for k in range(4)]
    # A replay of the whole source changes nothing: the batches are promoted already.
    S.publish_stream(stream, base, str(tmp_path / "other"), [F.col("id") >= 0]).awaitTermination(120)
    assert S.read_published(spark, base, stream.schema).count() == 12
    # Published again, a snapshot is replaced; refused by a gate, it stays as it was.
    rows = spark.range(5).toDF("id")
    assert S.publish_snapshot(rows, base, "batch-0", [F.col("id") >= 0]) and not S.publish_snapshot(rows, base, "batch-0", [F.col("id") > 2])
    assert S.read_published(spark, base, stream.schema).where("snapshot = 'batch-0'").count() == 5
