"""Queries against their SQL twins, and operators on the cases that tables do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from contractlens.functions import columns as C
from contractlens.functions.coded import coded_values
from contractlens.operators import graph as G
from contractlens.operators import relational as R
from contractlens.plans import cases  # noqa: F401  registers its queries
from contractlens.plans import queries as Q
from contractlens.plans.views import view
from contractlens.sources import readers as S
from contractlens.streaming import edits as E

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(Q.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(norm(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in rel.fetchall())


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_functions(spark):
    lit = F.lit
    assert one(spark, C.upper_camel(lit("HTTPServer order-name2X"))) == "HTTPServerOrderName2X"
    assert [one(spark, C.lower_camel(lit(x))) for x in ("HTTPServer", "ID", "OrderName", "AB1Cd", "AB1", "x")] == ["httpServer", "id", "orderName", "ab1Cd", "aB1", "x"]
    assert one(spark, C.fallback_key(lit("orderStatus"), lit("-1"))) == "ORDER_STATUS_NEGATIVE_1"
    assert one(spark, C.redact(lit("see  https://u:p@h/a?x=1#y now"))) == "see https://***@h/a now"
    assert one(spark, C.normalize_path(lit("a/./b/../c"))) == "a/c"
    assert one(spark, C.compare_versions(lit("1.0.0-rc.2"), lit("1.0.0-rc.10"))) == "older"
    assert one(spark, C.compare_versions(lit("1.0.0"), lit("1.0.0-rc.1"))) == "newer"
    assert one(spark, C.repo_slug(lit("git+https://github.com/A/b.git"))) == "A/b"
    assert one(spark, C.resolve_ref(lit("src/a/x.ts"), lit("../b/y"))) == "src/b/y"
    assert one(spark, C.relative_ref(lit("src/a/x.ts"), lit("src/b/y.ts"))) == "../b/y"
    assert one(spark, C.is_safe_relative(lit("a/../b"))) is False and one(spark, C.is_safe_relative(lit("a/b"))) is True


def test_coded_values(spark):
    df = spark.createDataFrame([(1, "状态：1-待审 2/3-通过；", None, "Integer"), (2, "A:one B:two", None, "String"), (3, "just text", "1=x 2=y", "Integer"), (4, "1-only", None, "Integer")], "id int, comment string, annotation string, type string")
    got = {(r["id"], r["value"], r["label"]) for r in coded_values(df, "id").collect()}
    assert {(1, "1", "待审"), (1, "2", "通过"), (1, "3", "通过"), (2, "A", "one"), (2, "B", "two"), (3, "1", "x"), (3, "2", "y")} == got


def test_reachable_cycle(spark):
    e = spark.createDataFrame([("root", "a"), ("a", "b"), ("b", "root")], "source string, target string")
    roots = spark.createDataFrame([("root",)], "root string")
    got = {(r["node"], r["parent"], r["depth"]) for r in G.reachable(e, roots).collect()}
    assert got == {("root", None, 0), ("a", "root", 1), ("b", "a", 2)}
    with pytest.raises(ValueError, match="more than 2"):
        G.reachable(e, roots, max_nodes=2)
    assert {r["path"] for r in G.paths(G.reachable(e, roots), 2).collect()} == {"root", "root => a", "root => a => b"}


def test_reachable_does_not_stop_silently(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "root string")
    with pytest.raises(ValueError, match="beyond depth 1"):
        G.reachable(e, roots, 1)
    assert G.reachable(e, roots, 2).count() == 3 and G.reachable(e, roots, 1, partial=True).count() == 2
    assert {r["path"] for r in G.paths(G.reachable(e, roots)).collect()} == {"a", "a => b", "a => b => c"}


def test_closure_goes_around_the_cycle(spark):
    got = Q.QUERIES["g1_closure"](spark, DIR)
    assert got.agg(F.max("depth")).first()[0] > 4 and got.where("depth > 0 and node like 'nation:%'").count() > 0


def test_paths_inheritance_pairs_names(spark):
    f = spark.createDataFrame([("p", "list", "q", True), ("q", "back", "p", False), ("q", "leaf", None, False)], "schema string, field string, ref string, is_list boolean")
    assert {tuple(r) for r in G.expand_paths(spark.createDataFrame([("p",)], "root string"), f).collect()} == {("p", "", "p"), ("p", "list[]", "q")}
    cls = spark.createDataFrame([("B", "A"), ("A", None)], "class string, parent string")
    fl = spark.createDataFrame([("A", "x", 1, "int"), ("A", "y", 2, "int"), ("B", "x", 1, "long")], "class string, field string, pos int, type string")
    assert [(r["field"], r["type"]) for r in G.flatten_inheritance(cls, fl).where("root = 'B'").orderBy("position").collect()] == [("y", "int"), ("x", "long")]
    seeds = spark.createDataFrame([(1, ["order", "id"]), (2, ["user", "id"]), (3, ["name"])], "id int, parts array<string>")
    assert {r["id"]: r["name"] for r in G.shortest_unique_names(seeds, spark.sql("SELECT 'X' AS name")).collect()} == {1: "OrderId", 2: "UserId", 3: "Name"}
    s = spark.createDataFrame([("R", "a", "S"), ("S", "b", "T")], "schema string, field string, ref string")
    n = spark.createDataFrame([("R2", "a", "S2"), ("S2", "b", "T2")], "schema string, field string, ref string")
    assert {(r["old"], r["new"]) for r in G.pair_schemas(s, n, spark.sql("SELECT 'R' AS old, 'R2' AS new")).collect()} == {("R", "R2"), ("S", "S2"), ("T", "T2")}


def test_deep_graphs_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(10)], "source string, target string")
    roots = spark.createDataFrame([("n0",)], "root string")
    assert G.reachable(chain, roots, merge=4).agg(F.max("depth")).first()[0] == 10
    calls = chain.select(F.concat(F.lit("m"), "source").alias("caller"), F.concat(F.lit("m"), "target").alias("method"), F.col("target").alias("slot"), F.col("source").alias("from_slot"), F.lit(None).cast("string").alias("domain"))
    slots = chain.select(F.col("source").alias("slot"), F.concat(F.lit("m"), "source").alias("method"))
    within = slots.select(F.lit("op").alias("root"), F.col("method").alias("node"))
    with pytest.raises(ValueError, match="beyond 5 flows"):
        G.propagate_domains(slots, calls, within, 5)


def test_matching_by_words_loses_no_pair(spark):
    import random

    r = random.Random(2)
    words = ["Common", "Order", "User", "Price", "Room", "Hotel", "Detail"]
    names = lambda p: [(f"{p}{i}", "Common" + "".join(r.sample(words[1:], r.randint(0, 3))), r.choice("ab")) for i in range(40)]
    old, new = names("o"), names("n")
    ws = lambda x: {w.lower() for w in "".join(" " + c if c.isupper() else c for c in x).split()}
    want = set()
    for i, a, s in old:
        ranked = sorted(((s == t, len(ws(a) & ws(b)), j) for j, b, t in new if len(ws(a) & ws(b)) >= (1 if s == t else 2)), reverse=True)
        if ranked and (len(ranked) == 1 or ranked[0][:2] != ranked[1][:2]):
            want.add((i, ranked[0][2]))
    side = lambda rows: spark.createDataFrame(rows, "id string, name string, value_set string")
    assert {(x["old_id"], x["new_id"]) for x in R.match_by_words(side(old), side(new)).collect()} == want


def test_matching_by_words_squares_no_word(spark):
    """20,000 names on each side share one set and one word, 5,000 of them another one as well, and one a pair of its own."""
    side = lambda p, own: spark.range(20_000).select(F.concat(F.lit(p), "id").alias("id"), F.concat(F.lit("Common "), F.when(F.col("id") % 4 == 0, "Shared").when(F.col("id") == 7, "Lonely Pair").otherwise(F.concat(F.lit(own), "id"))).alias("name"), F.lit("a").alias("value_set"))
    extra = spark.createDataFrame([("o", "Single", None), ("p", "", "a"), ("q", None, "a"), ("r", "Single", "b")], "id string, name string, value_set string")
    got = R.match_by_words(side("o", "Old").union(extra), side("n", "New").union(extra)).collect()
    assert {tuple(x) for x in got} == {("o7", "n7", 3, True), ("o", "o", 1, True), ("r", "r", 1, True)}
    assert R.match_by_words(extra.where("false"), extra).count() == 0 and R.match_by_words(extra, extra.where("false")).count() == 0


def test_turn_stream_equals_batch(spark, tmp_path):
    rows = [("s", "t", i, i % 5 == 4, None if i % 5 == 4 else f"p{i % 3}", ["failed", "passed", "warning", "none", "failed"][(i // 5) % 5] if i % 5 == 4 else None, i == 24) for i in range(60)]
    ev = spark.createDataFrame(rows, "session_id string, turn_id string, event_id long, stop boolean, path string, status string, continued boolean")
    ev.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = E.close_turns_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = [tuple(r) for r in spark.table("turns").orderBy("stop_id").collect()]
    assert got == [tuple(r) for r in E.close_turns(ev).orderBy("stop_id").collect()]
    assert [r[4] for r in got][:4] == ["block", "silent", "message", "message"]


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks columns: y, z"):
        R.require_columns(spark.range(1), ["id", "z", "y"], "t")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("one\ntwo")
    (tmp_path / "a/y.bin").write_text("no")
    assert [r["line"] for r in S.read_text_tree(spark, str(tmp_path / "a"), ["txt"], ["skip"]).orderBy("pos").collect()] == ["one", "two"]
    doc = '{"paths":{"/a":{"get":{"operationId":"op"}}},"components":{"schemas":{"S":{"properties":{"c":{"type":"string","enum":["x","y"]},"r":{"$ref":"#/T"}}}}}}'
    got = S.flatten_contracts(spark.createDataFrame([("app", doc)], "app string, text string"))
    assert [(r["path"], r["operation_id"]) for r in got["operations"].collect()] == [("/a", "op")]
    assert {(r["property"], r["ref"]) for r in got["properties"].collect()} == {("c", None), ("r", "#/T")}
    assert [r["value"] for r in got["values"].orderBy("position").collect()] == ["x", "y"]
    (tmp_path / "e.json").write_text('{"hook_event_name":"Stop","session_id":"s"}\nbroken\n')
    assert [r["session_id"] for r in S.read_events(spark, str(tmp_path / "e.json")).collect()] == ["s", None]
    df, base = spark.range(5), str(tmp_path / "pub")
    assert S.publish_snapshot(df, base, "s1", [F.col("id") >= 0]) and not S.publish_snapshot(df, base, "s2", [F.col("id") > 0])
    assert S.read_published(spark, base, df.schema).select("snapshot").distinct().count() == 1


def test_files_left_out_are_never_opened(spark, tmp_path):
    kept = ["a/x.txt", "a b+c%20/ü.txt", "notskip me/k.txt"]
    for path in [*kept, "skip me/x.txt", "a/skip me/b/x.txt", "a/x.md", "a/big.txt", "a/yarn.lock", "a/old.txt~"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("one" if "big" not in path else "long" * 100)
    df = S.read_text_tree(spark, str(tmp_path), ["txt", "lock", "txt~"], ["skip me"], 100)
    got = df.collect()
    assert {r["path"].split(str(tmp_path) + "/")[1] for r in got} == set(kept) and {r["line"] for r in got} == {"one"}
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().get("numFiles").get().value() == len(kept)


def test_stream_equals_batch(spark, tmp_path):
    ev = view(spark, DIR, "hook")
    ev.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timeouts would keep it running
    q = E.track_edits(stream).writeStream.format("memory").queryName("edits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("edits").collect()}
    assert got and got == {tuple(r) for r in E.track_edits_batch(ev).select(*E.KEY, "event_id", "changed", "path").collect()}
