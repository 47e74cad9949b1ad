"""Queries whose inputs take every branch of an operator: cases dealt over the rows of the given tables by their keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.functions import columns as C
from contractlens.operators import graph as G
from contractlens.operators import relational as R
from contractlens.plans.queries import ORACLES, PAIRED, QUERIES, T, query
from contractlens.plans.views import as_sql, view
from contractlens.sources import readers as S
from contractlens.sources.scratch import materialize, scratch_path
from contractlens.streaming import edits as E

c, lit = F.col, F.lit


def literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def dealt(s, d, rows: list[tuple]) -> DataFrame:
    """part's keys, each with one of the rows as x0, x1, .."""
    n = len(rows)
    pick = [F.get(F.array(*[lit(r[i]) for r in rows]), (c("p_partkey") % n).cast("int")).alias(f"x{i}") for i in range(len(rows[0]))]
    return T(s, d, "part").select("p_partkey", *pick)


def chosen(values: list) -> str:
    """SQL for the one of some values that a part's key is dealt."""
    return f"list_extract([{', '.join(map(literal, values))}], CAST(p_partkey % {len(values)} + 1 AS BIGINT))"


def cases(name: str, out: str, rows: list[tuple], want: list, f) -> None:
    """Registers f's column over the rows, and what is to come of each."""
    inputs = [r if isinstance(r, tuple) else (r,) for r in rows]

    def run(s, d):
        df = dealt(s, d, inputs)
        return df.select("p_partkey", f(*[c(f"x{i}") for i in range(len(inputs[0]))]).alias(out))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT p_partkey, {chosen(want)} AS {out} FROM part"


def flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def comma(x: Column) -> Column:
    return F.array_join(x, ",")


cases("f1_strip_dates", "t", ["at 2024-01-05 x", "2024/1/5 gone\nkept", "in yyyy-MM-dd or HH:mm:ss", "on 3-4 10:30 go", "12:30 sharp", "1-2 things", "  7-8 9:05 gone\nHH:mm gone\nlast", "v2024-1-5"], ["at x", "kept", "in or", "on go", "sharp", "1-2 things", "last", "v2024-1-5"], lambda x: flat(C.strip_dates(x)))
cases("f3_value_kind", "kind", ["java.lang.Integer", "Long", "Foo", "LocalDate", "java.util.Date", "BigDecimal", "boolean", "Instant", "char", "LocalDateTime", "Timestamp"], ["number", "string", None, "string", "string", "number", None, "string", "string", "string", "string"], C.value_kind)
cases("f8_catalogue_type", "kind", ["java.time.LocalDate", "BigDecimal", "Boolean", "void", "java.lang.String", "BigInteger", "x.Y", "short"], ["string", "number", "boolean", "null", "string", "string", None, "number"], C.catalogue_type)
cases("f13_doc_links", "links", ["see {@link AEnum#x} and AEnum", "{@link p.Q} or {@link B}", "none", "BEnum, p.CEnum!"], ["AEnum", "B,p.Q", "", "BEnum,p.CEnum"], lambda x: comma(C.doc_links(x)))
GOOD, FAIL = " Test Files  2 passed (2)\n      Tests  5 passed (5)\n", "ERROR: Coverage for lines (70%) does not meet global threshold (80%)"
cases("f16_coverage_only", "flag", [(GOOD, FAIL, 1, None), (GOOD.replace("2 passed (2)", "1 passed (2)"), FAIL, 1, None), (GOOD, "", 1, None), (GOOD, FAIL, 0, None), (GOOD, FAIL, 1, "boom"), (GOOD + FAIL, "", 2, None)], [True, False, False, False, False, True], lambda a, b, n, e: C.coverage_only_failure(a, b, n, e.cast("string"), lit(None).cast("string")))
cases("f16_clean_test_log", "t", ["a\nCoverage enabled with v8\nb", f"a\n  {FAIL}\n\n\n\nb\n", "ERROR: Uncovered lines (3) exceed global threshold (1)\nx", "ERROR: other"], ["a\nb", "a\n\nb", "x", "ERROR: other"], C.clean_test_log)
cases("f15_threshold_cases", "failures", [FAIL, FAIL + " for src/a.ts\n" + FAIL, "ERROR: Uncovered branches (12) exceed per-file threshold (3)", "x\n" + FAIL + "\n" + FAIL, "ERROR: Coverage for lines fell"], ["All files lines 70 80", "src/a.ts lines 70 80,All files lines 70 80", "per-file uncovered branches 12 3", "All files lines 70 80", ""], lambda x: comma(F.transform(C.threshold_failures(x), lambda f: F.concat_ws(" ", f["scope"], f["metric"], f["actual"], f["expected"]))))
R1 = {"httpToScfFilterConfig": {"interfaceName": "com.x.Order", "methodSignature": "run(int)"}, "httpMethod": "post", "httpPath": "/a"}
ROUTES = [R1, {"scfMethodPath": "/com.y.User/get(java.lang.String)", "httpMethod": "GET", "httpPath": "/b", "httpHost": "h"}, {"httpToScfFilterConfig": {"interfaceName": "A"}, "scfMethodPath": "z.B/m(x)", "httpMethod": "put", "httpPath": "/c"}, {"scfMethodPath": "/B", "httpMethod": "put", "httpPath": "/c"}, {"scfMethodPath": "/B/m", "httpMethod": "put"}]
cases("f20_normalize_route", "route", [*map(json.dumps, ROUTES), "bad"], ["Order|run|POST|/a", "User|get|GET|/b|h", "A|m|PUT|/c", None, None, None], lambda x: F.when(C.normalize_route(x).isNotNull(), F.concat_ws("|", *[C.normalize_route(x)[n] for n in ("interface", "method", "http_method", "path", "host")])))
ENUMS = ["export const X = {\n  A: 'a',\n  B: 2,\n} as const\n", "const Y = {\n  A: 'a',\n} as const", "export const Z = {\n  Q: 'it\\'s',\n  R: \"x\",\n  S: -1,\n}  as const;\nother: 'no',\n", "export const W = {\n  A: 1,\n  B: 1,\n} as const", "export const V = {\n  A: 1.5,\n  B: 'x'\n} as const", "export const P = {\n  A: 1,\n} as const\nexport const Q = {\n  B: 2,\n} as const", "export const U = {\n  A: 1,\n}"]
cases("f23_exported_enums", "members", ENUMS, ["X:n:2=B,X:s:a=A", "", "Z:n:-1=S,Z:s:it\\'s=Q,Z:s:x=R", "W:n:1=B", "", "P:n:1=A,Q:n:2=B", ""], lambda x: comma(F.transform(C.exported_enums(x), lambda m: F.concat(m["constant"], lit(":"), m["wire"], lit("="), m["member"]))))
cases("f23_exported_symbols", "symbols", ["export interface A {}\nexport declare const b: x\nexport function f() {}\nexport type T<X> = 1\nimport c\n", " export const no = 1", "export enum E {}\nexport class E {}\nexport default E"], ["A,T,b", "", "E"], lambda x: comma(C.exported_symbols(x)))
cases("f24_enum_seed", "seed", [("com.x.OrderStatusEnum", "getStatusCode", "f"), ("A.TypeEnum", "getType", "f"), ("A.B", "isOpen", "f"), ("A.B", "get", "orderKind"), ("A.B", "value", "code")], ["com.x.OrderStatusCode", "A.Type", "A.BOpen", "A.BOrderKind", "A.BCode"], lambda o, a, f: F.array_join(C.enum_seed(o, a, f), "."))
cases("f7_parameter_types", "types", ["void save(Map<String, Integer> m, final Long[] ids)", "int f()", "X g(a.B<C<D>> x)", "X h(noName)"], ["Map<String, Integer>|final Long[]", "", "a.B<C<D>>", ""], lambda x: F.array_join(G.parameter_types(x), "|"))
MEANT = [("a.createTime", None), ("x.timezoneName", None), ("d", "date"), ("birthdate", None), ("userEmail", None), ("pictureX", None), ("siteUrl", None), ("tag", None), ("homePhone", None), ("orderId", None), ("x.y", "date-time"), ("to", "email")]
cases("m2_semantic_value", "v", MEANT, [C.SAMPLE_TIME, C.SAMPLE_NAME, C.SAMPLE_DATE, C.SAMPLE_DATE, C.SAMPLE_EMAIL, C.SAMPLE_IMAGE, C.SAMPLE_URL, "MOCK_TAG_0007", "13800000007", "100007", C.SAMPLE_TIME, C.SAMPLE_EMAIL], lambda p, f: C.semantic_value(p, f.cast("string"), lit(7).cast("long")))
JSONS = ['{"a":{"k":"x"},"k":"y"}', '{"a":[1,{"k":{"z":1}}]}', "not json", '{"k":[1,2]}', '{"b":{"c":{"k":"deep"}},"a":{"k":null}}', '{"a":1}', '[{"k":7}]']


@query(f"SELECT p_partkey, {chosen(['y', '{"z":1}', None, '[1,2]', 'deep', None, '7'])} AS value FROM part")
def f19_find_key(s, d):
    return R.find_key(dealt(s, d, [(x,) for x in JSONS]), "p_partkey", "x0", "k")


cases("f19_all_refs", "refs", ['{"$ref":"#/a","x":[{"$ref":"#/b"},{"$ref":"#/a"}]}', "{", "{}"], ["#/a,#/b", None, ""], lambda x: comma(C.all_refs(x)))


@query("SELECT p_partkey, concat('{\"code\":0,\"data\":{\"n\":', p_size, '}}') AS body, concat('{\"status\":\"OK\",\"result\":', p_size, '}') AS text FROM part")
def m3_envelope(s, d):
    n = c("p_size")
    return T(s, d, "part").select("p_partkey", R.envelope(F.to_json(F.struct(n.alias("n"))), "code", "data", "0").alias("body"), R.envelope(n.cast("string"), "status", "result", "OK").alias("text"))


# --- sources ---------------------------------------------------------------------------------------------------------
@query("SELECT 'region lacks columns: nope, zz' AS error, COUNT(*) AS rows FROM region")
def s2_require_columns(s, d):
    region = T(s, d, "region")
    try:
        R.require_columns(region, ["r_name", "zz", "nope"], "region")
    except ValueError as e:
        return R.require_columns(region, ["r_name"], "region").agg(lit(str(e)).alias("error"), F.count("*").alias("rows"))


@query("SELECT p_partkey, 'operation' AS what, concat('/p/', p_partkey, ' get op', p_partkey) AS value FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'property', concat('S.', lower(p_type), ' string') FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'value', concat('0 ', p_brand) FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'patch', concat('f closed ', p_size) FROM part WHERE p_partkey % 7 <> 0")
def s5_flatten_contracts(s, d):
    t = F.format_string('{"paths":{"/p/%d":{"get":{"operationId":"op%d","x-patches":[{"field":"f","status":"closed","values":["%d"]}]}}},"components":{"schemas":{"S":{"properties":{"%s":{"type":"string","enum":["%s"]}}}}}}', "p_partkey", "p_partkey", "p_size", F.lower("p_type"), "p_brand")
    docs = T(s, d, "part").select(c("p_partkey").alias("app"), F.when(c("p_partkey") % 7 == 0, "{broken").otherwise(t).alias("text"))
    parts = S.flatten_contracts(docs)
    rows = lambda n, *x: parts[n].select(c("app").alias("p_partkey"), lit(n[:-1] if n != "properties" else "property").alias("what"), F.concat_ws(" ", *x).alias("value"))
    return rows("operations", "path", "http_method", "operation_id").union(rows("properties", F.concat_ws(".", "schema", "property"), "type")).union(rows("values", "position", "value")).union(rows("patches", "field", "status", comma(c("values")))).withColumn("what", F.when(c("what") == "patche", "patch").otherwise(c("what")))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(user_id AS VARCHAR) END AS session, COUNT(*) AS n FROM events GROUP BY 1")
def s7_parse_events(s, d):
    ok = F.to_json(F.struct(lit("Stop").alias("hook_event_name"), c("user_id").cast("string").alias("session_id")))
    long = F.concat(lit('{"session_id":"'), F.repeat(lit("x"), 70000), lit('"}'))
    lines = T(s, d, "events").select(F.when(c("event_id") % 10 == 0, "broken {").when(c("event_id") % 10 == 5, long).otherwise(ok).alias("value"))
    return S.parse_events(lines).groupBy(c("session_id").alias("session")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS line, COUNT(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT '', 1")
def s4_read_text_tree(s, d):
    base, names = scratch_path(s, "tree"), T(s, d, "nation").select("n_name").coalesce(1)
    names.write.text(f"{base}/keep")  # one file of lines that end in a line feed
    names.write.text(f"{base}/node_modules/x")
    names.write.option("compression", "gzip").text(f"{base}/packed")
    return S.read_text_tree(s, base, ["txt"], ["node_modules"]).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part")
def s8_publish(s, d):
    p, base = T(s, d, "part").select("p_partkey", "p_name"), scratch_path(s, "published")
    promoted = S.publish_snapshot(p, base, "good", [c("p_partkey") >= 0]), S.publish_snapshot(p.where("p_partkey % 2 = 0"), base, "bad", [c("p_partkey") < 0])
    return S.read_published(s, base, p.schema).where(lit(promoted == (True, False))).select("p_partkey", "p_name")


MANIFEST = [("h1", "h1", None), ("h1", None, None), ("h1", "h2", "h2"), ("h1", "h2", "h3"), (None, "h1", "h1"), (None, "h2", "h1"), (None, None, "h1"), ("h1", "h1", "h1"), (None, None, None)]


@query(f"SELECT * FROM (SELECT p_partkey AS path, {chosen(['unchanged', 'create', 'overwrite', 'conflict', 'remove_stale', 'conflict_stale', 'already_gone', 'unchanged', None])} AS action FROM part) WHERE action IS NOT NULL")
def s9_reconcile_manifest(s, d):
    p = dealt(s, d, [tuple(r) for r in MANIFEST]).withColumnRenamed("p_partkey", "path")
    side = lambda x: p.where(f"{x} is not null").select("path", c(x).cast("string").alias("hash"))
    return R.reconcile_manifest(side("x0"), side("x2"), side("x1"))


# --- joins and aggregates --------------------------------------------------------------------------------------------
@query("SELECT concat('region:', n_regionkey) AS parent, concat('nation:', n_nationkey) AS child, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, length(n_name), n_name) AS position FROM nation")
def j2_contained_order(s, d):
    k = F.substring_index("id", ":", -1).cast("int")
    nodes = view(s, d, "nodes").withColumn("start_line", k % 3).withColumn("start_column", F.length("name"))
    return R.contained(view(s, d, "edges"), nodes, "nation").select("parent", "child", "position")


CALLS = [(None, "run", 1, True), ("this", "run", 1, True), ("this.dep", "go", 0, True), ("Helper", "go", 0, True), ("arg", "go", 0, True), ("loc", "go", 0, True), ("make()", "go", 0, True), ("nobody", "go", 0, True), ("Helper", "two", 1, True), ("Helper", "two", 9, False)]


@query(f"SELECT p_partkey, {chosen(['run', 'run', 'go', 'go', 'go', 'go', None, None, 'two1', None])} AS method_id FROM part")
def j4_resolve_receivers(s, d):
    x = dealt(s, d, CALLS).withColumns({"receiver": c("x0").cast("string"), "name": c("x1"), "arity": c("x2"), "exact": c("x3")})
    calls = x.select(c("p_partkey").alias("call_id"), lit("f").alias("file"), lit("C").alias("class_id"), lit("a.C").alias("scope"), lit("a").alias("package"), lit("m").alias("method"), "receiver", "name", "arity", "exact", lit(50).alias("at"))
    t = lambda rows, schema: s.createDataFrame(rows, schema)
    types = t([("C", "a.C", "C"), ("H", "a.Helper", "Helper"), ("O", "z.Other", "Other")], "id string, fqn string, simple string")
    variables = t([("f", "loc", 10, "Other"), ("f", "loc", 40, "Helper"), ("f", "loc", 60, "Other")], "file string, name string, at int, type string")
    owners = R.resolve_receivers(calls, t([("m", "arg", "Helper<X>")], "method string, name string, type string"), t([("C", "dep", "a.Helper")], "class_id string, name string, type string"), variables, types, t([("f", "q.Q")], "file string, fqn string"))
    methods = t([("run", "C", "run", 1), ("go", "H", "go", 0), ("two1", "H", "two", 1), ("two2", "H", "two", 2)], "id string, owner string, name string, arity int")
    return R.resolve_calls(owners, methods).select(c("call_id").alias("p_partkey"), "method_id")


@query("SELECT p_partkey AS ref_id, " + chosen(["T1", "T2", "T3", "T4", "T5", None]) + " AS type_id FROM part")
def j3_resolve_tiers(s, d):
    k = c("p_partkey")
    names = [("a.b.One",), ("Imported",), ("Inner",), ("Near",), ("Lone",), ("Twice",)]
    refs = dealt(s, d, names).select(k.alias("ref_id"), c("x0").alias("name"), F.concat(lit("f"), k).alias("file"), lit("a.b.Outer").alias("scope"), lit("a.b").alias("package"))
    types = s.sql("SELECT * FROM VALUES ('T1', 'a.b.One', 'One'), ('T2', 'q.Imported', 'Imported'), ('TX', 'a.b.Imported', 'Imported'), ('T3', 'a.b.Outer.Inner', 'Inner'), ('TY', 'a.b.Inner', 'Inner'), ('T4', 'a.b.Near', 'Near'), ('TZ', 'z.Near', 'Near'), ('T5', 'z.Lone', 'Lone'), ('T6', 'z.Twice', 'Twice'), ('T7', 'y.Twice', 'Twice') AS t(id, fqn, simple)")
    return R.resolve_names(refs, types, refs.select("file", lit("q.Imported").alias("fqn"))).select("ref_id", "type_id")


@query("SELECT event_id, (SELECT arg_min(v.event_id, [abs(v.event_id - e.event_id), v.event_id]) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view') AS nearest_id FROM events e WHERE event_type = 'click'")
def j9_nearest(s, d):
    e = T(s, d, "events").select("event_id", "user_id", "event_type")
    left = e.where("event_type = 'click'").select("user_id", "event_id")
    right = e.where("event_type = 'view'").select("user_id", c("event_id").alias("at"), c("event_id").alias("view_id"))
    return R.nearest(left, right, ["user_id"], "event_id", "at", "view_id").select("event_id", "nearest_id")


@query("SELECT name, status, detail FROM (SELECT concat('n', p_partkey) AS name, CASE p_partkey % 3 WHEN 0 THEN 'installed' WHEN 1 THEN 'version-mismatch' ELSE 'missing' END AS status, CASE p_partkey % 3 WHEN 1 THEN concat('expected 1.0.', p_size, ', got 0.9.0') WHEN 2 THEN 'listing broke' END AS detail FROM part)")
def j12_reconcile_detail(s, d):
    e = T(s, d, "part").select(F.concat(lit("n"), "p_partkey").alias("name"), F.concat(lit("1.0."), "p_size").alias("version"), (c("p_partkey") % 3).alias("k"))
    actual = e.where("k < 2").select("name", F.when(c("k") == 0, c("version")).otherwise("0.9.0").alias("version"))
    return R.reconcile(e.select("name", "version"), actual, "listing broke").select("name", "status", "detail")


@query("SELECT p_partkey AS target, 1 AS wire, CASE WHEN p_partkey % 3 = 0 THEN concat('a', p_partkey) WHEN p_partkey % 3 = 1 THEN concat('i', p_partkey) ELSE concat('a', p_partkey) END AS new_member FROM part")
def j14_map_members(s, d):
    k = c("p_partkey")
    p = T(s, d, "part").select(k.alias("target"), lit(1).alias("wire"), F.concat(lit("m"), k).alias("member"), (k % 3).alias("case"))
    own = p.where("case <> 1").select("target", "wire", F.concat(lit("a"), "target").alias("member"))
    other = p.where("case >= 1").select((c("target") + 10**9).alias("target"), "wire", F.concat(lit("i"), "target").alias("member"))
    inferred = p.where("case >= 1").select("target", (c("target") + 10**9).alias("new_target"))
    return R.map_members(p.select("target", "wire", "member"), own.union(other), inferred).select("target", "wire", "new_member")


LINES = ["# nvm use 1", "cd ~/.tool/bin", "run $HOME/.tool", "nvm use 18", "echo $NVM_DIR", "plain", "${HOME}/other here", "  # ~/.tool"]


@query(f"SELECT p_partkey AS doc_id, {chosen(['unaffected', 'affected', 'affected', 'affected', 'uncertain', 'unaffected', 'affected', 'unaffected'])} AS impact, {chosen([None, '/home/user/.tool/bin', '/home/user/.tool', None, None, None, '/home/user/other', None])} AS root FROM part")
def j15_impact_cases(s, d):
    lines = dealt(s, d, [(x,) for x in LINES]).select(c("p_partkey").alias("doc_id"), lit(0).alias("pos"), c("x0").alias("line"))
    roots = s.sql("SELECT * FROM VALUES (1, '/home/user/.tool/bin'), (2, '/home/user/.tool'), (3, '/home/user/other') AS t(ordinal, root)")
    return R.impact_scan(lines, roots).select("doc_id", "impact", "root")


@query(f"SELECT p_partkey AS doc_id, {chosen([None, '/home/user/.tool/bin', '/home/user/.tool', None, None, None, '/home/user/other', None])} AS root FROM part")
def j15_impact_many_roots(s, d):
    lines = dealt(s, d, [(x,) for x in LINES]).select(c("p_partkey").alias("doc_id"), lit(0).alias("pos"), c("x0").alias("line"))
    roots = s.sql("SELECT * FROM VALUES (1, '/home/user/.tool/bin'), (2, '/home/user/.tool'), (3, '/home/user/other') AS t(ordinal, root)").union(s.range(300).selectExpr("id + 9", "concat('zz', id)"))
    return R.impact_scan(lines, roots).select("doc_id", "root")


@query("""SELECT impact, coalesce(root, '') AS root, COUNT(*) AS n FROM (SELECT CASE WHEN note THEN 'unaffected' WHEN root IS NOT NULL OR contains(line, 'fnm use') THEN 'affected' WHEN contains(line, '.fnm') THEN 'uncertain' ELSE 'unaffected' END AS impact, root
FROM (SELECT line, starts_with(trim(line), '#') AS note, CASE WHEN NOT starts_with(trim(line), '#') THEN (SELECT min_by(r, [o, k]) FROM (SELECT concat('/home/user/c', p_partkey) AS r, -p_size AS o, p_partkey AS k FROM part) WHERE contains(line, r)) END AS root
FROM (SELECT concat(CASE o_orderkey % 7 WHEN 0 THEN '# ' ELSE '' END, 'run /home/user/c', o_custkey, CASE o_orderkey % 5 WHEN 0 THEN '/npm' WHEN 1 THEN ' fnm use' WHEN 2 THEN ' nvm use' WHEN 3 THEN ' .fnm' ELSE '' END) AS line FROM orders)
WHERE contains(line, '/npm') OR contains(line, '.fnm') OR contains(line, 'fnm use') OR contains(line, 'nvm use'))) GROUP BY ALL""".replace("min_by(r, [o, k])", "min_by(r, struct_pack(o := o, r := r))"))
def j15_impact_candidates(s, d):
    """One root for each part, first by size: as many automaton words as parts, over a line for each order."""
    o = c("o_orderkey")
    end = F.when(o % 5 == 0, "/npm").when(o % 5 == 1, " fnm use").when(o % 5 == 2, " nvm use").when(o % 5 == 3, " .fnm").otherwise("")
    lines = T(s, d, "orders").select(o.alias("doc_id"), lit(0).alias("pos"), F.concat(F.when(o % 7 == 0, "# ").otherwise(""), lit("run ~/c"), "o_custkey", end).alias("line"))
    roots = T(s, d, "part").select((-c("p_size")).alias("ordinal"), F.concat(lit("/home/user/c"), "p_partkey").alias("root"))
    return R.impact_scan(lines, roots, ("fnm",), True).groupBy("impact", F.coalesce("root", lit("")).alias("root")).agg(F.count("*").alias("n"))


@query("""SELECT target, CASE WHEN clean AND n = 1 THEN 'closed' WHEN f IS NOT NULL THEN 'known' WHEN ext THEN 'external' ELSE 'unresolved' END AS status, f.e AS enum_fqn, CASE WHEN clean AND n = 1 THEN f.v END AS vals, coalesce(u, '') AS unknowns, coalesce(ev, '') AS evidence,
CASE WHEN clean AND n = 1 THEN NULL WHEN f IS NOT NULL THEN 'enum evidence does not prove a complete field domain' WHEN ext THEN 'field value stops at an external boundary' ELSE concat('field domain unresolved', coalesce(': ' || replace(u, '|', ', '), '')) END AS warning
FROM (SELECT target, first(struct_pack(e := e, v := v) ORDER BY p) FILTER (e IS NOT NULL) AS f, bool_and(e IS NOT NULL AND whole AND unk IS NULL AND e2 IS NULL AND NOT changed) AS clean, bool_and(e2 IS NOT NULL AND unk IS NULL AND NOT changed) AS ext, count(DISTINCT e) AS n FROM sites GROUP BY 1)
LEFT JOIN (SELECT target, array_to_string(list(x ORDER BY x)[1:4], '|') AS u FROM (SELECT target, unk AS x FROM sites WHERE unk IS NOT NULL UNION SELECT target, concat('conflicting enum projections:', one, ':', e) FROM (SELECT target, e, first_value(e) OVER (PARTITION BY target ORDER BY p) AS one FROM sites WHERE e IS NOT NULL) WHERE e <> one) GROUP BY 1) USING (target)
LEFT JOIN (SELECT target, array_to_string(list(x ORDER BY p, x)[1:20], '|') AS ev FROM (SELECT target, concat('write:', p % 500) AS x, min(p) AS p FROM sites GROUP BY 1, 2) GROUP BY 1) USING (target)""", "sites")
def a3_domain_verdicts(s, d):
    none = F.array().cast("array<string>")
    one = lambda x: F.when(c(x).isNull(), none).otherwise(F.array(x))
    site = view(s, d, "sites").select("target", c("p").alias("position"), c("e").alias("enum_fqn"), F.when(c("e").isNotNull(), "get").alias("accessor"), c("whole").alias("complete"), one("e2").alias("external"), one("unk").alias("unknown"), none.alias("literals"), c("changed").alias("transformed"), one("v").alias("values"), F.array(F.concat(lit("write:"), c("p") % 500)).alias("evidence"))
    text = lambda n: F.array_join(n, "|").alias(n)
    return R.classify_domains(site).select("target", "status", "enum_fqn", comma(c("values")).alias("vals"), text("unknowns"), text("evidence"), "warning")


@query("SELECT c_custkey, CASE WHEN n = 0 THEN 'code' ELSE a END AS a, CASE WHEN n = 0 THEN 'data' ELSE b END AS b FROM (SELECT c_custkey, COUNT(o_orderkey) AS n, arg_max(o_orderstatus, concat(lpad(m::varchar, 6, '0'), o_orderstatus, o_orderpriority)) AS a, arg_max(o_orderpriority, concat(lpad(m::varchar, 6, '0'), o_orderstatus, o_orderpriority)) AS b FROM (SELECT c_custkey, o_orderkey, o_orderstatus, o_orderpriority, COUNT(o_orderkey) OVER (PARTITION BY c_custkey, o_orderstatus, o_orderpriority) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY 1)")
def a4_dominant_default(s, d):
    j = T(s, d, "customer").select("c_custkey").join(T(s, d, "orders"), c("o_custkey") == c("c_custkey"), "left").select("c_custkey", c("o_orderstatus").alias("a"), c("o_orderpriority").alias("b"))
    return R.dominant_pair(j, ["c_custkey"], "a", "b", ("code", "data"))


@query("SELECT p_brand, CASE WHEN n % 4 = 0 THEN 'a/b' WHEN n % 4 = 1 THEN 'a/b/share' WHEN n % 4 = 2 THEN 'a/share' ELSE 'share' END AS prefix FROM (SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INT) AS n FROM part)")
def a5_common_prefix(s, d):
    n = F.split("p_brand", "#")[1].cast("int") % 4
    paths = F.when(n == 0, F.array(lit("a/b"))).when(n == 1, F.array(lit("a/b"), lit("a/b/c"))).when(n == 2, F.array(lit("/a/b/c"), lit("/a//x/c"))).otherwise(F.array(lit("a/b"), lit("z/b")))
    return R.common_prefix(T(s, d, "part").select("p_brand", F.explode(paths).alias("path")), "p_brand", "path")


@query("""SELECT run, rank, text FROM (SELECT run, row_number() OVER (PARTITION BY run ORDER BY ordinal) AS rank, concat(file, ':', CASE line WHEN 0 THEN 1 ELSE line END, ':', col, ' error', ' [', rule, '] m') AS text FROM dg WHERE severity = 2) WHERE rank <= 50
UNION ALL SELECT run, least(e, 50) + 1, concat('... ', e + 2 - least(e, 50), ' additional diagnostic(s) omitted') FROM (SELECT run, COUNT(*) FILTER (severity = 2) AS e FROM dg GROUP BY run)""".replace("FROM dg", "FROM (SELECT file AS run, file, line, col, severity, rule, concat(lpad(line::varchar, 9, '0'), col, '-', l_suppkey, '-', l_extendedprice) AS ordinal FROM diag)"), "diag")
def a6_diagnostic_lines(s, d):
    g = view(s, d, "diag").select(c("file").alias("run"), F.concat_ws("-", F.concat(F.lpad(c("line").cast("string"), 9, "0"), c("col").cast("string")), "l_suppkey", "l_extendedprice").alias("ordinal"), "file", "line", c("col").alias("column"), "severity", "rule", lit("m").alias("message"))
    return R.diagnostic_lines(g, g.groupBy("run").agg((F.count_if(c("severity") == 2) + 2).alias("error_count")))


@query("""SELECT file, rank, note, omitted FROM (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line, col, rule, l_suppkey, l_extendedprice) AS rank, NULL AS note, greatest(COUNT(*) OVER (PARTITION BY file) - 50, 0) AS omitted FROM diag) WHERE rank <= 50
UNION ALL SELECT file, 51, concat('... ', COUNT(*) - 50, ' additional diagnostic(s) omitted'), COUNT(*) - 50 FROM diag GROUP BY file HAVING COUNT(*) > 50""", "diag")
def l2_omitted_row(s, d):
    g = view(s, d, "diag").withColumn("note", lit(None).cast("string"))
    return R.cap_with_omitted(g, ["file"], [c(x) for x in ("line", "col", "rule", "l_suppkey", "l_extendedprice")], 50, "note").select("file", "rank", "note", c("omitted").cast("long").alias("omitted"))


@query("""SELECT run, file, error, lines, position FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY file <> 'All files', file) - 1 AS position FROM (
SELECT p_brand AS run, 'All files' AS file, NULL AS error, 'Unknown' AS lines FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INT) % 3 <> 0 GROUP BY p_brand
UNION ALL SELECT p_brand, concat('f', lpad(p_partkey::varchar, 7, '0')), CASE WHEN p_partkey % 4 = 2 THEN 'invalid metrics' END, CASE WHEN p_partkey % 4 = 1 THEN '50.5' WHEN p_partkey % 4 = 3 THEN 'Unknown' END FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INT) % 3 <> 0 AND p_partkey % 4 <> 0))
UNION ALL SELECT DISTINCT p_brand, 'All files', 'no valid total', NULL, 0 FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INT) % 3 = 0""")
def a7_coverage_report(s, d):
    k, n = c("p_partkey"), F.split("p_brand", "#")[1].cast("int") % 3
    p = T(s, d, "part")
    files = p.select(c("p_brand").alias("run"), F.concat(lit("f"), F.lpad(k.cast("string"), 7, "0")).alias("file"), F.when(k % 4 == 0, "100").when(k % 4 == 1, "50.5").when(k % 4 == 2, "n/a").otherwise("Unknown").alias("lines"))
    totals = p.select(c("p_brand").alias("run"), lit("total").alias("file"), F.when(n == 0, "NaN").otherwise("Unknown").alias("lines")).distinct()
    return R.coverage_report(files.union(totals), ["lines"], True)


@query("SELECT (SELECT COUNT(*) FROM orders) AS operations, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') AS placeholders, (SELECT COUNT(*) FROM part) AS schemas, (SELECT COUNT(*) FROM supplier) AS patches, (SELECT COUNT(*) FROM supplier WHERE s_acctbal > 0) AS closed_patches, (SELECT COUNT(*) FROM nation) AS warnings, CASE WHEN (SELECT COUNT(*) FROM nation) = 0 THEN 'complete' ELSE 'complete-with-warnings' END AS status UNION ALL SELECT COUNT(*), 0, 0, 0, 0, 0, 'complete' FROM orders")
def a8_run_verdict(s, d):
    ops = T(s, d, "orders").select(F.when(c("o_orderstatus") == "P", "placeholder").otherwise("resolved").alias("route_status"))
    patches = T(s, d, "supplier").select(F.when(c("s_acctbal") > 0, "closed").otherwise("known").alias("status"))
    return R.run_verdict(ops, T(s, d, "part"), patches, T(s, d, "nation")).union(R.run_verdict(ops.withColumn("route_status", lit("resolved")), T(s, d, "part").where("false"), patches.where("false"), T(s, d, "nation").where("false")))


@query("SELECT (SELECT COUNT(*) FROM part) AS rows, true AS same, true AS other_value, true AS other_count")
def a11_table_fingerprint(s, d):
    p = T(s, d, "part")
    finger = lambda df: R.table_fingerprint(df, p.columns).first()
    a, b = finger(p), finger(p.orderBy(F.desc("p_partkey")).repartition(7))
    one = finger(p.withColumn("p_size", F.when(c("p_partkey") == 1, c("p_size") + 1).otherwise(c("p_size"))))
    more = finger(p.union(p.where("p_partkey = 1")))
    return s.range(1).select(lit(a["rows"]).alias("rows"), lit(a == b).alias("same"), lit(a["fingerprint"] != one["fingerprint"]).alias("other_value"), lit(a["fingerprint"] != more["fingerprint"]).alias("other_count"))


@query("SELECT p_partkey AS tag, CASE WHEN p_partkey % 4 = 0 THEN repeat('a', 40) WHEN p_partkey % 4 = 1 THEN repeat('B', 64) END AS revision, CASE p_partkey % 4 WHEN 2 THEN 'bad-hash' WHEN 3 THEN 'unexpected-reference' ELSE 'ok' END AS status FROM part")
def a15_tag_cases(s, d):
    k = c("p_partkey")
    p = T(s, d, "part").select(k.alias("tag"), (k % 4).alias("k"))
    ref = F.concat(lit("refs/tags/"), c("tag").cast("string"))
    direct = p.select("tag", ref.alias("reference"), F.when(c("k") == 1, F.repeat(lit("B"), 64)).when(c("k") == 2, "short").otherwise(F.repeat(lit("c"), 40)).alias("revision"))
    more = p.where("k in (0, 3)").select("tag", F.when(c("k") == 0, F.concat(ref, lit("^{}"))).otherwise(F.concat(ref, lit("x"))), F.repeat(lit("a"), 40))
    return R.tag_revision(direct.union(more))


@query("SELECT 'c' AS provider, concat('c', c_custkey) AS name FROM customer UNION ALL SELECT 's', concat('s', s_suppkey) FROM supplier UNION ALL SELECT 'c', concat('! ', c_custkey) FROM customer WHERE c_acctbal < 0")
def u1_collect_inventory(s, d):
    cu, su = T(s, d, "customer"), T(s, d, "supplier")
    none = cu.where("false").select(lit("").alias("message"))
    packages, diagnostics = R.collect_inventory({"c": (cu.select(F.concat(lit("c"), "c_custkey").alias("name")), cu.where("c_acctbal < 0").select(F.concat(lit("! "), "c_custkey").alias("message"))), "s": (su.select(F.concat(lit("s"), "s_suppkey").alias("name")), none)})
    return packages.select("provider", "name").union(diagnostics.select("provider", "message"))


NODE = {"name": "a", "version": "1.0.0", "repository": "github:a/b"}
PACKAGES = [("node", NODE), ("node", NODE | {"private": True}), ("node", NODE | {"private": "yes"}), ("node", NODE | {"version": "1.0"}), ("node", NODE | {"name": " "}), ("node", NODE | {"repository": {"url": "x"}}), ("node", NODE | {"repository": {}}), ("node", NODE | {"publishConfig": {"registry": "https://registry.npmjs.org/"}}), ("node", NODE | {"publishConfig": {"registry": "https://other"}}), ("rust", NODE), ("rust", NODE | {"publish": []}), ("rust", NODE | {"publish": ["crates-io"]}), ("rust", NODE | {"publish": ["mine"]}), ("rust", NODE | {"publish": False}), ("rust", NODE | {"repository": " "}), ("node", NODE | {"private": False})]


@query(f"SELECT p_partkey AS path, {chosen(['publishable', 'private', 'bad-private', 'bad-version', 'no-name', 'publishable', 'no-repository', 'publishable', 'bad-registry', 'publishable', 'private', 'publishable', 'bad-registry', 'bad-publish', 'no-repository', 'publishable'])} AS status FROM part")
def p9_package_cases(s, d):
    return R.package_catalog(dealt(s, d, [(e, json.dumps(m)) for e, m in PACKAGES]).select(c("p_partkey").alias("path"), c("x0").alias("ecosystem"), c("x1").alias("manifest"))).select("path", "status")


MANAGED = [("npm@10.1.0", ""), ("pnpm@9.0.0", "x"), ("yarn@1.0.0", ""), ("npm", ""), ("npm@1", ""), (None, "package-lock.json"), (None, "pnpm-lock.yaml"), (None, "package-lock.json pnpm-lock.yaml"), (None, "yarn.lock"), (None, "deno.json"), (None, "readme"), (" ", "")]


@query(f"SELECT p_partkey AS path, {chosen(['npm', 'pnpm', 'error: not supported', 'error: no version', 'error: bad version', 'npm', 'error: pnpm needs packageManager', 'error: several lockfiles', 'error: not supported', 'error: deno', 'npm', 'error: empty'])} AS manager FROM part")
def p9_package_manager(s, d):
    return R.package_manager(dealt(s, d, MANAGED).select(c("p_partkey").alias("path"), c("x0").cast("string").alias("declared"), F.split("x1", " ").alias("files")))


ROOTED = ["a/src/main/java/x/contract/A.java", "a/src/main/java/x/contract/sub/contract/B.java", "b/contract/C.java", "c/other/D.java", "a/src/main/java/x/contract/deep/E.java", "a/src/main/java/x/contract"]


@query(f"SELECT concat(p_partkey, '/', x) AS path, st AS status FROM (SELECT p_partkey, {chosen(ROOTED)} AS x, {chosen(['ok', 'ok', 'outside-layout', 'no-root', 'ok', 'no-root'])} AS st FROM part) UNION ALL SELECT 'z/src/main/java/contract/A', 'ok' UNION ALL SELECT 'z/src/main/java/contract/b/contract/B', 'nested'")
def p10_check_roots(s, d):
    files = dealt(s, d, [(x,) for x in ROOTED]).select(F.concat_ws("/", "p_partkey", "x0").alias("path"))
    more = s.sql("SELECT 'z/src/main/java/contract/A' AS path UNION ALL SELECT 'z/src/main/java/contract/b/contract/B'")
    return R.check_roots(files.union(more), "contract", "src/main/java/").select("path", "status")


@query("SELECT id, row_number() OVER (ORDER BY kind, name, id) AS place FROM nodes", "nodes")
def l1_ordered(s, d):
    path = scratch_path(s, "ordered")
    R.ordered(view(s, d, "nodes"), ["kind", "name"]).write.parquet(path)
    parts = s.read.schema("id string, kind string, name string").parquet(path).select("id", F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("int").alias("part"), F.monotonically_increasing_id().alias("at"))
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = F.create_map(*[lit(x) for p in sorted(sizes) for x in (p, sum(n for q, n in sizes.items() if q < p))])
    from pyspark.sql import Window

    return parts.select("id", (F.row_number().over(Window.partitionBy("part").orderBy("at")) + before[c("part")]).alias("place"))


# --- graph -----------------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, 'PageList' AS name, 0 AS depth, 0 AS arrays FROM part UNION ALL SELECT p_partkey, concat('p.', p_type), 1, 3 FROM part UNION ALL SELECT p_partkey, 'Map', 0, 1 FROM part UNION ALL SELECT p_partkey, 'String', 1, 0 FROM part UNION ALL SELECT p_partkey, 'Long', 1, 1 FROM part")
def f7_wrapped_tokens(s, d):
    p = T(s, d, "part").select("p_partkey", F.concat(lit("ApiResult<CompletableFuture<PageList<p."), "p_type", lit("[][][]>>>")).alias("sig"))
    more = T(s, d, "part").select("p_partkey", lit("Map< String, ? extends Long...>[]").alias("sig"))
    out = G.type_tokens(p, "p_partkey", c("sig"), ["ApiResult", "CompletableFuture"]).union(G.type_tokens(more, "p_partkey", c("sig"), ["ApiResult"]))
    return out.select("p_partkey", "name", c("depth").cast("int").alias("depth"), c("array_depth").alias("arrays"))


def tagged(name: str, k: Column) -> Column:
    return F.concat(lit(name), k.cast("string"))


def per_part(s, d, *rows: tuple, names: list[str], where: str = "true") -> DataFrame:
    """Each row for each part, with the part's key put behind the texts that end in `~`."""
    p = T(s, d, "part").where(where).select("p_partkey")
    one = lambda v: tagged(v[:-1], c("p_partkey")) if isinstance(v, str) and v.endswith("~") else lit(v)
    structs = [F.struct(*[one(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    # Written and read back, as Spark cannot tell the size of what explode makes.
    return materialize(p.select(F.explode(F.array(*structs)).alias("r")).select("r.*"), "per-part")


def rows_sql(names: list[str], *rows: tuple, where: str = "true") -> str:
    one = lambda v: f"concat({literal(v[:-1])}, p_partkey)" if isinstance(v, str) and v.endswith("~") else literal(v)
    return " UNION ALL ".join("SELECT " + ", ".join(f"{one(v)} AS {n}" for n, v in zip(names, r, strict=True)) + f" FROM part WHERE {where}" for r in rows)


@query(rows_sql(["root", "node", "depth"], ("a~", "a~", 0), ("a~", "b~", 1), ("a~", "c~", 2), ("a~", "x~", 1)))
def g2_reachable_resolved(s, d):
    edges = per_part(s, d, ("a~", "x~"), names=["source", "target"])
    calls = per_part(s, d, ("1-~", "a~", "B~", "go", 1), ("2-~", "b~", "C~", "run", 0), ("3-~", "b~", "C~", "two", 0), names=["call_id", "caller", "owner", "name", "arity"])
    methods = per_part(s, d, ("b~", "B~", "go", 1), ("z~", "B~", "go", 2), ("c~", "C~", "run", 0), ("d~", "C~", "two", 0), ("e~", "C~", "two", 0), names=["id", "owner", "name", "arity"])
    return G.reachable_resolved(edges, calls, methods, per_part(s, d, ("a~",), names=["root"])).select("root", "node", "depth")


@query(""", p(root, path, schema, up) AS (SELECT concat('nation:', n_nationkey), '', concat('nation:', n_nationkey), [concat('nation:', n_nationkey)] FROM nation UNION ALL
SELECT root, concat(path, CASE WHEN path = '' THEN '' ELSE '.' END, field, CASE WHEN is_list THEN '[]' ELSE '' END, CASE WHEN kind = 'page' THEN '.list[]' ELSE '' END), ref, list_append(up, ref) FROM p JOIN fields f ON f.schema = p.schema WHERE NOT list_contains(up, ref))
SELECT DISTINCT root, path, schema FROM p""", "fields")
def g6_nested_tables(s, d):
    return G.expand_paths(T(s, d, "nation").select(F.concat(lit("nation:"), "n_nationkey").alias("root")), view(s, d, "fields"))


@query(""", up(root, class, depth) AS (SELECT class, class, 0 FROM classes UNION ALL SELECT root, parent, depth + 1 FROM up JOIN classes USING (class) WHERE parent IS NOT NULL),
near AS (SELECT root, field, type, pos, depth FROM up JOIN members USING (class) QUALIFY row_number() OVER (PARTITION BY root, field ORDER BY depth) = 1)
SELECT root, field, type, CAST(row_number() OVER (PARTITION BY root ORDER BY depth DESC, pos, field) AS INTEGER) AS position FROM near""", "classes", "members")
def g7_order_chains(s, d):
    return G.flatten_inheritance(view(s, d, "classes"), view(s, d, "members"))


@query(""", t AS MATERIALIZED (SELECT * FROM tree), n AS MATERIALIZED (SELECT concat('n', schema) AS new, field, CASE WHEN ref LIKE 's%' THEN concat('n', ref, '-', field) ELSE concat('n', ref) END AS new_ref FROM t WHERE field <> 'f3'),
p0 AS MATERIALIZED (SELECT DISTINCT schema AS old, concat('n', schema) AS new, 0 AS depth FROM t WHERE schema LIKE 'c%'),
s1 AS MATERIALIZED (SELECT new, field, ref FROM p0 JOIN t ON schema = old),
p1 AS MATERIALIZED (SELECT ref AS old, min(new_ref) AS new, 1 AS depth FROM s1 JOIN n USING (new, field) GROUP BY 1),
s2 AS MATERIALIZED (SELECT new, field, ref FROM p1 JOIN t ON schema = old),
p2 AS (SELECT ref AS old, min(new_ref) AS new, 2 AS depth FROM s2 JOIN n USING (new, field) GROUP BY 1)
SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2""", "tree")
def g12_paired_trees(s, d):
    old = view(s, d, "tree")
    new = old.where("field <> 'f3'").select(F.concat(lit("n"), "schema").alias("schema"), "field", F.when(c("ref").startswith("s"), F.concat(lit("n"), "ref", lit("-"), "field")).otherwise(F.concat(lit("n"), "ref")).alias("ref"))
    seeds = old.where("schema like 'c%'").select(c("schema").alias("old"), F.concat(lit("n"), "schema").alias("new")).distinct()
    return G.pair_schemas(old, new, seeds).select("old", "new", "depth")


for name in ("g6_nested_tables", "g7_order_chains"):
    ORACLES[name] = ORACLES[name].replace("WITH", "WITH RECURSIVE", 1)


@query(rows_sql(["root", "path", "schema"], ("p~", "", "p~"), ("p~", "list[]", "q~"), ("p~", "map", "r~"), ("p~", "page.list[]", "q~"), ("p~", "map.deep[]", "q~")))
def g6_expand_paths(s, d):
    fields = per_part(s, d, ("p~", "list", "q~", True, "field"), ("p~", "map", "r~", False, "map"), ("p~", "page", "q~", False, "page"), ("r~", "deep", "q~", True, "field"), ("q~", "back", "p~", False, "field"), names=["schema", "field", "ref", "is_list", "kind"])
    return G.expand_paths(per_part(s, d, ("p~",), names=["root"]), fields)


@query(rows_sql(["root", "field", "type", "position"], ("C~", "y", "int", 1), ("C~", "z", "str", 2), ("C~", "x", "long", 3), ("C~", "w", "int", 4), ("B~", "y", "int", 1), ("B~", "z", "str", 2), ("B~", "x", "date", 3), ("A~", "x", "int", 1), ("A~", "y", "int", 2)))
def g7_flatten_inheritance(s, d):
    classes = per_part(s, d, ("A~", ""), ("B~", "A~"), ("C~", "B~"), names=["class", "parent"]).withColumn("parent", F.nullif("parent", lit("")))
    fields = per_part(s, d, ("A~", "x", 1, "int"), ("A~", "y", 2, "int"), ("B~", "z", 1, "str"), ("B~", "x", 2, "date"), ("C~", "x", 1, "long"), ("C~", "w", 2, "int"), names=["class", "field", "pos", "type"])
    return G.flatten_inheritance(classes, fields).select("root", "field", "type", "position")


@query(""", active AS (SELECT DISTINCT root AS operation, slot, from_slot, CASE WHEN from_slot IS NULL THEN coalesce(domain, 'unknown') END AS domain FROM args JOIN within ON node = caller WHERE caller <> method),
mine AS (SELECT DISTINCT root AS operation, slot FROM slots JOIN within ON node = method UNION SELECT operation, slot FROM active),
flow(operation, a, b) AS (SELECT operation, from_slot, slot FROM active WHERE from_slot IS NOT NULL UNION SELECT f.operation, f.a, x.slot FROM flow f JOIN active x ON x.operation = f.operation AND x.from_slot = f.b),
seeds AS (SELECT operation, slot, domain FROM active WHERE domain IS NOT NULL UNION SELECT operation, slot, 'unknown' FROM mine ANTI JOIN active USING (operation, slot) UNION SELECT operation, a, 'unknown' FROM flow WHERE a = b)
SELECT operation, slot, domain FROM seeds UNION SELECT s.operation, f.b, s.domain FROM seeds s JOIN flow f ON f.operation = s.operation AND f.a = s.slot""", "slots", "args", "within")
def g8_propagate_domains(s, d):
    return G.propagate_domains(view(s, d, "slots"), view(s, d, "args"), view(s, d, "within"))


ORACLES["g8_propagate_domains"] = ORACLES["g8_propagate_domains"].replace("WITH", "WITH RECURSIVE", 1)


@query(""", placed AS (SELECT c.caller, c.setter, c.line, c.col, s.slot, s.source, s.caller IS NULL AS blind FROM setter_calls c LEFT JOIN setter_sites s ON s.caller = c.caller AND s.setter = c.setter AND s.line = c.line
  QUALIFY row_number() OVER (PARTITION BY c.caller, c.setter, c.line, c.col ORDER BY abs(s.col - c.col), s.col, s.slot, s.source) = 1),
reach AS (SELECT concat('customer:', o_custkey) AS operation, concat('order:', o_orderkey) AS caller FROM orders),
mine AS (SELECT w.operation, field, setter, caller, name, file FROM written w JOIN reach USING (operation) JOIN writers ON node = caller WHERE setter IS NOT NULL),
dom AS (SELECT * FROM (VALUES ('d0', 'E0', ['b', 'a'], []::VARCHAR[]), ('d1', 'E1', ['c'], []), ('d2', NULL, [], ['rpc'])) t(domain, enum, vals, ext)),
one AS (SELECT m.operation, field, caller, line, col, name, file, source, b.domain, enum, vals, CASE WHEN enum IS NULL AND coalesce(len(ext), 0) = 0 THEN coalesce(b.domain, 'unknown') END AS unk, coalesce(len(ext), 0) > 0 AS out
  FROM mine m JOIN placed p USING (caller, setter) LEFT JOIN bound b ON b.operation = m.operation AND b.slot = p.slot LEFT JOIN dom ON dom.domain = b.domain WHERE NOT blind),
site AS (SELECT operation, field, caller, line, col, name, file, source, min(enum) AS e, max(enum) AS z, min_by(vals, enum) AS vals, list(DISTINCT unk) FILTER (unk IS NOT NULL) AS unk, bool_or(out) AS out FROM one GROUP BY ALL),
bare AS (SELECT operation, field, concat('unindexed setter argument at ', file, ':', line, ':', col) AS text FROM mine JOIN placed USING (caller, setter) WHERE blind
  UNION SELECT operation, field, concat('unindexed setter call:', file, ':', line, ':', col) FROM mine JOIN setter_sites USING (caller, setter) ANTI JOIN setter_calls USING (caller, setter, line)
  UNION SELECT operation, field, concat('unresolved setter call:', file, ':', line, ':', col) FROM mine JOIN setter_refs USING (caller, setter)),
f AS (SELECT operation, field, first(struct_pack(e := e, v := vals) ORDER BY file, line, col, e) FILTER (e IS NOT NULL) AS f, bool_and(e IS NOT NULL AND e = z AND NOT out AND unk IS NULL) AS clean, bool_and(out AND unk IS NULL) AS ext, count(DISTINCT e) AS n FROM site GROUP BY ALL),
texts AS (SELECT operation, field, unnest(unk) AS text FROM site UNION SELECT operation, field, concat('conflicting enum projections:', e, ':', z) FROM site WHERE e <> z UNION SELECT operation, field, concat('conflicting enum projections:', f.e, ':', site.e) FROM site JOIN f USING (operation, field) WHERE site.e <> f.e UNION SELECT * FROM bare),
told AS (SELECT operation, field, list(text ORDER BY text)[1:4] AS u FROM texts GROUP BY ALL),
ev AS (SELECT operation, field, text, min([file, lpad(line::VARCHAR, 6, '0'), lpad(col::VARCHAR, 6, '0'), kind]) AS o FROM (SELECT *, concat('write:', file, ':', line, ':', col, ':', source) AS text, '0' AS kind FROM site UNION ALL SELECT site.*, concat('chain:', c_name, ' => ', name), '1' FROM site JOIN customer ON operation = concat('customer:', c_custkey)) GROUP BY ALL),
proof AS (SELECT operation, field, array_to_string(list(text ORDER BY o, text)[1:20], '|') AS evidence FROM ev GROUP BY ALL),
v AS (SELECT w.operation, w.field, setter, f, u, evidence, f.operation IS NULL AND u IS NULL AS empty, CASE WHEN clean AND n = 1 AND b.operation IS NULL THEN 'closed' WHEN f.f IS NOT NULL THEN 'known' WHEN ext AND b.operation IS NULL THEN 'external' ELSE 'unresolved' END AS status
  FROM written w LEFT JOIN f USING (operation, field) LEFT JOIN told USING (operation, field) LEFT JOIN proof USING (operation, field) LEFT JOIN (SELECT DISTINCT operation, field FROM bare) b USING (operation, field))
SELECT operation, field, status, f.e AS enum_fqn, CASE WHEN status = 'closed' THEN array_to_string(f.v, ',') END AS vals, coalesce(array_to_string(u, '|'), '') AS unknowns, coalesce(evidence, '') AS evidence,
CASE WHEN setter IS NULL THEN 'setter not indexed' WHEN empty THEN 'no operation-reachable write site' WHEN status = 'known' THEN 'enum evidence does not prove a complete field domain' WHEN status = 'external' THEN 'field value stops at an external boundary'
  WHEN status = 'unresolved' THEN concat('field domain unresolved', coalesce(': ' || array_to_string(u, ', '), '')) END AS warning FROM v""", "writers", "setter_calls", "setter_sites", "setter_refs", "written", "bound")
def g9_field_lineage(s, d):
    edges = view(s, d, "edges").where("kind = 'calls' and source like 'customer:%'")
    reach = G.pair_parents(edges, T(s, d, "customer").select(F.concat(lit("customer:"), "c_custkey").alias("root")))
    named = lambda n: view(s, d, n).withColumnRenamed("col", "column")
    none = F.array().cast("array<string>")
    domains = s.createDataFrame([("d0", "E0", ["b", "a"], []), ("d1", "E1", ["c"], []), ("d2", None, [], ["rpc"])], "domain string, enum_fqn string, values array<string>, external array<string>")
    domains = domains.select("*", F.when(c("enum_fqn").isNotNull(), "get").alias("accessor"), c("enum_fqn").isNotNull().alias("complete"), none.alias("unknown"), none.alias("literals"), lit(False).alias("transformed"))
    out = G.field_lineage(reach, view(s, d, "writers"), view(s, d, "written"), named("setter_calls"), named("setter_sites"), named("setter_refs"), view(s, d, "bound"), domains)
    text = lambda n: F.coalesce(F.array_join(n, "|"), lit("")).alias(n)
    return out.select("operation", "field", "status", "enum_fqn", comma(c("values")).alias("vals"), text("unknowns"), text("evidence"), "warning")


@query(rows_sql(["field", "enum", "accessor", "vals"], ("f~", "E~", "getCode", "1,2")))
def g11_link_enums(s, d):
    fields = per_part(s, d, ("f~", "E~", "getName,getCode,getId"), ("g~", "X~", "getCode"), names=["field", "e", "a"]).select("field", F.array("e").alias("enums"), F.split("a", ",").alias("accessors"))
    domains = per_part(s, d, ("E~", "getName", False, "x"), ("E~", "getCode", True, "1,2"), ("E~", "getId", True, "7"), ("X~", "getCode", True, ""), names=["enum", "accessor", "complete", "values"])
    return G.link_enums(fields, domains).select("field", "enum", "accessor", c("values").alias("vals"))


@query(rows_sql(["old", "new", "depth"], ("R~", "R2~", 0), ("S~", "S2~", 1), ("T~", "T2~", 2)))
def g12_pair_schemas(s, d):
    old = per_part(s, d, ("R~", "a", "S~"), ("S~", "b", "T~"), ("T~", "back", "R~"), ("S~", "gone", "U~"), names=["schema", "field", "ref"])
    new = per_part(s, d, ("R2~", "a", "S2~"), ("S2~", "b", "T2~"), ("T2~", "back", "other~"), names=["schema", "field", "ref"])
    return G.pair_schemas(old, new, per_part(s, d, ("R~", "R2~"), names=["old", "new"]))


@query("SELECT id, CASE WHEN id % 2 = 1 THEN concat('K', id) ELSE concat('AB', CASE WHEN r = 1 THEN 2 ELSE r + 2 END) END AS name FROM (SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) AS r FROM part)")
def g14_shortest_unique_names(s, d):
    k = c("p_partkey")
    seeds = T(s, d, "part").select(k.alias("id"), F.when(k % 2 == 0, F.array(lit("a"), lit("b"))).otherwise(F.array(lit("only"), tagged("k", k))).alias("parts"))
    return G.shortest_unique_names(seeds, s.sql("SELECT * FROM VALUES ('AB1'), ('AB3'), ('B') AS t(name)"))


@query("SELECT concat('op', p_partkey, '|s', p_partkey) AS id, concat('S', p_partkey) AS name FROM part WHERE p_partkey % 2 = 0")
def g15_operation_aliases(s, d):
    reach = per_part(s, d, ("op~", "s~"), names=["root", "node"])
    patches = per_part(s, d, ("op~", "closed"), names=["operation", "status"], where="p_partkey % 2 = 0").union(per_part(s, d, ("op~", "known"), names=["operation", "status"], where="p_partkey % 2 = 1"))
    return G.operation_aliases(reach, patches, s.sql("SELECT 'Zz' AS name"))


@query("SELECT p_partkey AS owner, " + chosen(["T1", "T2", None]) + " AS schema FROM part")
def g16_root_schema(s, d):
    tokens = G.type_tokens(dealt(s, d, [("ApiResult<List<Detail>>",), ("Map<Kind,Row>",), ("List<Kind>",)]).withColumnRenamed("p_partkey", "owner"), "owner", c("x0"))
    types = s.sql("SELECT * FROM VALUES ('T1', 'Detail', 'class'), ('T2', 'Row', 'class'), ('T3', 'Kind', 'enum'), ('T4', 'ApiResult', 'class') AS t(id, simple, kind)")
    return T(s, d, "part").select(c("p_partkey").alias("owner")).join(G.root_schema(tokens, types, ["ApiResult", "List", "Map"]), "owner", "left")


@query("""SELECT concat('op', p_partkey) AS operation, r.row, concat('{"both":{"a":"', p_type, '","b":7},"brand":"', p_brand, '","empty":{},"id":', p_partkey, ',"list":[', p_size, ',', p_size, '],"odd":{},"size":{"n":', p_size, ',"self":null},"when":"2000-01-01T00:00:00"}') AS document FROM part, (SELECT 0 AS row UNION ALL SELECT 1) r""")
def m1_generate_rows(s, d):
    k, quoted = c("p_partkey"), lambda x: F.concat(lit('"'), x, lit('"'))
    text = lit(None).cast("string")
    names = ["node", "type", "fixed", "options", "ref"]
    node = lambda n, kind=None, fixed=text, option=None, ref=None: F.struct(tagged(n, k).alias("node"), lit(kind).cast("string").alias("type"), fixed.cast("string").alias("fixed"), (F.array(option) if option is not None else lit(None).cast("array<string>")).alias("options"), (tagged(ref, k) if ref else text).alias("ref"))
    nodes = [
        node("root", "object"), node("id", fixed=k), node("brand", option=quoted(c("p_brand"))), node("size", ref="S"), node("S"), node("n", fixed=c("p_size")), node("self", ref="S"), node("both"), node("old", "object"), node("word", "string", quoted(lit("x"))),
        node("new"), node("a1", fixed=quoted(lit("old"))), node("seven", fixed=lit("7")), node("a2", fixed=quoted(c("p_type"))), node("empty", "object"), node("list", "array"), node("odd"), node("when", fixed=quoted(lit("2000-01-01T00:00:00"))),
    ]
    link = lambda of, kind, name, at, child: F.struct(tagged(of, k).alias("node"), lit(kind).alias("kind"), lit(name).cast("string").alias("name"), lit(at).alias("position"), tagged(child, k).alias("child"))
    links = [link("root", "property", n, i, ch) for i, (n, ch) in enumerate([("when", "when"), ("size", "size"), ("id", "id"), ("brand", "brand"), ("both", "both"), ("empty", "empty"), ("list", "list"), ("odd", "odd")])]
    links += [link("S", "property", "n", 0, "n"), link("S", "property", "self", 1, "self"), link("both", "allOf", None, 0, "old"), link("both", "allOf", None, 1, "word"), link("both", "allOf", None, 2, "new"), link("old", "property", "a", 0, "a1"), link("old", "property", "b", 1, "seven"), link("new", "property", "a", 0, "a2"), link("list", "items", None, 0, "n"), link("odd", "allOf", None, 0, "word")]
    part = T(s, d, "part")
    schema = part.select(F.explode(F.array(*nodes)).alias("x")).select("x.*").withColumn("format", text).select("node", "type", "format", *names[2:])
    edges = part.select(F.explode(F.array(*links)).alias("x")).select("x.*")
    return G.generate_rows(part.select(tagged("op", k).alias("operation"), tagged("root", k).alias("node")), schema, edges, 2, 7)


# --- streaming -------------------------------------------------------------------------------------------------------
STOPS = "SELECT session_id, turn_id, event_id, CASE event_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'warning' END AS status FROM hook WHERE stage = 'Stop'"


@query()
def t2_close_turns(s, d):
    ev = view(s, d, "hook")
    k = c("event_id") % 4
    stops = ev.where("stage = 'Stop'").select("session_id", "turn_id", "event_id", F.when(k == 0, "passed").when(k == 3, "warning").otherwise("failed").alias("status"), lit(False).alias("continued"))
    return E.close_turns(E.turn_events(E.track_edits_batch(ev), stops))


ORACLES["t2_close_turns"] = (
    as_sql("hook").rstrip().replace("WITH", "WITH RECURSIVE", 1)
    + f""", ed AS (SELECT session_id, turn_id, event_id, path FROM ({PAIRED}) WHERE changed), st AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_id ORDER BY event_id) AS idx FROM ({STOPS})),
pairs AS (SELECT b.session_id, b.turn_id, coalesce(a.idx, 0) AS since, b.idx, b.event_id, b.status, (SELECT COUNT(DISTINCT path) FROM ed WHERE ed.session_id = b.session_id AND ed.turn_id = b.turn_id AND ed.event_id > coalesce(a.event_id, -1) AND ed.event_id < b.event_id) AS files
FROM st b LEFT JOIN (SELECT session_id, turn_id, idx, event_id FROM st UNION ALL SELECT DISTINCT session_id, turn_id, 0, -1 FROM st) a ON a.session_id = b.session_id AND a.turn_id = b.turn_id AND a.idx < b.idx),
r AS (SELECT session_id, turn_id, idx, event_id, files, status, since, false AS was, files > 0 AND status = 'failed' AS blocked FROM pairs WHERE since = 0 AND idx = 1
UNION ALL SELECT p.session_id, p.turn_id, p.idx, p.event_id, p.files, p.status, p.since, r.blocked, p.files > 0 AND p.status = 'failed' AND NOT r.blocked FROM r JOIN pairs p ON p.session_id = r.session_id AND p.turn_id = r.turn_id AND p.idx = r.idx + 1 AND p.since = CASE WHEN r.blocked THEN r.since ELSE r.idx END)
SELECT session_id, turn_id, event_id AS stop_id, files, CASE WHEN files = 0 THEN 'silent' WHEN blocked THEN 'block' WHEN status IN ('failed', 'warning') THEN 'message' ELSE 'silent' END AS decision FROM r"""
)


@query(
    "SELECT session_id, turn_id, tool_use_id, event_id, path IS DISTINCT FROM wp OR content IS DISTINCT FROM wc AS changed FROM (SELECT *, lag(stage) OVER w AS ws, lag(path) OVER w AS wp, lag(content) OVER w AS wc, lag(seen) OVER w AS wa FROM sessions WHERE stage IN ('PreToolUse', 'PostToolUse') WINDOW w AS (PARTITION BY session_id, turn_id, tool_use_id ORDER BY event_id)) WHERE stage = 'PostToolUse' AND ws = 'PreToolUse' AND seen - INTERVAL 24 HOUR <= wa",
    "sessions",
)
def t3_track_ttl(s, d):
    return E.track_edits_batch(view(s, d, "sessions"), "seen").select(*E.KEY, "event_id", "changed")


@query()
def t3_follow_turns(s, d):
    return E.follow_turns_batch(view(s, d, "sessions"), "seen")


ORACLES["t3_follow_turns"] = (
    as_sql("sessions").rstrip().replace("WITH", "WITH RECURSIVE", 1)
    + """, ev AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_id ORDER BY event_id) AS idx FROM sessions WHERE stage IS NOT NULL),
r AS (SELECT DISTINCT session_id, turn_id, CAST(0 AS BIGINT) AS idx, CAST([] AS STRUCT(tool VARCHAR, path VARCHAR, content VARCHAR, seen TIMESTAMP)[]) AS pre, CAST([] AS STRUCT(tool VARCHAR, path VARCHAR, seen TIMESTAMP)[]) AS rec,
CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS files, CAST(NULL AS VARCHAR) AS decision FROM ev
UNION ALL SELECT session_id, turn_id, idx,
CASE WHEN stage = 'Stop' AND decision <> 'block' THEN [] WHEN opens THEN list_append(list_filter(p, lambda x: x.tool <> tool), {'tool': tool, 'path': path, 'content': content, 'seen': seen}) WHEN was IS NOT NULL THEN list_filter(p, lambda x: x.tool <> tool) ELSE p END,
CASE WHEN stage = 'Stop' AND decision <> 'block' THEN [] WHEN was IS NOT NULL AND (was.path IS DISTINCT FROM path OR was.content IS DISTINCT FROM content) THEN list_append(list_filter(c, lambda x: x.tool <> tool), {'tool': tool, 'path': path, 'seen': seen}) WHEN opens OR was IS NOT NULL THEN list_filter(c, lambda x: x.tool <> tool) ELSE c END,
stage, event_id, files, decision
FROM (SELECT *, CASE WHEN files = '' OR status = 'passed' THEN 'silent' WHEN status = 'failed' AND NOT continued THEN 'block' ELSE 'message' END AS decision
FROM (SELECT *, stage = 'PreToolUse' AND tool IS NOT NULL AND path IS NOT NULL AS opens, CASE WHEN stage = 'PostToolUse' THEN list_filter(p, lambda x: x.tool = tool)[1] END AS was,
coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(c, lambda x: x.path), lambda x: x IS NOT NULL))), ','), '') AS files
FROM (SELECT e.session_id, e.turn_id, e.idx, e.event_id, e.stage, e.tool_use_id AS tool, e.path, e.content, e.status, e.continued, e.seen,
list_filter(r.pre, lambda x: x.seen >= e.seen - INTERVAL 24 HOUR) AS p, list_filter(r.rec, lambda x: x.seen >= e.seen - INTERVAL 24 HOUR) AS c FROM r JOIN ev e ON e.session_id = r.session_id AND e.turn_id = r.turn_id AND e.idx = r.idx + 1))))
SELECT session_id, turn_id, event_id AS stop_id, files, decision FROM r WHERE stage = 'Stop'"""
)


@query("SELECT event_id, concat(coalesce(stage, '-'), ' ', session_id, '/', turn_id, '/', tool_use_id, ' ', event_id % 90, 'ms') AS line FROM hook", "hook")
def t5_event_duration(s, d):
    return E.event_log(view(s, d, "hook").withColumn("took", c("event_id") % 90), "took")


# --- checks ----------------------------------------------------------------------------------------------------------
def _row(status):
    return lambda df: df.agg(status().alias("status"), lit("m").alias("message"))


BROKEN = {
    "a_plan": lambda df: df.select("no_such_column"),
    "b_run": _row(lambda: F.when(F.max(F.raise_error(lit("boom"))).isNull(), "passed")),
    "c_empty": lambda df: df.where("false").select(lit("passed").alias("status"), lit("m").alias("message")),
    "d_odd": _row(lambda: F.when(F.count("*") >= 0, "fine")),
    "e_good": _row(lambda: F.when(F.count("*") >= 0, "passed")),
    "f_warn": _row(lambda: F.when(F.count("*") >= 0, "warning")),
}


@query("SELECT UNNEST(['a_plan', 'b_run', 'c_empty', 'd_odd', 'e_good', 'f_warn']) AS \"check\", UNNEST(['failed', 'failed', 'failed', 'failed', 'passed', 'warning']) AS status")
def c1_broken_checks(s, d):
    return R.run_checks(T(s, d, "nation"), BROKEN).select("check", "status")


GATE = [("x", 5, 0, 0, "h"), ("y", 5, 0, 0, "h"), ("x", 4, 0, 0, "h"), ("x", 5, 1, 0, "h"), ("x", 5, 0, 2, "h"), ("x", 5, 0, 0, "g"), ("y", 1, 1, 1, "g")]


@query(f"SELECT p_partkey AS snapshot, {chosen(['', 'commit', 'count', 'placeholders', 'unresolved', 'hash', 'commit,count,placeholders,unresolved,hash'])} AS reasons, p_partkey % 7 = 0 AS accepted FROM part")
def c3_accept_cases(s, d):
    g = dealt(s, d, GATE).toDF("snapshot", "commit", "operations", "placeholders", "unresolved", "hash")
    return R.accept_gate(g.withColumns({"expected_commit": lit("x"), "expected_operations": lit(5), "expected_hash": lit("h")}))


# --- coded values ----------------------------------------------------------------------------------------------------
N, STR = "Integer", "String"
CODED = [
    ("status: 1-one 2-two", None, N, "1=one;2=two"),
    ("状态：1-待审，2/3-通过；备注", None, N, "1=待审;2=通过;3=通过"),
    ("状态：\n1 待审\n2 通过", None, N, "1=待审;2=通过"),
    ("订单类型:\n- (1) one\n2、two (TWO)\n3. three。more\n备注: x", None, N, "1=one;2=two;3=three"),
    ("类型：\n1 one\n2 two\n2023年 change", None, N, "1=one;2=two"),
    ("类型：\n1 one\nbroken line\n2 two", "1=a 2=b", N, "1=a;2=b"),
    ("enum values:\n1 one\n2 two", None, N, "1=one;2=two"),
    ("状态: 1 one, 2 two; 2024 later", None, N, "1=one;2=two"),
    ("状态: 1 one 2 two 3 three。more", None, N, "1=one;2=two;3=three"),
    ("状态: 1 one 3 three", None, N, ""),
    ("状态: 1 one, 2 two; see docs", None, N, "1=one;2=two"),
    ("just 1-only", "A", N, ""),
    ("1=x. 2=y! 3=z", None, N, "1=x;2=y;3=z"),
    ("-1-lost 1.5-half 007-bond", None, N, "-1=lost;1.5=half;7=bond"),
    ("A:one B:two", None, STR, "A=one;B=two"),
    ("场景:\n1. A_B first\n2. C-D second\n3. E9 third", None, STR, "A_B=first;C-D=second;E9=third"),
    ("场景:\n1. A_B first\n3. C-D second", None, STR, ""),
    ("场景\n- plain first\n- words second", None, STR, ""),
    ("取值\n- plain first\n- words second", None, STR, "plain=first;words=second"),
    ("取值\n- plain first\n1. X second\n2. Y third", None, STR, ""),
    ("0-off（OFF）1-on（ON）", None, N, "0=off（OFF）1-on"),
    ("0-off（OFF） 1-on（ON）", None, N, "0=off;1=on"),
    ("日期 2024-01-02 1-a 2-b", None, "LocalDate", "1=a;2=b"),
    ("1-a 2-b", None, "boolean", ""),
]
# One value is too few; a bracket without a space before the next code hides it.
WANTED = [w if ";" in w else "" for *_, w in CODED]


@query(f"SELECT * FROM (SELECT p_partkey, {chosen(WANTED)} AS pairs FROM part) WHERE pairs <> ''")
def f2_coded_cases(s, d):
    from contractlens.functions.coded import coded_values

    x = dealt(s, d, [r[:3] for r in CODED]).select("p_partkey", c("x0").alias("comment"), c("x1").cast("string").alias("annotation"), c("x2").alias("type"))
    pair = F.struct("position", F.concat_ws("=", "value", "label").alias("t"))
    return coded_values(x, "p_partkey").groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda v: v["t"]), ";").alias("pairs"))
