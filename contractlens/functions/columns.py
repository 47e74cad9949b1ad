"""Column expressions. Each is built of JVM functions alone, so it stays inside generated code where Spark can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path markers, annotations, comment markers, mappings of the catalogue.
EXTERNAL = ["/infrastructure/thirdpart/", "/infrastructure/database/", "/repository/", "/mapper/", "/dao/", "/rpc/"]
NOT_SERVICE = ["/interfaces/", "/infrastructure/", "/repository/"]
REQUIRED_MARKS = ["@NotNull", "@NonNull", "@NotEmpty", "@NotBlank", "@Size", "@Pattern", "@Min", "@Max", "@Email"]
OPTIONAL_WORDS = ["非必填", "可选", "可空", "可不传", "二选一", "多选一"]
REGISTRIES = ["https://registry.npmjs.org/", "http://registry.npmjs.org/", "https://registry.npmmirror.com/"]
SLUG_PREFIX = r"(?i)^(?:github:|https://github\.com/|http://github\.com/|git\+https://github\.com/|git\+ssh://git@github\.com/|git://github\.com/|git@github\.com:|ssh://git@github\.com/)"
NUMERIC = ["Integer", "int", "Short", "short", "Byte", "byte", "Double", "double", "Float", "float", "BigDecimal"]
TEXTUAL = ["String", "CharSequence", "char", "Character"]
WIDE = ["Long", "long", "BigInteger"]
DATES = ["Date", "LocalDate", "LocalDateTime", "Instant", "Timestamp"]
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(c: Column, parts: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(p)) for p in parts])


def is_safe_relative(c: Column, allow_dot: bool = False) -> Column:
    """Not empty, not absolute, no `..` step, no drive prefix. Empty and `.` steps further on say nothing; a path that
    begins with `.` is safe only if allowed."""
    steps = F.split(c, "/")
    ok = (F.length(c) > 0) & ~c.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(steps, "..")
    return ok if allow_dot else ok & (F.get(steps, F.lit(0)) != ".")


def path_layer(c: Column) -> Column:
    slashed = F.concat(F.lit("/"), c)
    package = F.concat(F.lit("/"), F.when(F.contains(c, F.lit("/java/")), F.get(F.split(c, "/java/"), F.lit(1))).otherwise(c))
    return F.when(has_any(slashed, EXTERNAL), "external").when(F.contains(package, F.lit("/service/")) & ~has_any(package, NOT_SERVICE), "service").otherwise("other")


def infer_optional(declaration: Column, comment: Column, name: Column) -> Column:
    """A required mark vetoes; then a nullable mark, a comment marker or the name's ending decide."""
    ends = F.lower(name).rlike("(ext|optional|opt)$")
    return ~has_any(declaration, REQUIRED_MARKS) & (has_any(declaration, ["@Nullable", "= null"]) | F.coalesce(has_any(comment, OPTIONAL_WORDS), F.lit(False)) | ends)


def package_source(resolved: Column, link: Column) -> Column:
    r = F.coalesce(resolved, F.lit(""))
    starts = lambda *ps: any_of([F.startswith(r, F.lit(p)) for p in ps])
    return (
        F.when(F.coalesce(link, F.lit(False)) | starts("link:"), "link").when(starts("file:"), "file").when(starts("workspace:"), "workspace")
        .when(starts("git+", "git:", "github:"), "git").when(starts(*REGISTRIES), "registry").otherwise("unknown")
    )


def valid_package_name(c: Column) -> Column:
    part = "(?!-)[A-Za-z0-9._-]+"
    return (F.length(c) <= 214) & c.rlike(f"^(@{part}/{part}|{part})$")


# Forms of dates and times, in the order in which they are blanked out.
DATE_FORMS = [
    r"(?m)^\s*(?:(?:yyyy[-/]MM[-/]dd|HH:mm(?::ss)?)|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}).*$",
    r"(?:yyyy[-/]MM[-/]dd|HH:mm(?::ss)?)",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
]


def strip_dates(c: Column) -> Column:
    for form in DATE_FORMS:
        c = F.regexp_replace(c, form, " ")
    return c


def value_kind(c: Column) -> Column:
    simple = F.element_at(F.split(c, r"\."), -1)
    return F.when(simple.isin(TEXTUAL + WIDE + DATES), "string").when(simple.isin(NUMERIC), "number")


def catalogue_type(c: Column) -> Column:
    simple = F.element_at(F.split(c, r"\."), -1)
    return F.when(simple.isin(TEXTUAL + WIDE + DATES), "string").when(simple.isin(NUMERIC), "number").when(F.lower(simple) == "boolean", "boolean").when(F.lower(simple) == "void", "null")


def words(c: Column) -> Column:
    """Words at case changes (`HTTPServer` is `HTTP`, `Server`) and at what is neither letter nor digit (ASCII)."""
    c = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")


def upper_camel(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")


def lower_camel(c: Column) -> Column:
    """Upper camel with the capitals before the first capital that a small letter follows lowered: all of them if there is
    no such place and nothing else, one letter if it is the first."""
    u = upper_camel(c)
    at = F.regexp_instr(u, F.lit("[A-Z][a-z]"))
    n = F.when(at > 1, at - 1).when((at == 0) & u.rlike("^[A-Z]+$"), F.length(u)).otherwise(F.lit(1))
    return F.concat(F.lower(F.left(u, n)), F.substring(u, n + 1, F.length(u)))


def upper_snake(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def without_interface_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^I(?=[A-Z])", "")


def without_enum_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "Enum$", "")


def fallback_key(field: Column, value: Column) -> Column:
    value = upper_snake(F.regexp_replace(value, "^-", "NEGATIVE_"))
    return F.concat(upper_snake(field), F.lit("_"), F.when(value == "", "VALUE").otherwise(value))


def sanitize_identifier(c: Column) -> Column:
    c = F.regexp_replace(c, "[^A-Za-z0-9_$]", "_")
    return F.when(c.rlike("^[A-Za-z_$]"), c).otherwise(F.concat(F.lit("Schema_"), c))


def safe_segment(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def repo_slug(c: Column) -> Column:
    path = F.trim(F.get(F.split(F.regexp_replace(F.trim(c), SLUG_PREFIX, ""), "[?#]"), F.lit(0)), F.lit("/"))
    path = F.regexp_replace(path, r"\.git$", "")
    return F.when(F.trim(c).rlike(SLUG_PREFIX) & path.rlike("^[^/]+/[^/]+$"), path)


def redact(c: Column, secrets: list[str] | None = None) -> Column:
    """URL tokens lose query, fragment and what stands before the first @; listed secrets and runs of space go too."""
    for s in secrets or []:
        c = F.replace(c, F.lit(s), F.lit("***"))

    def token(t: Column) -> Column:
        t2 = F.regexp_replace(t, "[?#].*$", "")
        return F.when(F.contains(t, F.lit("://")), F.regexp_replace(t2, "^(.*?://)[^@]*@", "$1***@")).otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda t: t != ""), token), " ")


def encode_segment(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_path(c: Column) -> Column:
    """Steps with `.` and `name/..` taken out; `..` at the top is dropped."""
    steps = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    stack = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.array_join(stack, "/")


def strip_extension(c: Column) -> Column:
    """Without what follows the last dot of the last step, if something stands before it; `..` is no name."""
    return F.when(c.rlike(r"(^|/)\.\.$"), c).otherwise(F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", ""))


def parent(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def resolve_ref(file: Column, ref: Column, alias: str = "@/", root: str = "src") -> Column:
    """What an import names, as a path from the top without extension: an alias under the root, all else (bare names too)
    beside the importing file."""
    inside = F.concat(F.lit(f"{root}/"), F.substring(ref, len(alias) + 1, 2**31 - 1))
    return normalize_path(strip_extension(F.when(F.startswith(ref, F.lit(alias)), inside).when(F.startswith(ref, F.lit("/")), ref).otherwise(F.concat(parent(file), F.lit("/"), ref))))


def relative_ref(source: Column, target: Column) -> Column:
    """The path that an import in `source` names `target` by."""
    a, b = F.filter(F.split(parent(source), "/"), lambda p: p != ""), F.split(strip_extension(target), "/")
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)), lambda x: x & (F.size(a) > 0)))
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    rest = F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")
    return F.when(F.size(up) > 0, rest).otherwise(F.concat(F.lit("./"), rest))


def doc_links(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.regexp_extract_all(c, F.lit(r"\{@link ([^\s}#]*)"), F.lit(1)), lambda x: x != ""), F.filter(F.split(c, r"[^A-Za-z0-9._$]+"), lambda t: t.endswith("Enum")))))


def accessor_candidates(field: Column) -> Column:
    own = F.concat(F.lit("get"), F.upper(F.substring(field, 1, 1)), F.substring(field, 2, 2**31 - 1))
    by_end = [F.when(field.endswith(s), F.lit(f"get{s}")) for s in ("Type", "Status", "State", "Code", "Id")]
    rest = [F.lit(f"get{s}") for s in ("Code", "Type", "Status", "State", "Value", "Id")]
    return F.array_distinct(F.array_compact(F.array(own, *by_end, *rest)))


def patch_files(c: Column) -> Column:
    pick = lambda p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.trim(x))
    return F.filter(F.array_union(pick(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), pick(r"(?m)^\*\*\* Move to: (.+)$")), lambda x: x != "")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _is_threshold(line: Column) -> Column:
    t = _trimmed(line)
    return F.startswith(t, F.lit("ERROR: Coverage for ")) | F.startswith(t, F.lit("ERROR: Uncovered "))


def clean_test_log(c: Column) -> Column:
    """The log without coverage lines, runs of blank lines as one, nothing blank at either end."""
    noise = lambda x: F.startswith(_trimmed(x), F.lit("Coverage enabled with ")) | _is_threshold(x)
    return _trimmed(F.regexp_replace(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~noise(x)), "\n"), "\n\n\n+", "\n\n"))


def _all_of(c: Column, title: str) -> Column:
    """Whether a summary line of this title says that n of n passed."""
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    head = F.split(F.lit(title), " ")
    k = len(title.split())

    def fits(x: Column) -> Column:
        w = words(x)
        return (F.size(w) == k + 3) & (F.slice(w, 1, k) == head) & F.get(w, F.lit(k)).rlike("^[0-9]+$") & (F.get(w, F.lit(k + 1)) == "passed") & (F.get(w, F.lit(k + 2)) == F.concat(F.lit("("), F.get(w, F.lit(k)), F.lit(")")))

    return F.exists(F.split(c, "\n"), fits)


def all_passed(c: Column) -> Column:
    return _all_of(c, "Test Files") & _all_of(c, "Tests")


def threshold_failures(c: Column) -> Column:
    """(scope, metric, actual, expected) of each failed threshold, once, of lines such as
    `ERROR: Coverage for lines (70%) does not meet global threshold (80%) for a.ts`."""
    number = r"\(([0-9.]+)%?\)"

    def pick(x: Column) -> Column:
        share = F.startswith(x, F.lit("ERROR: Coverage for "))
        rest = F.regexp_replace(x, "^ERROR: (?:Coverage for|Uncovered) ", "")
        verb = F.when(share, F.lit(" does not meet ")).otherwise(F.lit(" exceed "))
        left, right = F.get(F.split(rest, " (?:does not meet|exceed) "), F.lit(0)), F.get(F.split(rest, " (?:does not meet|exceed) "), F.lit(1))
        kind, file = F.regexp_extract(right, r"^(.+?) threshold ", 1), F.regexp_extract(right, r"\) for (.+)$", 1)
        scope = F.when(file != "", file).when(kind == "global", "All files").otherwise(kind)
        metric = F.concat(F.when(share, "").otherwise("uncovered "), F.regexp_extract(left, r"^(\w+) \(", 1))
        ok = F.contains(rest, verb) & left.rlike(number) & right.rlike(f"threshold {number}")
        return F.when(ok, F.struct(scope.alias("scope"), metric.alias("metric"), F.regexp_extract(left, number, 1).alias("actual"), F.regexp_extract(right, f"threshold {number}", 1).alias("expected")))

    return F.array_distinct(F.array_compact(F.transform(F.filter(F.split(c, "\n"), _is_threshold), lambda x: pick(_trimmed(x)))))


def coverage_only_failure(stdout: Column, stderr: Column, rows: Column, error: Column, warning: Column) -> Column:
    """F16: a run whose tests all passed and that failed by coverage thresholds alone."""
    both = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    return error.isNull() & warning.isNull() & (rows > 0) & all_passed(clean_test_log(F.coalesce(stdout, F.lit("")))) & (F.size(threshold_failures(both)) > 0)


def semver_valid(c: Column) -> Column:
    return c.rlike(SEMVER)


def semver_key(c: Column) -> Column:
    """A struct that sorts as versions do: numbers, then releases after their prereleases, whose numeric parts sort as
    numbers and below words. Null for what is no exact version."""
    part = lambda n: F.regexp_extract(c, SEMVER, n)
    numeric = lambda p: p.rlike("^[0-9]+$")
    pre = F.transform(F.filter(F.split(part(4), r"\."), lambda p: p != ""), lambda p: F.struct((~numeric(p)).alias("word"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(numeric(p), "").otherwise(p).alias("text")))
    key = F.struct(*[part(i).try_cast("decimal(20,0)").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))], (part(4) == "").alias("release"), pre.alias("pre"))
    return F.when(semver_valid(c), key)


def compare_versions(a: Column, b: Column) -> Column:
    ka, kb = semver_key(a), semver_key(b)
    return F.when(ka > kb, "newer").when(ka == kb, "equal").when(ka < kb, "older")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_hash(*cs: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *cs), 256), 1, size)


def json_payload(c: Column) -> Column:
    """The JSON value in noisy text: all of it, or what lies between the first opening and the last closing bracket."""
    return F.coalesce(F.try_parse_json(F.trim(c)), F.try_parse_json(F.regexp_extract(c, r"(?s)[\{\[].*[\}\]]", 0)))


def all_refs(c: Column) -> Column:
    """Every `$ref` value of a JSON text, once, sorted; null for what is no JSON."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.to_json(F.try_parse_json(c)), F.lit(r'"\$ref":"((?:[^"\\]|\\.)*)"'), F.lit(1))))


# Names in a route record.
ROUTE_CONFIG, ROUTE_INTERFACE, ROUTE_SIGNATURE, ROUTE_WHOLE = "httpToScfFilterConfig", "interfaceName", "methodSignature", "scfMethodPath"
ROUTE_METHOD, ROUTE_PATH, ROUTE_HOST = "httpMethod", "httpPath", "httpHost"


def normalize_route(c: Column) -> Column:
    """(interface, method, http_method, path, host) of a JSON route record, or null if it lacks one but the host. The
    nested configuration comes first, then the parts of the whole `/interface/signature`; of dotted names the last
    part counts, of signatures what stands before the bracket."""
    text = lambda p: F.get_json_object(c, f"$.{p}")
    whole = F.ltrim(F.coalesce(text(ROUTE_WHOLE), F.lit("")), F.lit("/"))
    after = F.when(F.contains(whole, F.lit("/")), F.substring(whole, F.instr(whole, "/") + 1, F.length(whole))).otherwise("")
    interface = F.substring_index(F.coalesce(text(f"{ROUTE_CONFIG}.{ROUTE_INTERFACE}"), F.substring_index(whole, "/", 1)), ".", -1)
    method = F.trim(F.substring_index(F.coalesce(text(f"{ROUTE_CONFIG}.{ROUTE_SIGNATURE}"), after), "(", 1))
    http, path = text(ROUTE_METHOD), text(ROUTE_PATH)
    ok = (interface != "") & (method != "") & http.isNotNull() & path.isNotNull()
    return F.when(ok, F.struct(interface.alias("interface"), method.alias("method"), F.upper(http).alias("http_method"), path.alias("path"), text(ROUTE_HOST).alias("host")))


def merge_owned(groups: Column, tokens: list[str], own: Column) -> Column:
    """An array of (matcher, commands): own commands dropped, groups left empty dropped, own group put last."""
    owned = lambda x: has_any(x, tokens)
    kept = F.transform(groups, lambda g: F.struct(g["matcher"].alias("matcher"), F.filter(g["commands"], lambda x: ~owned(x)).alias("commands")))
    return F.array_append(F.filter(kept, lambda g: F.size(g["commands"]) > 0), own)


def package_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))


def imports_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"), F.lit(1))


IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
EXPORTED = ["interface", "type", "const", "enum", "class"]  # fixed values: declarations that count as exported symbols


def exported_symbols(c: Column) -> Column:
    """Names that lines beginning with `export` declare, sorted."""
    def name(line: Column) -> Column:
        w = F.split(line, r"\s+")
        w = F.when(F.get(w, F.lit(1)) == "declare", F.slice(w, 2, F.size(w))).otherwise(w)
        return F.when(F.get(w, F.lit(1)).isin(EXPORTED), F.regexp_extract(F.get(w, F.lit(2)), f"^{IDENTIFIER}", 0))

    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^export\s"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(lines, name), lambda x: x.isNotNull() & (x != ""))))


def exported_enums(c: Column) -> Column:
    """(constant, wire, member) of the entries of `export const X = { .. } as const`: a member a line that ends in a
    comma; wire keys are typed (`s:` texts, `n:` whole numbers), and of equal ones the last member counts."""
    text = "|".join(rf"{q}(?:\\.|[^\\{q}])*{q}" for q in "'\"")
    entry = rf"^\s*({IDENTIFIER})\s*:\s*({text}|-?[0-9]+),"

    def members(piece: Column) -> Column:
        body = F.get(F.split(piece, r"\}\s+as\s+const", 2), F.lit(0))
        constant = F.regexp_extract(piece, rf"^({IDENTIFIER})\s*=\s*\{{", 1)
        closed = piece.rlike(r"\}\s+as\s+const") & (constant != "")
        lines = F.filter(F.split(F.regexp_replace(body, r"^[^{]*\{", ""), "\n"), lambda x: x.rlike(entry))

        def one(x: Column) -> Column:
            v = F.regexp_extract(x, entry, 2)
            wire = F.when(v.rlike("^['\"]"), F.concat(F.lit("s:"), F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(F.concat(F.lit("n:"), v))
            return F.struct(constant.alias("constant"), wire.alias("wire"), F.regexp_extract(x, entry, 1).alias("member"))

        found = F.transform(lines, one)
        later = lambda x, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["wire"] == x["wire"])
        return F.when(closed, F.filter(found, lambda x, i: ~later(x, i))).otherwise(F.slice(found, 1, 0))

    pieces = F.split(c, r"export\s+const\s+")
    return F.array_sort(F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), members)))


def enum_seed(owner: Column, accessor: Column, field: Column) -> Column:
    """Parts of a dotted owner, its last one without `Enum` and followed by what the accessor (without `get` or `is`;
    the field's name if nothing is left) adds to it: the accessor's longest start that ends at a capital or at its own
    end and that the owner ends in is not said twice."""
    parts = F.split(owner, r"\.")
    last = without_enum_suffix(F.element_at(parts, -1))
    bare = F.regexp_replace(accessor, "^(?:get|is)", "")
    said = F.when((bare != accessor) & (bare != ""), bare).otherwise(field)
    stops = F.filter(F.sequence(F.lit(1), F.length(said)), lambda i: (i == F.length(said)) | F.substring(said, i + 1, F.lit(1)).rlike("^[A-Z]"))
    cut = F.coalesce(F.array_max(F.filter(stops, lambda i: F.endswith(last, F.substring(said, F.lit(1), i)))), F.lit(0))
    rest = F.substring(said, cut + 1, F.length(said))
    return F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, F.when(rest == "", "").otherwise(upper_camel(rest)))))


def truncate_text(c: Column, n: int, note: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(note))).otherwise(c)


# Samples by what a field means.
SAMPLE_TIME, SAMPLE_DATE, SAMPLE_EMAIL = "2026-08-21T10:30:00+08:00", "2026-08-21", "mock@example.com"
SAMPLE_IMAGE, SAMPLE_URL, SAMPLE_NAME = "https://example.com/mock.png", "https://example.com/mock", "示例名称"


def semantic_value(path: Column, format: Column, h: Column) -> Column:
    """Sample value by the format and by what the last step of a path is called, in order: time, date, email, phone,
    image, url, id, name; else a tag of the field. h is a non-negative hash."""
    leaf = F.lower(F.substring_index(path, ".", -1))
    holds = lambda *ws: any_of([F.contains(leaf, F.lit(w)) for w in ws])
    ends = lambda w: F.endswith(leaf, F.lit(w))
    kind = F.coalesce(format, F.lit(""))
    digits = lambda n: F.lpad((h % 10**n).cast("string"), n, "0")
    return (
        F.when((kind == "date-time") | ends("time"), SAMPLE_TIME).when((kind == "date") | ends("date"), SAMPLE_DATE).when((kind == "email") | holds("email"), SAMPLE_EMAIL)
        .when(holds("phone", "mobile"), F.concat(F.lit("138"), digits(8))).when(holds("image", "pic", "avatar"), SAMPLE_IMAGE).when(ends("url"), SAMPLE_URL)
        .when(ends("id"), (h % 900_000 + 100_000).cast("string")).when(holds("name"), SAMPLE_NAME).otherwise(F.concat(F.lit("MOCK_"), F.upper(safe_segment(leaf)), F.lit("_"), digits(4)))
    )
