"""Divergence of the sources of a language by Gustavson's row accumulation.

Every (lang, source) group is a row of term shares p, most of which are the share of a term that it does not hold. The
terms lie in slices of a term-major index: for each term the groups that hold it. A slice's rows are taken one after
the other; a row scatters each of its terms through the index into one dense accumulator over its peers, so a pair of
groups leaves a slice once, however many terms it shares, and no pair of postings is emitted. What is scattered is the
change against the zero baselines (a share that only one or none of the two holds); the baselines themselves follow
from how often a share occurs in each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
SLICE = 32_768  # postings of a slice of terms, about
BLOCK = 512  # groups of a language that one task takes as rows, about
HELD = 200_000  # distinct terms that a task counts before it hands them on
SALTS = 16
#: A-Z to small letters; every other ASCII byte that is no letter parts terms.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x80 and not 0x61 <= c <= 0x7A else c for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, counted per task; the term '' stands for
    the group itself. The sums over all rows are the group's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, source, t, n, d) for (lang, source), terms in held.items() for t, (n, d) in terms.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            # Bytes that are no UTF-8 stay out of the way of others as escapes.
            text = lambda c: pa.array([x.decode("utf-8", "backslashreplace") for x in c], pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([*map(text, columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], ["lang", "source", "term", "n", "docs"])

        for whole in batches:
            for b in slices(whole, "text"):
                for lang, source, text in zip(*(b[c].cast(pa.binary()).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    group = held.setdefault((lang, source), {b"": [0, 0]})
                    size -= len(group)
                    terms: dict[bytes, int] = {}
                    for t in text.translate(FOLD).split():
                        terms[t] = terms.get(t, 0) + 1
                    for t, n in terms.items():
                        if (seen := group.get(t)) is None:
                            group[t] = [n, 1]
                        else:
                            seen[0] += n
                            seen[1] += 1
                    size += len(group)
                    if size > HELD:
                        yield out()
                        size = 0
        yield out()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) in whole numbers."""
    whole = lambda c: c.cast("decimal(20,0)")
    return 1 + _div(whole(n + 1) * F.lit(SCALE).cast("decimal(12,0)"), whole(total + terms))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def pulled(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) in whole numbers; shares reach SCALE + 1, so the square fits a long."""
    return _div((p - q) * (p - q), q)


def _accumulate(slice_: pa.Table) -> pa.Table:
    """(lang, source, peer, value): for each row group of the slice, what the terms shared with each peer change."""
    source, row = slice_["source"].to_numpy(), slice_["row"].to_numpy(zero_copy_only=False)
    groups, g = np.unique(source, return_inverse=True)
    _, t = np.unique(slice_["term"].to_numpy(), return_inverse=True)
    p, zero = slice_["p"].to_numpy(), slice_["zero"].to_numpy()
    base = np.zeros(len(groups), np.int64)
    base[g] = zero
    by_term = np.lexsort((g, t))
    start = np.searchsorted(t[by_term], np.arange(t.max() + 2 if len(t) else 1))
    peer, share_ = g[by_term], p[by_term]
    f = lambda a, b: (a - b) ** 2 // b
    out: list[tuple[str, str, int]] = []
    by_row = np.flatnonzero(row)
    by_row = by_row[np.argsort(g[by_row], kind="stable")]
    for mine in np.split(by_row, np.flatnonzero(np.diff(g[by_row])) + 1) if len(by_row) else []:
        total, seen = np.zeros(len(groups), np.int64), np.zeros(len(groups), bool)
        own = g[mine[0]]
        for part in np.array_split(mine, -(-len(mine) * len(groups) // 4_000_000)):
            n = start[t[part] + 1] - start[t[part]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[t[part]], n)
            h, q, mp = peer[at], share_[at], np.repeat(p[part], n)
            np.add.at(total, h, f(mp, q) - f(mp, base[h]) - f(base[own], q) + f(base[own], base[h]))
            seen[h] = True
        seen[own] = False
        out += [(groups[own], groups[h], total[h]) for h in np.flatnonzero(seen)]
    lang = slice_["lang"][0].as_py() if len(slice_) else ""
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([x[0] for x in out], pa.string()), "peer": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64())})


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from each other source (part `pair`,
    all) and which of its terms stand above the language's share (part `term`, the first `top`).

    Null text, lang and source are ''. A group without terms, or a language that keeps none, has pairs all the same
    (value 0 where no term is kept); repeated rows count as often as they stand; an empty table gives no rows. Other
    columns are left aside. A pair of groups is output by definition; within a language nothing else is paired.
    """
    counted = term_counts(docs).repartition("lang", "term")
    groups_n = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = groups_n.withColumn("all", F.sum("n").over(of_term)).withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("head", F.row_number().over(of_term.orderBy("source")) == 1)
    counts = materialize(counts.where(F.col("in_docs").__ge__(least_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "all", "head"), "term-counts")
    kept = counts.where("term <> ''")
    lang = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("postings"))
    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    group = counts.where("term = ''").select("lang", "source").join(group, ["lang", "source"], "left").join(lang, "lang", "left")
    group = group.withColumn("peers", F.count("*").over(Window.partitionBy("lang"))).na.fill(0)
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    group = materialize(group.withColumn("zero", zero), "term-groups")

    # Shares. A group may hold a third of all postings, so its row is copied and its postings are dealt by salt.
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    copies = group.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    j = salted.join(copies.hint("shuffle_merge"), ["lang", "source", "salt"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("lang_total"), F.col("terms"))
    slices_ = F.pmod(F.xxhash64("term"), F.ceil(F.col("postings") / SLICE))
    shares = materialize(j.select("lang", "source", "term", p.alias("p"), q.alias("q"), "zero", "n", slices_.alias("slice"), F.ceil(F.col("peers") / BLOCK).alias("blocks")), "term-shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), pulled(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Languages of very many groups: a slice is laid out once for each block of row groups.
    laid = shares.select("lang", "source", "term", "p", "zero", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), (F.pmod(F.xxhash64("source"), F.col("blocks"))).alias("own"))
    laid = laid.select("lang", "source", "term", "p", "zero", "slice", "block", (F.col("own") == F.col("block")).alias("row"))
    shared = laid.groupBy("lang", "slice", "block").applyInArrow(_accumulate, "lang string, source string, peer string, value long")

    # Baselines: how often each share occurs in a group, against the share of a term that the other does not hold.
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("often"))
    g = group.join(often.hint("shuffle_merge"), ["lang", "source"], "left").withColumn("often", F.coalesce("often", F.array().cast("array<struct<p:bigint,k:bigint>>")))
    left = g.select("lang", "source", "terms", F.col("held").alias("held"), F.col("zero").alias("z"), F.col("often").alias("o"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    right = g.select("lang", F.col("source").alias("peer"), F.col("held").alias("peer_held"), F.col("zero").alias("pz"), F.col("often").alias("po"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    pairs = left.join(right.hint("shuffle_merge"), ["lang", "salt"]).where("source <> peer")
    total = lambda often, f: F.aggregate(often, F.lit(0).cast("long"), lambda acc, x: acc + f(x["p"]) * x["k"])
    base = total("o", lambda p: pulled(p, F.col("pz"))) + total("po", lambda q: pulled(F.col("z"), q)) + (F.col("terms") - F.col("held") - F.col("peer_held")) * pulled(F.col("z"), F.col("pz"))
    both = pairs.select("lang", "source", "peer", base.alias("value")).union(shared)
    pair = both.groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))
    return pair.union(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
  row_number() OVER () AS row FROM documents),
o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
lang AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + lang.v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 1) // (lang.n + lang.v) AS q
  FROM g JOIN kept USING (lang) JOIN lang USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
one AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM one)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
