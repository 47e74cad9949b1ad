"""What the corpus operators share: reading tables, scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contractlens.sources.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_by_hash(df: DataFrame, columns: list[str], n: float, total: int) -> DataFrame:
    """About n of `total` rows of df, chosen by a hash of some columns; all if there are no more."""
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(min(1.0, n / max(total, 1)) * (1 << 40)))


def first_by_hash(df: DataFrame, columns: list[str], n: int, total: int) -> DataFrame:
    """The n of `total` rows that come first by a hash of some columns, in that order. The hash cuts most rows off
    before any are sorted, so what tasks hand on follows n and not their number."""
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    return share_by_hash(df, columns, 2 * n + 200, total).withColumn("_h", h).orderBy("_h", *columns).limit(n).drop("_h")


def slices(b: pa.RecordBatch, column: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of one string column: bounds what a task holds besides the batch."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64) + 64)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield b.slice(at, end - at)
        at = end


def per_text(df: DataFrame, column: str, fn: Callable[[list[str | None]], list[tuple]], added: str) -> DataFrame:
    """df without `column` and with the columns `added` (DDL) that fn gives for its texts, one tuple for each.

    All other columns pass as they are, so ids keep their 64 bits whether or not others are null.
    """
    more = to_arrow_schema(StructType.fromDDL(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, column):
                got = fn(part.column(column).to_pylist())
                new = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), more.types, strict=True)]
                kept = [n for n in part.schema.names if n != column]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *new], names=[*kept, *more.names])

    return df.mapInArrow(run, StructType([f for f in df.schema if f.name != column] + list(StructType.fromDDL(added))))


def map_texts(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]] | None = None, change: Callable[[list[str | None]], list[str | None]] | None = None) -> DataFrame:
    """docs with the rows that `keep` refuses dropped and the texts that `change` returns, all other columns as they
    are; n_chars follows the text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                if keep:
                    mask = keep(texts)
                    b = b.filter(pa.array(mask, pa.bool_()))
                    texts = [t for t, m in zip(texts, mask, strict=True) if m]
                if change:
                    new = change(texts)
                    b = b.set_column(b.schema.names.index("text"), "text", pa.array(new, b.column("text").type))
                    if "n_chars" in b.schema.names:
                        at = b.schema.names.index("n_chars")
                        b = b.set_column(at, "n_chars", pa.array([None if t is None else len(t) for t in new], b.column(at).type))
                yield b

    return docs.mapInArrow(run, schema)


def salted(edges: DataFrame, low: DataFrame, salts: int = 8) -> DataFrame:
    """edges (u, v) with the row of low (u, m) of each u. A node's edges are dealt to several tasks, each with a copy
    of its row, so that a node of very many edges does not meet in one."""
    s = F.pmod(F.xxhash64("v"), F.lit(salts))
    copies = low.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return edges.withColumn("s", s).join(copies.hint("shuffle_merge"), ["u", "s"]).drop("s")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node that can be reached.

    Alternating large-star and small-star rounds: every round only takes minima per node (combined map-side)
    and joins them back, so no neighbourhood is ever collected. Empty input gives an empty table; self loops
    and repeated edges do no harm.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("connected components did not settle")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(edges.select("b", "b").distinct()).toDF("node", "component").distinct()
