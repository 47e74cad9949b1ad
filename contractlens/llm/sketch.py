"""Threshold-scaled sketches in DataFrame functions alone.

A text's sketch is the sorted set of its five-word shingle hashes below a fixed fraction of the hash range. As the
rule looks at one hash only, sketches of two texts hold the same sample of what the texts share however unequal
they are: the union of sketches is the sketch of the union, and |A n B| / |A| estimates how much of A is in B.
A fingerprint of a text without any hash so low is its least hash, so that short texts keep one; such a stand-in is no
part of a sketch and is never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WORDS = 5
FRACTION = 0.25
QUANTILES, STEPS = 1024, 64  # parts of equally many ids, and equal steps within each: bounds the table that is broadcast
ROWS = 2000  # that a bucket of neighbours should hold


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION, stand_in: bool = False) -> Column:
    """Sorted distinct hashes below the threshold. Texts below `words` words are one shingle; texts without words have
    none. With `stand_in`, the least hash of a text that has none so low."""
    limit = -(2**63) + int(2**64 * fraction)
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(*[F.get(w, i + j - 1) for j in range(words)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(long)

    def keep(h: Column) -> Column:
        low = F.filter(h, lambda x: x < limit)
        kept = F.array_sort(F.array_distinct(low))
        return F.when((F.size(low) > 0) | (F.size(h) == 0), kept).otherwise(F.array(F.array_min(h))) if stand_in else kept

    # Each step binds its input to a lambda variable, so that no step is computed once per element.
    return F.element_at(F.transform(F.transform(F.array(tokens), hashes), keep), 1)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_sketches(df: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """One sketch for each group of rows: that of all their texts together. Hashes are made distinct map-side first."""
    each = df.select(*by, F.explode(column).alias("_h")).distinct()
    merged = each.groupBy(*by).agg(F.array_sort(F.collect_list("_h")).alias(column))
    none = df.select(*by).distinct().join(merged.hint("shuffle_merge"), by, "left")
    return none.withColumn(column, F.coalesce(column, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column) -> Column:
    """|A n B| / |A u B|, between 0 and 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Share of A's sketch that is in B's; an empty A is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: that of the next row by descending doc_id (after the last: the first).

    Rows are dealt into buckets of neighbouring ids; the highest row of each bucket is also sent to the bucket
    above, whose last row it follows. So no window spans the table. Null ids come last; equal ids go by text.
    """
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    bounds = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * QUANTILES)).alias("b")).first()["b"] or [0]
    low = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    # The part whose least id is the last one at or below the row's, however ids are spread, and a step within it.
    docs = docs.withColumn("part", F.greatest(F.size(F.filter(low, lambda b: b <= F.col("k"))), F.lit(1)))
    edge = lambda i: F.coalesce(F.get(low, F.least(i, F.size(low) - 1)), F.lit(0)).cast("double")
    width = F.greatest(edge(F.col("part")) - edge(F.col("part") - 1), F.lit(1.0))
    step = F.least(F.greatest(F.floor((F.col("doc_id").cast("double") - edge(F.col("part") - 1)) / width * STEPS), F.lit(0)), F.lit(STEPS - 1))
    docs = docs.withColumn("cell", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("part") * STEPS + step).cast("int")).drop("part")
    # At most QUANTILES * STEPS cells from here on, however large the table: one task may hold and broadcast them.
    running = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = docs.groupBy("cell").agg(F.count("*").alias("n"), F.max("k").alias("top"))
    cells = cells.select("cell", "top", F.floor(F.coalesce(F.sum("n").over(running), F.lit(0)) / ROWS).alias("b"))
    cells = cells.withColumn("bucket", F.dense_rank().over(Window.orderBy("b")))
    cells = cells.withColumn("head", F.max("top").over(Window.partitionBy("bucket"))).withColumn("last", F.max("bucket").over(Window.partitionBy()))
    cells = cells.select("cell", "bucket", "head", F.when(F.col("bucket") == F.col("last"), 1).otherwise(F.col("bucket") + 1).alias("above"), (F.col("bucket") == F.col("last")).alias("wraps"))
    seats = docs.join(F.broadcast(cells), "cell")
    own = F.struct(F.col("bucket").alias("seat"), F.lit(False).alias("guest"), F.lit(False).alias("after"))
    guest = F.struct(F.col("above").alias("seat"), F.lit(True).alias("guest"), F.col("wraps").alias("after"))
    seats = seats.withColumn("s", F.explode(F.when(F.col("k") == F.col("head"), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("s.seat").orderBy(F.col("s.after"), F.col("k").desc(), F.col("text"))
    seats = seats.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where(~F.col("s.guest"))
    return seats.drop("k", "cell", "bucket", "head", "above", "wraps", "s")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Sketch of each text and of its edited form, and how alike it is to that and to the next document.

    Null texts count as empty: no hashes, fingerprint ''. Rows map one to one; a lone row is its own next. Null ids come
    last, rows of equal id go by text, and extra columns are left aside.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d.withColumn("sk", sketch(F.col("text"), stand_in=True)), ["text", "sk"])
    n = F.length("text").cast("long")
    d = d.withColumn("n_chars", n).withColumn("edited", F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 3)))"), F.expr("left(next_text, int(floor(length(text) / 3)))"))).drop("text", "next_text")
    d = d.withColumn("esk", sketch(F.col("edited"), stand_in=True))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("sk")).alias("fingerprint"), as_string(F.col("esk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("esk")).alias("near_edited"), resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
        containment(F.col("sk"), F.col("next_sk")).alias("in_next"), containment(F.col("next_sk"), F.col("sk")).alias("holds_next"),
    )


def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
