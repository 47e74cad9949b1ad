"""Readers and the publishing writer. Schemas are given, never inferred."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

NODES = T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "kind", "name", "qualified_name", "file_path", "language", "docstring", "signature", "decorators", "return_type")], T.StructField("start_line", T.IntegerType()), T.StructField("start_column", T.IntegerType())])
EDGES = T.StructType([*[T.StructField(n, T.StringType()) for n in ("source", "target", "kind", "metadata", "provenance")], T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
EVENT = "hook_event_name string, session_id string, turn_id string, tool_use_id string, tool_name string, cwd string, stop_hook_active boolean, command string, path string, content string, ts timestamp, _corrupt string"


def load_graph(nodes: DataFrame, edges: DataFrame, languages: list[str], edge_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Filters that reach the scan, and empty text for missing optional columns."""
    n = nodes.where(F.col("language").isin(languages) | (F.col("kind") == "file"))
    text = [c for c in ("signature", "decorators", "return_type", "qualified_name") if c in n.columns]
    return n.fillna("", subset=text), edges.where(F.col("kind").isin(edge_kinds))


def read_graph(spark: SparkSession, path: str, languages: list[str], edge_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    return load_graph(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges"), languages, edge_kinds)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def read_text_tree(spark: SparkSession, root: str, extensions: list[str], skip_dirs: list[str], max_bytes: int = 1_000_000) -> DataFrame:
    """Numbered lines of the files below a folder; large files, skipped folders and lock or backup files are left out.
    What is left out is dropped from the listing by the scan's file metadata and never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    def wanted(path: Column) -> Column:
        name = F.substring_index(path, "/", -1)
        keep = F.substring_index(name, ".", -1).isin(extensions) & ~name.rlike(r"(\.lock|-lock\.(json|yaml)|\.bak|~)$")
        for d in skip_dirs:
            keep &= ~F.contains(path, F.lit(f"/{d}/"))
        return keep

    # the metadata's path has its odd characters encoded, so it is decoded first; a plus sign stands for itself there
    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = files.where((F.col("_metadata.file_size") <= max_bytes) & wanted(listed))
    return lines_of(files.select("path", F.decode("content", "UTF-8").alias("text")), "path", "text")


def flatten_contracts(docs: DataFrame) -> dict[str, DataFrame]:
    """(app, text of a contract document) -> operations, properties, enum values and the patches of operations; a
    text that is no JSON has none."""
    v = docs.select("app", F.try_parse_json("text").alias("v"))
    schema = "map<string,struct<properties:map<string,struct<type:string,`$ref`:string,`enum`:array<string>>>>>"
    paths = "map<string,map<string,struct<operationId:string,summary:string,`x-patches`:array<struct<field:string,status:string,`values`:array<string>>>>>>"
    ops = v.select("app", F.explode(F.from_json(F.to_json(F.variant_get("v", "$.paths", "variant")), paths)).alias("path", "m")).select("app", "path", F.explode("m").alias("http_method", "o"))
    props = v.select("app", F.explode(F.from_json(F.to_json(F.variant_get("v", "$.components.schemas", "variant")), schema)).alias("schema", "s")).select("app", "schema", F.explode("s.properties").alias("property", "p"))
    return {
        "operations": ops.select("app", "path", "http_method", F.col("o.operationId").alias("operation_id")),
        "patches": ops.select("app", "path", "http_method", F.explode("o.x-patches").alias("x")).select("app", "path", "http_method", "x.field", "x.status", "x.values"),
        "properties": props.select("app", "schema", "property", F.col("p.type").alias("type"), F.col("p.$ref").alias("ref")),
        "values": props.select("app", "schema", "property", F.posexplode("p.enum").alias("position", "value")),
    }


def read_contracts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return flatten_contracts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("app"), F.col("value").alias("text")))


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines; what is malformed or above 64 KiB is an empty record."""
    return parse_events((spark.readStream if streaming else spark.read).text(path))


def parse_events(lines: DataFrame) -> DataFrame:
    return lines.select(F.when(F.octet_length("value") <= 65536, F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).alias("e")).select("e.*")


def publish_snapshot(df: DataFrame, base: str, snapshot: str, gates: list[Column]) -> bool:
    """Data first, its manifest row last and only if every gate holds for all rows; readers see promoted snapshots.

    Rows and gates are counted by the very pass that writes, so they speak of what was written, and df is computed once.
    Each attempt writes to a folder of its own, and the manifest names it: a snapshot that is published again is the
    former one until its new manifest row is there, and what a broken attempt left is never read."""
    attempt, seen = uuid.uuid4().hex, Observation()
    held = [F.coalesce(F.bool_and(g), F.lit(True)).alias(f"g{i}") for i, g in enumerate(gates)]
    df.observe(seen, F.count("*").alias("rows"), *held).write.parquet(f"{base}/data/snapshot={snapshot}/attempt={attempt}")
    row = seen.get
    ok = all(row[f"g{i}"] for i in range(len(gates)))
    if ok:
        _promote(df.sparkSession, base, snapshot, attempt, row["rows"])
    return ok


MANIFEST = "snapshot string, attempt string, rows long, at timestamp"


def _promote(spark: SparkSession, base: str, snapshot: str, attempt: str, rows: int) -> None:
    row = spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.lit(attempt).alias("attempt"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def _promoted(spark: SparkSession, base: str) -> DataFrame:
    """The last attempt of each snapshot."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    except AnalysisException:  # nothing promoted so far
        rows = spark.createDataFrame([], MANIFEST)
    return rows.groupBy("snapshot").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def read_published(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField("snapshot", T.StringType()), T.StructField("attempt", T.StringType())])).parquet(f"{base}/data")
    return data.join(_promoted(spark, base), ["snapshot", "attempt"], "left_semi").drop("attempt")


def publish_stream(stream: DataFrame, base: str, checkpoint: str, gates: list[Column], prefix: str = "batch") -> StreamingQuery:
    """S8 and T5 over a stream: each micro-batch is a snapshot named by its number, so a batch that is replayed after a
    failure is written again only if it was not promoted, and promoted once at most. Ends when what is there was read."""

    def publish(df: DataFrame, batch: int) -> None:
        name = f"{prefix}-{batch}"
        if _promoted(df.sparkSession, base).where(F.col("snapshot") == name).isEmpty():
            publish_snapshot(df, base, name, gates)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
