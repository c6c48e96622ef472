"""Reading and writing: vectors from text, files for ingest, property graphs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions import vectors as V

TEXT_FILES = ("txt", "md", "json", "csv", "log")


def vectors_from_text(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """One vector a line, comma separated; a line of other length raises."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(V.parse(F.col("value")).alias("embedding"))
    if dims is not None:
        rows = rows.select(F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("dimension mismatch"))).alias("embedding"))
    return rows


def vectors_from_json(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding, metadata, content, one JSON object a line."""
    return spark.read.schema("id string, embedding array<double>, metadata map<string,string>, content string").json(path)


def text_files(spark: SparkSession, path: str, max_bytes: int = 10 << 20) -> DataFrame:
    """path, size, skipped, sha256, content of text files; other types are left out. A file above the size has skipped true and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    small = F.col("length") <= max_bytes
    return files.where(kind.isin(*TEXT_FILES)).select("path", F.col("length").alias("size"), (~small).alias("skipped"), F.when(small, F.sha2("content", 256)).alias("sha256"), F.when(small, F.decode("content", "UTF-8")).alias("content"))


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """path, vector, k of small query files with lines `vector: a, b, ...` and `k: n` (5 if there is none)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    k = F.regexp_extract("value", r"(?m)^\s*k:\s*(\d+)", 1)
    return text.select("path", V.parse(F.regexp_extract("value", r"(?m)^\s*vector:\s*(.+?)\s*$", 1)).alias("vector"), F.when(k != "", k.cast("int")).otherwise(5).alias("k"))


def embedding_sink(rows: DataFrame, path: str, key: str = "path", vector_col: str = "embedding") -> None:
    """Appends embeddings keyed by path, with their length and a checksum of the vector."""
    v = V.vec(vector_col)
    rows.select(key, v.alias("embedding"), F.size(v).alias("dims"), F.xxhash64(v).alias("checksum")).write.mode("append").parquet(path)


def checked_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """What `embedding_sink` wrote; a vector that does not have its checksum raises."""
    rows = spark.read.parquet(path)
    good = (F.xxhash64("embedding") == F.col("checksum")) & (F.size("embedding") == F.col("dims"))
    return rows.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("damaged vector of "), F.col(rows.columns[0]).cast("string")))))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Writes named tables below a folder that must not hold them yet."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The named tables of a backup."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def render(rows: DataFrame, kind: str = "human", n: int = 20) -> str:
    """The first rows as text: json (one object a line), compact (values by tabs), table, or human (name: value lines)."""
    some = rows.limit(n)
    if kind == "json":
        return "\n".join(r["j"] for r in some.select(F.to_json(F.struct(*some.columns)).alias("j")).collect())
    got = some.collect()
    if kind == "compact":
        return "\n".join("\t".join(str(x) for x in r) for r in got)
    if kind == "human":
        return "\n\n".join("\n".join(f"{c}: {r[c]}" for c in rows.columns) for r in got)
    if kind != "table":
        raise ValueError(f"unknown kind {kind}")
    width = [max([len(c), *(len(str(r[c])) for r in got)]) for c in rows.columns]
    line = lambda xs: " | ".join(str(x).ljust(w) for x, w in zip(xs, width)).rstrip()
    return "\n".join([line(rows.columns), "-+-".join("-" * w for w in width), *(line(r) for r in got)])


def export(rows: DataFrame, path: str, kind: str = "json", fields: list[str] | None = None, limit: int | None = None) -> None:
    """Writes rows, or some columns or first rows of them, in any format of Spark's writers."""
    out = rows.select(*fields) if fields else rows
    out = out.limit(limit) if limit is not None else out
    getattr(out.write.mode("errorifexists"), kind)(path)


def graph_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as `graph_to_json` writes them."""
    nodes = spark.read.schema("id long, type string, properties map<string,string>").json(f"{path}/nodes")
    return nodes, spark.read.schema("src long, dst long, type string, weight double").json(f"{path}/edges")


def graph_to_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes (id, type, properties) and edges (src, dst, type, weight) below a new folder."""
    nodes.write.mode("errorifexists").json(f"{path}/nodes")
    edges.write.mode("errorifexists").json(f"{path}/edges")


def node_text(kind: Column, properties: Column) -> Column:
    """The text that stands for a node when it is embedded."""
    lines = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("Type: "), kind), F.array_join(lines, "\n"))
