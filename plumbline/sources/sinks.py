"""Where results go: tables, JSON lines, a manifest, a denormalised export, appended analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_frame(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> str:
    """Parquet, gzipped CSV with a header (nested columns as JSON), or gzipped JSON lines."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).option("header", True).option("compression", "gzip").csv(path)
    elif kind == "json":
        df.write.mode(mode).option("compression", "gzip").json(path)
    else:
        raise ValueError(f"unknown kind {kind}")
    return path


def export_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts under one another by column name, with row_type; lists become words."""
    flat = [df.select(F.lit(kind).alias("row_type"), *(F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes)) for kind, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)


def register(spark: SparkSession, path: str, dataset: str, provenance: str, df: DataFrame, note: str = "") -> None:
    """Append an entry to the manifest below path; see :func:`manifest` for what is current."""
    row = df.agg(F.count("*").alias("rows")).select(F.lit(dataset).alias("dataset"), F.lit(provenance).alias("provenance"), "rows", F.lit(",".join(df.columns)).alias("columns"), F.lit(note).alias("note"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each dataset."""
    kind = "dataset string, provenance string, rows long, columns string, note string, at timestamp"
    w = Window.partitionBy("dataset").orderBy(F.desc("at"))
    return spark.read.schema(kind).json(path).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def assert_real(manifest_: DataFrame, required: list[str]) -> None:
    """Every required dataset is registered, and as real."""
    have = {r.dataset: r.provenance for r in manifest_.where(F.col("dataset").isin(required)).select("dataset", "provenance").collect()}
    bad = [d for d in required if have.get(d) != "REAL"]
    if bad:
        raise ValueError(f"not real data: {', '.join(f'{d} ({have.get(d, 'missing')})' for d in bad)}")


def save_analyses(df: DataFrame, path: str) -> None:
    """Append analyses (analysis_type, score, label, details struct) with the details as JSON."""
    d = df.withColumn("details_json", F.to_json("details")).drop("details").withColumn("created_at", F.current_timestamp())
    d.write.mode("append").parquet(path)


def details(json: Column) -> Column:
    """A details cell as a variant: what it parses to if that is an object, else the empty object; null, broken and other JSON alike."""
    v = F.try_parse_json(json)
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), v), F.parse_json(F.lit("{}")))


def dashboard(records: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, the latest records).  limit: 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    totals = records.agg(F.count("*").alias("total"), F.count_if(F.col("analysis_type") == "text").alias("texts"), F.count_if(F.col("analysis_type") == "network").alias("networks"), F.count_if(F.col("score") >= 0.6).alias("high_risk"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    return totals, records.orderBy(F.desc("created_at")).limit(limit)


def manifest_summary(manifest_: DataFrame) -> DataFrame:
    """(provenance, datasets, rows) of a manifest's current entries."""
    return manifest_.groupBy("provenance").agg(F.count("*").alias("datasets"), F.sum("rows").alias("rows")).orderBy("provenance")


def status_table(readiness_: DataFrame, manifest_: DataFrame) -> DataFrame:
    """(dataset, status, files, bytes, provenance, rows): what is on disk beside what was registered, problems first."""
    j = readiness_.join(manifest_.select("dataset", "provenance", "rows"), "dataset", "full_outer")
    order = F.when(F.col("status") == "MISSING", 0).when(F.col("status") == "UNKNOWN", 1).when(F.col("status") == "EMPTY", 2).otherwise(3)
    return j.select("dataset", F.coalesce("status", F.lit("UNKNOWN")).alias("status"), "files", "bytes", F.coalesce("provenance", F.lit("UNREGISTERED")).alias("provenance"), "rows").orderBy(order, "dataset")
