"""Reading heterogeneous files into fixed schemas: dispatch by format, sniffed delimiters, column aliases, unions, archives."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".parquet", ".json", ".jsonl", ".ndjson", ".csv", ".tsv", ".txt")
DELIMITERS = [",", "\t", ";", "|"]
#: Keys under which a JSON document may hold its rows.
WRAPPERS = ["data", "records", "rows", "items"]


def canonical(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.strip().lower())


def resolve_column(columns: list[str], aliases: list[str]) -> str | None:
    """The column an alias names: equal first; then an alias of five letters or more within a column; then such a column within an alias that it makes up at least 60 % of."""
    have = [(c, canonical(c)) for c in columns]
    wanted = [canonical(a) for a in aliases]
    for a in wanted:
        for c, k in have:
            if k == a:
                return c
    for a in wanted:
        for c, k in have:
            if len(a) >= 5 and a in k:
                return c
    for a in wanted:
        for c, k in have:
            if len(k) >= 5 and k in a and len(k) >= 0.6 * len(a):
                return c
    return None


def resolve_columns(columns: list[str], table: dict[str, list[str]], required: tuple[str, ...] = ()) -> dict[str, str | None]:
    out = {name: resolve_column(columns, aliases) for name, aliases in table.items()}
    lacking = [n for n in required if out.get(n) is None]
    if lacking:
        raise KeyError(f"no column for {', '.join(lacking)} among {columns}")
    return out


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first lines share: the one whose count is steady and highest; from 20 lines that Spark reads."""
    lines = [r.value for r in spark.read.text(path).limit(20).collect() if r.value.strip()]
    if not lines:
        return ","
    steady = [d for d in DELIMITERS if lines[0].count(d) and all(x.count(d) == lines[0].count(d) for x in lines)]
    return max(steady or DELIMITERS, key=lambda d: lines[0].count(d))


def suffix(path: str) -> str:
    """The data suffix of a path, .gz taken off."""
    p = path.lower().rstrip("/").removesuffix(".gz")
    return next((s for s in SUFFIXES if p.endswith(s)), "")


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, sep: str | None = None) -> DataFrame:
    """A file of any known format; all delimited columns are strings, so long ids survive; malformed lines are left out."""
    kind = suffix(path)
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind in (".jsonl", ".ndjson"):
        df = spark.read.option("mode", "DROPMALFORMED").json(path)
    elif kind == ".json":
        df = read_json(spark, path)
    elif kind:
        df = spark.read.option("header", True).option("sep", sep or sniff_delimiter(spark, path)).option("mode", "DROPMALFORMED").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format: {path}")
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of rows, lines, a document that wraps its rows, or a map from ids to rows (then with id)."""
    first = next((r.value.strip() for r in spark.read.text(path).limit(50).collect() if r.value.strip()), "")
    if not first.startswith("{"):
        return spark.read.option("multiLine", True).json(path)
    df = spark.read.option("multiLine", True).json(path)
    for w in WRAPPERS:
        if w in df.columns and df.schema[w].dataType.typeName() == "array":
            inner = df.select(F.explode(w).alias("x"))
            return inner.select("x.*") if inner.schema["x"].dataType.typeName() == "struct" else inner
    kinds = {f.dataType.simpleString() for f in df.schema.fields}
    if len(df.columns) > 1 and all(k.startswith("struct") for k in kinds):
        parts = [df.select(F.lit(c).alias("id"), F.col(f"`{c}`.*")) for c in df.columns]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def read_many(spark: SparkSession, paths: list[str], source: bool = True, rows_per_file: int | None = None, files: int | None = None) -> DataFrame:
    """The union by name of several files, with the name of each row's file and folder; files without rows or that can't be read are passed over.

    rows_per_file and files are a caller's own limits; if no file can be read the last problem is raised.
    """
    parts, problem = [], ValueError("no files")
    for p in paths[:files]:
        try:
            df = read_any(spark, p, limit=rows_per_file)
            if df.isEmpty():
                continue
        except Exception as e:  # noqa: BLE001 - a broken file must not stop the others
            problem = e
            continue
        if source:
            at = F.col("_metadata.file_path") if suffix(p) != ".json" else F.lit(p)
            df = df.select("*", at.alias("_at")).withColumn("__source_file", F.element_at(F.split("_at", "/"), -1)).withColumn("__source_dir", F.element_at(F.split("_at", "/"), -2)).drop("_at")
        parts.append(df)
    if not parts:
        raise problem
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def find_files(spark: SparkSession, root: str, pattern: str = "*", suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Data files below a folder of any store, in order; hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return sorted(r.path for r in files.collect() if suffix(r.path) in suffixes and not r.path.rsplit("/", 1)[-1].startswith((".", "_")))


def read_headerless(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Delimited lines without header and quotes, under a fixed schema."""
    return spark.read.schema(schema).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def archive_members(spark: SparkSession, path: str, names: str = r"\.(csv|tsv|txt|jsonl?)$") -> DataFrame:
    """(archive, member, content) of zip and tar files whose member names match; read where they lie, nothing is unpacked to disk."""
    rx = re.compile(names)

    def members(batches):
        import io
        import tarfile
        import zipfile

        for b in batches:
            out = []
            for at, raw in zip(b["path"], b["content"], strict=True):
                f = io.BytesIO(raw)
                if zipfile.is_zipfile(f):
                    with zipfile.ZipFile(f) as z:
                        out += [(at, n, z.read(n)) for n in sorted(z.namelist()) if rx.search(n) and "__MACOSX" not in n]
                else:
                    f.seek(0)
                    try:
                        with tarfile.open(fileobj=f) as t:
                            out += [(at, m.name, t.extractfile(m).read()) for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile() and rx.search(m.name)]
                    except tarfile.TarError:
                        continue
            yield pd.DataFrame(out, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def archive_table(spark: SparkSession, path: str, name: str, columns: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """(columns as strings, __source_dir) of the CSV file `name` in every archive within the archives at path.

    __source_dir is the inner archive's name without its endings.  Nothing is
    unpacked to disk; rows are read in pieces, an archive at a time in a task.
    """
    left = tuple(x.lower() for x in skip)

    def rows(batches):
        import io
        import tarfile
        import zipfile

        def inner(raw: bytes):
            f = io.BytesIO(raw)
            if zipfile.is_zipfile(f):
                with zipfile.ZipFile(f) as z:
                    yield from ((n, z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith(".zip"))
            else:
                f.seek(0)
                with tarfile.open(fileobj=f) as t:
                    yield from ((m.name, t.extractfile(m).read()) for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.lower().endswith(".zip"))

        for b in batches:
            for raw in b["content"]:
                for member, blob in inner(raw):
                    group = re.sub(r"(\.csv)?\.zip$", "", member.rsplit("/", 1)[-1], flags=re.IGNORECASE)
                    if group.lower() in left:
                        continue
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        for n in z.namelist():
                            if n.rsplit("/", 1)[-1].lower() == name.lower() and "__MACOSX" not in n:
                                with z.open(n) as f:
                                    for part in pd.read_csv(f, dtype=str, chunksize=100_000, encoding="utf-8", encoding_errors="replace", on_bad_lines="skip"):
                                        yield part.reindex(columns=columns).assign(__source_dir=group)

    schema = ", ".join(f"`{c}` string" for c in [*columns, "__source_dir"])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def extract_archives(spark: SparkSession, path: str, to: str) -> DataFrame:
    """(archive, member, content) of an archive's members, written once below `to` by the committed writer.

    The writer's own mark of success is the sentinel: with it the members are
    read from there and the archive isn't opened.  Names that lead out of a
    folder are left out.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        safe = ~F.col("member").startswith("/") & ~F.array_contains(F.split("member", r"[/\\]"), "..")
        archive_members(spark, path, ".").where(safe).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def readiness(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """(dataset, status, files, bytes): READY, EMPTY or MISSING for each named folder."""
    rows = []
    for name, root in places.items():
        try:
            f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length")
            n, b = f.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            rows.append((name, "READY" if n else "EMPTY", n, b))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.append((name, "MISSING", 0, 0))
    return spark.createDataFrame(rows, "dataset string, status string, files long, bytes long").orderBy("status", "dataset")
