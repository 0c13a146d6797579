"""Tables from files, databases and the catalog, as DataFrames by name. Nothing is copied or read before it is used."""

from __future__ import annotations

import codecs
import csv
import os
import re
import sqlite3
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.errors import SourceError
from assaykit.functions.predicates import quoted
from assaykit.model import SourceKind
from assaykit.sources.names import column_names, sheet_name, table_name
from assaykit.sources.xlsx import read_workbook

#: File extensions; what isn't listed is read as CSV.
EXTENSIONS = {".csv": SourceKind.CSV, ".tsv": SourceKind.CSV, ".xlsx": SourceKind.EXCEL, ".xls": SourceKind.EXCEL, ".json": SourceKind.JSON, ".jsonl": SourceKind.JSON, ".parquet": SourceKind.PARQUET}
#: A folder with such a name holds files of that kind, as a job writes them.
FOLDERS = (".csv", ".tsv", ".json", ".jsonl", ".parquet")
#: URL schemes, JDBC names and default ports.
DATABASES = {
    "mysql": (SourceKind.MYSQL, "mysql", 3306),
    "mysql+pymysql": (SourceKind.MYSQL, "mysql", 3306),
    "postgres": (SourceKind.POSTGRESQL, "postgresql", 5432),
    "postgresql": (SourceKind.POSTGRESQL, "postgresql", 5432),
    "postgresql+psycopg2": (SourceKind.POSTGRESQL, "postgresql", 5432),
    "mssql": (SourceKind.MSSQL, "sqlserver", 1433),
    "oracle": (SourceKind.ORACLE, "oracle:thin", 1521),
}
#: What a CSV file's field says for null.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: What Python's codecs are called in Java.
CHARSETS = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-16-be": "utf-16be", "utf-16-le": "utf-16le"}
SEPARATORS = (",", ";", "\t")


@dataclass(frozen=True)
class Source:
    kind: SourceKind
    path: str | None = None
    table: str | None = None
    url: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


def parse_source(text: str, table: str | None = None) -> Source:
    """A database URL, a file (also file://), a catalog table (catalog://name) or a store's path to Parquet (hdfs://…)."""
    if not text or not text.strip():
        raise SourceError("the source is empty")
    text = text.strip()
    scheme = text.split("://", 1)[0].lower() if "://" in text else ""
    if scheme == "sqlite":
        path = text.split("://", 1)[1]
        path, _, inner = path.partition("?table=")
        # sqlite:///relative.db and sqlite:////absolute.db
        return Source(SourceKind.SQLITE, path[1:] if path.startswith("/") else path, table or inner or None)
    if scheme in DATABASES:
        return _database(text, scheme, table)
    if scheme in ("catalog", "hive"):
        name = text.split("://", 1)[1]
        return Source(SourceKind.HIVE, table=name or table)
    path = text[7:] if scheme == "file" else text
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if scheme in ("", "file"):
        if not os.path.exists(path):
            if suffix in EXTENSIONS or scheme == "file":
                raise FileNotFoundError(f"file not found: {path}")
            raise SourceError(f"unrecognised source: {text}")
        if os.path.isdir(path) and suffix not in FOLDERS and not any(f.endswith(".parquet") for f in os.listdir(path)):
            raise SourceError(f"not a file: {path}")
        if os.path.isdir(path) and suffix not in (".csv", ".tsv", ".json", ".jsonl"):
            return Source(SourceKind.PARQUET, path, table or table_name(PurePosixPath(path).stem))
        if os.path.isfile(path) and os.path.getsize(path) == 0:
            raise SourceError(f"file is empty: {path}")
    kind = EXTENSIONS.get(suffix, SourceKind.PARQUET if scheme not in ("", "file") else SourceKind.CSV)
    return Source(kind, path, table or table_name(PurePosixPath(path.rstrip("/")).stem))


def _database(text: str, scheme: str, table: str | None) -> Source:
    kind, jdbc, port = DATABASES[scheme]
    parts = urlsplit(text)
    if not parts.hostname:
        raise SourceError(f"no host in {scheme} URL")
    names = [n for n in parts.path.split("/") if n]
    database, _, inner = ".".join(names).partition(".")
    inner = table or (inner.rsplit(".", 1)[-1] if inner else None)
    at = f"{parts.hostname}:{parts.port or port}"
    url = {"oracle:thin": f"jdbc:oracle:thin:@//{at}/{database}", "sqlserver": f"jdbc:sqlserver://{at};databaseName={database}"}.get(jdbc, f"jdbc:{jdbc}://{at}/{database}")
    return Source(kind, table=inner, url=url, options={"user": unquote(parts.username or ""), "password": unquote(parts.password or ""), "database": database})


def read(spark: SparkSession, source: Source | str, table: str | None = None, **options: Any) -> dict[str, DataFrame]:
    """The source's tables by name: one, but for workbooks and databases named without a table.

    options: for CSV encoding and multiline (see read_csv), for databases column, parts, low, high and fetch_size (see
    jdbc_options), for workbooks and SQLite files max_mb.
    """
    s = parse_source(source, table) if isinstance(source, str) else source
    if s.kind == SourceKind.CSV:
        return {s.table: read_csv(spark, s.path, **options)}
    if s.kind == SourceKind.JSON:
        lines = s.path.lower().rstrip("/").endswith(".jsonl") or os.path.isdir(s.path)
        return {s.table: _cleaned(spark.read.json(s.path, multiLine=not lines))}
    if s.kind in (SourceKind.PARQUET, SourceKind.HDFS):
        return {s.table: spark.read.parquet(s.path)}
    if s.kind == SourceKind.EXCEL:
        return read_excel(spark, s.path, s.table, **options)
    if s.kind == SourceKind.SQLITE:
        return read_sqlite(spark, s.path, s.table, **options)
    if s.kind in (SourceKind.HIVE, SourceKind.SPARK):
        return {s.table.split(".")[-1]: spark.table(s.table)}
    if not s.table:
        raise SourceError(f"{s.kind} needs a table")
    return {s.table: spark.read.format("jdbc").options(**jdbc_options(spark, s, **options)).load()}


def jdbc_options(spark: SparkSession, source: Source, *, column: str | None = None, parts: int = 8, low: Any = None, high: Any = None, fetch_size: int = 10_000) -> dict[str, Any]:
    """Options of a JDBC read, in so many parts if a column to cut by (numbers, dates or timestamps) is named.

    Its bounds are asked of the database where they are not given; rows beyond them, or with null, are read all the same.
    """
    found: dict[str, Any] = {"url": source.url, "dbtable": source.table, "fetchsize": fetch_size}
    found |= {k: source.options[k] for k in ("user", "password") if source.options.get(k)}
    if column is None:
        return found
    if low is None or high is None:
        ends = {k: v for k, v in found.items() if k != "dbtable"} | {"query": f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {source.table}"}
        row = spark.read.format("jdbc").options(**ends).load().first()
        low, high = row[0] if low is None else low, row[1] if high is None else high
    if low is None:  # no rows, or nulls only
        return found
    return found | {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": parts}


def _cleaned(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df.columns))


def sniff_separator(path: str, encoding: str = "utf-8-sig") -> str:
    """The first of the separators that splits the header into more than one column, else a comma."""
    with open(path, encoding=encoding, errors="replace") as f:
        head = f.readline()
    if not head.strip():
        raise SourceError(f"file is empty: {path}")
    return next((s for s in SEPARATORS if s in re.sub(r'"[^"]*"', "", head)), ",")


def _header(path: str, separator: str, encoding: str) -> list[str]:
    """As written: Spark numbers repeated names in its own way."""
    with open(path, encoding=encoding, errors="replace", newline="") as f:
        return next(csv.reader(f, delimiter=separator))


def breaks_in_quotes(spark: SparkSession, path: str, encoding: str = "utf-8") -> bool:
    """Whether a quoted field may hold a line break: then some line has an odd number of quotes. One distributed pass."""
    raw = spark.read.text(path) if encoding == "utf-8" else spark.read.csv(path, sep="\u0001", quote="", encoding=encoding, header=False, schema="value string")
    return not raw.where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, *, encoding: str = "utf-8", multiline: bool | None = None) -> DataFrame:
    """With a header; types are inferred, null tokens are null, rows with too few fields are filled with null.

    A file whose quoted fields hold line breaks can't be cut, so each such file is one task's; others are read in parts.
    multiline says which it is where that is known, otherwise the lines' quotes are counted first.
    """
    local = path.removeprefix("file://")
    encoding = codecs.lookup(encoding).name
    encoding = CHARSETS.get(encoding, encoding)
    single, plain = os.path.isfile(local), encoding == "utf-8"
    own = "utf-8-sig" if plain else encoding
    separator = sniff_separator(local, own) if single else ("\t" if path.rstrip("/").endswith(".tsv") else ",")
    if multiline is None:
        multiline = breaks_in_quotes(spark, path, encoding)
    raw = spark.read.csv(path, header=True, sep=separator, inferSchema=False, mode="PERMISSIVE", multiLine=multiline, escape='"', nullValue="", encoding=encoding)
    names = column_names(_header(local, separator, own) if single else raw.columns)
    text = raw.toDF(*names)
    text = text.select(*[F.when(quoted(c).isin(*NULLS), F.lit(None)).otherwise(quoted(c)).alias(c) for c in names])
    return text.select(*[_inferred(c, kind) for c, kind in _infer(text, names).items()])


def _infer(text: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    """As in data frames of files: whole numbers unless a gap makes them floating, then booleans, else text. One pass."""
    counts = []
    for i, c in enumerate(names):
        v = F.trim(quoted(c))
        counts += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{i}"),
            F.count_if(v.try_cast("double").isNotNull() & ~v.rlike(r"[dDfF]$")).alias(f"f{i}"),
            F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}"),
        ]
    row = text.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(names):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            out[c] = T.LongType() if n == row["rows"] else T.DoubleType()
        elif n and row[f"f{i}"] == n:
            out[c] = T.DoubleType()
        elif n and row[f"b{i}"] == n == row["rows"]:
            out[c] = T.BooleanType()
        else:
            out[c] = T.StringType()
    return out


def _inferred(c: str, kind: T.DataType):
    return quoted(c) if isinstance(kind, T.StringType) else F.trim(quoted(c)).try_cast(kind).alias(c)


def _frame(spark: SparkSession, names: list[str], rows: list[list[Any]]) -> DataFrame:
    kinds = []
    for i in range(len(names)):
        seen = {type(r[i]) for r in rows if r[i] is not None}
        gap = any(r[i] is None for r in rows)
        if seen == {bool}:
            kinds.append(T.BooleanType())
        elif seen == {int}:
            kinds.append(T.DoubleType() if gap else T.LongType())
        elif seen and seen <= {int, float}:
            kinds.append(T.DoubleType())
        elif seen and all(t.__name__ == "datetime" for t in seen):
            kinds.append(T.TimestampNTZType())
        else:
            kinds.append(T.StringType())
    cast = [float if isinstance(k, T.DoubleType) else str if isinstance(k, T.StringType) else (lambda v: v) for k in kinds]
    data = [tuple(None if v is None else f(v) for v, f in zip(r, cast, strict=True)) for r in rows]
    return spark.createDataFrame(data, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def _check_size(path: str, max_mb: float) -> None:
    size = os.path.getsize(path) / 1e6
    if size > max_mb:
        raise SourceError(f"{path} has {size:.1f} MB, more than the {max_mb} MB that the driver reads; store it as Parquet, or raise max_mb")


def read_excel(spark: SparkSession, path: str, table: str | None = None, *, max_mb: float = 100) -> dict[str, DataFrame]:
    """A table per sheet; a workbook of one sheet is called as the table that was asked for. The driver reads it, up to max_mb."""
    if path.lower().endswith(".xls"):
        raise SourceError("the old binary .xls format is not supported; save the workbook as .xlsx")
    _check_size(path, max_mb)
    out = {}
    sheets = read_workbook(path)
    for name, rows in sheets.items():
        if not rows:
            continue
        width = max(map(len, rows))
        names = column_names([None if v is None else str(v) for v in rows[0] + [None] * (width - len(rows[0]))])
        body = [r + [None] * (width - len(r)) for r in rows[1:] if any(v is not None for v in r)]
        out[table if len(sheets) == 1 and table else sheet_name(name)] = _frame(spark, names, body)
    if not out:
        raise SourceError(f"workbook is empty: {path}")
    return out


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, *, max_mb: float = 500) -> dict[str, DataFrame]:
    """Through the standard library on the driver, up to max_mb, with the declared types; other databases are read by JDBC."""
    from assaykit.plans.types import from_vendor

    if not os.path.isfile(path):
        raise FileNotFoundError(f"file not found: {path}")
    _check_size(path, max_mb)
    out = {}
    kinds = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType()}
    casts = {"INTEGER": int, "FLOAT": float, "BOOLEAN": bool}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [table] if table else [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for name in names:
            quoted_name = '"' + name.replace('"', '""') + '"'
            columns = db.execute(f"PRAGMA table_info({quoted_name})").fetchall()
            if not columns:
                raise SourceError(f"table {name} not found in {path}")
            info = [from_vendor(c[2] or "TEXT").type or "STRING" for c in columns]
            rows = []
            for r in db.execute(f"SELECT * FROM {quoted_name}"):
                rows.append(tuple(None if v is None else _as(v, casts.get(k, str)) for v, k in zip(r, info, strict=True)))
            fields = [T.StructField(c[1], kinds.get(k, T.StringType()), True, {"__CHAR_VARCHAR_TYPE_STRING": c[2].lower()} if k == "STRING" and re.match(r"(var)?char\(\d+\)$", c[2] or "", re.I) else {}) for c, k in zip(columns, info, strict=True)]
            out[name] = spark.createDataFrame(rows, T.StructType(fields))
    return out


def _as(value: Any, kind: type) -> Any:
    try:
        return kind(value)
    except (TypeError, ValueError):
        return None


# Catalog operations.


def list_databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def list_columns(df: DataFrame) -> list[dict[str, Any]]:
    """name, type, nullable and the sizes that a column declares."""
    from assaykit.plans.types import from_spark

    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, **{k: v for k, v in from_spark(f).to_dict().items() if k != "type"}} for f in df.schema.fields]


def table_exists(spark: SparkSession, name: str, database: str | None = None) -> bool:
    return spark.catalog.tableExists(name, database) if database else spark.catalog.tableExists(name)


def column_exists(df: DataFrame, column: str) -> bool:
    """Whatever the case."""
    return column.lower() in {c.lower() for c in df.columns}


def count_rows(df: DataFrame, where: str | None = None) -> int:
    return (df.where(F.expr(where)) if where else df).count()


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def execute_query(spark: SparkSession, sql: str, sample_limit: int | None = None, **tables: DataFrame) -> list[dict[str, Any]]:
    """Rows of a query as dicts; tables are visible under their keywords' names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    found = spark.sql(sql)
    return [r.asDict(recursive=True) for r in (found.limit(sample_limit) if sample_limit else found).collect()]


def write_results(results: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """A results DataFrame as Parquet or JSON."""
    if form not in ("parquet", "json"):
        raise SourceError(f"results are written as parquet or json, not {form}")
    results.write.mode(mode).format(form).save(path)
