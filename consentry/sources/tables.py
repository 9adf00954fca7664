"""Table sources: files, databases, governance catalogs, change-tracking reads."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.functions.shapes import coerce_parameter
from consentry.model import GOVERNANCE_SCHEMAS, Subject


def governance_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the governance catalog, with its declared schema."""
    return spark.read.schema(GOVERNANCE_SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_governance_table(df: DataFrame, root: str, name: str) -> None:
    schema = GOVERNANCE_SCHEMAS[name]
    have = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    df.select(*columns).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


# Names a source type may have, and the URL prefix of each database.
DIALECTS = {
    "sqlserver": ("mssql", "sqlserver", "sql_server", "microsoft sql server"),
    "sqlite": ("sqlite", "sqlite3"),
    "postgresql": ("postgres", "postgresql", "pgsql", "npgsql"),
    "databricks": ("databricks", "spark", "sparksql"),
    "oracle": ("oracle", "oracledb", "odp"),
}
DATABASE_URLS = {
    "sqlserver": "jdbc:sqlserver:",
    "sqlite": "jdbc:sqlite:",
    "postgresql": "jdbc:postgresql:",
    "databricks": "jdbc:databricks:",
    "oracle": "jdbc:oracle:",
}


def dialect_of(source_type: str | None) -> str:
    """Database of a source type; an unknown or empty one is PostgreSQL."""
    name = (source_type or "").strip().lower()
    return next((d for d, names in DIALECTS.items() if name in names), "postgresql")


def database_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 64,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel slices; filters and columns are pushed down.

    The driver jar of the database must be on the class path.
    """
    if not url.startswith(tuple(DATABASE_URLS.values())):
        raise ValueError("unknown database URL")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def scan_report(df: DataFrame, filtered: DataFrame) -> DataFrame:
    """Files of a table, and how many of them a filtered read of it opens.

    Both come from the plans: the table's file listing, and the files that the filtered scan lists after pruning. No row is
    read.
    """
    total, scanned = len(df.inputFiles()), _files_opened(filtered)
    percent = round((total - scanned) * 100.0 / total, 2) if total else 0.0
    return df.sparkSession.createDataFrame(
        [(total, scanned, total - scanned, percent)],
        "files_total long, files_scanned long, files_pruned long, pruned_percent double",
    )


def _files_opened(df: DataFrame) -> int:
    """Files that the scans of a frame list once their plans are ready."""
    execution = df._jdf.queryExecution()
    execution.toRdd().getNumPartitions()
    scans, n = execution.executedPlan().collectLeaves().iterator(), 0
    while scans.hasNext():
        listed = scans.next().metrics().get("numFiles")
        n += listed.get().value() if listed.isDefined() else 0
    return n


def changes_since(df: DataFrame, version: str, watermark: int, batch: int | None = 500) -> DataFrame:
    """Next rows after a change version; ``batch`` bounds one poll.

    A poll ends on a version border: it returns every row up to and including the version of the ``batch``-th row, so
    the next watermark skips none. A version with more rows than ``batch`` comes back whole.
    """
    rows = df.where(F.col(version) > watermark)
    if not batch:
        return rows
    border = rows.select(F.col(version).alias("_border")).orderBy("_border").limit(batch).agg(F.max("_border"))
    return rows.where(F.col(version) <= border.scalar())


def next_watermark(rows: DataFrame, version: str, watermark: int) -> DataFrame:
    return rows.agg(
        F.coalesce(F.max(version), F.lit(watermark)).cast("long").alias("watermark"),
        F.count("*").alias("changes"),
    )


def stream_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


@dataclass
class Parameter:
    name: str
    kind: str = "string"
    required: bool = False
    default: str | None = None


@dataclass
class Endpoint:
    """A named, parameterised query."""

    name: str
    sql: str
    summary: str = ""
    source: str = "default"
    method: str = "GET"
    timeout: int = 30
    parameters: list[Parameter] = field(default_factory=list)

    def bind(self, values: Mapping[str, object]) -> dict[str, object]:
        given = {k.lower(): v for k, v in values.items()}
        return {
            p.name: coerce_parameter(given.get(p.name.lower()), p.kind, p.required, p.default, p.name)
            for p in self.parameters
        }

    def run(self, governor, subject: Subject, values: Mapping[str, object] | None = None, **options) -> DataFrame:
        """Runs over governed views, with values bound as parameters."""
        pieces = re.split(r"('(?:[^']|'')*')", self.sql)
        pieces[::2] = [re.sub(r"(?<![\w@])@(\w+)", r":\1", p) for p in pieces[::2]]
        text = "".join(pieces)
        return governor.sql(text, subject, args=self.bind(values or {}), **options)


# Spellings of parameter types.
PARAMETER_TYPES = {
    "int": ("int", "integer", "int32"),
    "long": ("long", "bigint", "int64"),
    "decimal": ("decimal", "numeric", "money"),
    "double": ("float", "double", "real"),
    "bool": ("bool", "boolean"),
    "datetime": ("date", "datetime", "timestamp"),
    "guid": ("guid", "uuid"),
}


def _parameter(text: str) -> Parameter:
    """``name type [required] [default=x]``."""
    words = text.replace(":", " ").split()
    kind = words[1].lower() if len(words) > 1 else "string"
    kind = next((k for k, names in PARAMETER_TYPES.items() if kind in names), "string")
    default = re.search(r"default\s*=\s*(.+)$", text, re.IGNORECASE)
    return Parameter(
        words[0].lstrip("@"),
        kind,
        "required" in [w.lower() for w in words[2:]],
        default.group(1).strip(" \"'") if default else None,
    )


def parse_endpoint(text: str, name: str = "endpoint") -> Endpoint:
    """Reads ``-- @name``, ``@summary``, ``@datasource``, ``@method``, ``@timeout`` and
    ``@param`` headers; the rest is the query.

    Without a summary the other leading comments serve. A parameter the query uses but
    no header declares is a required text.
    """
    end = Endpoint(name, "")
    body, comments, declared = [], [], {}
    for line in text.splitlines():
        header = re.match(r"\s*--\s*@(\w+)\s*:?\s*(.*)$", line)
        if not header:
            remark = re.match(r"\s*--\s*(.+)$", line)
            (comments if remark else body).append(remark.group(1).strip() if remark else line)
            continue
        key, rest = header.group(1).lower(), header.group(2).strip()
        if key == "name":
            end.name = rest or end.name
        elif key in ("summary", "description"):
            end.summary = rest
        elif key in ("datasource", "data_source"):
            end.source = rest
        elif key in ("method", "http_method"):
            end.method = rest.upper()
        elif key == "timeout" and rest.isdigit():
            end.timeout = int(rest)
        elif key == "param" and rest:
            p = _parameter(rest)
            declared[p.name.lower()] = p
    end.sql = "\n".join(body).strip()
    if not end.sql:
        raise ValueError("the endpoint has no query")
    end.summary = end.summary or " ".join(comments)
    bare = re.sub(r"'(?:[^']|'')*'", "''", end.sql)
    for used in dict.fromkeys(re.findall(r"(?<![\w@])@(\w+)", bare)):
        found = declared.get(used.lower())
        kind = found or Parameter(used, required=True)
        end.parameters.append(Parameter(used, kind.kind, kind.required, kind.default))
    return end


def load_endpoints(folder: str) -> dict[str, Endpoint]:
    found = (parse_endpoint(p.read_text(), p.stem) for p in sorted(Path(folder).glob("*.sql")))
    return {e.name: e for e in found}


def register_models(spark: SparkSession, models: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> list[str]:
    """A view per model with its documented columns."""
    for name, df in models.items():
        df.select(*columns.get(name, df.columns)).createOrReplaceTempView(name)
    return sorted(models)
