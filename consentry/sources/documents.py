"""JSON payloads: nested rows, test results, model manifests, service descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions.shapes import value_kind


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files, one row per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def _step(path: str) -> str:
    return "$" + "".join(f".{p}" for p in path.split(".") if p)


def payload_rows(df: DataFrame, payload: str, path: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element under a dotted path: an array gives its elements, an object
    one row, anything else (or a missing path) none. The row is a ``variant``."""
    root = F.try_variant_get(F.try_parse_json(payload), _step(path), "variant")
    kind = F.schema_of_variant(root)
    rows = (
        F.when(kind.startswith("ARRAY"), F.expr("cast(_root as array<variant>)"))
        .when(kind.startswith("OBJECT"), F.array("_root"))
        .otherwise(F.lit(None).cast("array<variant>"))
    )
    return (
        df.withColumn("_root", root)
        .withColumn("_root", F.when(F.schema_of_variant("_root") != "VOID", F.col("_root")))
        .select(*keep, F.explode(rows).alias("row"))
    )


def payload_fields(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., name, value, kind) per member of each row; nested values stay raw JSON."""
    members = F.from_json(F.to_json("row"), "map<string,string>")
    out = rows.select(*keep, F.explode(members).alias("name", "value"))
    nested = F.substring("value", 1, 1).isin("{", "[")
    return out.withColumn("kind", F.when(nested, "json").otherwise(value_kind(F.col("value"))))


def result_rows(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a nested result: ``jsonRows``, ``rows``/``items``/``nodes``,
    ``edges[].node`` or a bare list, whichever is found first."""
    def at(path: str) -> Column:
        return F.from_json(F.get_json_object(payload, path), "array<string>")

    edges = F.transform(at("$.edges"), lambda e: F.get_json_object(e, "$.node"))
    found = F.coalesce(
        F.from_json(F.get_json_object(payload, "$.jsonRows"), "array<string>"),
        at("$.rows"),
        at("$.items"),
        at("$.nodes"),
        edges,
        F.from_json(F.col(payload), "array<string>"),
    )
    return df.select(*keep, F.explode(found).alias("row"))


RUN_RESULTS = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [T.StructField("dbt_version", T.StringType()), T.StructField("generated_at", T.StringType())]
            ),
        ),
        T.StructField("elapsed_time", T.DoubleType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("unique_id", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("execution_time", T.DoubleType()),
                        T.StructField("failures", T.IntegerType()),
                        T.StructField("message", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def run_results(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per test or model result of a run document."""
    parsed = df.withColumn("_run", F.from_json(payload, RUN_RESULTS))
    return parsed.select(
        *keep,
        F.coalesce("_run.metadata.dbt_version", F.lit("unknown")).alias("tool_version"),
        F.col("_run.metadata.generated_at").alias("generated_at"),
        F.explode("_run.results").alias("_r"),
    ).select(*keep, "tool_version", "generated_at", "_r.*")


_MANIFEST = """
nodes map<string, struct<
  resource_type: string, name: string, schema: string, description: string, tags: array<string>,
  columns: map<string, struct<name: string, data_type: string, description: string,
                              tags: array<string>, meta: map<string, string>>>>>
"""


def manifest_columns(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the models of a manifest, with the mask their tags propose."""
    nodes = df.select(*keep, F.explode(F.from_json(F.col(payload), _MANIFEST)["nodes"]).alias("node_id", "n"))
    models = nodes.where(F.coalesce("n.resource_type", F.lit("model")) == "model")
    columns = models.select(
        *keep,
        F.col("n.name").alias("model"),
        F.col("n.schema").alias("schema_name"),
        F.explode("n.columns").alias("_key", "c"),
    )
    tags = F.coalesce("c.tags", F.array().cast("array<string>"))
    name = F.coalesce("c.name", "_key")
    personal = F.exists(tags, lambda t: F.lower(t).isin("pii", "sensitive")) | (
        F.lower(F.coalesce(F.try_element_at("c.meta", F.lit("pii")), F.lit(""))) == "true"
    )
    proposal = F.when(personal & F.lower(name).contains("mail"), "MASK_EMAIL").when(personal, "REDACT")
    return columns.select(
        *keep,
        "model",
        "schema_name",
        name.alias("column_name"),
        F.col("c.data_type").alias("data_type"),
        tags.alias("tags"),
        personal.alias("is_sensitive"),
        proposal.alias("proposed_rule"),
    )


_SERVICE = """
paths map<string, string>,
components struct<schemas: map<string, struct<
  description: string, required: array<string>, properties: string>>>
"""
_PROPERTY = "struct<type: string, format: string, description: string, `x-sensitive`: boolean>"


def service_tables(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Catalog tables of a service description, with columns, primary key and path.

    Key: the required properties, else the first property called ``id`` or ``*_id``, else
    the first one. Path: the one ending in the schema's name or its plural.
    """
    parsed = df.withColumn("_d", F.from_json(F.col(payload), _SERVICE))
    schemas = parsed.select(
        *keep,
        F.map_keys("_d.paths").alias("_paths"),
        F.explode("_d.components.schemas").alias("schema_name", "_s"),
    )
    names = F.json_object_keys("_s.properties")
    types = F.from_json("_s.properties", f"map<string, {_PROPERTY}>")
    shaped = schemas.withColumn("_names", names).withColumn("_types", types)
    shaped = shaped.where(F.size("_names") > 0)

    def column(name: Column) -> Column:
        p = F.col("_types")[name]
        form = F.coalesce(F.when(F.trim(p["format"]) != "", p["format"]), p["type"], F.lit("string"))
        return F.struct(
            name.alias("name"),
            form.alias("data_type"),
            F.coalesce(p["x-sensitive"], F.lit(False)).alias("sensitive"),
        )

    lowered = F.transform("_names", F.lower)
    required = F.filter(
        F.coalesce("_s.required", F.array().cast("array<string>")),
        lambda r: F.array_contains(lowered, F.lower(r)),
    )
    ids = F.filter("_names", lambda n: (F.lower(n) == "id") | F.lower(n).endswith("_id"))
    key = (
        F.when(F.size(required) > 0, required)
        .when(F.size(ids) > 0, F.slice(ids, 1, 1))
        .otherwise(F.slice("_names", 1, 1))
    )
    low = F.lower("schema_name")

    def ending(word: Column) -> Column:
        hits = F.filter(
            F.coalesce("_paths", F.array().cast("array<string>")),
            lambda p: F.lower(F.substring_index(F.rtrim(p, F.lit("/")), "/", -1)) == word,
        )
        return F.try_element_at(hits, F.lit(-1))

    path = F.coalesce(ending(low), ending(F.concat(low, F.lit("s"))), F.concat(F.lit("/"), low))
    return shaped.select(
        *keep,
        low.alias("table_name"),
        F.col("_s.description").alias("description"),
        F.transform("_names", column).alias("columns"),
        key.alias("primary_key"),
        path.alias("path"),
    )
