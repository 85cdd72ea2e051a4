"""Reading other systems' exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def object_export(spark: SparkSession, path: str, text: str, vector: str = "default", pages: bool = False) -> DataFrame:
    """A JSON export of objects (``id, properties, vector(s)``) as ``doc_id, text, properties, vector``.

    One object a line, or with ``pages`` whole answers of the listing, ``{"objects": [...]}``, one a file. Lines that are no object,
    have no id or the id of zeros, or no text under the property, are left out; an id given again counts once; a missing vector is null.
    """
    schema = "id string, properties map<string,string>, vector array<float>, vectors map<string,array<float>>"
    if pages:
        rows = spark.read.schema(f"objects array<struct<{schema.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>>").option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")
    else:
        rows = spark.read.schema(schema).json(path)
    body = F.try_element_at("properties", F.lit(text))
    kept = rows.filter(F.col("id").isNotNull() & F.col("id").rlike("[^0-]") & (F.length(body) > 0)).dropDuplicates(["id"])
    return kept.select(F.col("id").alias("doc_id"), body.alias("text"), "properties", F.coalesce("vector", F.try_element_at("vectors", F.lit(vector))).alias("vector"))


def versioned(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A table written as ``root/version=N``: the given version, or the newest; only that directory is read."""
    df = spark.read.parquet(root)
    newest = version if version is not None else df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == newest).drop("version")
