"""Views of the project's tables that several problems need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def company_entities(companies: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(id, entity)``: the mapped companies; entity is null where the mapping has no gen_id."""
    m = mapping.select(F.upper(F.trim("external_id")).alias("x"), F.col("data_source_id").alias("s"), F.col("gen_id").alias("entity"))
    c = companies.select("id", F.upper(F.trim("external_id")).alias("x"), F.col("data_source_id").alias("s"))
    return c.join(m.where("x is not null and s is not null").distinct(), ["x", "s"]).select("id", "entity").distinct()


def unmapped(companies: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of companies whose key the mapping does not know."""
    return companies.join(entities.select("id").distinct(), "id", "left_anti")


def unlabelled(camera: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of camera whose spec the entity truth does not know."""
    return camera.join(truth.select("spec_id").where("spec_id is not null").distinct(), "spec_id", "left_anti")
