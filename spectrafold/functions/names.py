"""Families, categories and licence classes of models, from a table that the caller keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def family(model: Column, fallback: Column | None = None, patterns: Sequence[tuple[str, str]] = ()) -> Column:
    """The first family of *patterns* (regular expression, family) that matches; any other model is its own family."""
    out = None
    for pattern, name in patterns:
        out = F.when(model.rlike(pattern), name) if out is None else out.when(model.rlike(pattern), name)
    own = fallback if fallback is not None else model
    return own if out is None else out.otherwise(own)


def merged_category(category: Column) -> Column:
    """Tree ensembles and boosting count as one category."""
    return F.when(category.isin("Tree-based", "Gradient Boosting"), "Trees").otherwise(category)


def with_licence(df: DataFrame, models: DataFrame) -> DataFrame:
    """Attach the licence class from a *models* table (model, licence); models without one are ``open``."""
    return df.join(models.select("model", "licence"), "model", "left").withColumn("licence", F.coalesce("licence", F.lit("open")))


def with_names(df: DataFrame, models: DataFrame, patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Attach display name, family and category from a *models* table (model, display_name, category; optional family).

    A family named there comes first, then *patterns*.
    """
    named = models if "family" in models.columns else models.withColumn("family", F.lit(None).cast("string"))
    out = df.join(named.select("model", "display_name", F.col("category").alias("_category"), F.col("family").alias("_family")), "model", "left")
    name = F.coalesce("display_name", "model")
    return out.withColumn("display_name", name).withColumn("family", F.coalesce("_family", family(F.col("model"), name, patterns))).withColumn(
        "category", merged_category(F.coalesce("_category", F.lit("Other")))).drop("_category", "_family")
