"""Closed vocabularies of the annotation sheet, in their fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories of each dimension.
POSITION = ["Introduction", "Related work", "Methods", "Results", "Discussion"]
DISTANCE = ["Same sentence", "Same paragraph", "Same section", "Same article", "Single self-cited article"]
FUNCTION = [
    "Foundation", "Inspiration", "Extension", "Application", "Elaborated Citation", "Comparison", "Similarity", "Affirmation",
    "Related work", "Simple mention", "Comparison between Related Work", "Future work", "Further reading", "Historical background",
]
# Labels of the training records; the sheets use the same names in their own spelling.
TRAINING_FUNCTION = FUNCTION
DEPTH = ["Deep citation", "Moderate citation", "Shallow citation"]
STRENGTH = ["1", "2", "3", "4", ">=5"]
LABELS = [f"{g}-{f}" for g in ("G1", "G2") for f in range(1, 6)]
# Dimension, column of the records, categories.
DIMENSIONS = [
    ("position", POSITION), ("distance", DISTANCE), ("function", FUNCTION), ("depth", DEPTH), ("strength", STRENGTH),
]
# Hypotheses of the dimensions and report labels.
HYPOTHESES = {"position": "H1a", "distance": "H1b", "strength": "H1c", "function": "H2a", "depth": "H2b", "similarity": "H2c"}
DISPLAY = {
    "Simple mention": "Simple Mention", "Historical background": "Historical Background", "Related work": "Related Work",
    "Shallow citation": "Shallow Citation",
}


def categories(spark: SparkSession) -> DataFrame:
    """(dim, ord, category): one row per category of every dimension."""
    rows = [(dim, i, c) for dim, names in DIMENSIONS for i, c in enumerate(names, 1)]
    return spark.createDataFrame(rows, "dim string, ord int, category string")


def values_sql() -> str:
    """The same vocabulary as SQL rows (dim, ord, category)."""
    return ", ".join(f"('{dim}', {i}, '{c}')" for dim, names in DIMENSIONS for i, c in enumerate(names, 1))
