"""The small functions under names of their own in SQL: expressions that the optimizer unfolds, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textgauge.functions.dialect import SPARK


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name: (parameters, type, expression)."""
    from textgauge.operators.evaluate import DIMENSION_LABELS, LENGTH_FACTOR, OVERALL_LABELS, TASK_CAP, label_expr

    words = f"size({SPARK.words('text')})"
    return {
        "text_word_count": ("text STRING", "INT", f"coalesce({words}, 0)"),
        "text_clamp": ("x DOUBLE", "DOUBLE", SPARK.clamp("x")),
        "text_gaussian": ("x DOUBLE, mean DOUBLE, std DOUBLE", "DOUBLE", "exp(-0.5D * ((x - mean) / std) * ((x - mean) / std))"),
        "text_short_factor": ("wc INT", "DOUBLE", "CASE WHEN wc >= 30 THEN 1D WHEN wc <= 10 THEN 0.3D ELSE 0.3D + 0.7D * (wc - 10) / 20 END"),
        "text_neutralised": ("score DOUBLE, factor DOUBLE", "DOUBLE", "CASE WHEN factor < 1 THEN 0.5D + (score - 0.5D) * factor ELSE score END"),
        "text_length_factor": ("wc INT", "DOUBLE", f"CAST({LENGTH_FACTOR} AS DOUBLE)"),
        "text_task_cap": ("wc INT", "INT", TASK_CAP),
        "text_label": ("score DOUBLE", "STRING", label_expr("score", OVERALL_LABELS, "Poor")),
        "text_dimension_label": ("score DOUBLE", "STRING", label_expr("score", DIMENSION_LABELS, "Weak")),
    }


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, (parameters, returns, expression) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {expression}")
