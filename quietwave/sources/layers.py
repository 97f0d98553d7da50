"""Layered velocity models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYER_FIELDS = ["thickness", "vp", "vs", "rho", "qp", "qs"]


def parse_layer_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of six numbers; lines that are blank or comments drop out."""
    keep = [c for c in lines.columns if c != line]
    # cut at single blanks, which needs no pattern; the generator evaluates a line once for filter and fields
    text = F.translate(F.substring_index(line, "#", 1), "\t\r\n\f\v", "     ")
    fields = F.array_remove(F.split(text, " "), "")
    parts = lines.select(*keep, F.explode(F.filter(F.array(fields), lambda p: F.size(p) > 0)).alias("_p"))
    return parts.select(*keep, *[F.col("_p")[k].cast("double").alias(f) for k, f in enumerate(LAYER_FIELDS)])


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Every model file below a path: model_id, layer (line order), six fields.

    A file is one model of few lines, so it is read whole and cut into lines.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("model_id"), F.posexplode(F.split("value", "\n")).alias("layer", "value"))
    rows = parse_layer_lines(files)
    order = Window.partitionBy("model_id").orderBy("layer")
    return rows.withColumn("layer", F.row_number().over(order) - 1)


def stack_models(fiducial: DataFrame, perturbed: DataFrame, copy: str = "copy") -> DataFrame:
    """All perturbed copies and the fiducial (copy -1) in one table."""
    return perturbed.unionByName(fiducial.withColumn(copy, F.lit(-1)))
