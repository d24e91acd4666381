"""Page probes: flags by rule, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PAGE_FLAGS

MIN_CHARS, MIN_DENSITY, MIN_DRAWINGS = 40, 0.0005, 50


def flags(chars: Column, width: Column, height: Column, drawings: Column, images: Column, min_chars: int = MIN_CHARS, min_density: float = MIN_DENSITY, min_drawings: int = MIN_DRAWINGS) -> Column:
    """Text flag first (exactly one), then vector_diagram, then raster_image."""
    density = chars / F.greatest(width * height, F.lit(1.0))
    low = (chars < min_chars) | (density < min_density)
    found = F.array(
        F.when(low, F.lit("low_text_confidence")).otherwise(F.lit("text_normal")),
        F.when(drawings >= min_drawings, F.lit("vector_diagram")),
        F.when(images > 0, F.lit("raster_image")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def probe(pages: DataFrame, **thresholds: float) -> DataFrame:
    """pages with flags and text_density."""
    density = F.col("char_count") / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    return pages.withColumn("flags", flags(F.col("char_count"), F.col("width"), F.col("height"), F.col("drawings"), F.col("images"), **thresholds)).withColumn("text_density", density)


def flag_counts(probed: DataFrame) -> DataFrame:
    """flag, n for all four flags, 0 where none has it."""
    spark = probed.sparkSession
    counted = probed.select(F.explode("flags").alias("flag")).groupBy("flag").count()
    names = spark.createDataFrame([(f,) for f in PAGE_FLAGS], "flag string")
    return names.join(counted, "flag", "left").select("flag", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def text_layer_present(text: Column) -> Column:
    from ..functions.text import strip

    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))
