"""Product pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_image_per_product(images: DataFrame) -> DataFrame:
    """Smallest picture address of each product."""
    return images.groupBy("product_id").agg(F.min("image_url").alias("image_url"))
