"""Tables to record from, and where histograms are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkhist.plans.layouts import Layout


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def save(hist: DataFrame, path: str, layout: Layout) -> None:
    """Long form as Parquet, the layout's bytes beside it in the metadata of bin_index."""
    from sparkhist.sources.codec import layout_bytes

    meta = {"layout": layout_bytes(layout).hex()}
    hist.withMetadata("bin_index", meta).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Layout]:
    """(long form, layout) of a stored histogram."""
    from sparkhist.sources.codec import layout_from_bytes

    df = spark.read.parquet(path)
    return df, layout_from_bytes(bytes.fromhex(df.schema["bin_index"].metadata["layout"]))
