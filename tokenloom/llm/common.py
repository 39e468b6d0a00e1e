"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.shared import cut as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
