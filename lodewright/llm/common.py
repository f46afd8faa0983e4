"""Helpers shared by the training-data operators: words, shared storage, global prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import Scratch, shared_dir, stage  # noqa: F401  (operators take them from here)

#: Code points that separate words.  A word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_ROW_BITS = 33  # monotonically_increasing_id() keeps the row's place in the low 33 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_sorted(df: DataFrame, *order: Column, name: str, index: str = "__at") -> DataFrame:
    """A staged copy in global order; ``index`` has the range in its high bits, the place in its low ones."""
    placed = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return stage(placed.withColumn(index, F.monotonically_increasing_id()), name)


def range_of(index: str = "__at") -> Column:
    return F.shiftright(F.col(index), _ROW_BITS)


def with_before(df: DataFrame, name: str, value: Column, index: str = "__at") -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all ranges before a row's own, for a ``range_sorted`` table.

    The sums are a table of one row for each range (as many as shuffle partitions), so its broadcast is bounded.
    """
    sums = df.groupBy(range_of(index).alias("__r")).agg(F.sum(value).alias("__v"))
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__r", F.coalesce(F.sum("__v").over(earlier), F.lit(0)).cast("long").alias(name))
    return df.join(F.broadcast(sums), range_of(index) == F.col("__r")).drop("__r")


def place_in_range(index: str = "__at") -> Column:
    return F.col(index).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
