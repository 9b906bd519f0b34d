"""Reading wide diaries, writing and re-reading derived tables, diary ids, labels."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.runtime import cut_lineage

MEASURES = ("pri", "sec", "loc", "enj", "dev", "whoa", "whob", "whoc", "whod")


def wide_schema(slots: int = 144, measures: Sequence[str] = MEASURES, extra: str = "") -> str:
    """DDL of a wide diary table: an id and one coded column per measure and slot."""
    cells = ", ".join(f"{m}{s} int" for m in measures for s in range(1, slots + 1))
    return ", ".join(part for part in ("diaryid bigint", extra, cells) if part)


def load_wide(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read a wide diary table (Parquet or CSV) with a declared schema."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a derived table as Parquet."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a derived table back."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Read the routine assignment of each diary."""
    return load_table(spark, path, "label bigint, cluster60 int, cluster int, description string")


def with_diary_id(df: DataFrame, order_cols: Sequence[str], id: str = "diaryid") -> DataFrame:
    """Number the rows 1..n in the order of `order_cols`, which must identify a row.

    A global row_number() would sort the whole table in one task. Here the rows are range
    partitioned and sorted on the full key (so a hot leading value is split too) and kept as a
    checkpoint, which fixes both the partitions and the order inside them. A row's number is
    its place in its partition plus the sizes of the partitions before it.
    """
    ordered = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols))
    placed = ordered.withColumns(
        {
            "__part": F.spark_partition_id(),
            "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    # One row per partition meets in this window, never the data.
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__offset")
    )
    return (
        placed.join(offsets, "__part")
        .withColumn(id, F.col("__offset") + F.col("__place") + 1)
        .drop("__part", "__place", "__offset")
    )


def decode_labels(df: DataFrame, cols: Sequence[str], codebook: DataFrame) -> DataFrame:
    """Replace integer codes by labels and add the level order as `<col>_ord`.

    `codebook` has (variable, code, label); one left join per variable. Codes without a label
    become NULL. The codebook is small, so Spark broadcasts it by its own size check.
    """
    for col in cols:
        levels = codebook.filter(F.col("variable") == col).select(
            F.col("code").alias("__code"), F.col("label").alias("__label")
        )
        df = (
            df.join(levels, F.col(col) == F.col("__code"), "left")
            .withColumn(f"{col}_ord", F.when(F.col("__label").isNotNull(), F.col(col)))
            .withColumn(col, F.col("__label"))
            .drop("__code", "__label")
        )
    return df
