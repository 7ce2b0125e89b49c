"""Session settings that the wide rows of billing data want."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# A row of 58 columns makes generated methods that HotSpot refuses to compile
# (over 8,000 bytes of bytecode) and then interprets. With this limit Spark takes
# its split, compiled projections for such a stage instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
    # A parcel row becomes four to eight wide lines behind the shuffle: tasks that read
    # Spark's 64 MB of them sort several GB and spill.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"),
    # The same for parcel rows that were written, 20 bytes each: Spark's 128 MB of them are six million.
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    # Lines are written by month as they come, not sorted by month before: 58 columns of each would be
    # held and spilled. A task that meets more months sorts the lines of the others.
    "spark.sql.maxConcurrentOutputFileWriters": ("0", "16"),
}

# Spark's 200 partitions are 50 MB each at 200 million parcel rows, and sorts behind them may spill. It joins small
# partitions, but splits none: so there are many at first, and tasks read 16 MB at any size.
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FIRST_PARTITIONS = 1200


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings that still have Spark's default. Fewer partitions than that are someone's choice and stay."""
    for key, (default, wanted) in SETTINGS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, wanted)
    if spark.conf.get(PARTITIONS, None) is None and int(spark.conf.get("spark.sql.shuffle.partitions")) >= 200:
        spark.conf.set(PARTITIONS, str(FIRST_PARTITIONS))
    return spark


def landed(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and not again for a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/landed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the cluster's ``spark.checkpoint.dir``.

    Where that is not set, a folder in the session's warehouse, which is shared too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/freightlens"
