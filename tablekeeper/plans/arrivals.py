"""Stand-in arrivals: a table laid out as time-ordered files for the streaming queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrival_files(df: DataFrame, ts: str, path: str, files: int) -> None:
    """Lay ``df`` out as ``files`` parquet files over disjoint, increasing time
    ranges and stamp each file's modification time in that order, so a file
    stream source delivers the rows in time order (a micro-batch takes the next
    ``maxFilesPerTrigger`` files).  One distributed write with ``files`` tasks;
    the driver handles one (path, min ts) pair per file.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, F.col(ts)).sortWithinPartitions(ts).write.mode("overwrite").parquet(path)
    firsts = (spark.read.parquet(path).select(F.input_file_name().alias("f"), F.col(ts))
              .groupBy("f").agg(F.min(ts).alias("m")).orderBy("m").collect())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = 1_600_000_000_000
    for i, row in enumerate(firsts):
        p = jvm.org.apache.hadoop.fs.Path(row["f"])
        p.getFileSystem(conf).setTimes(p, base + i * 10_000, -1)

