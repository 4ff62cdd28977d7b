"""Sources and sinks: CSV, table names, inline rows, appends, declared schemas,
JSON payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row into a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def table_name(fqn: str) -> str:
    """service.database.schema.table -> schema.table (names of fewer than 3 parts unchanged)."""
    parts = fqn.split(".")
    return f"{parts[-2]}.{parts[-1]}" if len(parts) >= 3 else fqn


def read_table(spark: SparkSession, fqn: str, catalog: Callable[[str], str] | None = None,
               fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Resolve a fully qualified name and read the table.

    Without a catalog function the name goes to ``spark.table``; with one, the
    function maps 'schema.table' to a location read with ``fmt`` (e.g. parquet,
    or jdbc with ``options`` such as url/user - passed through untouched).
    """
    name = table_name(fqn)
    if catalog is None:
        return spark.table(name)
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "jdbc":
        return reader.option("dbtable", catalog(name)).load()
    return reader.load(catalog(name))


def inline_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def append_to(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """INSERT INTO ... SELECT by column name: when the target exists its columns
    (and order) win; columns the source lacks are written as NULL.  A source
    column that the target lacks is an error, and so is a target that is there
    but can't be read."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    target = spark.read.format(fmt).load(path).schema if there else None
    if target is not None:
        have = set(df.columns)
        extra = have - {f.name for f in target.fields}
        if extra:
            raise ValueError(f"{path} has no column {', '.join(sorted(extra))}")
        df = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in target.fields])
    df.write.mode("append").format(fmt).save(path)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Shape rows to a declared table: cast every declared column; a column the
    input does not carry gets its DEFAULT (or NULL).  An explicit NULL in a
    carried column stays NULL, as in SQL."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def add_column_if_missing(df: DataFrame, name: str, dtype: T.DataType | str) -> DataFrame:
    """ALTER TABLE ... ADD COLUMN IF NOT EXISTS."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


# ---------------------------------------------------------------- JSON payloads
TEST_CASE = T.StructType([T.StructField("name", T.StringType()), T.StructField("testCaseFQN", T.StringType()),
                          T.StructField("result", T.StringType())])
NODE = T.StructType([T.StructField("fullyQualifiedName", T.StringType()),
                     T.StructField("failingTestCases", T.StructType([
                         T.StructField("testCaseResults", T.ArrayType(TEST_CASE))]))])
EDGE = T.StructType([T.StructField("fromEntity", T.StringType()), T.StructField("toEntity", T.StringType())])
DIAGNOSIS = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("upstreamAnalysis", T.StructType([
        T.StructField("failingUpstreamNodesCount", T.IntegerType()),
        T.StructField("failingUpstreamNodes", T.ArrayType(NODE))])),
    T.StructField("lineage", T.StructType([T.StructField("downstreamEdges", T.ArrayType(EDGE))])),
])


def flatten_diagnosis(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """One row per (payload, failing node, failing test); payloads without
    nodes or tests keep one row with NULL positions (outer explode)."""
    d = df.select(id_col, F.from_json(F.col(json_col), DIAGNOSIS).alias("d"))
    n = d.select(id_col, F.col("d.status").alias("status"),
                 F.coalesce(F.size("d.lineage.downstreamEdges"), F.lit(0)).alias("downstream_edges"),
                 F.posexplode_outer("d.upstreamAnalysis.failingUpstreamNodes").alias("node_pos", "node"))
    t = n.select(id_col, "status", "downstream_edges", "node_pos",
                 F.col("node.fullyQualifiedName").alias("node_fqn"),
                 F.posexplode_outer("node.failingTestCases.testCaseResults").alias("test_pos", "tc"))
    return t.select(id_col, "status", "downstream_edges", "node_pos", "node_fqn", "test_pos",
                    F.col("tc.name").alias("test_name"), F.col("tc.testCaseFQN").alias("test_fqn"),
                    F.col("tc.result").alias("result"))


def json_field(col: str, path: str, dtype: str | None = None):
    v = F.get_json_object(F.col(col), path)
    return v.cast(dtype) if dtype else v
