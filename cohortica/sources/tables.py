"""Reading and writing of sample tables, annotations, feature lists and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from cohortica.functions.expressions import quoted
from cohortica.operators.order import written

ANNOTATION = StructType([StructField(c, StringType()) for c in ("PROBEID", "SYMBOL", "UNIPROT", "GENENAME")])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing: all floats, once, at the door."""
    return df.select(*[F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else quoted(f.name) for f in df.schema])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, index: str | None = None) -> DataFrame:
    """Header, inferred types unless a schema is given; NaN, NA and empty fields are null.

    ``index`` renames the first column of a file that was written with its row
    names; without it the first column is data like any other.
    """
    reader = spark.read.option("header", True).option("nanValue", "__none__").option("nullValue", "NaN")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    for c in text:
        df = df.withColumn(c, F.when(~quoted(c).isin("NA", "nan", ""), quoted(c)))
    return nan_to_null(df.toDF(index, *df.columns[1:]) if index else df)


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """row_id from 0 in the order of ``order``, without a global window: ranges are sorted, and counted before each."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = df.repartitionByRange(parts, *[quoted(c) for c in order]).sortWithinPartitions(*[quoted(c) for c in order])
    made = written(made.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "rows")  # ranges are drawn from a sample: a second run may deal others
    counts = {r[0]: (r[1], r[2]) for r in made.groupBy("_p").agg(F.count(F.lit(1)), F.min("_i")).collect()}  # a row per partition
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before - counts[p][1]))
        before += counts[p][0]
    offsets = spark.createDataFrame(rows or [(0, 0)], "_p int, _o bigint")
    return made.join(F.broadcast(offsets), "_p").withColumn("row_id", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def read_annotation(spark: SparkSession, path: str | None) -> DataFrame:
    """The annotation table, or an empty one where there is no file."""
    if path:
        try:
            found = read_csv(spark, path)
            return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast("string").alias(c) for c in ANNOTATION.names])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], ANNOTATION)


def read_features(spark: SparkSession, path: str) -> list[str]:
    """A feature list is metadata: names, one a row, in a column ``protein``."""
    return [r[0] for r in read_csv(spark, path, "protein string").where("protein is not null").collect()]


def read_inputs(spark: SparkSession, seen: str, unseen: str, features: str, validate: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    a, b, names = read_csv(spark, seen), read_csv(spark, unseen), read_features(spark, features)
    if validate:
        for which, df in (("seen", a), ("unseen", b)):
            if missing := sorted(set(names) - set(df.columns)):
                raise ValueError(f"{which} lacks features: {', '.join(missing[:10])}")
    return a, b, names


def info(df: DataFrame) -> DataFrame:
    """at (place), column, type, n_rows, n_known (neither null nor NaN) of every column, in one pass."""
    seen = [quoted(f.name).isNotNull() & (~F.isnan(quoted(f.name)) if isinstance(f.dataType, (DoubleType, FloatType)) else F.lit(True)) for f in df.schema]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[F.count_if(c) for c in seen]).alias("known"))
    names = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema)])
    return counts.select("n_rows", F.explode(F.arrays_zip(names.alias("f"), F.col("known").alias("k"))).alias("c")).select("c.f.at", "c.f.column", "c.f.type", "n_rows", F.col("c.k").alias("n_known"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
