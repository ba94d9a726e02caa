"""Tables of several cohorts, optional inputs, manifests, path context, Parquet output."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from carrierlake.operators.ranking import running_totals


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_cohort_tables(spark: SparkSession, folders: dict[str, str], label: str = "cohort") -> DataFrame:
    """The same table from several cohorts with the cohort as a column."""
    return union_tables([spark.read.parquet(path).withColumn(label, F.lit(name)) for name, path in folders.items()])


def read_or_default(spark: SparkSession, path: str, schema: StructType | str, fallback: DataFrame | None = None) -> DataFrame:
    """Optional input: the table, else another source, else an empty table of the schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback if fallback is not None else spark.createDataFrame([], schema)


def with_path_context(df: DataFrame, levels: list[str], path: Column | None = None) -> DataFrame:
    """Columns from the directory levels above the file, nearest last, plus the file name."""
    parts = F.split(F.col("_metadata.file_path") if path is None else path, "/")
    out = df.withColumn("_parts", parts)
    for i, level in enumerate(reversed(levels)):
        out = out.withColumn(level, F.get("_parts", F.size("_parts") - 2 - i))
    return out.withColumn("file_name", F.element_at("_parts", -1)).drop("_parts")


def with_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """Number the rows of a Parquet scan from 0 in file order, files in the order of their paths.

    A row's place is its file's start plus its index in the file, so nothing is sorted: one count per file is shuffled and only the
    table of files is ordered. Partitions, splits and later filters don't change it. Use it as the last column of an order that must
    be the same in every run.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    files = rows.groupBy("_path").agg((F.max("_index") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("_path", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, "_path").select(*df.columns, (F.col("_start") + F.col("_index")).alias(out))


def ordered_places(df: DataFrame, chrom: str, ordinal: str = "ordinal", out: str = "place") -> DataFrame:
    """Place of every row inside its chromosome by source order, from 1; blocks of 65,536 ordinals are ordered apart.

    Sort by ``keys.chrom_rank`` and this for the whole order.
    """
    ranked = running_totals(df, [chrom], ordinal, {"_rows": F.lit(1)}, band=F.floor(F.col(ordinal) / 65536))
    return ranked.withColumnRenamed("_rows_upto", out).drop("_rows_total")


def parse_manifest(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """One file path per line to (path, sample); comments, blanks and repeats dropped."""
    path = F.trim(F.regexp_replace(column, "\r", ""))
    return (
        lines.select(path.alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()
        .select("path", F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1), F.lit("")).alias("sample"))
    )


def read_manifest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return parse_manifest(spark.read.text(path), pattern)


def duplicate_samples(manifest: DataFrame) -> DataFrame:
    """Samples listed more than once."""
    return manifest.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_tables(tables: dict[str, DataFrame], folder: str, partition: dict[str, list[str]] = {}) -> None:
    """One Parquet directory per named result; tables may be partitioned by columns."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy(*partition.get(name, [])).parquet(f"{folder}/{name}")
