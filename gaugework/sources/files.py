"""CSV and Parquet in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators.filters import Selection, apply_selection


def read_observations(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False
) -> DataFrame:
    """A headered CSV (or folder of them) with every column as text.

    Nothing is inferred, so no extra pass over the data is made; the cleaning
    operators cast afterwards. Files stay splittable unless ``multi_line`` allows line
    breaks inside quotes.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    try:
        return reader.csv(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"no observations at {path}") from problem
        raise


def malformed_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(problem, line) of every line that ``read_observations`` has to pad, cut or reinterpret.

    ``short`` and ``long`` lines have fewer or more fields than the header; in ``quotes``, a quote is
    left open, or stands inside a field without being doubled. Blank lines are no records. One
    pass over the lines as they are, for files without line breaks inside quotes.
    """
    fields = len(read_observations(spark, path, encoding).columns)
    raw = spark.read.schema("line string").option("header", True).option("encoding", encoding)
    lines = raw.option("sep", "\u0001").option("quote", "").csv(path).where("trim(line) <> ''")
    whole, part = r'"[^"]*+(?:""[^"]*+)*+"', r'[^",]*+'
    sound = F.col("line").rlike(f"^(?:{whole}|{part})(?:,(?:{whole}|{part}))*+$")
    commas = F.regexp_replace("line", f"{whole}|[^,]", "")
    found = F.length(commas) + 1
    problem = F.when(~sound, "quotes").when(found < fields, "short").when(found > fields, "long")
    return lines.select(problem.alias("problem"), "line").where(F.col("problem").isNotNull())


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet twin of ``read_observations``: typed, with column pruning and filter pushdown.

    With a schema no file is opened while planning.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a result as headered CSV part files; the folder is created when missing."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, time: str | None = None) -> None:
    """Write Parquet; with ``time`` the table is laid out by year so later filters prune folders.

    The rows are rebalanced by year: adaptive execution splits a hot year by its size.
    """
    if time is None:
        df.write.mode("overwrite").parquet(path)
        return
    yearly = df.withColumn("year", F.year(time))
    yearly.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def export_filtered(df: DataFrame, selection: Selection, path: str) -> DataFrame:
    """Filter the wide table, write it as CSV and return the filtered frame."""
    kept = apply_selection(df, selection)
    write_csv(kept, path)
    return kept
