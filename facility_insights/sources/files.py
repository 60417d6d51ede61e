"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SNIFF_DELIMITERS = [",", ";", "\t", "|"]


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """Headered CSV with every column read as text (no inference: keys keep their leading zeros).

    With ``columns`` the schema is explicit and no header job runs; otherwise the header names
    are taken from the file and all columns are strings.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("encoding", "UTF-8")
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType(), True) for c in columns]))
    return reader.csv(path)


def sniff_delimiter(spark: SparkSession, path: str, candidates: Sequence[str] = SNIFF_DELIMITERS) -> str:
    """The candidate occurring most often in the header line (first wins a tie)."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    counts = [(line.count(c), -i, c) for i, c in enumerate(candidates)]
    return max(counts)[2]


def scan_sniffed(spark: SparkSession, path: str, candidates: Sequence[str] = SNIFF_DELIMITERS) -> DataFrame:
    return scan_csv(spark, path, sep=sniff_delimiter(spark, path, candidates))


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """CSV with a header row and no index column (a folder of part files)."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def load_cached(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Load several result tables once and keep them cached (executors' memory, spill to disk)."""
    return {name: spark.read.parquet(p).persist() for name, p in paths.items()}


def as_text_columns(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])
