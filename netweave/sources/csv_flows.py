"""Labelled flow tables as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.scalars import col_of

ENCODING = "ISO-8859-1"
#: The cleaned table is written next to the raw files and is not one of them.
OWN_OUTPUT = "cleaned_data.csv"


def write_csv(df: DataFrame, path: str) -> None:
    """Names and values keep their blanks; the names of flow files begin with some."""
    writer = df.write.mode("overwrite").option("header", True).option("encoding", ENCODING)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files and folders of CSV parts right below ``folder``, without the own output."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(f"{folder}/{n}" for n in names if n.endswith(".csv") and n != OWN_OUTPUT)


def _headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files by the column names in their first line. Parts of a folder share a header."""
    found: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        names = spark.read.option("header", True).option("encoding", ENCODING).csv(f).columns
        found.setdefault(tuple(names), []).append(f)
    return found


def read_flows(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All CSV files of the folder as one table, columns matched by name.

    With a schema, columns that a file lacks are null and columns that the schema lacks
    are left out; without one, types are inferred once per header and all columns stay.
    """
    reader = spark.read.option("header", True).option("encoding", ENCODING)
    files = csv_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    wanted = spark.createDataFrame([], schema).schema if schema else None
    kinds = {f.name: f.dataType.simpleString() for f in wanted or []}
    out = None
    for names, group in _headers(spark, files).items():
        if wanted is None:
            part = reader.option("inferSchema", True).csv(group)
        else:
            given = ", ".join(f"`{n.replace('`', '``')}` {kinds.get(n, 'string')}" for n in names)
            part = reader.schema(given).csv(group)
            part = part.select(*[
                col_of(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted
            ])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names that flow files use."""
    return df.select(*[col_of(c).alias(names.get(c, c)) for c in df.columns])

