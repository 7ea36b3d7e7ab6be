"""RAW layer: CSV files, all columns text, landed as Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.schemas import RAW_FILES, raw_schema

#: Tables whose fields hold line breaks.
MULTI_LINE = frozenset({"order_reviews"})


def read_raw_csv(spark: SparkSession, path: str | list[str], table: str, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header that names the table's columns in order; quoted fields may hold doubled quotes.

    Another header is an error. Only the tables in MULTI_LINE are read with line breaks inside fields, unless
    ``multi_line`` says otherwise: such a file cannot be split, so it is one task; export it as many files.
    """
    return spark.read.schema(raw_schema(table)).csv(
        path, header=True, multiLine=table in MULTI_LINE if multi_line is None else multi_line, quote='"', escape='"',
        encoding="UTF-8", mode="FAILFAST", enforceSchema=False,
    )


def file_table(name: str) -> str | None:
    """Table of a file name: the published name, alone or as ``<publisher>_<name>_dataset.csv``; None for any other."""
    for table, base in RAW_FILES.items():
        if re.fullmatch(rf"(?:{base}|[a-z0-9]+_{base}_dataset)\.csv", name):
            return table
    return None


def raw_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path of each RAW table that lies in ``folder`` itself, on any file system; only names are listed.

    Other files, and folders below, are left alone. Two files for one table are an error.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    # every name that can be a table's file, no others: a handful
    known = "|".join(RAW_FILES.values())
    paths = sorted(r["path"] for r in listed.where(F.col("path").rlike(f"/([a-z0-9]+_)?({known})(_dataset)?\\.csv$")).collect())
    found: dict[str, str] = {}
    for path in paths:
        table = file_table(path.rsplit("/", 1)[1])
        if table in found:
            raise ValueError(f"Two files for {table}: {found[table]} and {path}")
        if table:
            found[table] = path
    return found


def load_raw(
    spark: SparkSession, folder: str, out: str, multi_line: bool | None = None, files: dict[str, str] | None = None
) -> dict[str, int]:
    """Replaces every RAW table under ``out`` and returns the row counts; fails first if a file is missing.

    ``files`` names a file, or a folder of part files, for each table instead.
    """
    files = files or raw_files(spark, folder)
    missing = [table for table in RAW_FILES if table not in files]
    if missing:
        raise FileNotFoundError(f"No CSV file for {', '.join(missing)} in {folder}")
    counts = {}
    for table in RAW_FILES:
        target = f"{out}/raw/{table}"
        read_raw_csv(spark, files[table], table, multi_line).write.mode("overwrite").parquet(target)
        counts[table] = spark.read.schema(raw_schema(table)).parquet(target).count()
    return counts
