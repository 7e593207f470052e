"""File scans: statement CSVs grouped by header, sidecar CSVs, and the file catalogue."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources import records
from tallyframe.sources.layouts import Layout

# Folders and files a scan of the watch folder leaves out, unless the caller names others.
IGNORED_FOLDERS = (".git", "node_modules", "dist", "docs", "src")
IGNORED_SUFFIX = ".md"


def clean_name(name: str) -> str:
    """Header name to column name: BOM and blanks dropped, lower case, other characters as ``_``."""
    return re.sub(r"[^a-z0-9]+", "_", name.replace("﻿", "").strip().lower()).strip("_")


def file_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, names`` of every file with a line: the columns its header names."""
    lines = records.lines_of(spark, paths).groupBy("path").agg(F.min_by("value", F.struct("block", "line")).alias("header"))
    return lines.select("path", records.clean_names(F.col("header")).alias("names"))


def read_statements(spark: SparkSession, paths: str | Sequence[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Rows of all files with the layout's columns, and ``(path, reason)`` of files that lack some.

    Every file's columns are taken by its own header. A large file is read by several tasks, and
    nothing is read before the rows are asked for.
    """
    lacking = records.missing(layout.required)
    found = records.read_records(spark, paths).withColumn("names", records.clean_names(F.col("header"))).where(F.size(lacking) == 0)
    found = found.withColumn("values", records.fields(F.col("record")))
    rows = found.select(*[records.column(name).alias(name) for name in (*layout.required, *layout.optional)], "source_document_name")
    failed = file_headers(spark, paths).where(F.size(lacking) > 0)
    return rows, failed.select("path", F.concat(F.lit("missing required columns: "), F.array_join(lacking, ", ")).alias("reason"))


def read_sidecar(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """A sidecar CSV with ``#`` lines dropped, columns checked, and a stable ``entry_id`` per row."""
    scan = spark.read.csv(path, header=True, comment="#", quote='"', escape='"', inferSchema=False)
    names = [clean_name(c) for c in scan.columns]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    frame = scan.toDF(*names)
    columns = [(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in (*required, *optional)]
    kept = frame.select(*columns)
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in kept.columns])
    # Equal lines stay separate entries (they are reported as duplicates), so the copy number is part of the id.
    counted = kept.groupBy(*kept.columns).agg(F.count("*").alias("_n"))
    copies = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return copies.withColumn("entry_id", F.xxhash64(text, "_i")).drop("_n", "_i")


def is_candidate(relative_path: Column, ignored_folders: Sequence[str] = IGNORED_FOLDERS) -> Column:
    """Whether a path below the scan root is looked at."""
    parts = F.split(relative_path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    held_back = F.exists(folders, lambda p: (F.lower(p) == "archive") | p.startswith(".") | p.startswith("_"))
    ignored = F.exists(parts, lambda p: p.isin(*ignored_folders))
    return ~held_back & ~ignored & ~F.lower(F.element_at(parts, -1)).endswith(IGNORED_SUFFIX)


def file_catalogue(spark: SparkSession, root: str, ignored_folders: Sequence[str] = IGNORED_FOLDERS) -> DataFrame:
    """``(path, relative_path, size, modified)`` of every candidate file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", f"^.*?{re.escape(base)}/", "")
    return files.select(
        "path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    ).where(is_candidate(F.col("relative_path"), ignored_folders))
