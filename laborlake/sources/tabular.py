"""Bulk CSV files and the raw tables they are kept in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborlake.functions import lexicons as lx
from laborlake.functions.text import as_text, identifier, raw_table_name
from laborlake.sources import files


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column text. ``multi_line=False`` lets big files be split."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(paths if isinstance(paths, str) else list(paths))
    )


def pick_column(columns: Sequence[str], candidates: Sequence[str], *, any_case: bool) -> str | None:
    """The first candidate present among the columns."""
    present = {(c.lower() if any_case else c): c for c in columns}
    return next((present[c] for c in candidates if c in present), None)


def bulk_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Canonical field -> actual column of a bulk file (any letter case)."""
    return {f: pick_column(columns, names, any_case=True) for f, names in lx.BULK_ALIASES.items()}


Groups = dict[tuple[str, ...], list[str]]

#: Beyond the size of any file: a file is one split, and shares its task with no other file.
_WHOLE_FILE = 1 << 40
#: Batches of a thousand lines.
_SMALL_FILE = 100


def _first_record(multi_line: bool):
    def first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first record of the one file of a task. The rest of a big file is left unread."""
        lines, quotes, path = [], 0, None
        for line, path in ((v.as_py(), p.as_py()) for batch in batches for v, p in zip(batch["value"], batch["path"])):
            if lines or line.strip():
                lines.append(line)
                quotes += line.count('"')
            if lines and not (multi_line and quotes % 2):
                break
        if lines:
            yield pa.record_batch({"path": pa.array([path]), "header": pa.array(["\n".join(lines)])})
        # A worker that has read all of its task serves the next one; a small file's rest costs less than a new worker.
        for _ in islice(batches, _SMALL_FILE):
            pass

    return first_record


def header_texts(spark: SparkSession, paths: Sequence[str], *, multi_line: bool = True) -> dict[str, str]:
    """The first record of each file that has one, by qualified path, in one job with a task per file (Spark lists many paths in a job of its own).

    A task stops soon after its file's first record, so the size of files doesn't matter. The driver gets one line per path.
    """
    quick = spark.newSession()  # split sizes are settings of a session
    for name in ("maxPartitionBytes", "openCostInBytes"):
        quick.conf.set(f"spark.sql.files.{name}", _WHOLE_FILE)
    quick.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    lines = quick.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    found = lines.mapInArrow(_first_record(multi_line), "path string, header string").collect()
    return {_plain(unquote(r.path)): r.header for r in found}


def _plain(path: str) -> str:
    """``file:///x`` as ``file:/x``: scans and listings write local paths in either way."""
    return path.replace(":///", ":/", 1)


def route_by_header(
    spark: SparkSession, paths: Sequence[str], *, multi_line: bool = True
) -> tuple[Groups, Groups]:
    """Job files and files to keep raw only, both grouped by equal header.

    Only headers are read: of all files in one job, then once more of one file per distinct header, for the names that
    the reader gives its columns. A file without a title column is kept raw only; an empty file has no columns.
    """
    texts = header_texts(spark, paths, multi_line=multi_line) if paths else {}
    known: dict[str, tuple[str, ...]] = {}
    jobs: Groups = {}
    raw_only: Groups = {}
    for path in sorted(paths):
        text = texts.get(_plain(files.qualified(spark, path)))
        columns = known.get(text)
        if columns is None:
            columns = tuple(read_csv(spark, path, multi_line=multi_line).columns)
            if text is not None:
                known[text] = columns
        kind = jobs if bulk_columns(columns)["title"] else raw_only
        kind.setdefault(columns, []).append(path)
    return jobs, raw_only


def raw_column_names(columns: Sequence[str]) -> list[str]:
    """Safe, distinct column names that do not clash with the metadata columns."""
    taken: list[str] = []
    for position, column in enumerate(columns, start=1):
        name = identifier(column.strip() or f"col_{position}", prefix="col")
        if name in (*lx.RAW_RESERVED, "raw_table", files.LOAD):
            name = f"src_{name}"
        if name in taken:
            name = f"{name}_{position}"
        taken.append(name)
    return taken


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``row_number``, 1-based in file order, to rows read from splittable files.

    Rows are numbered inside their split and shifted by the rows of earlier
    splits of the file. The table of splits has one row per split, and a split
    has a bounded size, so no file is ever brought into one task.
    """
    marked = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    earlier = (
        Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = (
        marked.groupBy("_path", "_block")
        .agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1)
        .select("_path", "_block", "_shift")
    )
    return (
        marked.join(splits, ["_path", "_block"])
        .withColumn("row_number", F.col("_seq") + F.col("_shift"))
        .drop("_path", "_block", "_seq", "_shift")
    )


def raw_rows(rows: DataFrame, dataset_key: str, run_id: str | None) -> DataFrame:
    """Rows of files as text columns under safe names, with metadata in front."""
    types = dict(rows.dtypes)
    names = raw_column_names(rows.columns)
    texts = [as_text(F.col(f"`{c}`"), types[c]).alias(n) for c, n in zip(rows.columns, names)]
    return number_rows(rows).select(
        F.lit(run_id).cast("string").alias("run_id"),
        F.current_timestamp().alias("ingested_at"),
        F.lit(dataset_key).alias("dataset_key"),
        F.col("_name").alias("source_file"),
        F.col("row_number"),
        *texts,
    )


def land_raw(
    spark: SparkSession,
    paths: Sequence[str],
    root: str,
    dataset_key: str,
    run_id: str | None,
    *,
    multi_line: bool = True,
) -> None:
    """Keep CSV files of one header as raw Parquet tables, one per file, all in one job.

    A later load of a file adds to its table and may bring new columns; a load repeated under its ``run_id`` replaces itself.
    """
    source = read_csv(spark, paths, multi_line=multi_line)
    names = sorted({p.rsplit("/", 1)[-1] for p in paths})
    # One row per file of the load, made from the listing at hand.
    tables = spark.createDataFrame(
        [(n, raw_table_name(dataset_key, n)) for n in names], "source_file string, raw_table string"
    )
    rows = raw_rows(source, dataset_key, run_id).join(tables, "source_file")
    files.landing(rows, ["raw_table"], files.load_name(run_id, source.columns)).parquet(root)


def raw_tables(spark: SparkSession, root: str) -> list[DataFrame]:
    """All raw tables, those with the same columns read together; ``raw_table`` tells them apart.

    A load's name tells its files' header, so that tables of the same headers are found by listing; schemas are read once
    per set of headers, not per table.
    """
    loads: dict[str, set[str | None]] = {path: set() for path in files.matching(spark, f"{root}/raw_table=kaggle_raw_*")}
    for path in files.matching(spark, f"{root}/raw_table=kaggle_raw_*/{files.LOAD}=*"):
        table, load = path.rsplit("/", 1)
        loads[table].add(files.header_of(load))
    alike: dict[tuple, list[str]] = {}
    for path, headers in loads.items():
        known = headers and None not in headers
        alike.setdefault(tuple(sorted(headers)) if known else (None, path), []).append(path)
    reader = spark.read.option("basePath", root).option("mergeSchema", True)
    groups: dict[tuple[str, ...], list[str]] = {}
    for paths in alike.values():
        columns = spark.read.option("mergeSchema", True).parquet(paths[0]).columns
        groups.setdefault(tuple(columns), []).extend(paths)
    return [reader.parquet(*paths).drop(files.LOAD) for paths in groups.values()]


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate column that exists (even where its value is NULL), else NULL."""
    name = pick_column(df.columns, candidates, any_case=False)
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")
