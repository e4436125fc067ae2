"""Landed JSON records: listing, reading and writing.

Layout: ``<root>/source=<s>/ingest_date=<yyyy-mm-dd>/[sub folder/]*.json``.
Fetchers land array files (one JSON array per file); bulk loads write JSON
lines with Spark, which can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.sources import files, schemas

ARRAY_FILES = "batch_*.json"
LINE_FILES = "part-*.json"
ROWS_PER_FILE = 50_000


def day_folders(
    spark: SparkSession, root: str, source: str | None = None, ingest_date: str | None = None
) -> list[str]:
    """Folders holding the wanted source and day; only these are ever listed or read."""
    return files.matching(spark, f"{root}/source={source or '*'}/ingest_date={ingest_date or '*'}")


def sources_on(spark: SparkSession, root: str, ingest_date: str, source: str | None = None) -> list[str]:
    """Sources that landed something on the day."""
    return [
        p.rsplit("/source=", 1)[1].split("/", 1)[0]
        for p in day_folders(spark, root, source, ingest_date)
    ]


def read_bronze(
    spark: SparkSession,
    root: str,
    source: str | None = None,
    ingest_date: str | None = None,
    schema: T.StructType = schemas.BRONZE,
) -> DataFrame:
    """All landed records of the day(s), array files and line files together.

    ``_file`` and ``_seq`` order records by file and place in the file: an array
    file is read by one task from top to bottom, and so is each split of a line
    file.
    """
    folders = day_folders(spark, root, source, ingest_date)
    parts = []
    for pattern, multi_line in ((ARRAY_FILES, True), (LINE_FILES, False)):
        reader = (
            spark.read.schema(schema)
            .option("multiLine", multi_line)
            .option("mode", "PERMISSIVE")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True)
        )
        if folders:
            records = reader.json(folders).select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.monotonically_increasing_id().alias("_seq"),
            )
            if not multi_line:  # the writer keeps the source in the folder name only
                records = records.withColumn("source", F.coalesce("source", _source_in_path("_file")))
            parts.append(records)
    if not parts:
        return spark.createDataFrame(
            [], T.StructType(list(schema)).add("_file", "string").add("_seq", "long")
        )
    return parts[0].unionByName(parts[1])


def _source_in_path(path: str) -> Column:
    return F.regexp_extract(path, "/source=([^/]+)/", 1)


def read_array_files(
    spark: SparkSession,
    root: str,
    source: str,
    ingest_date: str | None = None,
    schema: T.StructType = schemas.BRONZE,
) -> DataFrame:
    """Records of array files with file name, path and 1-based place in the file.

    A file that is not a JSON array parses to NULL and is left out. A file is
    one batch of at most 50,000 records, so reading it whole is bounded.
    """
    names = [f.name for f in schema]
    texts = read_whole_files(spark, root, source, ingest_date)
    if texts is None:
        return spark.createDataFrame(
            [], T.StructType(list(schema)).add("_path", "string").add("_name", "string").add("_row", "long")
        )
    return texts.select(
        "_path", "_name", F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("_pos", "_rec")
    ).select(
        *[F.col(f"_rec.{n}").alias(n) for n in names],
        "_path",
        "_name",
        (F.col("_pos") + 1).cast("bigint").alias("_row"),
    )


def read_whole_files(
    spark: SparkSession, root: str, source: str | None = None, ingest_date: str | None = None
) -> DataFrame | None:
    """One row per array file: its text, path, name and the source in its path."""
    folders = day_folders(spark, root, source, ingest_date)
    if not folders:
        return None
    return (
        spark.read.option("pathGlobFilter", ARRAY_FILES)
        .option("recursiveFileLookup", True)
        .option("wholetext", True)
        .text(folders)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("_name"),
            _source_in_path("_metadata.file_path").alias("_source"),
        )
    )


def write_bronze(
    envelopes: DataFrame, root: str, ingest_date: str, *, load: str | None = None, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Land envelopes as JSON lines under source, day, dataset and load, 50,000 rows per file. A load that comes again
    replaces itself; without a name it is added."""
    dated = envelopes.withColumn("ingest_date", F.lit(ingest_date))
    writer = files.landing(dated, ("source", "ingest_date", "dataset_key"), load or files.load_name(None))
    writer.option("maxRecordsPerFile", rows_per_file).json(root)
