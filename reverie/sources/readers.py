"""Readers of listings, manifests, metadata and layer results."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import stem


def scan_recordings(spark: SparkSession, folders: dict[str, list[str]], pattern: str = "*.mp4") -> DataFrame:
    """videos(id, dataset, file_path, file_size, created_at) from an ordered mapping of dataset to folders.

    Only listings are read, not contents. A path under two datasets goes to the first; names that start with ._ are skipped.
    """
    out = None
    for rank, (dataset, paths) in enumerate(folders.items()):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths).drop("content")
        files = files.select(
            stem(F.col("path")).alias("id"),
            F.lit(dataset).alias("dataset"),
            F.col("path").alias("file_path"),
            F.col("length").alias("file_size"),
            (F.unix_micros("modificationTime") / 1e6).alias("created_at"),
            F.lit(rank).alias("_rank"),
        )
        out = files if out is None else out.union(files)
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("_rank"))
    return out.where(~F.substring_index("file_path", "/", -1).startswith("._")).withColumn("_r", first).where("_r = 1").drop("_r", "_rank")


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array (or several files of one); what does not parse is left out, the rest of the run goes on."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(kind.fields).add("_corrupt_record", "string")
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(full).json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_layers(spark: SparkSession, folder: str, pattern: str = "03*_result.json") -> dict[str, DataFrame]:
    """layer name -> results, for every result file of the folder, in name order; unreadable and empty ones are left out."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").collect()  # one row per layer
    out = {}
    for (path,) in names:
        rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        if "video_id" in rows.columns:
            out[path.rsplit("/", 1)[-1].removesuffix("_result.json")] = rows
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """video_uid and its record from {"videos": [...]}; of a repeated uid the last wins."""
    videos = spark.read.option("multiLine", True).json(path).select(F.posexplode("videos").alias("_i", "v")).select("_i", "v.*")
    last = F.row_number().over(Window.partitionBy("video_uid").orderBy(F.col("_i").desc()))
    return videos.where(F.col("video_uid").isNotNull()).withColumn("_r", last).where("_r = 1").drop("_r", "_i")


def read_uids(spark: SparkSession, path: str) -> DataFrame:
    """video_uid of {"videos": [...]} or of a bare list."""
    rows = spark.read.option("multiLine", True).json(path)
    if "videos" in rows.columns:
        return rows.select(F.explode("videos.video_uid").alias("video_uid"))
    return rows.select("video_uid").where(F.col("video_uid").isNotNull())


def read_csv_ids(spark: SparkSession, path: str, column: str = "video_id") -> DataFrame:
    """Distinct ids, in the order in which they first appear."""
    rows = spark.read.csv(path, header=True).select(column, F.monotonically_increasing_id().alias("_i"))
    return rows.groupBy(column).agg(F.min("_i").alias("_i")).orderBy("_i").select(column)


class ZipMembers(DataSource):
    """Members of zip archives, read from the directories at their ends alone: format zip_members, options paths (JSON list) and suffix.

    A partition is an archive. Its end is read by ranges, 64 KB and then the directory, also of archives of 4 GB and more (zip64), so
    an archive costs about the size of its directory whatever it holds.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, compressed long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(self.options)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.suffix = json.loads(options["paths"]), options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with open_ranged(partition.path) as f, zipfile.ZipFile(f) as z:  # the module seeks to the directory and reads no member
            for m in z.infolist():
                if m.filename.endswith(self.suffix) and not m.is_dir():
                    yield partition.path, m.filename, m.file_size, m.compress_size


def open_ranged(path: str) -> BinaryIO:
    """A file of any store that Arrow knows, for reading by ranges."""
    where = path.removeprefix("file:") if path.startswith("file:/") else path
    if "://" not in where:
        fs, inside = pafs.LocalFileSystem(), "/" + where.lstrip("/")
    else:
        fs, inside = pafs.FileSystem.from_uri(where)
    return io.BufferedReader(fs.open_input_file(inside), 1 << 16)


def zip_members(spark: SparkSession, path: str, suffix: str = ".mp4") -> DataFrame:
    """Members of zip archives with that suffix: archive, member, size, compressed, and id, the stem. Archives are listed by Spark and their directories read by ranges (see ZipMembers)."""
    spark.dataSource.register(ZipMembers)
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names alone: no content is read
    return spark.read.format("zip_members").option("paths", json.dumps(files)).option("suffix", suffix).load().withColumn("id", stem(F.col("member")))
