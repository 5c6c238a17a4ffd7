"""Result tables whose changes are whole or not there: parts that are written first, and a pointer that is then renamed into place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layers whose recordings without a result are tried again; the others record the reason and are done.
RETRIED = ("03a_attention", "03b_reasonable_emotion", "03c_acoustic_prosody")
LEDGER = "video_id string, layer string, attempt int, outcome string, error string, traceback string"


class ConflictError(RuntimeError):
    """Somebody else committed since the version that a change began from."""


class Versions:
    """The versions of the tables of one folder.

    A version is a small file _versions/<number> that lists the parts (Parquet folders) of each table. A change writes its parts,
    then its version beside the others, and last renames that to the next number, which fails if the number is taken. So a reader,
    who takes the largest number, sees a change whole or not at all, wherever a writer stops; parts that no version lists are
    rubbish that vacuum deletes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, parts of each table); 0 and none before the first commit."""
        where = self._at("_versions")
        if not self._fs.exists(where):
            return 0, {}
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, {}
        stream = self._fs.open(self._at(f"_versions/{number:012d}"))
        try:
            return number, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        """The table in its latest version, columns that older parts lack as nulls; without any part, an empty table of schema, or None."""
        return self._table(self.latest()[1].get(table, []), schema)

    def _table(self, parts: list[str], schema: str | None = None) -> DataFrame | None:
        if not parts:
            return self.spark.createDataFrame([], schema) if schema else None
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*(f"{self.path}/{p}" for p in parts))

    def write_part(self, df: DataFrame, table: str) -> str:
        part = f"{table}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def commit(self, base: int, parts: Mapping[str, list[str]]) -> int:
        """Publishes the version after base, or raises ConflictError if there is one."""
        self._fs.mkdirs(self._at("_versions"))
        staged = self._at(f"_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(parts).encode()))
        finally:
            stream.close()
        self._publish(staged, base + 1)
        return base + 1

    def _publish(self, staged, number: int) -> None:
        target = self._at(f"_versions/{number:012d}")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if self._at("").toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(staged), files.makeQualified(target), none)  # without overwriting
        except Exception as e:
            if self._fs.exists(target):
                self._fs.delete(staged, False)
                raise ConflictError(f"version {number} of {self.path} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> None:
        """Deletes parts that none of the last keep versions lists, and older versions. Not while a writer is at work: its parts are not listed yet."""
        number, parts = self.latest()
        wanted = {p for ps in parts.values() for p in ps} | {"_versions"}
        for n in range(max(1, number - keep + 1), number):
            stream = self._fs.open(self._at(f"_versions/{n:012d}"))
            wanted |= {p for ps in json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()).values() for p in ps}
            stream.close()
        for status in self._fs.listStatus(self._at("")):
            if status.getPath().getName() not in wanted:
                self._fs.delete(status.getPath(), True)
        for status in self._fs.listStatus(self._at("_versions")):
            name = status.getPath().getName()
            if not name.isdigit() or int(name) <= number - keep:
                self._fs.delete(status.getPath(), False)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    return Versions(spark, path).read("results", schema)


def append_results(spark: SparkSession, new: DataFrame, path: str, key: str = "video_id", force: bool = False) -> None:
    """Adds results, one record for each id however often it runs: ids that are there already are passed over, or replaced with force.

    Rows that are added are one more part; a replacement writes the table anew. Either takes its place at once (see Versions).
    """
    versions = Versions(spark, path)
    base, parts = versions.latest()
    versions.commit(base, parts | {"results": _merged(versions, parts.get("results", []), new, key, force)})


def _merged(versions: Versions, parts: list[str], new: DataFrame, key: str, force: bool) -> list[str]:
    once, old = new.dropDuplicates([key]), versions._table(parts)
    if old is None:
        return [versions.write_part(once, "results")]
    if not force:
        return [*parts, versions.write_part(once.join(old.select(key), key, "left_anti").select(*new.columns), "results")]
    whole = old.join(new.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)
    return [versions.write_part(whole, "results")]


def recorded(rows: DataFrame, layer: str, reason: str = "skipped_reason") -> DataFrame:
    """The rows that a layer records: layers that are tried again leave out recordings without a result."""
    return rows.where(F.col(reason).isNull()) if layer in RETRIED and reason in rows.columns else rows


def pending(spark: SparkSession, every: DataFrame, layer: str, path: str, force: bool = False, attempts: int | None = None, key: str = "video_id") -> DataFrame:
    """The rows of every whose recording the layer has still to do: all but those with a record, and with attempts those tried as often."""
    if force:
        return every
    ledger = Versions(spark, path).read("ledger", LEDGER).where(F.col("layer") == layer)
    final = ledger.groupBy("video_id").agg(F.bool_or(F.col("outcome").isin("done", "skipped")).alias("final"), F.max("attempt").alias("attempt"))
    over = F.col("final") if attempts is None else F.col("final") | (F.col("attempt") >= attempts)
    return every.join(final.where(over).select(F.col("video_id").alias(key)), key, "left_anti")


def commit_run(spark: SparkSession, layer: str, path: str, asked: DataFrame, records: DataFrame, errors: DataFrame | None = None, force: bool = False, key: str = "video_id") -> int:
    """Commits one run of a layer: its records, and a row of the ledger for every recording that was asked, in one version.

    outcome is done (a result), skipped (a record with a reason, final), none (no record: the layers of RETRIED are asked again)
    or raised (in errors: video_id, error, traceback; asked again by every layer, whatever else the run has of it). attempt counts the
    runs that asked. Returns the version.
    """
    versions = Versions(spark, path)
    base, parts = versions.latest()
    failed = spark.createDataFrame([], "video_id string, error string, traceback string") if errors is None else errors.select("video_id", "error", "traceback").dropDuplicates(["video_id"])
    good = recorded(records, layer).join(failed.select(F.col("video_id").alias(key)), key, "left_anti")
    reason = F.col("skipped_reason").isNotNull() if "skipped_reason" in records.columns else F.lit(False)
    found = good.select(F.col(key).alias("video_id"), F.when(reason, "skipped").otherwise("done").alias("found")).dropDuplicates(["video_id"])
    before = versions._table(parts.get("ledger", []), LEDGER).where(F.col("layer") == layer).groupBy("video_id").agg(F.max("attempt").alias("before"))
    rows = asked.select(F.col(key).cast("string").alias("video_id")).distinct().join(failed, "video_id", "left").join(found, "video_id", "left").join(before, "video_id", "left")
    outcome = F.when(F.col("error").isNotNull(), "raised").otherwise(F.coalesce("found", F.lit("none")))
    ledger = rows.select("video_id", F.lit(layer).alias("layer"), (F.coalesce("before", F.lit(0)) + 1).alias("attempt"), outcome.alias("outcome"), "error", "traceback")
    new = {"results": _merged(versions, parts.get("results", []), good, key, force), "ledger": [*parts.get("ledger", []), versions.write_part(ledger, "ledger")]}
    return versions.commit(base, parts | new)
