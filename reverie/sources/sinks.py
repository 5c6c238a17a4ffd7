"""Writers, validation, and the join back to local recordings."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from ..functions.text import leaks, schema_hash, stem


class LeakError(ValueError):
    """A column that must not be published."""


Check = Callable[[Column], Column]


def _checks(kind: DataType, path: str, bad: Check) -> list[tuple[str, Check]]:
    """(path, whether a value of the type leaks there) for every text within the type: fields by .name, elements by [], keys and values of maps by {key} and {}."""
    if isinstance(kind, BinaryType):
        raise LeakError(f"column {path} holds bytes")
    if isinstance(kind, StringType):
        return [(path, bad)]
    if isinstance(kind, StructType):
        inner = [(f.dataType, f"{path}.{f.name}", _field(f.name)) for f in kind]
    elif isinstance(kind, ArrayType):
        inner = [(kind.elementType, f"{path}[]", _any(lambda c: c))]
    elif isinstance(kind, MapType):
        inner = [(kind.keyType, f"{path}{{key}}", _any(F.map_keys)), (kind.valueType, f"{path}{{}}", _any(F.map_values))]
    else:
        inner = []
    return [(p, within(check)) for own, at, within in inner for p, check in _checks(own, at, bad)]


def _field(name: str) -> Callable[[Check], Check]:
    return lambda check: lambda c: check(c.getField(name))


def _any(items: Check) -> Callable[[Check], Check]:
    return lambda check: lambda c: F.exists(items(c), check)


def leak_paths(df: DataFrame, strict: bool = False) -> list[str]:
    """The full paths of all texts, at any depth, of which a value begins as an image or a local path; found in one aggregate pass.

    strict also looks for such paths, and /home/, anywhere in a text. Bytes at any depth raise LeakError before anything is read.
    """

    def bad(c: Column) -> Column:
        return leaks(c) | (c.rlike(r"data:image/[a-z]+;base64,|/[Vv]olumes/|/Users/|/tmp/|/home/") if strict else F.lit(False))

    checks = [(path, check(F.col(f"`{f.name}`"))) for f in df.schema for path, check in _checks(f.dataType, f.name, bad)]
    if not checks:
        return []
    row = df.agg(*(F.bool_or(found).alias(f"c{i}") for i, (_, found) in enumerate(checks))).first()
    return [path for i, (path, _) in enumerate(checks) if row[i]]


def validate(df: DataFrame, strict: bool = False) -> None:
    """Raises, naming the full paths, for bytes and for texts that begin as an image or a local path, also within structs, arrays and maps (see leak_paths)."""
    if found := leak_paths(df, strict):
        raise LeakError(f"column {', '.join(found)} holds an image or a local path")


def with_metadata(df: DataFrame, layers: list[str], git_sha: str = "unknown", version: str = "1.0.0") -> DataFrame:
    """Adds schema_version (with the hash of the column names), export_timestamp, active_layers and pipeline_git_sha."""
    digest = schema_hash(F.array(*(F.lit(c) for c in df.columns)))
    return df.withColumns(
        {
            "schema_version": F.concat(F.lit(f"{version}+"), digest),
            "export_timestamp": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "active_layers": F.lit(",".join(layers)),
            "pipeline_git_sha": F.lit(git_sha),
        }
    )


def export(df: DataFrame, path: str, layers: list[str], git_sha: str = "unknown", single_file: bool = False) -> dict:
    """Validates, writes Parquet, and writes the sidecar <path>_metadata as one JSON row; returns the sidecar."""
    validate(df)
    spark = df.sparkSession
    (df.coalesce(1) if single_file else df).write.mode("overwrite").parquet(path)
    side = {
        "schema_version": spark.range(1).select(F.concat(F.lit("1.0.0+"), schema_hash(F.array(*(F.lit(c) for c in df.columns))))).first()[0],
        "export_timestamp": datetime.now(UTC).isoformat(),
        "active_layers": layers,
        "pipeline_git_sha": git_sha,
        "total_videos": spark.read.parquet(path).count(),
    }
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_metadata")
    return side


def append_errors(errors: DataFrame, path: str) -> None:
    """Adds the errors (video_id, error, traceback) that are not there yet, so a run that is repeated adds none twice."""
    spark = errors.sparkSession
    new = errors.select("video_id", "error", "traceback").distinct()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.schema("video_id string, error string, traceback string").json(path)
        same = [new[c].eqNullSafe(old[c]) for c in new.columns]
        new = new.join(old, reduce(lambda a, b: a & b, same), "left_anti")
    new.write.mode("append").json(path)


def rehydrate(metadata: DataFrame, files: DataFrame, persons_column: str = "03a_attention_per_person_raw") -> DataFrame:
    """Rows with the local file of their recording, if there is one, and the number of persons in the raw attention column."""
    local = files.select(stem(F.col("file_path")).alias("video_id"), "file_path").dropDuplicates(["video_id"])
    out = metadata.join(local, "video_id", "left").withColumn("matched", F.col("file_path").isNotNull())
    if persons_column in metadata.columns:
        out = out.withColumn("n_persons", F.size(F.from_json(F.col(f"`{persons_column}`"), "array<string>")))
    return out


def match_counts(rehydrated: DataFrame) -> DataFrame:
    return rehydrated.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("missing"), F.count("*").alias("total"))


def inflation(df: DataFrame, source_bytes: int | None) -> tuple[float | None, str]:
    """(estimated bytes of the plan over source bytes, hash of the columns)."""
    digest = df.sparkSession.range(1).select(schema_hash(F.array(*(F.lit(c) for c in df.columns)))).first()[0]
    if not source_bytes:
        return None, digest
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / source_bytes, digest
