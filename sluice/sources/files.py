"""Sources and sinks: call envelopes, seen state, the tracker's CSV, and atomic writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def call_matrix(spark: SparkSession, queries: list[str], portals: dict[str, list[str]], limit: int = 15) -> DataFrame:
    """One row per call: every query at every place of every portal, with the limit pushed to the source.

    ``ordinal`` follows the order in which portals, their places and the queries were given.
    """
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], "qi int, query string")
    p = spark.createDataFrame([(n, portal, i, place) for n, (portal, places) in enumerate(portals.items()) for i, place in enumerate(places)], "n int, portal string, pi int, place string")
    # Both sides are the caller's literals.
    both = F.broadcast(q).crossJoin(F.broadcast(p))
    args = F.array(F.lit("-q"), "query", F.lit("-l"), "place", F.lit("--limit"), F.lit(str(limit)))
    order = F.row_number().over(Window.orderBy("n", "pi", "qi"))  # a literal of some dozens of rows
    return both.select(F.concat_ws("-", "portal", "pi", "qi").alias("call_id"), "portal", args.alias("args"), order.alias("ordinal"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Raw answers, one file per call: call_id (file name) and stdout."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("call_id"), F.col("value").alias("stdout"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def process_failure() -> Column:
    """The failure of a call that ended with another code than 0: what its stderr states as JSON, if anything."""
    err = F.try_parse_json("stderr")
    code = F.coalesce(F.try_variant_get(err, "$.code", "string"), F.concat(F.lit("PROCESS_EXIT_"), F.col("exit_code").cast("string")))
    return F.struct(code.alias("code"), F.coalesce(F.try_variant_get(err, "$.message", "string"), F.lit("")).alias("message"), (code == "NO_CREDENTIALS").alias("expected"))


def decode_calls(calls: DataFrame) -> DataFrame:
    """``calls`` (call_id, portal, exit_code, stdout, stderr) with items (array of variants) and failure.

    The first rule that applies decides: a non-zero exit takes the code that
    stderr states as JSON, if any, and NO_CREDENTIALS is expected; blank or broken
    output is MALFORMED_JSON; anything but an object with a results array is
    INVALID_ENVELOPE. Items that are no objects are dropped later, one by one.
    """
    out = F.try_parse_json("stdout")
    results = F.try_variant_get(out, "$.results", "variant")
    blank = F.trim(F.coalesce("stdout", F.lit(""))) == ""
    fail = lambda c, m: F.struct(F.lit(c).alias("code"), F.lit(m).alias("message"), F.lit(False).alias("expected"))
    failure = (
        F.when(F.col("exit_code") != 0, process_failure())
        .when(F.col("stdout").isNull(), fail("MALFORMED_JSON", "could not read raw file"))
        .when(blank, fail("MALFORMED_JSON", "empty stdout"))
        .when(out.isNull(), fail("MALFORMED_JSON", "stdout is not valid JSON"))
        .when(~_kind(out).startswith("OBJECT"), fail("INVALID_ENVELOPE", "root is not an object"))
        .when(results.isNull() | ~_kind(results).startswith("ARRAY"), fail("INVALID_ENVELOPE", "results is missing or not an array"))
    )
    told = calls.withColumn("failure", failure)
    return told.withColumn("items", F.when(F.col("failure").isNull(), F.try_variant_get(out, "$.results", "array<variant>")))


def read_seen(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """The seen keys of a version-1 state file, and the code of what was wrong with it (then it is empty)."""
    none = spark.createDataFrame([], "key string, first_seen_at string")
    raw = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    version = F.try_variant_get("v", "$.version", "int")
    seen = F.try_variant_get("v", "$.seen", "map<string, string>")
    row = raw.select((F.col("v").isNull() | ~F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False))).alias("broken"), version.alias("version"), seen.isNull().alias("empty")).first()
    if row is None or row["broken"]:
        return none, "STATE_RESET_CORRUPT"
    if row["version"] != 1:
        return none, "STATE_UNSUPPORTED_VERSION"
    if row["empty"]:
        return none, "STATE_RESET_CORRUPT"
    return raw.select(F.explode(seen).alias("key", "first_seen_at")), None


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """The tracker's rows with their position; the header must be exact, blank rows go.

    The file is one CSV document, read whole by one task, so positions are its order.
    """
    schema = ", ".join(f"`{c}` string" for c in fixed.TRACKER_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    tidy = rows.select(*[tx.clean(F.col(f"`{c}`")).alias(c) for c in fixed.TRACKER_COLUMNS])
    return tidy.where(F.concat(*[F.col(f"`{c}`") for c in fixed.TRACKER_COLUMNS]) != "").withColumn("pos", F.monotonically_increasing_id())


def _file_system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, committed: bool = True) -> list[int]:
    make, fs = _file_system(spark, path)
    if not fs.exists(make(path)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(make(path))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and (not committed or fs.exists(make(f"{path}/{n}/_SUCCESS"))))


def write_atomic(df: DataFrame, path: str, form: str = "parquet", keep: int = 2, version: int | None = None, **options: str) -> int:
    """Write a new version of a table; it counts once its _SUCCESS marker is there. Older ones go but for ``keep``.

    Readers take the newest version that counts, so they always see a whole table,
    old or new. One writer at a time. A caller that may repeat its work names the
    ``version``: a second write of it takes the first one's place.
    """
    spark = df.sparkSession
    mode = "error" if version is None else "overwrite"
    version = max(_versions(spark, path, committed=False), default=0) + 1 if version is None else version
    df.write.format(form).mode(mode).options(**options).save(f"{path}/version={version}")
    make, fs = _file_system(spark, path)
    for old in _versions(spark, path)[:-keep]:
        fs.delete(make(f"{path}/version={old}"), True)
    return version


def read_atomic(spark: SparkSession, path: str, form: str = "parquet", below: int | None = None) -> DataFrame:
    """The newest whole version of a table, of those below a number if one is given."""
    versions = [v for v in _versions(spark, path) if below is None or v < below]
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.format(form).load(f"{path}/version={versions[-1]}")


def write_run(df: DataFrame, path: str, run_id: str, mode: str = "error") -> None:
    """An immutable table per run; the latest is the largest run id. A run that may be repeated takes the mode overwrite."""
    df.write.mode(mode).parquet(f"{path}/run_id={run_id}")


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(path)
    return runs.where(F.col("run_id") == runs.agg(F.max("run_id")).first()[0])


def backup_seen(spark: SparkSession, path: str, code: str, stamp: str) -> dict:
    """Move a state file that can't be used aside; the failure to report, with the file or, if that failed, another code."""
    make, fs = _file_system(spark, path)
    stem, i = path.removesuffix(".json"), 0
    while fs.exists(make(to := f"{stem}.corrupt.{stamp}{f'.{i}' if i else ''}.json")):
        i += 1
    moved = fs.rename(make(path), make(to))
    return {"code": code if moved else "STATE_BACKUP_FAILED", "expected": False, "backup_file": to if moved else None}


SEEN = "key string, first_seen_at string"


def load_seen(spark: SparkSession, path: str, stamp: str, below: int | None = None) -> tuple[DataFrame, list[dict]]:
    """The seen keys and the failures of loading them; nothing there is an empty state.

    Versions, as write_seen leaves them, go first; only while there is none, the JSON document of an older state is
    read, and put aside if it can't be used. ``path`` names the document (then versions lie beside it) or the folder.
    """
    make, fs = _file_system(spark, path)
    none = spark.createDataFrame([], SEEN)
    folder, document = _seen_paths(path)
    if any(below is None or v < below for v in _versions(spark, folder)):
        return read_atomic(spark, folder, below=below), []
    if not fs.exists(make(document)) or fs.getFileStatus(make(document)).isDirectory():
        return none, []
    seen, code = read_seen(spark, document)
    return seen, [] if code is None else [backup_seen(spark, document, code, stamp)]


def _seen_paths(path: str) -> tuple[str, str]:
    """The folder of versions and the JSON document of a state, whichever of them is named."""
    path = path.rstrip("/")
    return (f"{path.removesuffix('.json')}.versions", path) if path.endswith(".json") else (path, f"{path}.json")


def write_seen(seen: DataFrame, path: str, failures: list[dict], version: int | None = None) -> bool:
    """Write the seen keys as a new version, unless the old state could not be put aside; whether it was written."""
    if any(f["code"] == "STATE_BACKUP_FAILED" for f in failures):
        return False
    write_atomic(seen.select("key", "first_seen_at"), _seen_paths(path)[0], version=version)
    return True
