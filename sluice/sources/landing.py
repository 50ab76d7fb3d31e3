"""Calls whose parts land as files: what was planned, and each call's stdout, stderr and status.

A landing folder holds ``plan/*.json`` (a call per line: call_id, portal, ordinal, planned_at in
seconds), ``stdout/<call_id>.json``, ``stderr/<call_id>.stderr`` and ``status/<call_id>.json``
({"exit_code": n, "stdout_bytes": n, "stderr_bytes": n}); files of ``tick/`` only tell the time.
Parts come in any order, late, twice or never. Spark's sources pass over files of no bytes, so the
status tells which parts are empty. A call is whole once its status and what that promises are
there; what is missing at its deadline stays missing, and without a status the call timed out
(exit code 124).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEADLINE = 120
TIMED_OUT = 124
TIMEOUT = '{"code": "TIMEOUT", "message": "the call took longer than its deadline"}'
PART = "kind string, call_id string, body string, at double"
KINDS = ("stdout", "stderr", "status")
#: Before the names of ticks, which no call has.
TICK = "tick/"


def _parts(files: DataFrame) -> DataFrame:
    """Files as parts (kind, call_id, body, at); bytes that are no UTF-8 make a null body, as if the file could not be read."""
    told = files.select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("kind"), F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1).alias("call_id"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("body"), F.col("modificationTime").cast("double").alias("at"))
    lines = F.when(F.col("kind") == "plan", F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).otherwise(F.array("body"))
    rows = told.where(F.col("kind").isin("plan", "tick", *KINDS)).select("kind", "call_id", F.explode(lines).alias("body"), "at")
    own = F.get_json_object("body", "$.call_id")
    named = F.when(F.col("kind") == "plan", own).when(F.col("kind") == "tick", F.concat(F.lit(TICK), F.col("call_id"))).otherwise(F.col("call_id"))
    return rows.withColumn("call_id", named).where("call_id IS NOT NULL")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a landing folder."""
    return _parts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def stream_parts(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Parts of a landing folder as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _parts(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(path))


def planned(parts: DataFrame) -> DataFrame:
    """The calls of the plans: call_id, portal, ordinal, planned_at; of a call planned twice the later plan."""
    rows = parts.where(F.col("kind") == "plan").select("call_id", F.from_json("body", "portal string, ordinal int, planned_at double").alias("p"), "at")
    return rows.groupBy("call_id").agg(F.max_by("p", F.struct("p.planned_at", "at")).alias("p")).select("call_id", "p.*")


def exit_code(status: Column) -> Column:
    """The exit code that a status states; 1 for one that states none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(status), "$.exit_code", "int"), F.lit(1))


def is_empty(status: Column, kind: str) -> Column:
    """Whether a status states that a part has no bytes."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(status), f"$.{kind}_bytes", "long") == 0, F.lit(False))


def join_parts(matrix: DataFrame, parts: DataFrame, now: float | Column, deadline: float = DEADLINE) -> DataFrame:
    """Calls of the matrix (call_id, portal, ordinal, planned_at) that are settled at ``now`` (seconds): exit_code, stdout, stderr.

    Of parts that came twice the latest counts; a part that came after the call's deadline does not. Calls neither
    whole nor overdue are left out. Parts are gathered once, by call.
    """
    by = {k: F.col("kind") == k for k in KINDS}
    timed = parts.where(F.col("kind").isin(*KINDS)).join(matrix.select("call_id", "planned_at"), "call_id").where(F.col("at") <= F.col("planned_at") + deadline)
    kept = timed.groupBy("call_id").agg(*[F.max_by(F.struct("body"), F.when(by[k], F.col("at"))).alias(k) for k in KINDS])
    both = matrix.join(kept, "call_id", "left")
    for k in ("stdout", "stderr"):
        both = both.withColumn(k, F.when(F.col(k).isNull() & is_empty(F.col("status.body"), k), F.struct(F.lit("").alias("body"))).otherwise(F.col(k)))
    whole = F.col("status").isNotNull() & F.col("stdout").isNotNull() & F.col("stderr").isNotNull()
    settled = both.where(whole | (F.lit(now) > F.col("planned_at") + deadline))
    late = F.col("status").isNull()
    return settled.select(
        "call_id", "portal", "ordinal", F.when(late, TIMED_OUT).otherwise(exit_code(F.col("status.body"))).cast("int").alias("exit_code"),
        F.col("stdout.body").alias("stdout"), F.when(late, TIMEOUT).otherwise(F.col("stderr.body")).alias("stderr"))
