"""Incremental runs: settled calls in, postings, failures, counters and seen keys out, each batch once.

A batch's output follows from its calls and from the state that the batches before it
left, and is written under the batch's number. So a run that was killed anywhere is
started again with the same result. One run works at a time, by a lease.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import postings
from ..sources import files
from ..sources.seen import SeenTable, mark_new
from ..tables import cut, numbered, scratch

RESULT = (*[c for c in fixed.RESULT_FIELDS], "size")


def write_once(spark: SparkSession, path: str, text: str) -> str:
    """Make a file with a text unless it is there; the text it holds. Of several writers at once, one makes it."""
    jvm = spark.sparkContext._jvm
    make, fs = files._file_system(spark, path)
    own = make(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            # A local rename replaces what is there, so the name itself is made, which fails for all but one.
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(place(make(path)), place(own))
        elif not fs.exists(make(path)):
            fs.rename(own, make(path))  # refused if another was first
    except Exception as e:  # noqa: BLE001
        if not fs.exists(make(path)):
            raise e
    finally:
        fs.delete(own, False)
    stream = fs.open(make(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@contextmanager
def lease(spark: SparkSession, path: str, stale_after: float = 6 * 3600) -> Iterator[bool]:
    """Whether this is the one run that works; a lease older than ``stale_after`` seconds was left by a run that died, and goes."""
    make, fs = files._file_system(spark, path)
    owner = uuid.uuid4().hex
    if fs.exists(make(path)) and time.time() - fs.getFileStatus(make(path)).getModificationTime() / 1000 > stale_after:
        fs.rename(make(path), make(f"{path}.stale.{owner}"))  # by one of those who try
        fs.delete(make(f"{path}.stale.{owner}"), False)
    held = write_once(spark, path, owner) == owner
    try:
        yield held
    finally:
        if held:
            fs.delete(make(path), False)


def scrape(calls: DataFrame, seen: SeenTable, batch: int, now: str, out: str, decode=files.decode_calls) -> None:
    """One run over settled calls (call_id, portal, ordinal, exit_code, stdout, stderr): results, failures and counters of
    the batch below ``out``, and its keys among the seen ones."""
    spark = calls.sparkSession
    with scratch(spark, []):
        decoded = cut(decode(calls), "run-calls")  # read by every output
        rows = postings.in_matrix_order(postings.normalize(decoded).withColumnRenamed("source_call", "call_id"), decoded).withColumnRenamed("call_id", "source_call").drop("pos")
        rows = cut(mark_new(rows, seen, batch), "run-rows")
        groups = cut(postings.deduplicate(rows, "arrival"), "run-groups")
        files.write_run(numbered(groups, postings.latest_order(), "place").select("place", *RESULT), f"{out}/results", f"{batch:010d}", "overwrite")
        told = decoded.where("failure IS NOT NULL").select("call_id", "portal", "exit_code", "failure.*")
        files.write_run(told, f"{out}/failures", f"{batch:010d}", "overwrite")
        files.write_run(postings.run_counters(decoded, groups, rows), f"{out}/counters", f"{batch:010d}", "overwrite")
        keys = rows.where("id IS NOT NULL").select(F.concat_ws(":", "portal", "id").alias("key"))
        seen.add(keys, now, batch)


def run_available(calls: DataFrame, seen_path: str, out: str, checkpoint: str, now: str, decode=files.decode_calls, buckets: int = 64) -> bool:
    """Work off all calls that a stream holds by now, and end; False if another run is at work.

    A batch keeps the ``now`` of its first attempt.
    """
    spark = calls.sparkSession
    with lease(spark, f"{out}.lease") as held:
        if not held:
            return False
        table = SeenTable(spark, seen_path, buckets)

        def one(batch_calls: DataFrame, batch: int) -> None:
            stamp = write_once(spark, f"{out}.stamps/{batch:010d}", now)
            scrape(batch_calls, SeenTable(batch_calls.sparkSession, table.path), batch, stamp, out, decode)

        calls.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return True


def latest(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results in their order, failures and counters of the newest run."""
    tables = [spark.read.parquet(f"{out}/{x}") for x in ("results", "failures", "counters")]
    newest = tables[2].agg(F.max("run_id")).first()[0]  # a run without failures or results has counters all the same
    results, failures, counters = [t.where(F.col("run_id") == newest).drop("run_id") for t in tables]
    return results.orderBy("place"), failures.orderBy("call_id"), counters
