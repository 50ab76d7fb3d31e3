"""Written tables, the folder that all executors share, and joins that hot keys can't stall."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and the
    master is local (as in tests) does a folder of this machine stand in.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run of one operator."""
    return f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex}"


#: Paths that cut() wrote, by the scopes that are open in this context, so that threads don't see each other's.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Settings that are changed for a while, by session and name: how many hold the change, and the value before the first.
_HELD: dict[tuple[int, str], list] = {}
_LOCK = threading.Lock()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; of several threads that change it to one value, the last puts it back."""
    key = (id(spark._jsparkSession), name)
    with _LOCK:
        held = _HELD.setdefault(key, [0, spark.conf.get(name, None)])
        held[0] += 1
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _HELD[key]
                spark.conf.unset(name) if held[1] is None else spark.conf.set(name, held[1])


def cut(df: DataFrame, name: str, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This ends the lineage: a lost executor costs a read of the table, not a
    second run of what made it. The write's own shuffles go with its end.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.mode("overwrite")
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    out._written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Remove tables that cut() returned and that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._written_at)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """At the end, remove all that cut() wrote meanwhile in this context, but for the tables that were put into ``keep``.

    A kept table passes to the scope around this one, if there is any.
    """
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        kept = {t._written_at for t in keep}
        if around := _SCOPES.get():
            around[-1].extend(p for p in own if p in kept)
        for path in own:
            if path not in kept:
                delete(spark, path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI, in the file system that Spark itself would take where the path names none."""
    jvm = spark.sparkContext._jvm
    uri = jvm.org.apache.hadoop.fs.Path(path).toUri()
    if uri.getScheme():
        return path
    base = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{base.getScheme()}://{base.getAuthority() or ''}{uri.getPath()}"


#: Keys that hold more than this share of all rows are dealt out, and such of fewer rows than HOT_LEAST never.
HOT_SHARE, HOT_LEAST = 4096, 1000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each key, with the number n of its rows; a written table), hot keys dealt out.

    A key with more than a share-th of all rows gets as many salted copies as it
    has such shares, and its rows are dealt over them by ``spread``. As the shares
    add up to one, at most ``share`` keys are hot, so these alone are broadcast.
    """
    most = max((groups.agg(F.sum("n")).first()[0] or 0) // share, least)
    salts = F.ceil(F.col("n") / most).cast("int")
    hot = groups.where(F.col("n") > most).select(*keys, salts.alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, salts - 1).otherwise(0))))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """1-based places in a total order, for any number of rows: places in ranges plus the rows of the ranges before."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = cut(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = own.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return own.join(F.broadcast(starts.select("_part", "_before")), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")
