"""Token counts in delta-maintained rollups.

Changes of documents become signed rows: an insert adds a document and its tokens,
a delete takes them away, a revised count adds the difference. A batch is summed
by source, language and tokenizer version before it is committed, and totals are
sums of committed batches: nothing is ever recounted.

A commit is a folder named by its batch id; it counts once its _SUCCESS marker is
there. Committing an id again does nothing, and an attempt that was cut short is
overwritten, so a batch may be retried freely. ``compact`` folds the batches of one
listing into a snapshot that names them; totals are the newest snapshot plus the
batches it does not name. So a batch that is committed beside a compaction is in
the snapshot and its list, or in neither. One compaction runs at a time. The driver
holds the ids of the batches, one name per commit, and no more.

The vocabulary is read once, by the driver, and goes to the tasks with the job.

Defined cases: a null text has no tokens; null sources and languages are keys of
their own; a batch may be empty; repeated rows count as often as they come; other
columns are not read, and a carried one named tokens comes out as tokens_in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bound_batches, set_aside
from .wordbytes import trimmed

TOKENIZERS = "/opt/tokenizers"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
KEYS = ("source", "lang", "tokenizer")


def load_vocabulary(path: str) -> tuple[str, str, bytes]:
    """A public vocabulary as (name, pattern, ranks file)."""
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        return path.rpartition("/")[2], PATTERN, f.read()


def encoder(name: str, pattern: str, raw: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _token_counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*vocabulary.value)
        for batch in batches:
            texts = batch.column("text")
            counts = [len(coder.encode_to_numpy(x)) if x else 0 for x in (t.as_py() for t in texts)]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts, pa.int64())], [*rest, "tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Tokens of every whole text by a public byte-level vocabulary, beside the carried columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    docs, names = set_aside(docs, ("tokens",))
    carry = tuple(names[c] for c in carry)
    kinds = dict(docs.dtypes)
    return docs.select(*carry, "text").mapInArrow(trimmed(_token_counter(shared)), ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", tokens long")


def count_words(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """White-space words of every whole text: the plainest tokenizer version."""
    docs, names = set_aside(docs, ("tokens",))
    return docs.select(*[names[c] for c in carry], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def inserts(counts: DataFrame, tokenizer: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame, tokenizer: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    """A revised count moves no document: it takes the old tokens away and adds the new ones."""
    gone = deletes(old, tokenizer).withColumn("docs", F.lit(0).cast("long"))
    return gone.unionByName(inserts(new, tokenizer).withColumn("docs", F.lit(0).cast("long")))


def folder(batch_id: str) -> str:
    """A batch id as a folder's name: letters, digits, dashes and dots stay, other bytes become _ and two hex digits."""
    if not batch_id:
        raise ValueError("a batch id is required")
    plain = "".join(chr(b) if chr(b).isalnum() and b < 128 or chr(b) in "-." else f"_{b:02x}" for b in batch_id.encode())
    return "b" + plain  # never a name that Hadoop hides


class Rollup:
    """Totals kept in a folder of batches and snapshots."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        top = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(top):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(top)]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was committed before. Folders of folded batches stay, as their marks."""
        target = f"{self.path}/batches/{folder(batch_id)}"
        if self._fs.exists(self._path(f"{target}/_SUCCESS")):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(target)
        return True

    def _listing(self) -> tuple[str | None, list[str], list[str]]:
        """The newest snapshot, the batches in it, and those committed since."""
        newest = (self._committed("snapshots") or [None])[-1]
        folded = [] if newest is None else [r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{newest}/batches").collect()]
        return newest, folded, sorted({*self._committed("batches")} - {*folded})

    def _sums(self, newest: str | None, since: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in since] + ([f"{self.path}/snapshots/{newest}/totals"] if newest else [])
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """Totals by source, language and tokenizer version of all committed batches."""
        newest, _, since = self._listing()
        return self._sums(newest, since)

    def compact(self) -> None:
        """Fold the batches committed by now into a new snapshot."""
        self._fold(*self._listing())

    def _fold(self, newest: str | None, folded: list[str], since: list[str]) -> None:
        """Write the snapshot of one listing; its marker is written last."""
        target = f"{self.path}/snapshots/{int(newest) + 1 if newest else 0:08d}"
        self._sums(newest, since).write.mode("overwrite").parquet(f"{target}/totals")
        self.spark.createDataFrame([(b,) for b in [*folded, *since]], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
        self._fs.create(self._path(f"{target}/_SUCCESS"), True).close()
