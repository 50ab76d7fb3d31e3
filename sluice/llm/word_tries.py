"""Importance resampling towards a target distribution, with word tries inside each task.

Features are runs of one to ``runs`` words; a feature's bucket is a CRC of its words
joined by blanks. A task keeps a trie of the words it meets: the node of a run holds
its CRC state, from which the next word's state follows, so no run is ever joined or
hashed from its start. While features are counted a node holds its count; the counts
go to their buckets' totals at the task's end, or as soon as the trie is large, when a
new one begins. So a task's memory is bounded, and it sends at most one row per
bucket. The corpus and the target give a gain per bucket; documents are then scored
by walking tries whose nodes have the gain of their bucket attached.

The draw is by the Gumbel trick: weight plus a seeded noise, largest first. The order
is found by ranges and never in one task; ``buckets`` rows reach the driver.

Defined cases: null or wordless texts have no features, weight 0 and are not drawn;
a null id draws as an empty one and comes last among ties; repeated rows count and
draw as often as they come, with ranks of their own; empty tables give no gains but
those of empty buckets; texts of any length are walked in blocks of words; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, numbered
from .wordbytes import trimmed

RUNS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Nodes and bytes of words in a trie before its counts go to the totals and a new one begins.
NODES, WORD_BYTES = 400_000, 64 << 20
#: Features met that wait to be added to their nodes' counts.
PENDING = 1 << 18
#: Bytes of text that become words at once.
STEP = 1 << 20
#: ASCII but for digits and letters separates words; A-Z become a-z; bytes of longer characters stay.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_blocks(text: str, runs: int = RUNS, step: int = STEP) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in blocks, each after the last words of the block before it (their number comes along)."""
    data, at, kept = text.encode("utf-8", "surrogatepass").translate(_WORDS), 0, []
    while at < len(data):
        end = data.find(b" ", at + step)
        end = len(data) if end < 0 else end
        words = [*kept, *data[at:end].split()]
        yield words, len(kept)
        kept, at = words[len(words) - runs + 1 :] if runs > 1 else [], end


class _Edges(dict):
    """A node's children by word; a word not met before makes one."""

    __slots__ = ("trie", "node")

    def __init__(self, trie: Trie, node: int) -> None:
        self.trie, self.node = trie, node

    def __missing__(self, word: bytes) -> int:
        self[word] = made = self.trie.grow(self.node, word)
        return made


class Trie:
    """Nodes by number, the root first: CRC state, count and, if buckets have gains, the gain of each."""

    def __init__(self, gains: list[int] | None = None) -> None:
        self.state, self.gain, self.gains, self.word_bytes = [0], [0], gains, 0
        self.top, self.edges = _Edges(self, 0), {}
        self.count, self.pending = np.zeros(1, np.int64), []

    def grow(self, node: int, word: bytes) -> int:
        state = zlib.crc32(word, zlib.crc32(b" ", self.state[node]) if node else 0)
        self.state.append(state)
        if self.gains is not None:
            self.gain.append(self.gains[state % len(self.gains)])
        self.word_bytes += len(word)
        return len(self.state) - 1

    def walk(self, words: list[bytes], known: int, runs: int) -> Iterator[list[int]]:
        """The nodes of all runs that end after the first ``known`` words, one list for each length of a run."""
        nodes = list(map(self.top.__getitem__, words))
        yield nodes[known:]
        for k in range(1, runs):
            nodes = [self._below(a)[w] for a, w in zip(nodes, words[k:])]
            yield nodes[max(known - k, 0) :]

    def _below(self, node: int) -> _Edges:
        if node not in self.edges:
            self.edges[node] = _Edges(self, node)
        return self.edges[node]

    def meet(self, nodes: list[int]) -> None:
        """Count one more feature at each of these nodes."""
        self.pending += nodes
        if len(self.pending) > PENDING:
            self.settle()

    def settle(self) -> None:
        met = np.bincount(np.array(self.pending, np.int64), minlength=len(self.state))
        met[: len(self.count)] += self.count
        self.count, self.pending = met, []

    def full(self) -> bool:
        return len(self.state) > NODES or self.word_bytes > WORD_BYTES

    def add_to(self, totals: np.ndarray) -> None:
        """Add the counts of all nodes to their buckets' totals."""
        self.settle()
        np.add.at(totals, np.array(self.state, np.int64) % len(totals), self.count)


def _counter(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie()
        for batch in batches:
            for text in batch.column("text"):
                for words, known in word_blocks(text.as_py() or "", runs):
                    for nodes in trie.walk(words, known, runs):
                        trie.meet(nodes)
                    if trie.full():
                        trie.add_to(totals)
                        trie = Trie()
        trie.add_to(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket of all texts, from one row per task and bucket."""
    bound_batches(texts.sparkSession)
    parts = texts.select("text").mapInArrow(trimmed(_counter(runs, buckets)), "bucket int, n long")
    out = [0] * buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count one more, floored."""
    n, all_s, all_t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(((t + 1) * float(all_s + n)) / ((s + 1) * float(all_t + n)))) for s, t in zip(source, target, strict=True)]


def _scorer(gains, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gains.value)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column("text"):
                words_in, features, total = 0, 0, 0
                for words, known in word_blocks(text.as_py() or "", runs):
                    words_in += len(words) - known
                    for nodes in trie.walk(words, known, runs):
                        features += len(nodes)
                        total += sum(map(trie.gain.__getitem__, nodes))
                    if trie.full():
                        trie = Trie(gains.value)
                n_words.append(words_in)
                n_features.append(features)
                weight.append(total // features if features else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scores(docs: DataFrame, gains: list[int], runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind, shared = dict(docs.dtypes)["doc_id"], spark.sparkContext.broadcast(gains)
    found = docs.select("doc_id", "text").mapInArrow(trimmed(_scorer(shared, runs)), f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return found.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; the rank is null unless it is drawn."""
    gains = bucket_gains(bucket_totals(docs, runs, buckets), bucket_totals(target, runs, buckets))
    scored = cut(scores(docs, gains, runs, seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    placed = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")], "rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
