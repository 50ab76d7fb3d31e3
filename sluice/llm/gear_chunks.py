"""Substring dedup by content-defined chunking with a gear rolling hash.

Every byte shifts the gear hash left and adds its byte's value, so a hash depends
on the last GEAR bytes alone. A chunk ends where the hash is the smallest within
``reach`` bytes on either side: a purely local rule, so that an insertion moves
only the chunks it touches, and chunk lengths vary little (about 2 * reach + 1 on
average, more than reach always). Chunks are deduplicated by 128-bit digest.

A chunk is repeated if its digest stands in another document too; the lowest
doc_id of those is its keeper. A document's chunks that follow each other in the
keeper, too, are a run. From the ends of every run, however short, the document's
and the keeper's bytes are compared until they differ; the whole words that agree
are a passage, and count from ``min_words`` on. The document's copy may be removed,
the keeper's stays. All that is removed stands in a document of lower id, so that
the lowest copy of every passage stays. Not found are passages without one whole
shared chunk, and what two documents share beyond the text of the lowest keeper of
all chunks of it.

Scale: one narrow row per chunk is written once. Digests are counted with map-side
sums, which collapses a passage that a third of all documents share before it
moves. Chunks then meet their keepers by an equi-join whose hot digests are dealt
out over salted keys. Of texts, only the bytes
around the ends of runs are compared: texts are shuffled once, to cut these
slices, and slices that agree as a whole are looked at again ``WIDER`` times as wide,
after runs that have grown together have been joined. No group of copies is
gathered, and no copies but the lowest are paired with each other.

Defined cases: null and empty texts have no chunks; equal rows are one document;
different texts under one doc_id are one document in several texts: they do not
make each other repeated, each has spans of its own, told apart by ``text_hash``
(0 where the doc_id has one text); rows with a null doc_id are ignored; texts
shorter than a chunk are one chunk; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, fresh, release, spread_join
from .wordbytes import SPACE, steps, trimmed

#: Bytes that a gear hash depends on, and the reach of the smallest-hash rule.
GEAR, REACH = 16, 20
MIN_WORDS = 50
_GEAR_VALUE = np.random.default_rng(20240301).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes compared on either side of a run's ends at first, and how many times as many later.
SLICE, WIDER = 160, 16
BROADCAST_IDS = 2_000_000
CHUNKS = "doc_id long, part long, hi long, lo long, start int, bytes int, word int, words int"
PAIR = ("doc_id", "part", "k_doc", "k_part", "shift")
#: A run: its pair, first and end byte, words begun before these, and words begun before its place in the keeper.
RUN = (*PAIR, "s", "e", "ws", "we", "kws")
EDGES = "doc_id long, part long, k_doc long, k_part long, shift int, s int, e int, ws int, we int, kws int, raw_s int, raw_e int, new_s int, new_e int, first int, k_first int, last int, done boolean"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of value[data[i - j]] << j for the last GEAR bytes, in log2(GEAR) passes."""
    h = _GEAR_VALUE[data]
    span = 1
    while span < GEAR:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def _windowed_min(h: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(h[i : i + width]), by doubling; the array is as long as full windows allow."""
    span, out = 1, h
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _smallest(data: np.ndarray, reach: int) -> np.ndarray:
    """Places whose hash is the smallest within ``reach`` bytes on either side."""
    n = len(data)
    if n < 2 * reach + 1:
        return np.zeros(0, np.int64)
    h = gear_hashes(data)
    low = _windowed_min(h, 2 * reach + 1)
    return np.flatnonzero(h[reach : n - reach] == low) + reach


def _apart(at: np.ndarray, reach: int) -> np.ndarray:
    """Of equal hashes within reach (runs of one byte) the first."""
    if len(at) > 1 and (np.diff(at) <= reach).any():
        kept, last = [], -reach - 1
        for x in at.tolist():
            if x - last > reach:
                kept.append(x)
                last = x
        at = np.array(kept, np.int64)
    return at


def boundaries(data: np.ndarray, offsets: np.ndarray | None = None, reach: int = REACH) -> np.ndarray:
    """Ends of the chunks inside texts laid end to end (one text where no offsets are given); a text's own end is not named.

    They depend on their own text alone: where hashes within reach would see
    bytes of the text before or after, no chunk ends.
    """
    if offsets is None:
        offsets = np.array([0, len(data)], np.int64)
    at = _smallest(data, reach)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = (at - reach - (GEAR - 1) >= offsets[doc]) & (at + reach < offsets[doc + 1])
    return _apart(at[inside], reach) + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    for batch in batches:
        ids, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "part"))
        for first, _, data, offsets in steps(batch.column("text")):
            space = SPACE[data]
            begins = ~space
            begins[1:] &= space[:-1]
            inner = offsets[1:-1]
            inner = inner[inner < len(data)]
            begins[inner] = ~space[inner]
            begun = np.concatenate([[0], np.cumsum(begins)])
            ends = np.union1d(boundaries(data, offsets), offsets[1:])
            starts = np.concatenate([[0], ends[:-1]])
            full = ends > starts
            starts, ends = starts[full], ends[full]
            if not len(starts):
                continue
            view = memoryview(np.ascontiguousarray(data))
            both = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), ">i8").reshape(-1, 2)
            doc = np.searchsorted(offsets, starts, "right") - 1
            cols = [
                ids[first + doc], of[first + doc], both[:, 0].astype(np.int64), both[:, 1].astype(np.int64), (starts - offsets[doc]).astype(np.int32),
                (ends - starts).astype(np.int32), (begun[starts] - begun[offsets[doc]]).astype(np.int32), (begun[ends] - begun[starts]).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, part, text: every text of every document once; part tells several texts of one doc_id apart, else it is 0."""
    base = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    th = F.xxhash64("text")
    ids = base.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(th) != F.max(th)).alias("several"))
    again = cut(ids.where("n > 1").select("doc_id", "several"), "again")
    n = again.count()
    if not n:
        return base.select("doc_id", F.lit(0).cast("long").alias("part"), "text")
    known = F.broadcast(again) if n <= BROADCAST_IDS else again
    once = base.join(known, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("part"), "text")
    more = base.join(known, "doc_id").select("doc_id", F.when(F.col("several"), F.xxhash64("text")).otherwise(0).alias("part"), "text")
    return once.unionByName(more.dropDuplicates(["doc_id", "part"]))


def chunks(texts: DataFrame) -> DataFrame:
    """Every chunk of every whole text (doc_id, part, text): digest, place, length, words begun before and in it."""
    bound_batches(texts.sparkSession)
    return texts.select("doc_id", "part", "text").mapInArrow(trimmed(_chunks), CHUNKS)


def repeated_digests(parts: DataFrame) -> DataFrame:
    """Digests that stand in two documents or more: n chunks, the document that keeps them and the first place there."""
    ends = parts.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "part", "start", "word")).alias("k"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n"))
    kept = [F.col(f"k.{a}").alias(b) for a, b in (("doc_id", "k_doc"), ("part", "k_part"), ("start", "k_start"), ("word", "kws"))]
    return ends.where("k.doc_id < last_doc_id").select("hi", "lo", *kept, "n")


def marked_chunks(parts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Repeated chunks beside their place in their keeper, but for the keepers' own."""
    return spread_join(parts, repeated, ["hi", "lo"], ["doc_id", "start"]).where("k_doc < doc_id").drop("hi", "lo", "n")


def _grouped(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a pair with the number of their group: what overlaps or touches, in order, is one."""
    order = Window.partitionBy(*PAIR).orderBy(start, end)
    gap = F.col(start) > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("group", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def runs(marked: DataFrame) -> DataFrame:
    """Chunks that follow each other in the document and in the keeper, as runs."""
    placed = marked.withColumn("shift", F.col("start") - F.col("k_start")).withColumn("end", F.col("start") + F.col("bytes"))
    return _grouped(placed, "start", "end").groupBy(*PAIR, "group").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min("word").alias("ws"), F.max(F.col("word") + F.col("words")).alias("we"), F.min("kws").alias("kws")).drop("group")


def _slices(found: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Runs beside bytes of both texts: around the run (head), or where it is long around its start (head) and end (tail)."""
    ks, ke = F.col("s") - F.col("shift"), F.col("e") - F.col("shift")
    margin = F.least("s", ks, F.lit(width))
    long = F.col("e") - F.col("s") > 2 * width
    before = lambda at: F.greatest(at - margin - 1, F.lit(0))
    after = lambda s, e: F.when(long, s + width).otherwise(e + width + 1)

    def piece(slot: int, doc: str, part: str, low, high):
        return F.struct(F.lit(slot).alias("slot"), F.col(doc).alias("of_doc"), F.col(part).alias("of_part"), low.cast("int").alias("low"), (high - low).cast("int").alias("n"))

    s, e = F.col("s"), F.col("e")
    heads = [piece(0, "doc_id", "part", before(s), after(s, e)), piece(1, "k_doc", "k_part", before(ks), after(ks, ke))]
    tails = [piece(2, "doc_id", "part", e - width, e + width + 1), piece(3, "k_doc", "k_part", ke - width, ke + width + 1)]
    asked = found.select(*RUN, F.explode(F.when(long, F.array(*heads, *tails)).otherwise(F.array(*heads))).alias("x")).select(*RUN, "x.*")
    needed = asked.select(F.col("of_doc").alias("doc_id"), F.col("of_part").alias("part")).distinct()
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sources = texts.join(F.broadcast(needed), ["doc_id", "part"], "left_semi") if few else texts
    sources = sources.select(F.col("doc_id").alias("of_doc"), F.col("part").alias("of_part"), F.col("text").cast("binary").alias("raw"))
    got = asked.join(sources, ["of_doc", "of_part"]).select(*RUN, "slot", F.expr("substring(raw, low + 1, n)").alias("piece"))
    names = ("head", "k_head", "tail", "k_tail")
    return got.groupBy(*RUN).agg(*[F.max(F.when(F.col("slot") == i, F.col("piece"))).alias(c) for i, c in enumerate(names)])


class _Piece:
    """Some bytes of a text from ``low`` on, which of them are spaces, and which begin a word."""

    def __init__(self, raw: bytes, low: int):
        self.data, self.low = np.frombuffer(raw, np.uint8), low
        self.space = SPACE[self.data]
        self.begins = ~self.space
        if low:  # unknown, and never asked for: the byte before the first compared one
            self.begins[:1] = False
        self.begins[1:] &= self.space[:-1]

    def inside(self, at: int) -> bool:
        """Whether a place (in this piece) lies inside a word."""
        return 0 < at < len(self.data) and not self.space[at - 1] and not self.space[at]

    def begun(self, known: int, at: int, place: int) -> int:
        """Words begun before ``place``, where those before ``at`` are known."""
        if place >= at:
            return known + int(self.begins[at:place].sum())
        return known - int(self.begins[place:at].sum())


def _ends(s: int, e: int, shift: int, ws: int, we: int, kws: int, pieces: list, width: int) -> tuple:
    """raw_s, raw_e (bytes that agree), new_s, new_e (whole words of them), first, k_first, last (words begun), done."""
    long = pieces[2] is not None
    ks, ke = s - shift, e - shift
    m = min(s, ks, width)
    a, b = _Piece(pieces[0], max(s - m - 1, 0)), _Piece(pieces[1], max(ks - m - 1, 0))
    c, d = (_Piece(pieces[2], e - width), _Piece(pieces[3], ke - width)) if long else (a, b)
    i, j, x, y = s - a.low, ks - b.low, e - c.low, ke - d.low
    off = np.flatnonzero(a.data[i - m : i] != b.data[j - m : j])
    left = m - (int(off[-1]) + 1 if len(off) else 0)
    done = left < m or m == min(s, ks)
    n = min(len(c.data) - x, len(d.data) - y, width)
    off = np.flatnonzero(c.data[x : x + n] != d.data[y : y + n])
    right = int(off[0]) if len(off) else n
    done &= right < width or min(len(c.data) - x, len(d.data) - y) == width
    # Whole words: the search stops at the other end of what agrees, or of the piece if the run is long.
    p, q = i - left, x + right
    stop = len(a.data) if long else q
    if a.inside(p) or b.inside(j - left):
        blank = np.flatnonzero(a.space[p:stop])
        p = p + int(blank[0]) if len(blank) else stop
    word = np.flatnonzero(~a.space[p:stop])
    done &= not long or len(word) > 0
    p = p + int(word[0]) if len(word) else stop
    low = 0 if long else min(p, q)
    if c.inside(q) or d.inside(y + right):
        blank = np.flatnonzero(c.space[low:q])
        q = low + int(blank[-1]) if len(blank) else low
    word = np.flatnonzero(~c.space[low:q])
    done &= not long or len(word) > 0
    q = low + int(word[-1]) + 1 if len(word) else low
    return s - left, e + right, a.low + p, c.low + q, a.begun(ws, i, p), b.begun(kws, j, p - i + j), c.begun(we, x, q), done


def _comparer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in EDGES.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        for batch in batches:
            pieces = zip(*(batch.column(c).to_pylist() for c in ("head", "k_head", "tail", "k_tail")), strict=True)
            own = zip(*(batch.column(c).to_pylist() for c in ("s", "e", "shift", "ws", "we", "kws")), strict=True)
            found = [_ends(*x, p, width) for x, p in zip(own, pieces, strict=True)]
            cols = [batch.column(c) for c in RUN]
            cols += [pa.array([r[k] for r in found], kinds[kind]) for k, (_, kind) in enumerate(fields[len(RUN) :])]
            yield pa.RecordBatch.from_arrays([x.cast(kinds[kind]) for x, (_, kind) in zip(cols, fields, strict=True)], [name for name, _ in fields])

    return run


def passages(found: DataFrame, texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs extended to passages: the pair, s and e in bytes, first and last (words begun before), k_first."""
    done, width = [], SLICE
    while not found.isEmpty():
        ends = cut(_slices(found, texts, width).mapInArrow(trimmed(_comparer(width)), EDGES), "run-ends")
        own = F.struct(*[F.col(a).alias(b) for a, b in (("new_s", "start"), ("new_e", "end"), ("first", "first"), ("last", "last"), ("k_first", "k_first"))])
        # What overlaps at one shift agrees as a whole: the end of one that is done is the end of all.
        joined = cut(_grouped(ends, "raw_s", "raw_e").groupBy(*PAIR, "group").agg(
            F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("ws", "s").alias("ws"), F.max_by("we", "e").alias("we"), F.min_by("kws", "s").alias("kws"),
            F.max(F.when(F.col("done"), own)).alias("p")), "runs")
        release(ends, found)
        done.append(joined.where(F.col("p.last") - F.col("p.first") >= min_words).select(*PAIR, "p.*"))
        found = cut(joined.where("p IS NULL").select(*RUN), "runs")
        width = min(width * WIDER, 1 << 30)
    return reduce(DataFrame.unionByName, done) if done else found.select(*PAIR, *[F.lit(0).alias(c) for c in ("start", "end", "first", "last", "k_first")])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of min_words words or more that stand in another document too.

    One row per span of overlapping passages: doc_id, text_hash, start and length in
    bytes, n_words, n_passages, the lowest keeper, and removed (false where the
    document itself keeps them). A kept span may overlap a removed one, whose
    words then stand in a lower document.
    """
    texts = documents(docs)
    parts = cut(chunks(texts), "chunks")
    repeated = cut(repeated_digests(parts), "digests")
    found = cut(runs(marked_chunks(parts, repeated)), "runs")
    release(parts, repeated)
    pairs = passages(found, texts, min_words)
    gone = pairs.select("doc_id", "part", F.lit(True).alias("removed"), "start", "end", "first", "last", F.col("k_doc").alias("keeper_doc_id"))
    kept = pairs.select(
        F.col("k_doc").alias("doc_id"), F.col("k_part").alias("part"), F.lit(False).alias("removed"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"),
        F.col("k_first").alias("first"), (F.col("k_first") + F.col("last") - F.col("first")).alias("last"), F.col("k_doc").alias("keeper_doc_id"))
    owner = ("doc_id", "part")
    each = gone.unionByName(kept).groupBy(*owner, "removed", "start", "end", "first", "last").agg(F.min("keeper_doc_id").alias("keeper_doc_id"))
    order = Window.partitionBy(*owner, "removed").orderBy("start", "end")
    gap = F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = each.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*owner, "removed", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).cast("long").alias("n_words"),
        F.count("*").alias("n_passages"), F.min("keeper_doc_id").alias("keeper_doc_id"),
    )
    # What a removed span holds is not kept here, though a higher document may have been compared with it.
    over = F.max(F.when(F.col("removed"), F.col("end"))).over(Window.partitionBy(*owner).orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("over", F.coalesce(over, F.lit(0))).where("removed OR over < end")
    return spans.select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "n_words", "n_passages", "keeper_doc_id", "removed", F.col("part").alias("text_hash"))


def _cut_out(text: str, spans: list) -> str:
    raw = text.encode()
    kept, at = [], 0
    for start, length in sorted(spans):
        kept.append(raw[at:start])
        at = start + length
    return b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without their removed spans; their own columns, whatever their names."""
    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if g is None or t is None else _cut_out(t, [(x["start"], x["length"]) for x in g]) for t, g in zip(text, gone, strict=True)])

    name, key, part = (fresh(docs.columns, c) for c in ("_gone", "_id", "_part"))
    gone = spans.where("removed").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(part)).agg(F.collect_list(F.struct("start", "length")).alias(name))
    own = (F.col("doc_id") == F.col(key)) & ((F.col(part) == 0) | (F.col(part) == F.xxhash64("text")))
    return docs.join(gone, own, "left").withColumn("text", without("text", name)).select(*docs.columns)
