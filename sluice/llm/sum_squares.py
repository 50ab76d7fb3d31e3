"""Packing of documents into training sequences by the sum-of-squares rule.

A document is its token ids and an end id. One longer than a sequence is cut into
whole sequences; what does not fill one goes first, as a shorter piece. Whole pieces
are sequences of their own. The others are placed longest first: of all open
sequences with room, a piece goes to one with that gap for which the sum of squared
counts of open sequences per gap becomes smallest, and opens a sequence only where
none has room. Ties take the smaller gap.

Only lengths matter to the rule, so it needs one count per gap. Pieces are dealt by
a hash of their row over groups of about ``group`` pieces, each packed by itself: a
task holds that many lengths, however long the texts or large the corpus. A group
leaves a few sequences half empty at its end; with 8,192 pieces that is about one in
a thousand. Pieces are written before they are numbered, so a lost executor repeats a
group with the same result.

Ids come from a vocabulary file of the tokenizers library. They are found by the
byte-pair encoder of tiktoken over the ranks of that file, which gives the same ids
at four times the speed (1.2 MB/s and core by the library itself); a test compares
both. Special tokens of the file that a text spells out are taken as such, as the
library does by default.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are
packed as often as they come; an empty table has no sequences; a table's other
columns are not read, and may have any names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .wordbytes import trimmed

SEQUENCE, END, GROUP = 1024, 2, 8192


def load_vocabulary(path: str) -> tuple[str, str, dict[bytes, int], dict[str, int]]:
    """(name, pattern, ranks, special tokens) of a byte-level vocabulary file of the tokenizers library."""
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    # Byte-level vocabularies spell printable bytes as themselves and the others, in order, from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(signs[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    return path.rpartition("/")[2], PATTERN, ranks, special


def encoder(name: str, pattern: str, ranks: dict[bytes, int], special: dict[str, int]):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cuts(length: int, size: int = SEQUENCE) -> list[int]:
    """Where the pieces of a document of so many ids begin, and its end: whole pieces, but for a shorter first one."""
    return [0, *range((length - 1) % size + 1, length + 1, size)]


def _piece_maker(vocabulary, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*vocabulary.value)
        known = coder.special_tokens_set
        for batch in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(coder.encode_to_numpy(text.as_py() or "", allowed_special=known), end).astype("<u4")
                edges = cuts(len(ids), size)
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """A written table of the pieces of all documents: row (a number), doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    made = docs.select("doc_id", "text").mapInArrow(trimmed(_piece_maker(shared, size, end, with_ids)), schema)
    return cut(made.withColumn("row", F.monotonically_increasing_id()), "pieces")


def place(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """For lengths below ``size``: which of the sequences opened so far each one goes to, and where it begins there."""
    count = np.zeros(size, np.int64)  # open sequences by gap
    held: list[list[int]] = [[] for _ in range(size)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        a = int(lengths[i])
        here = count[a:]
        fits = np.flatnonzero(here)
        if len(fits):
            # A move from gap g to g - a changes the sum by 2 * (count[g - a] - count[g] + 1); a full sequence leaves it.
            change = 2 * (count[fits] - here[fits] + 1)
            if fits[0] == 0:
                change[0] = 1 - 2 * here[0]
            gap = a + int(fits[change.argmin()])
            to = held[gap].pop()
            count[gap] -= 1
        else:
            gap, to, opened = size, opened, opened + 1
        bins[i], offsets[i] = to, size - gap
        if gap > a:
            held[gap - a].append(to)
            count[gap - a] += 1
    return bins, offsets


def _packer(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("length", "descending"), ("row", "ascending")])  # the same in every attempt
        row = table.column("row").to_numpy()
        bins, offsets = place(table.column("length").to_numpy(), size)
        name = np.empty(int(bins.max()) + 1, np.int64)
        name[bins[offsets == 0]] = row[offsets == 0]
        return table.append_column("sequence_id", pa.array(name[bins])).append_column("offset", pa.array(offsets)).drop_columns(["_group"])

    return run


def pack(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Pieces (a written table) without their ids, with the sequence of each and its offset there. A sequence has the row of its first piece for a number."""
    kinds = dict(pieces.dtypes)
    narrow = [c for c in pieces.columns if c != "ids"]
    pieces = pieces.select(*narrow)
    whole = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < size)
    groups = max(1, -(-short.count() // group))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in narrow) + ", sequence_id long, offset long"
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("_group").applyInArrow(_packer(size), schema))


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of all its tokens), doc_ids and starts (where each piece begins), from pieces with their ids."""
    parts = pieces.select("row", "ids").join(packed.select("row", "doc_id", "sequence_id", "offset"), "row")
    # A sequence holds at most ``size`` pieces.
    held = F.array_sort(F.collect_list(F.struct("offset", "row", "doc_id", "ids")))
    told = parts.groupBy("sequence_id").agg(held.alias("h"))
    return told.select("sequence_id", F.flatten(F.transform("h", lambda x: x["ids"])).alias("ids"), F.transform("h", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("h", lambda x: x["offset"]).alias("starts"))
