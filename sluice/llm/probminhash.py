"""MinHash near-dedup by ProbMinHash.

A text is a bag of five-word shingles, weighted by how often each occurs (a text
of one to four words is one shingle). Every shingle is a Poisson process: its
arrivals, at a rate of its weight, each hit one of M registers, and a register
keeps the shingle that came first. A shingle's process ends as soon as it is
later than the text's latest register, so a text costs about its length plus
M log M. Two texts agree in a register with the probability Jaccard similarity

    J_P = sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i),

which is the Jaccard similarity where all weights are equal.

Equal texts form classes first (by 128-bit digest, combined map-side). Of each
class one signature goes on. Signatures are cut into bands; texts that share a
band's bucket are candidates. Candidates whose estimate is within five standard
errors of the threshold are verified exactly on whole texts. Links join to
components by alternating large and small stars.

No bucket is expanded into all its pairs. First every text meets the best of its
buckets' smallest members; texts that are connected by then need no other look.
Where members of a bucket are still in different components, the rest is
searched exactly: the bucket is dealt out in blocks, and pairs of blocks
compare signatures as matrices. Members with a plausible partner in another
component go on with their texts, again in pairs of blocks, where all similarities
are bounded by inverted lists, those that may reach the threshold are compared exactly,
and only links that join components come out. So no link between texts that share a bucket is lost, and rows out of a
bucket are at most its members.

Every text has a number of its own; buckets, links and components know texts by
these, and document ids come in at the end. Joins on buckets, leaders and digests
deal hot keys out over salted copies.

Defined cases: a null text is a class of its own; empty or wordless texts are
near only their exact copies; rows are judged by their texts, whatever their ids:
a doc_id with several texts is in the class of each, and rows of null ids are like
others; a class is named by its smallest doc_id (null if it has none), and
``class_no`` tells classes apart; an empty table gives an empty result; other
columns are not read. ``keep_one`` keeps one row of every class, and all rows of null
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bound_batches, cut, fresh, release, spread_join
from .wordbytes import Words, mixed, steps, trimmed

SHINGLE = 5
#: Registers = BANDS * ROWS: texts of similarity 0.8 share a bucket with probability 0.9999.
BANDS, ROWS = 24, 5
M = BANDS * ROWS
THRESHOLD = 0.8
#: Members of a block: of signatures, and of whole texts.
SIGNATURE_BLOCK, TEXT_BLOCK = 1024, 256
BROADCAST_IDS = 2_000_000
_STEP = 1 << 19
_NEXT = np.uint64(0xD1B54A32D192ED03)


def weighted_shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, text, weight) of each text's distinct shingles."""
    hashes = w.hashes()
    keys, _, doc = w.windows(hashes, SHINGLE)
    parts_k, parts_d = [keys], [doc]
    for k in range(1, SHINGLE):
        if (w.counts == k).any():
            short, _, owner = w.windows(hashes, k)
            own = w.counts[owner] == k
            parts_k.append(short[own] + np.uint64(k))
            parts_d.append(owner[own])
    keys, doc = np.concatenate(parts_k), np.concatenate(parts_d)
    with np.errstate(over="ignore"):
        both = keys ^ mixed(doc.astype(np.uint64) + _NEXT)
    order = np.argsort(both)
    both, keys, doc = both[order], keys[order], doc[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return keys[at], doc[at], np.diff(np.append(at, len(both))).astype(np.float64)


def signatures(keys: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """The shingle that arrives first at each register: n_docs rows of m 64-bit values."""
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(keys))
    state = keys.copy()
    with np.errstate(over="ignore"):
        while len(state):
            state += _NEXT
            z = mixed(state)
            time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
            slot = doc * m + ((z * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(33)).astype(np.int64) % m
            np.minimum.at(first, slot, time)
            won = first[slot] == time
            owner[slot[won]] = keys[won]
            latest = first.reshape(n_docs, m).max(axis=1)
            alive = time < latest[doc]
            state, time, keys, doc, weight = state[alive], time[alive], keys[alive], doc[alive], weight[alive]
    return owner.reshape(n_docs, m)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in steps(batch.column("text"), _STEP):
            w = Words(data, offsets)
            keys, doc, weight = weighted_shingles(w)
            short = mixed(signatures(keys, doc, weight, end - first)).astype(np.uint16)
            raw = short.tobytes()
            width = 2 * M
            sig = [raw[i * width : (i + 1) * width] if n else None for i, n in enumerate(w.counts.tolist())]
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(sig, pa.binary())], ["doc_id", "h1", "h2", "sig"])


def exact_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two bags (keys, weights), in n log n."""
    common, ia, ib = np.intersect1d(a[0], b[0], return_indices=True)
    if not len(common):
        return 0.0
    va, vb = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - va.sum(), b[1].sum() - vb.sum()
    ratio = vb / va
    order = np.argsort(ratio, kind="stable")
    va, vb, ratio = va[order], vb[order], ratio[order]
    # For j with a larger ratio the maximum is b's share, for the others a's; equal ratios agree.
    below = np.searchsorted(ratio, ratio, "left")
    sum_a = np.concatenate([[0], np.cumsum(va)])
    sum_b = np.concatenate([[0], np.cumsum(vb)])
    return float(np.sum(1 / ((only_a + sum_a[below]) / va + (only_b + sum_b[-1] - sum_b[below]) / vb)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    keys, _, weight = weighted_shingles(Words(raw, np.array([0, len(raw)], np.int64)))
    return keys, weight


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}  # the bags of the first side come in runs
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            out = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x not in last:
                    last = {x: bag(ta[i].as_py())}
                if exact_similarity(last[x], bag(tb[i].as_py())) >= threshold - 1e-9:
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold."""
    side = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    both = side.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(trimmed(_verifier(threshold)), "a long, b long")


def _agreement(sa, sb):
    import pandas as pd

    n = len(sa)
    if not n:
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(sa), np.uint16).reshape(n, M)
    y = np.frombuffer(b"".join(sb), np.uint16).reshape(n, M)
    return pd.Series((x == y).mean(axis=1))


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_l"))
    return rows.join(named, column, "left").withColumn(name, F.coalesce("_l", column)).drop("_l")


def _merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """Labels after components were joined: the old labels are nodes of ``joined``, as are texts that were alone."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    roots = cut(_labelled(counts, joined, "label", "root").select("label", "root", "n"), "roots")
    return cut(spread_join(labels, roots, ["label"], ["node"]).select("node", F.col("root").alias("label")).unionByName(joined), "labels")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, i, j), which come together, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
        at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(at[:-1], at[1:], strict=True):
            key = tuple(keys[:, x].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks that the group compares (one block with itself, or two)."""
    block = group.column("block").to_numpy()
    return np.flatnonzero(block == group.column("i")[0].as_py()), np.flatnonzero(block == group.column("j")[0].as_py())


def _plausible(least: float):
    """Members with a partner in another component whose estimate is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, M)
            label = group.column("label").to_numpy()
            left, right = _sides(group)
            flagged = np.zeros(len(label), bool)
            for x in left:
                ok = (label[right] != label[x]) & ((sig[right] == sig[x]).mean(axis=1) >= least)
                flagged[x] |= ok.any()
                flagged[right[ok]] = True
            if flagged.any():
                at = pa.array(np.flatnonzero(flagged))
                yield pa.RecordBatch.from_arrays([group.column(c).take(at).combine_chunks() for c in ("bucket", "rid", "label")], ["bucket", "rid", "label"])

    return run


def _shares(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' distinct shingles as one table sorted by text: hashes, their shares of the text's weight, and where each text begins (and the last ends)."""
    keys, docs, weights = [], [], []
    for first, _, data, offsets in steps(texts, _STEP):
        k, d, w = weighted_shingles(Words(data, offsets))
        order = np.argsort(d, kind="stable")
        keys.append(k[order])
        docs.append(d[order] + first)
        weights.append(w[order])
    doc, weight = np.concatenate(docs), np.concatenate(weights)
    n = len(texts)
    return np.concatenate(keys), weight / np.bincount(doc, weight, n)[doc], np.searchsorted(doc, np.arange(n + 1))


def _at_most(keys: np.ndarray, share: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Bounds from above of a text's similarity to each of n others, whose shingles are listed (hashes in order, texts, shares).

    Of a common shingle with shares p and q the similarity's term is at most 1 / (1/p + B/q) and 1 / (A/p + 1/q),
    where A and B are the shares of the shingles that only one side has. With equal weights this is the similarity
    itself. Texts that are not ``wanted``, or share less than the threshold, get 0.
    """
    listed, owner, shares = lists
    low, high = np.searchsorted(listed, keys, "left"), np.searchsorted(listed, keys, "right")
    ends = np.cumsum(high - low)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(_STEP, ends[-1], _STEP), "right").tolist(), len(keys)]) if len(ends) else []

    def common() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            width = high[x:y] - low[x:y]
            at = np.repeat(low[x:y] - np.cumsum(width) + width, width) + np.arange(width.sum())
            yield owner[at], np.repeat(share[x:y], width), shares[at]

    mine, theirs, out = np.zeros(n), np.zeros(n), np.zeros(n)
    for who, p, q in common():
        mine += np.bincount(who, p, n)
        theirs += np.bincount(who, q, n)
    close = wanted & (np.minimum(mine, theirs) >= threshold)
    if close.any():
        for who, p, q in common():
            on = close[who]
            who, p, q = who[on], p[on], q[on]
            only_mine, only_theirs = np.maximum(1 - mine[who], 0), np.maximum(1 - theirs[who], 0)
            out += np.bincount(who, 1 / np.maximum(1 / p + only_theirs / q, only_mine / p + 1 / q), n)
    return out


def _linked(threshold: float):
    """Links between components (by their labels) by similarities of all pairs of two blocks, as few as join them.

    One text's shingles are looked up in the blocks' inverted lists, which bounds its
    similarities to all others in one count; what may reach the threshold is compared exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            label = group.column("label").to_numpy()
            left, right = _sides(group)
            texts = group.column("text").combine_chunks()
            keys, share, start = _shares(texts)
            n = len(label)
            owner = np.repeat(np.arange(n), np.diff(start))
            inside = np.isin(owner, right)
            order = np.argsort(keys[inside], kind="stable")
            lists = tuple(x[inside][order] for x in (keys, owner, share))
            parent = {x: x for x in label.tolist()}

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            out = []
            for x in left.tolist():
                wanted = label != label[x]
                if not wanted[right].any():
                    continue
                own = slice(start[x], start[x + 1])
                bound = _at_most(keys[own], share[own], lists, n, wanted, threshold - 1e-6)
                for y in np.flatnonzero(bound >= threshold - 1e-6).tolist():
                    i, j = int(label[x]), int(label[y])
                    # A bag's shares are as good as its weights.
                    if find(i) != find(j) and exact_similarity((keys[own], share[own]), (keys[start[y] : start[y + 1]], share[start[y] : start[y + 1]])) >= threshold - 1e-9:
                        parent[find(j)] = find(i)
                        out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, extra: DataFrame, size: int) -> DataFrame:
    """Members (bucket, rid, label, n of their bucket) dealt to pairs of blocks of their bucket, beside a column of ``extra`` by rid."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(extra, "rid")
    more = [c for c in extra.columns if c != "rid"]
    keyed = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "label", *more)
    return keyed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component: bucket, rid, label, n."""
    told = cut(_labelled(members.select("bucket", "rid"), labels, "rid", "label"), "labelled")
    still = told.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", "n")
    return spread_join(told, cut(still, "open"), ["bucket"], ["rid"])


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed documents, representatives of equal texts, and component labels of these."""
    agreement = F.pandas_udf(_agreement, "double")
    hashed = _hashed(docs)
    signed = cut(hashed.where("text IS NOT NULL").mapInArrow(trimmed(_signer), "doc_id long, h1 long, h2 long, sig binary"), "signatures")
    equal = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.min_by("sig", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("sig"))
    # Numbers are given by the write that fixes them: unique, whatever attempt commits.
    reps = cut(equal.withColumn("rid", F.monotonically_increasing_id()), "representatives")
    usable = reps.where("sig IS NOT NULL").select("rid", "sig")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    placed = usable.select("rid", F.explode(bands).alias("bucket"))
    full = cut(placed.groupBy("bucket").agg(F.min("rid").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = cut(spread_join(placed, full, ["bucket"], ["rid"]).select("bucket", "rid", "leader"), "members")
    release(full)
    wanted = members.select("rid").distinct().join(reps.select("rid", "first_doc", "h1", "h2"), "rid")
    a, b = hashed.alias("a"), wanted.alias("b")
    own = F.col("a.doc_id").eqNullSafe(F.col("b.first_doc")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    texts = cut(a.join(b, own).select("rid", "text").dropDuplicates(["rid"]), "texts")
    least = threshold - 5 * (threshold * (1 - threshold) / M) ** 0.5
    star = members.where("rid <> leader").select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct()
    sa, sb = usable.select(F.col("rid").alias("a"), F.col("sig").alias("sa")), usable.select(F.col("rid").alias("b"), F.col("sig").alias("sb"))
    pairs = cut(star.join(sb, "b").join(sa, "a").select("a", "b", agreement("sa", "sb").alias("estimate")).where(F.col("estimate") >= least), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    links = cut(verified(best, texts, threshold), "links")
    release(pairs)
    labels = components(links)
    flagged = cut(_in_blocks(_open_members(members, labels), usable, SIGNATURE_BLOCK).mapInArrow(trimmed(_plausible(least)), "bucket long, rid long, label long").distinct(), "flagged")
    counted = spread_join(flagged, cut(flagged.groupBy("bucket").agg(F.count("*").alias("n")), "flagged-buckets"), ["bucket"], ["rid"])
    more = cut(_in_blocks(counted, texts, TEXT_BLOCK).mapInArrow(trimmed(_linked(threshold)), "a long, b long"), "links")
    release(members, texts, flagged)
    if not more.isEmpty():
        labels = _merged(labels, components(more))
    return signed, reps, labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), text_class_id (of its equal texts), class_no, and the text's two hashes."""
    bound_batches(docs.sparkSession)
    signed, reps, labels = _classes(docs, threshold)
    nodes = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    firsts = nodes.join(reps.select(F.col("rid").alias("node"), "first_doc"), "node")
    names = cut(firsts.groupBy("label").agg(F.min("first_doc").alias("class_id"), F.count("*").alias("n")), "names")
    named = spread_join(nodes, names, ["label"], ["node"]).select(F.col("node").alias("rid"), "label", "class_id").withColumn("linked", F.lit(True))
    own = reps.join(named, "rid", "left").select(
        "h1", "h2", "n", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("first_doc")).alias("class_id"), F.col("first_doc").alias("text_class_id"), F.coalesce("label", "rid").alias("class_no"))
    told = spread_join(signed.select("doc_id", "h1", "h2"), cut(own, "classes"), ["h1", "h2"], ["doc_id"]).select("doc_id", "class_id", "text_class_id", "class_no", "h1", "h2")
    none = F.lit(None).cast("long")
    alone = F.col("doc_id").cast("long")
    return told.unionByName(docs.where("text IS NULL").select(alone.alias("doc_id"), alone.alias("class_id"), alone.alias("text_class_id"), none.alias("class_no"), none.alias("h1"), none.alias("h2")))


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class, that of its smallest doc_id (then of the smallest hash); rows of null texts stay.

    What goes is joined away: by (doc_id, text hashes), broadcast only if counted and
    small. Equal rows of one doc_id are dropped but for one.
    """
    told = cut(classes.where("class_no IS NOT NULL").groupBy("class_no", "doc_id", "h1", "h2").agg(F.count("*").alias("copies")), "told")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    best = cut(told.groupBy("class_no").agg(F.min(key).alias("best"), F.count("*").alias("n")), "best")
    goes = spread_join(told, best, ["class_no"], ["doc_id", "h1"]).where(key != F.col("best"))
    goes = cut(goes.select("doc_id", "h1", "h2"), "goes")
    again = cut(told.join(best.select(F.col("best.h1").alias("h1"), F.col("best.h2").alias("h2"), F.col("best.doc_id").alias("_doc")), ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("copies") > 1)).select("doc_id", "h1", "h2"), "again")
    h1, h2, i = fresh(docs.columns, "_h1"), fresh(docs.columns, "_h2"), fresh(docs.columns, "_id")
    keyed = docs.withColumns({h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text"), i: F.when(F.col("text").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))}).withColumn(h1, F.when(F.col("doc_id").isNull(), F.bitwise_not(h1)).otherwise(F.col(h1)))

    def joined(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        # A null id is told apart by its hash's complement, so that the keys are plain equalities.
        ids = ids.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.when(F.col("doc_id").isNull(), F.bitwise_not("h1")).otherwise(F.col("h1")).alias(h1), F.col("h2").alias(h2))
        return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, [i, h1, h2], how)

    kept = joined(keyed, goes, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    return joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates([i, h1, h2])).select(*docs.columns)
