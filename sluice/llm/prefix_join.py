"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every window of ``window`` consecutive item words is a set of positioned shingles
(three words each, fewer in shorter items). A document holds the window only if
it holds all of them, so for containment the necessary prefix is one shingle: the
rarest in the corpus. Documents are joined with those shingles alone; length and
position bounds drop what can't fit, and the words at each place left are compared
with the whole window.

All texts are cut into words once. One row per word position meets the benchmark's
shingles, and what is found goes into a narrow table: document, position, shingle.
Rarity is counted there, over all documents, and the prefix join reads it. Texts are
read again only where a window may lie. The first pass folds case as a superset of
the exact rule (all letters, not A-Z only), so that it loses nothing; the last
comparison uses the exact words.

Scale: up to ``broadcast`` distinct shingles are a hash table in the scan's stage
(one long each), so no row leaves a document before it is found. More are joined by
a shuffle of (shingle, position) rows, with the same results and no text in it.
Only shingle lengths that the benchmark has are looked for. Hits are rows, merged to
runs in a window over one document's hits, which spills; no row holds a document's
finds.

Defined cases: null or wordless texts have no words and no hits; items without
words have no windows; equal items count each, under one window; items of null id
count as one item, which the list of ids does not name; repeated rows of
``documents`` come back as often as they came; an empty benchmark hits nothing;
extra columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
#: Distinct shingles, windows and documents that are broadcast, each counted first.
BROADCAST = 5_000_000
BROADCAST_WINDOWS, BROADCAST_TEXTS = 200_000, 2_000_000
DOC = ("doc_id", "th", "size")


def _words(text: Column) -> Column:
    """What lies between separators; splitting is several times faster here than matching words."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def exact_words(text: str) -> Column:
    return _words(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER))


def folded_words(text: str) -> Column:
    """Words at the same positions, folded further: equal exact words are equal here too.

    Capital sigma is replaced first, as its lower case depends on what stands beside it.
    """
    return _words(F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("Σ"), F.lit("σ"))))


def _shingle(words: str, at: str, k: int) -> str:
    """SQL: the hash of the k words from a position on, null where fewer are left."""
    return f"CASE WHEN {at} <= size({words}) - {k} THEN xxhash64({', '.join(f'{words}[{at} + {j}]' for j in range(k))}) END"


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    """The join of the documents of two tables, aliased a and b, null ids included."""
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in DOC])


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows with the items they come from: words, folded, len, k (words of a shingle), items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), exact_words("text").alias("w"), folded_words("text").alias("f")).where("size(w) > 0")
    return (
        items.select("item", "w", "f", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("s"))
        .select("item", F.slice("w", F.col("s") + 1, window).alias("words"), F.slice("f", F.col("s") + 1, window).alias("folded"))
        .groupBy("words", "folded").agg(F.collect_set(F.struct("item")).alias("items"))
        .withColumn("len", F.size("words")).withColumn("k", F.least(F.col("len"), F.lit(SHINGLE)))
    )


def window_shingles(wins: DataFrame) -> DataFrame:
    """Every window under each of its shingles: words, len, items, k, offset, hash."""
    at = wins.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))))
    picked = reduce(lambda c, k: c.when(F.col("k") == k, F.expr(_shingle("folded", "offset", k))), range(1, SHINGLE + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    return at.select("words", "len", "items", "k", "offset", picked.alias("hash"))


def found_shingles(docs: DataFrame, shingles: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The benchmark's shingles in every whole text: doc_id, th, size, n_words, pos, hash; and one row per document with null hash."""
    lengths = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # SHINGLE at most
    tokens = shingles.select("hash").distinct().withColumn("known", F.lit(True))
    small = tokens.count() <= broadcast
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"), folded_words("text").alias("f"))
    # explode_outer, as for explode the optimiser pushes a filter on the array's size below, where it makes all words anew.
    at = texts.select(*DOC, "f", F.explode_outer(F.expr("sequence(0, size(f))")).alias("pos"))
    n_words = F.size("f").alias("n_words")
    hashes = [F.expr(_shingle("f", "pos", k)) for k in lengths]
    if len(hashes) > 1:
        rows = at.select(*DOC, n_words, "pos", F.explode_outer(F.array(*hashes)).alias("hash"))
        # The row after the last word stands for the document; of its lengths' null hashes one is enough.
        rows = rows.where("hash IS NOT NULL").unionByName(_documents(docs))
    else:
        rows = at.select(*DOC, n_words, "pos", (hashes[0] if hashes else F.lit(None).cast("long")).alias("hash")).where("hash IS NOT NULL OR pos = n_words")
    if small:
        told = rows.join(F.broadcast(tokens), "hash", "left").where("known OR pos = n_words")
        return told.select(*DOC, "n_words", "pos", F.when(F.col("known"), F.col("hash")).alias("hash"))
    found = rows.where("hash IS NOT NULL").join(tokens, "hash", "left_semi").select(*DOC, "n_words", "pos", "hash")
    return found.unionByName(_documents(docs))


def _documents(docs: DataFrame) -> DataFrame:
    """One row per document, with null hash."""
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"), F.size(folded_words("text")).alias("n_words"))
    return words.select(*DOC, "n_words", F.col("n_words").alias("pos"), F.lit(None).cast("long").alias("hash"))


def prefixes(shingles: DataFrame, finds: DataFrame) -> DataFrame:
    """Each window under its rarest shingle: hash, offset, words, len, items."""
    counts = finds.where("hash IS NOT NULL").groupBy("hash").count()
    ranked = shingles.join(counts, "hash", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    rarest = ranked.groupBy("words").agg(F.min(F.struct("n", "offset", "hash", "len")).alias("x"), F.first("items").alias("items"))
    return rarest.select("x.hash", "x.offset", "words", "x.len", "items")


def contained_windows(docs: DataFrame, finds: DataFrame, prefix: DataFrame) -> DataFrame:
    """Every occurrence of a window in a distinct (doc_id, text): doc_id, th, size, start, len, items."""
    near = F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix
    start = F.col("pos") - F.col("offset")
    places = finds.where("hash IS NOT NULL").join(near, "hash").withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    places = cut(places.select(*DOC, "start", "len", "words", "items"), "places")
    wanted = places.select(*DOC).distinct()
    few = wanted.count() <= BROADCAST_TEXTS
    a = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"), "text").alias("a")
    b = (F.broadcast(wanted) if few else wanted).alias("b")
    texts = a.join(b, _same_document(a, b), "left_semi").groupBy(*DOC).agg(F.first("text").alias("text")).withColumn("w", exact_words("text")).drop("text")
    p, t = places.dropDuplicates([*DOC, "start", "words"]).alias("a"), texts.alias("b")
    met = p.join(t, _same_document(p, t)).where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("words"))
    return met.select("a.*").drop("words")


def _runs(hits: DataFrame) -> DataFrame:
    """Hits of a document that overlap or touch, as runs: doc_id, th, size, start, len."""
    order = Window.partitionBy(*DOC).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    gap = F.col("start") > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = hits.withColumn("gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*DOC, "run").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("len")).drop("run")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, the spans of hit words, and the text's hash and size.

    Contaminated: at least one word in ``share`` lies in an occurrence of a window.
    """
    shingles = cut(window_shingles(windows(benchmark, window)), "shingles")
    finds = cut(found_shingles(docs, shingles, broadcast), "finds")
    hits = cut(contained_windows(docs, finds, cut(prefixes(shingles, finds), "prefixes")), "hits")
    spans = _runs(hits).groupBy(*DOC).agg(F.sum("len").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "len"))).alias("spans"))
    items = hits.select(*DOC, F.explode("items").alias("i")).select(*DOC, "i.item").distinct()
    items = items.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    a, b = spans.alias("a"), items.alias("b")
    told = a.join(b, _same_document(a, b)).select("a.*", "b.n_items", "b.ids")
    a, b = finds.where("hash IS NULL").alias("a"), told.alias("b")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return a.join(b, _same_document(a, b), "left").select(
        "a.doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "a.th", "a.size",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """The documents that are not contaminated. What is judged is the text, so equal texts go together."""
    th, size = fresh(docs.columns, "_th"), fresh(docs.columns, "_size")
    bad = decontaminate(docs, benchmark, window, share, broadcast).where("contaminated").select(F.col("th").alias(th), F.col("size").alias(size)).distinct()
    bad = cut(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_TEXTS else bad
    return docs.withColumns({th: F.xxhash64("text"), size: F.coalesce(F.octet_length("text"), F.lit(-1))}).join(bad, [th, size], "left_anti").select(*docs.columns)
