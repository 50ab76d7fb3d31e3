"""The operators over their whole tables, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_norms, capture_index, gear_chunks, langid_crf, prefix_join, probminhash, robust_outliers, sum_squares, temporal_list, token_rollup, virtual_slots, waterfill, word_tries
from .common import cut, new_path


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid_crf.train(langid_crf.training_rows(docs))
    found = langid_crf.identify(docs, model, ("doc_id",))
    return found.select("doc_id", langid_crf.held_out().alias("held_out"), "lang_pred", "score")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = robust_outliers.text_counts(_read(spark, sf_dir, "documents"))
    return robust_outliers.reject_outliers(counts).select("doc_id", *robust_outliers.COUNTS, "base_failed", "kept", "distance")


def op3_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture_index.archive_round_trip(_read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "key")


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_class_id")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches (all documents; a tenth deleted; a tenth revised), each sent twice, a compaction between."""
    docs = _read(spark, sf_dir, "documents")
    revised = docs.where("doc_id % 10 = 7").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    count = {"byte_bpe_50k": token_rollup.count_tokens, "words": token_rollup.count_words}
    old = {k: cut(f(docs), "tokens") for k, f in count.items()}
    first, second, third = [], [], []
    for k, f in count.items():
        first.append(token_rollup.inserts(old[k], k))
        second.append(token_rollup.deletes(old[k].where("doc_id % 10 = 3"), k))
        third.append(token_rollup.revisions(old[k].where("doc_id % 10 = 7"), f(revised), k))
    rollup = token_rollup.Rollup(spark, new_path(spark, "rollup"))
    for i, (a, b) in enumerate((first, second, third)):
        rollup.commit(f"batch-{i}", a.unionByName(b))
        rollup.commit(f"batch-{i}", a.unionByName(b))
        if i == 1:
            rollup.compact()
    return rollup.totals()


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = virtual_slots.shard_documents(_read(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def url_list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts: a third of the domains and a sixth of the hosts, added,
    removed and added again on days that follow from a digest of their names."""
    host = temporal_list.url_host("url")
    domain = F.regexp_extract(F.col("host"), r"[^.]+\.[^.]+$", 0)
    hosts = pages.select(host.alias("host")).where("host IS NOT NULL").distinct()
    names = hosts.select(F.lit("domain").alias("kind"), domain.alias("pattern")).where("pattern <> ''").distinct().unionByName(hosts.select(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    digit = lambda i: F.ascii(F.substring("m", i, 1))
    start = F.date_add(F.to_date(F.lit("2024-01-01")), digit(2) * 3 - 144)
    chosen = names.withColumn("m", F.md5("pattern")).where(((F.col("kind") == "domain") & (digit(1) % 3 == 0)) | ((F.col("kind") == "host") & (digit(1) % 6 == 1)))
    base = chosen.withColumn("list", F.when(digit(3) % 2 == 0, "ads").otherwise("malware")).withColumn("start", start)
    rows = F.array(
        F.struct(F.lit("add").alias("action"), F.col("start").alias("effective"), F.lit(1).alias("seq")),
        F.struct(F.lit("remove").alias("action"), F.date_add("start", 30 + digit(4) % 40).alias("effective"), F.lit(2).alias("seq")),
        F.struct(F.lit("add").alias("action"), F.date_add("start", 100 + digit(5)).alias("effective"), F.lit(3).alias("seq")),
    )
    return base.select("list", "kind", "pattern", F.explode(rows).alias("e")).select("list", "kind", "pattern", "e.*")


def op7_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url")
    captures = pages.withColumn("fetch_date", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 365).cast("int")))
    judged = temporal_list.judge(captures, url_list_entries(pages))
    first = F.get("matches", 0)
    return judged.select(
        "page_id", "host", "fetch_date", "blocked", F.size("matches").cast("long").alias("n_matches"),
        first["list"].alias("list"), first["pattern"].alias("pattern"), first["since"].alias("since"), first["until"].alias("until"),
    )


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.repeated_spans(_read(spark, sf_dir, "documents"))


def op9_waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfill.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_join.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_sum_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sum_squares.pieces(_read(spark, sf_dir, "documents"), f"{token_rollup.TOKENIZERS}/byte_bpe_50k.json")
    return sum_squares.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_norms.cluster(_read(spark, sf_dir, "embeddings"))[0]


def op13_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tries.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_langid_crf, op2_robust_outliers, op3_capture_index, op4_probminhash, op5_token_rollup, op6_virtual_slots, op7_temporal_list, op8_gear_chunks, op9_waterfill, op10_prefix_join, op11_sum_squares, op12_block_norms, op13_word_tries)}

_WATERFILL_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('sluice-mix:' || doc_id) AS ord FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sums
), weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS sharing FROM weighted
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= rest * weight / sharing THEN cap::DOUBLE
    ELSE (max(CASE WHEN cap > rest * weight / sharing THEN rest / sharing END) OVER ()) * weight END AS target FROM level
), joined AS (
  SELECT d.doc_id, d.size, d.ord, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM joined
"""

_PREFIX_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), spots AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (SELECT rid, item_id, i, spots.n FROM spots JOIN wins ON spots.n = wins.n AND spots.s = wins.s
), words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

_TEMPORAL_SQL = r"""
WITH caps AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '\.+$', ''), '') AS host,
    DATE '2024-01-01' + (page_id % 365)::INT AS fetch_date FROM pages
), hosts AS (SELECT DISTINCT host FROM caps WHERE host IS NOT NULL
), names AS (
  SELECT DISTINCT 'domain' AS kind, regexp_extract(host, '[^.]+\.[^.]+$', 0) AS pattern FROM hosts WHERE regexp_extract(host, '[^.]+\.[^.]+$', 0) <> ''
  UNION ALL SELECT 'host', host FROM hosts
), chosen AS (
  SELECT *, CASE WHEN ascii(m[3]) % 2 = 0 THEN 'ads' ELSE 'malware' END AS list, DATE '2024-01-01' + (ascii(m[2]) * 3 - 144) AS start
  FROM (SELECT *, md5(pattern) AS m FROM names) WHERE (kind = 'domain' AND ascii(m[1]) % 3 = 0) OR (kind = 'host' AND ascii(m[1]) % 6 = 1)
), entries AS (
  SELECT list, kind, pattern, 'add' AS action, start AS effective, 1 AS seq FROM chosen
  UNION ALL SELECT list, kind, pattern, 'remove', start + (30 + ascii(m[4]) % 40), 2 FROM chosen
  UNION ALL SELECT list, kind, pattern, 'add', start + (100 + ascii(m[5])), 3 FROM chosen
), spans AS (
  SELECT list, kind, pattern, action, effective AS since, lead(effective) OVER (PARTITION BY list, kind, pattern ORDER BY effective, seq) AS until FROM entries
), met AS (
  SELECT page_id, list, kind, pattern, since, until FROM caps JOIN spans ON action = 'add' AND since <= fetch_date AND (until IS NULL OR fetch_date < until)
    AND (pattern = host OR (kind = 'domain' AND ends_with(host, '.' || pattern)))
), firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY list, kind, pattern, since) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM met)
SELECT c.page_id, c.host, c.fetch_date, f.page_id IS NOT NULL AS blocked, coalesce(f.n, 0)::BIGINT AS n_matches, f.list, f.pattern, f.since, f.until
FROM caps c LEFT JOIN firsts f ON c.page_id = f.page_id AND f.r = 1
"""

_ROUND_SQL = """far{i} AS (
  SELECT v.n, v.vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{i} AS c
), near{i} AS (SELECT * FROM far{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1
)"""
_MOVE_SQL = """, mean{i} AS (SELECT cluster, list(m ORDER BY d) AS q FROM (SELECT cluster, d, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT cluster, d, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS d FROM near{i}) GROUP BY cluster, d)) GROUP BY cluster
), c{j} AS (SELECT cluster, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN mean{i} AS m USING (cluster)
)"""
_CLUSTER_SQL = (
    """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS cluster, q FROM v QUALIFY cluster < 16
), """
    + ", ".join(_ROUND_SQL.format(i=i) + _MOVE_SQL.format(i=i, j=i + 1) for i in range(3))
    + ", " + _ROUND_SQL.format(i=3)
    + """ SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256 FROM near3 JOIN c3 USING (cluster)"""
)

_TRIE_SQL = r"""
WITH RECURSIVE step AS (SELECT i AS b, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS tab FROM step WHERE k = 8
), texts AS (SELECT row_number() OVER () AS n, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark
), split AS (SELECT n, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), words AS (SELECT n, own, w, count(*) AS times FROM (SELECT n, own, unnest(w) AS w FROM split) GROUP BY ALL
), hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(0, 2 * strlen(w), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)), crc
), counted AS (SELECT bucket, coalesce(sum(times) FILTER (own), 0) AS s, coalesce(sum(times) FILTER (NOT own), 0) AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(t_s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t_t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted, (SELECT sum(s) AS t_s, sum(t) AS t_t FROM counted) GROUP BY bucket, s, t
), weights AS (SELECT n, sum(times * gain) AS total, sum(times) AS features FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY n
), scored AS (
  SELECT n, doc_id, len(w) AS n_words, coalesce(features, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / features), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM split LEFT JOIN weights USING (n) WHERE own
), drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM scored
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""

ORACLE_SQL = {"op7_temporal_list": _TEMPORAL_SQL, "op9_waterfill": _WATERFILL_SQL, "op10_prefix_join": _PREFIX_SQL, "op12_block_norms": _CLUSTER_SQL, "op13_word_tries": _TRIE_SQL}
