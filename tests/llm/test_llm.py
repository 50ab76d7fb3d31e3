import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import capture_index, common, gear_chunks, langid_crf, prefix_join, probminhash, queries, robust_outliers, temporal_list, token_rollup, virtual_slots, waterfill

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 3), (4, "#### 123", "en", "a", 8), (5, LONG, "fr", "b", 9), (5, LONG, "fr", "b", 9), (None, "x y z", "en", "b", 5), (7, "Ünïcode ΣΑΣ word\r\nword", "fr", "c", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 8)} if len(runs) < 1500 else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_text_counts(spark, docs, odd):
    for df in (docs.where("n_chars < 6000"), odd):
        texts = [r["text"] for r in df.collect()]
        got = robust_outliers.text_counts(df).collect()
        assert sorted(tuple(r[c] for c in robust_outliers.COUNTS) for r in got) == sorted(map(plain_counts, texts))


def test_mcd_finds_planted_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [("g", *map(float, rng.normal(0, 1, 4))) for _ in range(900)] + [("g", *map(float, rng.normal(9, 1, 4))) for _ in range(100)]
    centre = robust_outliers.mcd(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")).first()
    assert np.abs(np.array(centre["m"])).max() < 0.25
    spread = 1 / np.diag(np.array(centre["inv"]).reshape(4, 4))
    assert (spread > 0.6).all() and (spread < 1.6).all()


def test_a_third_of_a_source_as_junk_is_rejected(spark):
    rng = np.random.default_rng(2)
    rows = []
    for source, level in (("a", 0.6), ("b", 1.0), ("c", 2.0)):
        for i in range(1200):
            n, junk = int(rng.integers(60, 400)), i % 3 == 0
            rows.append((source, junk, n, int(n * rng.normal(5, 0.15)), int(n * (level * rng.uniform(0.95, 1.05) if junk else rng.choice([0, 0, 0.01]))), 0, 0))
    counts = spark.createDataFrame(rows, "source string, junk boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = robust_outliers.reject_outliers(counts.withColumn("lang", F.lit("en"))).groupBy("source", "junk").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert len(got) == 6 and all(share == 0 if junk else share >= 0.999 for _, junk, share in got), got


def test_mcd_keeps_the_smallest_determinant(spark):
    """Two fifths of the rows in a tight clump: the clean majority's estimate, not one that bridges both."""
    rng = np.random.default_rng(4)
    mix = np.linalg.cholesky(0.9 * np.ones((4, 4)) + 0.1 * np.eye(4))
    rows = [("g", *map(float, mix @ rng.normal(0, 1, 4))) for _ in range(600)] + [("g", *map(float, [3, -3, 3, -3] + rng.normal(0, 0.3, 4))) for _ in range(400)]
    got = robust_outliers.mcd(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")).collect()
    assert len(got) == 1 and np.abs(np.array(got[0]["m"])).max() < 0.3


def test_outliers_keep_plain_documents(spark, docs, odd):
    got = robust_outliers.reject_outliers(robust_outliers.text_counts(docs))
    r = got.agg(F.count("*").alias("n"), F.count_if(F.expr("base_failed AND kept")).alias("bad"), F.count_if(F.expr("n_symbols = 0 AND NOT base_failed AND NOT kept AND n_repeat_words = 0 AND n_dup_lines = 0")).alias("lost")).first()
    assert (r["n"], r["bad"], r["lost"]) == (docs.count(), 0, 0)
    assert robust_outliers.reject_outliers(robust_outliers.text_counts(odd)).count() == len(ODD)
    assert robust_outliers.reject_outliers(robust_outliers.text_counts(odd.limit(0))).count() == 0


def test_language_held_out_accuracy(spark, docs, odd):
    model = langid_crf.train(langid_crf.training_rows(docs))
    got = langid_crf.identify(docs, model, ("doc_id", "lang")).where(langid_crf.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95
    told = {r["text"]: (r["lang_pred"], r["score"]) for r in langid_crf.identify(odd, model, ("doc_id", "text")).collect()}
    assert told[None] == told[""] == told["#### 123"] == ("und", 0.0) and 0 < told[LONG][1] <= 1
    assert langid_crf.identify(odd, langid_crf.train([])).where("lang_pred <> 'und'").count() == 0
    assert langid_crf.training_rows(odd.limit(0)) == []


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    scores, t = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    post = langid_crf.forward_backward(scores, np.array([0]), np.array([4]), t)[0]
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(post, want / want.sum(axis=1, keepdims=True))


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://b.example.org/x", "<p>é</p>"), (2, "http://a.example.org/", "<p>é</p>"), (3, None, None), (4, "http://a.example.org/?q=1 2", ""), (None, "nohost", "z"), (5, "http://a.example.org/", "y"), (5, "http://a.example.org/", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    captures = capture_index.write_archives(pages, f"{path}/archive")
    shards = capture_index.build_index(captures, f"{path}/index", block_lines=2)
    wanted = pages.select(F.col("page_id").alias("id"), capture_index.url_key("url").alias("key"))
    got = capture_index.look_up(wanted, shards, f"{path}/index", f"{path}/archive", True).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    told = sorted((str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    to = {1: 2, 3: 4}
    assert told == sorted((str(i), len((h or "").encode()), digest(h), "revisit" if i in to else "response", to.get(i)) for i, _, h in rows)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w/archive").iterdir())
    n = 0
    while raw:  # every record is a gzip member of its own
        d = zlib.decompressobj(31)
        assert d.decompress(raw).startswith(b"WARC/1.1\r\n")
        raw, n = d.unused_data, n + 1
    assert n == len(rows)
    missing = spark.createDataFrame([(9, "org,example,zzz)/")], "id long, key string")
    assert capture_index.look_up(missing, shards, f"{path}/index", f"{path}/archive").count() == 0
    assert capture_index.archive_round_trip(pages.limit(0), path=f"{tmp_path}/none").count() == 0


def plain_similarity(a, b):
    def bag(t):
        w = t.split()
        out = {}
        for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]:
            out[s] = out.get(s, 0) + 1
        return out

    x, y = bag(a), bag(b)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())


def test_exact_similarity_against_the_definition():
    a, b = "a b c d e f g h i j a b c d e f g", "a b c d e f g h i j k a b c d e f z"
    assert abs(probminhash.exact_similarity(probminhash.bag(a), probminhash.bag(b)) - plain_similarity(a, b)) < 1e-12


def test_register_agreement_estimates_similarity():
    base = [f"t{i}" for i in range(400)]
    a, b = " ".join(base), " ".join(base[:330] + [f"u{i}" for i in range(70)])
    out = []
    for t in (a, b):
        k, w = probminhash.bag(t)
        out.append(probminhash.signatures(k, np.zeros(len(k), np.int64), w, 1, 4000)[0])
    assert abs((out[0] == out[1]).mean() - plain_similarity(a, b)) < 0.04


def test_near_duplicates_against_brute_force(spark, odd):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in rng.integers(0, 500, 120)]
        for _ in range(12):
            t = list(base)
            for i in rng.integers(0, 120, rng.integers(0, 7)):
                t[i] = f"n{rng.integers(1e9)}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[0], "one two", "one two", "", ""]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if a == texts[j] or a and texts[j] and plain_similarity(a, texts[j]) >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    classes = probminhash.near_duplicates(odd)
    assert classes.count() == len(ODD)
    assert sorted(str(r["doc_id"]) for r in probminhash.keep_one(odd, classes).collect()) == sorted(["1", "2", "3", "4", "5", "7", "None"])
    assert probminhash.near_duplicates(odd.limit(0)).count() == 0


def test_rollup_commits_once(spark, odd, tmp_path):
    counts = token_rollup.count_tokens(odd)
    encoder = token_rollup.encoder(*token_rollup.load_vocabulary(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    assert sorted(r["tokens"] for r in counts.collect()) == sorted(len(encoder.encode_ordinary(t[1] or "")) for t in ODD)
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    all_in = token_rollup.inserts(counts, "v1")
    assert [r.commit("a", all_in), r.commit("a", all_in)] == [True, False]
    before = {tuple(x) for x in r.totals().collect()}
    assert r.commit("b", token_rollup.deletes(counts.where("doc_id = 5"), "v1"))
    r.compact()
    assert not r.commit("b", all_in)
    assert r.commit("c", token_rollup.inserts(counts.where("doc_id = 5"), "v1")) and {tuple(x) for x in r.totals().collect()} == before


def test_slots(spark, docs, odd):
    for df in (docs, odd):
        rows = virtual_slots.shard_documents(df, 8).collect()
        assert len(rows) == df.count()
        for shard in range(8):
            at = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert at == list(range(len(at)))
        assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((r["text"] or "").encode()) for r in df.collect())
    size = [sum(r["size"] for r in virtual_slots.shard_documents(docs, 8).collect() if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) < 0.02 * sum(size)
    loads = [(i, 100 + i % 7, 1) for i in range(4096)]
    old = virtual_slots.plan_map(loads, 8)
    new = virtual_slots.rebalance(old, loads, 9)
    moved = [s for s in old if old[s] != new[s]]
    assert moved and all(new[s] == 8 for s in moved) and len(moved) < 4096 / 8
    assert virtual_slots.shard_documents(odd.limit(0), 8).count() == 0
    named = virtual_slots.shard_documents(odd.withColumn("Slot", F.lit("x")).withColumn("size", F.lit("y")), 8, keep=("Slot", "size"))
    assert {(r["Slot_in"], r["size_in"]) for r in named.collect()} == {("x", "y")} and named.select("size", "slot").dtypes == [("size", "bigint"), ("slot", "bigint")]


def test_temporal_list(spark):
    d = lambda s: __import__("datetime").date.fromisoformat(s)
    caps = spark.createDataFrame([(1, "http://x.a.org/p", d("2024-01-05")), (2, "http://a.org/", d("2024-02-05")), (3, "http://b.org/q/#f", d("2024-01-01")), (4, None, d("2024-01-05")), (5, "http://a.org/", None), (6, "http://A.ORG./", d("2024-01-10"))], "page_id int, url string, fetch_date date")
    entries = spark.createDataFrame([("l", "domain", "a.org", "add", d("2024-01-02"), 1), ("l", "domain", "a.org", "add", d("2024-01-03"), 1), ("l", "domain", "a.org", "remove", d("2024-01-10"), 1), ("l", "url", "b.org/q", "add", d("2024-01-01"), 1), ("l", "host", "a.org", "add", d("2024-02-01"), 1), ("l", "host", "a.org", "remove", d("2024-02-01"), 2), ("l", "host", None, "add", d("2024-01-01"), 1)], "list string, kind string, pattern string, action string, effective date, seq int")
    assert {r["page_id"]: r["blocked"] for r in temporal_list.judge(caps, entries).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert temporal_list.judge(caps, entries.limit(0)).where("blocked").count() == 0
    named = temporal_list.judge(caps.withColumn("host", F.lit("x")).withColumnRenamed("url", "matches"), entries, url="matches").collect()
    assert {r["host_in"] for r in named} == {"x"} and {r["page_id"] for r in named if r["blocked"]} == {1, 3}


def test_chunks_resist_shifts_and_find_passages(spark, odd):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage = say(55)
    rows = [(i, f"{say(80)} {passage if i % 4 == 0 else say(55)} {say(60)}", "en", "s", 0) for i in range(40)]
    spans = gear_chunks.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in spans} == {i for i in range(40) if i % 4 == 0}
    assert {r["keeper_doc_id"] for r in spans} == {0} and {r["doc_id"] for r in spans if not r["removed"]} == {0}
    data = np.frombuffer(say(4000).encode(), np.uint8)
    a, b = gear_chunks.boundaries(data), gear_chunks.boundaries(np.concatenate([data[:7000], data[:13], data[7000:]]))
    assert len({*a[a > 7100].tolist()} - {x - 13 for x in b.tolist()}) == 0 and (np.diff(a) > gear_chunks.REACH).all()
    # A text's chunks are its own, whatever texts lie beside it.
    both, at = np.concatenate([data[500:900], data[:7000], data[3:77]]), np.array([0, 400, 7400, 7474], np.int64)
    own = gear_chunks.boundaries(both, at)
    assert (own[(own > 400) & (own <= 7400)] - 400).tolist() == gear_chunks.boundaries(data[:7000]).tolist()
    same = np.full(300, 97, np.uint8)
    assert gear_chunks.boundaries(np.concatenate([data[:50], same]), np.array([0, 50, 350], np.int64)).tolist() == (gear_chunks.boundaries(same) + 50).tolist()
    plain = gear_chunks._GEAR_VALUE.astype(object)
    h = gear_chunks.gear_hashes(data[:100])
    assert h[60] == sum(int(plain[data[60 - j]]) << j for j in range(gear_chunks.GEAR)) % (1 << 32)
    assert gear_chunks.repeated_spans(odd).count() == 0 and gear_chunks.repeated_spans(odd.limit(0)).count() == 0


def test_passages_are_whole_and_from_50_words_on(spark):
    """Short words: a passage of 60 has few chunks, one of 49 may have as many; each span is the passage and no word more."""
    rng = np.random.default_rng(11)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(n))
    rows, want = [], {}
    for p in range(60):
        n = 49 if p % 3 == 0 else 60
        passage = say(n)
        for k in range(2):
            before = f"{say(40)} {'<>'[k]} "
            rows.append((2 * p + k, f"{before}{passage} {'<>'[k]} {say(40)}", "en", "s", 0))
            if n == 60:
                want[2 * p + k] = (len(before), len(passage), 60, 2 * p, k == 1)
    got = gear_chunks.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["start"], r["length"], r["n_words"], r["keeper_doc_id"], r["removed"]) for r in got} == want and len(got) == len(want)


def test_every_passage_stays_in_one_document(spark):
    rng = np.random.default_rng(12)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    one, two = say(60), say(60)
    docs = spark.createDataFrame([(1, f"{say(30)} {one} {say(30)}"), (5, f"{say(30)} {one} {two} {say(30)}"), (7, f"{say(30)} {one} {two} {say(30)}"), (9, f"{say(30)} {two} {say(30)}")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in gear_chunks.remove_spans(docs, gear_chunks.repeated_spans(docs)).collect()}
    assert [i for i in left if one in left[i]] == [1] and [i for i in left if two in left[i]] == [5]


def test_spans_cover_what_brute_force_finds(spark):
    """Words of all spans against words of all 50-word runs that stand in another document, with nested and whole copies."""
    rng = np.random.default_rng(21)
    say = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n)]
    shared = [say(300) for _ in range(4)]
    texts = {}
    for i in range(30):
        words = say(int(rng.integers(20, 60)))
        for k in rng.permutation(4)[: int(rng.integers(0, 4))]:
            first, last = sorted(rng.choice(range(0, 301, 60), 2, replace=False).tolist())
            words += shared[k][first:last] + say(int(rng.integers(5, 40)))
        texts[i] = words
    texts[30], texts[31], texts[32] = texts[3], say(3000), say(10)
    texts[33] = texts[31][:1500] + say(30) + texts[31][1500:]
    runs = {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            runs.setdefault(tuple(w[j : j + 50]), set()).add(i)
    want = {(i, j + k) for i, w in texts.items() for j in range(len(w) - 49) if len(runs[tuple(w[j : j + 50])]) > 1 for k in range(50)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got, sizes = set(), []
    for r in gear_chunks.repeated_spans(df).collect():
        text = " ".join(texts[r["doc_id"]])
        at, span = len(text[: r["start"]].split()), text[r["start"] : r["start"] + r["length"]]
        sizes.append(r["n_words"] == len(span.split()) and span == span.strip())
        got |= {(r["doc_id"], at + k) for k in range(r["n_words"])}
    assert got == want and all(sizes)


def test_spans_of_odd_rows(spark):
    """Several texts under one doc_id, equal rows, clashing columns, long runs of one byte and one of 300,000 words."""
    rng = np.random.default_rng(22)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    p, q, long = say(60), say(60), say(300_000)
    rows = [(1, f"{say(20)} {p} {say(20)}"), (5, f"{say(9)} {p} {say(9)}"), (5, f"{say(30)} {q}"), (7, q), (7, q), (8, "a" * 5000), (9, "b" + "a" * 5000), (None, p), (10, None), (11, long), (12, f"x {long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "start", "hi", "_gone", "text_hash", "removed")})
    spans = gear_chunks.repeated_spans(df)
    got = sorted((r["doc_id"], r["n_words"], r["removed"], r["text_hash"] != 0) for r in spans.collect())
    assert got == [(1, 60, False, False), (5, 60, False, True), (5, 60, True, True), (7, 60, True, False), (11, 300_000, False, False), (12, 300_000, True, False)]
    left = gear_chunks.remove_spans(df, spans)
    assert left.columns == df.columns and left.count() == len(rows)
    texts = [r["text"] or "" for r in left.collect()]
    assert sum(p in t for t in texts) == 2 and sum(q in t for t in texts) == 1 and sum(long in t for t in texts) == 1


def test_waterfill(spark, odd):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 4}" if i % 4 else None, 0) for i in range(400)] + [(999, "a b", "en", "tiny", 2)]
    df = spark.createDataFrame(rows, DOCS)
    got = waterfill.mix(df).collect()
    assert len(got) == 401 and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    assert abs(sum(v[0] for v in by.values()) - sum(v[1] for v in by.values())) < 1e-6 and by["tiny"][0] == 6.0
    assert all(abs(v[0] - v[2]) <= 5 for v in by.values())
    again = waterfill.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert waterfill.mixture(df).count() == sum(r["repeats"] for r in got)
    assert waterfill.mix(odd).count() == len(ODD) and waterfill.mix(odd.limit(0)).count() == 0


def test_prefix_join_both_ways(spark, sf, docs, odd):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(str, prefix_join.decontaminate(docs, bench).drop("spans").collect()))
    assert one == sorted(map(str, prefix_join.decontaminate(docs, bench, broadcast=0).drop("spans").collect()))
    items = spark.createDataFrame([(1, "word WORD"), (2, None), (3, "σας"), (4, "w5 w6"), (4, "w5 w6"), (5, "x y z")], "item_id long, text string")
    got = {str(r["doc_id"]): (r["n_words"], r["n_hit"], r["n_items"]) for r in prefix_join.decontaminate(odd, items).collect()}
    assert got["5"] == (3000, 2, 1) and got["None"] == (3, 3, 1) and got["1"] == got["2"] == (0, 0, 0) and got["7"] == (4, 2, 1)
    assert prefix_join.decontaminate(odd, items).count() == len(ODD)
    assert prefix_join.decontaminate(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert prefix_join.decontaminate(odd.limit(0), items).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table().to_pandas(date_as_object=True)
    line = lambda df: sorted(tuple(None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    key = lambda rows: sorted(map(str, rows))
    assert key(line(got)) == key(line(want))


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.cut(stage(spark, kept, sf), f"test-{name}")
        assert kept.columns == docs.columns
        if name in ("language", "near_duplicates", "decontamination"):
            assert 0 < kept.count() <= before.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert placed.count() == kept.count()


CLASHES = ("lang_pred", "score", "spoken", "class_id", "rid", "h1", "label", "_th", "th", "size", "ord", "target", "whole", "extra", "repeats", "row", "_times", "slot", "shard", "vslot", "key", "count")


def test_pipeline_stages_take_odd_rows_and_any_columns(spark, sf, docs, odd):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables pass every stage."""
    import corpus_pipeline

    known = docs.where("lang IS NOT NULL").limit(60)
    rows = known.unionByName(odd).withColumns({c: F.lit(f"v-{c}") for c in CLASHES})
    for table in (rows, rows.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = common.cut(stage(spark, kept, sf), f"test-odd-{name}")
            assert kept.columns == rows.columns
            assert kept.where(" OR ".join(f"{c} <> 'v-{c}'" for c in CLASHES)).isEmpty()
        assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() == kept.count()


def test_each_stage_takes_odd_rows(spark, sf, odd):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for name, want in (("near_duplicates", ["1", "2", "3", "4", "5", "7", "None"]), ("decontamination", sorted(str(r[0]) for r in ODD))):
        assert sorted(str(r["doc_id"]) for r in stages[name](spark, odd, sf).collect()) == want
    assert {r["doc_id"] for r in stages["mixing"](spark, odd, sf).collect()} <= {r[0] for r in ODD}
    assert stages["sharding"](spark, odd, sf).count() == len(ODD)
    assert stages["language"](spark, odd.where("doc_id < 5"), sf).where("text IS NULL OR NOT text RLIKE '[a-z]'").isEmpty()


def test_one_of_each_class_stays_but_no_text_goes_for_its_id_alone(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "z"])
    other = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(3, " ".join(base), "en", "s", 0), (5, " ".join(base), "en", "s", 0), (5, other, "en", "s", 0), (6, near, "en", "s", 0)], DOCS)
    kept = probminhash.keep_one(df, probminhash.near_duplicates(df)).collect()
    assert other in {r["text"] for r in kept} and 3 in {r["doc_id"] for r in kept} and 6 not in {r["doc_id"] for r in kept}


def test_carried_columns_keep_their_values(spark, odd):
    taken = odd.withColumn("tokens", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert {r["tokens_in"] for r in token_rollup.count_words(taken, ("doc_id", "tokens")).collect()} == {"x"}
    assert {r["n_words_in"] for r in robust_outliers.text_counts(taken, ("doc_id", "n_words")).collect()} == {"y"}


def test_no_link_is_lost_for_repeated_ids(spark):
    """Texts are judged, whatever ids they stand under and in whatever order rows come; null ids take part."""
    rng = np.random.default_rng(31)
    base = {k: [f"{k}{i}" for i in range(80)] for k in "abc"}
    text = lambda k, *cuts: " ".join(f"x{i}" if i in cuts else w for i, w in enumerate(base[k]))
    rows = [(5, text("a")), (5, text("b")), (7, text("a", 3)), (9, text("b", 70)), (None, text("c")), (None, text("c", 1)), (None, text("c", 1)), (4, None), (None, None)]
    for _ in range(3):
        df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").repartition(3)
        found = probminhash.near_duplicates(df).collect()
        groups = {}
        for r in found:
            groups.setdefault((r["class_no"], r["class_id"]), []).append(r["doc_id"])
        assert sorted((sorted(map(str, v)), str(k[1])) for k, v in groups.items() if k[0] is not None) == [(["5", "7"], "5"), (["5", "9"], "5"), (["None", "None", "None"], "None")]
        kept = [(r["doc_id"], r["text"]) for r in probminhash.keep_one(df, probminhash.near_duplicates(df)).collect()]
        assert sorted(map(str, kept)) == sorted(map(str, [(5, text("a")), (5, text("b")), (4, None), (None, None), next(x for x in kept if x[0] is None and x[1])]))


def test_sample_is_bounded_at_any_size(spark):
    for wanted, rows in ((360, 10**10), (360, 4 * 10**8), (360, 7), (360, 0), (1, 10**18)):
        share = (langid_crf.hash_limit(wanted, rows) + 2**63) / 2**64
        assert -(2**63) <= langid_crf.hash_limit(wanted, rows) < 2**63 and abs(share * max(rows, 1) - min(wanted, max(rows, 1))) < 0.01 * wanted + 1
    rows = [(i, f"alpha beta {i}", "en", "s", 0) for i in range(500)] + [(3, "same words here", "de", "s", 0)] * 400 + [(i, "x y", f"junk{i}", "s", 0) for i in range(700)]
    got = langid_crf.training_rows(spark.createDataFrame(rows, DOCS), 50, 2, 2)
    by = {}
    for lang, words in got:
        by.setdefault(lang, []).append(words)
        assert len(words) <= 2
    assert set(by) <= {"en", "de"} and len(by["en"]) == 50 and len(by.get("de", [])) <= 1


def test_crf_gradient_against_differences():
    """Posteriors and expected transitions are the derivatives of the log partition, over chains of several lengths."""
    rng = np.random.default_rng(6)
    size = np.array([1, 4, 3])
    first = np.cumsum(size) - size
    later = np.array([i for i in range(8) if i not in first])
    scores, t = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    log_z = lambda s, x: langid_crf.forward_backward(s, first, size, x)[3]
    post, alpha, onward, _ = langid_crf.forward_backward(scores, first, size, t)
    expected = langid_crf.expected_transitions(alpha, onward, later, t)
    for at, grad, which in ((scores, post, 0), (t, expected, 1)):
        for index in np.ndindex(*at.shape):
            step = np.zeros_like(at)
            step[index] = 1e-5
            up, down = (log_z(scores + step, t), log_z(scores - step, t)) if which == 0 else (log_z(scores, t + step), log_z(scores, t - step))
            assert abs((up - down) / 2e-5 - grad[index]) < 1e-6


def _exhaustive(x, h):
    """The MCD of a few rows by all subsets: centre and ridged scatter after the final step, as the operator defines them."""
    from itertools import combinations

    ridge, best = np.diag(np.square(robust_outliers.RIDGE)), None
    scatter = lambda rows, share: np.cov(rows.T, bias=True) * robust_outliers._share_scale(share) + ridge
    for rows in combinations(range(len(x)), h):
        det = np.linalg.slogdet(scatter(x[list(rows)], 0.5))[1]
        if best is None or det < best[0]:
            best = det, rows
    rows = x[list(best[1])]
    d = x - rows.mean(axis=0)
    inner = x[(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter(rows, 0.5)), d)) <= robust_outliers.chi_square_quantile(0.975, 4)]
    return inner.mean(axis=0), np.linalg.inv(scatter(inner, 0.975))


def test_mcd_and_kept_against_all_subsets(spark):
    rng = np.random.default_rng(8)
    rows = [(int(n), int(n * rng.normal(5, 0.1)), 0, 0, 0) for n in rng.integers(60, 200, 10)] + [(int(n), int(n * 5), int(n * rng.uniform(2, 4)), 6, int(0.2 * n)) for n in rng.integers(60, 200, 4)]
    x = np.array([[np.log1p(c / n), np.sqrt(s / n), np.sqrt(d / np.sqrt(n)), np.sqrt(r / n)] for n, c, s, d, r in rows])
    m, inv = _exhaustive(x, 7)
    got = robust_outliers.mcd(spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, x0 double, x1 double, x2 double, x3 double")).first()
    assert np.allclose(got["m"], m, atol=1e-6) and np.allclose(np.array(got["inv"]).reshape(4, 4), inv, rtol=1e-4)
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - m, inv, x - m))
    want = [bool(v <= np.sqrt(robust_outliers.chi_square_quantile(0.9999, 4))) for v in d]
    counts = spark.createDataFrame([(i, "en", "s", *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    judged = robust_outliers.reject_outliers(counts, min_rows=5).orderBy("doc_id").collect()
    assert [r["kept"] for r in judged] == want and np.allclose([r["distance"] for r in judged], d, atol=1e-4) and want == [True] * 10 + [False] * 4


def test_archives_roll_and_keys_span_shards(spark, tmp_path):
    long = "é" * 2_000_000
    rows = [(i, "http://a.example.org/same", f"<p>{i}</p>") for i in range(60)] + [(100, "http://b.example.org/", long), (101, "http://b.example.org/", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("key", "sha", "last", "id", "payload", "refers_to")})
    path = f"file://{tmp_path}/w"
    captures = capture_index.write_archives(pages, f"{path}/archive", roll_bytes=2000)
    assert captures.select("file").distinct().count() > 2
    same = spark.createDataFrame([(7, "org,example,a)/same")] * 1, "id long, key string")
    twice = captures.where("id = 7").unionByName(captures.where("id = 7").withColumn("offset", F.col("offset"))).repartition(2)
    shards = capture_index.build_index(captures.unionByName(twice.limit(1)), f"{path}/index", block_lines=3)
    assert shards.count() > 1 and capture_index.look_up(same, shards, f"{path}/index", f"{path}/archive").count() == 2
    got = capture_index.look_up(pages.select(F.col("page_id").alias("id"), capture_index.url_key("url").alias("key")), shards, f"{path}/index", f"{path}/archive").where("id >= 100").collect()
    assert sorted((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(100, 4_000_000, "revisit", 101), (101, 4_000_000, "response", None)]


def test_paths_follow_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://names:8020")
        assert common.qualified(spark, "/a/b") == "hdfs://names:8020/a/b" and common.qualified(spark, "file:///a") == "file:///a"
    finally:
        conf.set("fs.defaultFS", before)
    assert common.qualified(spark, "/a/b") == "file:///a/b"


def test_rollup_survives_retries_and_compaction(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_rollup.TOTALS)
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    half = tmp_path / "r" / "batches" / token_rollup.folder("../odd id/_x")
    half.mkdir(parents=True)
    rows(99).write.mode("append").parquet(f"file://{half}")
    (half / "_SUCCESS").unlink()  # an attempt that was cut short
    assert r.totals().count() == 0 and r.commit("../odd id/_x", rows(1)) and r.totals().first()["tokens"] == 1
    listing = r._listing()
    assert r.commit("beside", rows(10))  # after the listing, before the sum
    r._fold(*listing)
    assert r.totals().first()["tokens"] == 11 and not r.commit("../odd id/_x", rows(5)) and r.commit("later", rows(100))
    r.compact()
    assert tuple(r.totals().first())[3:] == (3, 111) and sorted(len(x) for x in r._listing()[1:]) == [0, 3]
    with pytest.raises(ValueError):
        r.commit("", rows(1))


def test_rollup_query_against_plain_sums(spark, sf, docs):
    coder = token_rollup.encoder(*token_rollup.load_vocabulary(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = {}
    for r in docs.collect():
        if r["doc_id"] % 10 == 3:
            continue
        text = r["text"] or ""
        if r["doc_id"] % 10 == 7:
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
        for name, count in (("byte_bpe_50k", lambda t: len(coder.encode_ordinary(t))), ("words", words)):
            at = want.setdefault((r["source"], r["lang"], name), [0, 0])
            at[0] += 1
            at[1] += count(text)
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in queries.op5_token_rollup(spark, sf).collect()}
    assert got == want


def test_slots_by_plain_python_and_edited_maps(spark, odd, tmp_path):
    df = spark.createDataFrame([(i, "y" * (i * 37 % 500), "en", "s", 0) for i in range(900)], DOCS).unionByName(odd)
    path = f"file://{tmp_path}/map"
    rows = virtual_slots.shard_documents(df, 8, keep=("text",), n_slots=64, map_path=path).collect()
    maps = [{r["vslot"]: r for r in virtual_slots.read_map(spark, path, v).collect()} for v in (0, 1)]
    assert [m["shard"] for _, m in sorted(maps[0].items())] == [i % 8 for i in range(64)] and {r["map_version"] for r in rows} == {1}
    slots = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["shard"] == maps[1][r["vslot"]]["shard"]
        slots.setdefault(r["vslot"], []).append(r)
    for v, m in maps[1].items():
        own = slots.get(v, [])
        before = sum(len(slots.get(u, [])) for u in range(v) if maps[1][u]["shard"] == m["shard"])
        assert (m["rows"], m["bytes"]) == (len(own), sum(r["size"] for r in own)) and sorted(r["slot"] for r in own) == list(range(before, before + len(own)))
        order = sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text_crc32"], r["size"]))
        assert [r["slot"] for r in order] == sorted(r["slot"] for r in own)
    grown = virtual_slots.rebalance_documents(df, path, 1, 9, n_slots=64).collect()
    maps.append({r["vslot"]: r for r in virtual_slots.read_map(spark, path, 2).collect()})
    moved = {v for v in maps[1] if maps[1][v]["shard"] != maps[2][v]["shard"]}
    assert moved and 8 in {r["shard"] for r in grown if r["vslot"] in moved} and all(r["shard"] == maps[1][r["vslot"]]["shard"] for r in grown if r["vslot"] not in moved)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # a version is never changed
        virtual_slots.rebalance_documents(df, path, 1, 9, n_slots=64)
    virtual_slots.write_shards(virtual_slots.shard_documents(df, 3, keep=("text",)), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == df.count() and {p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(3)}


def test_temporal_list_of_long_and_hot_hosts(spark):
    day = __import__("datetime").date(2024, 1, 5)
    far = ".".join(["a"] * 20_000) + ".bad.org"
    rows = [(i, f"http://h{i % 50 if i % 3 else 0}.bad.org/{i}", day) for i in range(3000)] + [(9000, f"http://{far}/", day), (9001, "http://good.org/", day), (9002, None, day)]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetch_date date").withColumn("n", F.lit("x"))
    entries = spark.createDataFrame([("l", "domain", "bad.org", "add", day, 1), ("l", "host", "h7.bad.org", "add", day, 1), ("m", "url", "good.org", "add", day, 1)], "list string, kind string, pattern string, action string, effective date, seq int")
    one = sorted(map(str, temporal_list.judge(caps, entries).collect()))
    assert one == sorted(map(str, temporal_list.judge(caps, entries, broadcast=0).collect())) and sum("blocked=True" in x for x in one) == 3002 and len(one) == 3003
    assert temporal_list.judge(caps, entries).columns[3] == "n_in"


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = common.cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")), "groups")
    got = common.spread_join(rows, groups, ["k"], ["id"], share=10, least=100)
    assert sorted(map(tuple, got.select("k", "id", "low").collect())) == sorted(map(tuple, rows.join(groups, "k").select("k", "id", "low").collect()))
    assert common.spread_join(rows.limit(0), common.cut(groups.limit(0), "none"), ["k"], ["id"]).count() == 0


def test_water_of_many_sources_and_null_ids(spark):
    rows = [(None if i % 5 == 0 else i, "w " * (1 + i * 7 % 23), "en", f"s{i % 37:02d}" if i % 37 else None, 0) for i in range(800)] + [(5000 + i, "w " * 900, "en", "s03", 0) for i in range(9)]
    base = common.cut(waterfill.sized(spark.createDataFrame(rows, DOCS)), "sizes")
    one, many = (sorted(map(str, waterfill.source_targets(base, single=n).collect())) for n in (100, 0))
    assert one == many and len(one) == 37
    got = waterfill.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    taken = {}
    for r in got:
        at = taken.setdefault(r["source"], [0, r["target"]])
        at[0] += r["taken"]
    assert all(abs(a - b) <= 900 for a, b in taken.values())


def test_windows_of_null_items_and_of_long_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "w " * 100_000), (3, "x y"), (4, "z")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("th", "pos", "hash", "len", "items", "start", "n_words")})
    items = spark.createDataFrame([(None, "b c"), (7, "c d"), (8, "w " * 14), (9, "z")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in prefix_join.decontaminate(docs, items).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (4, 3, 2, sha("7")), 2: (100_000, 100_000, 1, sha("8")), 3: (2, 0, 0, sha("")), 4: (1, 1, 1, sha("9"))}
    kept = prefix_join.clean_documents(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    """Every stage's rows on a small table, each from the stage's own input."""
    import corpus_pipeline

    rng = np.random.default_rng(41)
    lexicon = {lang: [f"{p}{i}" for i in range(300)] for lang, p in (("en", "the"), ("de", "ung"))}
    say = lambda lang, n: [lexicon[lang][i] for i in rng.integers(0, 300, n)]
    items = [(f"i{k}", " ".join(say("en", 30))) for k in range(4)]
    rows = []
    for i in range(60):
        words = say("en" if i % 2 else "de", int(rng.integers(60, 120)))
        if i % 12 == 0:
            words[20:20] = items[i // 12 % 4][1].split()
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}", 0))
    rows += [(100 + i, " ".join([*rows[i][1].split()[:-1], "changed"]), "en", "s1", 0) for i in range(0, 60, 9)] + [(200, rows[5][1], "en", "s2", 0), (201, None, "en", "s1", 0), (202, "12 34", "en", "s1", 0), (203, "", None, None, 0)]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    run = lambda name, rows: common.cut(stages[name](spark, spark.createDataFrame(rows, DOCS), str(folder)), "plain")
    tuples = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    one = tuples(run("language", rows))
    assert one == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)
    kept, classes = [], []
    for r in sorted(one):
        if not any(r[1] == k[1] or plain_similarity(r[1], k[1]) >= 0.8 for k in classes):
            kept.append(r)
        classes.append(r)
    two = tuples(run("near_duplicates", one))
    assert two == sorted(kept, key=str) and len(two) == 60
    wins = {tuple(w[i : i + 13]) for _, t in items for w in [t.split()] for i in range(len(w) - 12)}
    share = lambda w: len({i + j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in wins for j in range(13)}) / len(w)
    three = tuples(run("decontamination", two))
    assert three == [r for r in two if share(r[1].split()) < 0.05] and len(three) < len(two)
    sizes = {}
    for r in three:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, free = {}, set(sizes)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    want = []
    for s in sizes:
        whole, at = int(target[s] // sizes[s]), 0
        for r in sorted((r for r in three if r[3] == s), key=lambda r: hashlib.md5(f"sluice-mix:{r[0]}".encode()).hexdigest()):
            n = len(r[1].split())
            want += [r] * (whole + (at + n / 2 < target[s] - whole * sizes[s]))
            at += n
    four = tuples(run("mixing", three))
    assert four == sorted(want, key=str)
    five = run("sharding", four).collect()
    assert sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in five), key=str) == four
    for shard in range(8):
        at = sorted(r["slot"] for r in five if r["shard"] == shard)
        assert at == list(range(len(at)))
    loads = [sum(r["size"] for r in five if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= 2 * max(r["size"] for r in five) and all(r["size"] == len(r["text"]) + 1 for r in five)
    assert corpus_pipeline.run(spark, str(folder)).count() == len(four)
    corpus_pipeline.write(spark, str(folder), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(four)
