import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import block_norms, queries, sum_squares, token_rollup, word_tries

DOCS = "doc_id long, text string, lang string, sequence_id string, score string"
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", "x"), (3, " \n\t ", "en", "s", "x"), (4, "#### 123", None, "s", "x"), (5, LONG, "fr", "s", "x"), (5, LONG, "fr", "s", "x"), (None, "x y z " * 20, "en", "s", "x"), (7, "Ünïcode ΣΑΣ word\r\nword <|endoftext|> x", "fr", "s", "x"), (8, "one " * 25, None, None, None), (9, "one " * 25, None, None, None)]
VOCABULARY = f"{token_rollup.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def expected_pieces(coder, rows):
    out = []
    for doc, text in rows:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, first, *range(first + 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


@pytest.fixture(scope="module")
def coder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def whole_sequences(rows):
    """How many sequences, none with a gap, an overlap or too many tokens."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def test_pieces_and_sequences_against_the_tokenizer(spark, sf, coder, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd, odd.limit(0)):
        rows = sum_squares.pack(sum_squares.pieces(df, VOCABULARY)).collect()
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows]
        assert sorted(got, key=str) == sorted(expected_pieces(coder, texts), key=str)
        n, tokens = whole_sequences(rows), sum(r["length"] for r in rows)
        # No packing needs fewer than the tokens or the pieces that can't share a sequence do.
        assert n <= max(1.02 * -(-tokens // 1024), sum(r["length"] > 512 for r in rows)) + 2


def test_query_packs_all_documents(spark, sf):
    rows = queries.op11_sum_squares(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_groups_lose_nothing_and_sequences_hold_their_ids(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = sum_squares.pieces(docs, VOCABULARY, with_ids=True)
    packed = sum_squares.pack(made, group=20)
    rows = packed.collect()
    whole_sequences(rows)
    assert len(rows) == made.count() and "ids" not in packed.columns
    texts = dict(docs.collect())
    where = {(r["sequence_id"], r["offset"]): (r["doc_id"], r["start"], r["length"]) for r in rows}
    for s in sum_squares.sequences(made, packed).collect():
        assert len(s["ids"]) <= 1024 and len(s["doc_ids"]) == len(s["starts"])
        for doc, at in zip(s["doc_ids"], s["starts"]):
            own, start, length = where[s["sequence_id"], at]
            assert own == doc
            assert s["ids"][at : at + length] == (coder.encode(texts[doc] or "", add_special_tokens=False).ids + [2])[start : start + length]


def test_place_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    for size, n in ((12, 60), (40, 200), (100, 300)):
        lengths = rng.integers(1, size, n)
        bins, offsets = sum_squares.place(lengths, size)
        fill = {}
        for i in np.argsort(-lengths, kind="stable"):
            gaps = Counter(size - f for f in fill.values() if f < size)
            room = {}
            for g in gaps:
                if g >= lengths[i]:
                    after = gaps.copy()
                    after[g] -= 1
                    if g > lengths[i]:
                        after[g - lengths[i]] += 1
                    room[g] = sum(v * v for v in after.values())
            own = fill.get(bins[i], 0)
            assert own == offsets[i]
            if room:
                assert size - own == min(room, key=lambda g: (room[g], g))
            else:
                assert bins[i] not in fill
            fill[bins[i]] = own + lengths[i]


def test_ids_of_all_kinds_of_characters(coder):
    own = sum_squares.encoder(*sum_squares.load_vocabulary(VOCABULARY))
    points = [*range(0x250), *range(0x250, 0x11000, 37), *range(0x2000, 0x2070), 0x3000, 0x1F600]
    for text in (f"a{chr(p)}b 1{chr(p)}2 {chr(p)}  {chr(p)}'s \n{chr(p)}." for p in points if not 0xD800 <= p < 0xE000):
        assert own.encode(text, allowed_special="all") == coder.encode(text, add_special_tokens=False).ids


def test_screened_centroids_against_all_distances():
    rng = np.random.default_rng(3)
    for spread, dims, block in ((1, 64, 8), (40, 64, 8), (3, 12, 4)):
        centres = rng.integers(-spread, spread + 1, (20, dims)) * 10
        v = centres[rng.integers(0, 20, 500)] + rng.integers(-2, 3, (500, dims))
        c = np.concatenate([centres, centres[:3], v[:5]])  # equal centroids: the smaller number wins
        who, far, taken = block_norms.nearest(v, block_norms.compressed(v, block), c, block)
        every = ((v[:, None, :] - c[None, :, :]) ** 2).sum(2)
        assert (who == every.argmin(1)).all() and (far == every.min(1)).all()
        if spread == 40:
            assert taken < 0.3 * every.size
    bound = ((block_norms.compressed(v, 4)[:, None] - block_norms.compressed(c, 4)[None]) ** 2).sum(2)
    assert (bound <= every + 1e-6).all()


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [q for _, q in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = defaultdict(list)
        for _, q in kept:
            at[near(q)[1]].append(q)
        c = [[sum(x) // len(at[j]) for x in zip(*at[j])] if at[j] else old for j, old in enumerate(c)]
    told = [(i, *near(q)) for i, q in kept]
    sums = Counter()
    for _, d, j in told:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in told), key=str)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    v = [[float(np.float32(x)) for x in rng.normal(0, 1, 64)] for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(v)] + [(i % 7, v[i]) for i in range(20)] + [(None, v[1]), (None, v[2]), (100, None), (101, []), (102, v[0][:63]), (103, [*v[0], 1.0]), (104, [None, *v[0][1:]]), (105, [math.nan, *v[0][1:]]), (106, [math.inf, *v[0][1:]]), (107, [-math.inf, *v[0][1:]])]
    schema = "vec_id long, embedding array<float>, q string, cluster string"
    full = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    for df, given in ((full, rows), (full.where("vec_id < 5"), [r for r in rows if r[0] is not None and r[0] < 5]), (full.limit(0), [])):
        got = block_norms.cluster(df)[0].collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_clusters(given)
    with pytest.raises(Exception, match="beyond"):
        block_norms.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))[0].collect()


def plain_draw(docs, target, runs, buckets=10_000, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [r[:1] + r[4:] for r in able[: percent * len(able) // 100]]
    return sorted(map(tuple, out), key=str), ranks


@pytest.mark.parametrize("runs", [1, 3])
def test_draw_against_plain_counts(spark, sf, odd, runs):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for df, of, percent in ((docs, target, 10), (odd, target, 60), (odd.limit(0), target, 10), (odd, target.limit(0), 60)):
        rows = word_tries.resample(df, of, runs, percent=percent).collect()
        want, ranks = plain_draw([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], [r["text"] for r in of.collect()], runs, percent=percent)
        assert sorted((tuple(r)[:5] for r in rows), key=str) == want
        drawn = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1))
        assert [[r["doc_id"], r["score"]] for r in drawn] == ranks


def test_small_tries_and_short_blocks_give_the_same(monkeypatch):
    texts = [LONG, "a b a b a c", None, "", "Ünï x " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(5))], ["text", "doc_id"])

    class Gains:
        value = list(range(97))

    counted = lambda: [next(word_tries._counter(r, 97)(iter([batch]))).to_pydict() for r in (1, 2, 4)]
    scored = lambda: [next(word_tries._scorer(Gains, r)(iter([batch]))).to_pydict() for r in (1, 2, 4)]
    whole = counted(), scored()
    monkeypatch.setattr(word_tries, "NODES", 50)
    monkeypatch.setattr(word_tries, "PENDING", 10)
    monkeypatch.setattr(word_tries.word_blocks, "__defaults__", (1, 30))
    assert (counted(), scored()) == whole
