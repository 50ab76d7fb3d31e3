"""Links within blocks of signatures' buckets, and components that end once they are stars."""

import numpy as np
import pyarrow as pa

from sluice.llm import probminhash
from sluice.operators import graph


def _texts():
    """Groups of near texts, all with a common line that repeats and words that do."""
    rng = np.random.default_rng(1)
    out = []
    for g in range(4):
        for _ in range(20):
            words = [f"g{g}w{i}" for i in range(60)]
            for i in rng.integers(0, 60, rng.integers(0, 6)):
                words[i] = f"n{rng.integers(1e6)}"
            out.append(" ".join(words) + " c1 c2 c3 c4 c5 c6 c7 c8" * int(rng.integers(1, 5)) + " rep" * int(rng.integers(0, 9)))
    return out


def _roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_a_block_is_compared_exactly_only_where_it_may_reach_the_threshold(monkeypatch):
    texts = _texts()
    n, bags, exact, calls = len(texts), [probminhash.bag(t) for t in texts], probminhash.exact_similarity, []
    want = _roots(n, [(i, j) for i in range(n) for j in range(i) if exact(bags[i], bags[j]) >= 0.8 - 1e-9])
    monkeypatch.setattr(probminhash, "exact_similarity", lambda a, b: calls.append(1) or exact(a, b))
    names = ["bucket", "i", "j", "block", "rid", "label", "text"]
    # One block with itself, then the halves as two blocks.
    for blocks in ([0] * n, [i % 2 for i in range(n)]):
        calls.clear()
        links = []
        for i, j in sorted({(min(x, y), max(x, y)) for x in blocks for y in blocks}):
            at = [x for x in range(n) if blocks[x] in (i, j)]
            k = len(at)
            batch = pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int64()), *[pa.array(v, pa.int32()) for v in ([i] * k, [j] * k, [blocks[x] for x in at])], pa.array(at, pa.int64()), pa.array(at, pa.int64()), pa.array([texts[x] for x in at])], names)
            links += [tuple(r.values()) for out in probminhash._linked(0.8)([batch]) for r in out.to_pylist()]
        assert _roots(n, links) == want
        assert len(calls) < 4 * n  # all pairs are n * (n - 1) / 2


def test_the_bound_is_one_and_tight_with_equal_weights(monkeypatch):
    texts = [*_texts()[:30], *[" ".join(f"p{i}" for i in range(s, s + 50)) for s in range(0, 20, 2)], "one two", "one two three", ""]
    n, bags = len(texts), [probminhash.bag(t) for t in texts]
    for step in (1 << 19, 40):  # in one pass and in several
        monkeypatch.setattr(probminhash, "_STEP", step)
        keys, share, start = probminhash._shares(pa.chunked_array([texts[:7], texts[7:]]))
        order = np.argsort(keys, kind="stable")
        lists = keys[order], np.repeat(np.arange(n), np.diff(start))[order], share[order]
        for x in range(n):
            own = slice(start[x], start[x + 1])
            bound = probminhash._at_most(keys[own], share[own], lists, n, np.ones(n, bool), 0.3)
            for y in range(n):
                true = probminhash.exact_similarity(bags[x], bags[y])
                assert true < 0.3 or bound[y] >= true - 1e-9
                assert not 30 <= min(x, y) <= max(x, y) < 40 or true < 0.5 or abs(bound[y] - true) < 1e-9


def _labels(df):
    return {tuple(r) for r in df.collect()}


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    stars = spark.createDataFrame([(5, 1), (1, 4), (9, 7), (4, 1), (3, 3)], "a long, b long")
    assert _labels(graph.components(stars)) == {(5, 1), (4, 1), (9, 7)}
    assert written == ["edges", "lows"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (55, 60)], "a long, b long")
    assert _labels(graph.components(chain)) == {(i, 1) for i in range(2, 41)} | {(55, 50), (60, 50)}
    assert graph.components(stars.limit(0)).count() == 0


def test_components_are_joined_by_their_labels(spark):
    labels = spark.createDataFrame([(2, 1), (3, 1), (11, 10), (21, 20)], "node long, label long")
    joined = graph.components(spark.createDataFrame([(10, 1), (30, 10)], "a long, b long"))
    assert _labels(probminhash._merged(labels, joined)) == {(2, 1), (3, 1), (11, 1), (10, 1), (30, 1), (21, 20)}
