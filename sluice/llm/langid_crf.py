"""Language identification by a linear-chain conditional random field.

Every word of a line gets a language: emissions come from affixes, character
n-grams and a learned lexicon, transitions between neighbouring words are learned
too, so that code-switched lines are labelled word by word. Forward-backward gives
each word's posterior; a document's language is the one with the largest mean
posterior over its words with letters, and that mean is its score.

Training uses a bounded sample of labelled documents: of the MAX_LANGUAGES labels
with most documents, SAMPLE_DOCS each, those with the smallest hashes, and
SAMPLE_WORDS neighbouring words of each, from a place
anywhere in its text. Training lines switch between stretches of several
languages, so transitions are learned from seen switches. The weights are maximum
likelihood with a small penalty, by Adam on exact gradients. The model's size is
BUCKETS times the number of languages, whatever the corpus.

Labelling reads whole texts. A line is one chain; batches of lines run through
forward-backward together, longest first, so memory follows the step's bytes.

Defined cases: a null text, or one without a letter, is 'und' with score 0; null
languages are not learned from; with one language everything with letters is
that language; without any labelled text everything is 'und'; repeated rows get
equal results; a carried column named lang_pred, score or spoken comes out with
"_in" appended; lang, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound_batches, set_aside
from .wordbytes import POWERS, Words, _FOLD, _VALUE, mixed, steps, trimmed

SAMPLE_DOCS, SAMPLE_WORDS = 240, 200
OWN = ("lang_pred", "score", "spoken")
MAX_LANGUAGES = 500
BITS = 17
BUCKETS = 1 << BITS
AFFIXES, GRAMS = (1, 2, 3, 4), (2, 3)
UNKNOWN = "und"
_STEP = 1 << 19
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """Languages, lexicon (sorted word hashes), feature weights and transitions (source, target)."""

    languages: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All start + 0..count-1, and the index of each one's range."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature bucket) pairs: affixes, n-grams, and the word itself if it is in the lexicon."""
    n = len(data)
    up, down = POWERS.get(n + 1)
    length = ends - starts
    words, features = [], []

    def add(word: np.ndarray, value: np.ndarray, salt: int) -> None:
        words.append(word)
        features.append((mixed(value + np.uint64(salt * 0x1F123BB5159A55E5 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64))

    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[_FOLD[data]] * up[:n])])
        part = lambda a, b: (total[b] - total[a]) * down[a]
        for k in AFFIXES:
            own = np.flatnonzero(length >= k)
            add(own, part(starts[own], starts[own] + k), k)
            add(own, part(ends[own] - k, ends[own]), 16 + k)
        for k in GRAMS:
            at, own = _ranges(starts, np.maximum(length - k + 1, 0))
            add(own, part(at, at + k), 32 + k)
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
            own = np.flatnonzero(lexicon[at] == hashes)
            add(own, hashes[own], 64)
    return np.concatenate(words), np.concatenate(features)


def _summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, first: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posteriors of all words of all chains, scaled alphas, (emission times beta), and the log partition."""
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(transitions)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    norm = np.ones(len(e))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = first[: active[t]] + t
        x = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        s = x.sum(axis=1)
        norm[at] = s
        alpha[at] = x / s[:, None]
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        beta[at - 1] = ((beta[at] * e[at]) @ a.T) / norm[at][:, None]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    return post, alpha, e * beta / norm[:, None], float(np.log(norm).sum() + top.sum())


def expected_transitions(alpha: np.ndarray, onward: np.ndarray, later: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """How often each transition is expected, over the words ``later`` that have one before them in their line."""
    a = np.exp(transitions)
    z = ((alpha[later - 1] @ a) * onward[later]).sum(axis=1, keepdims=True)
    return a * ((alpha[later - 1] / z).T @ onward[later])


def _training_lines(doc_words: list[np.ndarray], labels: list[int], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, label, first of line, line sizes): stretches of the documents, dealt into lines of mixed languages."""
    rng = np.random.default_rng(seed)
    stretches = []
    for words, label in zip(doc_words, labels, strict=True):
        at = 0
        while at < len(words):
            n = int(rng.integers(3, 25))
            stretches.append((words[at : at + n], label))
            at += n
    rng.shuffle(stretches)
    line_of = np.cumsum(rng.integers(0, 3, len(stretches)) == 0)
    word = np.concatenate([w for w, _ in stretches])
    label = np.concatenate([np.full(len(w), k) for w, k in stretches])
    lengths = np.bincount(line_of, [len(w) for w, _ in stretches]).astype(np.int64)
    lengths = lengths[lengths > 0]
    return word, label, np.cumsum(lengths) - lengths, lengths


def train(rows: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.15, penalty: float = 1e-3) -> Model:
    """A model from (language, neighbouring words) rows."""
    languages = sorted({lang for lang, words in rows if words})
    k = len(languages)
    if not k:
        return Model([], np.zeros(0, np.uint64), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    texts = [" ".join(words).encode() for _, words in rows]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    w = Words(data, np.array([0, *ends[:-1], len(data)], np.int64), fold=True)
    hashes = w.hashes()
    types, at, of, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lexicon = types[counts >= 2]
    pair_word, pair_feature = word_features(data, w.starts[at], w.ends[at], types, lexicon)
    used, pair_feature = np.unique(pair_feature, return_inverse=True)
    bounds = w.per_doc
    doc_words = [of[bounds[i] : bounds[i + 1]] for i in range(len(rows))]
    word, label, first, size = _training_lines(doc_words, [languages.index(lang) if lang in languages else 0 for lang, _ in rows])
    inner = np.ones(len(word), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    params = [np.zeros((len(used), k)), np.zeros((k, k))]
    seen_t = np.zeros((k, k))
    np.add.at(seen_t, (label[later - 1], label[later]), 1)
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        weights, transitions = params
        by_type = _summed(pair_word, weights[pair_feature], len(types))
        post, alpha, onward, _ = forward_backward(by_type[word], first, size, transitions)
        expected_t = expected_transitions(alpha, onward, later, transitions)
        miss = -post
        miss[np.arange(len(word)), label] += 1
        miss = _summed(word, miss, len(types))
        gradient = [_summed(pair_feature, miss[pair_word], len(used)) / len(word) - penalty * weights / len(used), (seen_t - expected_t) / len(word) - penalty * transitions]
        for i, g in enumerate(gradient):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] + rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    full = np.zeros((BUCKETS, k), np.float32)
    full[used] = params[0]
    return Model(languages, lexicon, full, params[1])


def label_words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some texts and their posteriors over the model's languages."""
    w = Words(data, offsets, fold=True)
    k = len(model.languages)
    if not len(w.starts):
        return w, np.zeros((0, k))
    types, at, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
    pair_word, pair_feature = word_features(data, w.starts[at], w.ends[at], types, model.lexicon)
    by_type = np.stack([np.bincount(pair_word, model.weights[:, j][pair_feature], len(types)) for j in range(k)], axis=1)
    line = np.cumsum(data == 10)[w.starts]
    begins = np.ones(len(w.starts), bool)
    begins[1:] = line[1:] != line[:-1]
    doc_first = w.per_doc[:-1][w.counts > 0]
    begins[doc_first] = True
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(begins)))
    return w, forward_backward(by_type[of], first, size, model.transitions)[0]


def label_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language (index) and score."""
    w, post = label_words(model, data, offsets)
    lettered = np.concatenate([[0], np.cumsum(_LETTER[data])])
    counts = (lettered[w.ends] > lettered[w.starts]).astype(np.float64)
    sums = np.stack([np.bincount(w.doc, post[:, j] * counts, w.n_docs) for j in range(post.shape[1])], axis=1)
    n = np.bincount(w.doc, counts, w.n_docs)
    best = sums.argmax(axis=1)
    return best, np.clip(sums[np.arange(w.n_docs), best] / np.maximum(n, 1), 0, 1)


def training_rows(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, words_per_doc: int = SAMPLE_WORDS, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, list[str]]]:
    """The bounded sample of labelled, not held-out documents."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return []
    limits = docs.sparkSession.createDataFrame([(r["lang"], hash_limit(1.5 * docs_per_language, r["count"])) for r in counts], "lang string, limit long")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    deal = F.xxhash64("doc_id", "text")
    at = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.greatest(F.size("w") - words_per_doc, F.lit(0)) + 1)
    # Equal rows have equal hashes and count once; of what is under the limit, the smallest hashes are taken.
    chosen = labelled.select("lang", "doc_id", "text", deal.alias("deal")).join(F.broadcast(limits), "lang").where(F.col("deal") <= F.col("limit")).dropDuplicates(["lang", "deal"])
    first = Window.partitionBy("lang").orderBy("deal")
    rows = chosen.withColumn("r", F.row_number().over(first)).where(F.col("r") <= docs_per_language).select("lang", "deal", "doc_id", words.alias("w"))
    rows = rows.select("lang", "deal", F.slice("w", at.cast("int") + 1, words_per_doc).alias("w")).collect()
    return [(r["lang"], r["w"]) for r in sorted(rows, key=lambda r: (r["lang"], r["deal"]))]


def hash_limit(wanted: float, rows: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of any number of rows lie."""
    return -(2**63) + min(2**64 - 1, int(wanted * 2**64 / max(rows, 1)))


def held_out():
    """Every fifth document by the CRC of its id is for testing only; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def _labeller(model, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for first, end, data, offsets in steps(batch.column("text"), _STEP):
                part = batch.slice(first, end - first)
                spoken = part.column("spoken").to_numpy(zero_copy_only=False).astype(bool)
                if m.languages:
                    best, score = label_texts(m, data, offsets)
                else:
                    best, score, spoken = np.zeros(end - first, np.int64), np.zeros(end - first), np.zeros(end - first, bool)
                best, score = np.where(spoken, best, len(m.languages)), np.where(spoken, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(names[best].tolist(), pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns (text may be one) with lang_pred and score of every whole text."""
    bound_batches(docs.sparkSession)
    docs, names = set_aside(docs, OWN)
    carry = tuple(names[c] for c in carry)
    spoken = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken")
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.lexicon, model.weights, model.transitions))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "lang_pred string", "score double"])
    return docs.select(*dict.fromkeys([*carry, "text"]), spoken).mapInArrow(trimmed(_labeller(shared, [*carry])), schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, under their own columns, that have a language: null texts and such without a letter go."""
    aside, names = set_aside(docs, OWN)
    told = identify(aside, model, tuple(names.values()))
    return told.where(F.col("lang_pred") != UNKNOWN).select(*[F.col(new).alias(old) for old, new in names.items()])
