"""Toxicity by a linear-chain conditional random field over words.

Two tags, toxic and other. A word's features are hashed: the word, its first four and
first five characters and its last three. Forward-backward gives every word's marginal.
A document's score is a logistic function of its largest marginal, calibrated on the
sample; words with a marginal of one half or more are the offending spans.

Only documents carry labels, so word labels are made first: in toxic documents of the
sample, a word whose features are met in far more toxic than other documents is toxic
(if none stands out, the word that stands out most; a document without any teaches the field
nothing). Documents are the unit of these counts, near copies counted once; a feature counts from
``LEAST`` toxic documents on, by a ratio with one added to either count. The field is then fitted by gradient steps on every word of
the sample, in pieces of 16 words, the last piece of a text as long as it is.

The sample of labelled rows is bounded: at most ``SAMPLE`` rows of label 0 and of label 1, the
smallest by a hash of the id, whole texts. They are hashed on the executors; of a label whose
hashed texts hold over ``SAMPLE_BYTES`` (about 15 MB of text), the rows beyond that are left out,
never a part of one. One task fits the field to them; the driver gets its weights alone.
Scoring covers whole texts of all rows and hands nothing but the text to Python.

Defined cases: null and empty texts score 0; a null id is judged by its text like any
other and is never sampled; labels of unknown ids and null labels teach nothing; repeated
labels count once a row of the sample; of unlike texts under one id the one with the lowest
hash is sampled; without rows of both labels every score is 0; an empty table gives an empty
result. A text is read in parts of ``SLICE`` bytes cut at blanks, so a very long one costs
eight bytes a word and table. Columns of any name pass through ``drop_toxic`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, array_slices, byte_slices, crc_mod, materialize, remove

SAMPLE, SAMPLE_BYTES, GROUP = (2400, 1000), 48 << 20, 1 << 15
BUCKETS, FEATURES, PIECE, EPOCHS, RATE, PENALTY = 1 << 17, 4, 16, 30, 0.4, 2e-6
CUTOFF, SPAN_CUTOFF, LEAST = 0.3, 0.5, 3
#: Bytes of text that a worker scores at once, words whose emissions it remembers, words of a block.
SLICE, REMEMBERED, BLOCK = 1 << 20, 200_000, 64


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(ALNUM_TABLE).split()


def word_parts(text: str) -> Iterator[list[bytes]]:
    """The words of a text, of about SLICE bytes at a time."""
    plain = text.lower().encode().translate(ALNUM_TABLE)
    lo = 0
    while len(plain) - lo > SLICE:
        hi = plain.find(b" ", lo + SLICE)
        if hi < 0:
            break
        yield plain[lo:hi].split()
        lo = hi
    yield plain[lo:].split()


def feature_names(word: bytes) -> list[bytes]:
    chars = word.decode(errors="replace")
    return [b"w" + word, b"4" + chars[:4].encode(), b"5" + chars[:5].encode(), b"s" + chars[-3:].encode()]


@dataclass
class Hashed:
    """A text as hashes: features of its distinct words, its words as places among them, and
    the lowest hash of three words in a row, which near copies share."""

    features: np.ndarray
    words: np.ndarray
    mark: int


@dataclass
class Field:
    """Weights of a bucket for the toxic tag, the log potentials of tag pairs, and how a
    document's largest log odds become its score."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def score(self, odds: np.ndarray) -> float:
        """A document's score from the log odds of its words; 0 without words."""
        if not len(odds):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * odds.max() + self.shift, -60, 60))))


def marginal_odds(e: list[np.ndarray], pairs: np.ndarray) -> list[np.ndarray]:
    """Log odds of the toxic tag's marginal at every word of texts, from the words' emission scores.

    Forward-backward in blocks of ``BLOCK`` words: the transfer matrices of all blocks of all texts
    are multiplied up side by side, the state is carried from block to block along each text, and
    then all blocks are walked side by side from the states they begin with. Exact, and a long text
    takes as many steps as it has blocks, not words.
    """
    a = np.exp(pairs)
    sizes = np.array([len(x) for x in e], np.int64)
    counts = -(-sizes // BLOCK)
    texts = np.flatnonzero(counts)
    texts = texts[np.argsort(-counts[texts], kind="stable")]  # so that those with a k-th block come first
    out: list[np.ndarray] = [np.empty(0)] * len(e)
    if not len(texts):
        return out
    counts = counts[texts]
    first = np.cumsum(counts) - counts  # each text's first block
    n = int(counts.sum())
    score, live = np.zeros((n, BLOCK)), np.zeros((n, BLOCK), bool)
    for k, text in enumerate(texts.tolist()):
        at = first[k] * BLOCK
        score.reshape(-1)[at : at + sizes[text]] = e[text]
        live.reshape(-1)[at : at + sizes[text]] = True
    score, live = np.asfortranarray(score), np.asfortranarray(live)
    # transfer matrices; a text's first word has no transition before it
    m = np.zeros((4, n))
    m[0] = m[3] = 1.0
    heads = np.zeros(n, bool)
    heads[first] = True
    for t in range(BLOCK):
        p, go = np.exp(np.clip(score[:, t], -60, 60)), live[:, t]
        step = np.stack((m[0] * a[0, 0] + m[1] * a[1, 0], (m[0] * a[0, 1] + m[1] * a[1, 1]) * p, m[2] * a[0, 0] + m[3] * a[1, 0], (m[2] * a[0, 1] + m[3] * a[1, 1]) * p))
        if t == 0:
            step[0, heads], step[1, heads], step[2, heads], step[3, heads] = 1.0, p[heads], 1.0, p[heads]
        step /= step.max(axis=0)
        m = np.where(go, step, m)
    # the state before each block, and the backward state after it, as log odds
    into, back = np.zeros(n), np.zeros(n)
    v = np.ones((2, len(texts)))
    for k in range(int(counts[0])):
        own = first[: np.searchsorted(-counts, -k, "left")]  # texts with a k-th block
        now, b = v[:, : len(own)], own + k
        into[b] = np.log(now[1] / now[0])
        nxt = np.stack((now[0] * m[0, b] + now[1] * m[2, b], now[0] * m[1, b] + now[1] * m[3, b]))
        v = nxt / nxt.max(axis=0)
    u = np.ones((2, len(texts)))
    for k in range(int(counts[0]) - 1, 0, -1):
        own = first[: np.searchsorted(-counts, -k, "left")]
        b = own + k
        got = np.stack((m[0, b] * u[0, : len(own)] + m[1, b] * u[1, : len(own)], m[2, b] * u[0, : len(own)] + m[3, b] * u[1, : len(own)]))
        u[:, : len(own)] = got / got.max(axis=0)
        back[b - 1] = np.log(u[1, : len(own)] / u[0, : len(own)])
    odds = np.zeros((n, BLOCK), order="F")
    f = into
    for t in range(BLOCK):
        r = np.exp(np.clip(f, -60, 60))
        moved = np.log((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
        if t == 0:
            moved[heads] = 0.0
        f = score[:, t] + moved
        odds[:, t] = f
    g = back
    for t in range(BLOCK - 2, -1, -1):
        r = np.exp(np.clip(score[:, t + 1] + g, -60, 60))
        g = np.where(live[:, t + 1], np.log((a[1, 0] + r * a[1, 1]) / (a[0, 0] + r * a[0, 1])), back)
        odds[:, t] += g
    odds[:, BLOCK - 1] += back
    odds = np.ascontiguousarray(odds).reshape(-1)
    for k, text in enumerate(texts.tolist()):
        at = first[k] * BLOCK
        out[text] = odds[at : at + sizes[text]]
    return out


def hashed(text: str) -> Hashed:
    words = words_of(text)
    places: dict[bytes, int] = {}
    order = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32, len(words))
    features = np.array([[xxhash.xxh64_intdigest(f, 3) for f in feature_names(w)] for w in places], np.uint64).reshape(-1, FEATURES)
    mark = min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
    return Hashed(features, order, mark)


def weak_odds(docs: list[Hashed], toxic: list[bool], table: np.ndarray) -> np.ndarray:
    """For every word of table, how much more its features are met in toxic than in other documents."""
    seen, held, total = set(), ([], []), [0, 0]
    for d, y in zip(docs, toxic, strict=True):
        if (d.mark, y) in seen:
            continue
        seen.add((d.mark, y))
        total[y] += 1
        held[y].append(np.unique(d.features[:, :3]))

    def counts(y: int, features: np.ndarray) -> np.ndarray:
        keys, n = np.unique(np.concatenate(held[y]), return_counts=True)
        at = np.minimum(np.searchsorted(keys, features), max(len(keys) - 1, 0))
        return np.where(keys[at] == features, n[at], 0) if len(keys) else np.zeros(features.shape)

    bad, good = (counts(y, table[:, :3]) for y in (1, 0))
    ratio = ((bad + 1) / (total[1] + 1)) / ((good + 1) / (total[0] + 1))
    return np.where(bad >= LEAST, ratio, 0.0).max(axis=1, initial=0.0)


def tags_of(found: np.ndarray) -> np.ndarray:
    """Which words of a toxic document, given their odds, are its toxic ones."""
    own = found >= 12
    if len(found) and not own.any() and found.max() > 6:
        own = found == found.max()
    return own


def fit(rows: list[tuple[str, bool]]) -> Field:
    """A field fitted to labelled texts."""
    return fit_hashed([(hashed(t), y) for t, y in rows])


def fit_hashed(rows: list[tuple[Hashed, bool]]) -> Field:
    """A field fitted to labelled texts whose words are hashed."""
    none = Field(np.zeros(BUCKETS), -12.0, np.zeros((2, 2)))
    docs, toxic = [d for d, _ in rows], [y for _, y in rows]
    if len(set(toxic)) < 2:
        return none
    # all words of the sample: their features, and every text as places among them
    _, first = np.unique(np.concatenate([d.features[:, 0] for d in docs]), return_index=True)
    table = np.concatenate([d.features for d in docs])[first]
    texts = [np.searchsorted(table[:, 0], d.features[:, 0]).astype(np.int32)[d.words] for d in docs]
    odds = weak_odds(docs, toxic, table)
    own_buckets = (table % np.uint64(BUCKETS)).astype(np.int32)
    del docs
    # the last piece of a text is padded
    s = sum(-(-len(t) // PIECE) for t in texts)
    x, y, live = np.zeros((s, PIECE), np.int32), np.zeros((s, PIECE), bool), np.zeros((s, PIECE), bool)
    at = 0
    for text, bad in zip(texts, toxic, strict=True):
        n = len(text)
        own = tags_of(odds[text]) if bad else np.zeros(n, bool)
        # a toxic text in which nothing stands out is no example of clean words either
        x.reshape(-1)[at : at + n], y.reshape(-1)[at : at + n], live.reshape(-1)[at : at + n] = text, own, own.any() or not bad
        at += -(-n // PIECE) * PIECE
    if not y.any():
        return none
    # pieces in falling order of length
    order = np.argsort(-live.sum(axis=1), kind="stable")[: live.any(axis=1).sum()]
    s = len(order)
    x, y, live = x[order], y[order], live[order]
    pair_seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, bias, pairs = np.zeros(BUCKETS), np.array([-3.0]), np.zeros((2, 2))
    speed = [np.full(BUCKETS, 1e-6), np.full(1, 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(EPOCHS):
        words = w[own_buckets].sum(axis=1)
        pull, total, expected = np.zeros(len(table)), 0.0, np.zeros((2, 2))
        for lo in range(0, s, GROUP):  # groups of pieces bound what is held at once
            part = slice(lo, lo + GROUP)
            missed, pair_sum = _expectations(words[x[part]] + bias, pairs, y[part], live[part])
            pull += np.bincount(x[part].reshape(-1), missed.reshape(-1), len(table))
            total += missed.sum()
            expected += pair_sum
        grads = [np.bincount(own_buckets.reshape(-1), np.repeat(pull, FEATURES), BUCKETS) / s - PENALTY * w, np.array([total / s]), (pair_seen - expected) / s]
        for value, grad, acc in zip((w, bias, pairs), grads, speed, strict=True):
            acc += grad**2
            value += RATE * grad / np.sqrt(acc)
    field = Field(w, float(bias[0]), pairs)
    del x, y, live
    words = w[own_buckets].sum(axis=1) + field.bias
    top = np.full(len(texts), -12.0)
    for lo in range(0, len(texts), 200):  # a few texts at a time bound what is held at once
        for k, o in enumerate(marginal_odds([words[t] for t in texts[lo : lo + 200]], pairs), lo):
            top[k] = o.max(initial=-12.0) if len(o) else -12.0
    field.slope, field.shift = _calibrate(top, np.array(toxic, float))
    return field


def _expectations(e: np.ndarray, pairs: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tags less marginals, and expected tag pairs, of pieces in falling order of length, by forward-backward."""
    a, s, going = np.exp(pairs), len(e), live.sum(axis=0)
    alpha = np.zeros((s, PIECE, 2), np.float32)
    beta = np.ones((s, PIECE, 2), np.float32)
    scale = np.ones((s, PIECE, 1), np.float32)
    pot = (np.stack((np.ones_like(e), np.exp(np.clip(e, -50, 50))), axis=2) * live[:, :, None]).astype(np.float32)
    for t in range(PIECE):
        k = going[t]
        alpha[:k, t] = pot[:k, t] * (alpha[:k, t - 1] @ a if t else 1.0)
        scale[:k, t] = alpha[:k, t].sum(axis=1, keepdims=True)
        alpha[:k, t] /= scale[:k, t]
    for t in range(PIECE - 2, -1, -1):
        k = going[t + 1]
        beta[:k, t] = ((pot[:k, t + 1] * beta[:k, t + 1]) @ a.T) / scale[:k, t + 1]
    marginal = (alpha * beta)[:, :, 1]
    expected = np.einsum("sti,ij,stj,st->ij", alpha[:, :-1], a, pot[:, 1:] * beta[:, 1:], 1 / scale[:, 1:, 0])
    return (y - marginal) * live, expected


def _calibrate(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of a document's label on its largest log odds; label 1 weighs a quarter."""
    top = np.clip(top, -12, 12)
    weight = np.where(y > 0, 0.25 / max(y.mean(), 1e-9), 0.75 / max(1 - y.mean(), 1e-9)) / len(y)
    x = np.stack((top, np.ones_like(top)), axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta = theta + 0.5 * np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * (theta - np.array([1.0, 0.0])))
    return max(float(theta[0]), 0.05), float(theta[1])


def _sampled(docs: DataFrame, labels: DataFrame, keep: "F.Column", sample: tuple[int, int], most: int) -> tuple[DataFrame, str] | None:
    """Hashed texts of the sample as a written table and its path; none if no label fits."""
    ids = None
    for value in (0, 1):
        own = labels.filter((F.col("toxic") == value) & F.col("doc_id").isNotNull() & keep).select("doc_id", "toxic").distinct()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[value])
        ids = own if ids is None else ids.union(own)
    picked = ids.collect()  # at most sum(sample) rows
    if not picked:
        return None
    few = docs.sparkSession.createDataFrame(picked, ids.schema)
    text = F.coalesce("text", F.lit(""))
    # one text an id, so that a repeated id is met once and reruns agree
    texts = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("x"))
    texts = texts.select("doc_id", "toxic", F.xxhash64("doc_id").alias("turn"), F.col("x.text").alias("text"))
    out = texts.select("doc_id", "toxic", "turn", *(F.lit(None).cast("binary").alias(c) for c in ("features", "words", "mark")))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(byte_slices(b, "text", SLICE) for b in batches):
            got = [hashed(t) for t in batch.column("text").to_pylist()]
            made = ([h.features.tobytes() for h in got], [h.words.tobytes() for h in got], [h.mark.to_bytes(8, "little") for h in got])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(m, pa.binary()) for m in made)], names=schema.names)

    once, path = materialize(texts.mapInArrow(run, schema), "toxicity_sample")
    sizes = once.select("doc_id", "toxic", "turn", (F.octet_length("features") + F.octet_length("words")).alias("size")).collect()
    chosen, used = [], [0, 0]
    for r in sorted(sizes, key=lambda r: (r.turn, r.doc_id)):
        if used[bool(r.toxic)] < most:  # one row at least, and whole rows only
            chosen.append((r.doc_id, r.toxic))
        used[bool(r.toxic)] += r.size
    if len(chosen) < len(sizes):
        once = once.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, ids.schema)), ["doc_id", "toxic"])
    return once.select("doc_id", "toxic", "features", "words", "mark"), path


def _unpacked(toxic: int, features: bytes, words: bytes, mark: bytes) -> tuple[Hashed, bool]:
    return Hashed(np.frombuffer(features, np.uint64).reshape(-1, FEATURES), np.frombuffer(words, np.int32), int.from_bytes(mark, "little")), bool(toxic)


def sample_rows(docs: DataFrame, labels: DataFrame, keep: "F.Column", sample: tuple[int, int] = SAMPLE, most: int = SAMPLE_BYTES) -> list[tuple[Hashed, bool]]:
    """At most sample[0] whole texts of label 0 and sample[1] of label 1, whose rows satisfy keep, hashed
    where they lie. Rows of a label are taken by a hash of the id until they hold ``most`` bytes."""
    found = _sampled(docs, labels, keep, sample, most)
    if found is None:
        return []
    rows = sorted(found[0].collect(), key=lambda r: (r.doc_id, r.toxic))
    remove(docs.sparkSession, found[1])
    return [_unpacked(*r[1:]) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, keep: "F.Column", sample: tuple[int, int] = SAMPLE, most: int = SAMPLE_BYTES) -> Field:
    """The field that one task fits to the sample."""
    found = _sampled(docs, labels, keep, sample, most)
    if found is None:
        return fit_hashed([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        field = fit_hashed([_unpacked(*r[1:]) for r in sorted(rows, key=lambda r: r[:2])])
        rest = [field.bias, *field.pairs.reshape(-1).tolist(), field.slope, field.shift]
        yield pa.RecordBatch.from_arrays([pa.array([field.weights.tobytes()], pa.binary()), pa.array([rest], pa.list_(pa.float64()))], ["weights", "rest"])

    got = found[0].coalesce(1).mapInArrow(run, "weights binary, rest array<double>").collect()
    remove(docs.sparkSession, found[1])
    if not got:
        return fit_hashed([])
    (weights, (bias, *pairs, slope, shift)), *_ = got
    return Field(np.frombuffer(weights), bias, np.array(pairs).reshape(2, 2), slope, shift)


class Tagger:
    """Marginals of whole documents; emission scores of words are remembered, bounded."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def emissions(self, text: str) -> np.ndarray:
        parts = []
        for words in word_parts(text):
            found = list(map(self.known.get, words))
            if None in found:
                new = list({w for w, e in zip(words, found, strict=True) if e is None})
                places = np.array([xxhash.xxh64_intdigest(f, 3) for w in new for f in feature_names(w)], np.uint64) % np.uint64(BUCKETS)
                fresh = dict(zip(new, (self.field.weights[places.astype(np.int64)].reshape(-1, FEATURES).sum(axis=1) + self.field.bias).tolist(), strict=True))
                found = [fresh[w] if e is None else e for w, e in zip(words, found, strict=True)]
                if len(self.known) + len(fresh) > REMEMBERED:
                    self.known = {}
                self.known.update(fresh)
            parts.append(np.array(found))
        return np.concatenate(parts)

    def log_odds(self, texts: list[str]) -> list[np.ndarray]:
        """Log odds of the toxic tag's marginal at every word of every text."""
        return marginal_odds([self.emissions(t) for t in texts], self.field.pairs)


def spans_of(text: str, odds: np.ndarray, cutoff: float = SPAN_CUTOFF) -> list[dict]:
    """Runs of offending words as offsets in characters, with their largest marginal."""
    bad = np.flatnonzero(odds >= np.log(cutoff / (1 - cutoff)))
    if not len(bad):
        return []
    marginal = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    import regex

    places = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out: list[dict] = []
    for k in bad.tolist():
        lo, hi = places[k]
        if out and out[-1]["_last"] == k - 1:
            out[-1] |= {"end": hi, "p": max(out[-1]["p"], float(marginal[k])), "_last": k}
        else:
            out.append({"start": lo, "end": hi, "p": float(marginal[k]), "_last": k})
    return [{"start": x["start"], "end": x["end"], "p": x["p"]} for x in out]


_TAGGED = "struct<score:double,spans:array<struct<start:int,end:int,p:double>>>"


def tagged(spark: SparkSession, field: Field, text: "F.Column") -> "F.Column":
    """A struct of score and spans of a text column."""
    shared = spark.sparkContext.broadcast(field)  # of fixed size
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])

    @F.arrow_udf(_TAGGED)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(shared.value)
        for array in arrays:
            out = []
            for texts in array_slices(array, SLICE):
                out += [{"score": tagger.field.score(o), "spans": spans_of(t, o)} for t, o in zip(texts, tagger.log_odds(texts), strict=True)]
            yield pa.array(out, kind)

    return run(F.coalesce(text, F.lit("")))


def scored(spark: SparkSession, field: Field, text: "F.Column") -> "F.Column":
    """The score of a text column alone."""
    shared = spark.sparkContext.broadcast(field)  # of fixed size

    @F.arrow_udf("double")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(shared.value)
        for array in arrays:
            yield pa.array([tagger.field.score(o) for texts in array_slices(array, SLICE) for o in tagger.log_odds(texts)], pa.float64())

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, spans."""
    held = crc_mod("doc_id", 4) == 2
    slim = docs.select("doc_id", "text")
    field = learn(slim, labels, ~held)
    out = slim.select("doc_id", held.alias("held_out"), tagged(docs.sparkSession, field, F.col("text")).alias("_tox"))
    return out.select("doc_id", "held_out", F.col("_tox.score").alias("score"), (F.col("_tox.score") >= cutoff).cast("int").alias("predicted"), F.col("_tox.spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without those that the field rejects; it learns as score_documents does."""
    field = learn(docs.select("doc_id", "text"), labels, crc_mod("doc_id", 4) != 2)
    return docs.filter(scored(docs.sparkSession, field, F.col("text")) < cutoff)
