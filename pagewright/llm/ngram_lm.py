"""Language-model scores by an interpolated modified Kneser-Ney bigram model.

Counting: every map task turns its training texts into word hashes and sends distinct
words and word pairs with their counts, packed, to groups by hash. The pairs of one first
word go to ``SPLIT`` groups by their second, so that the commonest words, and the begin
mark, fill no group alone. A group sums them and writes sorted hash arrays into the model
folder: words with counts; pairs with counts. What it knows of its words goes on to a second
deal, where parts are added and written too: for every second word the number of distinct
words before it (its continuation count), for every first word the number of its distinct
followers met once, twice and more often. Only sums of a few numbers a group reach the driver.

Scoring: workers map the arrays into memory and look the words and pairs of a batch up by
binary search. The model is

    P(v|u) = (c(uv) - D(c(uv))) / c(u.) + g(u) P(v),  P(v) = (k(v) - D'(k(v))) / k(.) + g' / (V + 1)

with k(v) the distinct words before v, discounts from the counts of counts, and one
place for all unknown words. A text starts at a begin mark and ends with an end token.

The arrays live in the folder that driver and executors share (``spark.checkpoint.dir``),
which must be mounted on every worker, since files are mapped; another kind is an error.
A group writes a file under another name first and renames it, so a repeated task
leaves a whole file. Names hold the group's number, which follows from the hash.

Words are told apart by 64 bits of hash where they are counted, and by 48 in pairs: of W
distinct words one shares these with another with a chance of W / 2^48 (4e-9 for a million).

Defined cases: null and empty texts have one token, the end; a null id counts as the
empty text in the split; without training rows every probability is the uniform one
and the base score takes N = V = 0; repeated rows are learned and scored as often; an empty
table gives an empty result; a text is held whole with eight bytes for each of its words;
other columns are not carried along.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import byte_slices, crc_mod, fresh_path, materialize, shuffles_cleaned, utf8

#: Bytes of training text that a group stands for, and tokens a task holds before it sends.
GROUP_BYTES, HELD_TOKENS = 32 << 20, 2_000_000
#: Groups that share the pairs of one first word (a power of two).
SPLIT = 4
END, BEGIN = xxhash.xxh64_intdigest(b"", 101), xxhash.xxh64_intdigest(b"", 102)
_M48 = np.uint64((1 << 48) - 1)


class Hashes(dict):
    """Word to 64-bit hash, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def token_hashes(text: bytes, known: Hashes) -> list[int]:
    out = list(map(known.__getitem__, text.lower().split()))
    out.append(END)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(u * np.uint64(0x9E3779B97F4A7C15) + v)


def short(h: np.ndarray) -> np.ndarray:
    """The 48 bits of a word's hash that pairs and their statistics carry."""
    return h & _M48


def group_of(h48: np.ndarray, groups: int) -> np.ndarray:
    return ((_mix(h48) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)


def pair_group(u: np.ndarray, v: np.ndarray, groups: int) -> np.ndarray:
    """Where a pair is summed and stored."""
    return group_of(u + (_mix(v) & np.uint64(SPLIT - 1)) * np.uint64(0x9E3779B97F4A7C15), groups)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, and their sums."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    heads = np.flatnonzero(first)
    return k[heads], order[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


_SENT = StructType([StructField("kind", IntegerType()), StructField("g", IntegerType()), StructField("packed", BinaryType())])
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("g", pa.int32()), ("packed", pa.binary())])


def _send(kind: int, g: np.ndarray, pack) -> pa.RecordBatch:
    order = np.argsort(g, kind="stable")
    sorted_g = g[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_g[1:] != sorted_g[:-1]))) if len(g) else np.empty(0, int)
    ends = np.append(heads[1:], len(g))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), kind, np.int32)), pa.array(sorted_g[heads]), pa.array([pack(order[a:b]) for a, b in zip(heads, ends, strict=True)], pa.binary())], schema=_SENT_ARROW)


def _counted(held: list[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs of some texts, each a hash array with its end token."""
    flat = np.concatenate(held)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    starts = np.cumsum([0, *(len(h) for h in held[:-1])])
    before[starts] = BEGIN
    words, _, counts = _summed(flat, np.ones(len(flat), np.int64))
    yield _send(0, group_of(short(words), groups), lambda k: words[k].tobytes() + counts[k].astype(np.uint32).tobytes())
    u, v = short(before), short(flat)
    _, at, counts = _summed(pair_keys(u, v), np.ones(len(flat), np.int64))
    u, v = u[at], v[at]
    yield _send(1, pair_group(u, v, groups), lambda k: _six(u[k]) + _six(v[k]) + counts[k].astype(np.uint32).tobytes())


def _send_counts(training: DataFrame, groups: int, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Hashes(), [], 0
        for batch in chain.from_iterable(byte_slices(b, text_col, 2 << 20) for b in batches):
            for text in utf8(batch, text_col):
                held.append(np.array(token_hashes(text, known), np.uint64))
                size += len(held[-1])
            if size > HELD_TOKENS:
                yield from _counted(held, groups)
                held, size = [], 0
        if held:
            yield from _counted(held, groups)

    return training.select(text_col).mapInArrow(run, _SENT)


def _local(path: str) -> str:
    if not path.startswith("file:"):
        raise ValueError(f"the shared folder must be mounted on every worker to be memory-mapped: {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def _save(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{os.getpid()}.npy"
    np.save(part, values)
    os.replace(part, f"{folder}/{name}.npy")


_TOTALS = ("n_tokens", "n_words", "p1", "p2", "p3", "p4", "pairs", "k1", "k2", "k3", "k4")


def _write_groups(folder: str):
    """Sums the sent counts of each group and writes its arrays.

    Yields what it knows of second words (kind 2) and first words (kind 4), and one row of totals a group (kind 3).
    """

    def words(g: int, packed: list[bytes]) -> np.ndarray:
        h = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 12) for p in packed])
        c = np.concatenate([np.frombuffer(p, np.uint32, offset=len(p) // 12 * 8) for p in packed]).astype(np.int64)
        h, _, c = _summed(h, c)
        _save(folder, f"word-{g}", h)
        _save(folder, f"count-{g}", c)
        return np.array([c.sum(), len(c), *[0] * 9], np.int64)

    def merge(held: tuple, packed: list[bytes]) -> tuple:
        u = np.concatenate([held[0], *(_eight(p[: len(p) // 16 * 6]) for p in packed)])
        v = np.concatenate([held[1], *(_eight(p[len(p) // 16 * 6 : len(p) // 16 * 12]) for p in packed)])
        c = np.concatenate([held[2], *(np.frombuffer(p, np.uint32, offset=len(p) // 16 * 12).astype(np.int64) for p in packed)])
        keys, at, c = _summed(pair_keys(u, v), c)
        return u[at], v[at], c, keys

    def pairs(g: int, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals; first words and what follows them in this group."""
        u, _, c, keys = held
        _save(folder, f"pair-{g}", keys)
        _save(folder, f"times-{g}", np.minimum(c, (1 << 32) - 1).astype(np.uint32))
        order = np.argsort(u)
        first = np.ones(len(u), bool)
        first[1:] = u[order][1:] != u[order][:-1]
        heads = np.flatnonzero(first)
        kinds = np.stack([(c[order] == 1), (c[order] == 2), (c[order] > 2), c[order]], axis=1).astype(np.int64)
        totals = np.array([0, 0, *((c == n).sum() for n in (1, 2, 3, 4)), len(c), 0, 0, 0, 0], np.int64)
        return totals, u[order][heads], np.add.reduceat(kinds, heads, axis=0).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
        at, held, size, pair_state = None, [], 0, None
        empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), None)

        def close() -> Iterator[pa.RecordBatch]:
            kind, g = at
            if kind == 0:
                totals = words(g, held)
            else:
                state = merge(pair_state, held)
                totals, u, kinds = pairs(g, state)
                yield _send(4, group_of(u, groups), lambda k: _six(u[k]) + kinds[k].tobytes())
                v, _, n = _summed(state[1], np.ones(len(state[1]), np.int64))
                yield _send(2, group_of(v, groups), lambda k: _six(v[k]) + n[k].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([g], pa.int32()), pa.array([totals.tobytes()], pa.binary())], schema=_SENT_ARROW)

        for batch in batches:
            for kind, g, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (kind, g) != at:
                    if at:
                        yield from close()
                    at, held, size, pair_state = (kind, g), [], 0, empty
                held.append(packed)
                size += len(packed)
                if kind == 1 and size > 48 << 20:  # what repeats is summed before more is held
                    pair_state, held, size = merge(pair_state, held), [], 0
        if at:
            yield from close()

    return run


def _write_sums(folder: str):
    """Adds up what groups knew of first and second words and writes it."""

    def seconds(g: int, packed: list[bytes]) -> np.ndarray:
        v = np.concatenate([_eight(p[: len(p) // 10 * 6]) for p in packed])
        n = np.concatenate([np.frombuffer(p, np.uint32, offset=len(p) // 10 * 6) for p in packed]).astype(np.int64)
        v, _, n = _summed(v, n)
        _save(folder, f"after-{g}", v)
        _save(folder, f"cont-{g}", n)
        return np.array([*[0] * 7, *((n == k).sum() for k in (1, 2, 3, 4))], np.int64)

    def firsts(g: int, packed: list[bytes]) -> np.ndarray:
        u = np.concatenate([_eight(p[: len(p) // 22 * 6]) for p in packed])
        kinds = np.concatenate([np.frombuffer(p, np.uint32, offset=len(p) // 22 * 6).reshape(-1, 4) for p in packed]).astype(np.int64)
        order = np.argsort(u)
        u = u[order]
        heads = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        _save(folder, f"before-{g}", u[heads])
        _save(folder, f"follow-{g}", np.add.reduceat(kinds[order], heads, axis=0))
        return np.zeros(len(_TOTALS), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            kind, g = at
            totals = (seconds if kind == 2 else firsts)(g, held)
            return pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([g], pa.int32()), pa.array([totals.tobytes()], pa.binary())], schema=_SENT_ARROW)

        for batch in batches:
            for kind, g, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (kind, g) != at:
                    if held:
                        yield close()
                    at, held = (kind, g), []
                held.append(packed)
        if held:
            yield close()

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified discounts for counts of one, two and more, from the counts of counts."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5  # too little was seen to tell
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * (n[k] / n[k - 1]) if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def train(training: DataFrame, text_col: str = "text") -> dict:
    """Counts the training texts; the model's folder, groups and totals."""
    spark = training.sparkSession
    size = training.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    path = fresh_path(spark, "lm")
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)
    write, add_up = _write_groups(folder), _write_sums(folder)
    with shuffles_cleaned(spark):
        sent = _send_counts(training, groups, text_col)
        dealt = sent.repartition(groups * 2, "kind", "g").sortWithinPartitions("kind", "g")
        rows, _ = materialize(dealt.mapInArrow(lambda b: write(b, groups), _SENT), "lm-rows")
        later = rows.filter("kind in (2, 4)").repartition(groups, "kind", "g").sortWithinPartitions("kind", "g").mapInArrow(add_up, _SENT)
        later, _ = materialize(later, "lm-totals")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_TOTALS), np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total.tolist()], list(_TOTALS))

    totals = rows.filter("kind = 3").select("packed").union(later.select("packed")).mapInArrow(add, ", ".join(f"{t} long" for t in _TOTALS))
    found = totals.agg(*[F.sum(t).alias(t) for t in _TOTALS]).first().asDict()
    return {"folder": folder, "groups": groups, **{k: v or 0 for k, v in found.items()}}


@lru_cache(maxsize=16384)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


class Model:
    """The memory-mapped arrays, looked up for whole batches."""

    def __init__(self, spec: dict):
        self.spec, self.groups, self.folder = spec, spec["groups"], spec["folder"]
        self.d = discounts([spec[f"p{i}"] for i in (1, 2, 3, 4)])
        self.dk = discounts([spec[f"k{i}"] for i in (1, 2, 3, 4)])
        self.pairs, self.v = spec["pairs"], spec["n_words"]
        k1, k2 = spec["k1"], spec["k2"]
        self.k_more = 0
        self.k = (k1, k2)

    def find(self, keys: np.ndarray, group: np.ndarray, names: str, values: str, width: int = 1) -> np.ndarray:
        """The values stored for keys; 0 where there is none. Keys must be sorted within a group."""
        shape = (len(keys),) if width == 1 else (len(keys), width)
        out = np.zeros(shape, np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            there = _mapped(f"{self.folder}/{names}-{g}.npy")
            if there is None or not len(there):
                continue
            own = order[cuts[g] : cuts[g + 1]]
            at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
            hit = there[at] == keys[own]
            out[own[hit]] = _mapped(f"{self.folder}/{values}-{g}.npy")[at[hit]]
        return out

    def score(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and log10 probability of each text."""
        flat = np.concatenate(tokens)
        starts = np.cumsum([0, *(len(t) for t in tokens[:-1])])
        words, back = np.unique(flat, return_inverse=True)
        g = group_of(short(words), self.groups)
        n, v = self.spec["n_tokens"], self.v
        c = self.find(words, g, "word", "count")
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        k = self.find_short(words, "after", "cont")
        total = max(self.pairs, 1)
        types = self.spec["k1"] * self.dk[0] + self.spec["k2"] * self.dk[1] + max(v - self.spec["k1"] - self.spec["k2"], 0) * self.dk[2]
        lower = (np.maximum(k - _discount(k, self.dk), 0) + (types if self.pairs else 1.0) / (v + 1)) / total
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[starts] = BEGIN
        contexts, context_back = np.unique(before, return_inverse=True)
        follow = self.find_short(contexts, "before", "follow", 4)
        u, w = short(before), short(flat)
        keys, pair_back = np.unique(pair_keys(u, w), return_inverse=True)
        first = np.empty(len(keys), np.int64)
        first[pair_back] = np.arange(len(flat))
        times = self.find(keys, pair_group(u[first], w[first], self.groups), "pair", "times")[pair_back]
        seen = follow[context_back]
        all_seen = np.maximum(seen[:, 3], 1)
        gamma = np.where(seen[:, 3] > 0, (seen[:, :3] * np.array(self.d)).sum(axis=1) / all_seen, 1.0)
        p = np.maximum(times - _discount(times, self.d), 0) / all_seen + gamma * lower[back]
        add = lambda x: np.add.reduceat(x, starts)
        return add((c > 0)[back].astype(np.int64)), add(base[back]), add(np.log10(p))

    def find_short(self, words: np.ndarray, names: str, values: str, width: int = 1) -> np.ndarray:
        h, back = np.unique(short(words), return_inverse=True)
        return self.find(h, group_of(h, self.groups), names, values, width)[back]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = crc_mod("doc_id", folds) == held_out
    slim = docs.select("doc_id", "text", held.alias("held_out"))
    spec = train(slim.filter(~F.col("held_out")))
    kind = slim.schema["doc_id"].dataType.simpleString()
    n = spec["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(spec), Hashes()
        for batch in chain.from_iterable(byte_slices(b, "text", 4 << 20) for b in batches):
            tokens = [np.array(token_hashes(t, known), np.uint64) for t in utf8(batch, "text")]
            if not tokens:
                continue
            seen, base, score = model.score(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([len(t) for t in tokens], pa.int64()), pa.array(seen), pa.array(np.full(len(tokens), n)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
