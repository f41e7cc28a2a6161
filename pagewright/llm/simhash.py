"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant that lies within r/2 bits
of both. So every distinct fingerprint emits all variants within r/2 bits (2081 of 64
bits for r = 4), variants are shuffled, and fingerprints that meet on a variant are
candidates. Candidates are checked by their true distance and linked to the smallest
owner of the variant: linear in the owners, and it keeps every component.

Variants go over the shuffle packed, ten bytes each: the variant and the number of the
mask that made it, from which the owner follows. They are dealt in ``rounds`` rounds by
a linear code of their bits, whose shuffle files are dropped before the next round, so
the disk holds one round's variants at a time.

Defined cases: null and empty texts, and texts of white space, have fingerprint 0 and
are linked like any other; a text under four words is one shingle; repeated rows share a
fingerprint and a component; rows without an id get the component's smallest id that is
not null (null if there is none); an empty table gives an empty result; a text is hashed
whole, its shingles 65536 at a time; ``keep_first`` passes columns of any name through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, few_files, fresh_name, materialize, remove, utf8
from .components import connected_components

BITS, SHINGLE, SEED = 64, 4, 42
#: Variants that one reducing group holds on average.
GROUP_VARIANTS = 1_000_000
#: Fingerprints whose variants a task makes at once.
CHUNK = 2048


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    set_bits, total, step = np.zeros(BITS, np.int64), len(words) - SHINGLE + 1, 1 << 16
    for lo in range(0, total, step):
        hi = min(lo + step, total)
        found = [digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), (ends[lo + SHINGLE - 1 : hi + SHINGLE - 1] - 1).tolist(), strict=True)]
        set_bits += np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long; one pass, no shuffle."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(byte_slices(b, "t") for b in batches):
            fp = np.array([fingerprint(t) for t in utf8(batch, "t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)], np.uint64)


def _code(x: np.ndarray, rounds: int) -> np.ndarray:
    """A code below rounds (a power of two), linear over bits: code(a ^ b) = code(a) ^ code(b)."""
    code = np.zeros(x.shape, np.int64)
    for bit in range(rounds.bit_length() - 1):
        chosen = np.uint64(sum(1 << b for b in range(BITS) if (b * 5 + b // 7) >> bit & 1))
        code |= (np.bitwise_count(x & chosen).astype(np.int64) & 1) << bit
    return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _emit(fps: DataFrame, radius: int, rounds: int, turn: int, groups: int) -> DataFrame:
    """Packed variants of one round: (g, packed), packed = variants then mask numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(radius)
        mask_code = _code(masks, rounds)
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), CHUNK):
                part = every[lo : lo + CHUNK]
                part_code, variants, numbers = _code(part, rounds), [], []
                for code in range(rounds):
                    own, which = part[part_code == code], np.flatnonzero(mask_code == code ^ turn)
                    variants.append((own[:, None] ^ masks[which][None, :]).ravel())
                    numbers.append(np.tile(which.astype(np.uint16), len(own)))
                v, m = np.concatenate(variants), np.concatenate(numbers)
                g = ((_mix(v) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(g, kind="stable")
                v, m, g = v[order], m[order], g[order]
                cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                ends = np.append(cuts[1:], len(g))
                yield pa.RecordBatch.from_arrays([pa.array(g[cuts].astype(np.int32)), pa.array([v[a:b].tobytes() + m[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["g", "packed"])

    return fps.select("fp").mapInArrow(run, "g int, packed binary")


def _meet(packed: list[bytes], masks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from every owner of a shared variant to its smallest owner, each once."""
    v = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 10) for p in packed])
    m = np.concatenate([np.frombuffer(p, np.uint16, offset=len(p) // 10 * 8) for p in packed])
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    if not shared.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    v, own = v[shared], (v[shared] ^ masks[m[order][shared]]).view(np.int64)
    first = np.concatenate(([True], v[1:] != v[:-1]))
    least = np.minimum.reduceat(own, np.flatnonzero(first))[np.cumsum(first) - 1]
    close = (own != least) & (np.bitwise_count((own ^ least).view(np.uint64)) <= distance)
    own, least = own[close], least[close]
    order = np.lexsort((least, own))
    own, least = own[order], least[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (least[1:] != least[:-1])
    return own[new], least[new]


def ball_links(fps: DataFrame, distance: int = 4, rounds: int = 8) -> DataFrame:
    """(src, dst) links among the distinct fingerprints ``fp``, enough for their components.

    Any two fingerprints within ``distance`` bits are joined by a path of these links.
    """
    spark, radius = fps.sparkSession, (distance + 1) // 2
    n = fps.count()
    variants = n * sum(math.comb(BITS, r) for r in range(radius + 1))
    groups = max(1, math.ceil(variants / rounds / GROUP_VARIANTS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / (8 * CHUNK)))
    spread = fps.select("fp").repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, held, at = ball(radius), [], None

        def flush() -> pa.RecordBatch:
            own, least = _meet(held, masks, distance)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(least)], ["src", "dst"])

        for batch in batches:
            for g, packed in zip(batch.column("g").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if g != at and held:
                    yield flush()
                    held = []
                at = g
                held.append(packed)
        if held:
            yield flush()

    found, paths = None, []
    for turn in range(rounds):
        dealt = _emit(spread, radius, rounds, turn, groups).repartition(groups, "g").sortWithinPartitions("g")
        # some links a fingerprint at most, as a rule; a file for each group would hold next to nothing
        links, path = materialize(few_files(dealt.mapInArrow(run, "src long, dst long"), 8 * n), f"links{turn}")
        paths.append(path)
        found = links if found is None else found.union(links)
    out, _ = materialize(few_files(found.distinct(), found.count()), "links")
    for path in paths:
        remove(spark, path)
    return out


def near_duplicates(docs: DataFrame, distance: int = 4, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    marked, _ = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rows = marked.count()
    classes, _ = materialize(few_files(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), rows), "classes")
    comp = connected_components(ball_links(classes, distance, rounds)).withColumnRenamed("node", "fp")
    joined = classes.join(comp, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class, _ = materialize(few_files(joined.join(least, "component").select("fp", "component_id"), rows), "class_components")
    return marked.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest id of each group of near duplicates.

    Rows that repeat an id count as one document; rows without an id stay only in groups
    where no row has one.
    """
    marked = near_duplicates(docs, distance, id_col=id_col, text_col=text_col)
    name = fresh_name(docs.columns, "_kept")
    kept = marked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi")
