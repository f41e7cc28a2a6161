"""Document fingerprints by locally consistent parsing.

The bytes of a text are its first symbols. On every level, runs of one symbol become one
symbol; deterministic coin tossing turns each symbol into a small label that depends on
a few symbols to its left (twice the lowest bit in which it differs from its left
neighbour, plus that bit, four times over); symbols whose label is a local minimum begin
a phrase, and the phrase's name, a hash of its symbols, is a symbol of the next level.
Equal substrings get equal phrases but for a few at their ends, wherever they stand.

A fingerprint keeps, of the phrase names of levels ``LEVELS``, the smallest in each of
``BINS`` hash bins, as a byte; two hex digits a bin, 00 for an empty one. The likeness of
two fingerprints is the share of bins on which they agree among bins that either fills,
an estimate of the overlap of their phrases.

Defined cases: null and empty texts have the empty fingerprint (zeros), which is like
itself (1) and unlike others (0); equal texts have equal fingerprints. Documents are
ordered by id, nulls first, and rows of one id by a hash of the text, also between
partitions, so that one id may hold any number of rows; a single document
follows itself; an empty table gives an empty result. A text is parsed whole, in memory of
some 40 bytes for each of its own; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BINS, LEVELS = 64, (2, 3, 4)
#: Bytes of text that a worker parses at once; longer texts are parsed alone.
STEP_BYTES = 1 << 20
#: Symbols tossed at once.
BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    up = np.full(n, _ODD, np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing against the left neighbour, in blocks; first symbols meet the symbol 0."""
    out = np.empty(len(label), np.uint8)
    one, two = label.dtype.type(1), label.dtype.type(2)
    for lo in range(0, len(label), BLOCK):
        own = label[lo : lo + BLOCK]
        left = np.empty_like(own)
        left[1:] = own[:-1]
        left[0] = label[lo - 1] if lo else 0
        left[first[lo : lo + BLOCK]] = 0
        differ = own ^ left
        at = np.bitwise_count((differ & (~differ + one)) - one).astype(label.dtype)
        at[differ == 0] = 0
        out[lo : lo + BLOCK] = two * at + ((own >> at) & one)
    return out


def parse_level(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of the phrases into which each document's symbols fall."""
    n = len(symbols)
    begin = np.ones(n, bool)
    begin[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(begin)
    runs = np.diff(np.append(heads, n)).astype(np.uint64)
    symbols, doc = symbols[heads], doc[heads]
    many = runs > 1
    symbols[many] = mix(symbols[many] + runs[many] * np.uint64(_ODD))
    n = len(symbols)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    label = _toss(symbols, first)
    for _ in range(3):
        label = _toss(label, first)
    cut = first.copy()
    if n > 2:
        cut[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:])
    cut &= first | ~np.append(first[1:], True)  # a last symbol has no right neighbour to be compared with
    # a phrase has two symbols at least, but for a text of one
    cut[1:] &= ~(cut[:-1] & ~first[1:]) | first[1:]
    heads = np.flatnonzero(cut)
    ends = np.append(heads[1:], n)
    sizes = ends - heads
    inside = np.arange(n, dtype=np.int32) - np.repeat(heads, sizes).astype(np.int32)
    names = mix(symbols)
    names *= powers(int(sizes.max()))[inside]
    names = mix(np.add.reduceat(names, heads) + sizes.astype(np.uint64))
    return names, doc[heads]


def sketches(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, a row of BINS bytes each."""
    out = np.zeros((len(texts), BINS), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return out
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    names, docs = [], []
    for level in range(1, max(LEVELS) + 1):
        symbols, doc = parse_level(symbols, doc)
        if level in LEVELS:
            names.append(mix(symbols + np.uint64(level)))
            docs.append(doc)
    name, doc = np.concatenate(names), np.concatenate(docs)
    place = doc.astype(np.int64) * BINS + (name >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((name, place))
    place, name = place[order], name[order]
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    out.reshape(-1)[place[least]] = (name[least] % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among bins that either row fills; 1 if both are empty."""
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(axis=-1)
    n = filled.sum(axis=-1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _rows(ids: list, texts: list[str], following: list[str], marks: np.ndarray, next_marks: np.ndarray) -> dict:
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    other = sketches(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": [m.tobytes().hex() for m in marks], "edited_fingerprint": [m.tobytes().hex() for m in other],
        "near_edited": likeness(marks, other).tolist(), "near_next": likeness(marks, next_marks).tolist(),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likenesses.

    Documents are range-partitioned by id once, so the next document is the next row.
    The last row of a partition is left open and the first kept with its text; the two
    meet in a join on partition numbers, which the order of the partitions links.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    schema = f"doc_id {kind}, {_RESULT}, part int, role string, text string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, arrow = TaskContext.get().partitionId(), _arrow(schema_types)
        ids, texts, started, size = [], [], False, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            marks = sketches([t.encode() for t in texts])
            n = len(ids) - 1
            out = _rows(ids[:n], texts[:n], texts[1:], marks[:n], marks[1:]) | {"part": [part] * n, "role": [None] * n, "text": [None] * n}
            extra = ([(0, "head")] if not started else []) + ([(n, "open")] if last else [])
            for k, role in extra:
                for name in out:
                    out[name].append(None)
                out["doc_id"][-1], out["part"][-1], out["role"][-1], out["text"][-1] = ids[k], part, role, texts[k]
            yield pa.RecordBatch.from_pydict(out, arrow)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= STEP_BYTES and len(ids) > 1:
                    yield from flush(False)
                    started, ids, texts, size = True, ids[-1:], texts[-1:], len(t)
        if ids:
            yield from flush(True)

    from pyspark.sql.pandas.types import to_arrow_schema

    from_ddl = spark.createDataFrame([], schema).schema
    schema_types = [(f.name, f.type) for f in to_arrow_schema(from_ddl)]
    table, _ = materialize(ordered.mapInArrow(walk, schema), "fingerprints")
    result = ["doc_id", *[c.split()[0] for c in _RESULT.split(", ")]]
    done = table.filter("role is null").select(*result)
    heads = table.filter("role = 'head'").select(F.col("part").alias("p"), F.col("text").alias("following"))
    numbers = table.filter("role = 'head'").select(F.col("part").alias("p"))
    order = Window.orderBy("p")  # a number a partition, no texts
    links = numbers.select("p", F.coalesce(F.lead("p").over(order), F.min("p").over(Window.partitionBy())).alias("next_p"))
    open_rows = table.filter("role = 'open'").select("doc_id", "text", "part").join(links, F.col("part") == F.col("p")).drop("p")
    pairs = open_rows.join(heads, F.col("next_p") == F.col("p")).select("doc_id", "text", "following")
    result_schema = f"doc_id {kind}, {_RESULT}"
    result_types = [x for x in schema_types if x[0] in result]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            rows = _rows(batch.column("doc_id").to_pylist(), texts, following, sketches([t.encode() for t in texts]), sketches([t.encode() for t in following]))
            yield pa.RecordBatch.from_pydict(rows, _arrow(result_types))

    return done.union(pairs.mapInArrow(close, result_schema))


def _arrow(types: list) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in types])
