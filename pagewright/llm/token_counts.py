"""Token counts by heap-and-linked-list byte-pair merging.

Each piece that the pre-tokenizer cuts starts as one symbol a byte, linked to its
neighbours. A heap holds the adjacent pairs that have a rank; the lowest rank (leftmost
on a tie) is popped and merged until no ranked pair is left. The count is the number of
first symbols less the number of merges; no identifiers are made. Counts of pieces are
remembered in a bounded table, since words repeat.

Defined cases: null and empty texts have 0 tokens; a special string inside a text is one
token, as the library's default has it; repeated rows each get their count; an empty
table gives an empty result; texts of over ``LONG_TEXT`` characters are cut into pieces one
after the other, so only a single piece (a run without a break) is held with its heap, some
200 bytes for each of its own; other columns of the input are not carried along.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Pieces remembered by each worker before its table is started anew.
REMEMBERED = 600_000
#: Texts longer than this are cut into pieces lazily.
LONG_TEXT = 4_000_000
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, by a heap of pairs over a doubly linked list."""
    n = left = len(symbols)
    if n < 2:
        return n
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two was merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class PieceCounts(dict):
    """Piece to number of tokens, filled on demand, of bounded size."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        named = self.symbols
        count = count_merged([named[b] for b in piece.encode()], self.ranks)
        if len(piece) <= 64:
            self[piece] = count
        return count


class Counter:
    """Counts tokens of texts as a byte-level BPE file of the tokenizers library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pieces = PieceCounts({pair: rank for rank, pair in enumerate(merges)})
        self.find = regex.compile(PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, found = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            found = len(parts) - 1
        get = self.pieces.__getitem__
        for part in parts:
            if len(part) > LONG_TEXT:
                found += sum(get(m.group()) for m in self.find.finditer(part))
            else:
                found += sum(map(get, self.find.findall(part)))
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row of docs; one pass, no shuffle."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in chain.from_iterable(byte_slices(b, "t", 4 << 20) for b in batches):
            n = [count(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("b"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"))
    out = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
