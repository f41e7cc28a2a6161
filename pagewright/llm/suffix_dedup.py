"""Removal of repeated 200-byte strings with suffix arrays built by deep-shallow sorting.

Sampling. A window of ``SPAN`` bytes picks an anchor: the position inside it whose next
``GRAM`` bytes hash lowest (leftmost on a tie). The pick depends on the window's bytes
alone, so equal windows pick anchors at equal offsets. Windows in a row that pick one
anchor form a segment. Only anchors whose bytes hash like another anchor's can have
repeated windows; all others are done after one shuffle of their hashes.

Sorting. The segments around one anchor's bytes meet in one group. Their bytes to the
right of the anchor, and reversed those to the left, are suffixes; both are put in order
by deep-shallow sorting: multikey quicksort on eight-byte symbols down to ``SHALLOW``
bytes, then a blind trie for each group with the same first bytes, which also yields
exact longest common prefixes. A window is repeated if and only if another suffix
shares its bytes on both sides, which two runs of neighbours in the arrays tell. Groups of
every size, two included, are sorted and read like this.

Hot anchors. Windows hold 0 to SPAN - GRAM bytes to the left of their anchor. Of an anchor met
more than ``HOT`` times these depths are cut into 2^LEVEL ranges. Equal windows of one range
share the bytes that all its windows have, so the anchor's group falls into one for each range
and value of these bytes, and no pair is lost. A segment's part that matters to a range is a
piece; equal pieces are counted before they are compared and joined with their segments again
afterwards, in joins that adaptive execution can split. Where a group still holds more than
``HOT`` different pieces they are cut once more, one depth a piece, which leaves groups of
equal pieces alone.

Segments that are equal are counted before the shuffle and compared once. Positions are
addressed by a 128-bit hash of the text, so equal texts share the work.

Defined cases: null and empty texts have no bytes; texts under 200 bytes keep all; rows
with equal texts of 200 bytes or more lose everything; repeated rows count as copies;
an empty table gives an empty result; texts are hashed in parts of ``STEP`` bytes, however
long they are. Where a kept text is wanted (``strip_repeats``), a removal never cuts a UTF-8
sequence: its bytes outside the removed run stay with it; columns of any name pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, remove, shuffles_cleaned

SPAN, GRAM, SHALLOW = 200, 64, 32
#: Bytes that a worker hashes at once; longer texts are taken in overlapping parts.
STEP, POSITION_BITS = 1 << 18, 22
#: Places of one anchor beyond which its group is split, and bytes of text taken from a batch at once.
HOT, LEVEL, SINGLE, SLICE = 300, 5, 8, 1 << 20
_ODD = 0xD1342543DE82EF95


# --- anchors -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = STEP * 3
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    of_byte = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), of_byte


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every position."""
    up, down, of_byte = _tables()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(of_byte[data] * up[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) of every segment, positions in data.

    data holds texts one after the other; ends says, for every byte, where its text ends.
    """
    none = np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    if len(data) < SPAN:
        return none
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    best = _sliding_min((h & ~low) | place, SPAN - GRAM + 1) & low
    window = np.flatnonzero(np.arange(SPAN, len(data) + 1) <= ends[: len(data) - SPAN + 1])
    if not len(window):
        return none
    pick = best[window].astype(np.int64)
    first = np.ones(len(window), bool)
    first[1:] = (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)
    heads = np.flatnonzero(first)
    last = window[np.append(heads[1:], len(window)) - 1]
    return h[pick[heads]], pick[heads], window[heads], last


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, text of each byte, offset in the text of each byte) of STEP bytes or so."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(b) for _, _, b in held])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        shift = np.array([o for _, o, _ in held]) - starts
        return data, np.repeat(starts + lengths, lengths), np.repeat(np.array([k for k, _, _ in held]), lengths), np.arange(len(data)) + np.repeat(shift, lengths)

    for k, text in enumerate(texts):
        if len(text) < SPAN:
            continue
        for lo in range(0, len(text) - SPAN + 1, STEP):
            part = text[lo : lo + STEP + SPAN - 1] if len(text) > STEP else text
            if held and size + len(part) > STEP:
                yield flush()
                held, size = [], 0
            held.append((k, lo, part))
            size += len(part)
            if len(text) <= STEP:
                break
    if held:
        yield flush()


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash, anchor, first window, last window), positions within the texts."""
    for data, ends, owner, offset in _parts(texts):
        h, at, lo, hi = anchors(data, ends)
        if len(h):
            yield owner[at], h.view(np.int64), offset[at], offset[lo], offset[hi]


# --- deep-shallow sorting ------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, lo: int = 0) -> int:
    """Length of the longest common prefix, known to be at least lo."""
    hi = min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """A trie of branching depths only: strings are compared once, at a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = k
            return
        node = self.root
        while isinstance(node, list):  # blind descent to some leaf
            node = node[1].get(self._byte(k, node[0])) if self._byte(k, node[0]) in node[1] else next(iter(node[1].values()))
        depth = common_prefix(self.strings[k], self.strings[node])
        above, key, here = None, None, self.root
        while isinstance(here, list) and here[0] < depth:
            above, key = here, self._byte(k, here[0])
            here = here[1][key]
        if isinstance(here, list) and here[0] == depth:
            here[1][self._byte(k, depth)] = k
            return
        leaf = here
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        new = [depth, {self._byte(leaf, depth): here, self._byte(k, depth): k}]
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def ordered(self) -> list[tuple[int, int]]:
        """(string, longest common prefix with the string before it), in order."""
        out: list[tuple[int, int]] = []
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, list):
                keys = sorted(node[1], reverse=True)
                stack += [(node[1][c], node[0] if i + 1 < len(keys) else shared) for i, c in enumerate(keys)]
            else:
                out.append((node, shared))
        return out


def _symbol(s: bytes, depth: int) -> tuple[int, int]:
    part = s[depth : depth + 8]
    return int.from_bytes(part.ljust(8, b"\0"), "big"), len(part)


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct strings, and each one's common prefix with the one before."""
    order: list[int] = []
    lcp: list[int] = []

    def put(found: list[tuple[int, int]]) -> None:
        for i, (k, shared) in enumerate(found):
            lcp.append((common_prefix(strings[order[-1]], strings[k]) if order else 0) if i == 0 else shared)
            order.append(k)

    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            put([(group[0], 0)])
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            put(trie.ordered())
        else:  # multikey quicksort: split by the symbol at this depth
            symbols = [_symbol(strings[k], depth) for k in group]
            pivot = sorted((symbols[0], symbols[len(group) // 2], symbols[-1]))[1]
            less = [k for k, s in zip(group, symbols, strict=True) if s < pivot]
            same = [k for k, s in zip(group, symbols, strict=True) if s == pivot]
            more = [k for k, s in zip(group, symbols, strict=True) if s > pivot]
            todo += [(g, d) for g, d in ((more, depth), (same, depth + 8), (less, depth)) if g]
    return order, lcp


# --- repeated windows of one anchor's group ------------------------------------------


def _sorted(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Each string's place among the distinct ones in order, and their common prefixes with the one before."""
    own: dict[bytes, int] = {}
    which = [own.setdefault(s, len(own)) for s in strings]
    order, lcp = deep_shallow(list(own))
    rank = [0] * len(order)
    for place, k in enumerate(order):
        rank[k] = place
    return [rank[k] for k in which], lcp


def _classes(lcp: list[int], depth: int) -> list[int]:
    """Numbers, in sorted order, that are equal where that many first bytes are."""
    return list(accumulate((x < depth for x in lcp[1:]), initial=0))


def repeated_depths(segments: list[bytes], left: list[int], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each segment the runs of depths (bytes left of the anchor) of its repeated windows.

    A segment holds ``left`` bytes before the anchor. What is equal changes only at depths
    that the two arrays of common prefixes and the segments' ends name; between two such
    depths all windows are judged at once.
    """
    least = [k + SPAN - len(s) for s, k in zip(segments, left, strict=True)]  # windows start ``left`` to ``least`` bytes before the anchor
    if len(segments) == 1:
        return [[(least[0], left[0])] if counts[0] > 1 else []]
    right_rank, right_lcp = _sorted([s[k:] for s, k in zip(segments, left, strict=True)])
    left_rank, left_lcp = _sorted([s[:k][::-1] for s, k in zip(segments, left, strict=True)])
    low, high = min(least), max(left)
    cuts = {low, *least, *(k + 1 for k in left), *(x + 1 for x in left_lcp[1:]), *(SPAN - x for x in right_lcp[1:])}
    cuts = [*sorted(c for c in cuts if low <= c <= high), high + 1]
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    for at, after in zip(cuts[:-1], cuts[1:], strict=True):
        right, back = _classes(right_lcp, SPAN - at), _classes(left_lcp, at)
        weight: dict[tuple[int, int], int] = {}
        members = [k for k in range(len(segments)) if least[k] <= at <= left[k]]
        keys = [(right[right_rank[k]], back[left_rank[k]]) for k in members]
        for k, key in zip(members, keys, strict=True):
            weight[key] = weight.get(key, 0) + counts[k]
        for k, key in zip(members, keys, strict=True):
            if weight[key] > 1:
                runs = found[k]
                if runs and runs[-1][1] == at - 1:
                    runs[-1] = (runs[-1][0], after - 1)
                else:
                    runs.append((at, after - 1))
    return found


# --- the Spark jobs ------------------------------------------------------------------


def _keyed(text: "F.Column") -> list["F.Column"]:
    """Two hashes of a text and its bytes."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), text.cast("binary").alias("b")]


def _find_anchors(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(byte_slices(x, "b", SLICE) for x in batches):
            k1, k2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2"))
            for owner, h, at, _, _ in text_anchors(batch.column("b").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(at)], ["a", "k1", "k2", "pos"])

    return keyed.select("k1", "k2", "b").mapInArrow(run, "a long, k1 long, k2 long, pos long")


#: Rows of two kinds: a place of a segment; a segment with its bytes, count and level.
PLACE, SEGMENT = 0, 1
_ROWS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("s1", pa.int64()), ("left", pa.int32()), ("seg", pa.binary()), ("n", pa.int64()), ("level", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64())])


def _hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed) - (1 << 63)


def pieces(seg: bytes, left: int, level: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(range, shared bytes, piece, its bytes left of the anchor) for every range of depths that the segment's windows meet."""
    ranges, depths = 1 << level, SPAN - GRAM + 1
    least = left + SPAN - len(seg)
    for k in range(ranges):
        lo, hi = depths * k // ranges, depths * (k + 1) // ranges - 1
        if lo > hi or hi < least or lo > left:
            continue
        own = min(left, hi)
        # a piece holds the range's windows and no more
        yield k, seg[left - lo : left + SPAN - hi], seg[left - own : left + SPAN - max(lo, least)], own


def _segments(with_positions: DataFrame) -> DataFrame:
    """Segments around repeated anchors: a row for each place, and one with bytes and count for
    each segment that is distinct in its slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(byte_slices(x, "b", SLICE) for x in batches):
            texts = batch.column("b").to_pylist()
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            # (text, position) of wanted anchors as one number, and the level of each
            wanted = np.concatenate([np.empty(0, np.int64), *((np.array(p, np.int64) >> 4) + (k << 40) for k, p in enumerate(batch.column("pos").to_pylist()))])
            levels = np.concatenate([np.empty(0, np.int64), *(np.array(p, np.int64) & 15 for p in batch.column("pos").to_pylist())])
            order = np.argsort(wanted)
            wanted, levels = wanted[order], levels[order]
            places: list[list] = [[] for _ in range(6)]
            distinct: dict[tuple, list] = {}
            for owner, h, at, lo, hi in text_anchors(texts):
                code = owner.astype(np.int64) * (1 << 40) + at
                found = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
                keep = wanted[found] == code if len(wanted) else np.zeros(len(code), bool)
                for k, a, p, x, y, level in zip(*(v[keep].tolist() for v in (owner, h, at, lo, hi)), levels[found[keep]].tolist(), strict=True):
                    seg = texts[k][x : y + SPAN]
                    s1 = _hash(seg, p - x)
                    distinct.setdefault((a, s1, p - x, seg, level), [0])[0] += 1
                    for column, value in zip(places, (a, s1, p - x, k1[k], k2[k], p), strict=True):
                        column.append(value)
            if places[0]:
                n, m = len(places[0]), len(distinct)
                none = lambda name, size: pa.nulls(size, _ROWS.field(name).type)
                typed = lambda name, values: pa.array(values, _ROWS.field(name).type)
                yield pa.RecordBatch.from_arrays([typed("kind", np.full(n, PLACE, np.int32)), *map(typed, ("a", "s1", "left"), places[:3]), *(none(c, n) for c in ("seg", "n", "level")), *map(typed, ("k1", "k2", "at"), places[3:])], schema=_ROWS)
                keys = list(zip(*distinct, strict=True))
                yield pa.RecordBatch.from_arrays([typed("kind", np.full(m, SEGMENT, np.int32)), *map(typed, ("a", "s1", "left", "seg"), keys[:4]), typed("n", [n for (n,) in distinct.values()]), typed("level", keys[4]), *(none(c, m) for c in ("k1", "k2", "at"))], schema=_ROWS)

    return with_positions.select("k1", "k2", "b", "pos").mapInArrow(run, "kind int, a long, s1 long, left int, seg binary, n long, level int, k1 long, k2 long, at long")


def _cut(segments: DataFrame, level: int) -> DataFrame:
    """Pieces of distinct segments (a, s1, left, seg, n): g names the group and p the piece."""
    arrow = pa.schema([("a", pa.int64()), ("s1", pa.int64()), ("left", pa.int32()), ("seg", pa.binary()), ("n", pa.int64()), ("g", pa.int64()), ("p", pa.int64()), ("own_left", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(byte_slices(x, "seg", SLICE >> 4) for x in batches):
            rows = []
            for a, s1, left, seg, n in zip(*(batch.column(c).to_pylist() for c in ("a", "s1", "left", "seg", "n")), strict=True):
                rows += [(a, s1, left, piece, n, _hash(shared, k + a % (1 << 32)), _hash(piece, own), own) for k, shared, piece, own in pieces(seg, left, level)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return segments.select("a", "s1", "left", "seg", "n").mapInArrow(run, "a long, s1 long, left int, seg binary, n long, g long, p long, own_left int")


def _alike(cut: DataFrame) -> DataFrame:
    """Different pieces as segments of their groups, with the places they stand for."""
    return cut.groupBy(F.col("g").alias("a"), F.col("p").alias("s1"), F.col("own_left").alias("left")).agg(F.sum("n").alias("n"), F.first("seg").alias("seg"))


def _back(cut: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of pieces as runs of the segments that they were cut from."""
    found = runs.select(F.struct(F.col("a").alias("g"), F.col("s1").alias("p"), F.col("left").alias("own_left")).alias("own"), "lo", "hi")
    return cut.select("a", "s1", "left", F.struct("g", "p", "own_left").alias("own")).join(found, "own").select("a", "s1", "left", "lo", "hi")


def _dealt(segments: DataFrame) -> DataFrame:
    """Segments (a, s1, left, seg, n), the groups dealt out and in order."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.select("a", "s1", "left", "seg", "n").repartition(parts, "a").sortWithinPartitions("a")


def _compare(segments: DataFrame) -> DataFrame:
    """(a, s1, left, lo, hi): runs of depths of repeated windows, from rows (a, s1, left, seg, n) ordered by a."""
    arrow = pa.schema([("a", pa.int64()), ("s1", pa.int64()), ("left", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in arrow}
        at, held = None, {}

        def close() -> None:
            keys = list(held)
            found = repeated_depths([seg for _, _, seg in keys], [left for _, left, _ in keys], [held[k] for k in keys])
            for (s1, left, _), runs in zip(keys, found, strict=True):
                for lo, hi in runs:
                    for name, value in zip(out, (at, s1, left, lo, hi), strict=True):
                        out[name].append(value)

        for batch in chain.from_iterable(byte_slices(x, "seg", SLICE) for x in batches):
            for a, s1, left, seg, n in zip(*(batch.column(c).to_pylist() for c in ("a", "s1", "left", "seg", "n")), strict=True):
                if a != at and held:
                    close()
                    held = {}
                at = a
                held[s1, left, seg] = held.get((s1, left, seg), 0) + n
            if len(out["a"]) > 20_000:
                yield pa.RecordBatch.from_pydict(out, arrow)
                out = {f.name: [] for f in arrow}
        if held:
            close()
        if out["a"]:
            yield pa.RecordBatch.from_pydict(out, arrow)

    return segments.mapInArrow(run, "a long, s1 long, left int, lo int, hi int")


def repeated_runs(docs: DataFrame, text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, str]:
    """(k1, k2, los, his): for each text with repeats, by hash, the runs of repeated window starts; and the table's path."""
    spark = docs.sparkSession
    keyed = docs.select(*_keyed(F.col(text_col)))
    found, anchor_path = materialize(_find_anchors(keyed), "anchors")
    with shuffles_cleaned(spark):
        # written first, so that the join reads two plain shuffles, whose hot keys can be split
        level = F.when(F.col("n") > hot, F.lit(LEVEL)).otherwise(F.lit(0)).cast("long")
        met_again, met_path = materialize(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a", level.alias("level")), "again")
        wanted = found.join(met_again, "a").groupBy("k1", "k2").agg(F.collect_set(F.col("pos") * 16 + F.col("level")).alias("pos"))
        positions, position_path = materialize(wanted, "positions")
        remove(spark, anchor_path)
        remove(spark, met_path)
        segments, segment_path = materialize(_segments(keyed.join(positions, ["k1", "k2"])), "segments")
        remove(spark, position_path)
        every = segments.filter(F.col("kind") == SEGMENT)
        runs, run_path = materialize(_compare(_dealt(every.filter("level = 0"))), "runs")
        # a hot anchor's equal segments are counted before any of them is cut
        hot_ones = every.filter("level > 0").groupBy("a", "s1", "left").agg(F.sum("n").alias("n"), F.first("seg").alias("seg"))
        cut, cut_path = materialize(_cut(hot_ones, LEVEL), "pieces")
        alike, alike_path = materialize(_alike(cut), "alike")
        large, large_path = materialize(alike.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("a"), "large")
        again, again_path = materialize(_cut(alike.join(large, "a", "left_semi"), SINGLE), "single")
        single_runs, single_path = materialize(_compare(_dealt(_alike(again))), "single_runs")
        part_runs, part_path = materialize(_compare(_dealt(alike.join(large, "a", "left_anti"))), "part_runs")
        runs = runs.unionByName(_back(cut, part_runs.unionByName(_back(again, single_runs))))
        places = segments.filter(F.col("kind") == PLACE).select("a", "s1", "left", "k1", "k2", "at")
        back = places.join(runs, ["a", "s1", "left"]).select("k1", "k2", F.struct((F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo")).alias("hi")).alias("run"))
        out = back.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("run")).alias("runs"))
        out, path = materialize(out.select("k1", "k2", F.col("runs.lo").alias("los"), F.col("runs.hi").alias("his")), "repeats")
        for done in (segment_path, run_path, cut_path, alike_path, large_path, again_path, single_path, part_path):
            remove(spark, done)
    return out, path


def removed_spans(los: list[int] | None, his: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed byte runs [lo, hi) from runs of repeated window starts, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in zip(los or (), his or (), strict=True):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi + SPAN, out[-1][1]))
        else:
            out.append((lo, hi + SPAN))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no UTF-8 sequence is cut."""
    out = []
    for lo, hi in spans:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _with_runs(docs: DataFrame, text_col: str, hot: int = HOT) -> DataFrame:
    """(row, b, los, his): every row of docs as a struct, with its text's bytes and runs."""
    runs, _ = repeated_runs(docs, text_col, hot)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keyed(F.col(text_col)))
    return keyed.join(runs, ["k1", "k2"], "left").select("row", "b", "los", "his")


_DIGEST = "struct<n_removed:long,kept_sha256:string,spans:array<struct<lo:long,hi:long>>>"


def _parts_of(*arrays: pa.Array) -> Iterator[Iterator[tuple]]:
    """Rows of arrays, the first holding bytes, in slices."""
    batch = pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))])
    for part in byte_slices(batch, "0", SLICE):
        yield zip(*(c.to_pylist() for c in part.columns), strict=True)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    kind = pa.struct([("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

    @F.arrow_udf(_DIGEST)
    def digest(b: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        out = []
        for rows in _parts_of(b, los, his):
            for text, lo, hi in rows:
                own = removed_spans(lo, hi)
                out.append({"n_removed": sum(y - x for x, y in own), "kept_sha256": hashlib.sha256(kept_bytes(text, own)).hexdigest(), "spans": [{"lo": x, "hi": y} for x, y in own]})
        return pa.array(out, kind)

    joined = _with_runs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", hot)
    out = joined.select(F.col("row.doc_id").alias("doc_id"), F.octet_length("b").cast("long").alias("n_bytes"), digest("b", "los", "his").alias("d"))
    return out.select("doc_id", "n_bytes", "d.n_removed", F.size("d.spans").cast("long").alias("n_spans"), "d.kept_sha256", "d.spans")


def strip_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with repeated passages removed from the text; all rows and columns stay."""

    @F.arrow_udf("string")
    def kept(b: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        return pa.array([kept_bytes(text, whole_characters(text, removed_spans(lo, hi))).decode() if lo else text.decode() for rows in _parts_of(b, los, his) for text, lo, hi in rows], pa.string())

    field = lambda c: F.col("row").getField(c)
    text = F.when(field(text_col).isNotNull(), kept("b", "los", "his"))
    return _with_runs(docs, text_col).select(*[(text if c == text_col else field(c)).alias(c) for c in docs.columns])
