"""Benchmark decontamination with suffix arrays over the training texts.

The documents are cut into shards. In each shard the words of the benchmark get numbers
(every other word gets 0 and cannot match) and the suffixes that start with enough numbered
words are put into a suffix array: sorted by a first column of packed words, ties again by
the next column, until no two are equal or the longest item's length is reached. Every
distinct suffix of the benchmark is then looked up by binary search. The range of its first
``n`` words holds all places where they stand; ranges are marked at their two ends, so no
pair of window and place is made. Documents stay whole inside a shard, so no shuffle is needed.

For a document and an item that share a window, ``find_matches`` also gives the longest
verbatim matches with their locations: all that can be extended to neither side.

The benchmark is the stated query set. It is cut into blocks of at most ``block_bytes`` of
text (one item at least). One block is broadcast and searched in one pass. If there are more,
each is broadcast, searched, its findings written by hash of the text, and dropped before the
next; the findings, rows of matching texts alone, are joined to the documents at the end.

Defined cases: null texts have no words; an item under n words is one window; an item
without words never matches; a null item_id counts as the empty text among item ids;
repeated items with one id count once; a shard never joins words of two documents; an
empty benchmark matches nothing; an empty table gives an empty result; a text is searched
whole, in memory of some 100 bytes a word. ``decontaminate`` passes columns of any name
through; ``find_matches`` takes a name for its struct, and refuses one that is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, ALNUM_WORD, byte_slices, fresh_name, materialize, remove, utf8

#: Bytes of text in a shard of the training data.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


@dataclass
class QueryBlock:
    """Items of one block as numbered words, and their distinct suffixes."""

    items: list[str]
    numbers: dict[bytes, int]
    texts: list[np.ndarray]  # of each item, its words
    words: np.ndarray  # of all items, each followed by zeros
    starts: np.ndarray  # where each distinct window starts
    sizes: np.ndarray  # and how many words it has
    owners: list[np.ndarray]  # which items hold it

    @property
    def bits(self) -> int:
        return max(1, len(self.numbers).bit_length())


def query_block(items: list[tuple[str, bytes]], n: int) -> QueryBlock:
    numbers: dict[bytes, int] = {}
    texts, words = [], []
    windows: dict[tuple[int, ...], tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        own = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        texts.append(np.array(own, np.int64))
        for i in range(max(1, len(own) - n + 1) if own else 0):
            at, owners = windows.setdefault(tuple(own[i : i + n]), (len(words) + i, []))
            if not owners or owners[-1] != k:
                owners.append(k)
        words += [*own, *[0] * n]
    return QueryBlock(
        [x for x, _ in items], numbers, texts, np.array(words, np.int64), np.array([at for at, _ in windows.values()], np.int64),
        np.array([len(w) for w in windows], np.int64), [np.array(o, np.int64) for _, o in windows.values()],
    )


def packed(words: np.ndarray, starts: np.ndarray, first: int, bits: int, ends: np.ndarray | int) -> np.ndarray:
    """Words ``first`` and following of each suffix as one number that compares like them; 0 from its end on."""
    column = np.zeros(len(starts), np.int64)
    for j in range(first, first + 63 // bits):
        at = np.minimum(starts + j, len(words) - 1)
        column = (column << bits) | np.where(starts + j < ends, words[at], 0)
    return column


@dataclass
class SuffixArray:
    """Suffixes of a shard in order, as words up to the next 0, ``longest`` words at most."""

    words: np.ndarray
    starts: np.ndarray
    first: np.ndarray  # the first column of each suffix


def suffix_array(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, longest: int) -> SuffixArray:
    """starts in order of their suffixes; ends says where each one's words end."""
    each = 63 // bits
    first = packed(words, starts, 0, bits, ends)
    order = np.argsort(first, kind="stable")
    starts, ends, column = starts[order], ends[order], first[order]
    group = np.concatenate(([0], np.cumsum(column[1:] != column[:-1]))) if len(starts) else np.empty(0, np.int64)
    for depth in range(each, longest, each):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(tied):
            break
        more = packed(words, starts[tied], depth, bits, ends[tied])
        if not more.any():
            break
        again = np.lexsort((more, group[tied]))
        starts[tied], ends[tied] = starts[tied][again], ends[tied][again]
        more, own = more[again], group[tied]
        new = np.zeros(len(group), np.int64)
        new[tied[1:]] = (own[1:] == own[:-1]) & (more[1:] != more[:-1])
        group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (new[1:] > 0))))
    return SuffixArray(words, starts, packed(words, starts, 0, bits, ends))


def search(found: SuffixArray, words: np.ndarray, starts: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every wanted window of ``size`` words; the range [lo, hi) of suffixes that begin with it."""
    each = 63 // bits
    if size <= each:  # the first column alone tells
        low = packed(words, starts, 0, bits, starts + size)
        high = low | ((1 << bits * (each - size)) - 1)
        return np.searchsorted(found.first, low, "left"), np.searchsorted(found.first, high, "right")
    bounds = []
    for right in (False, True):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(found.starts), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = found.starts[np.minimum(mid, len(found.starts) - 1)]
            before, equal = np.zeros(len(starts), bool), np.ones(len(starts), bool)
            for depth in range(0, size, each):
                theirs = packed(found.words, at, depth, bits, at + size)
                ours = packed(words, starts, depth, bits, starts + size)
                before |= equal & (theirs < ours)
                equal &= theirs == ours
            go_right = open_ & (before | (equal & right))
            lo, hi = np.where(go_right, mid + 1, lo), np.where(open_ & ~go_right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


@dataclass
class Shard:
    """What a block's items have in common with some texts."""

    words: list[np.ndarray]  # numbered words of each text
    hits: list[np.ndarray]  # words inside an occurring window
    items: list[np.ndarray]  # items of which a window occurs


def search_shard(texts: list[bytes], block: QueryBlock, n: int) -> Shard:
    get, words = block.numbers.get, []
    for t in texts:
        own = words_of(t)
        words.append(np.fromiter((get(w, 0) for w in own), np.int64, len(own)))
    none = [np.empty(0, np.int64)] * len(texts)
    counts = np.array([len(w) for w in words], np.int64)
    if not len(block.starts) or not counts.sum():
        return Shard(words, none, none)
    firsts = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
    flat = np.concatenate([x for w in words for x in (w, np.zeros(1, np.int64))])
    gaps = np.flatnonzero(flat == 0)
    known = np.flatnonzero(flat)
    ends = gaps[np.searchsorted(gaps, known)]
    longest = max(len(t) for t in block.texts)
    enough = ends - known >= block.sizes.min()  # shorter runs of known words hold no window
    array = suffix_array(flat, known[enough], ends[enough], block.bits, longest)
    doc = np.searchsorted(firsts, array.starts, "right") - 1
    delta = np.zeros(len(flat) + 1, np.int64)
    pairs = []
    for size in np.unique(block.sizes).tolist():
        which = np.flatnonzero(block.sizes == size)
        lo, hi = search(array, block.words, block.starts[which], size, block.bits)
        which, lo, hi = which[lo < hi], lo[lo < hi], hi[lo < hi]
        if not len(which):
            continue
        # windows of one size are distinct, so their ranges are apart
        order = np.argsort(lo)
        which, lo, hi = which[order], lo[order], hi[order]
        lengths = hi - lo
        place = np.repeat(lo - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(lengths.sum())
        np.add.at(delta, array.starts[place], 1)
        np.add.at(delta, array.starts[place] + size, -1)
        seen = np.unique(np.stack((doc[place], np.repeat(which, lengths)), axis=1), axis=0)
        for d, w in seen.tolist():
            pairs.append((d, block.owners[w]))
    hit = np.flatnonzero(np.cumsum(delta) > 0)
    hit_doc = np.searchsorted(firsts, hit, "right") - 1
    cuts = np.searchsorted(hit_doc, np.arange(len(texts) + 1))
    found: dict[int, list[np.ndarray]] = {}
    for d, owners in pairs:
        found.setdefault(d, []).append(owners)
    items = [np.unique(np.concatenate(found[d])) if d in found else none[0] for d in range(len(texts))]
    return Shard(words, [hit[a:b] - firsts[k] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], items)


def longest_matches(text: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first word, words) of all matches of n words or more (or a whole shorter item) that can be extended to neither side."""
    size = min(n, len(item))
    starts: dict[bytes, list[int]] = {}
    for j in range(len(item) - size + 1):
        starts.setdefault(item[j : j + size].tobytes(), []).append(j)
    out = set()
    for p in range(len(text) - size + 1):
        for j in starts.get(text[p : p + size].tobytes(), ()):
            if p and j and text[p - 1] == item[j - 1]:
                continue  # it began before
            most = min(len(text) - p, len(item) - j)
            differ = np.flatnonzero(text[p : p + most] != item[j : j + most])
            out.add((p, int(differ[0]) if len(differ) else most))
    return sorted(out)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark, streamed through the driver block by block."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        text = row.text.encode()
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    yield held


_FOUND = "struct<n_words:long,matches:array<struct<item_id:string,first_word:long,n_words:long>>,items:array<string>,hit:array<long>>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))), ("items", pa.list_(pa.string())), ("hit", pa.list_(pa.int64())),
])


def _searcher(spark: SparkSession, items: list[tuple[str, bytes]], n: int, located: bool):
    """A function of a text column that gives what the items of a block have in common with it, and the broadcast block."""
    shared = spark.sparkContext.broadcast(items)  # at most block_bytes of text

    @F.arrow_udf(_FOUND)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = query_block(shared.value, n)
        for array in arrays:
            out = []
            for batch in byte_slices(pa.RecordBatch.from_arrays([array], ["text"]), "text", SHARD_BYTES):
                shard = search_shard(utf8(batch, "text"), block, n)
                for words, hits, own in zip(shard.words, shard.hits, shard.items, strict=True):
                    ids, matches = sorted({block.items[k] for k in own.tolist()}), []
                    if located:
                        got = {(a, m, block.items[k]) for k in own.tolist() for a, m in longest_matches(words, block.texts[k], n)}
                        matches = [{"item_id": i, "first_word": a, "n_words": m} for a, m, i in sorted(got)]
                    out.append({"n_words": len(words), "matches": matches, "items": ids, "hit": hits.tolist()})
            yield pa.array(out, _FOUND_ARROW)

    return run, shared


def find_matches(docs: DataFrame, benchmark: DataFrame, n: int = 8, text_col: str = "text", block_bytes: int = BLOCK_BYTES, found_col: str = "_found", located: bool = True) -> DataFrame:
    """docs plus a struct column (n_words, matches, items, hit): longest matches (if located), item ids and hit words."""
    if fresh_name(docs.columns, found_col) != found_col:
        raise ValueError(f"the table has a column {found_col!r} already")
    spark, text = docs.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blocks = _blocks(benchmark, block_bytes)
    items, following = next(blocks), next(blocks, None)
    if following is None:
        return docs.withColumn(found_col, _searcher(spark, items, n, located)[0](text))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    found, paths = None, []
    while items is not None:
        run, shared = _searcher(spark, items, n, located)
        own = keyed.select("k1", "k2", run("text").alias("f")).filter(F.size("f.items") > 0)
        part, path = materialize(own.dropDuplicates(["k1", "k2"]), "block_matches")
        shared.destroy()
        paths.append(path)
        found = part if found is None else found.unionByName(part)
        items, following = following, next(blocks, None)
    lists = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"f.{c}")))) for c in ("items", "hit")}
    matches = F.array_sort(F.flatten(F.collect_list("f.matches")), lambda a, b: F.when(a["first_word"] < b["first_word"], -1).when(a["first_word"] > b["first_word"], 1).otherwise(0))
    merged, _ = materialize(found.groupBy("k1", "k2").agg(matches.alias("matches"), *[x.alias(c) for c, x in lists.items()]), "matches")
    for path in paths:
        remove(spark, path)
    count = F.regexp_count(text, F.lit(ALNUM_WORD)).cast("long").alias("n_words")
    none = F.struct(count, *[F.array().cast(kind).alias(c) for c, kind in (("matches", "array<struct<item_id:string,first_word:long,n_words:long>>"), ("items", "array<string>"), ("hit", "array<long>"))])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), none.alias("none"))
    joined = rows.join(merged.select("k1", "k2", "matches", "items", "hit"), ["k1", "k2"], "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.struct("none.n_words", *[F.coalesce(c, F.col("none")[c]).alias(c) for c in ("matches", "items", "hit")]).alias(found_col))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n, located=False)
    items = F.col("_found.items")
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), F.size("_found.hit").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.size(items) >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold words of at least min_items items."""
    name = fresh_name(docs.columns, "_found")
    found = find_matches(docs, benchmark, n, text_col, found_col=name, located=False)
    return found.filter(F.size(F.col(name)["items"]) < min_items).drop(name)
