"""Awkward tables, and parts of operators against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import brute_removed, lower, prose

from pagewright.llm import decontaminate, fingerprints, license_scan, mixing, ngram_lm, simhash, suffix_dedup, toxicity, url_filter
from pagewright.llm.common import fresh_name, keep, materialize, scratch

#: Names that the operators use themselves.
CLASHING = ("runs", "k1", "k2", "b", "row", "_tox", "_found", "_kept", "copy_no", "no", "size", "salt", "h", "fp", "kept", "words")


@pytest.fixture(scope="module")
def table(spark):
    """Nulls in any column, repeated rows and ids, a long text, copies, and clashing names."""
    rng = random.Random(11)
    passage, long = prose(rng, 70), prose(rng, 20_000)
    texts = [None, "", passage, "x " + passage, passage, prose(rng, 40), long, long + " z", "vilewort " * 5, None]
    rows = [(None if i in (4, 9) else i // 2, t, None if i % 3 == 0 else "s", *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], rows[2]], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def few(spark):
    items = spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (None, 1), (2, None), (4, 1), (4, 1)], "doc_id long, toxic int")
    return items, labels


def operators(items, labels):
    return [
        ("drop_toxic", lambda t: toxicity.drop_toxic(t, labels)), ("keep_first", lambda t: simhash.keep_first(t)), ("strip_repeats", lambda t: suffix_dedup.strip_repeats(t)),
        ("decontaminate", lambda t: decontaminate.decontaminate(t, items)), ("mixed_rows", lambda t: mixing.mixed_rows(t)),
    ]


@pytest.mark.parametrize("which", range(5))
def test_columns_of_any_name_pass(table, few, which):
    name, run = operators(*few)[which]
    out = run(table)
    columns = [*table.columns, fresh_name(table.columns, "copy_no")] if name == "mixed_rows" else table.columns
    assert out.columns == columns
    rows = out.collect()
    whole = {r[3:19] for r in table.collect()}
    assert {r[3:19] for r in rows} <= whole and (name != "strip_repeats" or len(rows) == table.count())
    assert run(table.filter("false")).count() == 0


def test_scratch_removes_what_is_not_kept(spark):
    import os

    paths = []
    with scratch(spark):
        for name in ("a", "b"):
            paths.append(materialize(spark.range(3), name)[1])
        keep(paths[1])
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True]


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_lose_no_repeat(spark, hot):
    rng = random.Random(12)
    line = prose(rng, 60)
    around = [prose(rng, 30) for _ in range(4)]
    # one passage between surroundings that share a little, much or all with others
    texts = [a[: rng.randint(0, 90)] + line + b[: rng.randint(0, 90)] for a in around for b in around for _ in range(2)] + [line * 2, around[0] + line]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeat_digest(docs, hot=hot).collect()}
    want = {}
    for i, gone in enumerate(brute_removed([t.encode() for t in texts])):
        want[i] = (sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])))
    assert got == want


def test_pieces_hold_every_window_once():
    rng = random.Random(13)
    for level in range(9):
        left = rng.randint(0, 136)
        least = rng.randint(0, left)
        seg = bytes(rng.randrange(256) for _ in range(left + 200 - least))
        seen = []
        for _, shared, piece, own in suffix_dedup.pieces(seg, left, level):
            windows = len(piece) - 199
            seen += range(own - windows + 1, own + 1)
            assert shared in piece and len(shared) <= 200
        assert sorted(seen) == list(range(least, left + 1))


def test_marginals_and_gradients(monkeypatch):
    rng = np.random.default_rng(14)
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    pairs = rng.normal(size=(2, 2))
    texts = [rng.normal(size=n) * 2 for n in (0, 1, 2, 3, 4, 6, 7, 9)]

    def weight(e, tags):
        return math.exp(sum(x for x, t in zip(e, tags, strict=True) if t) + sum(pairs[p] for p in itertools.pairwise(tags)))

    for e, got in zip(texts, toxicity.marginal_odds(texts, pairs), strict=True):
        z = np.zeros((len(e), 2))
        for tags in itertools.product((0, 1), repeat=len(e)):
            for i, t in enumerate(tags):
                z[i, t] += weight(e, tags)
        assert np.allclose(np.log(z[:, 1] / z[:, 0]) if len(e) else [], got)
    # expectations of a padded piece are those of its live words: tags less marginals, and pairs
    n = 5
    e = np.zeros((1, toxicity.PIECE))
    e[0, :n] = rng.normal(size=n)
    y, live = np.zeros((1, toxicity.PIECE), bool), np.zeros((1, toxicity.PIECE), bool)
    y[0, 1], live[0, :n] = True, True
    missed, expected = toxicity._expectations(e, pairs, y, live)
    total, marginal, both = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        w = weight(e[0, :n], tags)
        total += w
        marginal += w * np.array(tags)
        for p in itertools.pairwise(tags):
            both[p] += w
    assert np.allclose(missed[0, :n], y[0, :n] - marginal / total, atol=1e-5) and not missed[0, n:].any()
    assert np.allclose(expected, both / total, atol=1e-5)


def test_a_repeated_id_teaches_one_text(spark):
    docs = spark.createDataFrame([(i % 40, f"calm{i} words" + " vilewort" * (i % 4 == 0)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    runs = [sorted((h.mark, y) for h, y in toxicity.sample_rows(docs.repartition(n), labels, F.lit(True))) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 40


SENTENCES = (
    "Released under CC BY SA for all.", "CC BY 4.0", "cc-by-nc-sa 2.5", "Licensed under the Apache License, Version 2.0 (the \"License\")", "apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MIT", "GNU Lesser General Public License version 2.1", "the 3-clause BSD license", "BSD 2-Clause", "MIT License",
    "released under the MIT", "All rights reserved", "Copyright (c) 2019 Someone", "provided as is, without warranty", "Mozilla Public License 2.0", "open data commons open database licence",
    "placed in the public domain", "https://creativecommons.org/licenses/by-nd/4.0/", "Creative Commons Attribution ShareAlike 3.0", "Q Public License", "the Unlicense", "end-user license agreement",
    "GNU General Public License as published by\nthe Free Software Foundation; either version 2, or (at your option) any later version", "You may not use this file except in compliance with the License.",
    "This Source Code Form is subject to the terms of the Mozilla Public License", "account by accident", "GPLv3", "distributed under GPL", "modified BSD licence", "cc0", "isc license and zlib license",
)


def brute_licenses(text):
    """Labels and score, rule by rule, with plain loops."""
    low, found = lower(text), []
    for label, _, priority, regex, confidence in license_scan.rules():
        found += [(priority, m.start(), -m.end(), m.end(), label, confidence) for m in re.finditer(regex, low, re.ASCII)]
    kept = []
    for d in sorted(found):
        if not any(k[1] <= d[1] and d[3] <= k[3] for k in kept):
            kept.append(d)
    score = 1.0
    for d in kept:
        score *= 1 - d[5]
    return {d[4] for d in kept}, 1 - score


def test_license_labels_and_scores_by_brute_force(spark):
    rng = random.Random(15)
    texts = list(SENTENCES) + [" ".join(rng.choice((s, s.upper(), prose(rng, 3))) for s in rng.sample(SENTENCES, rng.randint(2, 6))) for _ in range(150)]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        labels, score = brute_licenses(texts[r.doc_id])
        own = {x for x in r.labels.split(",") if x}
        base = {x for x in r.base_labels.split(",") if x}
        assert own == labels | base and math.isclose(r.score, score, abs_tol=1e-12), (texts[r.doc_id], own, labels)
    # the longer of two detections of one priority from one start suppresses the other
    r = license_scan.scan(spark.createDataFrame([(1, "released under cc by sa for all")], "doc_id long, text string")).first()
    assert [(k.label, k.lo, k.hi) for k in r.kept] == [("cc-by-sa", 15, 23)]


def test_keywords_stand_in_what_rules_match(spark):
    """No keyword keeps a rule from what its own regex finds."""
    for label, keyword, _, regex, _ in license_scan.rules():
        for text in SENTENCES:
            for m in re.finditer(regex, lower(text), re.ASCII):
                words = " " + re.sub(license_scan._GAP, " ", lower(text)).strip() + " "
                assert keyword in words, (label, keyword, m[0])


def test_url_parts_and_rules_by_brute_force(spark):
    rng = random.Random(16)
    parts = ["http", "://", "Example.NET", "example.com", "m.", "org", "net", "/", "/en/", "/de/", "fr/", "?", "#", "x", "É"]
    urls = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(400)]

    def brute(url):
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = lower(rest[:cut])
            path = re.split("[?#]", rest[cut:], maxsplit=1)[0]
        best = None
        for rule, _ in url_filter.RULES:
            name, prefix = rule.split("/", 1)
            if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and len(rule) > len(best or ""):
                best = rule
        return host, path, best

    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        assert (r.host, r.path, r.rule) == brute(urls[r.page_id]), urls[r.page_id]
        assert r.rule is None or r.verdict == dict(url_filter.RULES)[r.rule]


def test_mixing_recomputes_prefix_sums(spark):
    """Copies are the integer boundaries that the running sum of expected copies crosses."""
    rng = random.Random(17)
    rows = [(i % 50, " ".join("w" * rng.randint(1, 30)), "hot" if i % 3 else "cold") for i in range(600)]
    got = mixing.expected_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("hot", "cold"):
        own = [r for r in got if r.source == source]
        step = own[0].target / own[0].source_size
        counts = Counter(r.copies for r in own)
        assert set(counts) <= {math.floor(step), math.ceil(step)} and abs(sum(r.copies for r in own) - step * len(own)) <= 1
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.05 * own[0].target


def test_matches_against_brute_force(spark):
    rng = random.Random(18)
    for _ in range(60):
        text, item = ([rng.randint(0, 2) for _ in range(rng.randint(0, 30))] for _ in range(2))
        size = min(3, len(item))
        want = set()
        for p in range(len(text)):
            for j in range(len(item)):
                n = 0
                while p + n < len(text) and j + n < len(item) and text[p + n] == item[j + n]:
                    n += 1
                if n >= size and not (p and j and text[p - 1] == item[j - 1]):
                    want.add((p, n))
        got = decontaminate.longest_matches(np.array(text, np.int64), np.array(item, np.int64), 3) if item else []
        assert got == sorted(want)


def test_suffix_array_and_search():
    rng = random.Random(19)
    for bits in (2, 9, 20):
        words = np.array([rng.randint(0, 3) for _ in range(400)] + [0], np.int64)
        gaps, known = np.flatnonzero(words == 0), np.flatnonzero(words)
        ends = gaps[np.searchsorted(gaps, known)]
        found = decontaminate.suffix_array(words, known, ends, bits, 400)
        end_of = dict(zip(known.tolist(), ends.tolist(), strict=True))
        suffixes = [words[s : end_of[s]].tolist() for s in found.starts.tolist()]
        assert suffixes == sorted(suffixes)
        for size in (1, 2, 3, 8, 40):
            wanted = np.array([rng.randint(1, 3) for _ in range(50)], np.int64)
            starts = np.arange(0, max(1, 50 - size))
            wanted = np.concatenate((wanted, np.zeros(size, np.int64)))
            lo, hi = decontaminate.search(found, wanted, starts, size, bits)
            for s, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
                own = wanted[s : s + size].tolist()
                assert [k for k, x in enumerate(suffixes) if x[:size] == own] == list(range(a, b))


def test_repeated_words_make_no_pairs(spark):
    block = decontaminate.query_block([("1", b"a " * 400)], 8)
    assert len(block.starts) == 1
    shard = decontaminate.search_shard([b"a " * 20_000, b"b"], block, 8)
    assert len(shard.hits[0]) == 20_000 and shard.items[0].tolist() == [0] and not len(shard.hits[1])


def test_blocks_agree_with_one_pass(spark, table, few):
    rng = random.Random(20)
    texts = [prose(rng, 60) for _ in range(6)]
    docs = spark.createDataFrame([(i, texts[i % 4] + " " + texts[(i + 1) % 4]) for i in range(12)], "doc_id long, text string")
    items = spark.createDataFrame([(i, t[20:200]) for i, t in enumerate(texts)], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.find_matches(docs, items, block_bytes=b).collect())) for b in (1 << 20, 100))
    assert one == many


def test_fingerprints_in_blocks_and_of_one_id(spark, monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, 300).encode(), b"a" * 500 + prose(rng, 50).encode()]
    want = fingerprints.sketches(texts)
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    assert (fingerprints.sketches(texts) == want).all()
    same = spark.createDataFrame([(None, prose(rng, 5)) for _ in range(200)], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(same).count() == 200


def test_language_model_in_many_groups(spark, monkeypatch):
    """Pairs of one first word lie in several groups; sums over them are those of one group."""
    rng = random.Random(22)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, "the " + " ".join(w for x in rng.choices(words, k=40) for w in ("the", x))) for i in range(40)], "doc_id long, text string").repartition(3)
    found = []
    for size in (1 << 20, 200):
        monkeypatch.setattr(ngram_lm, "GROUP_BYTES", size)
        found.append({r.doc_id: r.score for r in ngram_lm.score_documents(docs).collect()})
    assert all(math.isclose(found[0][k], found[1][k], rel_tol=1e-12) for k in found[0]) and len(found[0]) == 40
