"""The operators against brute force on a small table that holds the awkward cases."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, fingerprints, license_scan, mixing, ngram_lm, simhash, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, source string, n_words string, low string, size string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 90)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 5, 30, 200, 900)]
    texts += [None, "", " \t\n ", "A" * 700, "ab" * 400, passage, "x " + passage + " y", passage[7:] + prose(rng, 40), passage + " " + passage]
    texts += [texts[8]] * 3 + [texts[8].replace("é", "e", 1), texts[7].upper(), "MIT License and the GNU general, public LICENSE. cc by! apache license mit license", "permit license", "word\x00word  \x0bend"]
    out = [(i, t, ("a", "b", None)[i % 3], "n", "l", "s") for i, t in enumerate(texts)]
    return [*out, (3, texts[3], "a", None, None, None), (None, passage, "b", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(result, *columns):
    return Counter(tuple(r[c] for c in columns) for r in result.collect())


def test_token_counts(docs, rows, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [*(r[1] for r in rows), "a<|endoftext|> b<|endoftext|>", "I'll  go\x1c  ", "日本語 ١٢٣ ½ …!!\n\n  x", "a" * 3000]
    count = token_counts.Counter(path).count
    assert [count(t) for t in texts] == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 512) for r in rows)
    assert by_row(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, path).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, rows, empty):
    fp = [brute_fingerprint(r[1]) for r in rows]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(rows))]
    names = {c: min((rows[i][0] for i in range(len(rows)) if least[i] == c and rows[i][0] is not None), default=None) for c in least}
    want = Counter((rows[i][0], f"{fp[i]:016x}", names[least[i]]) for i in range(len(rows)))
    assert by_row(simhash.near_duplicates(docs, rounds=2), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty, rounds=1).count() == 0


def test_ball_links_reach_every_close_pair(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        flips = rng.sample(range(64), rng.randint(1, 4))
        values.append(v ^ sum(1 << b for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.node: r.component for r in simhash.connected_components(simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long"), rounds=4)).collect()}
    for a in signed:
        for b in signed:
            if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                assert got[a] == got[b]
    assert len(set(got.values())) == 20


def test_links_lie_in_few_files(spark, monkeypatch):
    rng, written = random.Random(4), {}
    values = [v ^ flip for v in (rng.getrandbits(63) for _ in range(150)) for flip in (0, 3)]
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", 30_000)  # 11 groups a round
    plain = simhash.materialize

    def counted(df, name):
        out, path = plain(df, name)
        written[name] = len(out.inputFiles())
        return out, path

    monkeypatch.setattr(simhash, "materialize", counted)
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fp long"), rounds=2)
    got = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert got == {v: min(v, v ^ 3) for v in values}
    assert written == {"links0": 1, "links1": 1, "links": 1}


def test_components_of_repeated_edges_and_loops(spark):
    edges = [(5, 2), (2, 5), (5, 2), (7, 7), (9, 5), (4, 3), (3, 3), (1, 9)]
    got = simhash.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (9, 1)]
    assert simhash.connected_components(spark.createDataFrame([(7, 7)], "src long, dst long")).count() == 0


def test_licenses(docs, rows, empty):
    def brute(text):
        words = WORD.findall(lower(text))
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    got = license_scan.scan(docs)
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r[0], *brute(r[1])) for r in rows)
    for r in got.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert not any(a != b and a.lo <= b.lo and b.hi <= a.hi for a in r.kept for b in r.kept)
    assert license_scan.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "label"), [("SPDX-License-Identifier: MIT", "mit"), ("GNU General Public License version 3", "gpl-3"), ("Apache License, Version 2.0.", "apache-2.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("the 3-clause BSD license", "bsd-3-clause"), ("All rights reserved", "all-rights-reserved"), ("Eclipse Public License 2.0", "epl-2")])
def test_license_labels(spark, text, label):
    df = spark.createDataFrame([(1, "some words " + text)], "doc_id long, text string")
    assert label in license_scan.scan(df).first().labels.split(",")


def test_every_rule_passes_the_gate():
    for _, keyword, _, regex, _ in license_scan.rules():
        plain = regex.replace(license_scan._W, " ").replace("licen[cs]", "licenc")
        assert re.compile(regex) and any(g in keyword or g in plain for g in license_scan.GATE), (keyword, regex)
    assert len(license_scan.rules()) > 200


def test_contamination(spark, docs, rows, empty):
    words = WORD.findall(lower(rows[8][1]))
    bench = [(1, " ".join(words[10:40])), (2, "! ".join(words[200:212]).upper()), (10, " ".join(words[300:303])), (11, ""), (12, None), (13, "none of these words"), (1, " ".join(words[10:40]))]

    def brute(text):
        w, hit, items = WORD.findall(lower(text)), set(), set()
        for item, t in bench:
            q = WORD.findall(lower(t))
            for i in range(max(1, len(q) - 7) if q else 0):
                win = q[i : i + 8]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        items.add(str(item))
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2

    table = spark.createDataFrame(bench, "item_id long, text string")
    want = Counter((r[0], *brute(r[1])) for r in rows)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(decontaminate.contamination(docs, table), *columns) == want
    blocks = decontaminate.find_matches(docs.select("doc_id", "text"), table, block_bytes=1).select("doc_id", F.size("_found.hit").cast("long").alias("n"))
    assert by_row(blocks, "doc_id", "n") == Counter((k[0], k[2]) for k in want.elements())
    assert decontaminate.contamination(empty, table).count() == 0
    none = decontaminate.contamination(docs, table.filter("false"))
    assert {r.n_items for r in none.collect()} == {0}
    assert decontaminate.decontaminate(docs, table).columns == docs.columns


def test_longest_matches_have_locations(spark):
    found = decontaminate.find_matches(spark.createDataFrame([("a b c d e f g h i j x a b c d e f g h",)], "text string"), spark.createDataFrame([(7, "Z a b c d e f g h i j")], "item_id long, text string"))
    assert [tuple(m) for m in found.first()._found.matches] == [("7", 0, 10), ("7", 11, 8)]


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://NET/", "https://m.example.net/en/1?q", "http://example.net/english", "http://x.example.com/de/#f", "http://example.com/de", "http://a.org/fr/", "http://anet/", "http://a.net", "ftp://h?x/y", None, "no scheme", "http://"]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["net/", "net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None]
    assert (got[9].host, got[9].path) == ("h", "") and (got[10].host, got[11].host) == ("", "") and got[2].path == "/en/1"
    assert got[2].verdict == "allow" and got[0].verdict == "block"
    learned = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)], "page_id long, url string")
    right = [(r.verdict == "block") == bool(url_filter.LABELLED[r.page_id][1]) for r in url_filter.judge_urls(learned, rules=()).collect()]
    assert sum(right) >= 0.95 * len(right)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(dict(sizes))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and r.copies in (math.floor(r.target / r.source_size), math.ceil(r.target / r.source_size))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(empty).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 50))").alias("text"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("source"))
    near = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.02 * r.g + 60 for r in near)
    out = mixing.mixed_rows(docs)
    assert out.columns == [*docs.columns, "copy_no"] and out.count() == sum(r.copies for r in got)


def brute_removed(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        yield gone


def test_suffix_dedup(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, brute_removed(texts), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want[r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert by_row(suffix_dedup.repeat_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.repeat_digest(empty).count() == 0
    stripped = suffix_dedup.strip_repeats(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(rows)


def test_texts_longer_than_a_step(spark, monkeypatch):
    rng = random.Random(1)
    a = bytes(rng.choice(b"abcd") for _ in range(5000))
    texts = [a, a[1000:1700] + b"z" * 10 + a[4000:4199], bytes(rng.choice(b"abcd") for _ in range(900)) + a[300:900]]
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    suffix_dedup._tables.cache_clear()
    whole = {(k, int(h), int(p)) for owner, hs, at, _, _ in suffix_dedup.text_anchors(texts) for k, h, p in zip(owner, hs, at, strict=True)}
    monkeypatch.setattr(suffix_dedup, "STEP", 1 << 20)
    suffix_dedup._tables.cache_clear()
    assert whole == {(k, int(h), int(p)) for owner, hs, at, _, _ in suffix_dedup.text_anchors(texts) for k, h, p in zip(owner, hs, at, strict=True)}


def test_deep_shallow_sorting():
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    strings = list({base[: rng.randint(0, 120)] + bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randint(0, 20))) for _ in range(300)})
    order, lcp = suffix_dedup.deep_shallow(strings)
    assert [strings[k] for k in order] == sorted(strings)
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        assert lcp[i] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_language_model(spark, docs, rows, empty):
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*(w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w), None]
    train = [tokens(r[1]) for r in rows if not held(r[0])]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    cont, context = Counter(b for _, b in bi), Counter()
    for (u, _), c in bi.items():
        context[u] += c
    of = lambda counts: [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
    d, dk = ngram_lm.discounts(of(bi)), ngram_lm.discounts(of(cont))
    cut = lambda c, x: 0 if not c else x[min(c, 3) - 1]
    back = sum(cut(c, dk) for c in cont.values()) / len(bi)
    lowest = lambda w: max(cont[w] - cut(cont[w], dk), 0) / len(bi) + back / (v + 1)
    gamma = Counter()
    for (u, _), c in bi.items():
        gamma[u] += cut(c, d)
    prob = lambda u, w: (max(bi[u, w] - cut(bi[u, w], d), 0) + gamma[u] * lowest(w)) / context[u] if context[u] else lowest(w)
    words = [*uni, "unseen"]
    assert math.isclose(sum(prob(next(iter(uni)), w) for w in words), 1, rel_tol=1e-9)
    want = {}
    for r in rows:
        t = tokens(r[1])
        want[r[0], r[1]] = (held(r[0]), len(t), sum(w in uni for w in t), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(prob(u, w)) for u, w in zip(["<s>", *t[:-1]], t, strict=True)))
    got = ngram_lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    left = Counter({})
    for r in got:
        own = [w for (i, _), w in want.items() if i == r.doc_id]
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) and math.isclose(r.score, w[5], rel_tol=1e-9) for w in own), (r, own, left)
    assert ngram_lm.score_documents(empty).count() == 0


def test_fingerprints(docs, rows, empty, spark):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in order]
    got = fingerprints.fingerprint_edits(docs).collect()
    follow = texts[1:] + texts[:1]
    want = Counter((r[0], len(t), hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest()) for r, t, f in zip(order, texts, follow, strict=True))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    marks = dict(zip(texts, fingerprints.sketches([t.encode() for t in texts]), strict=True))
    assert {r.fingerprint for r in got} == {m.tobytes().hex() for m in marks.values()}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(4)
    body = prose(rng, 400).encode()
    a, b, other = fingerprints.sketches([b"x" * 17 + body, b"zz" + body, prose(rng, 400).encode()])
    assert fingerprints.likeness(a, b) > 0.85 and fingerprints.likeness(a, other) < 0.2


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilewort", "grimsack", "foulbeck"]
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w.title())
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (None, "a vilewort"), (1001, "")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, table).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) and len(got) == len(rows) + 3
    texts = dict(rows)
    spans = [texts[r.doc_id][s.start : s.end].lower() for r in got if r.doc_id in texts for s in r.spans]
    assert len(spans) >= 100 and sum(any(w in x for w in bad) for x in spans) >= 0.8 * len(spans)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {0.0}
    none = toxicity.score_documents(docs, table.filter("false"))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.score_documents(docs.filter("false"), table).count() == 0


@pytest.mark.parametrize(("text", "label"), [
    ("under the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version", "gpl-3+"),
    ("All\nrights reserved", "all-rights-reserved"), ("provided as\nis, without warranty", "no-warranty"), ("released into the public\ndomain", "public-domain"),
    ("Neither\nthe name of X\nnor the names of its contributors", "bsd-3-clause"), ("proprietary and confidential,\nsee the license", "proprietary"), ("Creative-Commons Attribution", "cc-by"),
])
def test_wrapped_licenses(spark, text, label):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert label in license_scan.scan(df).first().labels.split(",")


def test_toxicity_short_texts_and_last_words():
    rng = random.Random(7)
    plain = [f"calm{k}" for k in range(40)]
    short = [(" ".join(rng.choices(plain, k=5) + ["vilewort"] * (k % 4 == 0)), k % 4 == 0) for k in range(120)]
    # 20 words, the offending one last: beyond the only full piece
    tails = [(" ".join(rng.choices(plain, k=19) + ["vilewort" if k % 4 == 0 else "end"]), k % 4 == 0) for k in range(120)]
    for rows in (short, tails):
        field = toxicity.fit(rows)
        scores = [field.score(o) for o in toxicity.Tagger(field).log_odds([t for t, _ in rows])]
        assert [p >= toxicity.CUTOFF for p in scores] == [y for _, y in rows]


def test_toxicity_late_passages(spark):
    rng = random.Random(8)
    plain = [f"calm{k}" for k in range(60)]
    rows = [(k, " ".join([*rng.choices(plain, k=1200), *["vilewort"] * (k % 4 == 0), *rng.choices(plain, k=5)])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert {r.doc_id: r.predicted for r in got} == {k: int(k % 4 == 0) for k, _ in rows}
    # a bound on bytes leaves out rows, never parts of them
    sample = toxicity.sample_rows(docs, labels, F.lit(True), most=30_000)
    assert {len(h.words) for h, _ in sample} <= {1205, 1206} and 2 < len(sample) < 80 and {y for _, y in sample} == {False, True}


def test_toxicity_many_rare_words():
    rng = random.Random(9)
    plain = [f"calm{k}" for k in range(300)]
    bad = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60)]
    # each offending word in 8 of 480 toxic texts
    rows = [(" ".join([*rng.choices(plain, k=20), bad[k % 60]]), True) for k in range(480)] + [(" ".join(rng.choices(plain, k=21)), False) for _ in range(900)]
    field = toxicity.fit(rows)
    scores = [field.score(o) for o in toxicity.Tagger(field).log_odds([t for t, _ in rows])]
    assert sum((p >= toxicity.CUTOFF) == y for p, (_, y) in zip(scores, rows, strict=True)) >= 0.98 * len(rows)
