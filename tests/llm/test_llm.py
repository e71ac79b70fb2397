"""The operators against brute force, exact round trips and held-out accuracy, with the odd inputs that all must take."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from conceptloom.llm import (
    decontamination, exact_dedup, language_id, licenses, mixing, simhash_dedup, suffix_tree, token_counts, toxicity, wrappers,
)
from conceptloom.llm.components import components
from conceptloom.scratch import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, size int, score string"


def docs_of(spark, rows):
    """Rows (id, text, lang, source), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, la, so, 1, "k", 7, "s") for i, t, la, so in rows], DOCS)


def prose(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(n))


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, "One two three", "en", "a"), (5, "one TWO three", "de", "a"),
    (5, "one TWO three", "de", "a"), (None, "one two three", "en", None), (7, "Ärger Öl 42", "de", "c"), (8, prose(1, 9000), "en", "c"),
    (9, "x" * 5000, "en", "a"), (10, "<|endoftext|> a <|endoftext|>", "en", "b"), (11, prose(2, 60), "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def answer(df, sql, docs):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    want = db.sql(sql)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted([tuple(r[c] for c in want.columns) for r in df.collect()], key=key)
    return got == sorted(want.fetchall(), key=key)


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd).collect()) == want
    assert token_counts.token_counts(empty).count() == 0
    encode = lambda x: t.encode(x, add_special_tokens=False)
    r = random.Random(3)
    pieces = ["the ", "a" * 300, "\n\n  ", "<|endoftext|>", "it's ", "123456", "é", "日本語テキスト", " !?", "\t", "don't<|endof"]
    for _ in range(30):
        text = "".join(r.choices(pieces, k=r.randint(1, 200)))
        for chunk, lap in ((200, 16), (500, 80)):
            assert token_counts.spliced_count(text, encode, chunk, lap) == len(encode(text).ids)


def test_token_counts_take_lengths_in_small_groups():
    """Groups stay within their size, whatever the texts' lengths, and no list of ids is asked for."""
    groups = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            groups.append(sum(map(len, texts)))
            return [range(len(t)) for t in texts]  # has a length, and no ids

    r = random.Random(9)
    texts = ["x" * r.choice([0, 1, 50, 90, 100, 130]) for _ in range(200)]
    assert token_counts.counts_of(Library(), texts, size=100) == [len(t) for t in texts]
    assert max(groups) == 130 and sum(g > 100 for g in groups) == sum(len(t) > 100 for t in texts)
    assert token_counts.counts_of(Library(), []) == []
    assert token_counts.GROUP <= token_counts.CHUNK


def test_suffix_tree(spark, odd, empty):
    docs = docs_of(spark, ODD + [(100 + i, prose(i % 4, 80), "en", "a") for i in range(60)])
    rows = suffix_tree.scores(spark, docs).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low)), "\n"]
    all_rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, x in all_rows if not held(i) for w in split(x))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, x in all_rows:
        w = split(x)
        want[i] = len(w), sum(y in c for y in w), n, round(float(sum(np.log10((c[y] + 1) / (n + v + 1)) for y in w)), 4)
    assert len(rows) == len(all_rows)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) == want[r.doc_id]
        assert r.held_out == held(r.doc_id) and r.score < 0
    known = [r for r in rows if r.doc_id and r.doc_id >= 100]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    assert suffix_tree.scores(spark, empty).count() == 0


def test_suffix_tree_is_a_distribution(spark):
    texts = docs_of(spark, [(i, prose(i % 3, 300), None, None) for i in range(9)]).select("text")
    tree = suffix_tree.learn_tree(Scratch(spark, "t"), texts)
    assert max(tree.states) > 1
    for context in (b"\0\0\0\0\0\0", b"ab cd ", b"zzzzzz", b"a bcde"):
        base = int.from_bytes(context[::-1], "big")
        codes = np.array([b << 8 * suffix_tree.DEPTH | base for b in range(256)], np.uint64)
        assert abs(tree.probabilities(codes).sum() - 1) < 1e-9


def test_suffix_tree_keeps_supported_contexts(spark, monkeypatch):
    """What is broadcast doesn't change the scores: no state is lost for a small share of all positions."""
    docs = docs_of(spark, ODD + [(100 + i, prose(i % 5, 200) + " caesar augustus", "en", "a") for i in range(60)])
    whole = {r.doc_id: r.score for r in suffix_tree.scores(spark, docs).collect()}
    for share in (0.001, 0.02, 1.0):
        monkeypatch.setattr(suffix_tree, "LEAST", share)
        part = {r.doc_id: r.score for r in suffix_tree.scores(spark, docs).collect()}
        assert part.keys() == whole.keys() and all(abs(part[i] - whole[i]) < 1e-6 for i in whole)
    tree, tail = suffix_tree.learn(Scratch(spark, "t"), docs.select(suffix_tree.whole_text().alias("text")))
    assert max(tree.states) == 0 and tail.count() > 100 and tail.agg({"total": "min"}).first()[0] >= suffix_tree.SUPPORT


def test_licenses(spark, odd, empty):
    docs = docs_of(spark, ODD + [
        (20, prose(5, 50) + "\nReleased under the MIT License.\n" + prose(6, 50), "en", "a"),
        (21, "Licensed under the APACHE License, version 2.0", "en", "a"), (22, "a license of the work under version", "en", "a"),
        (23, "This work is licensed under the GNU General Public License, version 3.", "en", "a"),
    ])
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(20, "MIT"), (21, "Apache-2.0"), (23, "GPL-3.0")}
    assert licenses.scan(empty).count() == 0


def test_licenses_compare_every_window():
    find = licenses.Templates(licenses.TEMPLATES, licenses.DICE).search
    mit = ('Permission is hereby granted, free of charge and without fee, to any person or organization obtaining a copy of this '
           'software and any associated documentation files (the "Software"), to deal in the Software without restriction')
    assert [m["license"] for m in find(f"{prose(1, 30)} {mit} {prose(2, 30)}")] == ["MIT"]
    both = "This work is licensed under the GNU General Public License, version 2. {} This project is licensed under the GNU General Public License, version 3"
    assert {m["license"]: round(m["dice"], 3) for m in find(both.format(prose(3, 30)))} == {"GPL-2.0": 1.0, "GPL-3.0": 0.9}
    r = random.Random(4)  # by definition, over all windows
    one = licenses.Templates([("X", "a b c d a b e f")], 0.8)
    grams = licenses.bigrams("a b c d a b e f".split())
    for _ in range(200):
        words = [r.choice("abcdef") for _ in range(9)] + "a b c d a b e f".split()[r.randrange(3):] + [r.choice("abcdef") for _ in range(4)]
        want = max(licenses.dice(licenses.bigrams(words[i:j]), grams) for i in range(len(words)) for j in range(i + 2, len(words) + 1))
        got = one.search(" ".join(words))
        assert [m["dice"] for m in got] == ([want] if want >= 0.8 else [])


def test_decontamination(spark, odd, empty):
    r = random.Random(1)
    items = [(k, prose(50 + k, r.randint(3, 40))) for k in range(12)] + [(20, None), (21, ""), (22, prose(50, 30)), (None, prose(77, 20))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = list(ODD)
    for i in range(60):
        item = (items[r.randrange(12)][1]).split()
        for _ in range(i % 4):
            item[r.randrange(len(item))] = "changed"
        rows.append((100 + i, prose(i, 30) + " " + " ".join(item) + " " + prose(i + 500, 20), "en", "a"))
    docs = docs_of(spark, rows)
    want = {}
    grams = lambda w: Counter(decontamination.shingles_of(w))
    for d, text, _, _ in rows:
        words = decontamination.words_of(text or "")
        for k, item in items:
            iw = decontamination.words_of(item or "")
            m = min(len(iw), len(words))
            if m:
                best = max(decontamination.similarity(grams(words[s : s + m]), grams(iw)) for s in range(len(words) - m + 1))
                if best >= 0.8:
                    want[d, k] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.matches(spark, docs, bench).collect()}
    assert got == want and len(want) > 20
    bad = {d for d, _ in want}
    kept = decontamination.clean(spark, docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_ in rows if d not in bad)
    assert decontamination.matches(spark, empty, bench).count() == 0
    assert decontamination.clean(spark, docs, bench.limit(0)).count() == len(rows)


def test_decontamination_blocks(spark):
    bench = spark.createDataFrame([(k, prose(k, 20)) for k in range(8)], "item_id bigint, text string")
    docs = docs_of(spark, [(k, prose(k, 20), "en", "a") for k in range(12)])
    find = decontamination.finders(spark, bench, block_bytes=200)
    assert len(find) > 1
    got = docs.select("doc_id", decontamination.found(find).alias("m")).collect()
    assert {r.doc_id for r in got if r.m} == set(range(8))


def test_toxicity(spark, odd, empty):
    r, bad = random.Random(2), ["vilezz", "grotz", "snarlk"]
    rows, labels = list(ODD), []
    for i in range(600):
        words, toxic = prose(1000 + i, 60).split(), i % 3 == 0
        if toxic:
            for b in r.choices(bad, k=3):
                words.insert(r.randrange(len(words)), b)
        rows.append((1000 + i, " ".join(words), "en", "a"))
        labels.append((1000 + i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10**9, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows)
    out = toxicity.scores(spark, docs, known).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    held = [(x.predicted, (x.doc_id - 1000) % 3 == 0) for x in out if x.held_out and x.doc_id >= 1000]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) > 0.95
    kept = toxicity.accepted(spark, docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(not x.predicted for x in out)
    assert toxicity.scores(spark, empty, known).count() == 0
    assert {x.score for x in toxicity.scores(spark, odd, known.limit(0)).collect()} == {0.0}


def test_mixing(spark, odd, empty):
    rows = ODD + [(200 + i, prose(i, 20 + i), "en", "abcdefg"[i % 7] if i % 9 else "a") for i in range(80)]
    docs = docs_of(spark, rows)
    mixed = mixing.mix(docs)
    out = mixed.collect()
    assert answer(mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "position"), mixing.SQL, docs)
    by = {}
    for x in out:
        by.setdefault(x.source, []).append(x)
        assert x.taken <= 3 * x.size and len(x.positions) == x.repeats
    for s, part in by.items():
        assert abs(sum(x.taken for x in part) - part[0].target) <= 1, s
    assert abs(sum(p[0].target for p in by.values()) - sum(x.size for x in out)) < 1e-6 * sum(x.size for x in out)
    places = [x.position for x in out if x.position is not None]
    assert places == sorted(places)
    assert mixing.mix(empty).count() == 0
    assert {x.taken for x in mixing.mix(docs_of(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()} == {0}


def test_mixing_schedule_inverts(spark):
    knots = ((0.0, 1.0), (0.4, 3.0), (1.0, 0.5))
    shares = spark.createDataFrame([(x / 50,) for x in range(51)], "y double")
    times = [r.t for r in shares.select(mixing._time(shares.y, knots).alias("t"), "y").orderBy("y").collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*knots, strict=True))
    demand = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
    assert np.allclose(np.interp(times, grid, demand / demand[-1]), np.arange(51) / 50, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/>Home</a></li><li>News</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>First &amp; <b>bold<p>second<br>line {n}</p>{extra}</article><div id="comments"><p>nice {n}</p></div>
<footer>&copy; site</footer>"""


def test_wrappers(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(title=f"Title {i}", n=i, extra="<ul><li>x</li><li>y</li></ul>" * (i % 3 == 0)))
            for i in range(20)]
    rows += [(90, None, None), (91, "", ""), (92, "http://h0.org", "<nav>only</nav>"), (93, "http://p.org/", "no markup at all"),
             (1, "http://h1.org/1", rows[1][2]), (None, "http://h1.org/2", rows[3][2]), (94, "http://d.org", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, host string, pages int")
    got = {r.page_id: r for r in wrappers.main_texts(spark, pages).collect()}
    for i in range(20):
        want = f"Title {i}\n\nFirst & bold\n\nsecond line {i}" + ("\n\nx\n\ny" if i % 3 == 0 else "")
        assert got[i].text == want and got[i].n_chars == len(want)
    assert got[90].text == got[91].text == got[92].text == "" and got[93].text == "no markup at all" and got[94].text == "deep"
    assert wrappers.main_texts(spark, pages).count() == len(rows) and wrappers.main_texts(spark, pages.limit(0)).count() == 0
    a, b = (wrappers.wrapper_of(wrappers.page_tree(x)) for x in ("<p>a<ul><li>x<li>y</ul>", "<p>b</p><h2>c</h2>"))
    assert wrappers.expression(wrappers.merged(a, b)) == "<p>#</>(<ul>(<li>#</>)+</>)?(<h2>text</>)?"


@pytest.mark.parametrize("page", [
    '<div class="layout with-sidebar"><article><p>the text</p></article></div>',
    '<div class="no-sidebar"><article><p>the text</p></article></div>',
    '<form id="aspnetForm"><article><p>the text</p></article></form>',
    '<div class="sidebar"><article><p>the text</p></article></div>',
    '<article><h2 class="section-header">the text</h2></article>', '<article><p class="notice">the text</p></article>',
    '<article><div class="legal-analysis">the text</div></article>', '<div class="overflow-hidden"><p>the text</p></div>',
    '<form><p>the text</p></form>',
    '<article><p>the text</p><p hidden>no</p><div style="display: none">no</div><div class="ads">no</div></article>',
    '<div class="comments"><article>no</article></div><article><p>the text</p></article>',
])
def test_wrappers_class_words_are_hints(page):
    assert wrappers.main_text(page, None) == "the text"


def test_wrappers_layouts(spark):
    """Each layout of a host has its own main region; template texts are told by place and text over different pages."""
    body = "<div class=bar><p>Subscribe today</p></div><div class=content><p>By Staff</p><p>{a}</p><ul><li>{b}</li><li>{c}</li></ul></div>"
    rows = [(i, "http://a.org/", f"<article><p>{prose(i, 60)}</p></article>") for i in range(12)]
    rows += [(20 + i, "http://a.org/", body.format(a=prose(50 + i, 5), b=prose(60 + i, 9), c=prose(70 + i, 9))) for i in range(4)]
    rows += [(40 + i, "http://copies.org/", "<div><p>same text</p></div>") for i in range(4)] + [(50, None, rows[0][2]), (51, None, "<p>null url</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(spark, pages).collect()}
    want = {i: prose(i, 60) for i in range(12)} | {40 + i: "same text" for i in range(4)} | {50: prose(0, 60), 51: "null url"}
    want |= {20 + i: "\n\n".join([prose(50 + i, 5), prose(60 + i, 9), prose(70 + i, 9)]) for i in range(4)}
    assert got == want


def sets_of(rows):
    out = []
    for _, text, _, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(prints, ids, sets=None):
    label = list(range(len(prints)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(prints)):
        for j in range(i):
            near = sets and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return {find(k): min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))}, find


def test_simhash(spark, odd, empty):
    import xxhash

    r, rows = random.Random(4), list(ODD)
    for i in range(150):
        words = prose(i % 12, 300).split()
        for _ in range(i % 5):
            words[r.randrange(len(words))] = "new"
        rows.append((300 + i, " ".join(words), "en", "a"))
    docs = docs_of(spark, rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [plain(x) for _, x, _, _ in rows]
    ids, find = brute_components(prints, [i for i, *_ in rows])
    want = Counter((i, f"{p:016x}", ids[find(k)]) for k, ((i, *_), p) in enumerate(zip(rows, prints, strict=True)))
    got = simhash_dedup.near_duplicates(spark, docs).collect()
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == want
    kept = simhash_dedup.survivors(spark, docs)
    assert kept.columns == docs.columns
    ids, find = brute_components(prints, [i for i, *_ in rows], sets_of(rows))
    assert {x.doc_id for x in kept.collect()} == {i for k, (i, *_) in enumerate(rows) if i == ids[find(k)]}
    assert simhash_dedup.survivors(spark, empty).count() == 0
    assert simhash_dedup.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("pairs", [64, 2])
def test_links_connect_like_brute_force(spark, pairs):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(6)]
    prints = sorted({s ^ sum({1 << r.randrange(64) for _ in range(k % 4)}) for k in range(240) for s in [seeds[k % 6]]})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    scratch = Scratch(spark, "links")
    edges = scratch.save(simhash_dedup.links(scratch, fps, pairs=pairs), "edges")
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= (2 if pairs == 64 else 2) for e in edges.collect())
    got = {x.node: x.label for x in components(scratch, edges).collect()}
    ids, find = brute_components(prints, signed)
    for k, p in enumerate(signed):
        group = [q for j, q in enumerate(signed) if find(j) == find(k)]
        assert got.get(p, p) == min(group)


@pytest.mark.parametrize("pairs", [64, 2])
def test_similar_texts_connect_like_brute_force(spark, pairs):
    r, rows = random.Random(8), list(ODD)
    for i in range(90):
        words = prose(i % 3, [30, 120, 240][i % 3]).split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"new{i}"
        rows.append((300 + i, " ".join(words), "en", "a"))
    docs = docs_of(spark, rows)
    scratch = Scratch(spark, "similar")
    marked = scratch.save(docs.select(
        simhash_dedup.F.md5(simhash_dedup._normal()).alias("node"), simhash_dedup.F.xxhash64(simhash_dedup._normal()).alias("fp"),
        simhash_dedup._sketch(simhash_dedup._normal()).alias("_s"), "doc_id"), "marked")
    edges = scratch.save(simhash_dedup.similar(scratch, docs, marked, pairs=pairs), "edges")
    got = {x.node: x.label for x in components(scratch, edges).collect()}
    print_of = {x.doc_id: x.fp for x in marked.collect()}
    prints = [1 << 3 * k for k in range(len(rows))]
    ids, find = brute_components([(p << 1) | p for p in prints], [i for i, *_ in rows], sets_of(rows))
    label = [got.get(print_of[i], print_of[i]) for i, *_ in rows]
    texts = {(t or "").lower() for _, t, _, _ in rows}
    assert len(set(label)) < len(texts) / 2
    for k in range(len(rows)):
        for j in range(k):
            if sets_of([rows[k]])[0] and sets_of([rows[j]])[0] and rows[k][0] and rows[j][0]:
                assert (label[k] == label[j]) == (find(k) == find(j)), (rows[k][0], rows[j][0])


def test_similar_texts_are_not_expanded_to_pairs(spark):
    """A group of n near copies makes a multiple of n candidate pairs, not n * (n - 1) / 2."""
    words, made = prose(3, 150).split(), []
    rows = [(i, " ".join([*words[:i], f"new{i}", *words[i + 1 :]]), "en", "a") for i in range(50)]

    class Recorder(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            if {"a", "b"} <= set(out.columns) and not name.startswith("component"):
                made.append(out.count())
            return out

    F, scratch = simhash_dedup.F, Recorder(spark, "similar")
    marked = scratch.save(docs_of(spark, rows).select(
        "doc_id", F.md5(simhash_dedup._normal()).alias("node"), F.xxhash64("text").alias("fp"),
        simhash_dedup._sketch(simhash_dedup._normal()).alias("_s")), "marked")
    edges = scratch.save(simhash_dedup.similar(scratch, docs_of(spark, rows), marked), "found")
    assert len({x.label for x in components(scratch, edges).collect()}) == 1
    assert made and max(made) <= 4 * len(rows)


def test_exact_dedup(spark, odd, empty):
    rows = ODD + [(400 + i, ["Copy of a TEXT", "copy OF a text", prose(i, 30)][i % 3], "en", "a") for i in range(60)]
    docs = docs_of(spark, rows)
    assert answer(exact_dedup.classes(spark, docs), exact_dedup.SQL, docs)
    kept = exact_dedup.survivors(spark, docs)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    best = {}
    for i, t, *_ in rows:
        best[norm(t)] = max(best.get(norm(t), -1), -1 if i is None else i)
    assert sorted((norm(x.text), x.doc_id) for x in kept.collect()) == sorted(best.items())
    assert exact_dedup.classes(spark, empty).count() == 0 and exact_dedup.survivors(spark, empty).count() == 0


def test_counting_filter_merges_without_loss(spark):
    r = random.Random(6)
    values = [r.getrandbits(52) if k % 3 else r.getrandbits(8) for k in range(3000)]
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint").repartition(7)
    got = {x.fp: x.n for x in exact_dedup.repeated_fingerprints(fps).collect()}
    assert got == {v: n for v, n in Counter(values).items() if n > 1}


def test_language(spark, odd, empty):
    rows = list(ODD)
    for i in range(400):
        lang, letters = [("aa", "abcdef"), ("bb", "uvwxyz"), ("cc", "äöüßst")][i % 3]
        rows.append((1000 + i, prose(i, 40, letters), lang if i % 10 else None, "a"))
    docs = docs_of(spark, rows)
    out = language_id.languages(spark, docs).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [x.lang_pred == ["aa", "bb", "cc"][(x.doc_id - 1000) % 3] for x in out if x.held_out and x.doc_id >= 1000]
    assert len(held) > 50 and np.mean(held) > 0.97
    assert {x.lang_pred for x in out if x.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.languages(spark, empty).count() == 0


def test_language_takes_batches_of_bounded_bytes(spark, monkeypatch):
    """Texts are sent to Python while the size of a batch is bounded in bytes, whatever the number of rows."""
    held, name = [], "spark.sql.execution.arrow.maxBytesPerBatch"

    class Recorder(Scratch):
        def save(self, df, table):
            held.append(spark.conf.get(name))
            return super().save(df, table)

    monkeypatch.setattr(language_id, "Scratch", Recorder, raising=False)
    docs = docs_of(spark, [(i, prose(i, 20, "abcdef"), "aa", "a") for i in range(8)])
    assert language_id.languages(spark, docs).count() == 8
    assert held == [str(4 << 20)]


def test_suffix_tree_windows_as_arrays(spark, monkeypatch):
    """Windows go through Spark as arrays of a bucket, not as a row each, and add up to the plain counts."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from conceptloom.llm import suffix_tree as st

    for name, value in (("_AT_ONCE", 500), ("_CODES_HELD", 900), ("BUCKET", 1000)):
        monkeypatch.setattr(st, name, value)
    texts = ["", "One two  three", *(" ".join(f"{'abc'[i * j % 3]}{i * j % 17}" for j in range(40)) for i in range(50))]
    plain = Counter()
    for t in texts:
        data = bytes(st.DEPTH) + st.written(st.words_of(t))
        plain.update(int.from_bytes(data[i : i + st.DEPTH + 1]) for i in range(len(data) - st.DEPTH))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = pa.Table.from_batches(list(st._window_counts(5)(iter([batch]))))
    assert rows.num_rows < len(plain) / 4
    found = Counter()
    for b in range(5):
        some = st._summed(rows.filter(pa.compute.equal(rows["bucket"], b)))
        found.update(dict(zip(some["code"].to_pylist(), some["n"].to_pylist(), strict=True)))
        assert len(set(some["code"].to_pylist())) == some.num_rows
    assert found == plain
    codes = np.array([0, 3, 1 << 40, (1 << 56) - 1], np.uint64)
    assert (st._unpacked(st._packed(codes)) == codes).all()
