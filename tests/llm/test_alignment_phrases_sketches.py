"""Token alignment, phrase collocations and odd-sketch near duplicates against brute force, with odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from conceptloom.llm import collocations, odd_sketch_dedup, token_alignment

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, t string, key string, h string"


def docs_of(spark, rows):
    """Rows (id, text, lang), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, la, "s", 1, 7, "t", "k", "h") for i, t, la in rows], DOCS)


def prose(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(n))


ODD = [
    (1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "One two three", "en"), (5, "one TWO three", "de"), (5, "one TWO three", "de"),
    (None, "one two three", "en"), (7, "Ärger ▁Öl 42", "de"), (8, prose(1, 3000), "en"), (9, "x" * 5000, "en"),
    (10, "<|endoftext|> a <s> <|endoftext|>", "en"), (11, "日本語  テキスト\x00 é", "und"), (12, ".;., !?", "fr"), (None, None, "en"),
]


def plain_tokens(text):
    """(ids, bytes) of both tokenizers by their libraries on the whole text, or None."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = t.encode(" " + text, add_special_tokens=False)
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte = {chr(b if b in plain else next(rest)): b for b in range(256)}
    a = [(i, bytes(byte[c] for c in p)) for i, p in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in m.encode(text):
        p = m.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (a, b) if text and all(b"".join(p for _, p in x) == whole for x in (a, b)) else None


def test_token_alignment(spark):
    rows = docs_of(spark, [(i, x[:1500] if x else x, la) for i, x, la in ODD])
    links, want = Counter(), []
    aligned = {}
    for i, x, _ in ((r.doc_id, r.text, 0) for r in rows.collect()):
        both = plain_tokens(x or "")
        if both is None:
            aligned[i, x] = None
            continue
        ends = []
        for side in both:
            at = np.cumsum([len(p) for _, p in side]).tolist()
            ends.append(dict(zip(at, (k for k, _ in side), strict=True)))
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for e, k in sorted(d.items()) if last < e <= c) for d in ends))
            last = c
        pairs = [(ends[0][c], ends[1][c]) for c in cuts]
        aligned[i, x] = (len(both[0]), len(both[1]), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())
        links.update(pairs)  # repeated rows come here once each
    for r in rows.collect():
        if aligned[r.doc_id, r.text] is None:
            want.append((r.doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n, pairs, sha = aligned[r.doc_id, r.text]
        top = defaultdict(int)
        for (_, b), c in links.items():
            top[b] = max(top[b], c)
        want.append((r.doc_id, n_a, n_b, n, len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs), sha))
    key = lambda r: tuple(str(x) for x in r)
    got = token_alignment.alignment(spark, rows)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) == 10  # all but two nulls, the empty text and the one with a word mark
    assert token_alignment.alignment(spark, docs_of(spark, [])).count() == 0


def test_alignment_parts(monkeypatch):
    """Long texts are encoded in pieces with the tokens of the whole; both forms of the byte vocabulary agree."""
    import public_tokenizers as P

    v = token_alignment.Vocabularies(token_alignment.default_a(), token_alignment.default_b())
    j = token_alignment.Vocabularies(P.path("byte_bpe_50k.json"), token_alignment.default_b())
    r = random.Random(5)
    pool = [" ", "  ", "\n", "\n\n", "\t ", "the", " don't", "1234", "é", "日本", " 　", "<|endoftext|>", ".", " !?", "a" * 40, " "]
    texts = ["".join(r.choices(pool, k=r.randint(1, 80))) for _ in range(150)]
    whole = list(v.encoded(texts))
    other = list(j.encoded(texts))
    monkeypatch.setattr(token_alignment, "parts_of", lambda t, f=token_alignment.parts_of: f(t, 20))
    cut = list(v.encoded(texts))
    assert any(len(token_alignment.parts_of(t)) > 1 for t in texts)
    for a, b, c in zip(whole, other, cut, strict=True):
        assert (a is None) == (b is None) == (c is None)
        for k in range(2):
            assert a is None or (a[k].tolist() == b[k].tolist() == c[k].tolist())


def test_group_names_are_gathered_without_objects():
    """The written ids of a text's groups come from arrays of one width, and are the plain ids."""
    v = token_alignment.vocabularies(token_alignment.default_a(), token_alignment.default_b())
    assert all(x.dtype.kind == "S" for x in v.names)
    text = "Plain words, 42 Ärger"
    ids_a, ids_b = next(iter(v.encoded([text])))
    assert v.a.decode(ids_a.tolist()) == v.b.decode(ids_b.tolist()) == b" " + text.encode()
    got = token_alignment.align(v, ids_a, ids_b)[2]
    sides = [g.split("|") for g in got.split(";")]
    assert [int(i) for a, _ in sides for i in a.split(",")] == ids_a.tolist()
    assert [int(i) for _, b in sides for i in b.split(",")] == ids_b.tolist()


def test_overlaps_lie_in_groups():
    r = random.Random(1)
    for _ in range(50):
        cut = lambda: np.diff([0, *sorted(r.sample(range(1, 60), r.randint(0, 20))), 60])
        a, b = cut(), cut()
        order, group = token_alignment.coalesce(a, b)
        of = np.empty(len(order), int)
        of[order] = group
        i, j = token_alignment.overlaps(a, b)
        spans = [[(int(e - s), int(e)) for s, e in zip(x, np.cumsum(x), strict=True)] for x in (a, b)]
        want = {(x, y) for x, (p, q) in enumerate(spans[0]) for y, (s, t) in enumerate(spans[1]) if p < t and s < q}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) == len(i)
        assert (of[i] == of[len(a) + j]).all()
        assert len(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist())) == group[-1] + 1


def sql_rows(sql, docs):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    return db.sql(sql)


def test_collocations(spark, monkeypatch):
    r = random.Random(2)
    words = ["new", "York", "city", "the", "of", "x\x01", "ä.ö", "San", "Juan"]
    phrases = ["New York city", "San Juan", "the of", "of the", "x\x01 the", "new\tyork", "a,b", "rare word"]
    rows = [(i, r.choice([" ", "  ", ". ", "\n", ""]).join(r.choices(words + phrases * 3, k=40)), r.choice(["en", "de", None, "und"]))
            for i in range(120)]
    docs = docs_of(spark, rows + ODD)
    want = sql_rows(collocations.SQL, docs)
    key = lambda x: (x[0], x[1])
    got = collocations.collocations(spark, docs)
    answer = sorted(want.fetchall(), key=key)
    assert len(answer) > 60
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == answer
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    # Chunks, shards of hashes and tries of any size give the same.
    for name, value in (("CHUNK", 64), ("PHRASES", 7), ("TRIE_BYTES", 20_000), ("HASHES", 100), ("WINDOWS", 50)):
        monkeypatch.setattr(collocations, name, value)
    again = collocations.collocations(spark, docs)
    assert sorted(map(tuple, again.select(want.columns).collect()), key=key) == answer
    assert collocations.collocations(spark, docs_of(spark, [])).count() == 0


def test_trie_holds_its_keys():
    r = random.Random(4)
    keys = sorted({bytes(r.choices(b"ab \x01\xc3\xa9", k=r.randint(1, 6))).replace(b"  ", b" a").strip(b" ") or b"a" for _ in range(300)})
    base, check = collocations.build_trie(keys)

    def find(key):
        state = 0
        for c in key + b"\n":
            slot = base[state] + c
            if check[slot] != state:
                return None
            state = slot
        return -1 - base[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"zz") is None and find(b"a" * 30) is None


def groups(rows, percent=80, k=4):
    """Brute force: (id, set size, component) of every row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        old = least.get(root(i))
        least[root(i)] = d if old is None else old if d is None else min(d, old)
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("turns", [0, 2])
def test_odd_sketch_near_duplicates(spark, turns):
    r = random.Random(7)
    rows = [(i, t) for i, t, _ in ODD]
    for g in range(12):  # chains and stars around the threshold, some of them large groups
        base = prose(100 + g, 60).split()
        for i in range(3 + 25 * (g % 4 == 0)):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = f"w{r.randrange(50)}"
            if g % 3 == 0:
                base = t
            rows.append((1000 * g + i + 20, " ".join(t)))
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    got = odd_sketch_dedup.near_duplicates(spark, docs, turns=turns)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    key = lambda x: tuple(str(v) for v in x)
    want = sorted(groups(rows), key=key)
    out = got.collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in out], key=key) == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)
    assert odd_sketch_dedup.near_duplicates(spark, docs_of(spark, [])).count() == 0


def test_keys_with_the_same_members_are_compared_once(spark):
    """Sets don't move with the keys they share: no working table has more than one row a text and set of members."""
    members = spark.createDataFrame([(k, t) for k in range(40) for t in ((1, 2, 3) if k % 2 else (2, 3, 4 + k))], "key bigint, t bigint")
    got = odd_sketch_dedup.once(members).groupBy("key").agg({"t": "collect_set"}).collect()
    assert sorted(sorted(r[1]) for r in got) == [[1, 2, 3], *[[2, 3, 4 + k] for k in range(0, 40, 2)]]
    saved = {}

    class Recorder(odd_sketch_dedup.Scratch):
        def save(self, df, name):
            saved[name] = super().save(df, name)
            return saved[name]

    r, rows = random.Random(3), []
    for i in range(40):  # two groups that share words, of which no two texts of different groups are similar
        half = prose(40 + i % 2, 10).split()
        rows.append((i, " ".join([*prose(50, 60).split(), *half, f"w{r.randrange(5)}"]), "en"))
    old, odd_sketch_dedup.Scratch = odd_sketch_dedup.Scratch, Recorder
    try:
        out = odd_sketch_dedup.near_duplicates(spark, docs_of(spark, rows), turns=0).collect()
    finally:
        odd_sketch_dedup.Scratch = old
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == sorted(groups([x[:2] for x in rows]))
    assert "across-members" in saved and "set" not in saved["across-members"].columns
    assert saved["across-members"].select("key").distinct().count() < saved["members"].select("key").distinct().count()


def test_odd_sketch_estimates():
    """XOR counts follow the similarity; no pair at the least similarity is pruned."""
    rng = np.random.default_rng(3)
    n, limit = odd_sketch_dedup.BANDS * odd_sketch_dedup.ROWS, odd_sketch_dedup.most_ones()
    for similarity, near in ((0.95, 0.03), (0.9, 0.05), (0.8, 0.08)):
        found = []
        for _ in range(60):
            both = rng.integers(1 << 62, size=int(400 * similarity), dtype=np.uint64)
            rest = rng.integers(1 << 62, size=(2, int(400 * (1 - similarity) / 2)), dtype=np.uint64)
            odd = [odd_sketch_dedup.odd_sketch(odd_sketch_dedup.samples(np.concatenate((both, x)))) for x in rest]
            ones = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64))
            assert ones <= limit
            found.append(odd_sketch_dedup.similarity_of(ones, n))
        assert abs(np.mean(found) - similarity) < near


def test_parities_prune_without_loss():
    """Sketches of whole sets differ in no more bits than the sets in shingles; most pairs below the least similarity are pruned."""
    rng, percent, pruned = np.random.default_rng(5), odd_sketch_dedup.PERCENT, 0
    for n, both in [(400, 160), *[(n, k) for n in (1, 3, 40, 400, 3000) for k in {n * 4 // 5, n * 9 // 10, n * 89 // 100, n}]]:
        sets = [np.concatenate((x, y)) for x in [rng.integers(1 << 62, size=both, dtype=np.uint64)] for y in rng.integers(1 << 62, size=(2, n - both), dtype=np.uint64)]
        a, b = (odd_sketch_dedup.parity_sketch(s).view(np.uint64) for s in sets)
        ones = int(np.bitwise_count(a ^ b).sum())
        assert ones <= 2 * (n - both)
        allowed = ones * (100 + percent) <= 2 * n * (100 - percent)
        assert allowed or 100 * both < percent * (2 * n - both)
        pruned += not allowed
    assert pruned


def test_sets_go_to_blocks_only_with_a_partner(spark):
    """Members of a key that no other component's sketches allow aren't joined with their sets."""
    saved, r, rows = {}, random.Random(3), []

    class Recorder(odd_sketch_dedup.Scratch):
        def save(self, df, name):
            saved[name] = super().save(df, name)
            return saved[name]

    shared = prose(50, 60).split()
    for i in range(40):
        rows.append((i, " ".join([*shared, *prose(100 + i % 20, 30).split(), f"w{r.randrange(5)}"]), "en"))
    old, odd_sketch_dedup.Scratch = odd_sketch_dedup.Scratch, Recorder
    try:
        out = odd_sketch_dedup.near_duplicates(spark, docs_of(spark, rows), turns=0).collect()
    finally:
        odd_sketch_dedup.Scratch = old
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == sorted(groups([x[:2] for x in rows]))
    assert saved["across-maybe"].count() < saved["across-members"].count()


def test_bitmaps_need_few_jobs(spark):
    """A bitmap isn't fetched partition by partition."""
    from pyspark.sql import functions as F

    from conceptloom.llm.bitmaps import bitmap_of

    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        rows = spark.range(5000, numPartitions=4).select(F.xxhash64("id").alias("h"))
        bits = np.unpackbits(np.frombuffer(bitmap_of(rows, "h", 16), np.uint8), bitorder="little")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {(r.h % (1 << 64)) >> 48 for r in rows.collect()}
    assert set(np.flatnonzero(bits).tolist()) == want


def test_survivors_keep_columns_of_any_name_and_type(spark):
    """The filters of the pipeline give rows back as they were, helper names and columns without an order included."""
    from pyspark.sql import functions as F

    from conceptloom.llm import exact_dedup, simhash_dedup

    rows = [(1, "One text", "a"), (2, "one TEXT", "b"), (3, prose(5, 40), "c"), (4, prose(5, 40) + " tail", "d"), (None, None, "e"), (7, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _norm string")
    for name in ("_fp", "_node", "_best", "_gone"):
        docs = docs.withColumn(name, F.col("_norm"))
    docs = docs.withColumn("bag", F.create_map(F.lit("k"), F.col("_norm")))
    same = lambda r: r._norm == r._fp == r._node == r._best == r._gone == r.bag["k"]
    exact = exact_dedup.survivors(spark, docs)
    assert exact.columns == docs.columns
    out = exact.collect()
    assert sorted(r._norm for r in out) == ["b", "c", "d", "f"] and all(map(same, out))
    near = simhash_dedup.survivors(spark, docs)
    assert near.columns == docs.columns
    out = near.collect()
    assert {r._norm for r in out} >= {"a", "c"} and "b" not in {r._norm for r in out} and all(map(same, out))
    assert sum(r._norm in "cd" for r in out) == 1


def test_small_batches_restores_the_setting(spark):
    from conceptloom.llm.common import small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), small_batches(spark, 1000):
        assert spark.conf.get(name) == "1000"
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


def test_bitmaps_lose_no_row(spark):
    from pyspark.sql import functions as F

    from conceptloom.llm.bitmaps import filtered

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 50 = 0")
    kept = filtered(rows, F.col("h"), wanted, "h", 16)
    assert kept.where("id % 50 = 0").count() == 100 and kept.count() < 300
    assert filtered(rows, F.col("h"), wanted.limit(0), "h", 16).count() == 0


def test_starts_outside_a_trie_are_left_out_and_none_inside():
    """Keys of every length around the prefix, one the beginning of another, and bytes above 127."""
    from conceptloom.llm import collocations as X

    words = ["a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "abz", "b", "é", "ÿÿÿÿÿ", "zz"]
    rng = np.random.default_rng(3)
    data = X.normal(" ".join(rng.choice(words, 3000)).replace(" b ", " b. ").encode())
    chunk = X.Chunk(data, len(data))
    every = sorted({data[chunk.starts[i] : chunk.ends[i + k - 1]] for k in (1, 2, 3) for i in chunk.windows(k)})
    begins = X.prefixes(chunk)
    for at in range(0, len(every), 37):
        keys = every[at : at + 37]
        low, high = X.prefix_range(keys)
        among = np.flatnonzero((begins >= np.uint64(low)) & (begins <= np.uint64(high)))
        assert len(among) < chunk.n
        trie = X.build_trie(keys)
        assert (X.count_phrases(chunk, *trie, len(keys), among) == X.count_phrases(chunk, *trie, len(keys))).all()


def test_short_bitmap(spark):
    """A bitmap of few words is not sent whole, and lets the same hashes through."""
    from conceptloom.llm.bitmaps import bitmap_of, in_bitmap, in_words, short_bitmap_of

    hashes = [hash((i, "h")) << 8 ^ i * 0x9E3779B97F4A7C1 for i in range(300)]
    hashes = [(h + (1 << 63)) % (1 << 64) - (1 << 63) for h in hashes]
    rows = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    short = short_bitmap_of(rows, "h", 20)
    assert isinstance(short, tuple) and sum(x.nbytes for x in short) < 1 << 13
    asked = np.concatenate((np.array(hashes, np.int64), np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20000))).view(np.uint64)
    whole = np.frombuffer(bitmap_of(rows, "h", 20), np.uint8)
    assert (in_words(short, asked, 20) == in_bitmap(whole, asked, 20)).all() and in_words(short, asked, 20)[:300].all()
    assert isinstance(short_bitmap_of(rows, "h", 10), bytes)
    assert not in_words(short_bitmap_of(rows.limit(0), "h", 20), asked, 20).any()


def test_components_by_one_join_a_round(spark, monkeypatch):
    """A round's own labels come from the join that gives the neighbours' labels; the classes are as by hand."""
    from conceptloom.llm import components as module
    from conceptloom.scratch import Scratch

    joins = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: joins.append(
        (name, df._jdf.queryExecution().optimizedPlan().toString().count("Join "))) or save(self, df, name))
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(5, 5), (-7, 90), (90, 3)]
    got = {r.node: r.label for r in module.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {-7: -7, 90: -7} | {i: -7 if i <= 20 else 21 for i in range(41)}
    assert max(n for name, n in joins if not name.endswith("-edges")) == 2
    assert module.components(Scratch(spark, "t"), spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_collocations_add_up_arrays(spark, monkeypatch):
    """Windows and counts go through Spark as arrays of a bucket or block, not as a row each, and add up to the same phrases."""
    from conceptloom.scratch import Scratch

    for name, value in (("CHUNK", 256), ("WINDOWS", 100), ("BUCKET", 300), ("BLOCK", 8)):
        monkeypatch.setattr(collocations, name, value)
    texts = [prose(i % 9, 60, "abc") for i in range(120)]
    plain = Counter(tuple(w[i : i + k]) for w in map(str.split, texts) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    chunks = collocations.chunks_of(Scratch(spark, "t"), docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    rows = chunks.mapInArrow(collocations._added([1, 2], 7), "bucket int, h binary, n binary, of binary, ids binary").collect()
    hashes = sum(len(r.h) // 8 for r in rows)
    assert len({r.bucket for r in rows}) == 7 and len(rows) < hashes / 4
    assert sum(np.frombuffer(r.n, np.int32).sum() for r in rows) == sum(n for w, n in plain.items() if len(w) < 3)
    got = {tuple(r.phrase.split(" ")): r.a for r in collocations.phrase_counts(spark, Scratch(spark, "t"), chunks).collect()}
    assert got == {w: n for w, n in plain.items() if n >= collocations.LEAST}
