"""Spelling variants, collocations and packing against brute force and odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from corpusmill.llm import collocations, packing, variants
from tests.llm.test_operators import DOCS, docs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and variants.one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def plain_edit(a, b):
    """By trying all edits."""
    letters = set(a + b)
    made = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in letters for d in (0, 1) if i + d <= len(a)}
    return a != b and b in made


def test_one_edit():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(5))) for _ in range(2))
        assert variants.one_edit(a, b) == plain_edit(a, b)


def variant_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdéè") for _ in range(r.choice([6, 6, 7, 8, 9]))) for _ in range(60)] + ["x" * 60, "x" * 61, "Straße" * 12, "zebras", "ZEBRAS", "zebra"]
    words = []
    for w in base:
        words += [w] * r.choice([5, 6, 30, 200, 1000])
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w))
            v = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcd") + w[i + 1 :], w[:i] + r.choice("abcd") + w[i:]])
            words += [v] * r.choice([4, 5, 9, 41])
    r.shuffle(words)
    rows = [(i, " ".join(words[k : k + 150])) for i, k in enumerate(range(0, len(words), 150))]
    return rows + [(None, "nullkeys " * 6), (0, rows[0][1]), (7000, None), (7001, ""), (7002, "longtext " * 30_000)]


@pytest.mark.parametrize("settings", [{}, {"NODE": 1, "PAIRS": 8}, {"NODE": 0}, {"WIDE": 4}])
def test_trie_finds_all_near_words(monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(variants, k, v)
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcàz") for _ in range(r.randrange(4, 9))) for _ in range(700)} | {"x" * 60, "x" * 61, "x" * 59 + "y"})
    trie = variants.Trie(pa.array(words), np.arange(len(words)))
    x, y = trie.search(pa.array(words))
    got = collections.Counter((words[i], trie.texts[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True))
    assert got == collections.Counter((a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and variants.one_edit(a, b))


@pytest.mark.parametrize("settings", [{}, {"SUBTREE": 4, "DEPTH": 2}, {"SUBTREE": 1, "DEPTH": 1}, {"QUERIES": 3}])
def test_variants(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(variants, k, v)
    rows = variant_rows(len(settings))
    got = variants.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(rows)
    assert len(got) == len({r.word for r in got})


def brute_collocations(rows, top=2000):
    f = {k: collections.Counter() for k in (1, 2, 3)}
    n = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in f:
                f[k].update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    for k in (2, 3):
        for (lang, *w), a in f[k].items():
            if a < 10:
                continue
            cuts = [(1000000 * a * a // (f[i][lang, *w[:i]] * f[k - i][lang, *w[i:]]), i) for i in range(1, k)]
            score, i = min(cuts)
            longer = [b for (other, *v), b in f[3].items() if other == lang and b >= 10 and k == 2 and (v[:2] == w or v[1:] == w)]
            if not any(100 * b >= 50 * a for b in longer):
                found[lang].append((-score, -a, " ".join(w).encode(), f[i][lang, *w[:i]], f[k - i][lang, *w[i:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, every in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1)}


def text_rows(seed):
    r = random.Random(seed)
    words = ["aa", "Bb", "c'c", "dé", "e\x00e", "漢字", "f-f", "gg"]
    rows = []
    for i in range(60):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?", "\x0b"]) for _ in range(r.randrange(80)))
        rows.append((r.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", "only once"), ("en", "new york city " * 20), ("en", ". ".join(["san jose"] * 30) + " " + "x" * 300)]


@pytest.mark.parametrize("settings", [{}, {"STRIPE": 3}, {"CELLS": (1 << 2, 1 << 2), "PAIR_CELLS": (1 << 2, 1 << 2)}, {"BLOCK": 40, "STRIPE": 5}])
def test_collocations(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(collocations, k, v)
    rows = text_rows(len(settings)) * 2
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, score int, phrase string").repartition(5)
    got = {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df).collect()}
    assert got == brute_collocations(rows) and got


def test_only_the_first_phrases(spark):
    rows = text_rows(9) * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {(r.lang, r.rank, r.phrase) for r in collocations.collocations(df, top=3).collect()} == {x[:3] for x in brute_collocations(rows, 3)}


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("999999999999999L a", "1000000000000000L - 1 l", "999999999999999L r").selectExpr(f"{collocations.scored('a', 'l', 'r')} s").first()
    assert row.s == 1_000_000


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_packing_equals_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "HELD_IDS", 3000)
    r = random.Random(3)
    texts = [None, "", "a <|endoftext|> b", "x" * 70_000, "漢字 é 😀 " * 900, *(" ".join(r.choice("the of and house river stone".split()) for _ in range(r.randrange(5000))) for _ in range(12))]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 0), (5, texts[5], "en", "s", 0), (5, texts[5], "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    t = library()
    got = packing.pack(df, P.path("byte_bpe_50k.json"), str(tmp_path / "p")).collect()
    docs_of = collections.defaultdict(list)
    for x in got:
        docs_of[x.doc_id].append(x)
    copies = {5: 3}
    assert set(docs_of) == {*range(len(texts)), None}
    for i, text in [*enumerate(texts), (None, "no id")]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = collections.Counter((x.start, x.length, x.doc_tokens, bytes(x.ids)) for x in docs_of[i])
        at, want = 0, collections.Counter()
        lengths = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]
        for n in lengths:
            want[at, n, len(ids), np.array(ids[at : at + n], "<u4").tobytes()] += copies.get(i, 1)
            at += n
        assert pieces == want and at == len(ids)
    assert sorted(x.sequence_id for x in got) == list(range(len(got))) and {x.offset for x in got} == {0}
    # the longest bucket first
    assert [x.length for x in sorted(got, key=lambda x: x.sequence_id)] == sorted((x.length for x in got), reverse=True)
    batches = packing.read(spark, str(tmp_path / "p")).withColumn("batch", packing.batch_of(4096)).groupBy("length", "batch").count().collect()
    assert all(b["count"] * b.length <= 4096 for b in batches)


def test_cut_and_lengths():
    which, length = packing.cut(np.array([1, 2048, 4097, 7]))
    assert list(zip(which.tolist(), length.tolist(), strict=True)) == [(0, 1), (1, 2048), (2, 2048), (2, 2048), (2, 1), (3, 4), (3, 2), (3, 1)]
    with pytest.raises(ValueError):
        packing.write(None, "", "", most=1000)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert variants.group(none).count() == collocations.collocations(none).count() == packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    clash = docs(spark, ["words of some length " * 12, None]).selectExpr("*", "1 AS word", "'a' AS form", "2 AS n", "3 AS part", "4 AS length", "5 AS slot", "6 AS w1", "7 AS rank", "8 AS total", "9 AS key")
    assert {r.word for r in variants.group(clash).collect()} == {"length"}
    assert collocations.collocations(clash).count() > 0 and packing.pack(clash, P.path("byte_bpe_50k.json")).where("doc_id = 1").count() == 1


def test_frequent_shingles_of_small_sets(spark, monkeypatch):
    from corpusmill.llm import jaccard
    from tests.llm.test_operators import brute_components, words

    r = random.Random(8)
    for k, v in {"HOT": 3, "MEETING": 5, "SALT_ROWS": 7}.items():
        monkeypatch.setattr(jaccard, k, v)
    lines = [" ".join(words(i, r.randrange(5, 12), 50)) for i in range(12)]
    texts = [" ".join(r.choice(lines) for _ in range(r.randrange(1, 4))) + (f" u{i}" if r.random() < 0.5 else "") for i in range(400)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_one_shingle_of_many_unlike_short_texts(spark):
    """Few of the pairs of thousands of texts that share a frequent shingle ever meet."""
    from corpusmill.llm import jaccard
    from corpusmill.llm.arrays import shingle_sets

    texts = [f"the same five words here then w{i} x{i}" for i in range(3000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    sets, at = shingle_sets(raw, np.cumsum([0, *map(len, texts)]))
    count = collections.Counter(sets.tolist())
    entries = collections.Counter()
    for i, j in zip(at[:-1], at[1:], strict=True):
        one = np.array(sorted(sets[i:j].tolist(), key=lambda h: (count[h], h)), np.uint64)
        need = len(one) - int(jaccard.least_common(np.int64(len(one)))) + 1
        entries.update(e[0] for e in jaccard._small_prefix(one, np.array([count[h] for h in one.tolist()]), need, jaccard.HOT))
    assert max(entries.values()) == 1
    got = jaccard.link_components(docs(spark, texts)).collect()
    assert all(x.component_id == x.doc_id for x in got) and len(got) == 3000


def test_names_that_sets_share_are_told_apart(spark, monkeypatch):
    from corpusmill.llm import jaccard

    texts = [f"some words of the text {i // 2} and {i // 2 * 7} more of them" for i in range(60)]
    profiled = spark.createDataFrame([(1, 5, 10, 100), (2, 5, 10, 100), (3, 5, 10, 101), (4, 6, 11, 100)], "doc_id long, n int, node long, twin long")
    anew = jaccard.clashes(profiled)
    assert set(anew) == {(10, 100), (10, 101)} and len({*anew.values(), 10, 11}) == 4
    # all documents renamed as if their names clashed: the same components
    real = jaccard.clashes
    monkeypatch.setattr(jaccard, "clashes", lambda p: {(r.node, r.twin): i for i, r in enumerate(p.where("node is not null").select("node", "twin").distinct().collect())} if real(p) == {} else {})
    got = {x.doc_id: x.component_id for x in jaccard.link_components(docs(spark, texts)).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)}


def test_a_bpe_worker_keeps_little():
    import tracemalloc

    from corpusmill.llm import bpe, pretokens

    r = random.Random(3)
    t = bpe.Transducer(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    tracemalloc.start()
    try:
        for _ in range(40_000):
            t.encode(bytes(r.choices(b"etaoinshrdlu", k=9)))
        assert tracemalloc.get_traced_memory()[0] < 60e6
    finally:
        tracemalloc.stop()
    cache = pretokens.PieceCache(lambda ws: [[1]] * len(ws), bpe._kinds())
    for i in range(40):
        cache.ids(["".join(r.choices("abcdef", k=20)) * 20_000 + "xyz"[i % 3]])
    assert cache.texts.used < 5_000_000


def test_unlike_sets_are_told_apart_before_they_are_met(spark):
    from corpusmill.llm import jaccard

    r = np.random.default_rng(7)
    for _ in range(200):
        x = r.integers(0, 1 << 62, int(r.integers(1, 5000)), np.uint64)
        y = np.concatenate([x[: int(r.integers(0, len(x) + 1))], r.integers(0, 1 << 62, int(r.integers(1, 3000)), np.uint64)])
        x, y = np.unique(x), np.unique(y)
        apart = jaccard.least_apart(jaccard.bitmap(x), jaccard.bitmap(y))
        assert 0 <= apart <= len(np.setxor1d(x, y)) and jaccard.least_apart(jaccard.bitmap(x), jaccard.bitmap(x)) == 0
    one = np.sort(r.integers(0, 1 << 62, 6000, np.uint64))
    near, far = np.sort(np.append(one[:5800], r.integers(0, 1 << 62, 100, np.uint64))), np.sort(np.append(one[:3000], r.integers(0, 1 << 62, 3000, np.uint64)))
    # only the sets of the near pair are at hand, so a look at the others would fail
    rows = [(1, one.tobytes(), jaccard.bitmap(one), len(one)), (2, near.tobytes(), jaccard.bitmap(near), len(near)), (3, None, jaccard.bitmap(far), len(far))]
    sets = spark.createDataFrame([(a, bytearray(b) if b else None, bytearray(c), m) for a, b, c, m in rows], "node long, shingles binary, bits binary, m int")
    got = {(x.a, x.b): x for x in jaccard.measured(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), sets).collect()}
    assert {k: x.linked for k, x in got.items()} == {(1, 2): True, (1, 3): False, (2, 3): False}
    exact = {(1, 2): 1 - 5800 / 6100, (1, 3): 1 - 3000 / 9000, (2, 3): 1 - 3000 / 8900}
    assert all(got[k].least <= d + 1e-12 and d <= got[k].most + 1e-12 for k, d in exact.items()) and got[1, 2].least == got[1, 2].most


def test_frequent_pieces_stay_when_the_cache_is_full():
    import collections

    from corpusmill.llm import bpe, pretokens

    r, asked = random.Random(11), collections.Counter()

    def number(words):
        asked.update(words)
        return [[len(w), *map(ord, w)] for w in words]

    cache = pretokens.PieceCache(number, bpe._kinds(), most=1500)
    frequent = ["".join(r.choices("abcdefgh", k=6)) + "z" for _ in range(300)]
    for i in range(30):
        words = frequent + ["".join(r.choices("abcdefgh", k=9)) for _ in range(400)] + ["😀", "x" * 100, "y" * 33]
        r.shuffle(words)
        ids, at = cache.ids([" ".join(words), None or "", words[i]])
        want = [i for n, w in enumerate(words) for i in (len(w) + (n > 0), *map(ord, " " * (n > 0) + w))]
        assert ids[: at[1]].tolist() == want and at[1] == at[2] and ids[at[2] :].tolist() == [len(words[i]), *map(ord, words[i])]
        assert len(cache.keys) < 3000 and cache.ids_end[-1] == cache.ids_pool.used and cache.text_end[-1] == cache.texts.used
    assert max(asked[f" {w}"] for w in frequent) <= 3


def test_pieces_of_one_hash_keep_their_ids(monkeypatch):
    from corpusmill.llm import bpe, pretokens

    monkeypatch.setattr(pretokens, "spans_hash", lambda raw, at, n: np.full(len(at), 7, np.uint64))
    cache = pretokens.PieceCache(lambda ws: [[*map(ord, w)] for w in ws], bpe._kinds())
    for text in ("one two three one", "twice 漢字 é😀 two", "abcdefghij abcdefghik"):
        assert cache.ids([text])[0].tolist() == [*map(ord, text)]


def test_moves_asked_for_once_are_not_saved():
    import tiktoken

    from corpusmill.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, t = random.Random(4), bpe.Transducer(ranks)
    rare = ["".join(r.choices("etaoinshrdlu", k=12)) for _ in range(3000)]
    want, saved = [library.encode_ordinary(x) for x in rare], []
    for _ in range(3):
        assert [t.encode(x.encode()) for x in rare] == want
        saved.append(len(t.states))
    few = bpe.Transducer(ranks, 50)  # starts anew again and again
    assert [few.encode(x.encode()) for x in rare[:300]] == want[:300]
    assert saved[0] < 12_000 < saved[2]


def test_sketches_are_squeezed():
    from corpusmill.llm import jaccard

    r = np.random.default_rng(5)
    for counts in (r.poisson(1, jaccard.CHUNK), r.poisson(900, jaccard.CHUNK), np.array([0, 1 << 40]), np.array([255, 0]), np.array([256, 65536]), np.zeros(4, np.uint32)):
        assert jaccard.unsqueezed(jaccard.squeezed(counts)).tolist() == counts.tolist()
    # a task's counts of one for each cell take about two bits
    assert len(jaccard.squeezed(r.poisson(1, jaccard.CHUNK).astype(np.uint32))) < 0.3 * jaccard.CHUNK


def near_and_repeated(r):
    """Rows (doc_id, text) with near and exact copies, repeated and null doc_ids."""
    from tests.llm.test_operators import words

    bases = [" ".join(words(i, 40)) for i in range(12)]
    texts = [bases[i % 12] + (f" u{i} v{i}" if r.random() < 0.5 else "") for i in range(120)] + [None, "", "a b"]
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("odd", ["plain", "copies", "repeats"])
def test_nodes_by_doc_ids_and_by_sets(spark, monkeypatch, odd):
    """Copies dropped before the shuffle or after it, and rows of one doc_id with different sets: as by brute force."""
    from corpusmill.llm import jaccard
    from tests.llm.test_operators import brute_components

    if odd == "copies":
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(jaccard, "SALT_ROWS", 7)
    rows = near_and_repeated(random.Random(5))
    want = brute_components([t for _, t in rows])
    want = [(i, n, rows[top][0]) for (i, _), (n, top) in zip(rows, want, strict=True)]
    more = [(None, rows[0][1]), (None, "of no other row at all")] + ([(rows[0][0], "quite another text of one more row"), (rows[5][0], rows[5][1])] if odd == "repeats" else [rows[5]])
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows + more], DOCS)
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.link_components(df).collect())
    extra = [(None, want[0][1], None), (None, 2, None), want[5]] + ([(rows[0][0], 3, rows[0][0])] if odd == "repeats" else [])
    assert got == collections.Counter(want + extra)


def test_whole_sets_are_not_kept_for_all_candidates(spark, monkeypatch):
    """Texts that only share some rare shingles never have their whole sets written."""
    from corpusmill.llm import jaccard
    from tests.llm.test_operators import words

    tables = []
    real = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, *path: tables.append(df.columns) or real(df, *path))
    texts = [" ".join(words(i // 2, 20) + words(1000 + i, 60)) for i in range(40)]
    assert all(x.component_id == x.doc_id for x in jaccard.link_components(docs(spark, texts)).collect())
    assert any("bits" in t for t in tables) and not any("shingles" in t for t in tables)


def test_packed_entries(spark):
    from corpusmill.llm import jaccard

    r = np.random.default_rng(2)
    n = np.concatenate([np.arange(1, 400), r.integers(400, 1 << 16, 300), [65535, 65536, 1 << 20, (1 << 31) - 1]])
    most, salts = np.maximum(1, n - (n * r.random(len(n)) * 0.3).astype(np.int64)), r.integers(1, 1 << 30, len(n))
    head, large = jaccard.packed(n, most, salts)
    rows = list(zip(head.tolist(), range(len(n)), range(len(n)), large.tolist(), strict=True))
    got = sorted(jaccard.unpacked(spark.createDataFrame(rows, "head long, sig long, node long, large int")).collect(), key=lambda x: x.sig)
    assert [x.n for x in got] == n.tolist() and [x.salts for x in got] == salts.tolist()
    assert all(m <= x.most <= min(x.n, m + x.n / 255) for x, m in zip(got, most.tolist(), strict=True))
