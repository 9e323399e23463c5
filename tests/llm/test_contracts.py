"""Held against libraries and brute force: collisions, special strings, byte payloads, clashing columns, empty tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from corpusmill.llm import bpe, decontaminate, html, jaccard, language, linededup, quality, sharding, tokenfile, warc
from tests.llm.test_operators import DOCS, brute_components, docs, words


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def odd_texts():
    r = random.Random(7)
    pick = lambda: chr(r.choice([r.randrange(32, 0x250), r.randrange(0x3000), r.randrange(0x10000, 0x33500), 97, 32, 49, 39, 0x105E7, 0x113A7]))
    texts = ["".join(c for c in (pick() for _ in range(60)) if not "\ud800" <= c <= "\udfff") for _ in range(120)]
    return [*thue_morse(2048), " ".join(thue_morse(1024)), "a <|endoftext|> b", None, "", "x" * 5000, *texts]


def test_token_file_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # as the tokenizers' description has it
    texts = odd_texts()
    want, start = {}, 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.write_and_read(docs(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    assert got == want


def test_random_access_on_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write(docs(spark, [f"some text number {i}" for i in range(40)]), path, P.path("byte_bpe_50k.json"))
    n = tokenfile.read_documents(spark, path).agg({"n_tokens": "sum"}).first()[0]
    got = {r.position: r.token for r in tokenfile.read_tokens(spark.createDataFrame([(i,) for i in range(0, n + 5, 3)] + [(None,)], "position long"), path).collect()}
    assert sorted(got) == list(range(0, n, 3)) and got[0] > 0


def test_bpe_digests_equal_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    for r in bpe.round_trip(docs(spark, texts), P.path("byte_bpe_multi_50k.tiktoken")).collect():
        x = texts[r.doc_id] or ""
        ids = library.encode_ordinary(x)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip_ok) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest(), True)
    both = bpe.decode(bpe.encode(docs(spark, texts), P.path("byte_bpe_multi_50k.tiktoken")), P.path("byte_bpe_multi_50k.tiktoken"))
    assert all(r.decoded == (r.text or "") for r in both.collect())


def test_shingles_of_colliding_words_differ(spark):
    a, b = thue_morse(1024)
    got = {r.doc_id: r.component_id for r in jaccard.link_components(docs(spark, [f"{w} one two three four" for w in (a, b, a)])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_jaccard_of_a_large_group_equals_brute_force(spark):
    r, base = random.Random(11), words(1, 80)
    texts = []
    for i in range(250):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(w[r.randrange(3) :]) if i % 5 else " ".join(words(1000 + i, 30)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_components(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_archives_carry_any_bytes(spark, tmp_path):
    raw = bytes(range(256)) * 8
    (tmp_path / "a.arc").write_bytes(warc.version_block(1) + warc.arc_record(1, "http://a", raw, 1) + b"no header\n" + warc.arc_record(2, "http://b c", raw, 1))
    warc.convert_files(spark, str(tmp_path / "a.arc"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got[2].payload_ok and got[2].payload_digest == hashlib.sha1(raw).hexdigest() and got[1].refers_to == 2


def test_shards_by_brute_force(spark):
    shards = {"a": 1, "b": 2, "c": 1}
    table, at, prefs = [None] * 101, dict.fromkeys(shards, 0), {}
    for s in shards:
        offset, skip = (int.from_bytes(hashlib.md5(f"{k}:{s}".encode()).digest()[:8], "big") for k in ("offset", "skip"))
        prefs[s] = [(offset % 101 + i * (skip % 100 + 1)) % 101 for i in range(101)]
    while None in table:
        for s in [x for x in sorted(shards) for _ in range(shards[x])]:
            free = [p for p in prefs[s] if table[p] is None]
            if free:
                table[free[0]] = s
    rows = sharding.place(spark.createDataFrame([(i, 5, "old") for i in range(300)], "doc_id long, slot int, shard string"), shards, slots=101).collect()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])


def test_phrases_and_proximity(spark):
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    texts = ["x alpha beta gamma y", "alpha x beta gamma", "alpha beta", "gamma beta alpha"]
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.judge(docs(spark, texts), bench).collect()}
    assert got[0][0] == 3 and got[1][0] == got[2][0] == got[3][0] == 0 and got[1][1] > 0


def test_paths_are_chosen_by_their_ratios(monkeypatch):
    prose = "A long sentence of the text, with marks; it goes on and on, as prose does. " * 5
    page = f"<body><table>{'<tr><td>17</td><td>42</td></tr>' * 30}</table><div><p>{prose}</p><p>{prose}</p></div></body>"
    assert html.main_text(page) == f"{prose.strip()}\n\n{prose.strip()}"
    monkeypatch.setattr(html, "SHARE", 0)
    assert "17" in html.main_text(page)


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<a " * 50_000, '<a href="x ' * 30_000, "<form>x" * 30_000])
def test_any_page_ends_soon(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 10


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = [sharding.place(none, {"a": 1}), warc.pages_round_trip(pages), linededup.drop_recurring(none), quality.judge(none), tokenfile.write_and_read(none, P.path("byte_bpe_50k.json")), jaccard.link_components(none), language.identify(none, language.fit(none)), html.extract(pages), decontaminate.judge(none, bench), bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"))]
    assert [df.count() for df in got] == [0] * 10
    assert decontaminate.judge(docs(spark, ["a b", None]), bench).where("n_hit = 0").count() == 2


def test_clashing_columns_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, 0, "x", True)] * 3 + [(None, None, None, None, None, 0, "x", True), (2, "word " * 20_000, "en", "s", 1, 0, "x", True)]
    df = spark.createDataFrame(rows, DOCS + ", row int, shard string, kept boolean")
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    got = [sharding.place(df, {"a": 1}), linededup.drop_recurring(df), quality.judge(df), tokenfile.write_and_read(df, P.path("byte_bpe_50k.json")), jaccard.link_components(df), language.identify(df, language.fit(df)), decontaminate.judge(df, bench), bpe.round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"))]
    assert [x.count() for x in got] == [5] * 8
    assert got[6].where("n_hit = 3").count() == 3


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    en = lambda n: " ".join(r.choice("the of and house river stone bright water under green old hill road north".split()) for _ in range(n))
    item = " ".join(f"zeta{i} lorem" for i in range(12))
    clean = [en(60) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " end", item + " " + en(20), None, "123 456"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(30)) and all(x.round_trip_ok for x in got.values())
    assert all(got[i].decoded_sha256 == hashlib.sha256(clean[i].encode()).hexdigest() for i in range(30))
