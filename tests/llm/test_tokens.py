"""Token files and packing against the tokenizers library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plait.llm import idfiles, packing, tokens
from plait.llm.queries import QUERIES, public_tokenizer
from plait.llm.tokens import Encoder
from plait.session import fresh_path

PATH = public_tokenizer("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, start long, ids string"

ODD = [
    "it's 'STILL' don't, O'Neil's we'LL x''s 'sst",
    "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|x",
    "éa,́ İ, İ̇. —,…! a̸ ≮",
    "a b c\x1cd\x85e\x0bf\x0cg",
    "1234 12ab34 ½Ⅷ ٣٤ x2²",
    "СЛОВО 中文字 ไทย \U0001f600\U0001f469‍\U0001f4bb!",
    "Été, Ñandú! ×÷ ǅ ŉ ﬁ ΣΣ. å̧b",
    "$$$ %%%word### ***a.b,c;d (x) [y] {z} ~`^| \\/",
    "", " ", "\n\t", "a" * 5000, "\x00\x01a\x7f",
]


def expected(texts, end):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_equal_whole_texts():
    enc, tok = Encoder(PATH), Tokenizer.from_file(PATH)
    assert enc.by_word
    rng = random.Random(5)
    glyphs = "abEéÉİ̇́'’,.<|>sS td1²中— ̸ \n$-_Σŉ"
    texts = ODD + ["".join(rng.choices(glyphs, k=rng.randint(1, 40))) for _ in range(20000)]
    for text, got in zip(texts, enc.packed([t.encode() for t in texts])):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u2").tolist() == want, repr(text)


def test_whole_text_tokenizer():
    path = public_tokenizer("byte_bpe_50k.json")
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    for text, got in zip(ODD, enc.packed([t.encode() for t in ODD])):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, top", [(0, 0), (1, 0), (1, 10**6), (700, 700), (1000, 10**9), (5, 2**62)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n, endpoint=True))
    made = idfiles.EliasFano.of(values, top)
    again, end = idfiles.EliasFano.read(memoryview(b"__" + made.to_bytes()), 2, n, top)
    assert end == 2 + len(made.to_bytes())
    assert again.decode().tolist() == values.tolist()
    assert [again.select(i) for i in range(n)] == values.tolist()


def odd_docs(spark):
    rows = [(i * 7 - 20, t, "en", "s", 1, "x") for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None), (None, None, None, None, None, None)]
    rows += [(3, "twice over", "en", "s", 1, "x")] * 2 + [(2**62, "word " * 5000, "en", "s", 1, "x")]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_files_round_trip(spark):
    rows, df = odd_docs(spark)
    path = fresh_path(spark, "ids")
    idfiles.write(df, path, PATH, shard_ids=300)
    got = idfiles.read(spark, path, with_ids=True).collect()
    want = sorted((r[0] is not None, r[0] or 0, ids) for r, ids in zip(rows, expected([r[1] for r in rows], 2)))
    mine = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got)
    assert mine == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    part = idfiles.Shard(bytes(spark.read.format("binaryFile").load(path).first().content))
    assert [part.span(i)[1] for i in range(part.docs)] == part.ends.decode().tolist()


def test_no_documents(spark):
    _, df = odd_docs(spark)
    path = fresh_path(spark, "ids")
    idfiles.write(df.where("false"), path, PATH)
    assert idfiles.read(spark, path).collect() == []
    assert packing.pack(df.where("false"), PATH).collect() == []


def check_packed(rows, got, size):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for r, ids in zip(rows, expected([r[1] for r in rows], 0)):
        for n, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want[r[0]].append((n, start, len(part), crc(part)))
    assert {d: sorted(p) for d, p in docs.items()} == {d: sorted(p) for d, p in want.items()}
    return len(bins)


def test_packing_small(spark):
    rows, df = odd_docs(spark)
    check_packed(rows, packing.pack(df, PATH, size=64, group_pieces=8).collect(), 64)


def test_queries(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = check_packed(rows, QUERIES["op5_best_fit_packing"](spark, sf).collect(), 2048)
    lengths = [len(i) for i in expected([r[1] for r in rows], 0)]
    cut = [min(2048, k - s) for k in lengths for s in range(0, k, 2048)]
    assert n <= packing.fewest(np.array(cut), 2048) * 1.02 + 1
    at = 0
    files = {r.doc_id: r for r in QUERIES["op4_token_id_files"](spark, sf).collect()}
    for (doc, _), ids in sorted(zip(rows, expected([r[1] for r in rows], 2)), key=lambda x: x[0][0]):
        r = files[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_search_never_adds_bins():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([20, 100, 2048])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
        bins = packing.best_fit(lengths, size)
        better = packing.improve([list(b) for b in bins], lengths, size)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= size for b in better)
        assert packing.fewest(np.array(lengths), size) <= len(better) <= len(bins)


def test_search_finds_the_exchange():
    # 6+4 | 7 | 3+... best fit leaves a bin that an exchange can empty
    lengths = [6, 5, 5, 4, 4, 3, 3]
    bins = [[0, 3], [1, 4], [2, 5], [6]]
    assert len(packing.improve(bins, lengths, 10)) == 3


@pytest.mark.parametrize("base, piece, held", [(tokens.BASE, 1 << 20, 2_000_000), (1, 1 << 20, 2_000_000), (tokens.BASE, 64, 50)])
def test_looked_up_words_equal_the_library(monkeypatch, base, piece, held):
    """Also where sums of different words are equal, stretches are short and caches small."""
    monkeypatch.setattr(tokens, "BASE", base)
    monkeypatch.setattr(tokens, "SLICE", piece)
    monkeypatch.setattr(tokens, "CACHED_WORDS", held)
    monkeypatch.setattr(tokens, "CACHED_UNITS", held)
    monkeypatch.setattr(tokens.Words, "powers", np.ones(1, np.uint64))
    monkeypatch.setattr(tokens.Words, "undone", np.ones(1, np.uint64))
    rng = random.Random(3)
    parts = ["listen", "silent", "Enlist", "tinsel", "ab", "ba", "élan", "don't", "x.y", "%%%", "café***", "9a", "a9", "<|x|>", "日本", "İ", "Ǆ", "\x00", "​"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t ", "\x0b", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, " ", "w" * 5000, "listen silent " * 2000, "\n\n", "end "]

    enc = tokens.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    for _ in range(2):
        got = enc.packed([None if t is None else t.encode() for t in texts])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
