"""Encoding and packing against the tokenizers library itself."""

import cProfile
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from odd_texts import ODD
from tokenizers import Tokenizer

from tablewash.llm import encoding, packing
from tablewash.llm.lexicon import Lexicon, compile_lexicon
from tablewash.llm.merges import ByteWords, Encoder, LowerWords, merge_long

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("path, splitter", [(BYTE, ByteWords()), (WORD, LowerWords())])
def test_ids_equal_the_library(path, splitter):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab  \n\t.'sé日1ß́<|Σ,") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += [f"a{chr(c)}b {chr(c)} x" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, splitter).encode(texts)] == want


#: Marks, digits, white space of all kinds, letters whose lower case has more bytes, letters beyond U+024F, special strings.
PARTS = [*"abstdmrvlSTE'' \n\t", "'ll", "'VE", "'re", "it's", "1", "²", "¼", "ß", "É", "é", "İ", "Ⱥ", "Ⱦ", "Σ", "ς", "日", "😀", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "—", "\u0301", "\u0345", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]


@pytest.mark.parametrize("remembered", [0, 30, 500_000])
def test_texts_cut_as_bytes(remembered):
    """All kinds of pieces side by side, with any memory from call to call."""
    rng = random.Random(11)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(4000)] + [None, "", " ", "'", "'s", "x" * 300 + "é" * 200, "日" * 300]
    own, lib = Encoder(WORD, LowerWords(), remembered=remembered), library(WORD)
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [x for at in range(0, len(texts), 500) for x in own.encode(texts[at : at + 500])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert own.encode([]) == [] and own.encode([None, ""]) == [b"", b""]


def test_new_words_cost_few_calls():
    """The cutting of a text takes no Python call per word, also where words come with capitals and marks."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeé", k=8)).capitalize() + rng.choice(["", ",", ".", "'s"]) for _ in range(20_000)]
    own = Encoder(WORD, LowerWords())
    profile = cProfile.Profile()
    profile.runcall(own.encode, [" ".join(words)])
    assert sum(e.callcount for e in profile.getstats()) < 6 * len(words)


def test_long_word_merges_equal_batch_merges():
    own = Encoder(BYTE, ByteWords()).merger
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"theanined") for _ in range(rng.randint(1, 80)))
        assert merge_long(own, word).tolist() == own.merge([word])[0].tolist()


def test_lexicon_finds_exactly_its_words(tmp_path):
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    ids = [np.array([i, i + 1][: 1 + i % 2]) for i in range(len(words))]
    compile_lexicon(words, ids, str(tmp_path / "x"))
    lex = Lexicon(str(tmp_path / "x"))
    others = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for w, n in zip(words + others, lex.find(words + others).tolist()):
        assert n == (words.index(w) if w in words else -1)
        assert n < 0 or lex.ids_of(n).tolist() == ids[n].tolist()
    assert len(lex.final) < sum(map(len, words)) / 3  # beginnings and endings are shared
    compile_lexicon([], [], str(tmp_path / "none"))
    assert Lexicon(str(tmp_path / "none")).find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("words", [0, 50, 5000])
def test_encode_and_decode(spark, odd_docs, sf_docs, words):
    docs = odd_docs.select("doc_id", "text").unionByName(sf_docs.select((sf_docs.doc_id + 1000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in encoding.encode(spark, docs, BYTE, lexicon_words=words, decoded=True).collect()}
    lib = library(BYTE)
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == ids
        assert got[r.doc_id].decoded.decode() == lib.decode(ids, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in encoding.decode(spark, encoding.encode(spark, odd_docs, BYTE, words), BYTE).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert encoding.encode(spark, odd_docs.limit(0), BYTE).count() == 0
    assert sha256(got[0].ids).hexdigest() == sha256(b"").hexdigest()


def check_packing(docs, rows, window=2048):
    lib = library(WORD)
    whole = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(whole)
    for d, ids in whole.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0  # no padding at all


def test_packing_covers_every_id_once(spark, sf_docs, odd_docs):
    check_packing(sf_docs, packing.pack(spark, sf_docs, WORD).collect())
    check_packing(odd_docs, packing.pack(spark, odd_docs, WORD).collect())
    assert packing.pack(spark, odd_docs.limit(0), WORD).count() == 0


def test_small_windows_and_ids(spark, sf_docs):
    rows = packing.pack(spark, sf_docs, WORD, window=64, with_ids=True).collect()
    check_packing(sf_docs, rows, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_neighbours_share_words():
    texts = [np.arange(a, a + 20) for a in (0, 100, 5, 105, 10)]
    shard = packing.Shard([{"ids": t, "used": 0} for t in texts])
    assert shard.neighbours(0).tolist()[:2] == [2, 4]
    shard.left[2] = 0
    assert shard.neighbours(0).tolist()[0] == 4


def test_statistics_of_all_tails(spark, sf_docs):
    """A shard weighs its terms by the whole corpus, not by its own tails."""
    cut = packing.tails(sf_docs, WORD, 2048, False)
    tails = [np.frombuffer(r.ids, packing.wide_of(len(r.ids), r.length)) for r in cut.where("sketch is not null").collect()]
    known = packing.statistics(cut.repartition(5))
    holders = np.zeros(len(known.holders), np.int64)
    for t in tails:
        holders[np.unique(t)] += 1
    assert known.count == len(tails) and known.tokens == sum(map(len, tails)) and np.array_equal(known.holders, holders)
    rows = [{"ids": t, "used": 0} for t in tails]
    whole, part = packing.Shard(rows), packing.Shard(rows[:40], known)
    for slot, term in enumerate(part.terms):
        assert np.allclose(part.index[slot], whole.index[np.searchsorted(whole.terms, term), :40])
