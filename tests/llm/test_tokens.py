import array
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, tokencount, tokenfile
from tidemark.llm.tokens import PieceEncoder, pack_ids, tokenizer_path

ODD = [" ", "  ", "\n", "\t", "a", "É", "é", "́", "<|endoftext|>", "<|startoftext|>", "'s", "'", "1", "漢", "\x1c", "　", ".", "foo", "Bar", "ß", "\xa0", "\r", "İ", "Σ", " \n", "###", "don't", "x" * 60]
TEXTS = [None, "", " ", "plain words here", "two  spaces", "tail ", "line\nline.\nLast", "<|endoftext|> and <|endoftext|>x", "word " * 3000, "y" * 30_000, "퟿", "é" * 5]


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(found):
    return zlib.crc32(array.array("I", found).tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1), (3, "other", "de", None, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_librarys_ids(name):
    r = random.Random(3)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(16))) for _ in range(4000)]
    e = PieceEncoder(tokenizer_path(name))
    whole = e.whole(texts)
    assert e.encode(texts) == whole and e.encode(texts) == whole  # the second time from the cache


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_with_runs_of_white_space(name):
    """Texts are cut beside any white space just where the library cuts them: nothing is encoded whole."""
    import random

    pieces, tokenizer = PieceEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    r = random.Random(1)
    parts = ["the", " ", "  ", "\n", " \n", "\t", " \t", "word", "Été", "'s", "12", ".", "...", "\r\n", "\u00a0", "\x1c", "  \n  ", "foo-bar", " x", "y ", "\u3000", "it's"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)] + [" ", "  ", "a  ", "  a", "\n a  b\n\n  c "]
    for text, packed in zip(texts, pieces.encode(texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert packed == pack_ids(want) and sum(pieces.count(pieces.spelled(pieces.pre_tokens(text)))) == len(want)


def test_a_full_cache_changes_nothing(monkeypatch):
    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    monkeypatch.setattr(tokens, "CACHE_CORE", 2)
    e = PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"some words {i} and others" for i in range(50)]
    assert [i for t in texts for i in e.encode([t])] == e.whole(texts)
    assert len(e.cache) < 20


def test_differencing_balances():
    r = random.Random(1)
    for _ in range(50):
        sizes = [r.randrange(1, 1000) for _ in range(r.randrange(0, 80))]
        k = r.randrange(1, 12)
        sets = packing.differencing(sizes, k)
        assert len(sets) == k and sorted(i for s in sets for i in s) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= max(sizes, default=0)
        windows = packing.pack_group(sizes, 1000)
        assert all(sum(sizes[i] for i in s) <= 1000 for s in windows)


def test_differencing_merges_opposing_imbalances():
    assert {sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)} == {14, 16}
    assert [sum([5, 5, 5, 5][i] for i in s) for s in packing.differencing([5, 5, 5, 5], 4)] == [5, 5, 5, 5]


def test_packing_loses_no_id(docs):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, window=64, piece=16, group_windows=4, with_ids=True).collect()
    expected = sorted((str(r.doc_id), ids(tokenizer, r.text) + [2]) for r in docs.collect())
    by_doc = {}
    for p in rows:
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append(p)
    assert sum(p.length for p in rows) == sum(len(x) for _, x in expected)
    for p in rows:
        own = list(np.frombuffer(p.ids, "<u4"))
        assert crc(own) == p.ids_crc32 and len(own) == p.length
        assert any(d == str(p.doc_id) and x[p.start : p.start + p.length] == own and len(x) == p.doc_tokens for d, x in expected)
    sequences = {}
    for p in rows:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 64
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_pads_little(spark, sf_dir):
    rows = packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)).collect()
    used = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * 4096 < used * 1.06


def test_counts_equal_encoding(docs):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs).collect())
    assert got == sorted((str(r.doc_id), len((r.text or "").encode()), n := len(ids(tokenizer, r.text)), n > 512) for r in docs.collect())
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "COUNT_BITS", 2)
    block = tokencount._Block()
    for k in range(20):
        block.add(k, "x", ["a"] * 10 + [f"b{k}"], 0)
    entries, bounds = block.lists()
    assert len(bounds) == 22
    assert sum(int(e) & 3 for e in entries[: bounds[1]]) == 200 and bounds[1] == 20 * 4


def test_token_files(docs):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(docs).collect())
    assert [r[1] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: -1 if x is None else x)
    assert [r[0] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    expected = sorted((str(r.doc_id), crc(ids(tokenizer, r.text) + [0])) for r in docs.collect())
    assert sorted((str(r[1]), r[3]) for r in got) == expected
    assert tokenfile.round_trip(docs.limit(0)).count() == 0


def test_simple8b_round_trips():
    r = np.random.default_rng(0)
    for t in range(200):
        n = int(r.integers(0, 900))
        v = (r.integers(0, 1 << r.integers(1, 62, n)) if t % 2 else r.integers(0, 512, n)).astype(np.uint64)
        if n and t % 3 == 0:
            v[r.integers(0, n, 5)] = np.uint64((1 << 64) - 1)
            v[r.integers(0, n, 5)] = np.uint64(tokenfile.ESCAPE)
            v[r.integers(0, n, 3)] = tokenfile.ESCAPED
        if t % 5 == 0:
            v[:] = 0
        words = tokenfile.encode_block(v)
        assert (tokenfile.decode_block(words, n) == v).all()
    assert len(tokenfile.encode_block(np.zeros(240, np.uint64))) == 1
    assert len(tokenfile.encode_block(np.full(60, 1, np.uint64))) == 1


def test_files_of_many_blocks(tmp_path, monkeypatch):
    from tidemark.llm.shards import committed, filesystem

    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 100)
    fs, place = filesystem(f"{tmp_path}/x.s8b")
    rows = [(k if k else None, np.arange(k * 37 % 251, dtype="<u4")) for k in range(40)]
    with committed(fs, place) as out:
        w = tokenfile._FileWriter(out)
        for k, x in rows:
            w.add(k, x)
        w.finish()
    back = list(tokenfile.read_documents(fs, place))
    assert [b[0] for b in back] == [r[0] for r in rows] and all((a[1] == b[1]).all() for a, b in zip(rows, back))
