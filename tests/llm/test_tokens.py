import zlib

import numpy as np
import pytest
from conftest_llm import SF
from strikeflow.llm import rans
from strikeflow.llm import tokenfile as T
from strikeflow.llm.queries import QUERIES, tokenizer_file
from strikeflow.llm.shared import Scratch


@pytest.fixture(scope="module")
def path():
    return tokenizer_file("byte_bpe_50k.json")


def expected(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_report(spark, path):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_token_files"](spark, SF).collect())) == expected(rows, path)


def test_odd_rows(odd, path):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = sorted((tuple(r) for r in T.token_file_report(odd, path).collect()), key=lambda r: r[1])
    assert got == expected(rows, path)


def test_pieces_are_cut_at_lone_spaces_only(path):
    words = T.WordIds(path)
    for t in ("", " ", "a", " a", "a ", "a  b", "a b", "it's a  b", "a \u3000b", "x\n y", "x \n y z", "end<|endoftext|> a <|endoftext|>b", "1 2 3", "don 't", "é 中文 b"):
        assert words.encode(t).tolist() == words.whole(t), repr(t)


def test_words_can_be_forgotten(path, monkeypatch):
    monkeypatch.setattr(T, "WORDS_KEPT", 3)
    words = T.WordIds(path)
    for t in ("a b c d e f", "a b x y z", "q r s a b", "a b c"):
        assert words.encode(t).tolist() == words.whole(t)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.LANES * rans.STRIDE, rans.BLOCK - 1, rans.BLOCK, 17 * rans.BLOCK + 5])
def test_round_trip(n):
    tokens = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Table(rans.quantise(np.bincount(tokens, minlength=2)))
    blocks = rans.encode(table, tokens)
    assert (rans.decode(table, blocks) == tokens).all()
    for k, b in enumerate(blocks):  # each block by itself
        assert (rans.decode(table, [b]) == tokens[k * rans.BLOCK : (k + 1) * rans.BLOCK]).all()


def test_size_is_near_the_entropy():
    tokens = np.minimum(np.random.default_rng(1).zipf(1.3, 20 * rans.BLOCK), 50_000).astype(np.uint32)
    share = np.bincount(tokens) / len(tokens)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum() * len(tokens)
    coded = sum(map(len, rans.encode(rans.Table(rans.quantise(np.bincount(tokens))), tokens)))
    assert coded * 8 < 1.1 * bits


def test_damage_is_noticed():
    tokens = np.arange(5000, dtype=np.uint32) % 7
    table = rans.Table(rans.quantise(np.bincount(tokens)))
    (block,) = rans.encode(table, tokens)
    for at in (20, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode(table, [bytes(bad)])


def test_quantise():
    freq = rans.quantise(np.array([0, 1, 10**9, 0, 3] + [1] * 5000))
    assert freq.sum() == 1 << rans.TABLE_BITS and (freq > 0).sum() == 5003 and freq[0] == 0
    assert rans.quantise(np.zeros(3)).sum() == 0


def test_tokens_come_back(spark, path):
    docs = spark.createDataFrame([(2, "hello there"), (1, None)], "doc_id long, text string")
    folder = Scratch(spark, "test").root
    T.write_token_files(docs, folder, path, end_id=50_256)
    got = sorted((tuple(r) for r in T.read_tokens(spark, folder).select("doc_id", "start", "tokens").collect()))
    assert got == [(1, 0, [50256]), (2, 1, [31373, 612, 50256])]


def test_empty(empty, path):
    assert T.token_file_report(empty, path).count() == 0


def test_new_words_are_encoded_together(path):
    words = T.WordIds(path)
    singly = []
    words.whole = lambda t: singly.append(t) or T.WordIds.whole(words, t)
    texts = ["it a1 Ġb é　é <|endoftext|>x", "", "x  y", "a b\n c", "q a1 new's 中文 ퟿", " lead a1", *(f"w{i} v{i} u{i}" for i in range(400))]
    got = words.encode_all(texts)
    # the first word of a text, and texts that can't be cut at every space
    assert sorted(singly) == sorted([t if t in ("", "x  y", "a b\n c", " lead a1") else t.split(" ")[0] for t in texts])
    assert [g.tolist() for g in got] == [T.WordIds.whole(words, t) for t in texts]


def test_words_that_cant_be_told_apart_are_encoded_singly(path):
    words = T.WordIds(path)
    words.leads[:] = False
    for t in ("a b c", "x y z b c"):
        assert words.encode(t).tolist() == words.whole(t)


def test_words_are_looked_up_once_for_many_texts(path, monkeypatch):
    words = T.WordIds(path)
    met = []
    monkeypatch.setattr(words, "learn", lambda new, learn=words.learn: met.append(sorted(new.to_pylist())) or learn(new))
    texts = ["a b c b", "x b　 c", "y c b d\n e", "b", "", "z c c é"] * 50
    for _ in range(2):
        assert [g.tolist() for g in words.encode_all(texts)] == [words.whole(t) for t in texts]
    assert met == [["b", "b　", "c", "d\n", "e", "é"], []]
    assert len(words.words) == len(words.ids) == 6
