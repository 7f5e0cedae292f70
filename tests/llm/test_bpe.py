import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm.bpe import token_counts, token_ids, transducer

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "don't 'reall'y'll", "a" * 4000, "____----" * 500, "абв" * 900, " " * 2000 + "x", "\U0001f600" * 300, "<|endoftext|> x", "e\u0301\u200d\ufeff", "the" * 700, "1234567890" * 200, "\t\r\n \u00a0\u3000"]


def test_equals_library_and_round_trip(library):
    t = transducer()
    for x in ODD:
        assert t.encode(x) == library(x), x[:20]
        assert t.decode(t.encode(x)) == x


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    mine = transducer()
    want = t.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == want and mine.decode(want) == text


def test_chunks_and_byte_streams():
    t = transducer()
    random.seed(0)
    for x in ODD + ["See docs/__init__/notes, it's a 3 / 4 split.\n" * 20]:
        chunks, i = [], 0
        while i < len(x):
            k = random.randint(1, 40)
            chunks.append(x[i : i + k])
            i += k
        assert list(t.encode_chunks(iter(chunks))) == t.encode(x)
        for p in t.split.findall(x)[:40]:
            raw = p.encode()
            assert list(t.stream(iter([raw[i : i + 1] for i in range(len(raw))]))) == t._merge(raw)


def test_state_is_bounded():
    """A long piece is emitted while it arrives."""
    t = transducer()
    fed = 0

    def feed():
        nonlocal fed
        for _ in range(3000):
            fed += 1
            yield b"ab"

    first = next(t.stream(feed()))
    assert isinstance(first, int) and fed < 8 * t.lookahead


def test_frames(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in token_ids(d).collect()]
    assert sorted(got) == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert sorted(map(tuple, token_counts(d).collect())) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert token_ids(d.where("false")).count() == 0
