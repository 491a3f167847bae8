import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from spanloom.llm import bpe_together
from spanloom.llm import byte_bpe as b
from spanloom.llm.bpe_together import Table

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return b.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "é", "日本", "😀", " ", "  ", "\n", "the", "ing", "12", "!!", "\x1c", "ß", "'s", "\t", "Schiff", "ñ", "́"]
    for _ in range(n):
        yield "".join(rng.choice([*bits, "x" * rng.randint(1, 30), chr(rng.randint(32, 0x2FFF))]) for _ in range(rng.randint(0, 30)))


def test_encodes_as_the_library(ranks, library, monkeypatch):
    # pieces together and each by itself, also when states and pieces are forgotten and texts are cut on the way
    for states, short, once in ((b.MOST_STATES, b.SHORT, b.AT_ONCE), (50, 0, 7), (50, 3, 1), (50, 10_000, 3)):
        monkeypatch.setattr(b, "MOST_STATES", states)
        monkeypatch.setattr(b, "SHORT", short)
        monkeypatch.setattr(b, "AT_ONCE", once)
        monkeypatch.setattr(b, "MOST_PIECES", 20 * once)
        code, back = b.Encoder(ranks, P.PATTERN), b.Decoder(ranks)
        for t in [*texts(600, 1), "", "a" * 5000, "ab" * 3000]:
            ids = code.encode(t)
            assert ids == library.encode_ordinary(t)
            assert back.decode(ids) == t
        many = [None, "", *texts(40, 3), ""]
        assert list(code.encode_all(many)) == [library.encode_ordinary(t or "") for t in many]
        assert list(code.encode_all([])) == []


def test_a_table_of_numbers_is_a_dictionary():
    rng, table, plain = random.Random(5), Table(2), {}
    for _ in range(30):
        new = np.array([k for k in {rng.choice([rng.randrange(50), rng.randrange(1 << 62)]) for _ in range(40)} if k not in plain], np.int64)
        values = np.array([rng.randrange(1 << 31) for _ in new], np.int32)
        table.put(new, values)
        plain.update(zip(new.tolist(), values.tolist(), strict=True))
        asked = np.array([*plain, *range(60)], np.int64)
        assert table.get(asked).tolist() == [plain.get(k, -1) for k in asked.tolist()]
    assert table.get(new[:0]).size == 0


def test_pieces_together_as_by_themselves(ranks, monkeypatch):
    monkeypatch.setattr(bpe_together, "MOST_PAIRS", 100)
    alone, rng = b.Transducer(ranks), random.Random(6)
    together = bpe_together.Together(alone)
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert together.encode([*pieces, *pieces[:9]]) == [tuple(alone.run(p)) for p in [*pieces, *pieces[:9]]]
    assert together.encode([]) == []


def test_small_vocabularies_by_merging():
    rng = random.Random(7)
    for _ in range(30):
        ranks = {bytes([i]): n for n, i in enumerate(b"abc")}
        while len(ranks) < 25:
            x, y = rng.choice(list(ranks)), rng.choice(list(ranks))
            if b.Transducer(ranks).by_merging(x + y) == [x, y]:  # as training joins neighbours
                ranks[x + y] = len(ranks)
        t = b.Transducer(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(200)]
        assert bpe_together.Together(t).encode(pieces) == [tuple(ranks[x] for x in t.by_merging(p)) for p in pieces]


def test_pairs_by_their_edges_agree_with_merging(ranks):
    t, rng = b.Transducer(ranks), random.Random(2)
    ids = list(t.bytes_of)
    for _ in range(4000):
        x, y = rng.choice(ids), rng.choice(ids[:3000])
        both = t.by_merging(t.bytes_of[x] + t.bytes_of[y])
        assert t.closes(x, y) == (both == [t.bytes_of[x], t.bytes_of[y]])


def test_streaming_decode_of_any_bytes(ranks):
    rng, back = random.Random(4), b.Decoder(ranks)
    for _ in range(2000):
        raw = bytes(rng.choice([rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F]) for _ in range(rng.randint(0, 10)))
        ids = [ranks[bytes([x])] for x in raw]
        cut = rng.randint(0, len(ids))
        assert back.feed(ids[:cut]) + back.feed(ids[cut:]) + back.finish() == raw.decode("utf-8", "replace")


def test_a_vocabulary_without_a_byte_is_an_error():
    with pytest.raises(ValueError, match="no token"):
        b.Transducer({b"a": 0}).run(b"ab")
    with pytest.raises(ValueError, match="no token"):
        bpe_together.Together(b.Transducer({b"a": 0})).encode([b"aa", b"ab"])


def test_columns(spark, library):
    rows = [(1, "The end"), (2, None), (3, ""), (None, "x" * 300_000), (1, "The end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' ids", "5 n_tokens")
    coded = b.encode(df, RANKS, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = b.decode(coded, RANKS, to="back").collect()
    assert all(r.back == (r.text or "") and r.ids == library.encode_ordinary(r.text or "") for r in back) and len(back) == 5
    for r in b.round_trip_digest(df, RANKS, P.PATTERN).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert b.round_trip_digest(df.limit(0), RANKS, P.PATTERN).count() == 0
