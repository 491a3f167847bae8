import io
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanloom.llm import token_files as f

WORDS = P.path("word_bpe_49k.json")


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_planes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        for bits in (False, True):
            planes = f.to_planes(ids, bits)
            assert len(planes) == (32 if bits else 4) and (f.from_planes(planes, n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_shards(bits, monkeypatch):
    monkeypatch.setattr(f, "BLOCK", 64)
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 50000, rng.integers(0, 300), dtype=np.uint32)) for i in range(40)]
    out = File()
    writer = f.ShardWriter(out, bits)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    reader = f.ShardReader(out)
    flat = np.concatenate([ids for _, ids in docs])
    assert reader.total == len(flat) and (reader.chunk(3) == flat[192:256]).all()  # any chunk by itself
    at = 0
    for (i, ids), (j, before, pieces) in zip(docs, reader.documents(), strict=True):
        assert (i, at) == (j, before) and b"".join(pieces) == ids.tobytes()
        at += len(ids)


def ids_of(code, texts):
    return [np.frombuffer(raw, "<u4").tolist() for raw in code.encode_batch(pa.array(texts, pa.string()))]


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(WORDS)
    texts = ["", None, "It's 3.5% of the Ünïcode text…", "a\x1c!b c\u0085d", "one<|endoftext|> ΑΣ Σ <|startoftext|>", "é ́x 日本 😀", "x" * 5000, "İ. ŉ, A.. b., c.\x01 \x01"]
    assert ids_of(f.WordEncoder(WORDS), texts) == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_random_texts_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(f, "MOST_WORDS", 50)
    monkeypatch.setattr(f, "TEXT_BYTES", 300)
    whole, code = Tokenizer.from_file(WORDS), f.WordEncoder(WORDS)
    rng = random.Random(3)
    bits = [*"abAB.,'sT\u0130\u0301\x1c\x1f\x85 \t\n\u200b\u3000\u00e91\u00b2\u00bd\u00df\u03c2\u0958", "<|endoftext|>", "\x01", "中", "😀", "word", "Word.", "'re", "ŉ", "\u1112\u1161"]
    for _ in range(4):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(400)]
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids_of(code, texts) == want
        assert [np.frombuffer(raw, "<u4").tolist() for raw in code.encode_batch(pa.array(texts).slice(150, 200))] == want[150:350]


def test_round_trip(spark, tmp_path):
    rows = [(9, "nine words"), (3, None), (None, "null id"), (5, ""), (4, "word " * 40_000), (3, "three"), (3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start", "2 ids", "3 shard").repartition(3)
    manifest = f.write_token_files(df, f"file://{tmp_path}/out", WORDS, 2, shards=4)
    listed = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert listed["n_ids"] == sum(s["n_ids"] for s in listed["shards"])
    got = f.read_token_files(spark, manifest).orderBy("start").collect()
    whole = Tokenizer.from_file(WORDS)
    assert [r.doc_id for r in got] == [None, 3, 3, 3, 4, 5, 9]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    want = sorted((i or -1, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == want
    digest = {(r.start, r.ids_crc32) for r in f.read_token_files(spark, manifest, digest=True).collect()}
    assert digest == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    none = f.write_token_files(df.limit(0), f"file://{tmp_path}/none", WORDS, 2)
    assert f.read_token_files(spark, none).count() == 0
