import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spanloom.functions import patterns as p
from spanloom.plans import catalog

TEXTS = ["", "😀CH3 x²", "１２ full", "éa", "a\x1cb", "x y", ".5 5. 1.2.3 a_b", "the IL-2 gene, 3.5%", None]


def model(which, text):
    """Matches of each pattern on what the earlier ones left."""
    taken, out = [False] * len(text), []
    for pattern in which:
        masked = "".join(" " if t else c for c, t in zip(text, taken, strict=True))
        for m in re.finditer(pattern, masked):
            out.append((m.start(), m.end()))
            taken[m.start() : m.end()] = [True] * (m.end() - m.start())
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_spans_follow_the_model(text):
    got = p.spans(p.check_patterns(p.DEFAULT, " "), text)
    assert got == model(p.DEFAULT, text)
    assert all(a < b for a, b in got) and all(b <= c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_tokens_slice_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    for r in p.tokenise(df).collect():
        if r.text is None:
            assert r.tokens is None
        else:
            assert [(t.start, t.stop) for t in r.tokens] == model(p.DEFAULT, r.text)
            assert all(r.text[t.start : t.stop] == t.data for t in r.tokens)


def test_a_column_of_the_same_name_is_replaced(spark):
    df = spark.createDataFrame([("a b", 1)], "text string, tokens int")
    assert p.tokenise(df).columns == ["text", "tokens"]
    assert p.tokenise(df.limit(0)).count() == 0


def test_bad_patterns_and_masks():
    with pytest.raises(ValueError, match="empty"):
        p.check_patterns(["x*"], " ")
    with pytest.raises(ValueError, match="one character"):
        p.check_patterns(["x"], "  ")


def test_transform_and_strip(spark):
    df = spark.createDataFrame([("\x1c Doe, Jane 42 ",), (None,)], "text string")
    native = p.strip(p.transform(F.col("text"), [(r"(\w+), (\w+)", "$2 $1"), (r"\d+", "0")]))
    called = p.transform_by([(r"\d+", lambda m: str(int(m[0]) + 1)), (r"Doe", "Roe")])(F.col("text"))
    rows = df.select(native.alias("a"), called.alias("b")).collect()
    assert rows[0].a == "Jane Doe 0" and rows[0].b == "\x1c Roe, Jane 43 "
    assert rows[1].a is None and rows[1].b is None


def test_codes(spark):
    row = spark.createDataFrame([("G#a_1 G#b G#a_1 #c",)], "x string").select(p.codes(F.col("x")).alias("c")).first()
    assert row.c == ["a_1", "b"]


def test_long_texts_are_tokenised_in_slices(spark, monkeypatch):
    """A worker holds the tokens of about TEXT_BYTES of text, however many rows come at once."""
    texts = [None, "", *(f"é{i} 😀 3.5% " * 12_000 for i in range(30)), "x" * (3 << 20), None, "a b"]
    taken = []
    df = spark.createDataFrame([("a",)], "text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run))
    p.tokenise(df)
    out = list(taken[0](iter([pa.record_batch({"text": texts}), pa.record_batch({"text": pa.array([], pa.string())})])))
    assert all(b.num_rows <= 1 or len("".join(t or "" for t in b["text"].to_pylist()).encode()) <= 1 << 20 for b in out) and len(out) > 5
    rows = [r for b in out for r in zip(b["text"].to_pylist(), b["tokens"].to_pylist(), strict=True)]
    assert [t for t, _ in rows] == texts
    for text, tokens in rows:
        want = None if text is None else p.spans(p.check_patterns(p.DEFAULT, " "), text)
        assert (tokens and [(t["start"], t["stop"], t["data"]) for t in tokens]) == (want and [(a, b, text[a:b]) for a, b in want])


def test_texts_come_to_a_worker_in_batches_of_bytes(spark):
    """Once something is tokenised, also where Spark's bound of rows is far away; a session's own bound stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it)
    docs = spark.range(0, 40, 1, 1).selectExpr("repeat('word ', 200000) text")  # 1 MB each
    try:
        spark.conf.unset(setting)
        p.tokenise(docs)
        n = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
        assert sum(n) == 40 and max(n) <= 9
        spark.conf.set(setting, "2m")
        p.tokenise(docs)
        assert spark.conf.get(setting) == "2m"
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


@pytest.mark.parametrize("name", ["tokenise_spans", "word_encode", "stitch_rows", "reload_spans"])
def test_queries_tokenise_in_slices(spark, monkeypatch, name):
    """What a query hands to workers yields the tokens of 1 MB of text at once, of rows that are shorter."""
    taken, whole = [], type(spark.range(0)).mapInArrow

    def noted(self, run, schema, *more):
        taken.append((run, [f.name for f in schema.fields if f.name != "tokens"]))
        return whole(self, run, schema, *more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noted)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    texts = ["ab, 3.5 é " * 1000] * 400
    assert taken
    for run, columns in taken:
        batch = pa.record_batch({c: pa.array(texts) if c == "text" else pa.nulls(len(texts)) for c in columns})
        n = [b.num_rows for b in run(iter([batch]))]
        assert sum(n) == len(texts) and max(n) * len(texts[0].encode()) <= 1 << 20
