"""The pipeline against a plain version of each stage."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_decontaminate import leaks
from test_line_dedup import model
from test_simhash import plain_groups, plain_print

import corpus_pipeline
from spanloom.llm import byte_bpe, line_dedup
from spanloom.llm import toxicity as t


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    machine = t.fit(*t.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 3, 1))
    rows = [r for r in rows if machine.score(t.term_buckets(r[1])) < t.THRESHOLD]
    source = {r[0]: r[2] for r in rows}
    rows = [(i, text, source[i]) for i, text, _, _ in model(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)]
    label = plain_groups([plain_print(x[1]) for x in rows])
    low = {}
    for r, g in zip(rows, label.tolist(), strict=True):
        low[g] = min(low.get(g, r[0]), r[0])
    rows = [r for r, g in zip(rows, label.tolist(), strict=True) if low[g] == r[0]]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 4]) for x in items for w in [x.lower().replace(".", " ").replace(",", " ").split()] for i in range(len(w) - 3)}

    def near(text):
        w = (text or "").lower().replace(".", " ").replace(",", " ").split()
        return any(tuple(w[i : i + 4]) in grams for i in range(len(w) - 3))

    rows = [r for r in rows if not (near(r[1]) and any(leaks(r[1], x)[0] for x in items))]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want[i] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_on_odd_tables(spark, sf_dir):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "x" * 100_000, None, "s", 9)], kinds)
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, sf_dir).columns == odd.columns, name
    clash = odd.selectExpr("*", "1 fp", "2 line", "3 score", "4 item_id", "5 component_id", "6 ids")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, sf_dir).columns == clash.columns, name
    assert np.isin([r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, clash, sf_dir).collect()], [1, 2, 3, None]).all()
