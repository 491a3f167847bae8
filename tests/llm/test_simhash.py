import random
import re

import numpy as np
import xxhash

from spanloom.llm import simhash as s
from spanloom.llm.graph import connected_components, local_components


def plain_print(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0


def plain_groups(prints):
    a = np.array(prints, np.uint64)
    return local_components(len(a), *np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3))


def dense(seed, n):
    rng, out = random.Random(seed), set()
    for base in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(n):
            v = base
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 3)})


def test_fingerprints():
    for t in [None, "", " \t", "One", "one TWO", "a b c a b c", "É é À " * 5, "x\x0by\x0cz\xa0w", "word " * 70_000]:
        assert s.fingerprint(t) == plain_print(t)


def test_index_finds_all_pairs():
    a = np.array(dense(1, 300), np.uint64)
    a = a[np.argsort(s.gray_rank(a))]
    index = s.GrayIndex(a)
    got = {(int(i), int(j)) for x, y in index.join(index, 3) for i, j in zip(x, y, strict=True)}
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))
    left, right = s.GrayIndex(a[:7]), s.GrayIndex(a[7:])
    got = {(int(i), int(j) + 7) for x, y in left.join(right, 3) for i, j in zip(x, y, strict=True)}
    assert got == {(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if p < 7 <= q}


def test_links_connect_the_same_groups_whatever_the_segments(spark):
    a = dense(2, 400)
    label = plain_groups(a)
    df = spark.createDataFrame([(int(x),) for x in np.array(a, np.uint64).view(np.int64)], "fp long")
    for segment in (s.SEGMENT, 60):
        got = {r.node: r.root for r in connected_components(s.fingerprint_links(df, segment)).collect()}
        own = np.array(a, np.uint64).view(np.int64).tolist()
        first, second = {}, {}
        for x, g in zip(own, label.tolist(), strict=True):
            assert first.setdefault(g, got.get(x, x)) == got.get(x, x)
            assert second.setdefault(got.get(x, x), g) == g


def rows():
    base = " ".join(f"w{i}" for i in range(400))
    return [
        (5, base), (3, base), (9, base + " end"), (None, base), (7, "own text of its own kind here"), (2, None), (4, ""), (8, " \n"), (11, "Lone"),
        (7, "own text of its own kind here"), (12, "x" * 200_000),
    ]


def test_near_duplicates(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 fp", "2 root", "3 component_id")
    got = sorted(map(tuple, s.near_duplicates(docs).collect()), key=str)
    prints = [plain_print(t) for _, t in rows()]
    label = plain_groups(prints)
    want = []
    for (i, _), p, g in zip(rows(), prints, label, strict=True):
        want.append((i, f"{p:016x}", min(k for (k, _), h in zip(rows(), label, strict=True) if h == g and k is not None)))
    assert got == sorted(want, key=str)
    assert s.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 fp", "2 root", "3 component_id", "4 low")
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 11, 12]
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "quite another text"), (1, "third one here")], "doc_id long, text string")
    assert sorted((r.text for r in s.keep_one(nameless).collect())) == ["a b c", "quite another text", "third one here"]
    assert s.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {300: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_rows_of_one_id_in_different_groups(spark):
    texts = ["one text of the first kind", "quite another text is here", "and a third that is like none"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1]), (6, texts[2]), (6, texts[0] + " x y z u v w"), (6, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 root", "3 component_id")
    assert sorted((r.doc_id, r.text) for r in s.keep_one(docs).collect()) == sorted([rows[0], *rows[2:5]])
