import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import substring_dedup as s


def split(text):
    return (text or "").encode().lower().split()


def repeated(rows, n=50):
    """Words in runs of n that stand in two different rows."""
    where = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = split(t)
        for j in range(len(w) - n + 1):
            where[tuple(w[j : j + n])].add(k)
    out = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = split(t)
        for j in range(len(w) - n + 1):
            if len(where[tuple(w[j : j + n])]) > 1:
                out[k].update(range(j, j + n))
    return out


def plain_shingles(text):
    w = split(text)
    return [tuple(w[i : i + s.SHINGLE]) for i in range(len(w) - s.SHINGLE + 1)]


def test_shingles():
    texts = ["a b\x0bc\x0cd e f g", "", None, "A  b C d\te\nf G", " x" * 3, "q " * 7, "é É \x1c 日本 b c d\xa0e"]
    base, text = s.shingles(pa.array(texts))
    seen = {}
    want = [(k, g) for k, t in enumerate(texts) for g in plain_shingles(t)]
    for value, (k, gram), of in zip(base.tolist(), want, text.tolist(), strict=True):
        assert seen.setdefault(gram, value) == value and of == k
    assert len(set(seen.values())) == len(seen)
    assert all(len(x) == 0 for x in s.shingles(pa.array([], pa.string())))
    for a in range(len(texts)):
        assert s.shingles(pa.array(texts).slice(a, 3))[0].tolist() == s.shingles(pa.array(texts[a : a + 3]))[0].tolist()


def cartesian(values, first, n, out):
    """Places of the nodes of the Cartesian tree of the values down to subtrees of n; each of equal minima is one."""
    if len(values) >= n:
        low = int(values.argmin())
        out.add(first + low)
        cartesian(values[:low], first, n, out)
        cartesian(values[low + 1 :], first + low + 1, n, out)
    return out


def test_minima_are_the_nodes_of_compact_windows():
    rng = np.random.default_rng(2)
    for n in (0, 3, 5, 9, 60, 300):
        values, text = rng.permutation(n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        want = set()
        for t in range(4):
            at = np.flatnonzero(text == t)
            want |= cartesian(values[at], at[0], 5, set()) if len(at) else set()
        assert set(np.flatnonzero(s.minima(values, text, 5)).tolist()) == want
        tied = values % 3
        got = s.minima(tied, text, 5)
        for i in range(n - 4):
            if text[i] == text[i + 4]:
                assert got[i : i + 5][tied[i : i + 5] == tied[i : i + 5].min()].all()
    values = rng.integers(0, 2**63, 60).astype(np.uint64)
    same = np.tile(values[:9], 5)
    for w in (2, 3, 7, 11, 21, 41):
        assert len(np.unique(s.run_hashes(same, w)[::9])) == 1 and len(np.unique(s.run_hashes(values, w))) == 61 - w


def plainly_alike(a, b):
    def good(x, y):
        y, out = set(y.tolist()), set()
        for i in range(len(x) - s.SPAN + 1):
            if sum(v in y for v in x[i : i + s.SPAN].tolist()) >= s.SPAN - s.MISSES:
                out.update(range(i, i + s.SPAN))
        return out

    there = good(b, a)
    here = good(a, b[sorted(there)])
    there = good(b, a[sorted(here)])
    return (here, there) if there else (set(), set())


def test_alike():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, 400, 150).astype(np.uint32)
        b = np.concatenate([rng.integers(0, 400, rng.integers(0, 60)), a[20 : rng.integers(60, 100)], rng.integers(0, 300, rng.integers(0, 30))]).astype(np.uint32)
        b[rng.integers(0, len(b), 2)] = 999
        found = s.alike(a, b)
        assert tuple(set(np.flatnonzero(x).tolist()) for x in found) == plainly_alike(a, b)
        assert all(set(range(first, last + 1)) <= set(np.flatnonzero(found[0]).tolist()) for first, last in s.runs(found[0]))
    assert not any(x.any() for x in s.alike(a[:45], a))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line, long = text(50), text(12), text(300)
    near = long.split()
    near[100], near[200] = "changed", "too"
    out = [(i, " ".join([text(rng.randint(0, 80)), line, text(rng.randint(5, 80))])) for i in range(40)]
    out += [(100 + i, " ".join([text(rng.randint(0, 60)), shared, line, text(rng.randint(0, 60))])) for i in range(12)]
    out += [(200, long), (201, "PRE " + long.upper()), (202, " ".join(near)), (203, long), (204, text(49)), (None, "nul " + shared)]
    out += [(300, None), (301, ""), (302, text(49)), (303, text(60) + " " + shared + " " + text(70) + " " + shared)]
    return out + [(302, out[-2][1]), (205, out[46][1])]


def test_exact_passages_are_all_found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 tid", "2 key", "3 first", "4 component_id")
    need = defaultdict(set)
    for k, places in repeated(rows).items():
        need[rows[k][0]] |= places
    for parts in (1, 40):  # what meets within a slice and what meets across them
        got, covered = s.repeated_passages(df.repartition(parts)).collect(), defaultdict(set)
        for r in got:
            assert r.n_words == r.last_word - r.first_word + 1 >= 50
            covered[r.doc_id].update(range(r.first_word, r.last_word + 1))
        assert all(need[i] <= covered[i] for i in need)
        assert set(covered) == set(need) | {202}
        assert len(covered[202]) == 300  # near copy: one word in 100 changed
        names = {r.doc_id: r.component_id for r in got}
        assert {names[i] for i in (200, 201, 202, 203)} == {200} and {names[i] for i in [*range(100, 112), None, 303, 205]} == {100}
        assert all(len(covered[i]) <= len(need[i]) + 4 * s.MISSES for i in need)
    assert s.repeated_passages(df.limit(0)).count() == 0


def test_a_third_of_rows_alike(spark):
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(i, text) for i in range(60)] + [(100 + i, " ".join(f"u{i * 100 + k}" for k in range(60))) for i in range(60)]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(60)) and {(r.first_word, r.last_word, r.component_id) for r in got} == {(0, 79, 0)}


def covered(got):
    out = defaultdict(set)
    for r in got:
        out[r.doc_id].update(range(r.first_word, r.last_word + 1))
    return out


def test_passages_that_begin_with_a_common_phrase(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(8):
        phrase = text(44)
        rows += [(10_000 + 100 * k + i, f"{text(30)} {phrase} {text(30)}") for i in range(60)]
        for i in range(6):
            end = text(6)
            rows += [(j + 10 * k + i, f"{text(20)} {phrase} {end} {text(20)}") for j in (1000, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 24):
        got = s.repeated_passages(df.repartition(parts)).collect()
        found = covered(got)
        assert set(found) == {j + 10 * k + i for k in range(8) for i in range(6) for j in (1000, 2000)}
        assert all(set(range(20, 70)) <= places for places in found.values())
        assert all(r.component_id == 1000 + r.doc_id % 1000 for r in got)


def test_passages_around_a_common_line_of_any_length(spark):
    """Of 30 texts that share a line two share 50 words about it."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**8)}" for _ in range(n))
    rows, pairs = [], []
    for k in range(60):
        n = 40 if k < 30 else 20 + (k - 30)
        line, before, after = text(n), text((50 - n) // 2), text(50 - n - (50 - n) // 2)
        a, b = rng.sample(range(30), 2)
        pairs.append({1000 * k + a, 1000 * k + b})
        for i in range(30):
            own = f"{before} {line} {after}" if i in (a, b) else line
            rows.append((1000 * k + i, f"{text(60)} {own} {text(60)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 16):
        got = s.repeated_passages(df.repartition(parts)).collect()
        groups, found = defaultdict(set), covered(got)
        for r in got:
            groups[r.component_id].add(r.doc_id)
        by_line = defaultdict(set)
        for i in found:
            by_line[i // 1000].add(i)
        assert all(pair in groups.values() for pair in pairs if len(by_line[min(pair) // 1000]) == 2)
        assert all(set(range(60, 110)) <= found[i] for pair in pairs for i in pair)
        assert all(len(by_line[k]) == 2 for k in range(30))  # 40 words alone aren't enough; 45 and more are, with misses


def test_a_word_repeated_without_end(spark):
    rows = [(1, "a " * 100_000), (2, "b " + "a " * 100_001), (3, "a b " * 50_000), (4, "c " * 100_000)]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_word, r.last_word, r.component_id) for r in got} >= {(1, 0, 99_999, 1)}
    assert {r.doc_id for r in got} == {1, 2}


def test_near_passages_of_the_least_similarity_are_found(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(600):
        n, changed = ((50, [25]), (55, [rng.randrange(55)]), (75, [25, 50]))[i % 3]
        one = text(n).split()
        two = [f"x{k}" if k in changed else w for k, w in enumerate(one)]
        rows += [(j + i, " ".join([text(20), *words, text(20)])) for j, words in ((1000, one), (2000, two))]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert all(r.component_id == 1000 + r.doc_id % 1000 for r in got)


def test_near_passages_among_texts_that_share_a_part(spark):
    """Two texts hold 24 and 25 words with one of their own between; nine more hold both with 20 of their own between."""
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows = []
    for k in range(60):
        one, two = (text(24), text(25)) if k % 2 else (text(25), text(24))
        rows += [(1000 * k + i, f"{text(30)} {one} {text(1 if i < 2 else 20)} {two} {text(30)}") for i in range(11)]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.first_word, r.last_word, r.component_id) for r in got} == {(1000 * k + i, 30, 79, 1000 * k) for k in range(60) for i in (0, 1)}


def test_what_many_texts_share_as_brute_force_finds_it():
    """Every text counts as one of a large group: what _about tells of them against a comparison of each with each."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    line, rows = text(90), []
    for _ in range(60):
        w = list(line)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = text(rng.randrange(2))
        at = rng.randrange(50)
        rows.append(" ".join([*text(rng.randrange(40)), *w[at : at + rng.randrange(25, 90)], *text(30)]))
    base, of = s.shingles(pa.array(rows))
    at, key = s.signatures(base, of)
    batch = pa.RecordBatch.from_pydict({"tid": list(range(60)), "text": rows, "keys": [np.unique(key[of[at] == i].view(np.int64)).tolist() for i in range(60)]})
    slices = [batch.slice(0, 25), batch.slice(25)]
    around = pa.Table.from_batches(s._around(iter(slices))).sort_by("part").combine_chunks().to_batches()
    run = s._by_key(["part", "kind", "tid", "first", "last"], s._about, "near")
    spans, links = defaultdict(set), {i: i for i in range(60)}

    def root(i):
        return i if links[i] == i else root(links[i])

    for r in pa.Table.from_batches(run(iter(around))).to_pylist():
        if r["kind"] == 2:
            spans[r["tid"]].update(range(r["first"], r["last"] + 1))
        else:
            links[max(root(r["tid"]), root(r["part"]))] = min(root(r["tid"]), root(r["part"]))
    want, met = defaultdict(set), {i: i for i in range(60)}
    for i in range(60):
        for j in range(i):
            found = s.alike(base[of == i], base[of == j])
            for k, places in zip((i, j), found, strict=True):
                want[k].update(w for first, last in s.runs(places) for w in range(first, last + s.SHINGLE))
            if found[0].any():
                a, b = sorted((met[i], met[j]))
                met = {k: a if m == b else m for k, m in met.items()}
    assert sum(map(bool, want.values())) > 20
    assert {i: p for i, p in spans.items() if p} == {i: p for i, p in want.items() if p}
    assert {i: root(i) for i in range(60)} == met
