import itertools
import random
import re

from spanloom.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(doc, item):
    """Windows that agree, by trying every alignment."""
    a, b = words(doc), words(item)
    n = min(d.WINDOW, len(b))
    if len(b) < d.LEAST_WORDS:
        return 0, None, None
    need = n - d.SUBSTITUTIONS if n == d.WINDOW else n
    at = [i for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if sum(a[i + k] == b[j + k] for k in range(n)) >= need]
    return len(at), min(at, default=None), max(at, default=0) + n - 1


def test_masks_miss_no_two_substitutions():
    for gone in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(not {s + o for o in mask} & set(gone) for mask in d.MASKS for s in range(d.WINDOW - mask[-1]))


def test_against_all_alignments(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([20, 14, 13, 12, 7, 5, 4, 30, 25])] + [(90, None), (91, ""), (None, "q1 q2 q3 q4 q5 q6")]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        source = (rng.choice(items[:9])[1]).split()
        cut = source[rng.randint(0, 3) :]
        for _ in range(rng.randint(0, 4)):
            cut[rng.randrange(len(cut))] = "changed"
        at = rng.randint(0, len(text))
        docs.append((k, " ".join(text[:at]) + ", " + " ".join(cut).upper() + ". " + " ".join(text[at:])))
    docs += [(None, "Q1 q2, q3 q4 q5 q6!"), (None, None), (100, ""), (101, "x " * 30000 + items[0][1])]
    want = {}
    for (i, t), (j, u) in itertools.product(docs, items):
        n, lo, hi = leaks(t, u)
        if n:
            want[i, j] = n, lo, hi
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 seed")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 doc_id")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.last_word) for r in d.find_leaks(a, b).collect()}
    assert got == want and (None, None) in got and (101, 0) in got
    leaked = {i for i, _ in want}
    kept = d.drop_leaks(a, b)
    assert kept.columns == a.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in leaked)


def test_repeated_rows_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "A, b c-d e")], "item_id long, text string")
    assert [tuple(r) for r in d.find_leaks(a, b).collect()] == [(1, 7, 1, 0, 4)]
    assert d.find_leaks(a.limit(0), b).count() == 0 and d.find_leaks(a, b.limit(0)).count() == 0
    assert d.drop_leaks(a, b.limit(0)).count() == 2


def test_without_broadcast(spark, monkeypatch):
    from spanloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    a = spark.createDataFrame([(1, "x y a b c d e z")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    assert [tuple(r) for r in d.find_leaks(a, b).collect()] == [(1, 7, 1, 2, 6)]
