from collections import Counter, defaultdict

from spanloom.llm import line_dedup as d


def model(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        pages[host] += 1
        seen[host].update({x.strip(d.BLANKS) for x in (text or "").split("\n")} if text is not None else ())
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        bad = {k for k, n in seen[host].items() if k and n >= least and n / pages[host] > ratio}
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(d.BLANKS) not in bad]
        out.append((i, "\n".join(kept) if bad else text, len(lines), len(lines) - len(kept) if bad else 0))
    return sorted(out, key=str)


def test_against_the_model(spark):
    rows = [(i, f"head \nline {i}\n\nline {i % 7}\nhead", "a") for i in range(30)]
    rows += [(100 + i, "head\nown " + str(i), "b") for i in range(3)] + [(200 + i, "Menu\t\nbody", None) for i in range(9)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "head", "a"), (302, "head", "a"), (None, "head\n" + "x" * 500_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 a", "2 b", "3 n", "4 k")
    got = d.drop_boilerplate_lines(df)
    assert got.columns == [*df.columns, "__sl_lines", "__sl_dropped"]
    have = sorted(((r.doc_id, r.text, r["__sl_lines"], r["__sl_dropped"]) for r in got.collect()), key=str)
    assert have == model(rows, d.MAX_RATIO, d.MIN_PAGES)
    assert (302, "", 1, 1) in have and (100, "head\nown 0", 2, 0) in have


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert d.drop_boilerplate_lines(df).count() == 0


def test_exactly_the_ratio_stays(spark):
    rows = [(i, "common" if i < 5 else f"own {i}", "h") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.text for r in d.drop_boilerplate_lines(df, max_ratio=0.1).where("doc_id < 5").collect()} == {"common"}
    assert {r.text for r in d.drop_boilerplate_lines(df, max_ratio=0.0999).where("doc_id < 5").collect()} == {""}
