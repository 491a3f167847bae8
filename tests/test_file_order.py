from spanloom.operators import corpus
from spanloom.sources import abstracts as a
from spanloom.sources.vectors import read_word_vectors


def test_files_are_read_by_name_whatever_their_size(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.txt").write_text("first 1 2\n")
    (tmp_path / "v" / "b.txt").write_text("".join(f"w{i} {i} 0.5\n" for i in range(5000)))
    rows = read_word_vectors(spark, str(tmp_path / "v")).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(5001)) and rows[0].word == "first" and rows[-1].word == "w4999"
    for name in "abc":
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "1").write_text("5\told title\told\n")
    (tmp_path / "a" / "2").write_text("".join(f"{i}\tt\tb\n" for i in range(10, 4000)))
    (tmp_path / "b" / "1").write_text("5\tT\t0\t3\told\tX\n5\tT\t0\t3\told\tY\n")
    (tmp_path / "c" / "1").write_text("5\tT\t0:4\n5\tT\t4:9\n")
    (tmp_path / "c" / "2").write_text("".join(f"{i}\tT\t0:1\n" for i in range(10, 4000)) + "5\tT\t9:10\n")
    got = corpus.records(a.read_corpus(spark, *(str(tmp_path / x) for x in "abc"))).where("id = 5 and part = 'T'").collect()
    assert [[tuple(x) for x in r.annotation] for r in got] == [[(0, 3, "X"), (0, 3, "Y")]]
    assert [[tuple(x) for x in r.borders] for r in got] == [[(0, 4), (4, 9), (9, 10)]]
