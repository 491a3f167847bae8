import gzip

import pytest

from pyspark.sql import functions as F

from spanloom.operators import corpus
from spanloom.sources import abstracts as a
from spanloom.sources.annotated_xml import read_annotated_xml
from spanloom.sources.vectors import read_word_vectors


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "abstracts").write_text("101\tA title \tA body.\n102\tOther\tText 😀 here\n101\tAgain\tB\n")
    (tmp_path / "annotations").write_text(
        "101\tA\t2\t6\tbody\tFAMILY\n101\tT\t2\t7\ttitle\tTRIVIAL\n101\tA\t0\t1\tA\tX\n101\tA\t3\t3\t\tEMPTY\n103\tZ\t0\t1\tq\tY\n"
    )
    (tmp_path / "borders").write_text("101\tA\t0:7\n101\tT\t0:7\n102\tA\t0:0\n")
    return tmp_path


def test_corpus(spark, files):
    rows = a.read_corpus(spark, str(files / "abstracts"), str(files / "annotations"), str(files / "borders"))
    got = [(r.id, r.part, r.text, [tuple(x) for x in r.annotation], [tuple(x) for x in r.borders]) for r in corpus.records(rows).collect()]
    assert len(got) == 6
    assert (101, "T", "A title", [(2, 7, "TRIVIAL")], [(0, 7)]) in got
    assert (101, "A", "A body.", [(0, 1, "X"), (2, 6, "FAMILY")], [(0, 7)]) in got
    assert (102, "A", "Text 😀 here", [], [(0, 0)]) in got
    assert (101, "A", "B", [(0, 1, "X"), (2, 6, "FAMILY")], [(0, 7)]) in got
    other = {r.id: r for r in a.read_annotations(spark, str(files / "annotations")).collect()}
    assert other[103].title == [] and other[103].body == []


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x").write_text("7\ttitle\t\n")
    with pytest.raises(Exception, match="3 fields"):
        a.read_abstracts(spark, str(tmp_path / "x")).collect()
    (tmp_path / "y").write_text("7\tT\t3\t1\tq\tL\n")
    with pytest.raises(Exception, match="stops before"):
        a.read_annotations(spark, str(tmp_path / "y")).collect()


def test_ids_must_agree(spark):
    df = spark.range(1).select(
        F.struct(F.lit(1).cast("bigint").alias("id"), F.lit("t").alias("title"), F.lit("b").alias("body")).alias("text"),
        F.struct(F.lit(2).cast("bigint").alias("id"), F.array().cast(corpus.SPANS).alias("title"), F.array().cast(corpus.SPANS).alias("body")).alias("annotation"),
    )
    with pytest.raises(Exception, match="ids of text and annotation differ"):
        corpus.records(df).collect()


def test_mapping(spark):
    assert corpus.parse_mapping(["a:1", "b:2", "a:3"]) == {"a": 3, "b": 2}
    for bad in ("a", "a:1:2", "a:x"):
        with pytest.raises(corpus.AnnotationError):
            corpus.parse_mapping([bad])
    with pytest.raises(Exception, match="name:number"):
        corpus.mapping_table(spark.createDataFrame([("a:1:2", 0)], "item string, ord int")).collect()


XML = """<set><article><articleinfo><bibliomisc>MEDLINE:95</bibliomisc></articleinfo>
<title><sentence><cons lex="x" sem="G#protein"><cons sem="G#dna_part">IL-2</cons> gene</cons> is</sentence></title>
<abstract><sentence>We <cons sem="G#cell">T cells</cons>.</sentence><sentence>Two
<cons sem="G#cell"><w>a</w></cons><cons sem="G#x"></cons></sentence></abstract></article></set>"""


def test_annotated_xml(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    r = read_annotated_xml(spark, str(tmp_path / "one.xml")).first()
    assert (r.text.id, r.text.title, r.text.body) == (95, "IL-2 gene is", "We T cells.Two a")
    assert [tuple(x) for x in r.annotation.title] == [(0, 4, "dna_part")]
    assert [tuple(x) for x in r.annotation.body] == [(3, 10, "cell"), (15, 16, "cell")]
    assert [tuple(x) for x in r.borders.body] == [(0, 11), (12, 17)]
    for bad in ('<cons sem="G#a G#b">q</cons>', "<cons>q</cons>"):
        (tmp_path / "bad.xml").write_text(XML.replace("We ", bad))
        with pytest.raises(Exception, match="AnnotationError: one code is needed"):
            read_annotated_xml(spark, str(tmp_path / "bad.xml")).collect()


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    one = XML[XML.index("<article>") : XML.index("</set>")]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE set>\n<!-- all -->\n<set>'
    articles = [one.replace("MEDLINE:95", f"MEDLINE:{k}").replace("We ", "Wé &amp; <article-like/>" * (k % 7)) for k in range(400)]
    (tmp_path / "many.xml").write_text(head + "\n\n".join(articles) + "\n</set>\n", encoding="utf-8")
    (tmp_path / "none.xml").write_text("<set></set>")
    for size in ("1000", "777", "128m"):  # articles across the borders of splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            split = read_annotated_xml(spark, str(tmp_path))
            if size != "128m":
                assert split.rdd.getNumPartitions() > 100
            got = sorted(map(str, split.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == 400 and got == sorted(map(str, read_annotated_xml(spark, str(tmp_path), whole_files=True).collect()))


def test_word_vectors(spark, tmp_path):
    with gzip.open(tmp_path / "v.txt.gz", "wt") as f:
        f.write('the 0.1 0.2\n" 1 2\nNA 3 4\n')
    rows = read_word_vectors(spark, str(tmp_path / "v.txt.gz")).orderBy("idx").collect()
    assert [r.word for r in rows] == ["the", '"', "NA"] and rows[2].vector == [3.0, 4.0]
