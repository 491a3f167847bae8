"""Queries over the sources: a table is written out in a source's format, to several files, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, segments
from ..session import work_folder, written
from ..sources import abstracts, annotated_xml, vectors
from .text_queries import read

#: Files that a table is written to at least, by its key, and bytes of one about.
FILES, FILE_BYTES = 4, 128 << 20
#: Code points that lines of these formats can hold.
PLAIN, PLAIN_SQL = r"[^\p{L}\p{N}.,;!?'-]+", r"[^\p{L}\p{N}.,;!?''-]+"


def _put(lines: DataFrame, label: str, order: str = "ord") -> str:
    """Writes value in order, file by file (file), to a new folder; files' names follow the numbers in file."""
    path = f"{work_folder(lines.sparkSession)}/{label}-{uuid.uuid4().hex}"
    named = lines.withColumn("file", F.format_string("%09d", F.col("file").cast("bigint")))
    named.repartition("file").sortWithinPartitions("file", order).select("file", "value").write.partitionBy("file").text(path)
    return path


def _files(df: DataFrame, *texts: str) -> int:
    """How many files the rows' texts ask for."""
    size = df.agg(F.sum(sum(F.octet_length(t).cast("bigint") for t in texts))).first()[0] or 0
    return max(FILES, -(-size // FILE_BYTES))


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, " ")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (the first word), body (the rest): documents with both."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.trim(_plain(F.col("text"))).alias("t"))
    docs = docs.select("doc_id", F.regexp_extract("t", "^[^ ]+", 0).alias("title"), F.regexp_extract("t", "^[^ ]+ (.*)$", 1).alias("body"))
    return docs.where("title <> '' and body <> ''")


_TEXTS = f"""t as (select doc_id, trim(regexp_replace(text, '{PLAIN_SQL}', ' ', 'g'), ' ') t from documents where text is not null),
d as (select doc_id, split_part(t, ' ', 1) title, substr(t, instr(t, ' ') + 1) body from t where instr(t, ' ') > 0)"""


def abstract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts, annotations (of either part the last character, then the first word, then both again for the whole) and borders
    (all of either part). Spans come back in order."""
    docs = written(_texts(spark, sf_dir), "docs")
    docs = docs.withColumn("file", F.col("doc_id") % _files(docs, "title", "body"))
    part = lambda code, text: F.struct(F.lit(code).alias("code"), F.col(text).alias("text"), F.lit(text).alias("label"))
    parts = docs.select("doc_id", "file", F.explode(F.array(part("T", "title"), part("A", "body"))).alias("p")).select("doc_id", "file", "p.*")
    n, word = F.length("text"), F.length(F.regexp_extract("text", "^[^ ]+", 0))
    span = lambda k, start, stop, label: F.struct(F.lit(k).alias("k"), start.alias("start"), stop.alias("stop"), label.alias("label"))
    spans = F.array(span(0, n - 1, n, F.lit("end")), span(1, F.lit(0), word, F.col("label")), span(2, F.lit(0), n, F.lit("all")))
    marked = parts.select("doc_id", "file", "code", "text", F.inline(spans))
    lines = {
        "abstracts": docs.select("file", F.col("doc_id").alias("ord"), F.concat_ws("\t", "doc_id", "title", "body").alias("value")),
        "annotations": marked.select(
            "file", (F.col("doc_id") * 3 + F.col("k")).alias("ord"), F.concat_ws("\t", "doc_id", "code", "start", "stop", F.expr("substr(text, start + 1, stop - start)"), "label").alias("value")
        ),
        "borders": parts.select("file", F.col("doc_id").alias("ord"), F.concat_ws("\t", "doc_id", "code", F.concat(F.lit("0:"), n)).alias("value")),
    }
    rows = corpus.records(abstracts.read_corpus(spark, *(_put(df, label) for label, df in lines.items())))
    border = F.col("borders")[0]["stop"].alias("border")
    rows = rows.select("id", "part", "text", border, F.posexplode("annotation").alias("k", "a"))
    return rows.select("id", "part", F.length("text").alias("n"), "border", "k", F.col("a.start").alias("a"), F.col("a.stop").alias("b"), F.col("a.data").alias("label"))


ABSTRACT_FILES = f"""with {_TEXTS}, p as (select doc_id, 'T' part, title as text, 'title' label from d union all select doc_id, 'A', body, 'body' from d),
s as (select doc_id, part, length(text) n, length(split_part(text, ' ', 1)) w, unnest([[n - 1, n, 0], [0, w, 1], [0, n, 2]]) x, unnest(['end', label, 'all']) label from p)
select doc_id id, part, cast(n as int) n, cast(n as int) border, cast(row_number() over (partition by doc_id, part order by x[1], x[3]) - 1 as int) k,
cast(x[1] as int) a, cast(x[2] as int) b, label from s"""


def last_vector_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors in several files, the last one the smallest: a word has its last line's, files in order of their names."""
    rows = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    rows = rows.withColumn("file", F.floor((F.col("vec_id") % 10) / 3))
    value = F.concat_ws(" ", F.concat(F.lit("w"), (F.col("vec_id") % 97).cast("string")), F.transform("embedding", lambda x: x.cast("string")))
    path = _put(rows.select("file", F.col("vec_id").alias("ord"), value.alias("value")), "vectors")
    found = written(vectors.read_word_vectors(spark, path), "vectors")
    last = found.groupBy("word").agg(F.max_by("vector", "idx").alias("v"))
    return last.select("word", F.posexplode("v").alias("at", "x")).select("word", "at", F.col("x").cast("double").alias("value"))


LAST_VECTOR_WINS = """with r as (select vec_id, embedding e, (vec_id % 10) // 3 file from embeddings where embedding is not null),
w as (select vec_id % 97 w, arg_max(e, file * 1000000000 + vec_id) e from r group by 1)
select 'w' || w word, cast(generate_subscripts(e, 1) - 1 as int) "at", cast(unnest(e) as double) "value" from w"""


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title is one annotated word and whose body has two sentences, with an annotation around another."""
    docs = written(_texts(spark, sf_dir), "docs")
    n = _files(docs, "title", "body")
    docs = docs.withColumn("file", F.col("doc_id") % n)
    title, body = _escaped(F.col("title")), _escaped(F.col("body"))
    article = F.concat(
        F.lit("<article><articleinfo><bibliomisc>MEDLINE:"), F.col("doc_id").cast("string"), F.lit('</bibliomisc></articleinfo><title><sentence><cons sem="G#name">'), title,
        F.lit('</cons></sentence></title><abstract><sentence>in <cons sem="(AND G#out G#out)">a <cons sem="">'), title, F.lit("</cons> or</cons>.</sentence>\n<sentence>"), body, F.lit("</sentence></abstract></article>"),
    )
    edge = lambda at, tag: F.struct(F.lit(at).cast("bigint").alias("ord"), F.lit(tag).alias("value"))  # noqa: E731  a file's first and last line
    edges = spark.range(n).select(F.col("id").alias("file"), F.inline(F.array(edge(-1, '<?xml version="1.0"?><set>'), edge(2**62, "</set>"))))
    path = _put(docs.select("file", F.col("doc_id").alias("ord"), article.alias("value")).unionByName(edges), "articles")
    rows = annotated_xml.read_annotated_xml(spark, f"{path}/file=*/*.txt")
    inside, at = F.col("annotation.body"), F.col("borders.body")
    return rows.select(
        F.col("text.id").alias("id"), F.col("text.title").alias("title"), F.col("text.body").alias("body"), F.col("annotation.title")[0]["data"].alias("name"),
        F.size(inside).alias("n"), inside[0]["start"].alias("a"), inside[0]["stop"].alias("b"), inside[0]["data"].alias("label"), at[0]["stop"].alias("first_end"), at[1]["start"].alias("second"),
    )


ANNOTATED_FILES = f"""with {_TEXTS}
select doc_id id, title, 'in a ' || title || ' or. ' || body body, 'name' "name", 1 n, 5 a, cast(5 + length(title) as int) b, 'out' label,
cast(9 + length(title) as int) first_end, cast(10 + length(title) as int) "second" from d"""


def scatter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of each vector put four places apart, zeros between."""
    rows = read(spark, sf_dir, "embeddings").where("size(embedding) > 1").select(F.col("vec_id").alias("doc_id"), "embedding", F.floor(F.size("embedding") / 2).cast("int").alias("h"))
    half = lambda k, start, n: F.struct(F.lit(k).alias("ord"), start.alias("start"), (start + n).alias("stop"), F.slice("embedding", F.lit(1) if k == 0 else F.col("h") + 1, n).alias("data"))
    both = F.array(half(0, F.lit(0), F.col("h")), half(1, F.col("h") + 4, F.size("embedding") - F.col("h")))
    found = segments.scatter(rows.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*"), F.lit(0.0).cast("float"))
    return found.select("doc_id", "start", F.size("chars").alias("n"), F.posexplode(F.transform("chars", lambda x: x.cast("double"))).alias("at", "value"))


SCATTER_NUMBERS = """with e as (select vec_id, embedding e, len(embedding) // 2 h from embeddings where len(embedding) > 1),
s as (select vec_id, list_concat(list_concat(e[1:h], [0.0::float, 0.0::float, 0.0::float, 0.0::float]), e[h + 1:]) c from e)
select vec_id doc_id, 0 as start, cast(len(c) as int) n, cast(generate_subscripts(c, 1) - 1 as int) "at", cast(unnest(c) as double) "value" from s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (abstract_files, last_vector_wins, annotated_files, scatter_numbers)}


def oracle_sql() -> dict[str, str]:
    return {"abstract_files": ABSTRACT_FILES, "last_vector_wins": LAST_VECTOR_WINS, "annotated_files": ANNOTATED_FILES, "scatter_numbers": SCATTER_NUMBERS}
