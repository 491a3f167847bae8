"""Abstracts as XML with nested semantic annotations."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import BORDERS, SPANS, AnnotationError

CODE = re.compile(r"G#(\w+)")
SCHEMA = f"id bigint, title_text string, title_spans {SPANS}, title_borders {BORDERS}, body_text string, body_spans {SPANS}, body_borders {BORDERS}"


def pieces(sentence: ET.Element) -> Iterator[tuple[str, str | None]]:
    """The sentence's texts in order, its own tail last. With the text of an element without children inside comes the
    annotation it stands under: its own or else that of the closest element around it that has one; None with other texts."""
    todo: list[tuple[ET.Element, str, bool] | str | None] = [(sentence, "", True)]
    while todo:
        item = todo.pop()
        if not isinstance(item, tuple):
            if item is not None:
                yield item, None
            continue
        node, above, outermost = item
        under = above if outermost else node.get("sem") or above
        todo.append(node.tail)
        todo.extend((child, under, False) for child in reversed(node))
        if node.text is not None:
            yield node.text, None if outermost or len(node) else under


def single_code(annotation: str) -> str:
    """The code that the annotation names, however often."""
    codes = dict.fromkeys(m[1] for m in CODE.finditer(annotation))
    if len(codes) == 1:
        return next(iter(codes))
    raise AnnotationError(f"one code is needed, {annotation!r} names {len(codes)}")


def read_part(root: ET.Element) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Text, spans of elements without children, sentence borders (one character between sentences)."""
    text, spans, borders, at, end = [], [], [], 0, 0
    for k, sentence in enumerate(root.findall("sentence")):
        for piece, annotation in pieces(sentence):
            if annotation is not None:
                label = single_code(annotation)
                if piece:
                    spans.append((at, at + len(piece), label))
            text.append(piece)
            at += len(piece)
        n = sum(map(len, sentence.itertext()))
        borders.append((end + k, end + n + k))
        end += n
    return "".join(text).replace("\n", " ").rstrip(), spans, borders


def read_article(article: ET.Element) -> tuple:
    number = int(article.find("articleinfo").find("bibliomisc").text.replace("MEDLINE:", ""))
    return (number, *read_part(article.find("title")), *read_part(article.find("abstract")))


#: What an article's record begins and ends with; a record is what stands between two closing tags of articles.
OPENS, CLOSES = re.compile(r"<article(?=[\s>])"), "</article>"


def record_articles(record: str) -> Iterator[tuple]:
    """The article that a record ends with; none where it has no opening tag, as after a file's last article."""
    found = OPENS.search(record)
    if found:
        yield read_article(ET.fromstring(record[found.start() :] + CLOSES))


def file_articles(content: bytes) -> Iterator[tuple]:
    for article in ET.fromstring(content).findall("article"):
        yield read_article(article)


SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("data", pa.string())])
BORDER = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
PART = [pa.string(), pa.list_(SPAN), pa.list_(BORDER)]


def _batches(articles: Callable[..., Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The articles of the first column's values."""
    names = [f.split()[0] for f in ("id", "title_text", "title_spans", "title_borders", "body_text", "body_spans", "body_borders")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        dicts = lambda x, keys: [dict(zip(keys, one, strict=True)) for one in x]
        cells = []
        for number, *parts in rows:
            cells.append([number])
            for text, spans, borders in (parts[:3], parts[3:]):
                cells[-1] += [text, dicts(spans, ("start", "stop", "data")), dicts(borders, ("start", "stop"))]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells, strict=True), [pa.int64(), *PART, *PART], strict=True)], names=names)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [row for value in batch.column(0).to_pylist() for row in articles(value)]
            if rows:
                yield batch_of(rows)

    return read


def read_annotated_xml(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """text, annotation, borders structs of every article of every file. The tree of an article is walked in Python: Spark's
    own XML source loses the order of mixed content.

    Files are read by records that end with an article's closing tag, so that a large file is read by as many tasks as it has
    splits; an article across the border of two splits belongs to the first. Such files are UTF-8, define no entities or
    namespace prefixes outside of the articles and have no articles in comments; others are read with whole_files, a task a file.
    A file without articles gives no rows, and of an article that can't be read the error comes when its row is read.
    """
    if whole_files:
        flat = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_batches(file_articles), SCHEMA)
    else:
        flat = spark.read.text(path, lineSep=CLOSES).select("value").mapInArrow(_batches(record_articles), SCHEMA)
    of = lambda kind: F.struct("id", F.col(f"title_{kind}").alias("title"), F.col(f"body_{kind}").alias("body"))
    return flat.select(of("text").alias("text"), of("spans").alias("annotation"), of("borders").alias("borders"))
