"""Annotated abstracts: the record shape, alignment of annotations, class mappings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER, TITLE, BODY = "OTHER", "T", "A"
SPANS = "array<struct<start:int,stop:int,data:string>>"
BORDERS = "array<struct<start:int,stop:int>>"


class AnnotationError(ValueError):
    """An annotation or a class mapping that can't be read."""


def records(abstracts: DataFrame) -> DataFrame:
    """id, part, text, annotation, borders: a row each for title and body.

    abstracts: text, annotation, borders, each a struct of id, title, body; the last two may be absent or null. Ids
    that disagree are an error when the row is read.
    """
    of = lambda name, part, kind: F.col(f"{name}.{part}").cast(kind) if name in abstracts.columns else F.lit(None).cast(kind)
    key = F.col("text.id")
    for name in ("annotation", "borders"):
        if name in abstracts.columns:
            key = F.when(F.col(f"{name}.id") != F.col("text.id"), F.raise_error(F.lit(f"ids of text and {name} differ")).cast("bigint")).otherwise(key)
    rows = [
        F.struct(F.lit(code).alias("part"), F.col(f"text.{part}").alias("text"), of("annotation", part, SPANS).alias("annotation"), of("borders", part, BORDERS).alias("borders"))
        for code, part in ((TITLE, "title"), (BODY, "body"))
    ]
    return abstracts.select(key.alias("id"), F.inline(F.array(*rows)))


def flatten(abstracts: DataFrame, order: str = "id") -> DataFrame:
    """text, annotation, borders without ids, title before body; `order` and part keep the order."""
    return records(abstracts).select(F.col("id").alias(order), "part", "text", "annotation", "borders")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one of the largest order."""
    rest = [c for c in df.columns if c not in (key, order)]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(key, "r.*")


def align(abstracts: DataFrame, annotations: DataFrame | None = None, borders: DataFrame | None = None, key: str = "id") -> DataFrame:
    """abstracts (key, title, body; all rows, repeats too) as text, annotation, borders structs for records(). The
    others (key, title, body, ord) join from the left; of rows that repeat a key the last in ord counts and a missing
    one gives empty lists."""

    def side(df: DataFrame | None, name: str, kind: str) -> DataFrame | None:
        if df is None:
            return None
        one = last_by(df.select(key, "title", "body", "ord"), key, "ord")
        return one.select(F.col(key).alias(f"__{name}"), F.col("title").cast(kind).alias(f"__{name}_t"), F.col("body").cast(kind).alias(f"__{name}_b"))

    out = abstracts
    columns = [F.struct(F.col(key).alias("id"), "title", "body").alias("text")]
    for name, df, kind in (("annotation", annotations, SPANS), ("borders", borders, BORDERS)):
        found, empty = side(df, name, kind), F.array().cast(kind)
        title = body = empty
        if found is not None:
            out = out.join(found, F.col(key) == F.col(f"__{name}"), "left")
            title, body = (F.coalesce(f"__{name}_{p}", empty) for p in "tb")
        columns.append(F.struct(F.col(key).alias("id"), title.alias("title"), body.alias("body")).alias(name))
    return out.select(*columns)


def parse_mapping(classes: Iterable[str]) -> dict[str, int]:
    """["a:1", "b:2"] as a dictionary; the last of repeated names counts."""
    out = {}
    for item in classes:
        try:
            name, code = item.split(":")
            out[name] = int(code)
        except ValueError as e:
            raise AnnotationError(f"not name:number: {item!r}") from e
    return out


def mapping_table(df: DataFrame, item: str = "item", order: str = "ord") -> DataFrame:
    """name, code of the rows of a table of "name:number" items; the last in order of repeated names counts."""
    parts = F.split(item, ":")
    bad = F.raise_error(F.concat(F.lit("not name:number: "), F.col(item)))
    rows = df.select(F.when(F.size(parts) != 2, bad).otherwise(parts[0]).alias("name"), parts[1].cast("int").alias("code"), F.col(order).alias("ord"))
    return last_by(rows, "name", "ord")
