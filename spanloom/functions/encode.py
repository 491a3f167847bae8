"""Character and word codes with a code for what is not in the vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import stack


def ascii_charset(df: DataFrame, text: str = "text") -> DataFrame:
    """char, code: the different ASCII characters in order, from code 1. At most 128 rows."""
    chars = df.select(F.explode(F.split(text, "")).alias("char")).where(F.ascii("char") < 128).where("char <> ''").distinct()
    return chars.select("char", F.row_number().over(W.orderBy("char")).alias("code"))


class CharEncoder:
    """Codes of a corpus's ASCII characters, the code for all others, and columns that encode."""

    def __init__(self, corpus: DataFrame, text: str = "text", word_length: int | None = None):
        if word_length is not None and word_length < 0:
            raise ValueError("word_length must not be negative")
        self.word_length = word_length or None
        self.codes = {r.char: r.code for r in ascii_charset(corpus, text).collect()}  # at most 128
        if not self.codes:
            raise ValueError("the corpus has no ASCII character")
        self.oov = len(self.codes) + 1

    def encode(self, text: Column) -> Column:
        """array<int>, a code for each character; empty text is an error."""
        table = F.lit([self.codes.get(chr(i), self.oov) for i in range(128)])  # by place: a map would be searched entry by entry
        codes = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, F.ascii(c) + 1), F.lit(self.oov)))
        return F.when(text == "", F.raise_error(F.lit("empty strings have no codes"))).otherwise(codes)

    def encode_padded(self, text: Column, length: int) -> Column:
        """As encode, cut or filled by 0 to word_length, or to length if that is not set."""
        return stack(self.encode(text), self.word_length or length, F.lit(0), trim=True)


    def encode_words(self, words: Column, n_words: int, length: int | None = None) -> Column:
        """array<array<int>>, n_words x word_length (or length where that is not set) codes of an array of words: words and rows are
        cut, or filled by 0. An empty word is an error, a null one a row of 0, null words stay null."""
        width = self.word_length or length
        if not width or n_words < 1:
            raise ValueError("the padded array needs a width and at least one row")
        rows = F.transform(words, lambda w: F.coalesce(self.encode_padded(w, width), F.array_repeat(F.lit(0), width)))
        return stack(rows, n_words, F.array_repeat(F.lit(0), width), trim=True)


def word_index(words: DataFrame, vocabulary: DataFrame, word: str = "word", transform: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """words with column idx: the place in vocabulary (idx, word, vector) of the transformed word, the last place for
    words that aren't in it. Of a word that the vocabulary repeats the last place counts; empty words are an error.
    Spark chooses between broadcast and shuffle by the vocabulary's size."""
    oov = vocabulary.agg(F.max("idx")).first()[0]
    if oov is None:
        raise ValueError("the vocabulary has no words")
    places = vocabulary.groupBy(F.col("word").alias("__word")).agg(F.max("idx").alias("__idx"))
    key = F.when(F.col(word) == "", F.raise_error(F.lit("empty words have no codes")).cast("string")).otherwise(transform(F.col(word)))
    found = words.withColumn("__key", key).join(places, F.col("__key") == F.col("__word"), "left")
    return found.withColumn("idx", F.coalesce("__idx", F.lit(oov))).drop("__key", "__word", "__idx")


def word_vectors(words: DataFrame, vocabulary: DataFrame, word: str = "word", transform: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """words with columns idx and vector."""
    vectors = vocabulary.select(F.col("idx").alias("__at"), "vector")
    return word_index(words, vocabulary, word, transform).join(vectors, F.col("idx") == F.col("__at")).drop("__at")
