"""Loaders that a saved registry finds again by name."""

from pyspark.sql import functions as F


def words(registry, data):
    return registry.spark.read.text(data["list"]).select(F.col("value").alias("word"))


def size(registry, data):
    return F.udf(lambda x: len(x), "int")


def sizes(registry, data):
    return registry.spark.sql("select word, size_of(word) n from words")


def other(registry, data):
    return registry.spark.sql("select * from sizes")
