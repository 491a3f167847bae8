"""Connected components of a distributed link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialise


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 the smallest node that each reaches by the links left[i] - right[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new, deeper := new[new]):
            new = deeper
        if np.array_equal(new, label):
            return label
        label = new


def _shorten(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch, replaced by as many as a forest of them needs: node to smallest node it reaches."""
    for batch in it:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        m = batch.num_rows
        label = local_components(len(nodes), place[:m], place[m:])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (bigint, not null), any direction, repeats and self-links allowed. Returns node, root for every node
    that has a link to another: root is the smallest node of its component.

    Alternating large-star and small-star steps [Kiveris et al. 2014], in which links only ever move towards smaller
    nodes; the number of steps grows with the logarithm of the nodes. Each step is written to the shared folder. Minima
    are broadcast only while few; beyond that both sides of the join come from tables, so that Spark can split a node
    with very many links. An empty table gives an empty table.
    """
    links = links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v")
    links = materialise(links.mapInArrow(_shorten, "u bigint, v bigint").distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "least")
        near = both.join(broadcast_if_small(least), "u")
        large = materialise(near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = materialise(down.groupBy("u").agg(F.min("v").alias("low")), "least")
        small = down.join(broadcast_if_small(low), "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        for old in (links, least, large, low):
            discard(old)
        links = after
        if now == state or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
