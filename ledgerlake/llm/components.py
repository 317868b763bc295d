"""Connected components of a link table, by alternating large and small stars.

Each round every node hands its neighbours to the smallest node it knows, which halves
the depth of trees; a few rounds make every component a star around its smallest node.
Links never reach the driver, and each round is written to the shared folder, so a lost
executor costs one round at most. At most FEW links are joined by one task instead, in
memory that this number bounds; rounds would be a dozen jobs of a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, on_workers, release


#: The share of all rows that makes a key hot: one in so many.
HOT = 1000
#: Links that one task joins, 16 bytes each.
FEW = 1 << 20


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values``, which have one row a key and in ``_size`` the number of ``rows`` of it.

    Keys with more than one in HOT of all ``total`` rows, of which there are less than HOT,
    are broadcast, so their rows stay where they are; all others are few a key.
    """
    hot, cold = (values.where(F.expr(f"{size} {total}")).drop("_size") for size in (f"_size * {HOT} >", f"_size * {HOT} <="))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One large star (links to larger nodes move) or small star (links to smaller nodes move)."""
    if large:
        both, total = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total
    else:
        both = links
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_size"))
    joined = spread_join(both, least, "u", total)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of links (a, b): roots hang on smaller ones and trees are flattened until no link joins two."""
    ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate([a for a, _ in ends] + [b for _, b in ends]), return_inverse=True)
    a, b = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b, longs): label is the smallest node reachable."""
    given = links.where("a <> b").select("a", "b")
    if given.count() <= FEW:
        on_workers(links.sparkSession)
        return materialise(given.repartition(1).mapInArrow(_joined, "node long, label long"), "label")
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.expr("CAST(xxhash64(u, v) AS decimal(38, 0))"))).first())
    before = state(edges)
    while before[0]:
        # the large star has as many links as its input at most
        grown = materialise(_star(edges, True, before[0]), "links")
        after_edges = materialise(_star(grown, False, grown.count()), "links")
        after = state(after_edges)
        drop_table(edges)
        drop_table(grown)
        edges = after_edges
        release(links.sparkSession)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
