"""Connected components of a table of links, by large-star and small-star rounds.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)  Every
round is two aggregations and two joins on the links; the links stay a table,
and each round is written to the shared folder.  A node with very many links is
pre-aggregated before its shuffle, and its join is one that Spark can split.  At
most ``ONE_TASK`` links are joined in one task of an executor, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


#: Links that one task takes, 16 bytes each.
ONE_TASK = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links, by least neighbours and pointer jumping."""
    ends = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    u, v = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        for side in (u, v):
            np.minimum.at(new, root[side], least)
            np.minimum.at(new, side, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v).  Connects each node's neighbours to its least one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return rest.unionByName(own).distinct()


def components(links: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node reachable.

    ``links`` has columns u and v of one integer type; order and repeats don't
    matter, loops and nulls are left out.
    """
    now = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= one_task:
        kind = now.schema["u"].dataType.simpleString()
        out = settle(now.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
        release(now)
        return out
    mark = None
    for _ in range(rounds):
        new = settle(_star(_star(now, large=True), large=False))
        release(now)
        seen = new.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        now = new
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
