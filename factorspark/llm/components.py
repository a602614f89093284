"""Connected components of an edge table, distributed, for graphs too large for one machine.

First the edges are contracted where they lie: a task takes a bounded number of them and gives, for each node that it has
seen, the least node that its own edges reach. Where one task's share was all there is, that is the answer; otherwise
star steps go on from these forests, which have fewer edges than nodes, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut

#: Edges that a task contracts.
SHARE = 1 << 19

#: Most nodes whose least neighbour is broadcast: those with over 1/HUBS of all edge ends.
HUBS = 1024


def _star(edges: DataFrame, large: bool, ends: int) -> DataFrame:
    """One star step. large: every node sends its larger neighbours to its least neighbour; small: its smaller ones.

    The least neighbour comes from a map-side aggregate and goes back to the edges by a join. Hubs, of which there are at
    most HUBS, meet their edges where those are read; no other node has more than ``ends`` / HUBS edges to bring to one task.
    """
    if large:
        rows = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        rows = rows.filter("v > u")
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    is_hub = F.col("n") * HUBS >= ends
    hubs = F.broadcast(least.filter(is_hub).select("u", "m"))
    met = rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.filter(~is_hub).select("u", "m"), "u"))
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each link the least label, in place, with all that already share a label."""
    while len(a):
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:  # labels point at labels: jump to the roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) for each node u of these edges that reaches a lesser one over them; v is the least."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    n = table.num_rows
    ends = pa.concat_arrays([c.chunk(0) for c in table.columns if c.num_chunks]).dictionary_encode() if n else None
    if ends is None:
        return
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[ends.indices.to_numpy(zero_copy_only=False)]
    label = np.arange(len(order))
    join_labels(label, at[:n], at[n:])
    some = np.flatnonzero(label != np.arange(len(label)))
    names = ends.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(label[some]))], names=["u", "v"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges`` (u, v) that is not a root itself.

    Beyond one task's share, alternates large-star and small-star steps until the edge set no longer changes (about log of the diameter rounds),
    each round cut into the shared folder. Raises if it has not settled after ``max_rounds``: an unfinished answer is never returned.
    """
    kind = edges.schema["u"].dataType.simpleString()
    edges = cut(edges.filter("u <> v").select("u", "v"))
    shares = -(-edges.count() // SHARE)
    named = F.col("u").alias("node"), F.col("v").alias("root")
    if not shares:
        return edges.select(*named)
    edges = cut(arrow_map(edges.coalesce(shares), contract, f"u {kind}, v {kind}"))
    if shares == 1:
        return edges.select(*named)
    edges = cut(edges.distinct())
    mark = None
    for _ in range(max_rounds):
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or not got[0]:
            return edges.select(*named)
        mark = tuple(got)
        edges = cut(_star(cut(_star(edges, True, 2 * got[0])), False, got[0]))
    raise RuntimeError("connected components did not settle")
