"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at a quantile of a random projection until its leaves are small; vectors
near a split go to both sides. Thresholds come from a bounded sample of each node, but every vector goes down every
tree. Vectors are compared within leaves, pairs that hold are joined into components, and within the components found
links are counted block against block, so that a group of thousands is neither gathered nor listed pair by pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm.common import components, stash

SIMILAR = 0.9
TREES = 12
LEAF = 512               # a node of more vectors is split
SPILL = 0.05             # share of a node's vectors on either side of its threshold that go to both sides
SAMPLE = 16_384          # vectors that set one node's thresholds, about
DEPTH = 8                # levels made from one sample; larger leaves are then split anew from samples of their own
BLOCK = 512              # vectors of one block when links are counted
ROUNDS = 30


def matrix(values: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(values.to_pylist()), np.float64)
    return x.reshape(len(values), -1) if len(values) else x.reshape(0, 0)


def unit(embeddings: pa.Array) -> pa.Array:
    """Pack each vector as doubles divided by its length; null for one that links with nothing."""
    out = []
    for v in embeddings.to_pylist():
        if v is None or any(c is None for c in v):
            out.append(None)
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max() if len(x) else 0.0
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append((x / np.sqrt(x @ x)).tobytes())
    return pa.array(out, pa.binary())


@lru_cache(maxsize=256)
def directions(tree: int, turn: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, turn, dim]).normal(size=(dim, DEPTH)) / np.sqrt(dim)


def fit(x: np.ndarray, d: np.ndarray, depth: int, spill: float) -> np.ndarray:
    """Bounds (low, high) of the nodes of a tree in heap order: to the left goes what is at most high, to the right
    what is above low."""
    p = x @ d
    bounds = np.zeros((2, (1 << depth) - 1))
    rows = {0: np.arange(len(x))}
    for node in range((1 << depth) - 1):
        own = rows.pop(node, np.zeros(0, np.int64))
        level = (node + 1).bit_length() - 1
        if len(own):
            q = p[own, level]
            bounds[:, node] = np.quantile(q, [0.5 - spill, 0.5 + spill])
            rows[2 * node + 1], rows[2 * node + 2] = own[q <= bounds[1, node]], own[q > bounds[0, node]]
    return bounds


def descend(x: np.ndarray, d: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs; a row in a band goes to both sides."""
    p = x @ d
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(depth):
        q = p[row, level]
        left, right = q <= bounds[1, node], q > bounds[0, node]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - ((1 << depth) - 1)


def grow(nodes: DataFrame, turn: int, leaf: int, sample: int, spill: float, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Split the nodes (tree, node, dim, id, v) that hold too many vectors: the new nodes, those that are small enough,
    and whether any was split. A node's number is its path, a bit for each split after a leading one."""
    sizes = stash(nodes.groupBy("tree", "node", "dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf))
    depth = F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    large = nodes.join(sizes.select("tree", "node", "dim", "n", depth.alias("depth")), ["tree", "node", "dim"])

    def thresholds(table: pa.Table) -> pa.Table:
        tree, node, dim, deep = (table[c][0].as_py() for c in ("tree", "node", "dim", "depth"))
        b = fit(matrix(table["v"].combine_chunks()), directions(tree, turn, dim, seed), deep, spill)
        return pa.table({"tree": [tree], "node": [node], "dim": [dim], "depth": pa.array([deep], pa.int32()), "low": [b[0].tolist()], "high": [b[1].tolist()]}, schema=schema)

    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("dim", pa.int32()), ("depth", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    chance = F.pmod(F.xxhash64("id", "tree", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    picked = large.where(chance < F.lit(float(sample)) / F.col("n"))
    splits = stash(picked.select("tree", "node", "dim", "depth", "v").groupBy("tree", "node", "dim").applyInArrow(thresholds, "tree int, node long, dim int, depth int, low array<double>, high array<double>"))

    def send(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            node, tree, dim, depth = (t[c].to_numpy() for c in ("node", "tree", "dim", "depth"))
            group = np.unique(np.stack([tree, node, dim], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if not len(own):
                    continue
                part = t.take(pa.array(own))
                i = own[0]
                b = np.array([part["low"][0].as_py(), part["high"][0].as_py()])
                row, leaf_no = descend(matrix(part["v"].combine_chunks()), directions(int(tree[i]), turn, int(dim[i]), seed), b, int(depth[i]))
                out = part.select(["tree", "dim", "id", "v"]).take(pa.array(row))
                out = out.append_column("node", pa.array((int(node[i]) << int(depth[i])) + leaf_no, pa.int64()))
                yield from out.select(["tree", "node", "dim", "id", "v"]).combine_chunks().to_batches()

    split = nodes.join(splits, ["tree", "node", "dim"]).mapInArrow(send, "tree int, node long, dim int, id long, v binary")
    kept = nodes.join(splits.select("tree", "node", "dim"), ["tree", "node", "dim"], "left_anti")
    return stash(split), kept, not splits.isEmpty()


def leaves(vectors: DataFrame, trees: int, leaf: int, sample: int, spill: float, seed: int) -> DataFrame:
    """(tree, node, id, v): every vector in a leaf or more of every tree."""
    nodes = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), (F.length("v") / 8).cast("int").alias("dim"), "id", "v")
    done = None
    for turn in range(ROUNDS):
        nodes, kept, more = grow(nodes, turn, leaf, sample, spill, seed)
        done = kept if done is None else done.unionByName(kept)
        if not more:
            break
    return done.unionByName(nodes)


def joined(table: pa.Table) -> pa.Table:
    """Compare the vectors of one leaf; give each that has a partner an edge to the smallest id it is linked with."""
    ids, x = table["id"].to_numpy(), matrix(table["v"].combine_chunks())
    n = len(ids)
    label = np.arange(n)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    near = [np.nonzero(x[i:i + BLOCK] @ x.T >= SIMILAR) for i in range(0, n, BLOCK)]
    a = np.concatenate([r + i * BLOCK for i, (r, _) in enumerate(near)]) if near else np.zeros(0, np.int64)
    b = np.concatenate([c for _, c in near]) if near else a
    a, b = a[a != b], b[a != b]
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    own = np.flatnonzero(label != np.arange(n))
    return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[label[own]], pa.int64())})


def counted(table: pa.Table) -> pa.Table:
    """Links between two blocks of one component (or within one): per vector, the number of vectors."""
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    block, ids, times = table["block"].to_numpy(), table["id"].to_numpy(), table["times"].to_numpy().astype(np.float64)
    x = matrix(table["v"].combine_chunks())
    i, j = np.flatnonzero(block == one), np.flatnonzero(block == two)
    hit = x[i] @ x[j].T >= SIMILAR
    if one == two:
        np.fill_diagonal(hit, False)
        out_ids, out = ids[i], hit @ times[j]
    else:
        out_ids, out = np.concatenate([ids[i], ids[j]]), np.concatenate([hit @ times[j], hit.T @ times[i]])
    return pa.table({"id": pa.array(out_ids, pa.int64()), "n": pa.array(out.astype(np.int64))})


def near_duplicates(embeddings: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, spill: float = SPILL, seed: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with cosine SIMILAR or more), component_id (smallest vec_id
    reachable), kept (its own component's smallest).

    A vector that is null, zero or holds null or non-finite components, or has no id, links with nothing; vectors of
    different lengths are not compared. Rows that repeat id and vector are vectors of their own and link with each
    other; of rows with one id and different vectors one is compared and the others link with nothing. An empty table
    gives no rows; other columns are not looked at."""
    rows = stash(embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), F.arrow_udf(unit, "binary")(embeddings["embedding"]).alias("v")))
    own = rows.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    own = stash(own.groupBy("vec_id").agg(F.min(F.struct("v", "times")).alias("s")).select("vec_id", "s.*"))
    vectors = stash(own.groupBy("v").agg(F.min("vec_id").alias("id"), F.sum("times").alias("times")))
    parts = leaves(vectors.select("id", "v"), trees, leaf, sample, spill, seed)
    edges = parts.groupBy("tree", "node", "dim").applyInArrow(lambda t: joined(t), "a long, b long")
    roots = components(edges)

    sizes = stash(roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    members = roots.join(sizes, "root").join(vectors, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = members.select("root", "id", "times", "v", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("root", "id", "times", "v", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    links = cells.groupBy("root", "one", "two").applyInArrow(lambda t: counted(t), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    known = own.select("vec_id", "v").join(vectors, "v").join(roots, "id", "left").join(links, "id", "left")
    known = known.select(F.col("vec_id").alias("id_"), F.col("v").alias("v_"), F.coalesce("root", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = rows.join(known, (F.col("vec_id") == F.col("id_")) & (F.col("v") == F.col("v_")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
