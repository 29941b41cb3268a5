"""Near-duplicate embeddings with a forest of random-projection trees.

A tree splits the vectors again and again at the middle of a random projection; those within a fixed margin of the middle go to both sides (spill), and several
trees with other directions catch what one tree separates. A node that lies mostly within the margin is not split. Vectors are compared within leaves only, in double precision. A pair that meets in many leaves
counts in the first of them, which both ends' leaf lists tell without exchanging pairs. A leaf returns counts and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connect, connected_components, shipped

SAMPLE = 32768  # vectors at most that the splits are fitted on; all are indexed
SAMPLE_BYTES = 1 << 24  # bytes of that sample at most (but 1,024 vectors at least)
TREES, SPILL, LEAF_ROWS = 4, 0.3, 512  # SPILL: margin of the projection; two unit vectors at cosine 0.9 differ by 0.45 (standard deviation) there
CHUNK = 2048  # a leaf of more vectors is compared in chunk pairs, each a task of its own


class Forest:
    """Directions and the two thresholds of every node; node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 11):
        r = np.random.default_rng(seed)
        self.depth, self.trees, nodes = depth, trees, (1 << depth) - 1
        self.direction = r.normal(size=(trees, nodes, sample.shape[1])).astype(np.float32)
        self.low, self.high = np.zeros((trees, nodes), np.float32), np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(nodes):
                rows = held.pop(node)
                at = sample[rows] @ self.direction[t, node]
                middle = np.median(at) if len(at) else 0
                if len(at) and (np.abs(at - middle) <= spill).mean() <= 0.5:
                    self.low[t, node], self.high[t, node] = middle - spill, middle + spill
                    held[2 * node + 1], held[2 * node + 2] = rows[at <= middle], rows[at > middle]
                else:
                    self.low[t, node] = self.high[t, node] = np.inf  # all go left
                    held[2 * node + 1], held[2 * node + 2] = rows, rows[:0]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) for every leaf of every tree that a row of unit vectors lies in."""
        rows, codes = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.einsum("ij,ij->i", x[row], self.direction[t][node])
                left, right = at <= self.high[t][node], at >= self.low[t][node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            codes.append((t << self.depth) + node - ((1 << self.depth) - 1))
        return np.concatenate(rows), np.concatenate(codes)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that no square overflows."""
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300) if len(v) else v
    return (v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)).astype(np.float32)


def compare(x: np.ndarray, size: np.ndarray, second: np.ndarray | None, bits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links per row weighted by the other's size, component labels) of pairs with cosine of at least ``least``.

    ``second`` marks the rows of the other chunk (None: all pairs of one chunk); pairs that share one of ``bits`` met before and count no links.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, labels = np.zeros(len(x), np.int64), np.arange(len(x))
    left = np.arange(len(x)) if second is None else np.flatnonzero(~second)
    right = left if second is None else np.flatnonzero(second)
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= least * np.outer(norm[rows], norm[right]))
        i, j = rows[i], right[j]
        if second is None:
            i, j = i[i < j], j[i < j]
        new = ~(bits[i] & bits[j]).any(axis=1)
        i, j = i[new], j[new]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        connect(labels, i, j)
    return links, labels


def embedding_links(vectors: DataFrame, least: float = 0.9, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``; labels are not read.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors link with those of their own length only: each
    length of more than ``leaf_rows`` vectors has a forest, the others are a leaf each. Equal vectors are one point of the forest and all link
    with each other; so do repeated rows. Rows with null vec_id count as links of others but name no component. An empty table gives an empty result;
    other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "forest")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.col("v")))
    rows = scratch.save(rows.withColumn("h", F.xxhash64("v")), "rows")
    points = rows.where("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    points = scratch.save(points.select("h", "v", F.size("v").alias("d"), F.coalesce("rep", F.lit(0) - F.abs(F.col("h")) - 1).alias("rep"), "size"), "points")
    forests = {}
    for dim, n in points.groupBy("d").count().where(F.col("count") > leaf_rows).collect():
        most = max(1024, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        drawn = points.where((F.col("d") == dim) & (F.pmod(F.col("h"), F.lit(1 << 30)) < min(1.0, most / n) * (1 << 30))).select("v").limit(most).toArrow()
        x = _matrix(drawn.column(0).combine_chunks(), dim) if drawn.num_rows else np.zeros((1, dim))
        depth = max(0, min((n // leaf_rows).bit_length(), (max(len(x), 32) // 32).bit_length() - 1))
        forests[dim] = Forest(_units(x), depth, trees, spill)
    sent = shipped(spark, forests)

    def assign(batches):
        known = sent()
        for b in batches:
            lengths = b.column(3).to_numpy()
            for dim in np.unique(lengths):
                own = b.filter(pa.array(lengths == dim))
                if dim in known:
                    row, code = known[dim].leaves(_units(_matrix(own.column(2), dim)))
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order].astype(np.int32)
                else:
                    row, code = np.arange(len(own)), np.zeros(len(own), np.int32)
                ends = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
                yield pa.record_batch([*own.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], names=["rep", "size", "v", "d", "codes"])

    leaves = points.select("rep", "size", "v", "d").mapInArrow(assign, "rep long, size long, v array<double>, d int, codes array<int>")
    leaves = scratch.save(leaves, "leaves")
    # One row per leaf, at most trees * 2**depth of them for a length, whatever the number of vectors.
    parts = leaves.select("d", F.explode("codes").alias("code")).groupBy("d", "code").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("m"))
    dealt = leaves.withColumn("code", F.explode("codes")).join(parts, ["d", "code"]).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("d", "code", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), (F.col("c") > F.col("o")).alias("second"), "rep", "size", "v", F.filter("codes", lambda k: k < F.col("code")).alias("before"))

    def leaf(key, table):
        table = table.combine_chunks()
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        lists = table.column("before").combine_chunks()
        owner = np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
        codes, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        bits = np.zeros((len(rep), max(1, -(-len(codes) // 64))), np.uint64)
        np.bitwise_or.at(bits, (owner, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        own = key[2].as_py() == key[3].as_py()
        links, labels = compare(_matrix(table.column("v").combine_chunks(), key[0].as_py()), size, None if own else table.column("second").to_numpy(), bits, least)
        some, moved = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(rep)))
        a = pa.array(np.concatenate([rep[some], rep[moved]]))
        b = pa.array(np.concatenate([rep[some], rep[labels[moved]]]))
        return pa.table({"a": a, "b": b, "links": np.concatenate([links[some], np.zeros(len(moved), np.int64)])})

    found = scratch.save(dealt.groupBy("d", "code", "p", "q").applyInArrow(leaf, "a long, b long, links long"), "found")
    scratch.drop("leaves")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"), scratch)
    points = points.select(F.col("h").alias("ph"), F.col("v").alias("pv"), "rep", "size")
    named = points.join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("ph", "pv", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, (F.col("h") == F.col("ph")) & (F.col("v") == F.col("pv")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
