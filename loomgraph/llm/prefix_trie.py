"""Prefix trie of conversations with subtree totals by centroid decomposition of its parent-edge forest.

Every distinct sequence of first turns is a node. Totals of subtrees come from splitting: the centroid of a component is taken out, its total goes to every
node on the way from it to the component's top, and what is left falls into components of at most half the size. Large components are split by
joins, all of them at once in a round; a component of LOCAL nodes or fewer is split to the end within a task by the same rounds in numpy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LOCAL = 2048  # nodes of a component that a task takes whole
SENT = 100_000  # rows of a side that is sent to every task, of some 50 bytes each
RUN = 1024  # turns of a conversation that are added up together
PIECE = 1 << 16  # characters of a list of ids that travel together
WORD = r"[^ \t\n\x0b\f\r]+"


def local_sums(parent: np.ndarray, values: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """``extra`` plus the subtree sums of ``values`` (columns by nodes); ``parent`` is -1 for tops."""
    parent, out = parent.copy(), extra.copy()
    alive = np.arange(len(parent))
    while len(alive):
        here = np.full(len(parent), -1)
        here[alive] = np.arange(len(alive))
        above = np.where(parent[alive] >= 0, here[parent[alive]], -1)
        size, sums, top, jump = np.ones(len(alive), np.int64), values[:, alive].copy(), np.arange(len(alive)), above
        while (jump >= 0).any():
            low = np.flatnonzero(jump >= 0)
            to = jump[low]
            more, moved = size[low], sums[:, low]
            further, upper = jump[to], top[to]
            np.add.at(size, to, more)
            for row, add in zip(sums, moved, strict=True):
                np.add.at(row, to, add)
            top[low], jump = upper, np.full(len(alive), -1)
            jump[low] = further
        heavy = np.flatnonzero(2 * size > size[top])
        heavy = heavy[np.lexsort((size[heavy], top[heavy]))]
        first = np.append(True, top[heavy][1:] != top[heavy][:-1])
        centroid = heavy[first]
        path, owner = heavy[~first], centroid[np.cumsum(first) - 1][~first]
        out[:, alive[centroid]] += sums[:, centroid]
        out[:, alive[path]] += sums[:, owner]
        gone = np.zeros(len(alive), bool)
        gone[centroid] = True
        parent[alive[(above >= 0) & gone[above]]] = -1
        alive = alive[~gone]
    return out


def _split_small(pool: DataFrame, names: list[str]) -> DataFrame:
    """(id, sums) of components that are small, from ``pool(top, id, parent, values, extras)``."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        ids, parents = table.column("id").to_pandas(), table.column("parent").to_pandas()
        code, seen = pd.factorize(pd.concat([ids, parents], ignore_index=True))
        if len(seen) != len(ids):
            raise ValueError("a node's parent is missing or a node is there twice")
        parent = np.full(len(ids), -1)
        parent[code[: len(ids)]] = code[len(ids) :]
        values, extra = np.zeros((2, len(names), len(ids)), np.int64)
        for k, name in enumerate(names):
            values[k, code[: len(ids)]] = table.column(name).to_numpy()
            extra[k, code[: len(ids)]] = table.column(f"extra_{name}").to_numpy()
        sums = local_sums(parent, values, extra)[:, code[: len(ids)]]
        return pa.record_batch([table.column("id").combine_chunks(), *map(pa.array, sums)], names=["id", *names])

    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            tops = held.column("top").to_pandas()
            cut = int((tops != tops.iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1  # the last component may go on in the next batch
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield solve(held)

    rows = pool.select("top", "id", "parent", *names, *[f"extra_{n}" for n in names]).repartition("top").sortWithinPartitions("top")
    return rows.mapInArrow(run, "id string, " + ", ".join(f"{n} long" for n in names))


def subtree_sums(forest: DataFrame, names: list[str], scratch: Scratch, local: int | None = None) -> DataFrame:
    """(id, sums of ``names``) over the subtree of each node of ``forest(id, parent, ...)``, its top included.

    ``id`` is a string and unique, ``parent`` null for tops and else the id of a row; ``names`` are columns of longs without nulls. Rounds are as many as
    halvings take the largest component to ``local`` nodes, each with as many steps as doublings reach its height. An empty forest gives an empty result.
    """
    spark, local = forest.sparkSession, local or LOCAL
    extras = [f"extra_{n}" for n in names]
    rows = forest.select("id", "parent", *names, *[F.lit(0).cast("long").alias(e) for e in extras])
    rows = scratch.save(rows, "forest")
    kinds = "id string, " + ", ".join(f"{n} long" for n in names)
    ended, pools, k = spark.createDataFrame([], kinds), [], 0
    while not rows.isEmpty():
        sized = scratch.save(_sized(rows, names, scratch, k), f"tops{k}")
        totals = sized.where("id = top").select("top", F.col("size").alias("total"))
        sized = sized.join(totals, "top")
        pools.append(sized.where(F.col("total") <= local))
        heavy = sized.where((F.col("total") > local) & (2 * F.col("size") > F.col("total")))
        central = heavy.groupBy("top").agg(F.min(F.struct("size", "id", *[f"sum_{n}" for n in names], *extras)).alias("c"))
        central = scratch.save(central.select("top", F.col("c.id").alias("centroid"), *[F.col(f"c.sum_{n}").alias(f"c_{n}") for n in names], *[F.col(f"c.{e}").alias(f"c_{e}") for e in extras]), f"central{k}")
        ended = ended.unionByName(central.select(F.col("centroid").alias("id"), *[(F.col(f"c_{n}") + F.col(f"c_extra_{n}")).alias(n) for n in names]))
        few = central.count() <= SENT
        left = sized.where(F.col("total") > local).join(F.broadcast(central) if few else central, "top").where("id <> centroid")
        on_path = 2 * F.col("size") > F.col("total")
        rows = left.select(
            "id", F.when(F.col("parent") != F.col("centroid"), F.col("parent")).alias("parent"), *names,
            *[(F.col(f"extra_{n}") + F.when(on_path, F.col(f"c_{n}")).otherwise(0)).alias(f"extra_{n}") for n in names],
        )
        k += 1
        rows = scratch.save(rows, f"rest{k}")
    for pool in pools:
        ended = ended.unionByName(_split_small(pool, names))
    return ended


def _sized(rows: DataFrame, names: list[str], scratch: Scratch, k: int) -> DataFrame:
    """``rows`` with the size of each node's subtree in its component, the sums there, and the component's top, by doubling jumps.

    A node whose jump has left its component is done: it takes part in no further join, and what it still receives is added up once at the end.
    """
    sums = ["size", *[f"sum_{n}" for n in names]]
    own = [F.lit(1).cast("long").alias("size"), *[F.col(n).alias(f"sum_{n}") for n in names]]
    tops = rows.where("parent is null").select("id", F.col("id").alias("top"))
    moving, given, step = rows.where("parent is not null").select("id", F.col("parent").alias("jump"), *own), None, 0
    while not moving.isEmpty():
        add = moving.groupBy(F.col("jump").alias("id")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        given = add if given is None else given.unionByName(add)
        target = moving.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.lit(None).cast("string").alias("top"))
        target = target.unionByName(tops.select(F.col("id").alias("jump"), F.lit(None).cast("string").alias("further"), "top"))
        met = moving.join(target, "jump").join(add, "id", "left")
        met = met.select("id", F.col("further").alias("jump"), "top", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])
        met = scratch.save(met, f"jump{k}_{step}")
        tops = tops.unionByName(met.where("jump is null").select("id", "top"))
        moving = met.where("jump is not null").select("id", "jump", *sums)
        step += 1
    sized = rows.select("*", *own).join(tops, "id")
    if given is None:
        return sized
    total = given.groupBy("id").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in sums])
    met = sized.join(total, "id", "left")
    return met.select(*rows.columns, "top", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums])


def _counted(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns(conv_id, turn, t1, t2, words)`` with ``i``, from 1, of each row in its conversation; ranges of rows are counted apart, so that no task holds a whole one."""
    cut = turns.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")).withColumn("part", F.spark_partition_id())
    cut = scratch.save(cut, "ranges")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2"))
    return cut.withColumn("own", own).join(starts.where("start > 0").select("conv_id", "part", "start"), ["conv_id", "part"], "left").select("conv_id", (F.coalesce("start", F.lit(0)) + F.col("own")).alias("i"), "t1", "t2", "words")


def rebuilt(conversations: DataFrame, scratch: Scratch, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id, length), their turns (conv_id, pos, t1, t2, words)), the first h turns of each taken from the first conversation of its group."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(said("role"), said("text")).alias("t1"), F.xxhash64(F.lit(1), said("text"), said("role")).alias("t2"),
        F.regexp_count(said("text"), F.lit(WORD)).cast("long").alias("words"),
    )
    turns = scratch.save(_counted(turns, scratch), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    convs = lengths.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.save(convs.select("conv_id", "base", "h", "k", "length"), "convs")
    heads = turns.where(F.col("i") < most).select(F.col("conv_id").alias("base"), F.col("i").alias("pos"), "t1", "t2", "words")
    first = convs.where("k > 0").join(heads, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "words", "length")
    rest = turns.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("pos"), "t1", "t2", "words", "length")
    return convs.select("conv_id", "length"), first.unionByName(rest)


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns`` with (p1, p2), which tell apart sequences of pos turns, and (q1, q2) of the sequence without the last."""
    rows = turns.select("conv_id", "pos", "length", "words", F.xxhash64("t1", "t2", "pos").alias("z1"), F.xxhash64(F.lit(2), "t2", "t1", "pos").alias("z2"), F.floor((F.col("pos") - 1) / RUN).alias("run"))
    rows = scratch.save(rows, "rebuilt")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.where(F.col("length") > RUN).groupBy("conv_id", "run").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    runs = runs.select("conv_id", "run", F.bit_xor("z1").over(before).alias("b1"), F.bit_xor("z2").over(before).alias("b2")).where("run > 0")
    along = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p1", F.bit_xor("z1").over(along)).withColumn("p2", F.bit_xor("z2").over(along)).join(runs, ["conv_id", "run"], "left")
    xor = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(F.col(b), F.lit(0)))
    rows = rows.withColumn("p1", xor("p1", "b1")).withColumn("p2", xor("p2", "b2"))
    return scratch.save(rows.select("conv_id", "pos", "length", "words", "p1", "p2", xor("p1", "z1").alias("q1"), xor("p2", "z2").alias("q2")), "prefixes")


def id_digests(ends: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, ends_sha256) of ``ends(keys, conv_id)``: SHA-256 of each key's ids in ascending order, comma-joined.

    Ranges of sorted ids become pieces of text; what a task folds for a key is a few pieces, in order, one batch at a time.
    """
    kinds = ", ".join(f"{k} long" for k in keys)

    def split(batches):
        at = 0
        for b in batches:
            values = [b.column(k).to_numpy() for k in keys]
            place = np.arange(len(b))
            new = np.append(True, np.any([v[1:] != v[:-1] for v in values], axis=0))[: len(b)]
            starts = np.flatnonzero(new)
            cut = new | ((place - np.repeat(starts, np.diff(np.append(starts, len(b))))) % max(PIECE // 20, 1) == 0)
            first = np.flatnonzero(cut)
            said = list(map(str, b.column("conv_id").to_pylist()))
            pieces = [",".join(said[s:e]) for s, e in zip(first, np.append(first[1:], len(b)), strict=True)]
            yield pa.record_batch([*[pa.array(v[first]) for v in values], b.column("part").cast(pa.int64()).take(pa.array(first)), pa.array(at + np.arange(len(first))), pa.array(pieces, pa.string())], names=[*keys, "part", "at", "piece"])
            at += len(first)

    def fold(batches):
        key, digest = None, None
        for b in batches:
            done = []
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(row["piece"].encode())
                else:
                    digest.update(b"," + row["piece"].encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], d, strict=True)) for d in done])
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], (*key, digest.hexdigest()), strict=True))])

    cut = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").withColumn("part", F.spark_partition_id())
    pieces = scratch.save(cut.mapInArrow(split, f"{kinds}, part long, at long, piece string"), "pieces")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "at").mapInArrow(fold, f"{kinds}, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A conversation's turns go by ``turn``, null first, rows of one turn by a hash of role and text; repeated rows are turns of their own. Null role or
    text is empty. Rows with null conv_id take no part. Very long texts are read whole. Sequences are told apart by 128 bits of hashes. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    convs, turns = rebuilt(conversations, scratch)
    rows = _prefixes(turns, scratch)
    root_id, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    nodes = rows.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nodes = scratch.save(nodes, "nodes")
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("pos > 1").join(above, ["pos", "q1", "q2"]).select("pos", "p1", "p2", "conv_id", "n_convs", "words", "parent_conv_id")
    top = nodes.where("pos = 1").select("pos", "p1", "p2", "conv_id", "n_convs", "words", F.lit(root_id).cast("long").alias("parent_conv_id"))
    root = conversations.sparkSession.createDataFrame([(0, 0, 0, root_id, n, 0, None)] if n else [], "pos long, p1 long, p2 long, conv_id long, n_convs long, words long, parent_conv_id long")
    tree = scratch.save(deep.unionByName(top).unionByName(root), "tree")
    children = tree.where("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    name = lambda depth, conv: F.concat_ws(":", depth, conv)
    tree = tree.join(children, ["pos", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("id", name(F.col("pos"), F.col("conv_id")))
    tree = scratch.save(tree, "counted")
    forest = tree.select(
        "id", F.when(F.col("pos") > 0, name(F.col("pos") - 1, F.col("parent_conv_id"))).alias("parent"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    sums = subtree_sums(forest, ["n_leaves", "saved_tokens"], scratch)
    ends = rows.where("pos = length").select("pos", "p1", "p2", "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("pos", "p1", "p2")], "conv_id"))
    digests = id_digests(ends, ["pos", "p1", "p2"], scratch)
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    found = tree.join(sums, "id").join(digests, ["pos", "p1", "p2"], "left")
    return found.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
