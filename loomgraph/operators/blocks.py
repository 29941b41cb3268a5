"""Blocks of postings without a shuffle of single postings: tasks cut full blocks from a lot of chunks, and what is left of a term is sent on in parts that are cut where they meet.

What a lot has for one task to come travels as one row, its columns packed by zstd: each chunk once, postings as steps from chunk to chunk.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .ranking import K1, SOURCE, B

PACKED = f"{SOURCE} string, bucket int, share int, avgdl double, lot long, segments int, postings int, chunks int, size long, data binary"
BLOCKS = f"{SOURCE} string, bucket int, term string, block long, n long, max_tf int, min_dl int, postings array<struct<chunk_id: string, tf: int, dl: int>>"


def cut_lots(rows: DataFrame, size: int, lot: int, buckets: int, shares: int) -> DataFrame:
    """PACKED segments of ``rows(source_config_id, chunk_id, dl, avgdl, tf, w)``, in which each word of w counts tf times: blocks of ``size`` postings and, of each term and source, what is left.

    A task holds some ``lot`` words at a time, besides those of a batch. Postings of a lot's term and source go to segments by impact, so that those of least are left. Terms go to buckets
    by their CRC-32; parts go to shares by term, full blocks also by their lot, so that those of a frequent term are dealt out.
    """

    def run(batches):
        own = TaskContext.get().partitionId() << 16  # lots of all tasks have numbers of their own
        for i, table in enumerate(_lots(batches, lot)):
            yield from _packed(table, size, own + i, buckets, shares)

    return rows.select(SOURCE, "chunk_id", "dl", "avgdl", "tf", "w").mapInArrow(run, PACKED)


def _lots(batches, lot: int):
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += pc.sum(pc.list_value_length(held[-1]["w"])).as_py() or 0
        if n >= lot:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.concat_tables(held).combine_chunks()


def _only(column) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _impact(tf, dl, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _runs(keys, impact, size: int):
    """The order of postings by key and impact, where its segments of at most ``size`` of a key begin, and the number of each in its key."""
    order = np.lexsort((-impact, keys))
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    place = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
    starts = np.flatnonzero(place % size == 0)
    return order, starts, place[starts] // size


def _ranges(starts, n):
    """The numbers from each start on, n of them, one range after the other."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def _packed(table, size: int, lot: int, buckets: int, shares: int):
    w, chunk, source = _only(table["w"]), _only(table["chunk_id"]), _only(table[SOURCE]).dictionary_encode()
    words = pc.list_flatten(w).dictionary_encode()
    names = words.dictionary.cast(pa.binary()).to_pylist()
    terms = len(names)
    pairs, times = np.unique(pc.list_parent_indices(w).to_numpy().astype(np.int64) * terms + words.indices.to_numpy(), return_counts=True)
    row, term = pairs // terms, pairs % terms
    tf, dl, avgdl = times * table["tf"].to_numpy()[row], table["dl"].to_numpy().astype(np.int64), table["avgdl"].to_numpy()
    of = source.indices.to_numpy().astype(np.int64)
    order, starts, number = _runs(of[row] * terms + term, _impact(tf, dl[row], avgdl[row]), size)
    n, first = np.diff(np.r_[starts, len(order)]), order[starts]
    number = np.where(n == size, number + 1, 0)  # 0 is a part
    hashed = np.array([crc32(t) for t in names], dtype=np.int64)[term[first]]
    bucket, share = hashed % buckets, (hashed // buckets + np.where(number > 0, lot, 0)) % shares
    by = np.lexsort((term[first], share, bucket, of[row[first]]))  # segments by where they go
    order = order[_ranges(starts[by], n[by])]
    n, number, first, bucket, share = n[by], number[by], first[by], bucket[by], share[by]
    order = order[np.lexsort((row[order], np.repeat(np.arange(len(n)), n)))]  # a segment's postings by chunk
    where = np.stack([of[row[first]], bucket, share])
    cuts = np.r_[np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0)]), len(n)]
    at = np.r_[0, np.cumsum(n)]
    made = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[at[lo] : at[hi]]
        chunks, place = np.unique(row[own], return_inverse=True)
        steps = np.diff(place.astype("<u4"), prepend=np.uint32(0))
        told = _strings(chunk.take(pa.array(chunks))), _strings(words.dictionary.take(pa.array(term[first[lo:hi]])))
        numbers = [n[lo:hi], number[lo:hi], told[1][0], tf[own], steps, dl[chunks], told[0][0]]
        data = b"".join([*(_bytes_of(x) for x in numbers), told[1][1], told[0][1]])
        i = row[own[0]]
        made.append((source[int(i)].as_py(), int(bucket[lo]), int(share[lo]), float(avgdl[i]), lot, int(hi - lo), len(own), len(chunks), len(data), pa.compress(data, codec="zstd", asbytes=True)))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)]
    yield from pa.table(columns, names=[c.split()[0] for c in PACKED.split(", ")]).to_batches(max_chunksize=1000)


def _strings(values: pa.Array):
    """Sizes of strings in bytes and 1, 0 where they are null, and their bytes."""
    values = values.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(values), -1).to_numpy() + 1
    return sizes, b"".join(v for v in values.to_pylist() if v)


def _bytes_of(x) -> bytes:
    """Numbers below 2**32 by their bytes, the low ones of all first, which packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def meet(packed: DataFrame, size: int) -> DataFrame:
    """BLOCKS of PACKED rows, those of a source, bucket and share in a run: parts of a term are put together by impact and cut into blocks, full blocks stay as they are.

    Blocks have numbers of their own in a term and source. A task holds the postings of one run at a time.
    """

    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                its = row[SOURCE], row["bucket"], row["share"]
                if held and its != key:
                    yield from _blocks(held, size)
                    held = []
                key = its
                held.append(row)
        if held:
            yield from _blocks(held, size)

    return packed.select(*[c.split()[0] for c in PACKED.split(", ")]).mapInArrow(run, BLOCKS)


def _read(row):
    """Columns of segments (n, block, term) and of postings (tf, dl, chunk)."""
    data, at = memoryview(pa.decompress(row["data"], decompressed_size=row["size"], codec="zstd", asbytes=True)), 0

    def numbers(n):
        nonlocal at
        at += 4 * n
        return np.ascontiguousarray(np.frombuffer(data[at - 4 * n : at], dtype=np.uint8).reshape(4, n).T).view("<u4").ravel()

    def strings(sizes):
        nonlocal at
        ends = np.r_[0, np.cumsum(np.maximum(sizes.astype(np.int64) - 1, 0))]
        own = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at : at + int(ends[-1])])])
        at += int(ends[-1])
        return pc.if_else(pa.array(sizes == 0), pa.scalar(None, pa.string()), own) if (sizes == 0).any() else own

    n, number, term = (numbers(row["segments"]) for _ in range(3))
    tf, steps = numbers(row["postings"]), numbers(row["postings"])
    dl, chunk = numbers(row["chunks"]), numbers(row["chunks"])
    place = np.cumsum(steps, dtype=np.uint32).astype(np.int64)
    term, chunk = strings(term), strings(chunk)
    block = np.where(number > 0, ((row["lot"] + 1) << 20) + number.astype(np.int64), 0)
    return n.astype(np.int64), block, term, tf.astype(np.int32), dl[place].astype(np.int32), chunk.take(pa.array(place))


def _blocks(rows, size: int):
    read = [_read(row) for row in rows]
    n, block, tf, dl = (np.concatenate([r[i] for r in read]) for i in (0, 1, 3, 4))
    term = pa.concat_arrays([r[2] for r in read]).dictionary_encode()
    code, chunk = term.indices.to_numpy(), pa.concat_arrays([r[5] for r in read])
    starts, full, parts = np.r_[0, np.cumsum(n)][:-1], np.flatnonzero(block > 0), np.flatnonzero(block == 0)
    order, sizes, number, name = _ranges(starts[full], n[full]), n[full], block[full], code[full]
    if len(parts):
        loose, own = _ranges(starts[parts], n[parts]), np.repeat(code[parts], n[parts])
        by, first, place = _runs(own, _impact(tf[loose], dl[loose], rows[0]["avgdl"]), size)
        order, sizes = np.r_[order, loose[by]], np.r_[sizes, np.diff(np.r_[first, len(by)])]
        number, name = np.r_[number, place], np.r_[name, own[by[first]]]
    tf, dl, ends = tf[order], dl[order], np.r_[0, np.cumsum(sizes)]
    postings = pa.StructArray.from_arrays([chunk.take(pa.array(order)), pa.array(tf), pa.array(dl)], names=["chunk_id", "tf", "dl"])
    same = lambda v, kind: pa.array([v] * len(sizes), kind)
    columns = [
        same(rows[0][SOURCE], pa.string()), same(rows[0]["bucket"], pa.int32()), term.dictionary.take(pa.array(name)), pa.array(number.astype(np.int64)), pa.array(sizes),
        pa.array(np.maximum.reduceat(tf, ends[:-1])), pa.array(np.minimum.reduceat(dl, ends[:-1])), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), postings),
    ]
    return pa.table(columns, names=[SOURCE, "bucket", "term", "block", "n", "max_tf", "min_dl", "postings"]).to_batches(max_chunksize=10_000)
