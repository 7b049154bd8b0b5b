"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly to partitions; each runs best-fit
decreasing and compares its number of bins with a lower bound from dual-feasible functions. A partition whose number
equals its bound is certified and stays. The others keep their full bins and exchange the pieces of the rest, which
are dealt anew to fewer partitions that run best-fit decreasing again, for as long as that saves bins.

Defined results: null text is empty and has only its end id; null doc_id and equal rows are documents of their own;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import tokens
from lodestar.llm.common import cut

CAPACITY = 1024
PER_PARTITION = 60_000  #: pieces that one task packs
MAX_ROUNDS = 8


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenised documents (doc_id, text), cut from the end: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    Only the first piece of a document may be shorter than the capacity.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist(), vocabulary)):
                    ids += end
                    n = len(ids) // 4
                    stops = range(n % capacity or capacity, n + 1, capacity)
                    for i, stop in enumerate(stops):
                        start = max(0, stop - capacity) if i else 0
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc_id, i, start, stop - start, tokens.crc(own), own)[: len(fields)])
                yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)], names=[f[0] for f in fields])

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return docs.select("doc_id", "text").mapInArrow(cut_up, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of many dual-feasible bounds on the bins for these lengths: rounding functions for k up to 20, and
    threshold functions, which count large pieces in full and leave out small ones. Exact integers throughout.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):
        scaled = np.where(size * (k + 1) % capacity == 0, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    n = np.bincount(lengths, minlength=capacity + 1).cumsum()
    tokens_to = (np.bincount(lengths, minlength=capacity + 1) * size).cumsum()
    for e in range(1, capacity // 2 + 1):  # over capacity - e: a whole bin; under e: nothing
        middle = int(tokens_to[capacity - e] - tokens_to[e - 1])
        best = max(best, -(-(int(n[capacity] - n[capacity - e]) * capacity + middle) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) for pieces in the order given; equal lengths fill in that order.

    Bins with the same space left stand in one list, and a bit mask tells which lists have bins, so the tightest one
    is found at once.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = open_bins[left].pop()
            if not open_bins[left]:
                mask ^= 1 << left
        else:
            left, k, n = capacity, n, n + 1
        bins[i], offsets[i] = k, capacity - left
        left -= size
        open_bins[left].append(k)
        mask |= 1 << left
    return bins, offsets, n


def pack(rows: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """rows: length (long, 1 to capacity) and any columns. Adds sequence_id and offset; sequences have no gaps inside."""
    names = rows.columns
    if {"sequence_id", "offset"} & set(names):
        raise ValueError("rows already has a column sequence_id or offset")
    inner = rows.toDF(*[f"_bp{i}" for i in range(len(names))])
    size_at, base = names.index("length"), [f"_bp{i}" for i in range(len(names))]
    pool, done = cut(inner), []
    out = T.StructType([*inner.schema.fields, T.StructField("_sq", T.LongType()), T.StructField("_off", T.LongType()), T.StructField("_gap", T.BooleanType())])
    bins_before = None
    kept = None
    n = pool.count()
    for turn in range(max_rounds):
        if not n:
            break
        parts = max(1, -(-n // per_partition))

        dealt = pool.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).cast("long"))
        packed = cut(dealt.groupBy("_part").applyInArrow(_packer(f"_bp{size_at}", capacity, turn), out))
        used = packed.select("_sq").distinct().count()
        if bins_before is not None and used >= bins_before:
            break  # the exchange saved nothing: what was there before stays
        if kept is not None:
            done.append(kept.where("not _gap"))
        kept, pool = packed, packed.where("_gap").select(*base)
        gap = packed.where("_gap").agg(F.count("*"), F.count_distinct("_sq")).first()
        n, bins_before = gap[0], gap[1]
        if parts == 1:
            break
    if kept is None:
        kept = pool.withColumn("_sq", F.lit(0).cast("long")).withColumn("_off", F.lit(0).cast("long"))
    result = kept.select(*base, "_sq", "_off")
    for d in done:
        result = result.unionByName(d.select(*base, "_sq", "_off"))
    return result.toDF(*names, "sequence_id", "offset")


def _packer(size_name: str, capacity: int, turn: int):
    def one(key, table):
        lengths = table.column(size_name).to_numpy().astype(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        full = np.bincount(bins, weights=lengths, minlength=used) == capacity
        gap = (used > lower_bound(lengths, capacity)) & ~full[bins]
        ids = ((turn << 22) + key[0].as_py() << 28) + bins
        out = table.drop_columns(["_part"])
        for name, values in (("_sq", ids), ("_off", offsets), ("_gap", gap)):
            out = out.append_column(name, pa.array(values))
        return out

    return one


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    return pack(pieces(docs, vocabulary, capacity), capacity)
