"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments of at most 23 bits. If two fingerprints differ in at most two bits, one
segment is equal in both, and the exclusive or of the other two differs in at most two bits. The perfect (23, 12) Golay
code turns this 23-bit word into the indices of all codewords at most four bits away: one if the word is at most two
bits from its codeword, else six. Words at most two bits apart share an index. So the keys (segment, its
bits, index) meet for every pair in question, and candidates are verified on the whole fingerprint.

Equal fingerprints are one candidate. Rows with a key are compared in blocks of bounded size; a key with more rows is
split into blocks by hash, and each pair of blocks is a task of its own, so no pair is left out. Blocks give the links
of a spanning forest, never all pairs.

Defined results: null, empty and blank texts have no words and fingerprint zero, which links like any other; doc_id
null counts as no id when the smallest is looked for; equal rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut

GENERATOR = 0b110001110101  #: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
WIDTHS = (22, 21, 21)
BLOCK = 2048


# --- fingerprints


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at space and \\x09 to \\x0D."""
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, repeats included; fewer words make one shingle, none make none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(w) - size]]]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[at : at + 65_536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs (doc_id, text): doc_id, fp (long, the fingerprint's 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = np.array([fingerprint(shingle_hashes(x, size)) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# --- Golay keys


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of high and low bits; for each syndrome the lightest error, and the five errors of four bits if that has three."""
    high = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int64)
    low = np.arange(1 << 11)
    one = [_remainder(1 << i) for i in range(23)]
    light, heavy = np.zeros(1 << 11, np.int64), [[] for _ in range(1 << 11)]
    for n in range(1, 5):
        for bits in combinations(range(23), n):
            s = word = 0
            for i in bits:
                s, word = s ^ one[i], word | 1 << i
            if n < 4:
                light[s] = word
            else:
                heavy[s].append(word)
    five = np.array([h if len(h) == 5 else [-1] * 5 for h in heavy], np.int64)
    return high, low, light, five


_golay: list = []


def codewords(words23: np.ndarray) -> np.ndarray:
    """(n, 6): indices of the codewords at most four bits from each 23-bit word, -1 where there are fewer."""
    if not _golay:
        _golay.extend(_tables())
    high, low, light, five = _golay
    s = high[words23 >> 11] ^ low[words23 & 0x7FF]
    more = five[s]
    others = np.where(more >= 0, (words23[:, None] ^ more) >> 11, -1)
    return np.concatenate([((words23 ^ light[s]) >> 11)[:, None], others], axis=1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of fingerprints (uint64): which row has which key."""
    segments, at = [], 0
    for w in WIDTHS:
        segments.append((fps >> np.uint64(at)).astype(np.uint64).astype(np.int64) & ((1 << w) - 1))
        at += w
    rows, out = [], []
    for i, exact in enumerate(segments):
        a, b = (s for j, s in enumerate(segments) if j != i)
        index = codewords(a ^ b)
        r, c = np.nonzero(index >= 0)
        rows.append(r)
        out.append(i << 40 | exact[r] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(out)


# --- links


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, max_bits: int = 2, block: int = BLOCK) -> DataFrame:
    """fps (fp long, distinct): links (u, v) that connect all fingerprints at most max_bits (up to 2) apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys meet for two differing bits at most")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            rows, k = keys(own)
            yield pa.record_batch([pa.array(k), pa.array(own[rows].view(np.int64))], names=["k", "fp"])

    rows = fps.select("fp").mapInArrow(keyed, "k long, fp long")
    return blocked_links(rows, lambda x, y: np.bitwise_count(x ^ y) <= max_bits, block)


def blocked_links(rows: DataFrame, close, block: int) -> DataFrame:
    """rows (k long, fp long): links (u, v) that connect what is close and shares a key. close: of two uint64 arrays."""

    def spanning(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, n = x[0].view(np.uint64), x.shape[1]
        at, a, b, step = np.arange(n - 1), [], [], 1
        while True:
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            hit = at[close(fp[at], fp[at + step])]
            a.append(hit)
            b.append(hit + step)
            if sum(map(len, a)) > 500_000:
                a, b = [np.arange(n)], [forest(n, np.concatenate(a), np.concatenate(b))]
            step += 1
        label = forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)
        some = label != np.arange(n)
        return x[0][some], x[0][label[some]]

    return blocked_rows(rows, ["fp"], spanning, block).where("u <> v")


def blocked_rows(rows: DataFrame, columns: list[str], pairs, block: int) -> DataFrame:
    """Runs pairs on the rows (k and columns, all long) of each key, in blocks: its (u, v).

    A key with more than `block` rows is dealt to pairs of blocks, by a hash of the first column. pairs gets the numbers of the groups
    and the columns of some whole groups, sorted, and returns two arrays.
    """
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    many = rows.join(sizes, "k").withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64(columns[0]), F.col("nb")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = many.withColumn("at", F.explode(spread)).select("k", F.col("at.i").alias("i"), F.col("at.j").alias("j"), *columns)
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", *columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            held = got if held is None else np.concatenate([held, got], axis=1)
            other = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
            if held.shape[1] < 20_000 or not len(other):
                continue
            yield from found(held[:, : other[-1] + 1])
            held = held[:, other[-1] + 1 :]
        if held is not None and held.shape[1]:
            yield from found(held)

    def found(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (x[:3, 1:] != x[:3, :-1]).any(axis=0)])
        u, v = pairs(np.cumsum(new), x[3:])
        if len(u):
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text): doc_id, fingerprint, component_id (smallest doc_id that links reach, itself included)."""
    each = cut(fingerprints(docs, size))
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = components(links(fps, max_bits, block)).select(F.col("id").alias("fp"), "component")
    placed = fps.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "component").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
