"""Substring near-duplicates by compact windows.

A document is its sequence of word shingles. Under a min-hash function, the Cartesian tree of the hashed shingles gives
compact windows (l, c, r): every passage [a, b] with l <= a <= c <= b <= r has its minimum at c. Windows with room for a
passage of `min_words` words are kept, about two for each such length of text. Documents that share a window's minimum
meet there. Where windows of two functions or more meet in one passage (an interval join within a document), their minima
together are a candidate key; of the documents with this key, one stands for all and each other is verified against it
on the shingles of both: passages of at least min_words words whose Jaccard similarity is at least `similarity`. Where this
leaves documents of a key unconnected (by passages of any key), all that differ in the key's reach are compared: each with
those of the other components, until no two that share a passage are in different ones. So documents are connected as all
pairs would connect them, but those that are connected already need not have a row for every passage they share.

A line that many documents have gives keys with as many regions. In a key of more than GROUP different regions those are compared
that share one of the rarest shingles of some window (`rare_shingles`): of a window's shingles all but a few must be in the other region,
so among the rarest few and one there is one of these. Where this takes more than comparing all by pairs of blocks, all are compared.

Windows reach at most HORIZON shingles from their minimum: longer repeats have several. Windows in a row with the same
minimum (a shingle that repeats) count as one. Only windows whose minimum occurs in another document are joined.

Defined results: null text has no shingles; a document with fewer than min_words words has no passage; documents with the same
doc_id and text are one document; null doc_id is a value like any other; passages repeated only within one document are left alone;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut, remove, stored
from lodestar.llm.golay_simhash import words
from lodestar.llm.shingles import hashes_of_each, shingle_hashes

SHINGLE, MIN_WORDS, SIMILARITY, FUNCTIONS = 5, 50, 0.8, 4
LEVELS = 7
HORIZON = (1 << LEVELS) - 1  #: enough for a passage of min_words words to both sides
BLOCK = 32_000  #: shingles worked on at a time, so that arrays stay in the cache
PER_TASK = 500  #: regions that a task holds against one representative
GROUP = 1024  #: different regions of a key, beyond which those with a rare shingle in common are compared, or all by pairs of blocks
SLACK = 0.05  #: by which the best window of a passage may look less similar than the passage
ROWS = 64  #: texts hashed at a time
CELLS = 1_000_000  #: places of regions looked up at once
BROADCAST_ROWS = 4_000_000  #: keys (a long each) up to which they are broadcast; beyond, the join shuffles


def mixed(h: np.ndarray, function: int) -> np.ndarray:
    """The function's hash of shingle hashes; never zero."""
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * (function + 1) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) | np.uint64(1)


def _sliding(op, v: np.ndarray, length: int) -> np.ndarray:
    """op (minimum or maximum) over each run of the length, by doubling."""
    span = 1
    while span < length:
        step = min(span, length - span)
        v = op(v[:-step], v[step:])
        span += step
    return v


def windows(v: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of v with r - l + 1 >= length, cut off HORIZON from c; zeros in v separate sequences.

    c is the leftmost minimum of its window. An element is the minimum of some run of the length if the largest minimum
    of the runs that hold it is its own value; only for these the window is measured, by doubling steps over a table
    of range minima.
    """
    n = len(v)
    if n < length:
        return (np.empty(0, np.int64),) * 3
    least = _sliding(np.minimum, v, length)
    edge = np.zeros(length - 1, v.dtype)
    c = np.flatnonzero((_sliding(np.maximum, np.concatenate([edge, least, edge]), length) == v) & (v > 0))
    table = [v]
    for k in range(LEVELS - 1):
        if len(table[-1]) <= 1 << k:
            break
        table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
    low = v[c]
    right, left = c + 1, c.copy()
    for k in range(len(table) - 1, -1, -1):
        t, step = table[k], 1 << k
        ok = right + step <= n
        ok[ok] = t[right[ok]] >= low[ok]
        right = right + step * ok
        ok = left - step >= 0
        ok[ok] = t[left[ok] - step] > low[ok]
        left = left - step * ok
    real = right - left >= length
    return left[real], c[real], right[real] - 1


def _window_rows(docs: DataFrame, shingle: int, length: int, functions: int) -> DataFrame:
    """docs (_d, text): (key, _d, w, first) of all windows, w packing place, reach and function; first is true for one of the windows
    of a document with the same minimum. Blocks of a long document count apart, which costs lookups but changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for d, h in zip(part.column(0).to_pylist(), hashes_of_each(part.column(1).to_pylist(), shingle)):
                for at in range(0, len(h) - length + 1, BLOCK):
                    held.append((d, at, h[at : at + BLOCK + length - 1]))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        yield found(held)
                        held, size = [], 0
        if held:
            yield found(held)

    def found(held: list) -> pa.RecordBatch:
        ids = np.array([d for d, _, _ in held], np.int64)
        first = np.array([at for _, at, _ in held], np.int64)
        sizes = np.array([len(h) for _, _, h in held])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        flat = np.zeros(int((sizes + 1).sum()), np.uint64)
        real = np.ones(len(flat), bool)
        real[starts + sizes] = False
        flat[real] = np.concatenate([h for _, _, h in held])
        out = []
        for j in range(functions):
            v = np.where(real, mixed(flat, j), np.uint64(0))
            left, c, right = windows(v, length)
            owner = np.searchsorted(starts, c, side="right") - 1
            key = v[c].view(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(c)])
            tails = np.concatenate([heads[1:], [len(c)]])[: len(heads)] - 1
            key, owner, left, c, right = key[heads], owner[heads], left[heads], c[heads], right[tails]
            order = np.lexsort((key, owner))
            new = np.empty(len(key), bool)
            new[order] = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(owner[order]) != 0)])[: len(key)]
            reach = np.minimum(right - c, (1 << 20) - 1)
            out.append((key, ids[owner], c - starts[owner] + first[owner] << 32 | (c - left) << 22 | reach << 2 | j, new))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "_d", "w", "first"])

    return docs.select("_d", "text").mapInArrow(run, "key long, _d long, w long, first boolean")


def _candidate_keys(rows: DataFrame, length: int) -> DataFrame:
    """rows (key, _d, w): (pk, _d, ab), ab the reach of shingles a << 32 | b, where windows of two functions have room for one passage of the length with both minima.

    All pairs of functions count.
    """
    ordered = rows.repartition("_d").sortWithinPartitions("_d", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            got = np.stack([np.asarray(c).astype(np.int64) for c in b.columns])
            held = got if held is None else np.concatenate([held, got], axis=1)
            other = np.flatnonzero(held[1] != held[1, -1])
            if held.shape[1] < 20_000 or not len(other):
                continue
            yield found(held[:, : other[-1] + 1])
            held = held[:, other[-1] + 1 :]
        if held is not None and held.shape[1]:
            yield found(held)

    def found(x: np.ndarray) -> pa.RecordBatch:
        key, d, w = x
        c, j = w >> 32, w & 3
        left, right = c - (w >> 22 & 1023), c + (w >> 2 & (1 << 20) - 1)
        at, step, out = np.arange(len(c)), 1, [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        while True:
            at = at[at + step < len(c)]
            at = at[(d[at] == d[at + step]) & (c[at + step] <= right[at])]
            if not len(at):
                break
            p, q = at, at + step
            low, high = np.maximum(left[p], left[q]), np.minimum(right[p], right[q])
            ok = (j[p] != j[q]) & (left[q] <= c[p]) & (high - low + 1 >= length)
            p, q = p[ok], q[ok]
            swap = j[p] > j[q]
            one, two = np.where(swap, key[q], key[p]).view(np.uint64), np.where(swap, key[p], key[q]).view(np.uint64)
            out.append((mixed(one ^ mixed(two, 7), 8), d[p], low[ok], high[ok]))
            step += 1
        pk, owner, low, high = (np.concatenate(v) for v in zip(*out))
        pk = pk.view(np.int64)
        order = np.lexsort((pk, owner))
        pk, owner, low, high = pk[order], owner[order], low[order], high[order]
        heads = np.flatnonzero(np.concatenate([[True], (pk[1:] != pk[:-1]) | (owner[1:] != owner[:-1])])[: len(pk)])
        ab = np.minimum.reduceat(low, heads) << 32 | np.maximum.reduceat(high, heads) if len(heads) else low
        return pa.record_batch([pa.array(pk[heads]), pa.array(owner[heads]), pa.array(ab)], names=["pk", "_d", "ab"])

    return ordered.mapInArrow(run, "pk long, _d long, ab long")


def _runs(there: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(start, stop) of runs of true, joined over gaps of false of at most gap."""
    hits = np.flatnonzero(there)
    if not len(hits):
        return []
    breaks = np.flatnonzero(np.diff(hits) > gap + 1)
    return list(zip(hits[np.concatenate([[0], breaks + 1])].tolist(), (hits[np.concatenate([breaks, [len(hits) - 1]])] + 1).tolist()))


def passages(a: np.ndarray, b: np.ndarray, length: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, stop, start, stop, similarity) of passages of shingles a and b that are near-duplicates; stops are exclusive.

    Runs of a's shingles that b has are joined over gaps of up to two changed words; each is held against the run of b
    that shares most with it. What does not pass is tried again with smaller gaps, down to none, and at last by all
    windows of the length, which may begin and end with words that the other lacks.
    """
    there = np.isin(a, b)
    out: list[tuple[int, int, int, int, float]] = []
    todo = [(0, len(a))]
    for gap in (12, 6, 0):
        again = []
        for lo, hi in todo:
            for s, e in _runs(there[lo:hi], gap):
                s, e = s + lo, e + lo
                if e - s < length:
                    continue
                x, best = np.unique(a[s:e]), (0.0, 0, 0)
                for bs, be in _runs(np.isin(b, x), gap):
                    if be - bs >= length * similarity:
                        best = max(best, (_jaccard(x, b[bs:be]), bs, be))
                if best[0] >= similarity:
                    out.append((s, e, best[1], best[2], best[0]))
                else:
                    again.append((s, e))
        todo = again
    for s, e, *_ in out:
        there[s:e] = False
    return sorted(out + _by_windows(a, b, there, length, similarity))


def _jaccard(x: np.ndarray, b: np.ndarray) -> float:
    """x is distinct."""
    y = np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _by_windows(a: np.ndarray, b: np.ndarray, there: np.ndarray, length: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of a among its windows of the length; there tells which of its shingles are to be found in b."""
    if min(len(a), len(b)) < length:
        return []
    hits = np.convolve(there, np.ones(length, np.int64), "valid")
    if hits.max() < similarity * length:
        return []
    order = np.argsort(b, kind="stable")
    place = order[np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)]
    low, high = _sliding(np.minimum, np.where(there, place, len(b)), length), _sliding(np.maximum, np.where(there, place, -1), length)
    guess = hits / (length + np.maximum(high - low + 1, length) - hits)
    good = np.flatnonzero(guess >= similarity - 1e-9)
    out = []
    for own in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        best = int(own[guess[own].argmax()])
        for s, e in ((int(own[0]), int(own[-1]) + length), (best, best + length)):
            bs, be = int(low[s : e - length + 1].min()), int(high[s : e - length + 1].max()) + 1
            hit = s + np.flatnonzero(there[s:e])
            if hit[-1] - hit[0] + 1 >= length:
                s, e = int(hit[0]), int(hit[-1]) + 1
            elif e - s > length:
                continue
            if be - bs < length:  # as far before its first common shingle as a begins before it
                bs = max(0, bs - int(hit[0] - s))
                be = min(len(b), bs + length)
                bs = be - length
            if (j := _jaccard(np.unique(a[s:e]), b[bs:be])) >= similarity:
                out.append((s, e, bs, be, j))
                break
    return out


def partners(sets: list[np.ndarray], label: list[int], length: int, similarity: float, every: bool = False) -> Iterator[tuple[int, int, list]]:
    """(i, j, passages) of regions (their shingles in order) of different labels, until those that have passages with each other are
    connected by labels and what came out.

    All regions are looked up at once: their number of common shingles, then for each window of i the common ones and their
    spread in j, tell which j can have a passage; only these are compared, the likeliest first.
    """
    n, sizes = len(sets), np.array([len(h) for h in sets])
    label = np.unique(label, return_inverse=True)[1]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    ids = np.empty(len(flat), np.int64)
    ids[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(flat)))
    owner = np.repeat(np.arange(n), sizes)[order]
    place = order - offset[owner]
    again = np.concatenate([[False], ~new[1:] & (owner[1:] == owner[:-1])])
    distinct = np.bincount(owner[~again], minlength=n)
    # what the others have with the most common label is found from their side, unless every region is to be looked up
    for i in range(n) if every else np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        own = ids[offset[i] : offset[i + 1]]
        k = count[own]
        least = max(1, int(np.ceil(similarity * (length - (len(own) - int(distinct[i]))) - 1e-9)))
        if (label == label[i]).all() or (k > 1).sum() < least - (len(own) - int(distinct[i])):
            continue
        at = np.repeat(first[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        t, who, where = np.repeat(np.arange(len(own)), k), owner[at], place[at]
        shared = np.bincount(who, minlength=n)
        able = np.flatnonzero((shared >= least) & (label != label[i]))
        if len(able):
            guess = _estimates(t, who, where, able, len(own), n, length, sizes[able] > distinct[able])
            for x in np.argsort(-guess, kind="stable").tolist():
                j = int(able[x])
                if guess[x] < similarity - SLACK:
                    break
                if label[i] != label[j] and (found := passages(sets[i], sets[j], length, similarity)):
                    label[label == label[j]] = label[i]
                    yield i, j, found


def _least_hits(length: int, similarity: float) -> int:
    """Places of a window that another region must have for it to look similar enough, less SLACK."""
    least = similarity - SLACK
    return max(1, int(np.ceil(2 * length * least / (1 + least) - 1e-9)))


def _estimates(t: np.ndarray, who: np.ndarray, where: np.ndarray, able: np.ndarray, size: int, n: int, length: int, repeats: np.ndarray) -> np.ndarray:
    """For each able region the best similarity of a window of the length, by its common shingles (place t here, place `where` in region `who`)."""
    out = np.zeros(len(able))
    if size < length:
        return out
    for lo in range(0, len(able), max(1, CELLS // size)):
        some = able[lo : lo + max(1, CELLS // size)]
        column = np.full(n, -1)
        column[some] = np.arange(len(some))
        c = column[who]
        on = c >= 0
        places = np.full((size, len(some)), -1, np.int32)
        places[t[on], c[on]] = where[on]
        there = places >= 0
        total = np.concatenate([np.zeros((1, len(some)), np.int32), np.cumsum(there, axis=0, dtype=np.int32)])
        hits = total[length:] - total[:-length]
        high = _sliding(np.maximum, places, length)
        low = _sliding(np.minimum, np.where(there, places, np.int32(2**31 - 1)), length)
        span = np.where(repeats[lo : lo + len(some)], length, np.maximum(high - low + 1, length))
        out[lo : lo + len(some)] = np.where(hits > 0, hits / (length + span - np.minimum(hits, length)), 0).max(axis=0)
    return out


def rare_shingles(ids: np.ndarray, n: np.ndarray, length: int, similarity: float) -> np.ndarray:
    """Places of a region's shingles, one of which another region must have that passes `partners` from this region's side.

    ids: the shingles; n: how many regions have each. A window that passes has at most `most` places that the other region lacks, and (a
    passage has at most a fifth) at most a third of its distinct shingles; so of its rarest ones, one more than that, one is common.
    """
    most = length - _least_hits(length, similarity)
    if len(n) < length:
        return np.empty(0, np.int64)
    order = np.lexsort((ids, n))
    new = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    rank = np.empty(len(n), np.int64)
    rank[order] = np.cumsum(new) - 1
    own = np.concatenate([[0], np.cumsum(n < 2)])
    starts = np.flatnonzero(own[length:] - own[:-length] <= most)
    chosen = np.zeros(int(new.sum()), bool)
    for at in range(0, len(starts), 4096):
        each = np.sort(rank[starts[at : at + 4096, None] + np.arange(length)], axis=1)
        place = np.concatenate([np.zeros((len(each), 1), np.int64), np.cumsum(each[:, 1:] != each[:, :-1], axis=1)], axis=1)
        chosen[each[place <= np.minimum(most, (place[:, -1:] + 1) // 3)]] = True
    return np.flatnonzero(chosen[rank] & (n > 1))


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (_d, text and more), one for each _d that rows have; the others go before texts are shuffled."""
    some = cut(rows.select("_d").distinct())
    return docs.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "_d", "left_semi").dropDuplicates(["_d"])


def _by_rare_shingles(huge: DataFrame, source: DataFrame, shingle: int, length: int, similarity: float) -> tuple[DataFrame, str]:
    """huge (k, _d, c, kinds, ab), regions of keys; source (_d, text): (_d, c, k, ab, at) of new groups of regions that share a rare shingle of
    one of them (`rare_shingles`), at the pairs of blocks (i, j) that each takes part in; and a table to be removed afterwards.

    Regions with the shingle among their rare ones are dealt to blocks i (numbered from -1 down), all that have it to blocks j. Keys of which more regions would be
    dealt so than by pairs of blocks of all stay whole.
    """

    def spelled(text: str | None, k: int, ab: int, own: list[bytes] | None = None) -> np.ndarray:
        h = shingle_hashes(b" ".join((own or words(text))[ab >> 32 : (ab & (1 << 32) - 1) + shingle]).decode(), shingle)
        return mixed(h ^ mixed(np.array([k], np.int64).view(np.uint64), 5), 6).view(np.int64)

    def each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, text, c, e in zip(*(x.to_pylist() for x in batch.columns)):
                own = words(text)
                for at in range(0, len(e), 1000):
                    part = e[at : at + 1000]
                    found = [np.unique(spelled(text, x["k"], x["ab"], own), return_counts=True) for x in part]
                    sizes = [len(h) for h, _ in found]
                    k, ab = (pa.array(np.repeat(np.array([x[name] for x in part], np.int64), sizes)) for name in ("k", "ab"))
                    h, m = (pa.array(np.concatenate(x)) for x in zip(*found))
                    yield pa.record_batch([h, k, pa.repeat(pa.scalar(d, pa.int64()), len(h)), pa.repeat(pa.scalar(c, pa.int64()), len(h)), ab, m.cast(pa.int32())], names=["h", "k", "_d", "c", "ab", "m"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, text, k, ab, e in zip(*(x.to_pylist() for x in batch.columns)):
                h, known = spelled(text, k, ab), {x["h"]: x["n"] for x in e}
                n = np.array([known.get(x, 1) for x in h.tolist()], np.int64)
                hit = np.unique(h[rare_shingles(h, n, length, similarity)])
                yield pa.record_batch([pa.array(hit), pa.repeat(pa.scalar(k, pa.int64()), len(hit)), pa.repeat(pa.scalar(d, pa.int64()), len(hit))], names=["h", "k", "_d"])

    spark = huge.sparkSession
    texts = source.select("_d", "text")
    by_text = huge.groupBy("_d", "c").agg(F.collect_list(F.struct("k", "ab")).alias("e")).join(_texts_of(texts, huge), "_d").select("_d", "text", "c", "e")
    each, place = stored(by_text.mapInArrow(each_shingle, "h long, k long, _d long, c long, ab long, m int"))
    counts = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    shared, now = stored(each.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "h"))
    remove(spark, place)
    place = now
    able = shared.groupBy("k", "_d").agg(F.sum("m").alias("m")).where(F.col("m") >= _least_hits(length, similarity)).select("k", "_d")
    sparse = able.groupBy("k").agg(F.count("*").alias("able")).join(huge.groupBy("k").agg(F.min("kinds").alias("kinds")), "k")
    dense = cut(sparse.where(F.col("able") * 4 > F.col("kinds")).select("k"))
    able = cut(able.join(F.broadcast(dense) if dense.count() <= BROADCAST_ROWS else dense, "k", "left_anti"))
    asked = shared.join(able, ["k", "_d"]).groupBy("k", "_d", "ab").agg(F.collect_list(F.struct("h", "n")).alias("e"))
    rarest = cut(asked.join(_texts_of(texts, able), "_d").select("_d", "text", "k", "ab", "e").mapInArrow(rare, "h long, k long, _d long"))
    chosen = rarest.select("h").distinct()
    chosen = F.broadcast(chosen) if rarest.count() <= BROADCAST_ROWS else chosen
    members = shared.join(chosen, "h").select("h", "k", "_d", "c", "ab").join(rarest.withColumn("p", F.lit(1)), ["h", "k", "_d"], "left").fillna(0, ["p"])
    # shingles with the same documents are one
    sizes = members.groupBy("h").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.sum("p").alias("np"), F.sum(F.xxhash64("_d", "p").cast("decimal(38,0)")).alias("x"), F.min("c").alias("least"), F.max("c").alias("most"))
    sizes = cut(sizes.where("least <> most").select("h", "k", "n", "np", F.xxhash64("x", "n", "np").alias("g"), F.ceil(F.col("np") / GROUP).cast("int").alias("ni"), F.ceil(F.col("n") / GROUP).cast("int").alias("nj")))
    groups = sizes.groupBy("k", "g").agg(F.max(F.expr("np * nj + n * ni")).alias("dealt")).groupBy("k").agg(F.sum("dealt").alias("dealt"))
    whole = cut(huge.groupBy("k").agg(F.min("kinds").alias("kinds")).join(groups, "k").where(F.col("dealt") > F.col("kinds") * F.ceil(F.col("kinds") / GROUP)).select("k").union(dense).distinct())
    a, b = F.shiftright("ab", 32), F.col("ab").bitwiseAND(F.lit((1 << 32) - 1))
    split = sizes.join(whole, "k", "left_anti").select("h", "g", "ni", "nj")
    groups = members.join(split, "h").groupBy("g", "_d", "c").agg(F.max("p").alias("p"), F.min("ni").alias("ni"), F.min("nj").alias("nj"), (F.shiftleft(F.min(a), 32) + F.max(b)).alias("ab"))
    i, j = (F.pmod(F.xxhash64("_d"), F.col(n)).cast("int") for n in ("ni", "nj"))
    all_i, all_j = (F.sequence(F.lit(0), F.col(n) - 1) for n in ("ni", "nj"))
    as_member = F.transform(all_i, lambda x: F.struct((-1 - x).alias("i"), j.alias("j")))
    as_rare = F.when(F.col("p") == 1, F.transform(all_j, lambda x: F.struct((-1 - i).alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    some = groups.select("_d", "c", F.col("g").alias("k"), "ab", F.array_distinct(F.concat(as_member, as_rare)).alias("at"))
    return some.unionByName(_by_blocks(huge.join(whole, "k"))), place


def _by_blocks(group: DataFrame) -> DataFrame:
    """group (k, _d, c, kinds, ab): (_d, c, k, ab, at), all regions of a key dealt to pairs of blocks (i, j)."""
    nb = F.ceil(F.col("kinds") / GROUP).cast("int")
    mine = F.pmod(F.xxhash64("_d"), nb).cast("int")
    spread = F.transform(F.sequence(F.lit(0), nb - 1), lambda x: F.struct(F.least(mine, x).alias("i"), F.greatest(mine, x).alias("j")))
    return group.select("_d", "c", "k", "ab", spread.alias("at"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, functions: int = FUNCTIONS) -> DataFrame:
    """docs (doc_id, text): near-duplicate passages, (doc_id, start_word, n_words, class_doc_id, class_start_word,
    class_n_words, similarity), a row for each passage of a document and its representative; a representative's own
    passage has itself as class.
    """
    length = min_words - shingle + 1
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_d"))
    found, place = stored(_window_rows(keyed, shingle, length, functions))
    again = cut(found.where("first").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    known = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    survivors = found.join(known, "key").select("key", "_d", "w")
    keys, now = stored(_candidate_keys(survivors, length))
    remove(docs.sparkSession, place)
    place = now
    chosen = cut(keys.groupBy("pk").agg(F.min("_d").alias("rd"), F.max("_d").alias("last"), F.max_by("ab", "_d").alias("ab"), F.count("*").alias("n")).where("rd <> last"))
    a, b = F.shiftright("ab", 32), F.col("ab").bitwiseAND(F.lit((1 << 32) - 1))
    # of keys with three documents or more, all are looked up; of two, the groups have both
    large = chosen.where("n > 2").select("pk", "rd")
    several, rest = stored(keys.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "pk"))
    remove(docs.sparkSession, place)
    met = several.where("_d <> rd").select("_d", "rd", "ab").union(chosen.where("n = 2").select(F.col("last").alias("_d"), "rd", "ab"))
    pairs = cut(met.groupBy("_d", "rd").agg(F.min(a).alias("a"), F.max(b).alias("b")))
    wanted = pairs.select("_d").union(pairs.select("rd")).distinct()
    few = wanted.count() <= BROADCAST_ROWS
    texts = keyed.join(F.broadcast(wanted) if few else wanted, "_d", "left_semi").dropDuplicates(["_d"])

    names = ["doc_id", "start_word", "n_words", "class_doc_id", "class_start_word", "class_n_words", "similarity"]
    kinds = [pa.int64()] * 6 + [pa.float64()]
    schema = "doc_id long, start_word long, n_words long, class_doc_id long, class_start_word long, class_n_words long, similarity double"

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            out = []
            for d, doc_id, text, rd, turn, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if d != last:
                    last, own = d, words(text)
                out.append((d, doc_id, rd, turn, a, b" ".join(own[a : b + shingle]).decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["_d", "doc_id", "key", "turn", "a", "region"])

    def listed_in(batch: pa.RecordBatch, i: int) -> tuple:
        """The words of row i, then its entries: a key, first and last shingle, and what else there is."""
        pk, ab, *more = batch.column(3).slice(i, 1).flatten().flatten()
        ab = ab.to_numpy()
        return words(batch.column(2)[i].as_py()), pk.to_pylist(), (ab >> 32).tolist(), (ab & (1 << 32) - 1).tolist(), *more

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, pk, a, b = listed_in(batch, i)
                joined, n = b" ".join(own), len(pk)
                stops = [0, *np.cumsum([len(w) + 1 for w in own]).tolist()]
                r = np.array([xxhash.xxh64_intdigest(joined[stops[s] : stops[e + shingle] - 1], 9) for s, e in zip(a, b)], np.uint64)
                d, doc_id, c = (pa.repeat(batch.column(x)[i], n) for x in (0, 1, 4))
                yield pa.record_batch([pa.array(pk), d, doc_id, c, pa.array(a), pa.array(b), pa.array(r.view(np.int64))], names=["key", "_d", "doc_id", "c", "a", "b", "r"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, pk, a, b, at = listed_in(batch, i)
                for lo in range(0, len(pk), 1000):
                    n = len(pk[lo : lo + 1000])
                    region = [b" ".join(own[s : e + shingle]).decode() for s, e in zip(a[lo : lo + n], b[lo : lo + n])]
                    d, doc_id, c = (pa.repeat(batch.column(x)[i], n) for x in (0, 1, 4))
                    yield pa.record_batch([pa.array(pk[lo : lo + n]), at.slice(lo, n), d, c, doc_id, pa.array(a[lo : lo + n]), pa.array(region)], names=["key", "at", "_d", "c", "doc_id", "a", "region"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = h = order = None
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            columns = [part.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for i, (d, doc_id, rd, a, class_id, own) in enumerate(zip(*columns, hashes_of_each(part.column(4).to_pylist(), shingle))):
                if rd != last:
                    last, h = rd, shingle_hashes(part.column(6)[i].as_py(), shingle)
                    order = np.argsort(h, kind="stable")
                first, stop = (np.searchsorted(h, own, side, sorter=order) for side in ("left", "right"))
                there = stop > first
                if not there.any():
                    continue
                lo, hi = int(order[first[there]].min()), int(order[stop[there] - 1].max())
                for s, e, bs, be, j in passages(own, h[lo : hi + 1], length, similarity):
                    out.append((d, rd, doc_id, a + s, e - s + shingle - 1, class_id, lo + bs, be - bs + shingle - 1, j))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 2 + kinds)], names=["_d", "rd", *names])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            columns = [part.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
            for key, i, j, c, doc_id, a, h in zip(*columns, hashes_of_each(part.column(7).to_pylist(), shingle)):
                if (key, i, j) != at:
                    out += settled(held, at)
                    at, held = (key, i, j), []
                held.append((doc_id, a, c, h.copy()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if out := settled(held, at):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def settled(held: list, at: tuple | None) -> list[tuple]:
        out = []
        if len(held) > 1:
            for i, j, found in partners([x[3] for x in held], [x[2] for x in held], length, similarity, at[1] < 0):
                (doc_id, a, *_), (class_id, c, *_) = held[i], held[j]
                out += [(doc_id, a + s, e - s + shingle - 1, class_id, c + bs, be - bs + shingle - 1, x) for s, e, bs, be, x in found]
        return out

    # a representative with many regions is dealt to tasks of PER_TASK regions, its text to each of them
    shares = cut(pairs.groupBy("rd").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("nb")))
    dealt = pairs.join(shares, "rd").withColumn("turn", F.pmod(F.xxhash64("_d"), F.col("nb")).cast("int"))
    left = dealt.join(texts, "_d").select("_d", "doc_id", "text", "rd", "turn", "a", "b").mapInArrow(regions, "_d long, doc_id long, key long, turn int, a long, region string").withColumnRenamed("key", "rd")
    named = texts.select(F.col("_d").alias("rd"), F.col("doc_id").alias("class_id"), F.col("text").alias("class_text")).join(shares, "rd")
    named = named.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    both = left.join(named, ["rd", "turn"]).select("_d", "doc_id", "rd", "a", "region", "class_id", "class_text")
    first = cut(both.mapInArrow(verify, f"_d long, rd long, {schema}"))

    # what is left unconnected within a key
    comps = components(first.select(F.col("_d").alias("u"), F.col("rd").alias("v"))).withColumnRenamed("id", "_d")
    placed = several.join(comps, "_d", "left").select("pk", "_d", "ab", F.coalesce("component", "_d").alias("c"))
    still = placed.groupBy("pk").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("pk")
    # what a document has in its keys' reach, by hash; equal ones are one region
    entries = cut(placed.join(still, "pk").groupBy("_d", "c").agg(F.collect_list(F.struct("pk", "ab")).alias("e")))
    remove(docs.sparkSession, rest)
    hashed = cut(entries.join(_texts_of(keyed, entries), "_d").select("_d", "doc_id", "text", "e", "c").mapInArrow(contents, "key long, _d long, doc_id long, c long, a long, b long, r long"))
    classes = cut(hashed.groupBy("key", "r").agg(F.min(F.struct("_d", "doc_id", "c", "a", "b")).alias("s"), F.min("c").alias("least"), F.max("c").alias("most")))
    # documents of several components with the same in reach
    alike = hashed.join(classes.where("least <> most").select("key", "r", "s"), ["key", "r"]).where("c <> s.c")
    words_of = (F.col("b") - F.col("a") + shingle).alias("n_words")
    copies = alike.select("doc_id", F.col("a").alias("start_word"), words_of, F.col("s.doc_id").alias("class_doc_id"), F.col("s.a").alias("class_start_word"), words_of.alias("class_n_words"), F.lit(1.0).alias("similarity")).distinct()
    # two regions of a key have been compared already: one is that of the document that stands for it
    kinds_of = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.xxhash64("s._d").cast("decimal(38,0)")).alias("x"), F.min("s.c").alias("least"), F.max("s.c").alias("most"), F.approx_count_distinct("s.c").alias("parts"))
    open_keys = kinds_of.where("kinds > 2 AND least <> most").select("key", F.xxhash64("x", "kinds").alias("k"), "kinds", "parts")
    # keys with the same documents are one
    ab = (F.shiftleft(F.min("a"), 32) + F.max("b")).alias("ab")
    group = cut(classes.select("key", "s.*").join(open_keys, "key").groupBy("k", "_d", "c").agg(F.min("kinds").alias("kinds"), F.min("parts").alias("parts"), ab))
    # where most regions are in few components, there is little to compare
    many = (F.col("kinds") > GROUP) & (F.col("parts") * 4 > F.col("kinds"))
    listed = _by_blocks(group.where(~many))
    huge = group.where(many).select("k", "_d", "c", "kinds", "ab")
    place = None
    if huge.head(1):
        split, place = _by_rare_shingles(huge, keyed, shingle, length, similarity)
        listed = listed.unionByName(split)
    listed = cut(listed.groupBy("_d", "c").agg(F.collect_list(F.struct(F.col("k").alias("pk"), "ab", "at")).alias("e")))
    if place:
        remove(docs.sparkSession, place)
    cutout = listed.join(_texts_of(keyed, listed), "_d").select("_d", "doc_id", "text", "e", "c").mapInArrow(cut_out, "key long, at array<struct<i:int,j:int>>, _d long, c long, doc_id long, a long, region string")
    dealt = cutout.withColumn("at", F.explode("at")).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "_d", "c", "doc_id", "a", "region")
    later = cut(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "_d").mapInArrow(compare, schema))
    members = cut(first.select(*names).unionByName(later).unionByName(copies).distinct())
    own = members.select(F.col("class_doc_id").alias("doc_id"), F.col("class_start_word").alias("start_word"), F.col("class_n_words").alias("n_words")).distinct()
    own = own.select("doc_id", "start_word", "n_words", F.col("doc_id").alias("class_doc_id"), F.col("start_word").alias("class_start_word"), F.col("n_words").alias("class_n_words"), F.lit(1.0).alias("similarity"))
    return members.unionByName(own)
