"""Near-duplicate texts at a given similarity of word shingles, by SimHash and Golay-code fuzzy hashing.

At a Jaccard similarity of 0.8, fingerprints of near-duplicates differ in about 15 % of their bits, far beyond what a few
segments of 64 bits can make up for. So fingerprints here have SEGMENTS segments of 23 bits, with the votes behind each bit, and
decoding is soft: a segment gives the NEAREST codewords that its votes agree with most, best first. Segments are taken in threes;
each three gives the keys of those combinations of its codewords whose places sum to RANKS at most, 36 bits each, and two texts are
candidates if they share one. Keys that long hardly ever meet by chance, so candidates grow with the near-duplicates, not with the square of the
texts. By simulation, a pair shares a key with probability 0.998 at a similarity of 0.8. Candidates pass
on 64 bits of the fingerprint, then on their shingles themselves.

Texts with the same words are one candidate. Shingles that only one of the texts with shared keys has are counted; two texts with so
many of them that they can't reach the similarity are no candidates. Verification goes in three rounds. First, the text with the most
shared keys stands for each of its keys, and each text is verified against the one of these that it shares most keys with. Where
this leaves texts of a key in different components, each is verified against the one before it, of another component, that is nearest
by fingerprint. What is still in different components is then compared exactly: all texts that share a key, pass on 64 bits and are not
connected yet.

Defined results: null, empty and blank texts are copies of each other; a text with fewer words than a shingle is one shingle; of a
group, the document with the smallest doc_id stays (null last; of equal ones one); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import AT_ONCE, components, cut, remove, stored
from lodestar.llm.golay_simhash import _remainder, blocked_rows, words
from lodestar.llm.shingles import hashes_of_each, shingle_hashes

SEGMENTS, NEAREST, RANKS, SIZE, SIMILARITY, BLOCK = 15, 4, 3, 5, 0.8, 2048
#: threes of segments: no two share a pair, and a segment is in five on average
THREES = [(t, (t + 1) % 15, (t + 5) % 15) for t in range(15)] + [(t, (t + 2) % 15, (t + 8) % 15) for t in (3 * i // 2 for i in range(10))]
_COMBINATIONS = np.array([c for c in product(range(NEAREST), repeat=3) if sum(c) <= RANKS])
BROADCAST_ROWS = 4_000_000  #: keys (a long each) up to which they are broadcast; beyond, the join shuffles
TEXTS, BUCKET_KEYS = 2048, 4_000_000  #: texts whose keys are dealt at a time; keys of a bucket that a worker sorts at once, on average
_BYTES = -(-SEGMENTS * 23 // 8)
_codes: list[np.ndarray] = []


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, hashes with the bit less those without."""
    total = np.zeros(_BYTES * 8, np.int64)
    for at in range(0, len(hashes), 16_384):
        h = hashes[at : at + 16_384]
        lanes = []
        for i in range(-(-_BYTES // 8)):
            x = (h ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            lanes.append((x ^ x >> np.uint64(32)).view(np.uint8).reshape(-1, 8))
        bits = np.unpackbits(np.concatenate(lanes, axis=1)[:, :_BYTES], axis=1, bitorder="little")
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(h)
    return total


def nearest_codewords(v: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS, NEAREST) indices of codewords, of votes (n, bits); the best first."""
    if not _codes:
        c = np.array([m << 11 ^ _remainder(m << 11) for m in range(4096)])
        _codes.append((((c[:, None] >> np.arange(23)) & 1) * 2.0 - 1).astype(np.float32).T.copy())
    x = v[:, : SEGMENTS * 23].astype(np.float32).reshape(-1, 23)
    score = x @ _codes[0]
    near = np.argpartition(score, 4096 - NEAREST, axis=1)[:, 4096 - NEAREST :]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1), axis=1)
    return near.reshape(len(v), SEGMENTS, NEAREST)


def soft_keys(near: np.ndarray) -> np.ndarray:
    """(n, keys): for each three of segments the likely combinations of their codewords."""
    near = near.astype(np.int64)
    p, q, r = _COMBINATIONS.T
    out = []
    for i, (a, b, c) in enumerate(THREES):
        out.append(near[:, a, p] << 24 | near[:, b, q] << 12 | near[:, c, r] | i << 36)
    return np.concatenate(out, axis=1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    return [np.unique(h) for h in hashes_of_each(texts, size)]


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, _d, text): doc_id, _d, k (hash of the words), fp (64 bits), near (codewords), n (distinct shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                texts = part.column(2).to_pylist()
                k = np.array([xxhash.xxh64_intdigest(b" ".join(words(t)), 3) for t in texts], np.uint64).view(np.int64)
                sets = _shingle_sets(texts, size)
                v, n = np.stack(list(map(votes, sets))), np.array([len(x) for x in sets], np.int64)
                fp = np.packbits(v[:, :64] > 0, axis=1, bitorder="little").view(np.int64).ravel()
                near = pa.array([x.tobytes() for x in nearest_codewords(v).astype(np.int16)], pa.binary())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(k), pa.array(fp), near, pa.array(n)], names=["doc_id", "_d", "k", "fp", "near", "n"])

    return docs.select("doc_id", "_d", "text").mapInArrow(run, "doc_id long, _d long, k long, fp long, near binary, n long")


def bit_limit(similarity: float) -> int:
    """Differing bits of 64 that the similarity allows for, 3.3 standard deviations above the mean."""
    rate = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * rate + 3.3 * np.sqrt(64 * rate * (1 - rate)))


def repeated_keys(classes: DataFrame, per_bucket: int = BUCKET_KEYS) -> DataFrame:
    """classes (_d, fp, near): the keys (k) that two texts or more have.

    Keys are dealt by their upper bits, so that a value holds the lower ones (four bytes each) of many texts, and counted by sorting
    in numpy. Of a key that many texts have, TEXTS of them send two at most. Buckets hold per_bucket keys on average, or as many as four bytes tell apart.
    """
    n = max(1, classes.count()) * len(_COMBINATIONS)  # keys of a three
    low = min(32, 36 - min(36, int(np.ceil(np.log2(max(1, n / per_bucket))))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                held.append(_codewords(b.column(0).slice(at, TEXTS)))
                size += len(held[-1])
                if size >= TEXTS:
                    yield bucketed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield bucketed(np.concatenate(held))

    def bucketed(near: np.ndarray) -> pa.RecordBatch:
        k = np.sort(soft_keys(near).ravel())
        k = k[np.concatenate([[True, True], k[2:] != k[:-2]])]
        b, lower = k >> low, (k & (1 << low) - 1).astype(np.uint32)
        heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        return pa.record_batch([pa.array(b[heads]), pa.array([x.tobytes() for x in np.split(lower, heads[1:])], pa.binary())], names=["b", "lower"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for b, lower in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != last and held:
                    yield repeated(last, held)
                    held = []
                last = b
                held.append(np.frombuffer(lower.as_buffer(), np.uint32).copy())
        if held:
            yield repeated(last, held)

    def repeated(b: int, held: list[np.ndarray]) -> pa.RecordBatch:
        k = np.sort(np.concatenate(held))
        k = np.unique(k[1:][k[1:] == k[:-1]])
        return pa.record_batch([pa.array(k.astype(np.int64) | b << low)], names=["k"])

    return classes.select("near").mapInArrow(dealt, "b long, lower binary").repartition("b").sortWithinPartitions("b").mapInArrow(counted, "k long")


def _codewords(near: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in near), np.int16).reshape(-1, SEGMENTS, NEAREST)


def key_rows(classes: DataFrame) -> DataFrame:
    """classes (_d, fp, near): (k, _d, fp) for each key that another text has, too."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                k = soft_keys(_codewords(part.column(2)))
                n = k.shape[1]
                yield pa.record_batch([pa.array(k.ravel()), pa.array(np.repeat(np.asarray(part.column(0)), n)), pa.array(np.repeat(np.asarray(part.column(1)), n))], names=["k", "_d", "fp"])

    again = cut(repeated_keys(classes))
    known = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    return classes.select("_d", "fp", "near").mapInArrow(keyed, "k long, _d long, fp long").join(known, "k")


def hopeful(rows: DataFrame, similarity: float) -> DataFrame:
    """rows of key_rows with nu, but those whose text can't have the similarity even with the shortest one of the key."""
    n, u = F.shiftright("nu", 32), F.col("nu").bitwiseAND(F.lit(0xFFFFFFFF))
    shortest = rows.groupBy("k").agg(F.min(n).alias("least"))
    able = n - u >= similarity * (F.col("least") + u) - 1e-9
    return rows.join(shortest, "k").where(able).drop("least")


def representatives(rows: DataFrame, similarity: float) -> DataFrame:
    """rows of key_rows with nu: (u, v), for each text the one it shares most keys with, of those that stand for a key: these have the
    most shared keys of its texts. Their 64 bits and nu allow for the similarity.
    """
    degrees = cut(rows.groupBy("_d").agg(F.count("*").alias("n")))
    ranked = rows.join(F.broadcast(degrees) if degrees.count() <= BROADCAST_ROWS else degrees, "_d")
    most = F.max(F.struct("n", "_d", "fp", "nu"))
    least = cut(ranked.groupBy("k").agg(most.alias("m")).select("k", F.col("m._d").alias("v"), F.col("m.fp").alias("vf"), F.col("m.nu").alias("vnu")))
    own, other = (tuple(f(x) for f in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)))) for x in (F.col("nu"), F.col("vnu")))
    both = F.least(own[0] - own[1], other[0] - other[1])
    able = (both >= similarity * (own[0] + other[0] - both) - 1e-9) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("vf"))) <= bit_limit(similarity))
    met = rows.join(least, "k").where((F.col("_d") != F.col("v")) & able).groupBy("_d", "v").agg(F.count("*").alias("n"))
    best = met.groupBy("_d").agg(F.max(F.struct("n", "v"))["v"].alias("v"))
    return best.select(F.least("v", "_d").alias("u"), F.greatest("v", "_d").alias("v")).distinct()


def reachable(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts can have the similarity, by n << 32 | u of each: n shingles, of which u are in no other text."""
    na, nb = a >> 32, b >> 32
    both = np.minimum(na - (a & 0xFFFFFFFF), nb - (b & 0xFFFFFFFF))
    return both >= similarity * (na + nb - both) - 1e-9


def nearest_of_others(rows: DataFrame, comps: DataFrame, similarity: float, block: int) -> DataFrame:
    """rows of key_rows, comps (id, component): distinct (u, v) of texts, each with the nearest before it of another component in a
    block of a key, if its 64 bits allow for the similarity.
    """
    limit = bit_limit(similarity)

    def nearest(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, c, nu, n = x[1].view(np.uint64), x[2], x[3], x.shape[1]
        best, who, at, step = np.full(n, 65), np.arange(n), np.arange(n - 1), 1
        while True:
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            able = (c[at] != c[at + step]) & reachable(nu[at], nu[at + step], similarity)
            d = np.where(able, np.bitwise_count(fp[at] ^ fp[at + step]), 65)
            closer = d < best[at + step]
            best[at[closer] + step], who[at[closer] + step] = d[closer], at[closer]
            step += 1
        some = np.flatnonzero(best <= limit)
        return np.minimum(x[0][some], x[0][who[some]]), np.maximum(x[0][some], x[0][who[some]])

    return blocked_rows(_mixed(rows, comps), ["_d", "fp", "c", "nu"], nearest, block).where("u <> v").distinct()


def _mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows of keys whose texts are in several components, with their component c."""
    placed = rows.join(comps.withColumnRenamed("id", "_d"), "_d", "left").select(*rows.columns, F.coalesce("component", "_d").alias("c"))
    mixed = placed.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("k")
    return placed.join(mixed, "k")


def unconnected(rows: DataFrame, comps: DataFrame, similarity: float, block: int) -> DataFrame:
    """rows of key_rows, comps (id, component): distinct (u, v) of all texts of different components that share a key and whose 64 bits
    allow for the similarity.
    """
    limit = bit_limit(similarity)
    def pairs(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, c, nu, at, step = x[1].view(np.uint64), x[2], x[3], np.arange(x.shape[1] - 1), 1
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while True:
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            hit = at[(c[at] != c[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= limit) & reachable(nu[at], nu[at + step], similarity)]
            a.append(x[0][hit])
            b.append(x[0][hit + step])
            step += 1
        u, v = np.concatenate(a), np.concatenate(b)
        return np.minimum(u, v), np.maximum(u, v)

    return blocked_rows(_mixed(rows, comps), ["_d", "fp", "c", "nu"], pairs, block).where("u <> v").distinct()


def groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, _d = hash of both): (_d, doc_id, component) for each row."""
    each = cut(_sketches(docs, size))
    classes = cut(each.select("k", "_d", "fp", "near", "n").dropDuplicates(["k"]))
    rows, place = stored(key_rows(classes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in _shingle_sets(part.column(1).to_pylist(), size)], pa.binary())], names=["_d", "h"])

    def each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                own = _shingle_sets(part.column(1).to_pylist(), size)
                yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), [len(x) for x in own]))], names=["h", "_d"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(h.as_buffer(), np.uint64) for h in b.column(i)] for i in (2, 3))
            ok = pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    def verified(edges: DataFrame) -> DataFrame:
        wanted = edges.select(F.col("u").alias("_d")).union(edges.select(F.col("v").alias("_d"))).distinct()
        few = wanted.count() <= BROADCAST_ROWS
        texts = docs.select("_d", "text").join(F.broadcast(wanted) if few else wanted, "_d", "left_semi").dropDuplicates(["_d"])
        shingles = texts.mapInArrow(sets, "_d long, h binary")
        one = edges.join(shingles.select(F.col("_d").alias("u"), F.col("h").alias("hu")), "u")
        both = one.join(shingles.select(F.col("_d").alias("v"), F.col("h").alias("hv")), "v").select("u", "v", "hu", "hv")
        return cut(both.mapInArrow(verify, "u long, v long"))

    asked = cut(rows.select("_d").distinct())
    few = asked.count() <= BROADCAST_ROWS
    texts = docs.select("_d", "text").join(F.broadcast(asked) if few else asked, "_d", "left_semi").dropDuplicates(["_d"])
    alone = texts.mapInArrow(each_shingle, "h long, _d long").groupBy("h").agg(F.count("*").alias("n"), F.min("_d").alias("_d")).where("n = 1")
    counts = classes.select("_d", "n").join(alone.groupBy("_d").agg(F.count("*").alias("u")), "_d", "left")
    counts = cut(asked.join(counts, "_d").select("_d", (F.shiftleft("n", 32) + F.coalesce("u", F.lit(0))).alias("nu")))
    known = rows.join(F.broadcast(counts) if few else counts, "_d")
    rows, now = stored(hopeful(known, similarity))
    remove(docs.sparkSession, place)
    place = now
    tried = cut(representatives(rows, similarity))
    links = verified(tried)
    comps = components(links, AT_ONCE)
    rows, place = _fewer(rows, comps, place)  # a key of one component has nothing to add in later rounds
    for turn in (nearest_of_others, unconnected):
        more = cut(turn(rows, comps, similarity, block).join(tried, ["u", "v"], "left_anti"))
        if not more.head(1):
            continue
        tried = tried.unionByName(more)
        links = links.unionByName(verified(more))
        comps = components(links, AT_ONCE)
        rows, place = _fewer(rows, comps, place)
    remove(docs.sparkSession, place)
    named = classes.select("k", "_d").join(comps.withColumnRenamed("id", "_d"), "_d", "left").select("k", F.coalesce("component", "_d").alias("component"))
    return each.select("_d", "doc_id", "k").join(named, "k").select("_d", "doc_id", "component")


def _fewer(rows: DataFrame, comps: DataFrame, place: str) -> tuple[DataFrame, str]:
    """The rows of keys with several components, as a table that takes the place of the one before."""
    left, now = stored(_mixed(rows, comps).drop("c"))
    remove(rows.sparkSession, place)
    return left, now


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs (doc_id, text and more), one row for each group of near-duplicates."""
    names = docs.columns
    inner = docs.toDF(*[f"_nt{i}" for i in range(len(names))])
    by = {n: f"_nt{i}" for i, n in enumerate(names)}
    keyed = inner.withColumn("_d", F.xxhash64(by["doc_id"], by["text"]))
    found = groups(keyed.select(F.col(by["doc_id"]).alias("doc_id"), F.col(by["text"]).alias("text"), "_d"), **options)
    stays = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_d")).alias("s")).select(F.col("s._d").alias("_d"))
    return keyed.join(stays, "_d").dropDuplicates(["_d"]).drop("_d").toDF(*names)
