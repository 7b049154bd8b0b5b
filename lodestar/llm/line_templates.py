"""Line deduplication by a tree of log templates.

A line's place in the tree has a fixed depth: its number of tokens, then its first DEPTH tokens, where a token with a
digit is a variable field <*>. In a leaf, a line joins the first earlier line with at least SIMILARITY of its tokens in place; where
the lines of such a group differ, the template has a variable field too. Lines whose template occurs in MIN_DOCS documents
or more are dropped, all but the very first (by doc_id), so that no text is lost altogether.

Only leaves that as many documents reach are parsed further. A leaf with more than PART distinct lines is parsed in parts, by the
lines' hash, so that parts do not depend on the partitions. Then leaders of all parts that have SIMILARITY in place are linked,
by keys of runs of tokens, and the templates of what links connect are one. A template with variable fields found by
comparison needs LEAST_FIXED fixed tokens, so that short prose is left alone.

Defined results: lines end at \\n; blank lines have no template and stay; null text stays null, with no lines; rows with the same
doc_id and text are the same document (each is cleaned the same way); doc_id null sorts first; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, cut
from lodestar.llm.golay_simhash import forest

DEPTH, SIMILARITY, MIN_DOCS, LEAST_FIXED = 3, 0.7, 10, 5
BROADCAST_ROWS = 1_000_000  #: leaves (a long each) up to which they are broadcast; beyond, the join shuffles
PART = 20_000  #: distinct lines of a leaf, beyond which it is parsed in parts
BLOCK = 1024  #: leaders with a run key, beyond which they are compared by pairs of blocks
FIELD = "<*>"
_VARIABLE = re.compile(r"\S*\d\S*")


def masked(line: str) -> str:
    """The line's tokens, one space between; those with a digit as variable fields."""
    return " ".join((_VARIABLE.sub(FIELD, line) if any(map(str.isdigit, line)) else line).split())


def leaf_of(line: str, depth: int = DEPTH) -> int:
    """Hash of the number of tokens and the first ones; line is masked."""
    head = line.split(" ", depth)[:depth]
    return xxhash.xxh64_intdigest(f"{line.count(' ') + 1} {' '.join(head)}".encode("utf-8", "replace"), 1) - (1 << 63)


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 2) - (1 << 63)


class Leaf:
    """Groups of a leaf's lines. A line joins the first group whose leader has at most `most` other tokens.

    The first `depth` tokens are the same in all lines. The rest is split into most + 2 runs; a line with so few differences
    equals the leader in two of them, so groups are looked up by pairs of runs. Lines of over PAIRED tokens, whose runs have
    three tokens, are split into most + 1 runs and looked up by single ones.
    """

    PAIRED = 40

    def __init__(self, n: int, similarity: float, depth: int = 0):
        self.n, self.most = n, int(n * (1 - similarity) + 1e-9)
        depth = min(depth, n)
        rest = n - depth
        if rest <= self.most:  # all of them may differ: every line joins the first group
            self.runs, self.keys = [], [()]
        else:
            paired = n <= self.PAIRED and rest >= self.most + 2
            k = self.most + 2 if paired else self.most + 1
            self.runs = [(depth + i * rest // k, depth + (i + 1) * rest // k) for i in range(k)]
            self.keys = list(combinations(range(k), 2 if paired else 1))
        self.leaders: list[list[str]] = []
        self.templates: list[list[str]] = []
        self.found: dict[tuple, list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        parts = [" ".join(tokens[a:b]) for a, b in self.runs]
        keys = [(key, *(parts[i] for i in key)) for key in self.keys]
        seen: set[int] = set()
        best = None
        for k in keys:
            for g in self.found.get(k, ()):
                if best is not None and g >= best:
                    break  # groups stand in order
                if g not in seen:
                    seen.add(g)
                    if sum(x != y for x, y in zip(tokens, self.leaders[g])) <= self.most:
                        best = g
        if best is None:
            best = len(self.leaders)
            self.leaders.append(tokens)
            self.templates.append(list(tokens))
            for k in keys:
                self.found.setdefault(k, []).append(best)
        else:
            t = self.templates[best]
            for i, (x, y) in enumerate(zip(t, tokens)):
                if x != y:
                    t[i] = FIELD
        return best


def _lines(docs: DataFrame, with_text: bool, depth: int) -> DataFrame:
    """Lines of docs (doc_id, text, _k); without text only a row for each leaf of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, out = b.slice(at, 512), []
                for doc_id, text, k in zip(*(c.to_pylist() for c in part.columns)):
                    if not with_text:
                        out += [(v,) for v in {leaf_of(m, depth) for m in map(masked, (text or "").split("\n")) if m}]
                        continue
                    for i, line in enumerate((text or "").split("\n")):
                        if m := masked(line):
                            out.append((doc_id, k, i, leaf_of(m, depth), line_hash(m), m))
                names = ["doc_id", "_k", "line", "leaf", "h", "m"] if with_text else ["leaf"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()] if with_text else [pa.int64()]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return docs.select("doc_id", "text", "_k").mapInArrow(run, "doc_id long, _k long, line int, leaf long, h long, m string" if with_text else "leaf long")


def _templates(distinct: DataFrame, similarity: float, depth: int = DEPTH) -> DataFrame:
    """distinct (leaf, h, m): leaf, h, template."""
    distinct = cut(distinct.select("leaf", "h", "m"))
    large = cut(distinct.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("leaf", F.ceil(F.col("n") / PART).cast("int").alias("nb")))
    ordered = distinct.join(large, "leaf", "left").withColumn("part", F.coalesce(F.pmod("h", "nb").cast("int"), F.lit(-1))).select("leaf", "part", "h", "m")
    ordered = ordered.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "m", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, held = (None, None), None, []
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            for key, part, h, m in rows:
                tokens = m.split(" ")
                if (key, part) != at or leaf.n != len(tokens):
                    yield from done(at, leaf, held)
                    at, leaf, held, first = (key, part), Leaf(len(tokens), similarity, depth), [], []
                g = leaf.add(tokens)
                if g == len(first):
                    first.append(h)
                held.append((h, g, first[g]))
        yield from done(at, leaf, held)

    def done(at, leaf, held) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held), 10_000):
            own = held[i : i + 10_000]
            texts = [" ".join(leaf.templates[g]) for _, g, _ in own]
            columns = [pa.array(np.full(len(own), at[0])), pa.array(np.full(len(own), at[1], np.int32)), pa.array([h for h, _, _ in own], pa.int64()), pa.array([x for _, _, x in own], pa.int64()), pa.array(texts)]
            yield pa.record_batch(columns, names=["leaf", "part", "h", "g", "template"])

    found = ordered.mapInArrow(run, "leaf long, part int, h long, g long, template string")
    if not large.head(1):
        return found.select("leaf", "h", "template")
    found = cut(found)
    parts = found.where("part >= 0")
    leaders = cut(parts.where("h = g").select("leaf", "h", "template").join(distinct, ["leaf", "h"]))
    comps = components(_leader_links(leaders, similarity, depth))
    placed = leaders.join(comps.withColumnRenamed("id", "h"), "h", "left").select("leaf", F.col("h").alias("g"), "template", F.coalesce("component", "h").alias("c"))
    placed = cut(placed)
    tokens = placed.select("leaf", "c", F.posexplode(F.split("template", " ")).alias("i", "x")).groupBy("leaf", "c", "i").agg(F.min("x").alias("x"), F.max("x").alias("y"))
    each = tokens.select("leaf", "c", F.struct("i", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(FIELD).alias("x")).alias("t"))
    merged = each.groupBy("leaf", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]), " ").alias("template"))
    named = placed.select("leaf", "g", "c").join(merged, ["leaf", "c"]).select("leaf", "g", "template")
    return found.where("part < 0").select("leaf", "h", "template").unionByName(parts.select("leaf", "h", "g").join(cut(named), ["leaf", "g"]).select("leaf", "h", "template"))


def _leader_links(leaders: DataFrame, similarity: float, depth: int) -> DataFrame:
    """leaders (leaf, h, m): links (u, v) that connect leaders of a leaf with at least the similarity of their tokens in place.

    A leaf's lines have the same first tokens, so the others are split into one run more than tokens may differ: such lines
    share a run.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for leaf, h, m in zip(*(c.to_pylist() for c in b.columns)):
                tokens = m.split(" ")
                most, rest = int(len(tokens) * (1 - similarity) + 1e-9), tokens[depth:]
                runs = 1 if len(rest) <= most else most + 1  # so few tokens that all may differ: the leaf is one run
                for i in range(runs):
                    run = [] if len(rest) <= most else rest[i * len(rest) // runs : (i + 1) * len(rest) // runs]
                    out.append((xxhash.xxh64_intdigest(f"{leaf} {i} {' '.join(run)}".encode("utf-8", "replace"), 3) - (1 << 63), h, m))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["k", "h", "m"])

    rows = cut(leaders.select("leaf", "h", "m").mapInArrow(keyed, "k long, h long, m string"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("h"), F.col("nb")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = rows.join(sizes, "k").withColumn("at", F.explode(spread)).select("k", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "h", "m")
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for k, i, j, h, m in zip(*(c.to_pylist() for c in b.columns)):
                if (k, i, j) != at:
                    yield from linked(held)
                    at, held = (k, i, j), []
                held.append((h, m.split(" ")))
        yield from linked(held)

    def linked(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2 or len({len(t) for _, t in held}) > 1:
            return
        ids: dict[str, int] = {}
        x = np.array([[ids.setdefault(t, len(ids)) for t in tokens] for _, tokens in held])
        h, most = np.array([h for h, _ in held], np.int64), int(x.shape[1] * (1 - similarity) + 1e-9)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(x) - 1):
            hit = i + 1 + np.flatnonzero((x[i + 1 :] != x[i]).sum(axis=1) <= most)
            a.append(np.full(len(hit), i))
            b.append(hit)
            if sum(map(len, a)) > 500_000:
                label = forest(len(x), np.concatenate(a), np.concatenate(b))
                a, b = [np.arange(len(x))], [label]
        label = forest(len(x), np.concatenate(a), np.concatenate(b))
        some = label != np.arange(len(x))
        if some.any():
            yield pa.record_batch([pa.array(h[some]), pa.array(h[label[some]])], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long")


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, least_fixed: int = LEAST_FIXED) -> DataFrame:
    """docs (doc_id, text, _k = hash of text): (doc_id, _k, line, template) of lines to drop."""
    leaves = cut(_lines(docs, False, depth).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    few = leaves.count() <= BROADCAST_ROWS
    lines = cut(_lines(docs, True, depth).join(F.broadcast(leaves) if few else leaves, "leaf").select("doc_id", "_k", "line", "leaf", "h", "m"))
    found = _templates(lines.groupBy("leaf", "h").agg(F.min("m").alias("m")), similarity, depth)
    fields = F.filter(F.split("template", " "), lambda t: t != FIELD)
    sure = (F.size(fields) >= least_fixed) | (F.col("template") == F.col("m"))
    named = lines.join(found, ["leaf", "h"]).withColumn("template", F.when(sure, F.col("template")).otherwise(F.col("m")))
    named = cut(named.select("doc_id", "_k", "line", F.xxhash64("leaf", "template").alias("t"), "template"))
    docs_of = named.groupBy("t", "doc_id", "_k").agg(F.min("line").alias("line"))
    often = docs_of.groupBy("t").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "_k", "line")).alias("first")).where(F.col("n_docs") >= min_docs)
    often = cut(often)  # a plain table on this side lets adaptive execution split a common template's rows
    first = F.col("first")
    is_first = F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("_k") == first["_k"]) & (F.col("line") == first["line"])
    return named.join(often, "t").where(~is_first).select("doc_id", "_k", "line", "template")


def drop_lines(docs: DataFrame, added: tuple[str, str] = ("n_lines", "n_dropped"), **options) -> DataFrame:
    """The columns of docs (doc_id, text and more), text without the recurring lines, then their numbers of lines and of
    lines dropped, named by added. A name that docs has already gets underscores until it is new.
    """
    names, new = docs.columns, []
    for name in added:
        while name.lower() in [n.lower() for n in (*names, *new)]:
            name += "_"
        new.append(name)
    inner = docs.toDF(*[f"_lt{i}" for i in range(len(names))])
    by = {n: f"_lt{i}" for i, n in enumerate(names)}
    k = F.xxhash64(F.col(by["text"]))
    keyed = inner.select(F.col(by["doc_id"]).alias("doc_id"), F.col(by["text"]).alias("text"), k.alias("_k"))
    gone = recurring_lines(keyed, **options).groupBy("doc_id", "_k").agg(F.collect_set("line").alias("_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "_gd", "_k": "_gk"})
    joined = inner.withColumn("_lk", k).join(gone, F.col(by["doc_id"]).eqNullSafe(F.col("_gd")) & (F.col("_lk") == F.col("_gk")), "left").drop("_lk", "_gd", "_gk")
    at = joined.columns.index(by["text"])
    end = len(joined.columns) - 1
    out_names = [*joined.columns[:end], "_ln", "_ld"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, gone_lines in zip(b.column(at).to_pylist(), b.column(end).to_pylist()):
                own = text.split("\n") if text else []
                out = set(gone_lines or ())
                texts.append("\n".join(x for i, x in enumerate(own) if i not in out) if out else text)
                lines.append(len(own))
                dropped.append(len(out))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:end])]
            yield pa.record_batch([*columns, pa.array(lines, pa.int32()), pa.array(dropped, pa.int32())], names=out_names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:end]), "_ln int, _ld int"])
    return joined.mapInArrow(run, schema).toDF(*names, *new)
