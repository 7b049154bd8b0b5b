"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens (here words) its source has sent up to and including
it, divided by the source's target. Copies are taken in the order of these times until the budget is used up, so at
any cut each source has sent its share. Within a source, documents follow a seeded hash; a source whose target is
above its size starts again from the top, up to `max_epochs` times.

Prefix sums never gather a source in one task: sizes are summed by (source, hash bucket), offsets are taken over these
sums alone, and rows are ordered only within their bucket. The number of buckets grows with the rows, so that a bucket, or a slot
of finish times, has BUCKET_ROWS rows at most on average; results don't depend on it.

Defined results: null text has no words; a document without words is never taken; null source is a source of its own,
last in order; null doc_id is hashed as an empty string; equal rows are rows of their own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKETS = 1024  #: hash buckets of a source, and slots of finish times in a unit of virtual time: at least so many
BUCKET_ROWS = 8192
_KEY = ["_mx_s", "_mx_n", "_mx_b"]


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_buckets(rows: int) -> int:
    """A power of two, from BUCKETS to 2^30."""
    return min(1 << 30, max(BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """sizes: (_mx_s, _mx_n, source_size), a row for each source. Adds target.

    Sources in order of code point, null last, have the weights in turn. Water filling: the level is such that
    sources above it get weight times level, the others max_epochs times their size.
    """
    order = Window.orderBy("_mx_n", "_mx_s")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    w = w.withColumn("_cap", F.col("source_size") * max_epochs)
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_mx_n", "_mx_s")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after)
    w = w.withColumn("_level", level)
    w = w.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_mx_n", "_mx_s", "_level"))).over(whole)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return w.select("_mx_s", "_mx_n", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def plan_mix(docs: DataFrame, payload: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """A row for each row of docs (doc_id, text, source and more): the payload columns of docs, size, source_size,
    target, and finish, the virtual finish times of the copies that the mix takes (an array, empty if none).
    """
    buckets = n_buckets(docs.count())
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        *[F.col(c).alias(f"_mx_p{i}") for i, c in enumerate(payload)],
        n_words(F.col("text")).alias("_mx_size"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_mx_s"),
        F.col("source").isNull().alias("_mx_n"),
        h.alias("_mx_h"),
        F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * buckets, 32).cast("int").alias("_mx_b"),
    )
    if "text" not in payload:  # then rows are small, and texts are read once
        sized = cut(sized)
    sums = cut(sized.groupBy(*_KEY).agg(F.sum("_mx_size").alias("_w")))
    targets = source_targets(sums.groupBy("_mx_s", "_mx_n").agg(F.sum("_w").alias("source_size")), weights, share, max_epochs)
    up_to = Window.partitionBy("_mx_s", "_mx_n").orderBy("_mx_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_w").over(up_to), F.lit(0))).drop("_w").join(targets, ["_mx_s", "_mx_n"])
    within = Window.partitionBy(*_KEY).orderBy("_mx_h", "_mx_size").rowsBetween(Window.unboundedPreceding, 0)

    def timed(rows: DataFrame) -> DataFrame:
        rows = rows.join(offsets, _KEY).withColumn("_cum", F.col("_before") + F.sum("_mx_size").over(within))
        ends = F.array(*[(F.col("source_size") * e + F.col("_cum")) / F.col("target") for e in range(max_epochs)])
        return rows.withColumn("_ends", F.when(F.col("_mx_size") > 0, ends).otherwise(F.array().cast("array<double>")))

    lean = timed(sized.select(*_KEY, "_mx_h", "_mx_size"))
    budget = share * (sums.agg(F.sum("_w")).first()[0] or 0)
    last = finish_limit(lean.select(F.explode("_ends").alias("f"), F.col("_mx_size").alias("w")), budget, buckets)
    kept = F.filter("_ends", lambda f: f <= F.lit(last))
    return timed(sized).select(
        *[F.col(f"_mx_p{i}").alias(c) for i, c in enumerate(payload)],
        F.col("_mx_size").alias("size"), "source_size", "target", kept.alias("finish"),
    )


def finish_limit(copies: DataFrame, budget: float, slots: int = BUCKETS) -> float:
    """The largest finish time up to which copies (f double, w long) sum to the budget at most; minus infinity if none.

    Sums by slot of time, slots to a unit, find the slot where the budget runs out; only this slot's times are ordered.
    """
    slot = F.floor(F.col("f") * slots).cast("long")
    by_slot = cut(copies.groupBy(slot.alias("b")).agg(F.sum("w").alias("w"), F.max("f").alias("f")))
    run = by_slot.withColumn("c", F.sum("w").over(Window.orderBy("b")))
    row = run.agg(F.max(F.when(F.col("c") <= budget, F.col("f"))), F.max(F.when(F.col("c") <= budget, F.col("c"))), F.min(F.when(F.col("c") > budget, F.col("b")))).first()
    best, used, edge = (row[0] if row[0] is not None else float("-inf")), row[1] or 0, row[2]
    if edge is None:
        return best
    times = copies.where(slot == edge).groupBy("f").agg(F.sum("w").alias("w"))
    more = times.withColumn("c", F.lit(used) + F.sum("w").over(Window.orderBy("f"))).where(F.col("c") <= budget).agg(F.max("f")).first()[0]
    return best if more is None else more


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: the columns of docs, a row for each copy taken, globally sorted by virtual finish time."""
    planned = plan_mix(docs, docs.columns, **options)
    n = len(docs.columns)
    flat = planned.toDF(*[f"_mx_p{i}" for i in range(n)], "_mx_1", "_mx_2", "_mx_3", "_mx_f")
    rows = flat.withColumn("_mx_t", F.explode("_mx_f")).orderBy("_mx_t")
    return rows.select(*[F.col(f"_mx_p{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    planned = plan_mix(docs, ["doc_id"], **options)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("finish")).alias("taken"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), l AS (
  SELECT *, 2 * source_size / w AS r,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w
), t AS (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE, w * (SELECT arg_min(lev, r) FROM l WHERE lev * w <= 2 * source_size)) AS target
  FROM w
), c AS (
  SELECT d.doc_id, d.size, d.h, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT c.*, (k.e * source_size + cum)::DOUBLE / target AS f FROM c, (VALUES (0), (1)) k(e) WHERE size > 0
), lim AS (
  SELECT max(f) AS f FROM (SELECT f, sum(size) OVER (ORDER BY f) AS run FROM e) WHERE run <= 1.5 * (SELECT sum(size) FROM d)
)
SELECT c.doc_id, c.size, c.source_size, c.target,
       CAST(c.size * (CASE WHEN c.size > 0 THEN (cum::DOUBLE / target <= (SELECT f FROM lim))::INT + ((source_size + cum)::DOUBLE / target <= (SELECT f FROM lim))::INT ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
