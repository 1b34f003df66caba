"""Mixing sources to target weights: capped water-filling, native Spark only.

Every source has a weight and a size (words). The whole mix is as large as all
documents together. A source's share is clamped at ``max_epochs`` times its size
and the excess goes to the others by weight, until no share is above its clamp.
A share of ``whole`` sizes and a rest is met by ``whole`` repetitions of every
document and one more of the documents that come first in a seeded order, up to
the one whose middle lies before the rest: the error is half a document at most.

The seeded order is md5 of seed and id, then of the text. Its leading hex digits are the
buckets of a prefix sum (as many digits as rows ask for), so only the one bucket of a
source in which the rest ends is ever sorted; all other rows are aggregated where they
are read. Rows alike in id and text share a place in the order; where the rest ends
among them, they are numbered and only as many as fit are taken. Nothing is collected
but a few scalars.

Null texts have size 0, a null source is a source of its own, rows without an id or
with a repeated one take part each by itself, and an empty table gives an empty result.
Column names that begin with ``__mix`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SEED = 17
LEAST_DIGITS, MOST_DIGITS = 3, 6  # of a bucket
BROADCAST_SOURCES = 50_000  # rows of (source, two numbers, a key)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.concat(F.md5(own.cast("binary")), F.substring(F.md5(text.cast("binary")), 1, 16))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The narrow columns all later steps work on, materialised once."""
    return cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(seed).alias("key")))


def ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with ``rank`` from 0: sources by code point, null last.

    Sorted by range; a partition's rows are numbered on from the rows before it.
    """
    place = F.monotonically_increasing_id()
    t = cut(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("place", place))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    t = t.withColumn("part", part).withColumn("row", row)
    parts = t.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("row")).drop("place", "part", "row", "before")


def water_fill(totals: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, weight, source_size) plus ``target``; one small job a round."""
    totals = cut(totals)
    cap = F.col("source_size") * max_epochs
    level, before = (0, 1), -1
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    share = lambda lv: (F.col("weight") * F.lit(lv[0])).cast("double") / F.lit(float(lv[1]))
    while True:
        full = share(level) > cap
        row = totals.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[2] or row[0] == before:
            break
        before, level = row[0], (total - (row[1] or 0), row[2])
    return totals.withColumn("target", F.when(share(level) > cap, cap.cast("double")).otherwise(share(level)))


def plan(docs_sized: DataFrame, weights: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, ``whole`` repetitions and ``last``, the last
    key of the seeded order of which rows get one more ('' if none does): ``takes`` of
    its ``ties`` rows.

    ``weights`` has a row (source, weight) for every source.
    """
    # some 16^digits buckets of 16^digits rows
    digits = max(LEAST_DIGITS, min(MOST_DIGITS, -(-(docs_sized.count().bit_length()) // 8)))
    bucket = F.substring("key", 1, digits)
    per_bucket = cut(docs_sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")))
    totals = per_bucket.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = cut(water_fill(totals.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.source", "weight", "source_size"), max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    running = per_bucket.withColumn("before", F.sum("size").over(upto) - F.col("size"))
    ends = running.alias("r").join(filled.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source"))).where("before < rest").groupBy("f.source").agg(F.max(F.struct("bucket", "before", "rest")).alias("e"))
    ends = cut(ends.select("source", "e.*"))
    few = ends.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    at_end = docs_sized.alias("d").join(hint(ends.alias("e")), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.substring("d.key", 1, digits) == F.col("e.bucket")))
    places = at_end.groupBy("e.source", "d.key").agg(F.count("*").alias("ties"), F.max("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = F.sum(F.col("ties") * F.col("size")).over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties") * F.col("size")
    left = F.col("rest") - F.col("before") - inside  # what is wanted from this place on
    # the k-th row of a place is taken if its middle, (k - 1/2) sizes on, lies before the rest
    fits = F.when(left <= 0, 0).when(F.col("size") == 0, F.col("ties")).when(F.col("ties") == 1, F.when(F.col("size") / 2 < left, 1).otherwise(0))
    fits = fits.otherwise(F.least(F.col("ties"), F.greatest(F.lit(0), F.ceil(left / F.col("size") - 0.5)))).cast("long")
    taken = places.withColumn("takes", fits).where("takes > 0").groupBy("source").agg(F.max(F.struct("key", "takes", "ties")).alias("top"))
    one = F.lit(1).cast("long")
    last = ends.alias("e").join(taken.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source")), "left").select("e.source", F.coalesce("top.key", "bucket").alias("last"), F.coalesce("top.takes", one).alias("takes"), F.coalesce("top.ties", one).alias("ties"))
    return cut(filled.alias("f").join(last.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")), "left").select("f.source", "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last"), "takes", "ties"))


def with_plan(docs: DataFrame, sources: DataFrame, key: Column) -> DataFrame:
    """``docs`` with its source's plan in ``__mix`` and its ``__mix_copies``.

    The plan is broadcast only up to ``BROADCAST_SOURCES`` rows. Beyond, it is
    joined by source and the key's first digits, so no source meets in one task.
    """
    if taken := [c for c in docs.columns if c.startswith("__mix")]:
        raise ValueError(f"reserved column names: {taken}")
    p = sources.select(F.col("source").alias("__mix_s"), F.struct("source_size", "target", "whole", "last", "takes", "ties").alias("__mix"))
    d = docs.withColumn("__mix_key", key)
    same = d["source"].eqNullSafe(p["__mix_s"])
    if sources.count() <= BROADCAST_SOURCES:
        joined = d.join(F.broadcast(p), same, "left")
    else:
        p = p.withColumn("__mix_salt", F.explode(F.array(*[F.lit(x) for x in "0123456789abcdef"])))
        joined = d.join(p, same & (F.substring("__mix_key", 1, 1) == p["__mix_salt"]), "left").drop("__mix_salt")
    place, last = F.col("__mix_key"), F.col("__mix.last")
    if sources.where("takes < ties").isEmpty():
        more = F.when(place <= last, 1).otherwise(0)
    else:
        # rows of one place, of which some are taken: numbered from partition to partition
        tied = (place == last) & (F.col("__mix.takes") < F.col("__mix.ties"))
        at = cut(joined.where(tied).withColumn("__mix_at", F.monotonically_increasing_id()))
        of, part = F.coalesce(F.concat(F.lit("s"), "__mix_s"), F.lit("")), F.shiftright("__mix_at", 33)
        at = at.withColumn("__mix_of", of).withColumn("__mix_part", part)
        at = at.withColumn("__mix_nth", F.row_number().over(Window.partitionBy("__mix_of", "__mix_part").orderBy("__mix_at")))
        sizes = at.groupBy("__mix_of", "__mix_part").agg(F.count("*").alias("__mix_rows"))
        before = F.coalesce(F.sum("__mix_rows").over(Window.partitionBy("__mix_of").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = at.join(sizes.select("__mix_of", "__mix_part", before.alias("__mix_before")), ["__mix_of", "__mix_part"])
        at = at.withColumn("__mix_more", F.when(F.col("__mix_before") + F.col("__mix_nth") <= F.col("__mix.takes"), 1).otherwise(0))
        others = joined.where(~F.coalesce(tied, F.lit(False))).withColumn("__mix_more", F.when(place <= last, 1).otherwise(0))
        joined, more = others.unionByName(at.select(*others.columns)), F.col("__mix_more")
    return joined.withColumn("__mix_copies", F.col("__mix.whole") + more).drop("__mix_s", "__mix_key", "__mix_more")


def cycling_weights(docs_sized: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """Sources by code point, null last, weigh 5, 2, 1 and so on again."""
    r = ranked(docs_sized.groupBy("source").agg(F.count("*").alias("n")).select("source"))
    return r.select("source", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Pipeline form: every row as often as the mix takes it, columns unchanged."""
    narrow = sized(docs, seed)
    sources = plan(narrow, weights if weights is not None else cycling_weights(narrow), max_epochs)
    taken = with_plan(docs, sources, order_key(seed))
    return taken.where("__mix_copies > 0").withColumn("__mix_n", F.explode(F.expr("sequence(1L, __mix_copies)"))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    narrow = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = with_plan(narrow, plan(narrow, cycling_weights(narrow)), F.col("key"))
    return taken.select("doc_id", "size", "__mix.source_size", "__mix.target", (F.col("size") * F.col("__mix_copies")).alias("taken"))


ORACLE = {
    "op3_mixing": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) || substr(md5(coalesce(text, '')), 1, 16) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT AS total,
         (coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS capped,
         (sum(weight) OVER (ORDER BY 3.0 * source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight
  FROM s),
l AS (
  SELECT arg_min(total - capped, cap::DOUBLE / weight) AS amount, arg_min(rest_weight, cap::DOUBLE / weight) AS over_weight
  FROM w WHERE (weight * (total - capped))::DOUBLE / rest_weight <= cap),
t AS (
  SELECT source, source_size,
         CASE WHEN (weight * amount)::DOUBLE / over_weight > cap THEN cap::DOUBLE ELSE (weight * amount)::DOUBLE / over_weight END AS target
  FROM w, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN middle < rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
""",
}
