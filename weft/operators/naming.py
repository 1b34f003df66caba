"""Numbering and disambiguation: unique names, aliases, first of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import settle


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """``row`` from 0 in a total order; ranges are numbered on from those before."""
    placed = settle(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # a row for each partition
    return placed.join(offsets, "__part").withColumn("row", F.col("__before") + F.col("__row")).drop("__at", "__part", "__row", "__before")


def make_unique(df: DataFrame, name: str, order: list[str], within: list[str] | None = None, alias: str = "unique_name") -> DataFrame:
    """The first of a name keeps it; others get ``_2``, ``_3`` and so on, without the
    numbers that make another row's own name. A suffix and a name give a suffixed name
    in one way only, so own names are all that can clash."""
    keys = within or []
    rows = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)) - 1).withColumn("__own", F.col(name))
    # numbers that own names take: the i-th of a name moves on whatever has a place of number - i or more
    own = df.select(*keys, F.regexp_extract(name, "^(?s:(.*))_([1-9][0-9]{0,8})$", 1).alias("__own"), F.regexp_extract(name, "^(?s:(.*))_([1-9][0-9]{0,8})$", 2).try_cast("int").alias("__n"))
    own = own.where("__n >= 2").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys, "__own").orderBy("__n"))
    blocks = own.select(*keys, "__own", (F.col("__n") - nth).alias("__r"), F.lit(1).alias("__block"))
    both = rows.withColumn("__block", F.lit(0)).unionByName(blocks, allowMissingColumns=True)
    # 1 for each taken number at or before a row's place
    before = F.sum("__block").over(Window.partitionBy(*keys, "__own").orderBy("__r", F.desc("__block")).rowsBetween(Window.unboundedPreceding, 0))
    number = F.col("__r") + 1 + F.col("__before")
    found = both.withColumn("__before", before).where("__block = 0")
    return found.withColumn(alias, F.when(F.col("__r") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), number.cast("string")))).drop("__r", "__own", "__block", "__before")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__row")).select(*keys, "__row.*")


def alias_depth(df: DataFrame, name: str, path: str, mark: str = ".") -> DataFrame:
    """``depth``: how many trailing segments of ``path`` all rows of a name need so
    that their aliases differ; 1 where the name is its only one. A name's longest path
    bounds it: shorter ones are whole from their own length on."""
    parts = F.split(path, F.lit(f"\\{mark}"))
    longest = df.groupBy(name).agg(F.max(F.size(parts)).alias("__most"))
    depths = df.select(name, path).distinct().join(longest, name).select(name, path, F.explode(F.sequence(F.lit(1), F.col("__most"))).alias("depth"))
    size = F.least("depth", F.size(parts))
    alias = F.array_join(F.slice(parts, -size, size), mark)
    enough = depths.groupBy(name, "depth").agg(F.countDistinct(alias).alias("aliases"), F.countDistinct(path).alias("paths")).where("aliases = paths").groupBy(name).agg(F.min("depth").alias("depth"))
    return df.join(enough, name, "left").withColumn("depth", F.coalesce("depth", F.lit(1)))


def qualify_collisions(df: DataFrame, literal: str, type_: str, alias: str = "class_name") -> DataFrame:
    """A literal that several types have is named by type and literal."""
    shared = df.groupBy(literal).agg((F.countDistinct(type_) > 1).alias("__shared"))
    return df.join(shared, literal).withColumn(alias, F.when(F.col("__shared"), F.concat_ws("_", type_, literal)).otherwise(F.col(literal))).drop("__shared")


def forward_references(order: DataFrame, refs: DataFrame) -> DataFrame:
    """(class, target) whose target comes at or after the class in (class, position)."""
    own, other = order.select("class", F.col("position").alias("at")), order.select(F.col("class").alias("target"), F.col("position").alias("to"))
    return refs.join(own, "class").join(other, "target").where("to >= at").select("class", "target")


def counter(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def resolve(df: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """``df`` with ``unresolved``: whether nothing has the key it refers to."""
    have = targets.select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return df.join(have, F.col(ref) == F.col("__key"), "left").withColumn("unresolved", F.col("__hit").isNull()).drop("__key", "__hit")


def first_match(*choices: tuple[Column, str]) -> Column:
    """The label of the first condition that holds, in order of priority."""
    out = None
    for condition, label in choices:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out
