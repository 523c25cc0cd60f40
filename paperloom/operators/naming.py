"""Numbering and naming of finalized documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def running_sums(rows: DataFrame, group: list[str], order: list[Column], out: str, weight: Column | None = None) -> DataFrame:
    """Adds the sum of ``weight`` (1 without one) over each row's group up to the row, in a total order within the group.

    Rows are range-partitioned by group and order, so a group of any size lies in as many parts as it needs.  Sums inside
    a part start from what the earlier parts of its group hold; at most one group goes on across each border, so no
    more offsets than parts are broadcast.  Nulls in ``group`` are one group.  The rows are written once: select
    what is needed before.
    """
    by = [F.col(c) for c in group]
    spread = rows.withColumn("__w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    spread = written(spread.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "numbering")
    whole = W.partitionBy(*by)
    earlier = F.sum("__n").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    borders = spread.groupBy(*by, "__part").agg(F.sum("__w").alias("__n")).withColumn("__from", earlier).filter("__from is not null")
    borders = borders.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__part").alias("__p"), "__from")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = F.sum("__w").over(W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = spread.withColumn("__inside", inside).join(F.broadcast(borders), same, "left")
    return summed.withColumn(out, F.col("__inside") + F.coalesce("__from", F.lit(0))).select(*rows.columns, out)


def numbered_per_group(docs: DataFrame, group: list[str], order: list[Column], start: int = 1, out: str = "seq") -> DataFrame:
    """Sequence numbers from ``start`` within each group, in a total order; a group may hold all rows."""
    return running_sums(docs, group, order, out).withColumn(out, (F.col(out) + (start - 1)).cast("int"))


def numbered_globally(docs: DataFrame, order: list[str], start: int = 1, out: str = "seq") -> DataFrame:
    """Sequence numbers from ``start`` over all rows in the order of the columns (nulls last, ties by all).

    Rows are range-partitioned by the order, counted per partition and ranked inside it, so no task sorts
    everything: the rank is the partition's offset plus the row's place in it.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    spread = written(docs.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbering")
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__from", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return spread.withColumn("__place", place).join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__from") + F.col("__place") + (start - 1)).cast("long")).drop("__part", "__from", "__place")


def without_collisions(names: DataFrame, folder: str, name: str, order: list[Column], existing: DataFrame | None = None, out: str = "placed") -> DataFrame:
    """Names made unique in their folder with _1, _2, ... before the extension.

    The first row of a name keeps it unless a file of ``existing`` (folder, name) has it.  Suffixed names
    that exist or that another row is named outright are stepped over.  Any number of rows may share a name, and any
    number of suffixes may be in use: both are counted by running sums.
    """
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    taken = names.select(F.col(folder).alias("__f"), F.col(name).alias("__t"), F.lit(False).alias("__exists"))
    if existing is not None:
        taken = taken.unionByName(existing.select(F.col(folder).alias("__f"), F.col(name).alias("__t"), F.lit(True).alias("__exists")))
    taken = taken.groupBy("__f", "__t").agg(F.bool_or("__exists").alias("__exists"))
    first = taken.filter("__exists").select(F.col("__f").alias(folder), F.col("__t").alias(name), "__exists")
    base = running_sums(names, [folder, name], order, "__rank").join(first, [folder, name], "left")
    base = base.withColumns({"__stem": stem, "__ext": ext, "__need": F.col("__rank") - 1 + F.coalesce(F.col("__exists"), F.lit(False)).cast("long")})
    # Suffix numbers in use for a stem, whoever uses them; the i-th of them, u, has u - i free ones below it.
    key = [folder, "__stem", "__ext"]
    parts = taken.select(F.col("__f").alias(folder), F.regexp_extract("__t", r"^(.*)_[0-9]+(\.[^.]*)$", 1).alias("__stem"), F.regexp_extract("__t", r"(\.[^.]*)$", 1).alias("__ext"), F.expr("try_cast(regexp_extract(__t, '_([0-9]+)[.][^.]*$', 1) as int)").alias("__k"))
    used = running_sums(parts.filter("__k >= 1").distinct(), key, [F.col("__k")], "__i")
    used = used.select(*key, (F.col("__k") - F.col("__i")).alias("__at"), F.lit(1).alias("__used"))
    # The need-th free number steps over the used ones with fewer than need free ones below.
    needs = base.filter("__need > 0").select(*key, F.col("__need").alias("__at"), F.lit(0).alias("__used")).join(used.select(*key).distinct(), key, "left_semi")
    steps = running_sums(needs.unionByName(used), key, [F.col("__at"), F.col("__used")], "__over", F.col("__used")).filter("__used = 0")
    base = base.join(steps.select(*key, F.col("__at").alias("__need"), "__over"), [*key, "__need"], "left")
    number = F.col("__need") + F.coalesce("__over", F.lit(0))
    placed = F.when(F.col("__need") == 0, F.col(name)).otherwise(F.concat("__stem", F.lit("_"), number.cast("string"), "__ext"))
    return base.withColumn(out, placed).select(*names.columns, out)


def file_sequence(name: Column) -> Column:
    """The four-digit number of a finalized file's name, with or without a month before it; null for others."""
    return F.when(name.endswith(".pdf"), F.nullif(F.regexp_extract(name, "^(?:[0-9]{6})?([0-9]{4})_", 1), F.lit("")).cast("int"))


def next_sequence(files: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """One more than the largest number among the finalized names of a group; 1 without any."""
    return files.groupBy(*group).agg((F.coalesce(F.max(file_sequence(F.col(name))), F.lit(0)) + 1).alias("next_seq"))
