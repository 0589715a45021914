"""Scans in order over sequences of any size: sessions, neighbours and ranks without a window that holds a whole group.

Rows are dealt by ranges of (key, order); a range is sorted and scanned by itself (a window over range and
key), the scanned ranges are written once, and only a row for each range of a key (its ends, its counts)
meets in one place: what earlier and later ranges know is carried across the edges from there. A key, or
the one sequence of a table without a key, is thus spread over as many tasks as it has rows for. Ties in
the order need a last column that tells rows apart, so equal times are split like any others. Ranges of a
written table survive lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.functions.timeparts import micros_between
from datelode.operators.components import saved

#: The number of a row's range; ranges of one key follow each other.
RANGE = "__range"


def dealt(rows: DataFrame, key: list[str], order: list[Column | str], ranges: int | None = None) -> DataFrame:
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *key, *order).withColumn(RANGE, F.spark_partition_id())


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equal in all of names, null to null."""
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[c])
    return out


def joined(rows: DataFrame, carried: DataFrame, names: list[str], small: bool = False) -> DataFrame:
    """rows with the columns of carried, left join by names, null to null."""
    other = carried.withColumnsRenamed({c: f"__r_{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return rows.join(F.broadcast(other) if small else other, on, "left").drop(*[f"__r_{c}" for c in names])


def edges(scanned: DataFrame, key: list[str], least: int = 1, **ends: Column) -> DataFrame:
    """One row for each key of at least so many ranges: e, the array of (range, *ends) in order."""
    each = scanned.groupBy(RANGE, *key).agg(*[c.alias(k) for k, c in ends.items()])
    return each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(RANGE, *ends))).alias("e")).where(F.size("e") >= least)


def total(entries: Column, value) -> Column:
    return F.aggregate(entries, F.lit(0).cast("long"), lambda s, x: s + value(x))


def before(e: Column, i: Column) -> Column:
    """Entries before place i (from 0)."""
    return F.slice(e, F.lit(1), i)


def behind(e: Column, i: Column) -> Column:
    return F.slice(e, i + 2, F.size(e))


def sessions(rows: DataFrame, time: str, key: list[str], tie: str, gap_hours: float, ranges: int | None = None) -> DataFrame:
    """Adds session_idx as timeline.sessionize() does, for keys of any size or none: from 0 in each key, a new one after a gap of more than gap_hours."""
    limit = int(gap_hours * 3_600_000_000)
    w = Window.partitionBy(RANGE, *key).orderBy(time, tie)
    new = F.when(micros_between(F.lag(time).over(w), F.col(time)) > limit, F.lit(1)).otherwise(F.lit(0))
    scanned = saved(dealt(rows, key, [time, tie], ranges).withColumn("__new", new).withColumn("__run", F.sum("__new").over(w)))
    first = F.when(F.count("*") == F.count(time), F.min(time))  # rows without a time come first
    several = edges(scanned, key, 2, first=first, last=F.max(time), new=F.sum("__new"))
    cut = F.transform("e", lambda x, i: F.struct(x[RANGE].alias(RANGE), x["new"].alias("new"), F.when(micros_between(F.get("e", i - 1)["last"], x["first"]) > limit, F.lit(1)).otherwise(F.lit(0)).alias("cut")))
    starts = several.withColumn("e", cut).select(*key, F.explode(F.transform("e", lambda x, i: F.struct(x[RANGE].alias(RANGE), (x["cut"] + total(before(F.col("e"), i), lambda y: y["new"] + y["cut"])).alias("__start")))).alias("s")).select(*key, "s.*")
    out = joined(scanned, starts, [RANGE, *key], small=True)  # at most two rows a range: a range has one key that goes on at each end
    return out.withColumn("session_idx", (F.coalesce("__start", F.lit(0)) + F.col("__run")).cast("int")).drop(RANGE, "__new", "__run", "__start")


def numbered(rows: DataFrame, key: list[str], order: list[Column | str], name: str, ranges: int | None = None) -> DataFrame:
    """Adds name, the place of a row in the order of its key from 0; keys of any size."""
    w = Window.partitionBy(RANGE, *key).orderBy(*order)
    scanned = saved(dealt(rows, key, order, ranges).withColumn("__place", F.row_number().over(w) - 1))
    starts = edges(scanned, key, 2, n=F.count("*")).select(*key, F.explode(F.transform("e", lambda x, i: F.struct(x[RANGE].alias(RANGE), total(before(F.col("e"), i), lambda y: y["n"]).alias("__start")))).alias("s")).select(*key, "s.*")
    return joined(scanned, starts, [RANGE, *key], small=True).withColumn(name, F.col("__place") + F.coalesce("__start", F.lit(0))).drop(RANGE, "__place", "__start")


def neighbours(rows: DataFrame, key: list[str], order: list[Column | str], mark: Column, ranges: int | None = None) -> DataFrame:
    """Adds n (place from 0), prev and next (the nearest marked rows before and behind), first, last and n_marked of the key.

    mark is a struct, null where a row is not marked; prev, next, first and last have its fields behind n.
    """
    group = Window.partitionBy(RANGE, *key)
    w = group.orderBy(*order)
    scanned = dealt(rows, key, order, ranges).withColumn("__n", F.row_number().over(w) - 1).withColumn("__mark", mark)
    fields = [f.name for f in scanned.schema["__mark"].dataType.fields]
    scanned = scanned.withColumn("__m", F.when(F.col("__mark").isNotNull(), F.struct(F.col("__n").cast("long").alias("n"), *[F.col(f"__mark.{f}").alias(f) for f in fields])))
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), group.orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)
    scanned = saved(scanned.withColumns({"__prev": F.last("__m", ignorenulls=True).over(up), "__next": F.last("__m", ignorenulls=True).over(down)}))
    moved = lambda m, by: F.when(m.isNotNull(), F.struct((m["n"] + by).alias("n"), *[m[f].alias(f) for f in fields]))
    every = edges(scanned, key, rows=F.count("*"), low=F.min("__m"), high=F.max("__m"), marked=F.count("__m"))
    start = F.transform("e", lambda x, i: F.struct(x[RANGE].alias(RANGE), total(before(F.col("e"), i), lambda y: y["rows"]).alias("start"), x["low"].alias("low"), x["high"].alias("high"), x["marked"].alias("marked")))
    whole = F.transform("e", lambda x: F.struct(x[RANGE].alias(RANGE), x["start"].alias("start"), moved(x["low"], x["start"]).alias("low"), moved(x["high"], x["start"]).alias("high"), x["marked"].alias("marked")))
    of = lambda e, what: F.filter(F.transform(e, lambda x: x[what]), lambda x: x.isNotNull())
    least, most = lambda e: F.get(of(e, "low"), F.lit(0)), lambda e: F.try_element_at(of(e, "high"), F.lit(-1))
    known = every.withColumn("e", start).withColumn("e", whole).select(*key, least(F.col("e")).alias("first"), most(F.col("e")).alias("last"), total(F.col("e"), lambda x: x["marked"]).alias("n_marked"), F.explode(
        F.transform("e", lambda x, i: F.struct(x[RANGE].alias(RANGE), x["start"].alias("__start"), most(before(F.col("e"), i)).alias("__before"), least(behind(F.col("e"), i)).alias("__behind")))).alias("s"))
    out = joined(scanned, known.select(*key, "first", "last", "n_marked", "s.*"), [RANGE, *key])
    out = out.withColumns({"n": F.col("__n") + F.col("__start"), "prev": F.coalesce(moved(F.col("__prev"), F.col("__start")), "__before"), "next": F.coalesce(moved(F.col("__next"), F.col("__start")), "__behind")})
    return out.drop(RANGE, "__n", "__m", "__mark", "__prev", "__next", "__start", "__before", "__behind")
