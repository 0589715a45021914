"""Timeline: gap sessions, folders to sessions, ambiguous folder digits, interpolation between anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.timeparts import micros_between
from datelode.operators import ordered

GAP_HOURS = 6
ANCHOR = 0.6
_HOUR = 3_600_000_000


def sessionize(rows: DataFrame, time: str, key: list[str], tie: str, gap_hours: float = GAP_HOURS) -> DataFrame:
    """Adds session_idx, from 0 in each key: a new session begins where the gap to the row before is larger than gap_hours."""
    w = Window.partitionBy(*key).orderBy(time, tie)
    gap = micros_between(F.lag(time).over(w), F.col(time))
    new = F.when(gap > int(gap_hours * _HOUR), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("__new", new).withColumn("session_idx", F.sum("__new").over(w).cast("int")).drop("__new")


def anchors(items: DataFrame, least: float = ANCHOR) -> DataFrame:
    return items.where(F.col("final_datetime").isNotNull() & (F.col("confidence") >= least))


def session_stats(anchored: DataFrame, key: list[str]) -> DataFrame:
    """One row a session: time range, anchors, years, duration, and the folder of its first anchor."""
    return anchored.groupBy(*key, "session_idx").agg(
        F.min("final_datetime").alias("time_start"),
        F.max("final_datetime").alias("time_end"),
        F.count("*").alias("n_anchors"),
        F.sort_array(F.collect_set(F.year("final_datetime"))).alias("year_candidates"),
        F.min_by(paths.folder(F.col("relpath")), F.struct("final_datetime", "item_id")).alias("first_folder"),
    )


def _prefixes(folder: Column) -> Column:
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def assign_floating(floating: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """item_id, key, session_idx: the session whose first folder shares the longest prefix; ties and no match: the lowest.

    Prefixes are joined by equality, one row for each (key, prefix) on the session side, so neither side is
    ever compared in full.
    """
    known = stats.select(*key, "session_idx", F.explode(_prefixes(F.col("first_folder"))).alias("prefix")).groupBy(*key, "prefix").agg(F.min("session_idx").alias("idx"))
    mine = floating.select("item_id", *key, F.posexplode(_prefixes(paths.folder(F.col("relpath")))).alias("depth", "prefix"))
    best = mine.join(known, [*key, "prefix"], "left").groupBy("item_id", *key).agg(F.max_by("idx", F.when(F.col("idx").isNotNull(), F.col("depth"))).alias("idx"))
    return best.select("item_id", *key, F.coalesce("idx", F.lit(0)).alias("session_idx"))


def build_sessions(items: DataFrame, key: list[str], gap_hours: float = GAP_HOURS, least: float = ANCHOR) -> DataFrame:
    """item_id, key, session_idx, is_anchor for every item(item_id, key, relpath, final_datetime, confidence).

    An empty key makes sessions of the whole album, by ranges of time.
    """
    cut = sessionize if key else ordered.sessions
    anchored = cut(anchors(items, least), "final_datetime", key, "item_id", gap_hours)
    rest = items.where(F.col("final_datetime").isNull() | (F.col("confidence") < least))
    floating = assign_floating(rest, session_stats(anchored, key), key)
    return anchored.select("item_id", *key, "session_idx", F.lit(True).alias("is_anchor")).unionByName(floating.withColumn("is_anchor", F.lit(False)))


def session_folders(members: DataFrame, key: list[str]) -> DataFrame:
    """The deepest folder that all members(key, session_idx, relpath) share: the common prefix of the least and greatest."""
    parts = F.split(paths.folder(F.col("relpath")), "/")
    ends = members.groupBy(*key, "session_idx").agg(F.min(parts).alias("a"), F.max(parts).alias("b"), F.count("*").alias("n_items"))
    return ends.select(*key, "session_idx", "n_items", F.array_join(paths.common_prefix(F.col("a"), F.col("b")), "/").alias("folder_path"))


def session_summary(members: DataFrame, key: list[str], threshold: float = ANCHOR) -> DataFrame:
    """key, session_idx, n_items, n_unresolved, n_weak, seconds, has_anchor for members(key, session_idx, is_anchor, final_datetime, confidence)."""
    at = F.when(F.col("is_anchor"), F.col("final_datetime"))
    return members.groupBy(*key, "session_idx").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("final_datetime").isNull()).alias("n_unresolved"),
        F.count_if(F.col("final_datetime").isNotNull() & (F.col("confidence") < threshold)).alias("n_weak"),
        F.coalesce(micros_between(F.min(at), F.max(at)) / 1e6, F.lit(0.0)).alias("seconds"),
        F.max("is_anchor").alias("has_anchor"),
    )


# -- ambiguous digits in folder names ---------------------------------------------------------------

PLACEHOLDER_YEAR = 2000
BASE, CONSENSUS = 0.50, 0.30


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))


def digit_candidates(text: Column) -> Column:
    """Dates that 2 to 7 digits of a name may mean (array, distinct, in order of the schemes)."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    s = F.array_join(runs, "")
    n = F.length(s)
    at = lambda a, k: F.substring(s, a, k).try_cast("int")
    full = lambda yy: F.when(yy <= 30, 2000 + yy).otherwise(1900 + yy)
    year = F.when(at(1, 4).between(1900, 2100), at(1, 4))
    one, two = F.size(runs) == 1, F.size(runs) == 2
    pair = two & (F.length(F.get(runs, F.lit(0))) == 2) & (F.length(F.get(runs, F.lit(1))) == 2)
    placeholder, first = F.lit(PLACEHOLDER_YEAR), F.lit(1)
    options = F.array(
        F.when(n == 6, _date(year, at(5, 2), first)),
        F.when(n == 4, _date(year, first, first)),
        F.when(one & (n == 6), _date(full(at(1, 2)), at(3, 2), at(5, 2))),
        F.when(one & (n == 4), _date(placeholder, at(1, 2), at(3, 2))),
        F.when(one & (n == 4), _date(full(at(1, 2)), at(3, 2), first)),
        F.when(pair, _date(placeholder, at(1, 2), at(3, 2))),
        F.when(pair, _date(placeholder, at(3, 2), at(1, 2))),
    )
    return F.when(n.between(2, 7), F.array_distinct(F.filter(options, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<timestamp_ntz>"))


def folder_tokens(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """item_id, folder_text, depth (0: nearest), candidates for folders that no folder evidence covers."""
    parts = F.reverse(F.slice(F.split("relpath", "/"), F.lit(1), F.size(F.split("relpath", "/")) - 1))
    names = items.where(~F.col("unsupported")).select("item_id", F.posexplode(parts).alias("depth", "folder_text"))
    covered = evidence.where("source = 'foldername'").select("item_id", F.col("folder_name").alias("folder_text")).distinct()
    open_ = names.join(covered, ["item_id", "folder_text"], "left_anti")
    return open_.withColumn("candidates", digit_candidates(F.col("folder_text"))).where(F.size("candidates") > 0)


def disambiguate(tokens: DataFrame) -> DataFrame:
    """Resolves tokens(folder_text, depth, candidates, year_candidates, time_start, time_end, n_anchors).

    Year filter, month filter (+-1 month of the session's ends), filling of the placeholder year, then
    one date or what the dates agree on. Filters never empty the list.
    """
    years = F.coalesce("year_candidates", F.array().cast("array<int>"))
    by_year = F.filter("candidates", lambda d: (F.year(d) == PLACEHOLDER_YEAR) | F.array_contains(years, F.year(d)))
    has_ends = F.col("time_start").isNotNull()
    months = F.flatten(F.transform(F.array(F.month("time_start"), F.month("time_end")), lambda m: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(m - 1 + k, F.lit(12)) + 1)))
    t = tokens.withColumn("c1", F.when((F.size(years) > 0) & (F.size(by_year) > 0), by_year).otherwise(F.col("candidates")))
    by_month = F.filter("c1", lambda d: (F.year(d) == PLACEHOLDER_YEAR) | F.array_contains(months, F.month(d)))
    t = t.withColumn("c2", F.when((F.size("c1") > 1) & has_ends & (F.size(by_month) > 0), by_month).otherwise(F.col("c1")))
    filled = F.transform("c2", lambda d: F.when(F.year(d) == PLACEHOLDER_YEAR, F.coalesce(_date(F.get(years, F.lit(0)), F.month(d), F.dayofmonth(d)), d)).otherwise(d))
    t = t.withColumn("c3", F.when(F.size(years) > 0, F.array_distinct(filled)).otherwise(F.col("c2")))
    same = lambda part: F.size(F.array_distinct(F.transform("c3", part))) == 1
    first = F.get("c3", F.lit(0))
    digits = F.length(F.regexp_replace("folder_text", "[^0-9]", ""))
    exact = F.size("c3") == 1
    y, m, d = same(F.year), same(F.month), same(F.dayofmonth)
    shown = F.when(digits >= 6, F.lit("day")).when(digits == 4, F.when(F.dayofmonth(first) > 1, F.lit("day")).otherwise(F.lit("month"))).otherwise(F.lit("year"))
    was_placeholder = F.exists("candidates", lambda x: F.year(x) == PLACEHOLDER_YEAR)
    precision = F.when(exact, F.when(was_placeholder, F.lit("day")).otherwise(shown)).when(y & m & d, F.lit("day")).when(y & m, F.lit("month")).when(y, F.lit("year"))
    dt = F.when(exact | (y & m & d), first).when(y & m, F.date_trunc("MONTH", first).cast("timestamp_ntz")).when(y, F.date_trunc("YEAR", first).cast("timestamp_ntz"))
    points = F.when(exact, F.lit(BASE)).otherwise(F.lit(CONSENSUS)) + F.when(F.size("c1") < F.size("candidates"), F.lit(0.10)).otherwise(F.lit(0.0)) + F.when(F.size("c2") < F.size("c1"), F.lit(0.10)).otherwise(F.lit(0.0))
    points = points + F.least(0.05 * F.coalesce("n_anchors", F.lit(0)), F.lit(0.20)) - 0.10 * F.col("depth")
    confidence = F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.85), points)), 3)
    return t.select(*tokens.columns, dt.alias("dt"), precision.alias("precision"), confidence.alias("struct_confidence")).where("dt IS NOT NULL AND struct_confidence >= 0.25")


# -- interpolation ----------------------------------------------------------------------------------


def _lined_up(members: DataFrame, session: list[str]) -> DataFrame:
    return members.select(*session, "item_id", "is_anchor", paths.folder(F.col("relpath")).alias("folder"), paths.tail_number(F.col("stem")).alias("tail"), F.when(F.col("is_anchor"), F.col("final_datetime")).alias("t"), F.when(F.col("is_anchor"), F.col("confidence")).alias("c"), F.when(F.col("is_anchor"), F.col("final_datetime")).otherwise(F.col("mtime")).alias("by_time"))


_ORDER = [F.desc, "with_anchor"], [F.asc, "folder"], [F.asc, "tail"], [F.desc, "is_anchor"], [F.asc, "by_time"], [F.asc, "item_id"]


def interpolate(members: DataFrame, key: list[str]) -> DataFrame:
    """Evidence between and beside anchors: item_id, dt, precision, confidence, mode.

    members(item_id, key, session_idx, is_anchor, relpath, stem, final_datetime, confidence, mtime): items of
    a session stand in order of folder (those with anchors first), tail number, anchors first, time. With
    two anchors or more, positions are stretched to the seconds between the first and the last; where the
    last is earlier, order and positions run against each other, and the neighbours are the outermost ones.
    A session is sorted in one task; interpolate_wide() has no such bound.
    """
    session = [*key, "session_idx"]
    in_folder = Window.partitionBy(*session, "folder")
    whole = Window.partitionBy(*session)
    order = whole.orderBy(*[way(c) for way, c in _ORDER])
    rows = _lined_up(members, session).withColumn("with_anchor", F.max("is_anchor").over(in_folder)).withColumn("n", F.row_number().over(order) - 1)
    here = F.when(F.col("is_anchor"), F.struct(F.col("n").alias("n"), F.col("t").alias("t"), F.col("c").alias("c"), F.col("folder").alias("folder")))
    rows = rows.withColumn("a", here)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*session).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # the same order backwards: a running frame, linear in the session
    rows = rows.withColumns({
        "prev": F.last("a", ignorenulls=True).over(before), "next": F.last("a", ignorenulls=True).over(after),
        "first": F.min("a").over(whole), "last": F.max("a").over(whole), "n_anchors": F.count("a").over(whole), "t0": F.min("t").over(whole), "t1": F.max("t").over(whole),
    })
    return _estimates(rows)


def interpolate_wide(members: DataFrame, key: list[str], ranges: int | None = None) -> DataFrame:
    """interpolate() for sessions of any size: each is dealt over ranges of its order, the last and the next anchor are carried over their edges."""
    session = [*key, "session_idx"]
    rows = _lined_up(members, session)
    marked = rows.groupBy(*session, "folder").agg(F.max("is_anchor").alias("with_anchor"))
    rows = ordered.joined(rows, marked, [*session, "folder"])
    mark = F.when(F.col("is_anchor"), F.struct("t", "c", "folder"))
    rows = ordered.neighbours(rows, session, [way(c) for way, c in _ORDER], mark, ranges)
    ends = rows.where("is_anchor").groupBy(*session).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return _estimates(ordered.joined(rows.where("NOT is_anchor"), ends, session).withColumnRenamed("n_marked", "n_anchors"))


def _estimates(rows: DataFrame) -> DataFrame:
    seconds = lambda a, b: micros_between(a, b) / 1e6
    p, length = (F.col("last.n") - F.col("first.n")).cast("double"), seconds(F.col("first.t"), F.col("last.t"))
    rows = rows.where("n_anchors > 0 AND NOT is_anchor").withColumn("scale", F.when((F.col("n_anchors") > 1) & (p != 0) & (length != 0), length / p))
    back = F.coalesce(F.col("scale") < 0, F.lit(False))
    rows = rows.withColumns({
        "l": F.when(back, F.when(F.col("last.n") > F.col("n"), F.col("last"))).otherwise(F.col("prev")),
        "r": F.when(back, F.when(F.col("first.n") < F.col("n"), F.col("first"))).otherwise(F.col("next")),
    })
    pos = lambda n: F.coalesce((n - F.col("first.n")) * F.col("scale"), n.cast("double"))
    x, pl, pr = pos(F.col("n")), pos(F.col("l.n")), pos(F.col("r.n"))
    span = pr - pl
    gap = micros_between(F.col("l.t"), F.col("r.t"))
    inner_dt = F.timestamp_add("MICROSECOND", F.round(gap * ((x - pl) / span)).cast("bigint"), F.col("l.t"))
    same = F.when((F.col("folder") == F.col("l.folder")) | (F.col("folder") == F.col("r.folder")), F.lit(0.10)).otherwise(F.lit(0.0))
    clamp = lambda v, high: F.round(F.greatest(F.lit(0.10), F.least(F.lit(high), v)), 3)
    inner_c = F.least("l.c", "r.c") * (1 - 0.6 * F.greatest(x - pl, pr - x) / span) + same
    per = F.abs(gap / 1e6) / span
    inner_p = F.when(per < 3600, F.lit("minute")).when(per < 86400, F.lit("hour")).otherwise(F.lit("day"))
    one = F.coalesce("l", "r")
    average = F.when(F.col("n_anchors") > 1, seconds(F.col("t0"), F.col("t1")) / (F.col("n_anchors") - 1)).otherwise(F.lit(60.0))
    steps = F.abs(x - pos(one["n"])) / F.when(average == 0, F.lit(1.0)).otherwise(average)
    outer_c = one["c"] - 0.08 * steps + F.when(F.col("folder") == one["folder"], F.lit(0.10)).otherwise(F.lit(0.0))
    inner = F.col("l").isNotNull() & F.col("r").isNotNull()
    return rows.select(
        "item_id",
        F.when(inner, inner_dt).otherwise(one["t"]).alias("dt"),
        F.when(inner, inner_p).otherwise(F.lit("day")).alias("precision"),
        F.when(inner, clamp(inner_c, 0.85)).otherwise(clamp(outer_c, 0.60)).alias("confidence"),
        F.when(inner, F.lit("inner")).otherwise(F.lit("outer")).alias("mode"),
    )
