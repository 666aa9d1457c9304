"""Joins of points and intervals of days. Keys of few intervals meet by the key alone, with a test of the days: each row is
shuffled once. Keys of many intervals meet by nested bins: equi-joins only, and no interval meets a point twice.

Days are counted from the one before the first of either side. A bin of level l holds 2^l days. An interval is cut into the largest bins
that fit, at most two of a level, so a century is a few bins just as a week is; a point lies in one bin of each level.
A point lies in an interval exactly if one of its bins is one of the interval's, and then exactly one is: the join on key,
level and bin is the answer, without a test of what is found and without anything to make distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.sources.tables import written

MOST = 100  # intervals of a key that meets by the key alone


def days_of(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def cover(start: Column, end: Column, levels: int) -> Column:
    """Array of (level, bin) of the days start to end - 1, counted from 0."""

    def of(level: Column) -> Column:
        size = days_of(level)
        lo, hi = F.ceil(start / size), F.floor(end / size)
        part = lambda keep, at: F.when((lo < hi) & keep, F.struct(level.cast("int").alias("level"), at.cast("long").alias("bin")))
        return F.filter(F.array(part(lo % 2 == 1, lo), part(hi % 2 == 1, hi - 1)), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def bins_of(day: Column, levels: int) -> Column:
    """Array of (level, bin), one for each level, of a day counted from 0."""
    bin_at = lambda level: F.floor(day / days_of(level)).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.cast("int").alias("level"), bin_at(level).alias("bin")))


def _days(frames: list[tuple[DataFrame, list[str]]]) -> tuple[int, int]:
    """A day (since 1970) before the first one, where open starts lie, and levels that the named date columns need."""
    ends = [df.agg(F.min(F.least(*map(F.unix_date, c)) if len(c) > 1 else F.unix_date(c[0])).alias("lo"), F.max(F.greatest(*map(F.unix_date, c)) if len(c) > 1 else F.unix_date(c[0])).alias("hi")) for df, c in frames]
    lo, hi = reduce(DataFrame.unionByName, ends).agg(F.min("lo"), F.max("hi")).first()
    return (lo or 0) - 1, max(1, ((hi or 0) - (lo or 0) + 3).bit_length())


def _bounded(df: DataFrame, span: tuple[str, str], first: int, levels: int) -> DataFrame:
    """df with _s and _e, days counted from 0; null ends are open, what is empty goes."""
    out = df.withColumns({"_s": F.coalesce(F.unix_date(span[0]) - first, F.lit(0)).cast("long"), "_e": F.coalesce(F.unix_date(span[1]) - first, F.lit(2**levels)).cast("long")})
    return out.where("_s < _e")


def _stab(points: DataFrame, day: str, spans: DataFrame, lo: Column, hi: Column, on: list[str], levels: int) -> DataFrame:
    """points (on, _p) and spans (on, _q) in one row each, where the day lies in lo to hi - 1."""
    p = points.select(*on, "_p", F.inline(bins_of(F.col(day), levels)))
    q = spans.where(lo < hi).select(*on, "_q", F.inline(cover(lo, hi, levels)))
    return p.join(q.hint("merge"), [*on, "level", "bin"]).select(*on, "_p", "_q")  # the estimate of a size doesn't know of the bins


def _pack(df: DataFrame, name: str) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def _unpack(pairs: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return pairs.select(*(F.col(f"_l.`{c}`").alias(c) for c in left.columns), *(F.col(f"_r.`{c}`").alias(c) for c in right.columns if c not in on))


def _open(test: Column) -> Column:
    """test, or true where an end is null."""
    return F.coalesce(test, F.lit(True))


def _by_key(left: DataFrame, right: DataFrame, on: list[str], test: Column, by_bins, most: int) -> DataFrame:
    """left and right of equal keys where test holds: by_bins(left, right) of the keys that have more than `most` rows of right.

    Neither side is broadcast, however small its files are.
    """
    many = right.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*on)
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    plain = lambda a, b: a.join(b.hint("merge"), on).where(test).select(*columns)
    if many.isEmpty():
        return plain(left, right)
    many = written(many, "intervals")
    of = lambda how: (left.join(many, on, how), right.join(many, on, how))
    return plain(*of("left_anti")).unionByName(by_bins(*of("left_semi")).select(*columns))


def stab_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, span: tuple[str, str], most: int = MOST) -> DataFrame:
    """points with each interval of the same key (columns on) that is valid at their date; the end is exclusive, null ends are
    open. Points without a date meet nothing. Other columns of the two have different names."""
    day, start, end = (F.unix_date(c) for c in (at, *span))
    return _by_key(points.where(F.col(at).isNotNull()), intervals, on, _open(start <= day) & _open(day < end), lambda p, q: _stab_bins(p, q, on, at, span), most)


def _stab_bins(points: DataFrame, intervals: DataFrame, on: list[str], at: str, span: tuple[str, str]) -> DataFrame:
    first, levels = _days([(points, [at]), (intervals, list(span))])
    p = points.select(*on, _pack(points, "_p"), (F.unix_date(at) - first).cast("long").alias("_d"))
    q = _bounded(intervals.select(*on, _pack(intervals, "_q"), *span), span, first, levels)
    pairs = _stab(p, "_d", q, F.col("_s"), F.col("_e"), on, levels)
    return _unpack(pairs.withColumnsRenamed({"_p": "_l", "_q": "_r"}), points, intervals, on)


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], most: int = MOST) -> DataFrame:
    """Pairs of the same key whose intervals share a day; null ends are open, and what is empty meets nothing."""
    (a, b), (c, d) = ((F.unix_date(x) for x in span) for span in (left_span, right_span))
    test = _open(a < b) & _open(c < d) & _open(a < d) & _open(c < b)
    return _by_key(left, right, on, test, lambda x, y: _overlap_bins(x, y, on, left_span, right_span), most)


def _overlap_bins(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Two intervals share a day if the right one starts within the left one, or the left one within the right one after its
    first day, and never both; each is a join of points and intervals."""
    first, levels = _days([(left, list(left_span)), (right, list(right_span))])
    a = _bounded(left.select(*on, _pack(left, "_l"), *left_span), left_span, first, levels)
    b = _bounded(right.select(*on, _pack(right, "_r"), *right_span), right_span, first, levels)
    s, e = F.col("_s"), F.col("_e")
    inside = _stab(b.withColumnRenamed("_r", "_p"), "_s", a.withColumnRenamed("_l", "_q"), s, e, on, levels).select(F.col("_q").alias("_l"), F.col("_p").alias("_r"))
    after = _stab(a.withColumnRenamed("_l", "_p"), "_s", b.withColumnRenamed("_r", "_q"), s + 1, e, on, levels).select(F.col("_p").alias("_l"), F.col("_q").alias("_r"))
    return _unpack(inside.unionByName(after), left, right, on)
