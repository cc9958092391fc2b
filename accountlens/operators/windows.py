"""Dense daily series: cumulative totals, trailing sums, averages and exact distinct counts.

All of them pre-aggregate events to one row per company and day (combined map-side, so a
company holding most of the rows is one small row per task and day). Windows then run over
at most `2 * (days + width)` rows per company, whatever the number of events.
"""

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlens.functions.dates import as_date, event_day, within_days
from accountlens.operators.spine import calendar_spine

_MASK_BITS = 63


@dataclass(frozen=True)
class Measure:
    """What to add up per company and day.

    Counts the events of `types` (those with a non-null `column`, if one is given) or sums
    `column`. `cumulative` runs over all history up to each day, otherwise over the
    trailing window.
    """

    name: str
    types: tuple[str, ...]
    column: str | None = None
    how: str = "count"
    cumulative: bool = False

    def wanted(self, summed: bool = False) -> Column:
        kind = F.col("type")
        condition = kind == self.types[0] if len(self.types) == 1 else kind.isin(*self.types)
        if self.column is None:
            return condition
        return condition & (F.col(f"n_{self.column}") > 0 if summed else F.col(self.column).isNotNull())

    def total(self, condition: Column, summed: bool = False) -> Column:
        """The total of events, or of rows of daily sums."""
        if summed:
            value = F.col("n" if self.column is None else f"{'sum' if self.how == 'sum' else 'n'}_{self.column}")
            # A count of nothing is 0, a sum NULL, as of the events.
            total = F.sum(F.when(condition, value))
            return (total if self.how == "sum" else F.coalesce(total, F.lit(0))).alias(self.name)
        value = F.col(self.column) if self.how == "sum" else F.lit(1)
        aggregate = F.sum if self.how == "sum" else F.count
        return aggregate(F.when(condition, value)).alias(self.name)


def is_summed(events: DataFrame) -> bool:
    """Whether these are daily sums instead of events."""
    return "n" in events.columns and "timestamp" not in events.columns


def daily_series(
    events: DataFrame,
    companies: DataFrame,
    measures: list[Measure],
    as_of_date: date | str | None = None,
    days: int = 30,
    width: int = 7,
) -> DataFrame:
    """`(company, day, <measure>...)` for every company and spine day, from events or from their daily sums.

    All trailing measures share one scan of the look-back days. All cumulative ones share a
    scan of the whole history, which reads their event types only and folds earlier days
    into the first look-back day. Of daily sums, which are small, one scan gives both.
    """
    last = as_date(as_of_date)
    lookback = last - timedelta(days=days - 1 + width - 1)
    trailing = [m for m in measures if not m.cumulative]
    cumulative = [m for m in measures if m.cumulative]
    day = event_day(events)
    folded = F.greatest(day, F.lit(lookback))
    if trailing and cumulative and is_summed(events):
        parts = [_both_totals(events.where(within_days(events, None, last)), folded, day >= F.lit(lookback), trailing, cumulative)]
    else:
        parts = []
        if trailing:
            parts.append(_daily_totals(events.where(within_days(events, lookback, last)), day, trailing))
        if cumulative:
            parts.append(_daily_totals(events.where(within_days(events, None, last)), folded, cumulative))
    daily = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return dense_series(
        daily, companies, last, days, width, [m.name for m in trailing], [m.name for m in cumulative]
    )


def _daily_totals(events: DataFrame, day: Column, measures: list[Measure]) -> DataFrame:
    summed = is_summed(events)
    wanted = [m.wanted(summed) for m in measures]
    totals = [m.total(w if len(measures) > 1 else F.lit(True), summed) for m, w in zip(measures, wanted)]
    return events.where(reduce(or_, wanted)).groupBy("company", day.alias("day")).agg(*totals)


def _both_totals(sums: DataFrame, day: Column, recent: Column, trailing: list[Measure], cumulative: list[Measure]) -> DataFrame:
    wanted = {m: m.wanted(True) & recent for m in trailing} | {m: m.wanted(True) for m in cumulative}
    totals = [m.total(w, True) for m, w in wanted.items()]
    return sums.where(reduce(or_, wanted.values())).groupBy("company", day.alias("day")).agg(*totals)


def dense_series(
    daily: DataFrame,
    companies: DataFrame,
    last: date,
    days: int,
    width: int,
    trailing: list[str] = (),
    cumulative: list[str] = (),
) -> DataFrame:
    """Window daily totals onto the spine.

    Spine rows enter as zeros next to the daily rows, and range frames include peers of the
    same day, so one shuffle by company replaces a join plus a shuffle.
    """
    names = [*trailing, *cumulative]
    spine = calendar_spine(companies, last, days)
    rows = spine.select("company", "day", *[F.lit(0).alias(n) for n in names], F.lit(True).alias("on_spine"))
    rows = rows.unionByName(daily.select("company", "day", *names, F.lit(False).alias("on_spine")))
    by_day = Window.partitionBy("company").orderBy(F.unix_date("day"))
    frames = {n: by_day.rangeBetween(-(width - 1), Window.currentRow) for n in trailing}
    frames |= {n: by_day.rangeBetween(Window.unboundedPreceding, Window.currentRow) for n in cumulative}
    return rows.select(
        "company", "day", "on_spine", *[F.sum(n).over(frames[n]).alias(n) for n in names]
    ).where("on_spine").drop("on_spine")


def cumulative_to_day(
    events: DataFrame,
    companies: DataFrame,
    name: str,
    types: tuple[str, ...],
    column: str | None = None,
    how: str = "count",
    as_of_date: date | str | None = None,
    days: int = 30,
) -> DataFrame:
    """For each spine day, the total over all events up to that day."""
    measure = Measure(name, types, column, how, cumulative=True)
    return daily_series(events, companies, [measure], as_of_date, days)


def trailing_window(
    events: DataFrame,
    companies: DataFrame,
    name: str,
    types: tuple[str, ...],
    column: str | None = None,
    how: str = "count",
    as_of_date: date | str | None = None,
    days: int = 30,
    width: int = 7,
) -> DataFrame:
    """For each spine day, the total over the `width` calendar days ending there."""
    measure = Measure(name, types, column, how)
    return daily_series(events, companies, [measure], as_of_date, days, width)


def trailing_avg(
    events: DataFrame,
    companies: DataFrame,
    column: str,
    types: tuple[str, ...],
    avg_name: str,
    count_name: str,
    as_of_date: date | str | None = None,
    days: int = 30,
    width: int = 7,
) -> DataFrame:
    """Average and count of non-null values over the trailing window; no values average to NULL."""
    measures = [Measure("_total", types, column, "sum"), Measure(count_name, types, column)]
    series = daily_series(events, companies, measures, as_of_date, days, width)
    return series.select("company", "day", ratio("_total", count_name).alias(avg_name), count_name)


def ratio(total: str, number: str) -> Column:
    return F.when(F.col(number) > 0, F.col(total) / F.col(number))


def trailing_distinct(
    events: DataFrame,
    companies: DataFrame,
    name: str,
    key: str,
    types: tuple[str, ...],
    as_of_date: date | str | None = None,
    days: int = 30,
    width: int = 7,
) -> DataFrame:
    """For each spine day, the exact number of distinct non-null `key` values in the window."""
    last = as_date(as_of_date)
    seen = events.where(
        within_days(events, last - timedelta(days=days - 1 + width - 1), last)
        & F.col("type").isin(*types)
        & F.col(key).isNotNull()
    )
    form = _distinct_by_mask if days + width - 1 <= _MASK_BITS else _distinct_by_change
    return form(seen, companies, name, key, last, days, width)


def _distinct_by_mask(
    seen: DataFrame, companies: DataFrame, name: str, key: str, last: date, days: int, width: int
) -> DataFrame:
    """One bit per day and key: a fixed-size, map-side combined aggregate, one wide shuffle.

    A key is active on a spine day when any bit of that day's window is set, so the counts
    are plain conditional counts over one row per company and key.
    """
    first = last - timedelta(days=days - 1)
    lookback = first - timedelta(days=width - 1)
    slot = F.datediff(event_day(seen), F.lit(lookback))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot)
    masks = seen.groupBy("company", key).agg(F.bit_or(bit).alias("mask"))
    window_bits = (1 << width) - 1
    counts = masks.groupBy("company").agg(
        *[F.expr(f"count(CASE WHEN mask & {window_bits << i}L <> 0 THEN 1 END) AS d{i}") for i in range(days)]
    )
    per_day = F.posexplode(F.array(*[f"d{i}" for i in range(days)])).alias("i", "n")
    return (
        companies.select("company")
        .join(counts, "company", "left")
        .select("company", per_day)
        .select(
            "company",
            F.date_add(F.lit(first), F.col("i")).alias("day"),
            F.coalesce("n", F.lit(0)).alias(name),
        )
    )


def _distinct_by_change(
    seen: DataFrame, companies: DataFrame, name: str, key: str, last: date, days: int, width: int
) -> DataFrame:
    """For spans too long for a mask: +1 when a key becomes active, -1 when it lapses.

    The window is per company and key over distinct days, so its size is bounded by the
    number of days.
    """
    first = last - timedelta(days=days - 1)
    active = seen.select("company", key, event_day(seen).alias("d")).distinct()
    following = F.lead("d").over(Window.partitionBy("company", key).orderBy("d"))
    lapsing = active.withColumn("lapse", F.least(F.date_add("d", width), following))
    changes = lapsing.select(
        "company",
        F.inline(
            F.array(
                F.struct(F.col("d").alias("day"), F.lit(1).alias(name)),
                F.struct(F.col("lapse").alias("day"), F.lit(-1).alias(name)),
            )
        ),
    )
    daily = (
        changes.where(F.col("day") <= F.lit(last))
        .groupBy("company", F.greatest("day", F.lit(first)).alias("day"))
        .agg(F.sum(name).alias(name))
    )
    return dense_series(daily, companies, last, days, width, cumulative=[name])


def at_last_day(*names: str) -> list[Column]:
    """Aggregates giving the values of the last day, NULL and 0 included."""
    return [F.max_by(n, "day").alias(n) for n in names]


def at_last_nonnull(value: str, *names: str) -> list[Column]:
    """Aggregates giving `names` on the last day whose `value` is not NULL."""
    known_day = F.when(F.col(value).isNotNull(), F.col("day"))
    return [F.max_by(n, known_day).alias(n) for n in names]


def headline(series: DataFrame, *names: str) -> DataFrame:
    """Per company, the values of the last day, NULL and 0 included."""
    return series.groupBy("company").agg(*at_last_day(*names))


def headline_last_nonnull(series: DataFrame, value: str, *names: str) -> DataFrame:
    """Per company, `names` on the last day whose `value` is not NULL; NULLs if there is none."""
    return series.groupBy("company").agg(*at_last_nonnull(value, *names))
