"""What the cards read."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Source = DataFrame | Callable[[], DataFrame]


class EventModel:
    """The two event tables and the company list (`company`, one row each).

    A table may be given as a function; it is called when a card first needs the table, so
    no other table is listed or planned. Additive measures read the daily sums of a table
    where there are any, and its events where there are none.
    """

    def __init__(
        self, user_events: Source, company_events: Source, companies: Source,
        user_daily: Source | None = None, company_daily: Source | None = None,
    ):
        self._sources = (user_events, company_events, companies, user_daily, company_daily)

    def _load(self, index: int) -> DataFrame | None:
        source = self._sources[index]
        return source() if callable(source) else source

    @cached_property
    def user_events(self) -> DataFrame:
        return self._load(0)

    @cached_property
    def company_events(self) -> DataFrame:
        return self._load(1)

    @cached_property
    def companies(self) -> DataFrame:
        return self._load(2)

    @cached_property
    def user_sums(self) -> DataFrame:
        """The daily sums of the user events, or the events themselves."""
        return self.user_events if self._sources[3] is None else self._load(3)

    @cached_property
    def company_sums(self) -> DataFrame:
        return self.company_events if self._sources[4] is None else self._load(4)

    def only(self, company: str) -> "EventModel":
        """One company by exact name; it need not be in the company list."""
        wanted = F.lit(company)
        return EventModel(
            lambda: self.user_events.where(F.col("company") == wanted),
            lambda: self.company_events.where(F.col("company") == wanted),
            lambda: self.companies.sparkSession.range(1).select(wanted.alias("company")),
            lambda: self.user_sums.where(F.col("company") == wanted),
            lambda: self.company_sums.where(F.col("company") == wanted),
        )
