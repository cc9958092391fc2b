"""The three top-3 lists of the home page. Each is a distributed top-k, ties by id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions import formatting as fmt

TOP = 3


def project_dates(projects: DataFrame) -> DataFrame:
    """Every project with its date as text: `date`, else the older documents' `due`, else that there is none."""
    dates = [F.col(c) for c in ("date", "due") if c in projects.columns]
    return projects.withColumn("formatted_date", fmt.short_date(*dates))


def home_projects(projects: DataFrame) -> DataFrame:
    """Earliest projects; documents without a date are not listed."""
    return project_dates(projects.where(F.col("date").isNotNull()).orderBy("date", "id").limit(TOP))


def home_renewals(renewals: DataFrame) -> DataFrame:
    """Earliest renewals by due date."""
    first = renewals.where(F.col("due").isNotNull()).orderBy("due", "id").limit(TOP)
    return first.withColumns(
        {
            "formatted_date": fmt.short_date(F.col("due")),
            "formatted_amount": fmt.money(F.col("amount")),
        }
    )


def home_trends(trending: DataFrame) -> DataFrame:
    """Latest trend values."""
    latest = trending.where(F.col("date").isNotNull()).orderBy(F.desc("date"), "id").limit(TOP)
    return latest.withColumns(
        {
            "formatted_date": fmt.short_date(F.col("date")),
            "change": fmt.percent(F.col("value")),
        }
    )
