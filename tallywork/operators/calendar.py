"""Calendar dimension, business days and super contribution settlement."""

from __future__ import annotations

from calendar import isleap
from datetime import date, timedelta
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import financial_year, financial_year_end, financial_year_label, financial_year_start

#: Uplift on an amount paid late, in per cent of shortfall and earnings.
UPLIFT = 60


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day with calendar and Australian financial-year attributes."""
    d = F.col("date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    fq = F.floor(F.pmod(F.month(d) - 7, F.lit(12)) / 3).cast("int") + 1
    return days.select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.dayofmonth(d).alias("day"), F.weekday(d).alias("weekday"), F.date_format(d, "EEEE").alias("day_name"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"),
        financial_year(d).alias("fy"), financial_year_label(d).alias("fy_label"), financial_year_start(d).alias("fy_start"), financial_year_end(d).alias("fy_end"), fq.alias("fy_quarter"), (F.pmod(F.month(d) - 7, F.lit(12)) + 1).alias("fy_month"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def business_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """(date, is_bd, bd_no): bd_no counts business days up to the date. days is a calendar: a bounded table."""
    c = days.select("date").join(holidays.select("date", F.lit(True).alias("h")).distinct(), "date", "left").withColumn("is_bd", (F.weekday("date") < 5) & F.col("h").isNull())
    return c.select("date", "is_bd", F.sum(F.col("is_bd").cast("int")).over(Window.orderBy("date")).alias("bd_no"))


def add_business_days(rows: DataFrame, column: str, n: int, calendar: DataFrame, out: str) -> DataFrame:
    """rows with the n-th business day after `column`; the calendar is broadcast, a row per day."""
    start = calendar.select(F.col("date").alias(column), (F.col("bd_no") + n).alias("__to"))
    end = calendar.where("is_bd").select(F.col("bd_no").alias("__to"), F.col("date").alias(out))
    return rows.join(F.broadcast(start), column, "left").join(F.broadcast(end), "__to", "left").drop("__to")


#: Digits of a limb, limbs behind the point of a growth factor.
LIMB, PLACES = 9, 4


def growth_table(spark: SparkSession, rates: dict[tuple[int, int], str]) -> DataFrame:
    """(date, p0.., q0..): the growth of one unit from the first quarter's start through each day, and its inverse, as limbs of nine digits, the lowest first, with
    36 places. rates: (year, quarter) -> yearly per cent of a day's quarter over the year's days; quarters must follow each other. A row per day: bounded."""
    quarters = sorted(rates)
    if any((y, q) != ((a, b + 1) if b < 4 else (a + 1, 1)) for (a, b), (y, q) in zip(quarters, quarters[1:], strict=False)):
        raise ValueError("rates leave out a quarter")
    (y, q), (z, r) = quarters[0], quarters[-1]
    day, end, one = date(y, q * 3 - 2, 1), date(z + (r == 4), r * 3 % 12 + 1, 1), 10 ** (LIMB * PLACES)
    limbs = lambda n: [n // 10 ** (LIMB * i) % 10**LIMB for i in range(PLACES + 1)]
    grown, rows = one, [(day - timedelta(days=1), *limbs(one), *limbs(one))]
    while day < end:
        rate = Fraction(rates[(day.year, (day.month - 1) // 3 + 1)]) / 100 / (366 if isleap(day.year) else 365)
        grown = round(grown * (1 + rate))
        rows.append((day, *limbs(grown), *limbs(one * one // grown)))
        day += timedelta(days=1)
    names = [f"{k}{i} long" for k in "pq" for i in range(PLACES + 1)]
    return spark.createDataFrame(rows, "date date, " + ", ".join(names))


def notional_earnings(rows: DataFrame, rates: dict[tuple[int, int], str], base: str = "base", due: str = "due", received: str = "received") -> DataFrame:
    """rows with `earnings`: base compounds daily from the day after `due` through `received`, at the yearly per cent of each day's calendar quarter over the year's days, rounded half up to cents.

    A span's growth is the growth through its end times the inverse of that through its start: two rows of growth_table, joined by broadcast, multiplied
    limb by limb in decimals, with 27 places kept. Amounts have at most 18 digits in cents. No span, no earnings; a day without a rate raises.
    """
    days, kept = growth_table(rows.sparkSession, rates), rows.columns
    late = F.coalesce(F.col(received) > F.col(due), F.lit(False)) & F.col(base).isNotNull()
    side = lambda k: F.broadcast(days.select(F.col("date").alias(f"__{k}"), *[F.col(f"{k}{i}").alias(f"__{k}{i}") for i in range(PLACES + 1)]))
    j = rows.withColumns({"__p": F.when(late, F.col(received)), "__q": F.when(late, F.col(due))}).join(side("p"), "__p", "left").join(side("q"), "__q", "left")
    limb, fit = F.lit(10**LIMB).cast("decimal(10,0)"), lambda c: c.cast("decimal(28,0)")
    over = lambda c: F.floor(fit(c) / limb)  # noqa: E731  exact: a quotient has nine places at most
    carry, total = F.lit(0), []
    for k in range(2 * PLACES + 1):  # columns of the long multiplication, each with what the one before carries
        pairs = [fit(F.col(f"__p{i}").cast("decimal(10,0)") * F.col(f"__q{k - i}").cast("decimal(10,0)")) for i in range(PLACES + 1) if 0 <= k - i <= PLACES]
        total.append(fit(sum(pairs[1:], pairs[0]) + carry))
        carry = over(total[-1])
    cents = F.col(base).cast("decimal(18,2)").cast("decimal(20,2)") * 100
    cents, up = cents.cast("decimal(18,0)"), F.lit(0)
    for k in range(PLACES + 1, 2 * PLACES):  # the amount times the three limbs behind the point, and the carry; the last rounds
        up = over(cents * (total[k] - over(total[k]) * limb).cast("decimal(10,0)") + up + (10**LIMB // 2 if k == 2 * PLACES - 1 else 0))
    grown = cents * total[-1].cast("decimal(10,0)") + up
    known = F.when(F.col("__p0").isNull() | F.col("__q0").isNull(), F.raise_error(F.lit("a day has no rate")).cast("decimal(28,0)")).otherwise(fit(grown - cents))
    earned = F.when(late, known).otherwise(F.lit(0).cast("decimal(28,0)"))
    return j.select(*kept, (earned * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("earnings"))


def settle(events: DataFrame, calendar: DataFrame, rates: dict[tuple[int, int], str], days: int = 7) -> DataFrame:
    """Contributions (…, pay_date, amount, received) with due date, state, earnings, uplift and charge: due `days` business days after pay day; late ones carry notional earnings and the uplift on both."""
    d = add_business_days(events, "pay_date", days, calendar, "due")
    state = F.when(F.col("received").isNull(), "UNPAID").when(F.col("received") > F.col("due"), "LATE").otherwise("ON_TIME")
    e = notional_earnings(d.withColumn("state", state), rates, "amount")
    late = F.col("state") == "LATE"
    up = F.when(late, F.round((F.col("amount") + F.col("earnings")) * UPLIFT / 100, 2)).otherwise(0).cast("decimal(18,2)")
    return e.withColumn("uplift", up).withColumn("charge", F.when(late, F.col("amount") + F.col("earnings") + F.col("uplift")).otherwise(0).cast("decimal(18,2)"))
