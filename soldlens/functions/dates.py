"""Sold dates in five languages, and period keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from soldlens.functions.text import bind, clean_text

#: Month names in English, German, French, Italian and Spanish, January first.
MONTH_NAMES = (
    "jan january januar janv janvier gen gennaio ene enero",
    "feb february februar févr fevr février febbraio febrero",
    "mar march mär märz maerz mars marzo",
    "apr april avr avril aprile abr abril",
    "may mai mag maggio mayo",
    "jun june juni juin giu giugno junio",
    "jul july juli juil juillet lug luglio julio",
    "aug august août aout ago agosto",
    "sep sept september septembre set settembre septiembre",
    "oct october okt oktober octobre ott ottobre octubre",
    "nov november novembre noviembre",
    "dec december dez dezember déc décembre dic dicembre diciembre",
)
MONTHS = {name: i for i, names in enumerate(MONTH_NAMES, 1) for name in names.split()}
#: Marks that a reader of pixels takes for a one beside a digit.
ONES = r"[\]|!]"


def make_date(year: Column, month: Column, day: Column, today: Column) -> Column:
    """A date from strings or numbers; two-digit years are 20xx, a missing one is the latest not after today; null if invalid."""
    num = lambda c: F.when(c.cast("string") != "", c.cast("string")).try_cast("int")
    y, m, d = num(year), num(month), num(day)
    date = lambda at: F.try_to_date(F.format_string("%04d-%02d-%02d", at, m, d), "yyyy-MM-dd")
    this = date(F.year(today))
    missing = F.when(this <= today, this).when(this.isNotNull(), date(F.year(today) - 1))
    return F.when(m.isNull() | d.isNull(), None).when(y.isNull(), missing).otherwise(date(F.when(y < 100, y + 2000).otherwise(y)))


def parse_sold_date(c: Column, today: Column | None = None, day_first: Column | bool = False) -> Column:
    """The date in a text such as "Sold Apr 3, 2026", "3. April 2026" or "03/04/2026"; null without one.

    The text is read as words and numbers: beside the first month's name stand the day, before it or else after it, and the year.
    """
    today = F.current_date() if today is None else today
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    months = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MONTHS.items()))
    is_day = lambda t: F.coalesce(t.rlike("^[0-9]{1,2}$"), F.lit(False))
    is_year = lambda t: F.coalesce(t.rlike("^[0-9]{4}$"), F.lit(False))
    # "sold" may run into the word that follows it
    month_of = lambda t: F.try_element_at(months, F.when(t.startswith("sold"), F.substring(t, 5, 40)).otherwise(t))

    def named(tokens: Column) -> Column:
        known = F.transform(tokens, month_of)
        first = F.array_position(F.transform(known, lambda m: m.isNotNull()), True).cast("int")

        def around(i: Column) -> Column:
            token = lambda k: F.when(i + k >= 1, F.get(tokens, i + k - 1))
            suffixed = token(2).isin("st", "nd", "rd", "th")
            after = F.when(suffixed, token(3)).otherwise(token(2))
            year_behind = F.when(is_year(token(1)) | is_day(token(1)), token(1))
            month = F.get(known, i - 1).cast("string")
            by_day = make_date(year_behind, month, token(-1), today)
            by_month = make_date(F.when(is_year(after), after), month, F.when(is_day(token(1)), token(1)), today)
            return F.when(i > 0, F.when(is_day(token(-1)), by_day).otherwise(by_month))

        return F.struct((first > 0).alias("named"), bind(first, around).alias("date"))

    def numeric(parts: Column) -> Column:
        a, b, year = (F.get(parts, F.lit(i)) for i in range(3))
        ok = (F.size(parts) == 3) & is_day(b) & (is_year(year) | year.rlike("^[0-9]{2}$"))
        return F.when(ok, make_date(year, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b), today))

    def read(text: Column) -> Column:
        by_name = bind(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[0-9]+"), F.lit(0)), named)
        by_number = bind(F.split(F.regexp_extract(text, r"(?<![0-9])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", 0), "[./-]"), numeric)
        return bind(by_name, lambda n: F.when(n["named"] & n["date"].isNotNull(), n["date"]).when(~n["named"], by_number))

    ones = F.regexp_replace(F.regexp_replace(clean_text(c), f"([0-9]){ONES}", "$11"), f"{ONES}([0-9])", "1$1")
    return bind(ones, read)


def period_key(day: Column, period: str) -> Column:
    """day 2026-04-01, week 2026-W14 (ISO), month 2026-04."""
    if period == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if period == "week":
        return F.when(day.isNotNull(), F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day)))
    if period == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError(f"period must be day, week or month, not {period!r}")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
