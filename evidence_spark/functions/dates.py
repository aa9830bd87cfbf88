"""Date expressions: tolerant parsing, age bands, date mentions and their granularity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_spark.functions.text import _col, fold
from evidence_spark.lexicons import MONTHS_PT, WEEKDAYS_PT

MONTHS_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_ISO = (r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2})?(?:\.[0-9]+)?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?")
_RFC = (r"^\s*(?:[A-Za-z]{3},\s*)?([0-9]{1,2})\s+([A-Z][a-z]{2})\s+([0-9]{4})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})\s*"
        r"(?:GMT|UTC|Z|([+-][0-9]{4}))?\s*$")


def _minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(zone.startswith("-"), -minutes).otherwise(F.coalesce(minutes, F.lit(0)))


def _at(day: Column, clock: Column, zone: Column) -> Column:
    local = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.timestamp_seconds(F.unix_timestamp(local) - _minutes(zone) * 60)


def parse_timestamp(c) -> Column:
    """ISO-8601 with optional time and zone, or RFC-822; null when neither fits. UTC."""
    text = _col(c)
    iso = lambda i: F.regexp_extract(text, _ISO, i)
    clock = F.concat(F.when(iso(2) == "", F.lit("00:00")).otherwise(iso(2)),
                     F.when(iso(3) == "", F.lit(":00")).otherwise(iso(3)))
    rfc = lambda i: F.regexp_extract(text, _RFC, i)
    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS_ABBR]), rfc(2)).cast("string"), 2, "0")
    day = F.concat_ws("-", rfc(3), month, F.lpad(rfc(1), 2, "0"))
    return F.when(text.rlike(_ISO), _at(iso(1), clock, iso(4))).when(text.rlike(_RFC), _at(day, rfc(4), rfc(5)))


def parse_ddmmyyyy(c) -> Column:
    """First dd/mm/yyyy in the text as a date; null when absent or impossible."""
    return F.try_to_date(F.regexp_extract(_col(c), r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")


def age_band(days) -> Column:
    """The undated band is explicit: dropping nulls silently would hide a third of the sources."""
    d = _col(days)
    return (F.when(d.isNull(), F.lit("sem data")).when(d <= 1, F.lit("mesmo dia ou véspera"))
            .when(d <= 30, F.lit("2 a 30 dias")).otherwise(F.lit("mais de um mês")))


def period_of(published, now, recent_days: int = 30) -> Column:
    p, n = _col(published), _col(now)
    return (F.when(p.isNull(), F.lit("sem_data"))
            .when(F.unix_timestamp(n) - F.unix_timestamp(p) <= recent_days * 86400, F.lit("recente"))
            .otherwise(F.lit("anterior")))


def padded_fold(text) -> Column:
    """Folded text between spaces: compute it as a column once, ``fact_date`` reads it many times."""
    return F.concat(F.lit(" "), fold(text), F.lit(" "))


def fact_date(folded, published, months: dict[str, int] | None = None, coarse: bool = False) -> Column:
    """Date of the fact cited in a text, resolved against the publication date: struct(day DATE, granularity).

    Order: day/month[/year]; day of month[ of year] in words; weekday (the day in brackets behind it, or else the last one
    on or before publication); relative words; month + year; and, when ``coarse``, month alone or ``em <year>``. ``folded`` is a column made by ``padded_fold``.
    """
    months = months or MONTHS_PT
    t = _col(folded)
    pub = F.to_date(_col(published))
    names = "|".join(months)
    dm = r"(?<![0-9/])([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{2,4}))?(?![0-9/])"
    d, m, y = (F.regexp_extract(t, dm, i).try_cast("int") for i in (1, 2, 3))
    year = (F.when(y < 100, y + 2000).when(y.isNotNull(), y)
            .when(m > F.month(pub) + 1, F.year(pub) - 1).otherwise(F.year(pub)))
    explicit = F.when(t.rlike(dm) & d.between(1, 31) & m.between(1, 12),
                      F.try_to_date(F.format_string("%04d-%02d-%02d", year, m, d)))
    in_words = r"(?<![0-9/])([0-9]{1,2})(?:o|º)? de (" + names + r")(?![a-z])(?: de ([0-9]{4}))?"
    word_month = _lookup(months, F.regexp_extract(t, in_words, 2))
    word_year = F.coalesce(F.regexp_extract(t, in_words, 3).try_cast("int"), F.when(word_month > F.month(pub) + 1, F.year(pub) - 1).otherwise(F.year(pub)))
    by_words = F.when(t.rlike(in_words), F.try_to_date(F.format_string("%04d-%02d-%02d", word_year, word_month, F.regexp_extract(t, in_words, 1).try_cast("int"))))
    bracket = r"(?<![a-z])(?:" + "|".join(WEEKDAYS_PT) + r")(?:-feira)? \(([0-9]{1,2})\)"
    inside = F.regexp_extract(t, bracket, 1).try_cast("int")
    month_start = F.when(inside > F.dayofmonth(pub), F.add_months(F.trunc(pub, "month"), -1)).otherwise(F.trunc(pub, "month"))
    by_bracket = F.when(t.rlike(bracket) & inside.between(1, 31), F.try_to_date(F.concat(F.date_format(month_start, "yyyy-MM-"), F.lpad(inside.cast("string"), 2, "0"))))
    weekday = F.regexp_extract(t, r"(?<![a-z])(" + "|".join(WEEKDAYS_PT) + r")(?:-feira)?(?![a-z])", 1)
    by_weekday = F.when(weekday != "", _last_weekday(pub, weekday))
    relative = (F.when(t.contains(" anteontem "), F.date_add(pub, -2)).when(t.contains(" amanha "), F.date_add(pub, 1))
                .when(t.contains(" ontem "), F.date_add(pub, -1))
                .when(t.rlike(" (hoje|nesta noite|nesta manha|nesta tarde) "), pub))
    my = r"(?<![a-z])(" + names + r") de ([0-9]{4})"
    mo = r"(?<![a-z])(?:em|de) (" + names + r")(?![a-z])(?! de [0-9]{4})"
    month_of = lambda pattern: _lookup(months, F.regexp_extract(t, pattern, 1))
    month_year = F.when(t.rlike(my), F.make_date(F.regexp_extract(t, my, 2).try_cast("int"), month_of(my), F.lit(1)))
    day_struct = lambda value, grain: F.when(value.isNotNull(), F.struct(value.alias("day"), F.lit(grain).alias("granularity")))
    options = [day_struct(explicit, "dia"), day_struct(by_words, "dia"), day_struct(by_bracket, "dia"), day_struct(by_weekday, "dia"), day_struct(relative, "dia"),
               day_struct(month_year, "mes")]
    if coarse:
        alone = month_of(mo)
        options.append(day_struct(F.when(t.rlike(mo), F.make_date(
            F.when(alone > F.month(pub), F.year(pub) - 1).otherwise(F.year(pub)), alone, F.lit(1))), "mes"))
        iy = r"(?<![a-z])em (19[0-9]{2}|20[0-9]{2})(?![0-9])"
        options.append(day_struct(F.when(t.rlike(iy), F.make_date(
            F.regexp_extract(t, iy, 1).try_cast("int"), F.lit(1), F.lit(1))), "ano"))
    return F.coalesce(*options)


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def _last_weekday(pub: Column, weekday: Column) -> Column:
    """Latest such weekday on or before ``pub``."""
    numbers = {name: i for i, name in enumerate(WEEKDAYS_PT, start=1)}  # dayofweek: Sunday is 1
    return F.date_add(pub, -F.pmod(F.dayofweek(pub) - _lookup(numbers, weekday), F.lit(7)))


def date_gap(a: Column, b: Column) -> Column:
    """Which grain two fact dates disagree on, respecting the coarser of the two; null when compatible."""
    grains = F.array(a["granularity"], b["granularity"])
    year_differs = F.year(a["day"]) != F.year(b["day"])
    month_differs = year_differs | (F.month(a["day"]) != F.month(b["day"]))
    return (F.when(F.array_contains(grains, "ano"), F.when(year_differs, F.lit("ano")))
            .when(F.array_contains(grains, "mes"), F.when(month_differs, F.lit("mes")))
            .otherwise(F.when(F.abs(F.datediff(a["day"], b["day"])) > 1, F.lit("dia"))))
