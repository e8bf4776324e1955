"""Thresholds and short texts that turn a number into a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import calendar as cal
from .grid import signed_lon

# Index threshold, strength bands, episode length, season names.
INDEX_THRESHOLD = 0.5
STRENGTHS = ((2.0, "very strong"), (1.5, "strong"), (1.0, "moderate"))
EPISODE_SEASONS = 5
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nth(words, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n)


def strength(index) -> Column:
    size = F.abs(_col(index))
    out = F.lit("weak")
    for floor, word in reversed(STRENGTHS):
        out = F.when(size >= floor, word).otherwise(out)
    return F.when(size.isNotNull(), out)


def phase_sign(index) -> Column:
    index = _col(index)
    return F.when(index >= INDEX_THRESHOLD, 1).when(index <= -INDEX_THRESHOLD, -1).otherwise(0)


def phase(index) -> Column:
    sign = phase_sign(index)
    return F.when(sign == 1, "el_nino").when(sign == -1, "la_nina").otherwise("neutral")


def season(middle) -> Column:
    """`JJA 2024`: the three-month season named after its middle month."""
    middle = _col(middle)
    return F.concat_ws(" ", _nth(SEASONS, F.month(middle)), F.year(middle).cast("string"))


def month_name(month) -> Column:
    return _nth(MONTHS, _col(month))


def gap_word(value, normal) -> Column:
    gap = _col(value) - _col(normal)
    return F.when(F.abs(gap) < 0.05, "at").when(gap > 0, "above").when(gap <= 0, "below")


def extent_word(ratio) -> Column:
    ratio = _col(ratio)
    return (
        F.when(ratio.isNull(), "rank").when(ratio >= 1.15, "above").when(ratio <= 0.85, "below").otherwise("about normal")
    )


def ordinal(n) -> Column:
    n = _col(n)
    teen = (n % 100).between(11, 13)
    suffix = (
        F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def slug(text) -> Column:
    """Lower case, everything but letters and digits to single hyphens."""
    dashed = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(trimmed == "", "export").otherwise(trimmed)


def fixed(value, decimals: int) -> Column:
    """A number with that many decimals, NULL kept."""
    value = _col(value)
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value.cast("double")))


def cell_slug(lat, lon) -> Column:
    """`48-03n_128-03w`."""
    lat, east = _col(lat), signed_lon(lon)
    parts = [
        F.concat(fixed(F.abs(lat), 2), F.when(lat < 0, "s").otherwise("n")),
        F.concat(fixed(F.abs(east), 2), F.when(east < 0, "w").otherwise("e")),
    ]
    return F.replace(F.concat_ws("_", *parts), F.lit("."), F.lit("-"))


def partial_note(month, year, n) -> Column:
    """The caveat under a ranking that still has an open month or year."""
    month, year, n = _col(month), _col(year), _col(n)
    whole_year = month == 0
    first = F.make_date(year, F.when(whole_year, F.lit(1)).otherwise(month), F.lit(1))
    days = F.when(whole_year, cal.days_in_year(first)).otherwise(cal.days_in_month(first))
    name = F.when(whole_year, year.cast("string")).otherwise(
        F.concat_ws(" ", month_name(F.greatest(month, F.lit(1))), year.cast("string"))
    )
    return F.format_string("* %s is incomplete — ranked on %d of %d days, so its place will move.", name, n, days)
