"""Column expressions for article fields. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL and date formats of article records.
HOST_PATTERN = r"https?://(?:www\.)?([^/?:]+)"
DATE_PATTERN = r"^[0-9]{14}$"


def host_of(url: Column) -> Column:
    """Host of an article URL without ``www.`` and trailing dots; '' if none."""
    return F.rtrim(F.regexp_extract(url, HOST_PATTERN, 1), F.lit("."))


def registry_host(url: Column) -> Column:
    """Host of a registry web address, which may lack its scheme."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    authority = F.regexp_extract(full, r"^https?://([^/?#]*)", 1)
    host = F.split_part(authority, F.lit(":"), F.lit(1))
    bare = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)
    return F.lower(bare)


def has_valid_date(date: Column) -> Column:
    return date.rlike(DATE_PATTERN)


def day_of(date: Column) -> Column:
    """Calendar day of a 14-digit date; NULL when the digits are no date."""
    return F.try_to_date(F.substring(date, 1, 8), "yyyyMMdd")


def year_text(date: Column) -> Column:
    return F.substring(date, 1, 4)


def month_text(date: Column) -> Column:
    """Month key ``YYYY-MM``."""
    return F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2))


def pieces(text: Column) -> Column:
    """The ``;``-separated pieces, including the empty one after a last ``;``."""
    return F.split(text, ";", -1)


def theme_count(themes: Column) -> Column:
    return F.size(pieces(themes)).cast("long")


def theme_count_or_zero(themes: Column) -> Column:
    return F.when(themes.isNull() | (themes == ""), F.lit(0).cast("long")).otherwise(theme_count(themes))


def theme_key(piece: Column) -> Column:
    """Upper-case theme name without its text offset."""
    return F.upper(F.trim(F.split_part(F.trim(piece), F.lit(","), F.lit(1))))


def raw_theme_key(piece: Column) -> Column:
    """Theme name as written, without its text offset."""
    return F.split_part(piece, F.lit(","), F.lit(1))


def theme_keys(themes: Column) -> Column:
    return F.transform(pieces(themes), theme_key)


def country_codes(locations: Column) -> Column:
    """Distinct non-empty country codes of a locations field."""
    codes = F.transform(pieces(locations), lambda p: F.split_part(p, F.lit("#"), F.lit(3)))
    return F.filter(F.array_distinct(codes), lambda c: c != "")


def location_fields(piece: Column) -> tuple[Column, Column, Column]:
    """(type, name, country) of one location piece."""
    return tuple(F.split_part(piece, F.lit("#"), F.lit(i)).alias(n)
                 for i, n in ((1, "loc_type"), (2, "loc_name"), (3, "country_code")))


# Readable names of the location types.
LOCATION_TYPES = {
    "1": "Pays",
    "2": "État US",
    "3": "Ville US",
    "4": "Ville Monde",
    "5": "Région Monde",
}


def location_type_name(code: Column) -> Column:
    label = F.lit("Inconnu")
    for key, name in LOCATION_TYPES.items():
        label = F.when(code == key, name).otherwise(label)
    return label


# Substrings that mark a theme as economic in the wide sense.
WIDE_ECONOMIC_PREFIX = "ECON"
WIDE_ECONOMIC_WORDS = ("FINANCE", "BUSINESS", "TRADE", "MARKET", "BANK", "CURRENCY", "STOCK", "TAX")


def is_economic(theme: Column) -> Column:
    return theme.contains("ECON")


def is_economic_wide(theme: Column) -> Column:
    test = theme.startswith(WIDE_ECONOMIC_PREFIX)
    for word in WIDE_ECONOMIC_WORDS:
        test = test | theme.contains(word)
    return test


def in_sample(record_id: Column, percent: int = 1) -> Column:
    """Repeatable sample of about ``percent`` in 100 records, by id."""
    return F.pmod(F.xxhash64(record_id), F.lit(100)) < percent


def in_portable_sample(record_id: Column, percent: int = 1) -> Column:
    """The same idea on md5, so that another engine draws the same rows."""
    return portable_draw(record_id) % 100 < percent


def portable_draw(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def all_present(names: list[str]) -> Column:
    """No NULL in any of the columns.

    One test on an array: a conjunction over dozens of shifted columns makes
    the optimizer's constraint inference explode.
    """
    return ~F.array_contains(F.array(*[F.col(f"`{n}`").isNull() for n in names]), True)
