"""Text functions: case, blanks, word lists, formats and informats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepledger.functions.dates import date_to_day_number, day_number_to_date
from stepledger.functions.missing import clear_missing

# Fixed value: the characters that separate words unless others are named.
WORD_DELIMITERS = " !$%&()*+,-./;<^|"
# Fixed value: white space as text tools count it, beyond the ASCII blanks.
SPACE = r"[[^!-~]&&[\s\x0B\x1C-\x1F\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"


def upcase(text: Column) -> Column:
    return F.upper(text)


def lowcase(text: Column) -> Column:
    return F.lower(text)


def strip(text: Column) -> Column:
    return F.trim(text)


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def words(text: Column, delimiters: str = WORD_DELIMITERS) -> Column:
    parts = F.split(text, "[" + re.escape(delimiters) + "]+")
    return F.filter(parts, lambda w: w != "")


def countw(text: Column, delimiters: str = WORD_DELIMITERS) -> Column:
    return F.size(words(text, delimiters))


def scan(text: Column, n, delimiters: str = WORD_DELIMITERS) -> Column:
    """The n-th word, from the right when n is negative; blank when there is none, as for n = 0."""
    place = F.nullif(F.lit(n) if isinstance(n, int) else n, F.lit(0))
    return F.coalesce(F.try_element_at(words(text, delimiters), place), F.lit(""))


def fit_length(text: Column, length: int) -> Column:
    """A character value cut to its declared length; trailing blanks do not count."""
    return F.rtrim(F.substring(text, 1, length))


def put(value: Column, fmt: str) -> Column:
    """Write a value in a named format; a missing number writes as ``.``."""
    name = fmt.strip().lower()
    if name.startswith("$"):
        return F.substring(value.cast("string"), 1, int(re.sub(r"\D", "", name) or 200))
    if name.startswith("date"):
        text = F.upper(F.date_format(value, "ddMMMyyyy"))
    elif name.startswith("yymmdd"):
        text = F.date_format(value, "yyyy-MM-dd")
    elif name.startswith("best"):
        text = _best(value, int(re.sub(r"\D", "", name) or 12))
    elif name.startswith("z"):
        width, decimals = _width(name[1:])
        text = F.format_string(f"%0{width}.{decimals}f", value.cast("double"))
    else:
        width, decimals = _width(name)
        text = F.lpad(F.format_string(f"%.{decimals}f", value.cast("double")), width, " ")
    return F.when(value.isNull(), F.lit(".")).otherwise(text)


def _width(spec: str) -> tuple[int, int]:
    match = re.fullmatch(r"(\d+)\.(\d*)", spec)
    if not match:
        raise ValueError(f"unknown format {spec!r}")
    return int(match.group(1)), int(match.group(2) or 0)


def _best(value: Column, width: int) -> Column:
    """The plain decimal text of a number, rounded to the digits that fit, or its exponent form when it does not fit."""
    number = value.cast("double")
    fitting = []
    for decimals in range(min(width, 12), -1, -1):
        plain = F.format_string(f"%.{decimals}f", number)
        plain = F.regexp_replace(plain, r"\.?0+$", "") if decimals else plain
        plain = F.when(plain.isin("-0", ""), F.lit("0")).otherwise(plain)
        fitting.append(F.when(F.length(plain) <= width, plain))
    tiny = (F.abs(number) > 0) & (F.abs(number) < 1e-10)
    exponent = F.format_string(f"%.{max(width - 7, 0)}E", number)
    return F.when(tiny, exponent).otherwise(F.coalesce(*fitting, exponent))


def read(text: Column, informat: str) -> Column:
    """Read text by an informat; text that does not fit gives a missing value, never an error."""
    name = informat.strip().lower()
    cleaned = clear_missing(F.trim(text))
    if name.startswith("$"):
        return F.substring(text, 1, int(re.sub(r"\D", "", name) or 200))
    if name.startswith("date"):
        return F.try_to_timestamp(F.initcap(F.lower(cleaned)), F.lit("[ddMMMyyyy][dMMMyyyy]")).cast("date")
    if name.startswith("yymmdd"):
        return F.try_to_timestamp(F.regexp_replace(cleaned, "[/-]", ""), F.lit("yyyyMMdd")).cast("date")
    if name.startswith("comma"):
        cleaned = F.regexp_replace(cleaned, "[$,]", "")
    return cleaned.try_cast("double")


def read_day_number(text: Column, informat: str) -> Column:
    """A date informat read as days from 1960."""
    return date_to_day_number(read(text, informat))


def put_day_number(days: Column, fmt: str) -> Column:
    return put(day_number_to_date(days), fmt)
