"""Normal forms of names, countries and dates of birth.

Plain Python functions say what is meant and serve single values; column forms serve tables. A name needs Unicode
decomposition, which Spark lacks, so names go through an Arrow UDF; everything else is built of Spark's own functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, in any case, with or without a full stop.
LEGAL_SUFFIXES = (
    "LLC", "LTD", "LIMITED", "CO", "CORP", "CORPORATION", "INC", "INCORPORATED",
    "GROUP", "HOLDINGS", "HOLDING", "PLC", "GMBH", "SA", "SRL", "BV", "NV", "AG",
    "OJSC", "PJSC", "JSC", "LLP", "LP", "PTY", "PTE",
)
# Spellings of countries by their code.
COUNTRY_SPELLINGS = {
    "US": ("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"),
    "GB": ("UK", "UNITED KINGDOM", "GREAT BRITAIN", "BRITAIN"),
    "RU": ("RUSSIA", "RUSSIAN FEDERATION"),
    "CU": ("CUBA",),
    "IR": ("IRAN", "IRAN ISLAMIC REPUBLIC OF"),
    "KP": ("NORTH KOREA", "KOREA NORTH", "DPRK"),
    "KR": ("SOUTH KOREA", "KOREA SOUTH", "REPUBLIC OF KOREA"),
    "SY": ("SYRIA", "SYRIAN ARAB REPUBLIC"),
    "CN": ("CHINA", "PEOPLES REPUBLIC OF CHINA"),
    "CH": ("SWITZERLAND",),
    "ES": ("SPAIN",),
    "JP": ("JAPAN",),
    "DE": ("GERMANY",),
    "FR": ("FRANCE",),
    "IT": ("ITALY",),
    "UA": ("UKRAINE",),
    "VE": ("VENEZUELA", "VENEZUELA BOLIVARIAN REPUBLIC OF"),
    "MM": ("MYANMAR", "BURMA"),
    "AF": ("AFGHANISTAN",),
    "BY": ("BELARUS",),
    "MX": ("MEXICO",),
    "PA": ("PANAMA",),
    "AE": ("UNITED ARAB EMIRATES", "UAE"),
}
COUNTRY_CODES = {spelling: code for code, spellings in COUNTRY_SPELLINGS.items() for spelling in spellings}
SENTINEL = "-0-"
_SUFFIX = r"(?i)\b(" + "|".join(LEGAL_SUFFIXES) + r")\b\.?"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def normalize_name(name: str | None) -> str:
    """Upper case without marks or punctuation, single spaces; '' for nothing."""
    if not name:
        return ""
    if name.isascii():
        letters = name
    else:
        letters = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", letters).split()).upper()


def _normalize_names(names: pd.Series) -> pd.Series:
    known = {n: normalize_name(n) for n in names.unique() if isinstance(n, str)}
    return names.map(lambda n: known.get(n, ""))


def normalized_name(name: Column) -> Column:
    return F.pandas_udf(_normalize_names, "string")(name)


def ascii_name(name: Column) -> Column:
    """The light form for aliases: anything but ASCII letters, digits and space becomes a space; JVM-side only."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9 ]", " "), " +", " ")))


def strip_legal_suffixes(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, _SUFFIX, " "), r"\s+", " "))


def normalize_country(country: Column) -> Column:
    """Two-letter code of a known spelling, else the cleaned text; null for nothing."""
    clean = F.regexp_replace(F.upper(F.trim(country)), r"\s+", " ")
    codes = F.create_map(*[F.lit(x) for pair in COUNTRY_CODES.items() for x in pair])
    return F.when(F.coalesce(country, F.lit("")) == "", None).otherwise(F.coalesce(F.try_element_at(codes, clean), clean))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def normalize_dob(raw: Column) -> Column:
    """ISO date at its own precision: 'dd Mon yyyy', 'yyyy-mm-dd', 'yyyy', 'yyyy-mm' and 'mm/dd/yyyy'; else null."""
    s = F.trim(raw)
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    word, iso, american, year_month = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})$"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(word, 2))).cast("string")
    number = part(year_month, 2)
    return (
        F.when(s.isNull() | s.isin("", SENTINEL), None)
        .when(s.rlike(word), _iso(part(word, 3), month, part(word, 1)))
        .when(s.rlike(iso), _iso(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(r"^\d{4}$") & (s != "0000"), s)
        .when(s.rlike(year_month) & F.lpad(number, 2, "0").between("01", "12"), F.concat(part(year_month, 1), F.lit("-"), F.lpad(number, 2, "0")))
        .when(s.rlike(american), _iso(part(american, 3), part(american, 1), part(american, 2)))
    )


def clean_sentinel(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(SENTINEL))


def split_list(value: Column, mark: str = ";") -> Column:
    """Trimmed, non-blank entries of a delimited list; null for a blank list."""
    entries = F.filter(F.transform(F.split(value, mark), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", None).otherwise(entries)
