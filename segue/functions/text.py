"""Text keys: paths, file names, normalised text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Characters that are neither letters nor digits, and the ASCII range test.
_SEPARATORS = r"[^\p{L}\p{N}]+"
_ASCII = r"^[\x00-\x7F]*$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_windows_path(path: Column) -> Column:
    return (F.substring(path, 2, 1) == ":") | path.startswith("\\\\")


# Everything up to the last separator; a backslash separates only in Windows-style paths.
_FOLDERS = r"(?s)^(?:(?:.:|\\\\)(?:.*[\\/])?|.*/)"


def file_name(path: Column) -> Column:
    """Last component of a POSIX or Windows-style path."""
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), _FOLDERS, "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def name_without_extension(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def display_name(artist: Column, title: Column, location: Column) -> Column:
    return (
        F.when((artist != "") & (title != ""), F.concat(artist, F.lit(" - "), title))
        .when(title != "", title)
        .otherwise(file_name(location))
    )


WORD = re.compile(r"[^\W_]+")


@pandas_udf(StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    """The words of the compatibility form, caseless, for the non-ASCII minority."""

    def words(s: str) -> str:
        caseless = unicodedata.normalize("NFKC", s).casefold()
        return " ".join(WORD.findall(caseless))

    return text.map(words, na_action="ignore")


@pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s.casefold(), na_action="ignore")


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def is_ascii(text: Column) -> Column:
    return text.rlike(_ASCII)


def _non_ascii_only(udf, text: Column) -> Column:
    """Python sees NULL for ASCII rows, so only the rest is shipped as text."""
    return udf(F.when(~is_ascii(text), text))


def norm_text_native(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _SEPARATORS, " "))


def norm_text(text: Column, exact: bool = True) -> Column:
    """Comparison form of a text.  ASCII never leaves the JVM; with ``exact`` the other
    texts get Unicode compatibility folding, which Spark has no built-in for."""
    if not exact:
        return norm_text_native(text)
    return F.coalesce(
        F.when(is_ascii(text), norm_text_native(text)), _non_ascii_only(_fold_unicode, text)
    )


def casefold(text: Column, exact: bool = True) -> Column:
    if not exact:
        return F.lower(text)
    return F.coalesce(F.when(is_ascii(text), F.lower(text)), _non_ascii_only(_casefold, text))


def stem_key(path: Column, exact: bool = True) -> Column:
    return norm_text(name_without_extension(path), exact)


def path_key(path: Column, exact: bool = True) -> Column:
    return casefold(normalise_path(path), exact)


def _cut(text: Column, limit: int) -> Column:
    text = F.regexp_replace(strip(text), r"\.+$", "")
    text = F.regexp_replace(F.substring(text, 1, limit), r"[ .]+$", "")
    return strip(F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown")))


def with_fat_safe(df: DataFrame, limits: dict[str, int], exact: bool = True) -> DataFrame:
    """Turn the named columns into path components a FAT volume accepts, in composed form."""
    unsafe = r'[<>:"/\\|?*\x00-\x1f]'
    for name in limits:
        df = df.withColumn(name, F.regexp_replace(name, unsafe, "_"))
    if exact:
        composed = {n: _non_ascii_only(_nfc, F.col(n)) for n in limits}
        df = df.withColumns({f"_nfc{n}": v for n, v in composed.items()})
        for n in limits:
            df = df.withColumn(n, F.coalesce(f"_nfc{n}", n)).drop(f"_nfc{n}")
    for name, limit in limits.items():
        df = df.withColumn(name, _cut(F.col(name), limit))
    return df


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def year_digits(year: Column) -> Column:
    return F.regexp_extract(year, r"^\s*(\d{4})", 1)


def year_or_empty(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit("0")) == "0", F.lit("")).otherwise(year)


def number_text(value: Column, places: int = 3) -> Column:
    """Fixed-point text without trailing zeros; ``-0`` reads ``0``."""

    def formatted(v: Column) -> Column:
        text = F.format_string(f"%.{places}f", v)
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        return F.when(text.isin("", "-0", "-"), F.lit("0")).otherwise(text)

    # most values are the number nearest to one of so many places: its digits, without the formatter and patterns
    units = F.rint(value * 10**places)
    digits = F.lpad(F.abs(units).cast("bigint").cast("string"), 18, "0")
    whole = F.coalesce(F.nullif(F.ltrim(F.substring(digits, 1, 18 - places), F.lit("0")), F.lit("")), F.lit("0"))
    part = F.rtrim(F.substring(digits, 19 - places, places), F.lit("0"))
    short = F.concat(F.when(units < 0, "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    near = (units / 10**places == value) & (F.abs(units) < 1e15)
    # the formatter writes so much of "null"; as a function of an array it is left out of generated code, which was one
    # method too long for the JVM to compile
    return F.when(value.isNull(), F.lit("null"[:places])).when(near, short).otherwise(F.get(F.transform(F.array(value), formatted), F.lit(0)))
