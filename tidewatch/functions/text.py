"""Text, hash, set and number normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The white space that counts as blank (wider than Java's \\s).
SPACES = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = f"[{SPACES}]"
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    if values.isna().all():
        return values
    return values.map(
        lambda v: v if unicodedata.is_normalized("NFC", v) else unicodedata.normalize("NFC", v),
        na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _compose_members(values: pd.Series) -> pd.Series:
    def composed(members):
        return [None if m is None else unicodedata.normalize("NFC", m) for m in members]

    return values.map(composed, na_action="ignore")


def nfc(c: Column | str) -> Column:
    """Unicode NFC.  Text below U+0300 is already composed and stays in the JVM."""
    c = _col(c)
    composed = c.rlike(r"^[\u0000-\u02FF]*$")
    return F.when(composed, c).otherwise(_compose(F.when(~composed, c)))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """Trim and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE_CLASS}+", " "))


def normalize_text(c: Column | str) -> Column:
    return collapse(nfc(c))


def text_value(c: Column | str) -> Column:
    """Normalised text; blank counts as no value."""
    return F.nullif(normalize_text(c), F.lit(""))


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def normalized_hash(c: Column | str) -> Column:
    return content_hash(normalize_text(c))


def photos_hash(c: Column | str) -> Column:
    """Photos are an ordered list of identifiers; order matters."""
    return F.sha2(F.array_join(F.transform(_col(c), strip), "\n"), 256)


def normalize_set(c: Column | str) -> Column:
    """Composed, lower-cased, distinct, sorted members without blanks.

    Arrays whose members are all below U+0300 are composed already and stay in the JVM.
    """
    c = _col(c)
    plain = F.forall(c, lambda m: F.coalesce(m.rlike(r"^[\u0000-\u02FF]*$"), F.lit(True)))
    composed = F.when(plain, c).otherwise(_compose_members(F.when(~plain, c)))
    members = F.transform(composed, lambda m: F.lower(collapse(m)))
    return F.array_sort(F.array_distinct(F.filter(members, lambda m: m != "")))


def set_hash(c: Column | str) -> Column:
    return F.sha2(F.array_join(normalize_set(c), "\n"), 256)


def set_added(previous: Column | str, current: Column | str) -> Column:
    return F.array_except(normalize_set(current), normalize_set(previous))


def set_removed(previous: Column | str, current: Column | str) -> Column:
    return F.array_except(normalize_set(previous), normalize_set(current))


def normalize_name(c: Column | str) -> Column:
    c = nfc(c)
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    return similarity_of_normalized(normalize_name(a), normalize_name(b))


def similarity_of_normalized(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def parse_integer(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(f"^{SPACE_CLASS}*-?[0-9]+{SPACE_CLASS}*$"),
                  strip(c).try_cast("bigint"))


def parse_decimal(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(f"^{SPACE_CLASS}*-?[0-9]+(\\.[0-9]+)?{SPACE_CLASS}*$"),
                  strip(c).try_cast("double"))


def parse_number(c: Column | str) -> Column:
    """Decimal with optional thousands separators."""
    return parse_decimal(F.regexp_replace(strip(c), ",", ""))


def leading_number(c: Column | str) -> Column:
    """The number a text starts with ("4.9 stars" is 4.9); NULL without one."""
    found = F.regexp_extract(
        strip(c), r"^([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def leading_integer(c: Column | str) -> Column:
    value = leading_number(c)
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("bigint")


def parse_boolean(c: Column | str, single_letters: bool = False) -> Column:
    """``single_letters`` also reads t and f."""
    word = F.lower(strip(c))
    extra = single_letters
    return F.when(word.isin(*TRUE_WORDS, *(["t"] if extra else [])), F.lit(True)).when(
        word.isin(*FALSE_WORDS, *(["f"] if extra else [])), F.lit(False))


def flag_boolean(c: Column | str) -> Column:
    """Page attribute form: true/1/yes and false/0/no only."""
    word = F.lower(_col(c))
    return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(
        word.isin("false", "0", "no"), F.lit(False))


def num_text(c: Column | str) -> Column:
    """Shortest plain decimal text: 3 not 3.0, 35000000 not 3.5E7."""
    c = _col(c).cast("double")
    whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
    plain = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)
    wide = F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(whole, c.try_cast("bigint").cast("string"))
        .when(plain, c.cast("string"))
        .otherwise(wide)
    )


def blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def non_blank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))
