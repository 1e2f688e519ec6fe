"""Cleaning expressions: numbers, two-digit-year dates, birth numbers, sentinels, ratios."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

CZK_TO_USD = 0.038


def to_number(col: Column, fill: float | None = None) -> Column:
    """Number or null; with ``fill``, never null."""
    number = col.try_cast("double")
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def coerce_numeric(
    df: DataFrame, columns: Iterable[str], *, fill: float | None = None
) -> DataFrame:
    """Make ``columns`` numeric; names the frame does not have are skipped."""
    known = set(df.columns)
    return df.withColumns({c: to_number(F.col(c), fill) for c in columns if c in known})


def to_usd(df: DataFrame, columns: Iterable[str], *, rate: float = CZK_TO_USD) -> DataFrame:
    """Multiply money columns by an exchange rate."""
    known = set(df.columns)
    return df.withColumns({c: F.col(c) * F.lit(rate) for c in columns if c in known})


def _with_century(text: Column, pivot: int) -> Column:
    """Prefix the century to text starting with a two-digit year."""
    year = F.substring(text, 1, 2).try_cast("int")
    return F.concat(F.when(year >= pivot, "19").otherwise("20"), text)


def parse_yymmdd(col: Column, *, pivot: int = 69) -> Column:
    """Date from yymmdd: years from ``pivot`` up are 19xx, below it 20xx; bad text is null."""
    text = F.trim(col.cast("string"))
    # a cast reads ISO dates without a formatter, which takes most of the time otherwise
    parts = [_with_century(F.substring(text, 1, 2), pivot), F.substring(text, 3, 2), F.substring(text, 5, 2)]
    return F.when(text.rlike(r"^[0-9]{6}\z"), F.concat_ws("-", *parts)).try_cast("date")


def parse_yymmdd_ts(col: Column, *, pivot: int = 69) -> Column:
    """Timestamp from ``yymmdd HH:mm:ss`` with the same century rule."""
    text = F.trim(col.cast("string"))
    shape = "^[0-9]{6} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
    full = F.when(text.rlike(shape), _with_century(text, pivot))
    return F.try_to_timestamp(full, F.lit("yyyyMMdd HH:mm:ss"))


def birth_date(col: Column) -> Column:
    """Date of birth from YYMMDD where one sex has 50 added to the month.

    Years below 50 are 20xx. Fewer than six characters or an impossible date give null.
    """
    text = F.regexp_replace(F.trim(col.cast("string")), '^"+|"+$', "")
    year, month, day = (F.substring(text, p, 2).try_cast("int") for p in (1, 3, 5))
    century = F.when(year < 50, 2000).otherwise(1900)
    zero = F.lit(0)
    built = F.try_make_timestamp_ntz(
        year + century, F.when(month > 12, month - 50).otherwise(month), day, zero, zero, zero
    )
    return F.when(F.length(text) >= 6, built).cast("date")


def age_years(col: Column, asof: Column) -> Column:
    """Whole 365-day years from birth to ``asof``; a birth after it gives a negative age."""
    return F.floor(F.date_diff(asof, birth_date(col)) / F.lit(365.0)).cast("int")


def sentinel_to_zero(col: Column, *, text: bool = False, sentinel: str = "?") -> Column:
    """Replace the sentinel and null by zero; numeric unless ``text``."""
    plain = F.when(F.trim(col.cast("string")) != sentinel, col.cast("string"))
    if text:
        return F.coalesce(plain, F.lit("0"))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def fill_nulls(df: DataFrame, defaults: Mapping[str, str | int | float]) -> DataFrame:
    """Per-column defaults, adding a column that is missing."""
    known, out = set(df.columns), {}
    for name, value in defaults.items():
        default = F.lit(value)
        out[name] = F.coalesce(F.col(name), default) if name in known else default
    return df.withColumns(out)


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Null to ``value`` in every numeric column."""
    return df.fillna(value, subset=numeric_columns(df))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_or_default(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Fixed column order; a column the frame lacks is the given constant."""
    known = set(df.columns)
    return df.select(
        *[F.col(c) if c in known else F.lit(d).alias(c) for c, d in wanted.items()]
    )


def suffix_columns(df: DataFrame, suffix: str, *, keep: Iterable[str] = ()) -> DataFrame:
    """Rename before a join so that no reference is ambiguous."""
    kept = set(keep)
    return df.select(*[F.col(c).alias(c if c in kept else c + suffix) for c in df.columns])


def ratio_plus_one(a: Column, b: Column) -> Column:
    """a / (b + 1); null where the divisor is zero."""
    return F.try_divide(a, b + 1)


def ratio_guarded(a: Column, b: Column) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def money_text(col: Column, digits: int) -> Column:
    """Number as text, half up, without needless zeros but always with one decimal."""
    fixed = F.round(col.try_cast("decimal(28,6)"), digits).cast(f"decimal(28,{digits})")
    return F.regexp_replace(fixed.cast("string"), r"(\.[0-9]+?)0+$", "$1")
