"""Text and date clean-up used by the ingest jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ascii_fold(col: Column | str) -> Column:
    """Each run of non-ASCII characters becomes one blank; null stays null."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]+", " ")


def first_number(col: Column | str) -> Column:
    """First run of digits as BIGINT, null if there is none."""
    return F.regexp_extract(_c(col), r"\d+", 0).try_cast("bigint")


def plain_int(col: Column | str) -> Column:
    """``1,234`` -> 1234; null if it is no number."""
    return F.trim(F.replace(_c(col), F.lit(","), F.lit(""))).try_cast("bigint")


def drop_double_spaces(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit("  "), F.lit(""))


def flip_name(col: Column | str) -> Column:
    """``Last, First`` -> ``First Last``; blanks are removed, a one-part name is kept."""
    parts = F.split(F.replace(_c(col), F.lit(" "), F.lit("")), ",")
    return F.when(F.size(parts) > 1, F.concat_ws(" ", parts[1], parts[0])).otherwise(parts[0])


def first_token(col: Column | str) -> Column:
    """First word of a display name, without ``[``."""
    return F.split(F.replace(_c(col), F.lit("["), F.lit("")), " ")[0]


def percent(col: Column | str) -> Column:
    """Ratio as an integer percentage."""
    return F.round(_c(col) * 100).cast("int")


def parse_review_date(col: Column | str) -> Column:
    """``Mar 16, 2011`` (any surrounding blanks) as a timestamp, null if malformed."""
    return F.try_to_timestamp(F.trim(_c(col)), F.lit("MMM d, yyyy"))


def date_from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Timestamp from parts; a missing month or day is 1, an impossible date is null."""
    one, zero = F.lit(1), F.lit(0)
    return F.try_make_timestamp(
        _c(year).cast("int"),
        F.coalesce(_c(month).cast("int"), one),
        F.coalesce(_c(day).cast("int"), one),
        zero,
        zero,
        zero,
    )


# Fixed values of the polynomial hash: start, multiplier, modulus.
HASH_START, HASH_FACTOR, HASH_MODULUS = 7, 1223, 4222234741


def poly_hash(col: Column | str) -> Column:
    """Polynomial string hash; reducing at each step keeps every product within BIGINT."""
    chars = F.split(_c(col), "")
    codes = F.filter(chars, lambda ch: ch != "")
    return F.when(
        _c(col).isNotNull(),
        F.aggregate(
            codes,
            F.lit(HASH_START).cast("bigint"),
            lambda h, ch: (h * HASH_FACTOR + F.ascii(ch)) % HASH_MODULUS,
        ),
    )


def bucket_id(col: Column | str, buckets: int = 10**8) -> Column:
    """Hash bucket of a name, from 60 bits of its md5, so that any engine gives the same."""
    return F.conv(F.substring(F.md5(_c(col)), 1, 15), 16, 10).cast("bigint") % F.lit(buckets)


def safe_ratio(num: Column | str, den: Column | str, empty: float | None = 0.0) -> Column:
    """``num / den``, or ``empty`` where the denominator is zero."""
    return F.when(_c(den) != 0, _c(num) / _c(den)).otherwise(F.lit(empty).cast("double"))
