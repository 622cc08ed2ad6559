"""Column expressions for names, addresses, identifiers and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street words and what they are shortened to.
STREET_WORDS = {"STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "BOULEVARD": "BLVD", "COURT": "CT", "PLACE": "PL", "TERRACE": "TER"}
#: Name suffixes.
SUFFIXES = ["JR", "SR", "II", "III", "IV"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_upper(c: Column) -> Column:
    return F.upper(blank_to_null(c))


def full_match(c: Column, pattern: str) -> Column:
    """rlike looks for a match anywhere; this asks for the whole string."""
    return c.rlike(f"^(?:{pattern})$")


def digits(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "[^0-9]", ""))


def phone10(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 10, d)


def zip5(c: Column) -> Column:
    z = F.trim(c)
    return F.when(full_match(z, "[0-9]{5}") & (z != "00000"), z)


def street_number(c: Column) -> Column:
    return F.regexp_substr(F.trim(c), F.lit("^[0-9]+"))


def street_name(c: Column) -> Column:
    out = F.upper(F.trim(F.regexp_replace(F.trim(c), "^[0-9]+", "")))
    for long, short in STREET_WORDS.items():
        out = F.regexp_replace(out, f" {long}$", f" {short}")
    return blank_to_null(out)


def search_text(c: Column) -> Column:
    """Lower case, runs of anything but letters, digits and $ to a space, and a space at both ends.

    Of letters that aren't A-Z only two have a small letter in a-z; the others become spaces in any case. A single
    space between words is no match, so most words cost the pattern nothing.
    """
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(c, up + "\u212a\u0130", up.lower() + "ki")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, "[^a-z0-9$ ][^a-z0-9$]*| [^a-z0-9$]+", " ")), F.lit(" "))


def reason_codes(pairs: list[tuple[Column, str]], sep: str = ";") -> Column:
    """The tags whose condition holds, in order."""
    return F.concat_ws(sep, *[F.when(c, F.lit(tag)) for c, tag in pairs])


def decode(c: Column, table: dict, default: Column | None = None) -> Column:
    """CASE over equal values; what isn't in the table becomes NULL or default."""
    out = None
    for k, v in table.items():
        out = (F.when if out is None else out.when)(c == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default)


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def whole_dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.round(c, 0).cast("bigint").cast("string"))


def party_key(record_id: Column) -> Column:
    return F.concat(F.lit("PTY_"), F.substring(F.md5(record_id), 1, 16))
