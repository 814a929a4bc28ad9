"""Listing text to typed columns.  Blank and unreadable values become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import col, first_match

# Tokens a delimited export uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Spellings of yes and no.
TRUE_WORDS = ("y", "yes", "t", "true", "1", "x")
FALSE_WORDS = ("n", "no", "f", "false", "0")
TRUE_FLAGS = ("true", "t", "y", "yes", "1")
FALSE_FLAGS = ("false", "f", "n", "no", "0")

# Plausible living area in square feet.
AREA_RANGE = (200.0, 20_000.0)

# Fee frequency words and the months each covers.
FEE_MONTHS = {
    12.0: ("annually", "annual", "year", "yearly"),
    3.0: ("quarterly", "quarter"),
    6.0: ("semiannually", "semiannual", "biannually", "biannual"),
}

# Listing status words, and the prefixes tried after them, in order.
STATUS_WORDS = {
    "SOLD": ("sold", "closed", "s", "cls", "soldclosed"),
    "EXPIRED": ("expired", "x", "exp"),
    "WITHDRAWN": (
        "withdrawn", "w", "wdn", "temporarilyoffmarket", "tempoffmarket",
        "temporaryoffmarket", "hold",
    ),
    "CANCELED": ("canceled", "cancelled", "c", "can", "terminated"),
    "ACTIVE": (
        "active", "a", "act", "comingsoon", "new", "activeundercontract",
        "activewithcontract", "backup", "contingent",
    ),
    "PENDING": ("pending", "p"),
}
STATUS_PREFIXES = (
    ("SOLD", ("sold", "closed")),
    ("EXPIRED", ("expired",)),
    ("WITHDRAWN", ("withdraw",)),
    ("CANCELED", ("cancel", "termin")),
    ("ACTIVE", ("active", "coming")),
    ("PENDING", ("pending",)),
)

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Each reader below uses its input once, so that nested readers stay one short
# chain of expressions instead of multiplying in the generated code.


def strip(value) -> Column:
    """Drop white space at both ends, not only blanks."""
    return F.btrim(col(value), F.lit(" \t\n\r\f\x0b"))


def squash(value) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(value)), "[^a-z0-9]", "")


def null_tokens(value) -> Column:
    """Null where an export wrote one of its words for "no value"."""
    value = col(value)
    return F.when(~value.isin(*NULL_TOKENS), value)


def number(text) -> Column:
    """A decimal number, or null; no suffixes, words or separators."""
    return F.regexp_extract(col(text), NUMBER, 0).try_cast("double")


def money(value) -> Column:
    """Amounts such as ``$1,200``; parentheses mean negative."""
    bare = strip(value)
    text = F.regexp_replace(bare, r"^\(\s*-(.*)\)$", "$1")
    text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    text = F.when(bare.startswith("("), text).otherwise(bare)
    for mark in "$, ":
        text = F.replace(text, F.lit(mark), F.lit(""))
    return number(text)


def boolean(value) -> Column:
    """Three-valued: blank stays null."""
    word = F.lower(strip(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def flag(value) -> Column:
    """Like :func:`boolean`, but ignoring punctuation and without the ``x`` mark."""
    word = squash(value)
    return F.when(word.isin(*TRUE_FLAGS), True).when(word.isin(*FALSE_FLAGS), False)


def area(value) -> Column:
    """Square feet with optional unit words; null outside the plausible range."""
    text = F.regexp_replace(strip(value), r"(?i)sq\.?\s*ft\.?|ft²|sf|sqft", "")
    size = number(strip(F.replace(text, F.lit(","), F.lit(""))))
    return F.when(size.between(*AREA_RANGE), size)


def postal_code(value) -> Column:
    """Five digits, left-padded; the extension and a trailing ``.0`` are cut."""
    bare = strip(value)
    text = F.when(bare.endswith(".0"), F.regexp_replace(bare, r"^(\d*)\.0$", "$1")).otherwise(bare)
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", F.lpad(F.substring(digits, 1, 5), 5, "0"))


def real(value) -> Column:
    """A double out of text with thousands commas."""
    return number(strip(F.replace(col(value), F.lit(","), F.lit(""))))


def whole(value) -> Column:
    """An integer out of text with thousands commas; decimals are cut, not rounded."""
    return real(value).try_cast("int")


def monthly_fee(fee, frequency) -> Column:
    """Fee per month, given the stated frequency; unknown words leave it as it is."""
    word = F.regexp_replace(F.lower(strip(frequency)), "[^a-z]", "")
    words = {w: months for months, group in FEE_MONTHS.items() for w in group}
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return col(fee) / F.coalesce(F.try_element_at(table, word), F.lit(1.0))


def fee_label(fee, frequency) -> Column:
    """The stated frequency; trimmed only where there is a fee to go with it."""
    return F.when(col(fee).isNotNull(), strip(frequency)).otherwise(col(frequency))


def status_of_word(word) -> Column:
    """One of the six canonical states of a squashed word: exact, then by prefix."""
    word = col(word)
    rules = [(word.isin(*words), F.lit(state)) for state, words in STATUS_WORDS.items()]
    for state, prefixes in STATUS_PREFIXES:
        pattern = f"^({'|'.join(prefixes)})"
        if state == "PENDING":
            pattern += "|undercontract"
        rules.append((word.rlike(pattern), F.lit(state)))
    return first_match(rules)


def with_status(df: DataFrame, column: str = "status") -> DataFrame:
    """Replace a status text by its canonical state."""
    return (
        df.withColumn("_word", squash(column))
        .withColumn(column, status_of_word("_word"))
        .drop("_word")
    )


def with_unit_key(df: DataFrame, building: str, street: str, unit: str) -> DataFrame:
    """Add ``unit_key``: place and unit, squashed, joined by a bar; empty when both are missing."""
    place = F.coalesce(F.nullif(squash(building), F.lit("")), squash(street), F.lit(""))
    df = df.withColumns({"_place": place, "_door": F.coalesce(squash(unit), F.lit(""))})
    empty = (F.col("_place") == "") & (F.col("_door") == "")
    key = F.when(empty, "").otherwise(F.concat_ws("|", "_place", "_door"))
    return df.withColumn("unit_key", key).drop("_place", "_door")


def contains_any(text, needles) -> Column:
    """True when any plain word occurs in the text."""
    return col(text).rlike("|".join(needles))
