"""Blank tests, whitespace, casing and amounts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The marks taken out of an amount before it is read as a number.
AMOUNT_SYMBOLS = "$,₹€£%"

# Accepted names of each casing.
CASINGS = {
    "upper": ("uppercase", "upper", "all_caps", "full_case"),
    "lower": ("lowercase", "lower"),
    "title": ("titlecase", "title", "capitalize_words", "1st_letters"),
    "capitalize": ("capitalize", "sentencecase", "sentence_case", "1st_letter_only"),
}

# Spark's own cast also takes Java suffixes such as "1.5f"; those are not numbers here.
_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"

# a run of letters and digits with what follows it, or what stands before the first run
_WORD = r"[\p{IsAlphabetic}\p{N}]+[^\p{IsAlphabetic}\p{N}]*|[^\p{IsAlphabetic}\p{N}]+"


def col(name: str) -> Column:
    """A column by its exact name; headers may hold dots, spaces and quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def blank(c: Column, dtype: T.DataType) -> Column:
    """Null, or text that is empty once stripped."""
    if not is_text(dtype):
        return c.isNull()
    # text that begins with a visible ASCII character needs no stripping to tell
    doubtful = (c < "!") | (c > "~")
    return c.isNull() | (doubtful & (F.ltrim(c, F.lit(WHITESPACE)) == ""))


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces and tabs become one space; line breaks stay."""
    return F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"[ \t]+", " ")).otherwise(c)


def collapse_whitespace(c: Column) -> Column:
    """Runs of any whitespace become one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters and digits."""
    words = F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def title_case_tokens(c: Column) -> Column:
    """Upper-case the first ASCII word character of each token, lower-case the rest of it."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\w\S*|\W+)"), F.lit(1))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike(r"^\w"), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))
            ).otherwise(p),
        ),
        "",
    )


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def with_casing(c: Column, casing: str | None) -> Column:
    """Apply a casing by any of its names; an unknown name changes nothing."""
    wanted = (casing or "").lower()
    for kind, names in CASINGS.items():
        if wanted in names:
            return {"upper": F.upper, "lower": F.lower, "title": title_case, "capitalize": capitalize}[kind](c)
    return c


def match_key(c: Column, dtype: T.DataType) -> Column:
    """The form in which duplicate keys are compared."""
    return F.lower(strip(c)) if is_text(dtype) else c


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number gives null."""
    return F.regexp_extract(c, _NUMBER, 0).try_cast("double")


def amount(c: Column) -> Column:
    """Text with currency marks, grouping commas and spaces to double."""
    return parse_number(F.translate(c, AMOUNT_SYMBOLS + WHITESPACE, ""))
