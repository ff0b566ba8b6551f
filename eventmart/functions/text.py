"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space in Unicode text (wider than trim()'s blank).
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# A word character is a letter, a number or the underscore, in any script.
_PUNCTUATION = r"[^\p{L}\p{N}_" + SPACE_CLASS + "]+"


def strip(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.trim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Turn each run of white space into one blank and strip the ends (FN-03)."""
    return F.trim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "))


def clean_text(c: Column, blank_as_null: bool = False) -> Column:
    """Normalise a text value; a missing one becomes ``""`` (CLN-04).

    ``blank_as_null=True`` keeps missing and blank values as NULL instead.
    """
    cleaned = collapse(c)
    if blank_as_null:
        return F.nullif(cleaned, F.lit(""))
    return F.coalesce(cleaned, F.lit(""))


def fold(c: Column) -> Column:
    """Comparison form of a name: stripped and lower case."""
    return F.lower(strip(c))


def strip_punctuation(c: Column) -> Column:
    """Remove punctuation at both ends; blanks uncovered by it are kept (FN-01)."""
    return F.regexp_replace(c, f"^{_PUNCTUATION}|{_PUNCTUATION}$", "")


def literal_pattern(separator: str) -> str:
    """A regular expression that matches ``separator`` literally."""
    if len(separator) == 1:
        return separator if separator.isalnum() or separator in " ,;:" else "\\" + separator
    return "\\Q" + separator + "\\E"


def split_list(c: Column, separator: str = ",") -> Column:
    """Delimited text to an array of non-empty stripped items (FN-02)."""
    items = F.split(c, literal_pattern(separator), -1)
    return F.filter(F.transform(items, strip), lambda item: item != "")


def _plain_end(character: Column) -> Column:
    return character.between("a", "z") | character.between("0", "9")


def _plain(token: Column) -> Column:
    """Lower-case text that starts and ends with an ASCII letter or digit."""
    one = F.lit(1)
    return _plain_end(F.left(token, one)) & _plain_end(F.right(token, one))


def normalised_tokens(c: Column, separator: str = ",", punctuation: bool = True) -> Column:
    """Delimited text to an array of lower-case tokens without surrounding white space.

    ``punctuation=True`` also strips punctuation. Both strips are skipped for tokens
    that start and end with a plain letter or digit, which most do; the pattern
    match is by far the dearest step. Working on the array keeps later filters from
    being pushed below and repeating that step.
    """
    items = F.split(F.lower(c), literal_pattern(separator), -1)
    items = F.transform(items, lambda t: F.when(_plain(t), t).otherwise(strip(t)))
    if punctuation:
        items = F.transform(items, lambda t: F.when(_plain(t), t).otherwise(strip_punctuation(t)))
    return F.filter(items, lambda t: t != "")


def contains_folded(c: Column, needle: Column) -> Column:
    """Case-insensitive literal substring test; NULL text never matches (FLT-07)."""
    return F.coalesce(F.contains(F.lower(c), F.lower(needle)), F.lit(False))
