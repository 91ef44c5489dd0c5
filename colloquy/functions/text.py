"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode character classes and "\n is the only line end", so that patterns written for
# a Unicode-aware matcher keep their meaning on the JVM.
UNICODE = "(?Ud)"

# Fixed values.
HANDLE = r"@\d+"
AGENT_SUFFIX = r"\s+\d+\s+\^[A-Z]{2,3}\s*$"
BARE_INITIALS = r"\s+\^[A-Z]{2,3}\s*$"
HANDLE_OR_URL = r"@\S+|https?://\S+"


def strip(text: Column) -> Column:
    """Cut white space of any kind from both ends."""
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def redact_handles(text: Column) -> Column:
    """Numeric handles become ``@USER``; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(text, UNICODE + HANDLE, "@USER"), F.lit(""))


def strip_agent_suffix(text: Column, bare_initials: bool = False) -> Column:
    """Drop a trailing part number with agent initials, e.g. `` 2 ^JL``.

    Initials without a part number stay unless ``bare_initials`` is set.
    """
    out = F.regexp_replace(text, UNICODE + AGENT_SUFFIX, "")
    if bare_initials:
        out = F.regexp_replace(out, UNICODE + BARE_INITIALS, "")
    return strip(out)


def clean(text: Column) -> Column:
    """Lower-case ASCII words only: handles and links go, other characters become spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), UNICODE + HANDLE_OR_URL, " ")
    out = F.regexp_replace(F.lower(out), "[^a-z0-9]+", " ")
    return F.trim(out)


def tokens(cleaned: Column) -> Column:
    """Words of two or more characters of a cleaned text."""
    return F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= 2)


def unigrams_and_bigrams(words: Column) -> Column:
    """The words, followed by each pair of neighbouring words joined with a space."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def resolve_label(raw: Column, labels: Sequence[str]) -> Column:
    """A typed label: its number, or any part of its name; null when nothing fits."""
    names = F.array(*[F.lit(x) for x in labels])
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
    by_number = F.when(number.between(1, len(labels)), F.get(names, number - 1))
    by_name = F.when(raw != "", F.get(F.filter(names, lambda x: F.contains(x, raw)), F.lit(0)))
    return F.coalesce(by_number, by_name)


def yes_no(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)).isin("y", "yes"), "yes").when(
        F.lower(F.trim(raw)).isin("n", "no"), "no")


def rating(raw: Column) -> Column:
    """A numeric label cut to an integer; null when it is not a number."""
    return F.trim(raw.cast("string")).try_cast("double").try_cast("int")
