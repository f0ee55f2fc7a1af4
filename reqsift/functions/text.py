"""Column functions on plain text: Unicode-aware stripping, word sets, Jaccard, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The 29 code points that count as white space when splitting words.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` alone removes only spaces).

    A pattern for the end would be tried at every blank of a text.
    """
    return F.btrim(text, F.lit(BLANKS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order, split at white space of any kind."""
    return F.array_remove(F.split(text, f"{BLANK}+", -1), "")


def word_set(text: Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(words(F.lower(text)))


def set_key(word_array: Column) -> Column:
    """Digest of a word set: equal for equal sets whatever their order."""
    return F.sha2(F.array_join(F.sort_array(word_array), " "), 256)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard index of two word sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(both, shared.cast("double") / total).otherwise(F.lit(0.0))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def full_text(title: Column, description: Column) -> Column:
    """``title description``, the text that similarity looks at."""
    return F.concat(blank_if_null(title), F.lit(" "), blank_if_null(description))


def dashed_text(title: Column, description: Column) -> Column:
    """``title - description``, the text a classifier is shown."""
    return F.concat(blank_if_null(title), F.lit(" - "), blank_if_null(description))


def is_yes(answer: Column) -> Column:
    """True for a verdict of exactly 'yes' or 'true', whatever its case and padding."""
    return F.coalesce(strip(F.lower(answer)).isin("yes", "true"), F.lit(False))


def starts_with_yes(answer: Column) -> Column:
    """True for a judge's answer that begins with 'yes'."""
    return F.coalesce(F.startswith(strip(F.lower(answer)), F.lit("yes")), F.lit(False))


def normal_confidence(confidence: Column) -> Column:
    return F.lower(strip(confidence))


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` places, filled with the columns of these names."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), blank_if_null(value))
    return text
