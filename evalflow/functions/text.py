"""Shared text and JSON building blocks.

All of them are built-in JVM expressions whose cost is linear in the text, so whole
documents can be processed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

FENCE = "```"

_END_MARK = "evalflow:end-of-value"

_WORD = r"[\p{L}\p{N}_]"
# Java looks back over surrogate pairs only if the pattern text holds one, so one letter is spelled out.
_WORD_BEFORE = "[\\p{L}\\p{N}_\U0001d4b3]"


def unicode_pattern(pattern: str) -> str:
    """A Java pattern whose classes \\b, \\w, \\s and \\d cover the characters Python's cover.

    Java's Unicode classes differ in numbers such as one half, in combining marks and in the
    separators U+001C to U+001F. Classes inside brackets are not rewritten.
    """
    edge = f"(?:(?<={_WORD_BEFORE})(?!{_WORD})|(?<!{_WORD_BEFORE})(?={_WORD}))"
    space = r"[\s\x1c-\x1f\x85\p{Z}]"
    return pattern.replace(r"\b", edge).replace(r"\w", _WORD).replace(r"\s", space).replace(r"\d", r"\p{Nd}")


def word_pattern(word: str) -> str:
    """Pattern of a whole word in any case.

    The first letter is checked before anything else, which is faster over a long text than a word
    boundary in front. U+017F is the long s, which counts as an s in any case.
    """
    first = "".join(sorted({word[0].lower(), word[0].upper()})) + ("\\u017f" if word[0].lower() == "s" else "")
    return f"(?s)(?=[{first}])(?<!{_WORD_BEFORE})(?iu:{word})(?!{_WORD})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    The optimizer copies an expression into every place that uses it, so a chain of readings of a
    computed text would compute that text once per reading. A lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def fenced_blocks(text: Column) -> Column:
    """Stripped contents of all closed code fences, in order of appearance."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)```(.*?)```"), F.lit(1)), strip)


def first_longest(texts: Column) -> Column:
    """The longest element of an array of strings; the first one on ties; NULL when empty."""
    return F.reduce(
        texts,
        F.lit(None).cast("string"),
        lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best),
    )


def unfenced(text: Column) -> Column:
    """Content of the first closed fence (an opening ``json`` tag is dropped), else the text."""

    def inner(parts: Column) -> Column:
        block = F.get(parts, 1)
        tagged = F.when(block.startswith("json"), F.substr(block, F.lit(5))).otherwise(block)
        return F.when(F.size(parts) == 3, strip(tagged))

    return F.when(text.contains(FENCE), F.coalesce(let(F.split(text, FENCE, 3), inner), text)).otherwise(text)


def json_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else NULL.

    Spark's JSON parsers stop after the first value and accept text behind it. Parsing the
    text as the first of two array elements makes trailing text fail: the closing mark is
    only reached when the value before it was complete.
    """

    def first_of_pair(items: Column) -> Column:
        mark = F.try_variant_get(F.get(items, 1), "$", "string")
        return F.when((F.size(items) == 2) & mark.eqNullSafe(F.lit(_END_MARK)), F.get(items, 0))

    def read(t: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END_MARK}"]')))
        pair = let(F.try_variant_get(wrapped, "$", "array<variant>"), first_of_pair)
        return F.when(F.ltrim(t, F.lit(" \t\r\n")).startswith("{"), pair)

    return let(text, read)


def with_json_object(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The rows with `json_object` of the text as a column, in projections instead of bound values."""
    rows = df.withColumn("_text", text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("_text"), F.lit(f',"{_END_MARK}"]')))
    rows = rows.withColumn("_items", F.try_variant_get(wrapped, "$", "array<variant>"))
    mark = F.try_variant_get(F.get("_items", 1), "$", "string")
    whole = F.ltrim(F.col("_text"), F.lit(" \t\r\n")).startswith("{") & (F.size("_items") == 2) & mark.eqNullSafe(F.lit(_END_MARK))
    return rows.withColumn(name, F.when(whole, F.get("_items", 0))).drop("_text", "_items")


def json_field(text: Column, name: str) -> Column:
    """A field of a text that is one JSON object, rendered as string; NULL when absent."""
    return F.try_variant_get(json_object(text), f"$.{name}", "string")
