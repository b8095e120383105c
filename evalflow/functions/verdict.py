"""The three yes/no readings: strict (answers), lenient (raw logs), normalising (verdict tables).

They differ on purpose; the order of the steps is their meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalflow.functions.text import blank_to_null, json_field, let, strip, unfenced, unicode_pattern, word_pattern

_KEYED_YES = unicode_pattern(r"""(?iu)['"]resolve_yn['"]:\s*['"]yes['"]""")
_KEYED_NO = unicode_pattern(r"""(?iu)['"]resolve_yn['"]:\s*['"]no['"]""")
_KEY = r"[rR](?iu:esolve_yn)"
_LOOSE_KEY = _KEY + unicode_pattern(r"""\s*+(?::\s*+)?['"]?(?iu:(yes|no))""")
_WORD_YES = word_pattern("yes")
_WORD_NO = word_pattern("no")


def _json_verdict(text: Column) -> Column:
    return strip(F.lower(json_field(text, "resolve_yn")))


def _keyed_verdict(text: Column) -> Column:
    return F.when(text.rlike(_KEYED_YES), "yes").when(text.rlike(_KEYED_NO), "no")


def _loose_key_verdict(text: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(text, _LOOSE_KEY, 1)))


def _strict(body: Column) -> Column:
    return F.coalesce(
        _json_verdict(body),
        F.when(body.rlike(_KEY), F.coalesce(_keyed_verdict(body), _loose_key_verdict(body))),
        F.when(body.rlike(_WORD_YES), "yes"),
        F.when(body.rlike(_WORD_NO), "no"),
        F.lit("unknown"),
    )


def strict_verdict(content: Column) -> Column:
    """Verdict of an answer; only the first code fence is read, if there is one."""
    return F.when(content.isNotNull(), let(unfenced(content), _strict))


def lenient_verdict(content: Column) -> Column:
    """Verdict of a raw log answer: the words also count inside other words."""

    def read(text: Column) -> Column:
        word = let(
            F.lower(text),
            lambda low: F.when(low.contains("yes"), "yes").when(low.contains("no"), "no").otherwise("unknown"),
        )
        return F.coalesce(_json_verdict(text), _loose_key_verdict(text), word)

    return F.when(content.isNotNull(), let(content, read))


def normalized_verdict(value: Column) -> Column:
    """Bring a stored verdict to yes / no / unknown; values of no known form stay as they are."""

    def read(text: Column) -> Column:
        low = F.lower(text)
        tidy = strip(low)
        return F.coalesce(
            F.when(tidy.isin("yes", "no", "unknown"), tidy),
            F.when(low.startswith("yes"), "yes"),
            F.when(low.startswith("no"), "no"),
            F.when(text.contains("'resolve_yn': 'yes'") | text.contains('"resolve_yn": "yes"'), "yes"),
            F.when(text.contains("'resolve_yn': 'no'") | text.contains('"resolve_yn": "no"'), "no"),
            _json_verdict(text),
            text,
        )

    return let(value, read)
