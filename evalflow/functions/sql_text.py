"""Extraction of SQL from free-text model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalflow.functions.text import FENCE, blank_to_null, fenced_blocks, first_longest, json_field, json_object, let, strip, word_pattern

_SQL_FENCE = "(?s)```sql.*?```"
# The word SELECT and what follows, at least one character, up to a semicolon.
_SELECT = word_pattern("select") + ".[^;]*;?"


def _sql_fence(content: Column) -> Column:
    return let(
        F.regexp_substr(content, F.lit(_SQL_FENCE)),
        lambda fence: strip(F.substr(fence, F.lit(7), F.length(fence) - 9)),
    )


def _fence(content: Column) -> Column:
    found = F.coalesce(F.when(content.contains("```sql"), _sql_fence(content)), first_longest(fenced_blocks(content)))
    return F.when(content.contains(FENCE), found)


def _select_statement(content: Column) -> Column:
    return strip(F.regexp_substr(content, F.lit(_SELECT)))


def extract_sql_without_json(content: Column) -> Column:
    """SQL in a text: sql fence, else longest fence, else first SELECT, else ''.

    Every step yields NULL when it does not match, so a fence that matched but is empty ends
    the search with an empty string.
    """
    search = lambda text: F.coalesce(_fence(text), _select_statement(text), F.lit(""))
    return F.when(content.isNotNull(), let(content, search))


def extract_sql(content: Column) -> Column:
    """The same search with JSON ``gen_sql`` as its last step."""

    def search(text: Column) -> Column:
        return F.coalesce(_fence(text), _select_statement(text), json_field(text, "gen_sql"), F.lit(""))

    return F.when(content.isNotNull(), let(content, search))


def generated_sql(content: Column) -> Column:
    """Struct ``gen_sql, reasoning, description, parse_status`` of a generation answer.

    A JSON answer with ``gen_sql`` wins and carries its reasoning fields along; otherwise the
    SQL is extracted from the text. Status: ``ok``, ``empty`` (no content) or ``rejected``.
    """

    def read(answer: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(answer, f"$.{name}", "string")

        return F.struct(
            field("gen_sql").alias("gen_sql"),
            F.when(field("gen_sql").isNotNull(), field("reasoning")).alias("reasoning"),
            F.when(field("gen_sql").isNotNull(), field("description")).alias("description"),
        )

    def finish(text: Column, parsed: Column) -> Column:
        found = F.coalesce(parsed["gen_sql"], blank_to_null(extract_sql_without_json(text)))
        return let(
            found,
            lambda sql: F.struct(
                sql.alias("gen_sql"),
                parsed["reasoning"].alias("reasoning"),
                parsed["description"].alias("description"),
                F.when(F.coalesce(text, F.lit("")) == "", "empty")
                .when(sql.isNull(), "rejected")
                .otherwise("ok")
                .alias("parse_status"),
            ),
        )

    return let(content, lambda text: let(let(json_object(text), read), lambda parsed: finish(text, parsed)))
