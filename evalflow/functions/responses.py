"""Reading fields out of saved model responses."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalflow.functions.sql_text import generated_sql
from evalflow.functions.text import json_field, json_object, let, strip
from evalflow.functions.verdict import strict_verdict


def variant_content(response: Column) -> Column:
    """Answer text of a response VARIANT in chat shape (preferred), prompt shape or bare message shape."""
    chat = F.try_variant_get(response, "$.choices[0].message.content", "string")
    plain = F.coalesce(
        F.try_variant_get(response, "$.response", "string"),
        F.try_variant_get(response, "$.message.content", "string"),
    )
    has_choice = F.try_variant_get(response, "$.choices[0]", "variant").isNotNull()
    return F.when(has_choice, chat).otherwise(plain)


def response_content(response_json: Column) -> Column:
    """Answer text of a response given as JSON text."""
    return let(json_object(response_json), variant_content)


def output_field(result: Column, name: str) -> Column:
    """Field ``name`` of a processed result; anything else passes through unchanged."""
    return F.coalesce(json_field(result, name), result)


def translation(content: Column, compat: bool = False) -> Column:
    """Struct ``e_question, e_answer`` of a translation answer; NULL fields when it is no JSON.

    ``compat=True`` gives the empty strings that result when the whole text is wrapped
    before its fields are read.
    """
    if compat:
        return F.struct(F.lit("").alias("e_question"), F.lit("").alias("e_answer"))

    def read(answer: Column) -> Column:
        def field(name: str) -> Column:
            value = F.coalesce(F.try_variant_get(answer, f"$.{name}", "string"), F.lit(""))
            return F.when(answer.isNotNull(), value)

        return F.struct(field("question").alias("e_question"), field("sql_query").alias("e_answer"))

    return let(json_object(content), read)


def _python_literal_prompts(texts: pd.Series) -> pd.DataFrame:
    """Prompts inside Python dict literals (their True/False/None and quoting are no JSON)."""

    def read(text):
        if text is None:
            return False, None
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return False, None
        if not isinstance(value, dict):
            return True, None
        prompt = value.get("prompt")
        if prompt is None and isinstance(value.get("request"), dict):
            prompt = value["request"].get("prompt")
        return True, None if prompt is None else str(prompt)

    return pd.DataFrame([read(t) for t in texts], columns=["parsed", "prompt"])


#: A quoted string, a constant, a number, a mark or white space of a Python dict literal.
_LITERAL_TOKEN = (
    r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|True|False|None|[-0-9.eE]++|[{}\[\],:]|[ \t\r\n]++"""
)
_CONSTANTS = {"True": "true", "False": "false", "None": "null"}


def _json_string(token: Column) -> Column:
    """A quoted Python string as a JSON string; NULL where it has escapes that JSON does not know, or is broken."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    parts = F.regexp_extract_all(inner, F.lit(r"(?s)\\.|[^\\]++"), F.lit(0))

    def part(p: Column) -> Column:
        return (
            F.when(p == "\\'", F.lit("'"))
            .when(p.startswith("\\"), F.when(F.substr(p, F.lit(2), F.lit(1)).isin(*'nrtbf\\"'), p))
            .when(~p.rlike(r"[\n\r]"), F.replace(p, F.lit('"'), F.lit('\\"')))
        )

    joined = let(F.transform(parts, part), lambda ps: F.when(F.forall(ps, lambda p: p.isNotNull()), F.array_join(ps, "")))
    return F.concat(F.lit('"'), joined, F.lit('"'))


def literal_object(text: Column) -> Column:
    """VARIANT of a Python dict literal made of strings, numbers, constants, lists and dicts; NULL for anything else.

    One linear pass cuts the text into tokens, which are written as JSON. What JSON cannot say in the same way (other
    escapes, tuples, repeated keys, trailing commas) is left out.
    """

    def token(t: Column) -> Column:
        constant = F.coalesce(*[F.when(t == python, F.lit(json)) for python, json in _CONSTANTS.items()], t)
        return F.when(t.startswith("'") | t.startswith('"'), _json_string(t)).otherwise(constant)

    # No lambda refers to a variable of an enclosing one: the optimizer could not compare such calls.
    def whole(cut: Column) -> Column:
        ts = cut["tokens"]
        done = let(F.transform(ts, token), lambda js: F.when(F.forall(js, lambda j: j.isNotNull()), F.array_join(js, "")))
        return F.when(F.length(F.array_join(ts, "")) == F.length(cut["text"]), done)

    tokens = F.regexp_extract_all(text, F.lit(_LITERAL_TOKEN), F.lit(0))
    return json_object(let(F.struct(tokens.alias("tokens"), text.alias("text")), whole))


def _prompt_of(request: Column) -> Column:
    return F.coalesce(F.try_variant_get(request, "$.prompt", "string"), F.try_variant_get(request, "$.request.prompt", "string"))


def _has_text_prompt(request: Column) -> Column:
    """Whether the prompt is a text or missing; numbers and lists are printed in their own way by Python."""

    def plain(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(request, path, "variant"))
        return F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))

    return F.when(request.isNotNull(), F.when(plain("$.prompt"), plain("$.request.prompt")))


def recovered_prompt(prompt: Column, fallback: bool = True) -> Column:
    """Prompt text behind a stringified request; text that is no dict stays as it is.

    JSON and plain Python literals are read in the JVM. Only dict-like texts that are neither are sent to Python; with
    ``fallback=False`` those stay as they are and the plan has no Python in it.
    """
    request = json_object(prompt)
    dict_like = F.ltrim(prompt, F.lit(" \t\r\n")).startswith("{")
    found = let(
        F.when(dict_like, F.when(request.isNull(), prompt)),
        lambda text: let(literal_object(text), lambda v: F.when(_has_text_prompt(v), F.struct(_prompt_of(v).alias("prompt")))),
    )
    chain = F.when(request.isNotNull(), let(request, _prompt_of)).when(found.isNotNull(), found["prompt"])
    if not fallback:
        return chain.otherwise(prompt)
    read_literal = F.pandas_udf(_python_literal_prompts, "struct<parsed: boolean, prompt: string>")
    literal = read_literal(F.when(dict_like, F.when(request.isNull(), F.when(found.isNull(), prompt))))
    return chain.when(literal["parsed"], literal["prompt"]).otherwise(prompt)


def catalogue_models(catalogue_json: Column) -> Column:
    """Array of model names in a saved model-catalogue response."""
    return F.from_json(catalogue_json, "models array<struct<name: string>>")["models"]["name"]


def listed_models(listing: Column) -> Column:
    """Array of model names in a printed listing: the first word of every line after the header."""
    lines = F.filter(F.slice(F.split(listing, "\n"), 2, 1 << 30), lambda line: strip(line) != "")
    return F.transform(lines, lambda line: F.split_part(line, F.lit(" "), F.lit(1)))


def _sql_result(content: Column) -> Column:
    return generated_sql(content)["gen_sql"]


def _translation_result(content: Column) -> Column:
    return strip(content)


PROCESSORS: dict[str, Callable[[Column], Column]] = {
    "generate": _sql_result,
    "evaluation": strict_verdict,
    "translate": _translation_result,
}


def processor_for(mode: str) -> Callable[[Column], Column]:
    """Response expression of a mode; an unknown mode reads SQL."""
    return PROCESSORS.get(mode, _sql_result)
