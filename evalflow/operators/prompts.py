"""Prompts, provider-shaped requests and their token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.functions import templates
from evalflow.functions.dialect import dialect_hint, dialect_label
from evalflow.functions.naming import is_chat_model
from evalflow.functions.tokens import TokenCounter, request_cost, word_tokens
from evalflow.sources.datasets import ColumnRoles

def _model(model: str | Column) -> Column:
    return F.lit(model) if isinstance(model, str) else model


def slots_of(df: DataFrame, roles: ColumnRoles) -> dict[str, Column]:
    """Template slots that the columns of ``df`` can fill."""
    sources = {
        "schema": roles.context,
        "ddl": roles.context,
        "question": roles.question,
        "gt_sql": roles.answer,
        "sql": roles.answer,
        "answer": roles.answer,
        "gen_sql": roles.output,
    }
    slots = {slot: F.col(name) for slot, name in sources.items() if name in df.columns}
    if "dbms" in df.columns:
        listed = dict(df.dtypes)["dbms"].startswith("array")
        label = dialect_label(F.col("dbms")) if listed else F.col("dbms")
        slots["dbms"] = F.coalesce(label, F.lit("SQL"))
        slots["dbms_instructions"] = dialect_hint(label)
    return slots


def render_prompts(
    df: DataFrame, template: str, roles: ColumnRoles | None = None, name: str = "prompt", **extra: Column
) -> DataFrame:
    """Add the prompt of a named template (or a template text)."""
    slots = {**slots_of(df, roles or ColumnRoles()), **extra}
    return df.withColumn(name, templates.fill(templates.TEMPLATES.get(template, template), slots))


def generation_prompts(
    df: DataFrame, model: str | Column, roles: ColumnRoles | None = None, name: str = "prompt"
) -> DataFrame:
    """Generation prompt; models named sqlcoder* use the tagged template."""
    slots = slots_of(df, roles or ColumnRoles())
    tagged = F.lower(_model(model)).startswith("sqlcoder")
    prompt = F.when(tagged, templates.fill(templates.GENERATE_TAGGED, slots)).otherwise(
        templates.fill(templates.GENERATE, slots)
    )
    return df.withColumn(name, prompt)


def verdict_prompts(df: DataFrame, roles: ColumnRoles | None = None, name: str = "prompt") -> DataFrame:
    return render_prompts(df, "verdict", roles, name)


def translation_prompts(df: DataFrame, roles: ColumnRoles | None = None, name: str = "prompt") -> DataFrame:
    """Translation prompt of the input column; the SQL slot is always the column ``answer``."""
    roles = roles or ColumnRoles()
    text = F.col(roles.input) if roles.input in df.columns else F.lit("")
    answer = F.col("answer") if "answer" in df.columns else F.lit("")
    return df.withColumn(name, templates.fill(templates.TRANSLATE, {"question": text, "answer": answer}))


def training_text(df: DataFrame, model: str | Column, roles: ColumnRoles | None = None) -> DataFrame:
    """Add ``text``: the generation prompt followed by the answer."""
    roles = roles or ColumnRoles()
    prompted = generation_prompts(df, model, roles, "_prompt")
    answer = F.coalesce(F.col(roles.answer), F.lit(""))
    return prompted.withColumn("text", F.concat("_prompt", F.lit("\n"), answer)).drop("_prompt")


def probe_prompts(df: DataFrame, length: int | Column, name: str = "prompt", compat: bool = False) -> DataFrame:
    """Latency-probe prompt of exactly ``length`` characters; ``compat`` only prints the length."""
    size = F.lit(length) if isinstance(length, int) else length
    if compat:
        return df.withColumn(name, F.format_string(templates.LATENCY_PROBE + "Its length is about %d.", size))
    repeats = F.ceil(size / len(templates.LATENCY_PROBE)).cast("int")
    return df.withColumn(name, F.substr(F.repeat(F.lit(templates.LATENCY_PROBE), repeats), F.lit(1), size))


def _answer_format(*fields: str) -> Column:
    kind = F.lit("string")
    return F.struct(
        F.lit("object").alias("type"),
        F.struct(*[F.struct(kind.alias("type")).alias(f) for f in fields]).alias("properties"),
        F.array(*[F.lit(f) for f in fields]).alias("required"),
    )


def answer_format(mode: str, only_sql: bool = True) -> Column | None:
    """JSON schema the answer must follow; None for free text."""
    if mode == "verdict":
        return _answer_format("resolve_yn")
    if mode == "translate":
        return _answer_format("question", "sql_query")
    if mode == "generate":
        return _answer_format("gen_sql") if only_sql else _answer_format("reasoning", "description", "gen_sql")
    if mode == "text":
        return None
    raise ValueError(f"unknown mode {mode!r}")


def build_requests(
    df: DataFrame, model: str | Column, mode: str = "generate", only_sql: bool = True, prompt: str = "prompt"
) -> DataFrame:
    """Add ``model`` and ``request``: the provider-shaped request with unused fields NULL.

    Chat models get one message (role ``user`` for o1-mini, else ``system``) and, when SQL or a
    verdict is wanted, a JSON answer format that o1-mini does not know. Others get the prompt shape.
    """
    name = _model(model)
    chat = is_chat_model(name)
    mini = F.lower(name).startswith("o1-mini")
    role = F.when(mini, "user").otherwise("system")
    message = F.struct(role.alias("role"), F.col(prompt).alias("content"))
    wants_json = F.lit(mode in ("generate", "verdict"))
    fields = [
        name.alias("model"),
        F.when(chat, F.array(message)).alias("messages"),
        F.when(chat & wants_json & ~mini, F.struct(F.lit("json_object").alias("type"))).alias("response_format"),
        F.when(~chat, F.lit(False)).alias("stream"),
        F.when(~chat, F.col(prompt)).alias("prompt"),
    ]
    layout = answer_format(mode, only_sql)
    if layout is not None:
        fields.append(F.when(~chat, layout).alias("format"))
    return df.withColumns({"model": name, "request": F.struct(*fields)})


def request_jobs(df: DataFrame) -> DataFrame:
    """Rows ``task_id, request`` with the request as JSON text; NULL fields are left out."""
    return df.select("task_id", F.to_json("request").alias("request"))


def with_token_cost(
    df: DataFrame,
    endpoint: Column,
    request: str = "request",
    counter: TokenCounter = word_tokens,
    name: str = "tokens",
) -> DataFrame:
    """Add the token estimate of requests given as JSON text or as the struct of ``build_requests``."""
    if dict(df.dtypes)[request] != "string":
        return df.withColumn(name, _struct_cost(df, endpoint, request, counter))
    parsed = F.try_parse_json(F.col(request))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("_req", f"$.{path}", kind)

    def texts(path: str) -> Column:
        """A field that holds one string or a list of strings, as an array."""
        return F.coalesce(field(path, "array<string>"), F.array(field(path, "string")))

    cost = request_cost(
        endpoint,
        messages=field("messages", "array<struct<role: string, content: string, name: string>>"),
        prompts=texts("prompt"),
        inputs=texts("input"),
        max_tokens=field("max_tokens", "bigint"),
        n=field("n", "bigint"),
        counter=counter,
    )
    return df.withColumn("_req", parsed).withColumn(name, cost).drop("_req")


def _struct_cost(df: DataFrame, endpoint: Column, request: str, counter: TokenCounter) -> Column:
    """The estimate from the fields of a request struct, without rendering and parsing it."""
    has = set(df.schema[request].dataType.names)

    def field(name: str, kind: str) -> Column:
        return F.col(f"{request}.{name}") if name in has else F.lit(None).cast(kind)

    def message(m: Column) -> Column:
        return F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("name"))

    return request_cost(
        endpoint,
        messages=F.transform(field("messages", "array<struct<role: string, content: string>>"), message),
        prompts=F.array(field("prompt", "string")),
        inputs=F.array(field("input", "string")),
        max_tokens=field("max_tokens", "bigint"),
        n=field("n", "bigint"),
        counter=counter,
    )
