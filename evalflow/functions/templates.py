"""Prompt templates and their compilation into one string expression.

Slots are ``{name}``; ``{{`` and ``}}`` are literal braces. The wording is ours.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANSWER_JSON = '{{"gen_sql": "<SQL>"}}'

GENERATE = f"""Write one SQL query for the question below.

Question: {{question}}
Tables:
{{schema}}

Use only the tables and columns listed. Answer with JSON only, in this form:
{_ANSWER_JSON}"""

# The markers [QUESTION], [/QUESTION] and [SQL], and the slot names of all templates.
GENERATE_TAGGED = """[QUESTION]{question}[/QUESTION]

Nothing but these tables can be read:
{schema}

One query has to return what [QUESTION]{question}[/QUESTION] asks for. Begin it after the mark and add no prose.
[SQL]
"""

GENERATE_REASONING = """Answer the request with SQL and explain yourself.
Return JSON with the fields "reasoning", "description" and "gen_sql" and nothing else.

{format_instructions}

Request: "{question}"
Tables:
{schema}
"""

GENERATE_LONG = f"""A person who cannot write SQL asks about the data below. Give the query that gets the answer.

What is asked: {{question}}

Data:
{{schema}}

An output column for every piece of information that is asked for, no more. Counts and sums need a name of their own.
If a word of the question fits several columns, take the one whose table is already joined.

For instance, over city(id, title, country, people) the question "largest city of each country" becomes
{{{{"gen_sql": "SELECT country, MAX_BY(title, people) AS largest FROM city GROUP BY country"}}}}

{_ANSWER_JSON}"""

GENERATE_DIALECT = f"""Write one {{dbms}} query for the question below.

Question: {{question}}
Tables:
{{schema}}
{{dbms_instructions}}
Keep to the rules of {{dbms}}. Answer with JSON only, in this form:
{_ANSWER_JSON}"""

GENERATE_TAGGED_LONG = """### Data
{schema}

### Wanted
{question}

### Conventions
One statement without comments. Spell out the join conditions. Sort only where the question speaks of an order.

### Statement for: {question}
```sql
"""

GENERATE_KOREAN = """아래 테이블 정의와 질문을 읽고 알맞은 SQL을 작성하세요.

테이블 정의:
{ddl}

질문:
{question}

SQL:
{sql}"""

VERDICT = """Decide whether the generated query answers the question.
Queries may be written differently; what counts is that both return the same result.
Answer with JSON: {{"resolve_yn": "yes"}} or {{"resolve_yn": "no"}}

Tables: {schema}
Question: {question}
Reference query: {gt_sql}
Generated query: {gen_sql}"""

VERDICT_TOLERANT = """A student wrote the second query as an exercise; the first is the teacher's. Mark it.
Formatting and spelling variants that the database reads alike cost no marks. A different filter, join or output does.
Mark as JSON, full marks {{"resolve_yn": "yes"}}, anything less {{"resolve_yn": "no"}}

Exercise: {question}
Over: {schema}
Teacher: {gt_sql}
Student: {gen_sql}"""

VERDICT_RESULT_SET = """Imagine small example tables with duplicates, missing values and unmatched keys, and run both queries over them.
If you find one example where the outputs differ in their rows, the verdict is no; the order counts only where one is asked for.
{{"resolve_yn": "yes"}} or {{"resolve_yn": "no"}}, as JSON

Tables: {schema}
Asked: {question}
First: {gt_sql}
Second: {gen_sql}"""

VERDICT_INTENT = """Say in one sentence for yourself what each query finds out. Are the sentences the same, and do they answer the question?
Return JSON only: {{"resolve_yn": "yes"}} if so, else {{"resolve_yn": "no"}}

Question: {question}
Tables: {schema}
Query A: {gt_sql}
Query B: {gen_sql}"""

TRANSLATE = """Translate the question from Korean to English.
In the SQL translate string literals and comments only; leave names, keywords and numbers as they are.
Answer with JSON: {{"question": "<question in English>", "sql_query": "<SQL>"}}

Question: {question}
SQL: {answer}"""

LATENCY_PROBE = "Summarise the following text. "

TEMPLATES: dict[str, str] = {
    "generate": GENERATE,
    "generate_tagged": GENERATE_TAGGED,
    "generate_reasoning": GENERATE_REASONING,
    "generate_long": GENERATE_LONG,
    "generate_dialect": GENERATE_DIALECT,
    "generate_tagged_long": GENERATE_TAGGED_LONG,
    "generate_korean": GENERATE_KOREAN,
    "verdict": VERDICT,
    "verdict_tolerant": VERDICT_TOLERANT,
    "verdict_result_set": VERDICT_RESULT_SET,
    "verdict_intent": VERDICT_INTENT,
    "translate": TRANSLATE,
}


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """The template with its slots filled per row; a slot that is absent or NULL becomes ''.

    The template is split once when the plan is built, so a filled-in value is never searched
    for slots again.
    """
    pieces = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if slot in slots:
            pieces.append(F.coalesce(slots[slot].cast("string"), F.lit("")))
    return F.concat(*pieces)
