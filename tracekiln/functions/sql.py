"""The answer functions in SQL: ``register(spark)`` makes them temporary SQL functions of a session.

Their bodies are SQL expressions, so Catalyst inlines them: a query that calls them has no Python
and is optimised as if it were written out.  Scalar ones (D1, D3, D4, D9, D10, D12, D13, D18) are called like built-in functions,
table functions (D15, D21) in a ``LATERAL`` join::

    register(spark)
    spark.sql("SELECT id, trace_answers_match(trace_boxed_first(response), gold) FROM attempts")
    spark.sql("SELECT id, n.number FROM problems, LATERAL trace_numbers(solution) n")

SQL functions cannot be called inside lambda functions; there, use the Column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.readers import FALLBACK_LEMMA
from . import answers as A

PREFIX = "trace_"


def _re(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, r'^\s+|\s+$', '')"


def _number(x: str) -> str:
    return f"case when {x} rlike {_re(A.NUMERIC_RE)} then try_cast({x} as double) end"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _last(text: str, pattern: str) -> str:
    return f"try_element_at(regexp_extract_all({text}, {_re(pattern)}, 1), -1)"


def _boxed_first(text: str) -> str:
    rest = rf"""case when locate(r'\boxed{{', {text}) > 0 then substr({text}, locate(r'\boxed{{', {text}) + 7)
                     when locate(r'\boxed {{', {text}) > 0 then substr({text}, locate(r'\boxed {{', {text}) + 8) end"""
    closes = "acc.done or (x = '}' and acc.depth = 1)"
    fold = f"""aggregate(regexp_extract_all(rest, r'[{{}}]|[^{{}}]+', 0), named_struct('depth', 1, 'n', 0, 'done', false), (acc, x) -> named_struct(
        'depth', case when x = '{{' then acc.depth + 1 when x = '}}' then acc.depth - 1 else acc.depth end,
        'n', case when {closes} then acc.n else acc.n + length(x) end, 'done', {closes}))"""
    return _bind(rest, "rest", _bind(fold, "found", f"case when found.done then {_strip('substr(rest, 1, found.n)')} end"))


def _boxed_last(text: str) -> str:
    return rf"regexp_replace({_strip(_last(text, A.BOXED_SIMPLE_RE))}, r'^\$+|\$+$', '')"


def _boxed_int(text: str) -> str:
    value = lambda m: _bind(f"replace({m}, ',', '')", "digits", r"case when digits rlike r'^0*\d{1,5}$' then cast(digits as bigint) end")
    return f"coalesce({value(_last(text, A.BOXED_INT_RE))}, {value(_last(text, A.FINAL_ANSWER_RE))})"


def _normalize(x: str) -> str:
    s = rf"regexp_replace({_strip(x)}, r'\.0+$', '')"
    s = rf"regexp_replace({_strip(f'''replace({s}, '$', '')''')}, r'\\text\{{([^}}]+)\}}', r'$1')"
    return rf"lower(regexp_replace(replace(replace({s}, r'\left', ''), r'\right', ''), r'\s+', ''))"


def _to_number(x: str) -> str:
    part = lambda k: f"try_element_at(split({x}, '/', -1), {k})"
    fraction = f"case when size(split({x}, '/', -1)) = 2 and ab.a is not null and ab.b <> 0 then try_divide(ab.a, ab.b) end"
    return f"coalesce({_number(x)}, {_bind(f'named_struct({chr(39)}a{chr(39)}, {_number(part(1))}, {chr(39)}b{chr(39)}, {_number(part(2))})', 'ab', fraction)})"


def _equal(p: str, g: str) -> str:
    return f"case when {p} is null or {g} is null then null when {g} = 0 then abs({p}) < 1e-6D else abs({p} - {g}) / (abs({g}) + 1e-10D) < 1e-6D end"


def _match(pred: str, gold: str) -> str:
    slash = lambda x: f"regexp_replace({x}, {_re(A.FRAC_RE)}, r'$1/$2')"
    numbers = f"named_struct('p', {_to_number('s.p')}, 'g', {_to_number('s.g')}, 'pc', {slash('s.p')}, 'gc', {slash('s.g')})"
    fractions = f"named_struct('p', {_to_number('t.pc')}, 'g', {_to_number('t.gc')})"
    decide = f"""case when s.p is null or s.g is null then false when s.p = s.g then true
        when t.p is not null and t.g is not null then {_equal('t.p', 't.g')} when t.pc = t.gc then true
        when u.p is not null and u.g is not null then {_equal('u.p', 'u.g')} else false end"""
    return _bind(f"named_struct('p', {_normalize(pred)}, 'g', {_normalize(gold)})", "s", _bind(numbers, "t", _bind(fractions, "u", decide)))


def _simple(pred: str, gold: str) -> str:
    return f"""case when {pred} is null or {gold} is null then false
        when ({_number(pred)}) is not null and ({_number(gold)}) is not null then abs(({_number(pred)}) - ({_number(gold)})) < 1e-6D
        else {_strip(pred)} = {_strip(gold)} end"""


def _last_int(text: str) -> str:
    return _bind(f"try_cast({_last(text, r'\b(\d+)\b')} as decimal(38, 0))", "v", "case when v >= 0 and v <= 99999 then cast(v as bigint) end")


def _numbers(text: str) -> str:
    part = lambda k: f"try_cast(regexp_extract(f, {_re(A.FRAC_INT_RE)}, {k}) as double)"
    fractions = f"transform(filter(transform(regexp_extract_all({text}, {_re(A.FRAC_INT_RE)}, 0), f -> named_struct('a', {part(1)}, 'b', {part(2)})), s -> s.b <> 0), s -> round(try_divide(s.a, s.b), 4))"
    plain = f"transform(filter(transform(regexp_extract_all({text}, {_re(A.PLAIN_NUMBER_RE)}, 1), m -> try_cast(m as double)), v -> v > 0 and v <= 9999), v -> round(v, 4))"
    return f"array_distinct(concat({fractions}, {plain}))"


def _lemmas(text: str) -> str:
    bodies = rf"regexp_extract_all({text}, r'(?is)\*\*Lemma\s*\d+\*\*:?\s*(.+?)(?=\*\*Lemma|$)', 1)"
    lines = rf"split({_strip('b')}, r'\n')"
    one = rf"""named_struct('statement', regexp_replace(l[0], r'^[- ]+|[- ]+$', ''),
        'verification_plan', {_strip("array_join(slice(l, 2, size(l)), '" + chr(92) + "n')")})"""
    fallback = f"array(named_struct('statement', '{FALLBACK_LEMMA[0]}', 'verification_plan', '{FALLBACK_LEMMA[1]}'))"
    return _bind(bodies, "bodies", f"case when size(bodies) > 0 then transform(bodies, b -> {_bind(lines, 'l', one)}) else {fallback} end")


SCALARS = {
    "boxed_first": ("text string", "string", _boxed_first("text")),
    "boxed_last": ("text string", "string", _boxed_last("text")),
    "boxed_int": ("text string", "bigint", _boxed_int("text")),
    "normalize_answer": ("answer string", "string", _normalize("answer")),
    "to_number": ("answer string", "double", _to_number("answer")),
    "answers_match": ("pred string, gold string", "boolean", _match("pred", "gold")),
    "check_simple": ("pred string, gold string", "boolean", _simple("pred", "gold")),
    "last_int": ("text string", "bigint", _last_int("text")),
}
TABLES = {
    "numbers": ("text string", "number double", f"SELECT explode({_numbers('text')})"),
    "lemmas": ("text string", "lemma_no int, statement string, verification_plan string",
               f"SELECT pos + 1, l.statement, l.verification_plan FROM (SELECT posexplode({_lemmas('text')}) AS (pos, l))"),
}


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Make the functions temporary functions of the session, with ``prefix`` before their names; the names."""
    for name, (given, returned, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {returned} RETURN {body}")
    for name, (given, returned, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS TABLE({returned}) RETURN {body}")
    return [prefix + n for n in (*SCALARS, *TABLES)]
