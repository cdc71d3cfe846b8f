"""DuckDB expression builders for the oracle SQL.

Independent restatements of the answer functions in DuckDB SQL (RE2 regex,
list lambdas).  Each returns SQL text for an expression over SQL text inputs.
"""

from __future__ import annotations

WS = r"[\t\n\v\f\r ]"
NUM = rf"^{WS}*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{WS}*$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def num(x: str) -> str:
    """guarded string -> double"""
    return f"(CASE WHEN regexp_matches({x}, {q(NUM)}) THEN try_cast({x} AS double) END)"


def last_match(x: str, pat: str, group: int = 1) -> str:
    return f"list_extract(regexp_extract_all({x}, {q(pat)}, {group}), -1)"


def trunc_in_range(d: str, lo: int = 0, hi: int = 99999) -> str:
    return f"(CASE WHEN ({d}) > {lo - 1} AND ({d}) < {hi + 1} THEN cast(trunc({d}) AS bigint) END)"


def d1(x: str) -> str:
    """first balanced \\boxed{...}"""
    p1 = f"instr({x}, {q(chr(92) + 'boxed{')})"
    p2 = f"instr({x}, {q(chr(92) + 'boxed {')})"
    start = f"(CASE WHEN {p1} > 0 THEN {p1} + 7 WHEN {p2} > 0 THEN {p2} + 8 END)"
    rest = f"substr({x}, {start})"
    toks = f"regexp_extract_all({rest}, '[{{}}]|[^{{}}]+')"
    fold = (f"list_reduce({toks}, lambda acc, t: {{'depth': CASE WHEN acc.done THEN acc.depth "
            f"WHEN t = '{{' THEN acc.depth + 1 WHEN t = '}}' THEN acc.depth - 1 ELSE acc.depth END, "
            f"'n': CASE WHEN acc.done OR (t = '}}' AND acc.depth = 1) THEN acc.n ELSE acc.n + length(t) END, "
            f"'done': acc.done OR (t = '}}' AND acc.depth = 1)}}, "
            f"{{'depth': 1, 'n': 0, 'done': false}})")
    return (f"(CASE WHEN {start} IS NOT NULL AND ({fold}).done "
            f"THEN {strip(f'substr({rest}, 1, ({fold}).n)')} END)")


BOXED = r"\\boxed\{([^}]+)\}"


def d3(x: str) -> str:
    m = strip(last_match(x, BOXED))
    return f"regexp_replace({m}, '^\\$+|\\$+$', '', 'g')"


def d4(x: str, hi: int = 99999) -> str:
    def as_int(m):
        dg = f"replace({m}, ',', '')"
        v = f"(CASE WHEN {dg} <> '' THEN try_cast({dg} AS decimal(38,0)) END)"
        return f"(CASE WHEN {v} >= 0 AND {v} <= {hi} THEN cast({v} AS bigint) END)"
    b = last_match(x, r"\\boxed\s*\{\s*([0-9,]+)\s*\}")
    f = last_match(f"lower({x})", r"final\s+answer\s+is\s*([0-9,]+)")
    return f"coalesce({as_int(b)}, {as_int(f)})"


def d9(x: str) -> str:
    s = strip(x)
    s = f"regexp_replace({s}, '\\.0+$', '')"
    s = strip(f"replace({s}, '$', '')")
    s = f"regexp_replace({s}, {q(r'\\text\{([^}]+)\}')}, '\\1', 'g')"
    s = f"replace(replace({s}, {q(chr(92) + 'left')}, ''), {q(chr(92) + 'right')}, '')"
    s = f"regexp_replace({s}, '{WS}+', '', 'g')"
    return f"lower({s})"


def d10(s: str) -> str:
    parts = f"string_split({s}, '/')"
    a = num(f"{parts}[1]")
    b = num(f"{parts}[2]")
    return (f"coalesce({num(s)}, CASE WHEN len({parts}) = 2 AND {a} IS NOT NULL AND {b} <> 0 "
            f"THEN {a} / {b} END)")


def d11(p: str, g: str, tol: str = "1e-6") -> str:
    return (f"(CASE WHEN ({p}) IS NULL OR ({g}) IS NULL THEN NULL WHEN ({g}) = 0 THEN abs({p}) < {tol} "
            f"ELSE abs(({p}) - ({g})) / (abs({g}) + 1e-10) < {tol} END)")


def d12_norm(pn: str, gn: str) -> str:
    """answers_match on already-normalised SQL expressions"""
    frac = r"\\frac\{([^}]+)\}\{([^}]+)\}"
    pc = f"regexp_replace({pn}, {q(frac)}, '\\1/\\2', 'g')"
    gc = f"regexp_replace({gn}, {q(frac)}, '\\1/\\2', 'g')"
    n1 = d11(d10(pn), d10(gn))
    n2 = d11(d10(pc), d10(gc))
    return (f"(CASE WHEN ({pn}) IS NULL OR ({gn}) IS NULL THEN false WHEN ({pn}) = ({gn}) THEN true "
            f"WHEN {n1} IS NOT NULL THEN {n1} WHEN ({pc}) = ({gc}) THEN true "
            f"WHEN {n2} IS NOT NULL THEN {n2} ELSE false END)")


def d12(p: str, g: str) -> str:
    return d12_norm(d9(p), d9(g))


def d13(p: str, g: str) -> str:
    return (f"(CASE WHEN ({p}) IS NULL OR ({g}) IS NULL THEN false "
            f"WHEN {num(p)} IS NOT NULL AND {num(g)} IS NOT NULL THEN abs({num(p)} - {num(g)}) < 1e-6 "
            f"ELSE {strip(p)} = {strip(g)} END)")


def d15(x: str) -> str:
    """number set (list, distinct) -- look-around-free formulation"""
    fr = r"\\frac\{([0-9]+)\}\{([0-9]+)\}"
    fr_all = f"regexp_extract_all({x}, {q(fr)}, 0)"
    fr_vals = (f"list_transform(list_filter({fr_all}, lambda m: try_cast(regexp_extract(m, {q(fr)}, 2) AS double) <> 0), "
               f"lambda m: round(try_cast(regexp_extract(m, {q(fr)}, 1) AS double) / "
               f"try_cast(regexp_extract(m, {q(fr)}, 2) AS double), 4))")
    t2 = f"regexp_replace({x}, '[a-zA-Z]+', 'L', 'g')"
    plain = f"regexp_extract_all({t2}, 'L[0-9]|([0-9]+\\.?[0-9]*)(?:[^L]|$)', 1)"
    pv = (f"list_transform(list_filter(list_transform({plain}, lambda m: try_cast(m AS double)), "
          f"lambda v: v > 0 AND v <= 9999), lambda v: round(v, 4))")
    return f"list_distinct(list_concat({fr_vals}, {pv}))"


STEP_WORDS = ["therefore", "thus", "so ", "we have", "note that", "since",
              "because", "=", "hence", "gives", "compute", "calculate"]
BROKEN = ["Timed out", "NameError", "Traceback", "Error:", "Exception", "not defined",
          "SyntaxError", "AttributeError", "IndexError", "KeyError", "RuntimeError",
          "ZeroDivisionError"]


def has_steps(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {q(w)})" for w in STEP_WORDS) + ")"


def valid_gold(x: str) -> str:
    return (f"(coalesce(length({x}), 0) >= 50 AND NOT ("
            + " OR ".join(f"contains({x}, {q(w)})" for w in BROKEN) + "))")


def depth_words(x: str) -> str:
    return f"greatest(1, len(regexp_extract_all(lower({x}), '(therefore|thus|so |hence|we get|we have|gives|equals|=)', 0)))"


def r6(x: str) -> str:
    return f"round({x}, 6)"
