"""Corpus profiling.

Flag and bucket statistics are conditional aggregates in one scan; keyword
taxonomies compile to one expression per row (no join against a keyword
table); windows only run over already-aggregated, bounded frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as A
from ..functions.text import word_count

# ----------------------------------------------------------------- fixed values
# Domain taxonomy (first declared wins on ties), reference values.
DOMAIN_KEYWORDS = {
    "number_theory": ["prime", "divisib", "modulo", "gcd", "lcm", "congruent",
                      "remainder", "digit", "coprime", "totient", "factorial"],
    "combinatorics": ["choose", "combinat", "permut", "arrange", "subset",
                      "count", "ways", "select", "committee", "distribute",
                      "graph", "coloring", "tournament", "sequence of"],
    "algebra": ["polynomial", "equation", "function", "inequality",
                "maximum", "minimum", "real number", "complex number",
                "functional equation", "recurrence"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area",
                 "perpendicular", "tangent", "chord", "radius",
                 "inscribed", "circumscribed", "coordinate"],
    "number_theory_hard": ["primitive root", "quadratic residue", "p-adic",
                           "lifting the exponent", "zsygmondy"],
}
# Second, smaller taxonomy of the same shape.
DOMAIN_KEYWORDS_SMALL = {
    "number_theory": ["prime", "divisib", "modulo", "gcd", "lcm", "remainder",
                      "digit", "coprime", "factorial", "congruent"],
    "combinatorics": ["choose", "combinat", "permut", "arrange", "count the",
                      "ways", "committee", "distribute", "coloring", "tournament"],
    "algebra": ["polynomial", "functional equation", "inequality", "maximum",
                "minimum", "real number", "recurrence", "sequence"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area",
                 "perpendicular", "tangent", "radius", "inscribed"],
}
# Three more taxonomies of the same shape.
DOMAIN_KEYWORDS_SEQUENCES = {
    "number_theory": ["prime", "divisib", "modulo", "gcd", "lcm", "congruent",
                      "remainder", "digit", "integer", "factor", "coprime",
                      "totient", "primitive root", "quadratic residue"],
    "combinatorics": ["choose", "combinat", "permut", "arrange", "subset",
                      "count", "ways", "select", "committee", "distribute",
                      "graph", "path", "cycle", "coloring", "tournament"],
    "algebra": ["polynomial", "equation", "function", "sequence", "series",
                "inequality", "maximum", "minimum", "real number", "complex",
                "functional equation", "recurrence", "sum of", "product of"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area", "length",
                 "perpendicular", "parallel", "tangent", "chord", "radius",
                 "inscribed", "circumscribed", "coordinate", "point"],
    "sequences": ["sequence", "series", "term", "fibonacci", "arithmetic",
                  "geometric", "recurrence", "limit", "converge"],
}
DOMAIN_KEYWORDS_FUNCTIONAL = {
    "number_theory": ["prime", "divisib", "modulo", "gcd", "lcm",
                      "remainder", "digit", "coprime", "factorial"],
    "combinatorics": ["choose", "combinat", "permut", "arrange",
                      "count", "ways", "select", "committee"],
    "algebra": ["polynomial", "equation", "function", "inequality",
                "maximum", "minimum", "recurrence", "sequence"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area",
                 "perpendicular", "tangent", "chord", "radius"],
    "functional_eq": ["functional equation", "f(x+y)", "g(x+y)", "cauchy"],
}
DOMAIN_KEYWORDS_USABLE = {
    "number_theory": ["prime", "divisib", "modulo", "gcd", "lcm",
                      "remainder", "digit", "coprime", "factorial"],
    "combinatorics": ["choose", "combinat", "permut", "arrange",
                      "count", "ways", "select", "committee"],
    "algebra": ["polynomial", "equation", "function", "inequality",
                "maximum", "minimum", "real number", "recurrence"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area",
                 "perpendicular", "tangent", "chord", "radius"],
    "functional_eq": ["functional equation", "f(x+y)", "f(xy)",
                      "g(x+y)", "cauchy", "f:", "g:"],
}
# The shorter technique list.
TECHNIQUES_SHORT = {
    "modular_arithmetic": ["mod", "modulo", "congruent", "remainder"],
    "inclusion_exclusion": ["inclusion-exclusion", "inclusion exclusion"],
    "generating_functions": ["generating function", "power series"],
    "functional_equations": ["functional equation", "f(x+y)", "g(x+y)"],
    "linear_recurrences": ["recurrence", "a_n =", "linear recurrence"],
    "pigeonhole": ["pigeonhole", "drawer"],
    "invariant": ["invariant", "monovariant"],
    "induction": ["induction", "base case", "inductive"],
    "extremal": ["maximum", "minimum", "extremal", "optimal"],
    "bijection": ["bijection", "one-to-one"],
    "vieta_jumping": ["vieta jumping", "vieta"],
    "am_gm": ["am-gm", "arithmetic mean", "geometric mean"],
    "cauchy_schwarz": ["cauchy-schwarz", "cauchy schwarz"],
    "infinite_descent": ["infinite descent", "well-ordering"],
    "graph_theory": ["graph", "vertex", "edge", "spanning tree"],
    "floor_ceiling": ["floor", "ceiling", "\\lfloor", "\\lceil"],
    "complex_numbers": ["complex number", "roots of unity", "argument"],
    "number_theory_adv": ["lifting the exponent", "lte", "zsygmondy",
                          "primitive root"],
    "polynomial_roots": ["vieta formulas", "factor theorem", "polynomial root"],
}
TECHNIQUES = {
    "modular_arithmetic": ["mod", "modulo", "congruent", "remainder"],
    "tower_exponentiation": ["tower", "a^(b^c)", "power tower", "tetration"],
    "chinese_remainder": ["chinese remainder", "crt", "coprime moduli"],
    "inclusion_exclusion": ["inclusion-exclusion", "inclusion exclusion", "PIE"],
    "generating_functions": ["generating function", "power series", "ogf", "egf"],
    "functional_equations": ["functional equation", "f(x+y)", "f(xy)", "cauchy"],
    "linear_recurrences": ["recurrence", "a_n =", "linear recurrence", "characteristic"],
    "pigeonhole": ["pigeonhole", "pigeon hole", "drawer principle"],
    "invariant": ["invariant", "monovariant", "conservation"],
    "induction": ["induction", "base case", "inductive step"],
    "extremal": ["extremal", "maximum", "minimum", "optimal"],
    "bijection": ["bijection", "bijective", "one-to-one correspondence"],
    "double_counting": ["double count", "count two ways", "overcounting"],
    "vieta_jumping": ["vieta jumping", "vieta", "by symmetry swap"],
    "infinite_descent": ["infinite descent", "smallest", "well-ordering"],
    "am_gm": ["am-gm", "am gm", "arithmetic mean", "geometric mean"],
    "cauchy_schwarz": ["cauchy-schwarz", "cauchy schwarz", "CBS"],
    "polynomial_roots": ["polynomial", "roots", "vieta formulas", "factor theorem"],
    "floor_ceiling": ["floor", "ceiling", "\\lfloor", "\\lceil", "greatest integer"],
    "combinatorial_identity": ["binomial", "pascal", "vandermonde", "hockey stick"],
    "graph_theory": ["graph", "vertex", "edge", "spanning tree", "chromatic"],
    "probability": ["probability", "expected value", "random", "expectation"],
    "geometry_coordinate": ["coordinate", "x-axis", "y-axis", "slope", "distance formula"],
    "geometry_classical": ["similar triangle", "power of a point", "ptolemy", "radical axis"],
    "number_theory_advanced": ["lifting the exponent", "LTE", "zsygmondy", "primitive root"],
    "matrix": ["matrix", "determinant", "eigenvalue", "linear algebra"],
    "complex_numbers": ["complex number", "argument", "modulus", "roots of unity"],
    "python_computation": ["```python", "sympy", "import math", "brute force", "for i in range"],
}
QUALITY_STEP_WORDS = ["step", "first", "note that", "therefore", "since", "because", "we have", "let"]
QUALITY_MATH_SYMBOLS = ["\\frac", "\\sum", "\\prod", "=", "\\leq", "\\geq"]
QUALITY_PROOF_WORDS = ["proof", "qed", "thus", "hence", "therefore"]
FUNNEL_MATH_SYMBOLS = ["\\", "=", "+", "-", "*"]
ANSWER_BUCKETS = [(0, 0), (1, 9), (10, 99), (100, 999), (1000, 9999), (10000, 99999)]
LENGTH_BUCKETS_WORDS = [("empty", 0, 0), ("tiny", 1, 19), ("short", 20, 99), ("medium", 100, 499), ("long", 500, None)]
LENGTH_BUCKETS_CHARS = [("lt_200", None, 199), ("lt_1k", 200, 999), ("lt_3k", 1000, 2999), ("ge_3k", 3000, None)]
DIFFICULTY_BUCKETS = [("very_easy", 0.875), ("easy", 0.625), ("medium", 0.375), ("hard", 0.125)]
# ----------------------------------------------------------------- end


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_contains(text: Column, words, lower_words: bool = False) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w.lower() if lower_words else w))
    return out


def value_share(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """count and % of total per value, descending (ties by value); the
    total is one number, taken from the aggregated table."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    g = g.withColumn("pct", F.round(F.col("n") * 100.0 / g.agg(F.sum("n")).scalar(), 6))
    if top:
        g = g.orderBy(F.col("n").desc(), F.col(col).asc()).limit(top)
    return g


def accuracy_hist(df: DataFrame, acc: str = "accuracy") -> DataFrame:
    """count per accuracy rounded to 3 places."""
    return df.groupBy(F.round(acc, 3).alias("accuracy")).agg(F.count("*").alias("n"))


def accuracy_stats(df: DataFrame, key: str, acc: str, hard_below: float = 0.5) -> DataFrame:
    """per config key n, min, median (exact), mean, max, hard/easy split."""
    a = F.col(acc)
    d = df.where(a.isNotNull())
    median = quantile_linear(d.select(key, acc), acc, [0.5], [key]).select(F.col(key).alias("_key"), F.col("q50").alias("median"))
    out = d.groupBy(key).agg(
        F.count("*").alias("n"), F.min(a).alias("min"), F.round(F.avg(a), 6).alias("mean"), F.max(a).alias("max"),
        F.count(F.when(a < hard_below, 1)).alias("hard"),
        F.count(F.when(a >= hard_below, 1)).alias("easy"))
    return out.join(median, F.col(key).eqNullSafe(F.col("_key"))).select(key, "n", "min", "median", "mean", "max", "hard", "easy")


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """``groupBy(row).pivot(col, values)`` with explicit values, 0-filled."""
    p = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    return p.fillna(0, subset=[str(v) for v in values])


def answer_breakdown(df: DataFrame, text: str) -> DataFrame:
    """integer / valid (0..99999) / out of range / string / none shares
    from the last simple boxed answer of ``text``."""
    t = A.answer_type(F.col(text))
    d = df.select(t.alias("t"))
    kind, v = F.col("t.kind"), F.col("t.value")
    n = F.count("*")
    return d.agg(
        n.alias("n"),
        F.count(F.when(kind == "integer", 1)).alias("integer"),
        F.count(F.when((kind == "integer") & v.between(0, 99999), 1)).alias("valid"),
        F.count(F.when((kind == "integer") & ~v.between(0, 99999), 1)).alias("out_of_range"),
        F.count(F.when(kind == "string", 1)).alias("string"),
        F.count(F.when(kind == "none", 1)).alias("none"))


def answer_buckets(df: DataFrame, answer: str) -> DataFrame:
    """counts per magnitude bucket plus > 10000 / > 50000 tallies (one pass)."""
    a = F.col(answer)
    aggs = [F.count(F.when(a.between(lo, hi), 1)).alias(f"b_{lo}_{hi}") for lo, hi in ANSWER_BUCKETS]
    aggs += [F.count(F.when(a > 10000, 1)).alias("gt_10000"), F.count(F.when(a > 50000, 1)).alias("gt_50000"),
             F.count(a).alias("n_valid"), F.countDistinct(a).alias("distinct_answers")]
    return df.where(a.between(0, 99999)).agg(*aggs)


def top_answers(df: DataFrame, answer: str, k: int = 20) -> DataFrame:
    """the ``k`` most common valid answers (ties by value)."""
    return (df.where(F.col(answer).between(0, 99999)).groupBy(answer).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), F.col(answer).asc()).limit(k))


def _bucket(x: Column, spec) -> Column:
    out = None
    for name, lo, hi in spec:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (x >= lo)
        if hi is not None:
            cond = cond & (x <= hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def length_buckets(df: DataFrame, text: str, scheme: str = "words") -> DataFrame:
    """word-length (empty/tiny/short/medium/long) or char-length buckets."""
    if scheme == "words":
        x, spec = word_count(F.col(text)), LENGTH_BUCKETS_WORDS
    else:
        x, spec = F.length(text), LENGTH_BUCKETS_CHARS
    return df.groupBy(_bucket(x, spec).alias("bucket")).agg(F.count("*").alias("n"))


PIVOTS = 256


def _counts_at(df: DataFrame, value: str, by: list, ranks) -> DataFrame:
    """``by, value, _cum, _n``: running and total counts of the non-null values around the places
    ``ranks(n)`` (a list of columns, from 0) of each group in ascending order.

    A quantile sketch of a group's distinct values gives up to ``PIVOTS`` - 1 pivots.  Exact counts between pivots tell
    in which intervals the places lie, and only those intervals' values are ordered.  Pivots are ranks, not widths: an interval
    holds about 1 / ``PIVOTS`` of the distinct values, however far apart or repeated the values are."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    # by way of the count: a filter on the place of a mere key would go below the aggregate and work out the key
    # anew, from the rows' texts, at every pivot
    x = F.when(F.col("_c") > 0, F.col(value)).cast("double")
    key = lambda prefix: [F.col(c).alias(f"{prefix}{c}") for c in by]
    same = lambda prefix: [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]
    pivots = F.percentile_approx(x, [i / PIVOTS for i in range(1, PIVOTS)], 20 * PIVOTS)
    if by:
        h = h.join(h.groupBy(*key("_p_")).agg(pivots.alias("_pivots")), same("_p_"))
    else:
        h = h.withColumn("_pivots", h.agg(pivots).scalar())
    # the interval: how many different pivots are below the value
    h = h.withColumn("_b", F.size(F.filter(F.array_distinct("_pivots"), lambda p: p < x))).select(*by, value, "_c", "_b")
    sums = h.groupBy(*key("_s_"), F.col("_b").alias("_s_b")).agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*[f"_s_{c}" for c in by])
    sums = (sums.withColumn("_before", F.coalesce(F.sum("_s").over(group.orderBy("_s_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_n", F.sum("_s").over(group)))
    asked = reduce(Column.__or__, [(k >= F.col("_before")) & (k < F.col("_before") + F.col("_s")) for k in ranks(F.col("_n"))])
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by:
        h = h.join(sums.where(asked), [*same("_s_"), F.col("_b") == F.col("_s_b")])
    else:                                   # a handful of intervals: one value
        found = sums.where(asked).agg(F.collect_list(F.struct("_s_b", "_before", "_n"))).scalar()
        h = h.withColumn("_found", found)
        h = h.withColumn("_i", F.get(F.filter("_found", lambda i: i["_s_b"] == F.col("_b")), F.lit(0))).where("_i is not null").select("*", "_i.*")
    return (h.withColumn("_cum", F.sum("_c").over(inside) + F.col("_before")).select(*by, value, "_cum", "_n"))


def quantile_index(df: DataFrame, value: str, probs: list[tuple[int, int]], by: list | None = None) -> DataFrame:
    """F8 (ii): ``sorted(x)[floor(n * p)]`` with p = num/den (exact integer
    floor): the first value whose running count exceeds floor(n p)."""
    by = by or []
    places = lambda n: [F.floor(n * num / den) for num, den in probs]
    h = _counts_at(df, value, by, places)
    aggs = [F.min(F.when(F.col("_cum") > k, F.col(value))).alias(f"p{num * 100 // den}")
            for (num, den), k in zip(probs, places(F.col("_n")), strict=True)]
    return h.groupBy(*by).agg(F.first("_n").alias("n"), *aggs)


def quantile_linear(df: DataFrame, value: str, probs: list[float], by: list | None = None) -> DataFrame:
    """F8 (i): exact linear interpolation (pandas default) between the values at
    the places around ``(n - 1) p``."""
    by = by or []
    h = _counts_at(df, value, by, lambda n: [f((n - 1) * F.lit(p)) for p in probs for f in (F.floor, F.ceil)])
    aggs = []
    for p in probs:
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.min(F.when(F.col("_cum") > F.floor(at), F.col(value).cast("double")))
        high = F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value).cast("double")))
        share = F.first(at - F.floor(at))
        aggs.append(F.round(low + (high - low) * share, 6).alias(f"q{int(p * 100)}"))
    return h.groupBy(*by).agg(F.first("_n").alias("n"), *aggs)


def cdf_counts(df: DataFrame, x: str, thresholds: list[int]) -> DataFrame:
    """share of rows with x <= each threshold (one pass)."""
    return df.agg(F.count("*").alias("n"),
                  *[F.round(F.avg((F.col(x) <= t).cast("double")), 6).alias(f"le_{t}") for t in thresholds])


def role_distribution(messages: DataFrame, role: str = "role") -> DataFrame:
    """message count per role."""
    return messages.groupBy(role).agg(F.count("*").alias("n"))


def turn_stats(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """per conversation turn count and the role sequence (ordered)."""
    return messages.groupBy(key).agg(
        F.count("*").alias("turns"),
        F.expr(f"listagg({role}, '>') WITHIN GROUP (ORDER BY {turn})").alias("role_sequence"))


def turn_quantiles(messages: DataFrame, key: str = "conv_id", probs: tuple = (0.1, 0.25, 0.5, 0.75, 0.9),
                   at_most: tuple = (2, 4, 6, 8, 10, 12, 16, 20, 30)) -> DataFrame:
    """messages per conversation -- quantiles, min, max, mean, and how many have at most so many."""
    per = messages.groupBy(key).agg(F.count("*").alias("turns"))
    ends = per.agg(F.min("turns").alias("min"), F.max("turns").alias("max"), F.round(F.avg("turns"), 6).alias("mean"),
                   *[F.count(F.when(F.col("turns") <= n, 1)).alias(f"le_{n}") for n in at_most])
    q = quantile_linear(per, "turns", list(probs))
    return q.withColumn("_e", ends.select(F.struct(*ends.columns)).scalar()).select(*q.columns, "_e.*")


def quality_flags(df: DataFrame, text: str) -> DataFrame:
    """too short (<20 words), just an answer (<5), step words, math
    notation, proof language -- counts in one aggregate."""
    t = F.col(text)
    low = F.lower(t)
    wc = word_count(t)
    return df.agg(F.count("*").alias("n"),
                  F.count(F.when(wc < 20, 1)).alias("too_short"),
                  F.count(F.when(wc < 5, 1)).alias("just_answer"),
                  F.count(F.when(_any_contains(low, QUALITY_STEP_WORDS), 1)).alias("has_steps"),
                  F.count(F.when(_any_contains(t, QUALITY_MATH_SYMBOLS), 1)).alias("has_math"),
                  F.count(F.when(_any_contains(low, QUALITY_PROOF_WORDS), 1)).alias("has_proof"))


def problem_flags(df: DataFrame, text: str) -> DataFrame:
    """find / compute / determine / prove / LaTeX / asks for boxed."""
    t = F.col(text)
    low = F.lower(t)
    return df.agg(F.count("*").alias("n"),
                  *[F.count(F.when(F.contains(low, F.lit(w)), 1)).alias(f"has_{w}")
                    for w in ("find", "compute", "determine", "prove")],
                  F.count(F.when(F.contains(t, F.lit("$")) | F.contains(t, F.lit("\\")), 1)).alias("has_latex"),
                  F.count(F.when(F.contains(low, F.lit("boxed")), 1)).alias("asks_boxed"))


def content_flags(df: DataFrame, text: str) -> DataFrame:
    """code fence, boxed, sympy, python shares."""
    t = F.col(text)
    return df.agg(F.count("*").alias("n"),
                  F.round(F.avg(F.contains(t, F.lit("```")).cast("double")), 6).alias("code_share"),
                  F.round(F.avg(F.contains(t, F.lit("\\boxed")).cast("double")), 6).alias("boxed_share"),
                  F.round(F.avg(F.contains(F.lower(t), F.lit("sympy")).cast("double")), 6).alias("sympy_share"),
                  F.round(F.avg(F.contains(F.lower(t), F.lit("python")).cast("double")), 6).alias("python_share"))


def classify_domain(text, taxonomy: dict | None = None) -> Column:
    """score = number of keywords contained (lower-cased substring);
    highest wins, ties -> first declared, zero -> ``other``.  One expression:
    ``array_max`` over (score, -ordinal, name) structs."""
    taxonomy = taxonomy or DOMAIN_KEYWORDS
    low = F.lower(_c(text))
    cands = []
    for i, (name, kws) in enumerate(taxonomy.items()):
        score = sum((F.contains(low, F.lit(k)).cast("int") for k in kws), F.lit(0))
        cands.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("d")))
    best = F.array_max(F.array(*cands))
    return F.when(best["s"] > 0, best["d"]).otherwise(F.lit("other"))


def detect_techniques(text, techniques: dict | None = None) -> Column:
    """array of techniques whose (lower-cased) keywords occur in ``text``
    (callers pass lower(solution || ' ' || problem))."""
    low = F.lower(_c(text))
    hits = [F.when(_any_contains(low, kws, lower_words=True), F.lit(name)) for name, kws in (techniques or TECHNIQUES).items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def technique_by_domain(df: DataFrame, domain: str, techniques: str, top: int = 8) -> DataFrame:
    """F16: technique counts per domain, top-k per domain (ties by name)."""
    e = df.select(domain, F.explode(techniques).alias("technique")).groupBy(domain, "technique").count()
    w = Window.partitionBy(domain).orderBy(F.col("count").desc(), F.col("technique").asc())
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cooccurrence(df: DataFrame, techniques: str, anchor: str) -> DataFrame:
    """techniques seen together with ``anchor`` and how often."""
    d = df.where(F.array_contains(techniques, anchor))
    return d.select(F.explode(techniques).alias("technique")).where(F.col("technique") != anchor) \
            .groupBy("technique").agg(F.count("*").alias("n"))


def exclusion_funnel(df: DataFrame, rules: list[tuple[str, Column]], usable: str = "usable") -> DataFrame:
    """the first failing rule names the exclusion reason; counts per reason."""
    reason = None
    for name, ok in rules:
        cond = ~F.coalesce(ok, F.lit(False))
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    reason = reason.otherwise(F.lit(usable))
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def filter_ladder(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """rows remaining after each cumulative filter, in one job."""
    aggs, cond = [F.count("*").alias("step_0_input")], F.lit(True)
    for i, (name, ok) in enumerate(steps, start=1):
        cond = cond & F.coalesce(ok, F.lit(False))
        aggs.append(F.count(F.when(cond, 1)).alias(f"step_{i}_{name}"))
    return df.agg(*aggs)


def difficulty_bucket(acc) -> Column:
    """>.875 very_easy, >.625 easy, >.375 medium, >.125 hard, else
    very_hard; missing -> no_metadata."""
    a = _c(acc)
    out = F.when(a.isNull(), F.lit("no_metadata"))
    for name, thr in DIFFICULTY_BUCKETS:
        out = out.when(a > thr, F.lit(name))
    return out.otherwise(F.lit("very_hard"))


def source_stats(df: DataFrame, source: str, words: str) -> DataFrame:
    """per source n, median words by the index rule, mean words."""
    q = quantile_index(df, words, [(1, 2)], by=[source]).select(source, F.col("p50").alias("median_words"))
    m = df.groupBy(source).agg(F.count("*").alias("n"), F.round(F.avg(words), 6).alias("mean_words"))
    return m.join(q, source)


def schema_report(df: DataFrame) -> DataFrame:
    """per column type, non-null count, null count and distinct values (the schema itself is metadata).

    Each value becomes its column's number and a 64-bit hash before anything is shuffled, however long it is; equal ones are
    counted in the task, then over all.  Distinct values are told apart by the hashes: among 10^9 of them 0.03 are expected to be missed."""
    fields = df.schema.fields
    hashed = lambda c, t: F.xxhash64(F.array_sort(F.map_entries(c)) if isinstance(t, T.MapType) else c)
    values = [F.struct(F.lit(i).cast("smallint").alias("i"), F.when(F.col(f"`{f.name}`").isNotNull(), hashed(F.col(f"`{f.name}`"), f.dataType)).alias("h"))
              for i, f in enumerate(fields)]
    counted = (df.select(F.explode(F.array(*values)).alias("v")).groupBy("v.i", "v.h").agg(F.count("*").alias("c"))
               .groupBy("i").agg(F.sum(F.when(F.col("h").isNotNull(), F.col("c")).otherwise(0)).alias("non_null"),
                                 F.sum(F.when(F.col("h").isNull(), F.col("c")).otherwise(0)).alias("nulls"), F.count("h").alias("distinct")))
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "i smallint, column string, type string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return names.join(counted, "i", "left").select("column", "type", zero("non_null"), zero("nulls"), zero("distinct"))


def python_stats(messages: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """Tool calls and tool errors per conversation (conditional counts)."""
    tool, t = F.col(role) == "tool", F.col(text)
    error = t.startswith("[ERROR]") | t.contains("Traceback") | t.contains("Error:")
    return messages.groupBy(key).agg(F.count(F.when(tool, 1)).alias("python_calls"), F.count(F.when(tool & error, 1)).alias("python_errors"))


def corpus_by_subject(problems: DataFrame, by: tuple = ("subject", "mohs")) -> DataFrame:
    """problems by subject and difficulty."""
    return problems.groupBy(*by).agg(F.count("*").alias("n"))


def compare_datasets(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """metric by key for two corpora, full outer join, 0 for missing."""
    ma = a.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed("_n", f"{metric}_a")
    mb = b.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed("_n", f"{metric}_b")
    j = ma.join(mb, key, "full_outer").fillna(0, subset=[f"{metric}_a", f"{metric}_b"])
    return j.withColumn("diff", F.col(f"{metric}_b") - F.col(f"{metric}_a"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """distinct keys each side, |intersection|, same key set, and
    identical (row multisets equal: ``exceptAll`` both ways is empty).
    Key counts come from one full outer join of the distinct keys; the
    one-row results are stacked and folded, not cross-joined."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(1))
    kb = b.select(key).distinct().withColumn("_b", F.lit(1))
    k = ka.join(kb, key, "full_outer").agg(
        F.count("_a").alias("v_keys_a"), F.count("_b").alias("v_keys_b"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("v_common"))
    rows = k.select(F.explode(F.array(
        F.struct(F.lit("keys_a").alias("m"), F.col("v_keys_a").alias("v")),
        F.struct(F.lit("keys_b").alias("m"), F.col("v_keys_b").alias("v")),
        F.struct(F.lit("common").alias("m"), F.col("v_common").alias("v")))).alias("r")).select("r.*")
    rows = rows.unionByName(a.exceptAll(b).agg(F.lit("only_a").alias("m"), F.count("*").alias("v"))) \
               .unionByName(b.exceptAll(a).agg(F.lit("only_b").alias("m"), F.count("*").alias("v")))
    g = rows.groupBy().agg(*[F.max(F.when(F.col("m") == m, F.col("v"))).alias(m)
                             for m in ("keys_a", "keys_b", "common", "only_a", "only_b")])
    return g.select("keys_a", "keys_b", "common",
                    ((F.col("keys_a") == F.col("common")) & (F.col("keys_b") == F.col("common"))).alias("same_keys"),
                    ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("identical"))


def numeric_answer_stats(df: DataFrame, answer: str) -> DataFrame:
    """numeric vs non-numeric answers, range, mean, integral count."""
    d = A.to_double(F.col(answer).cast("string"))
    return df.agg(F.count(d).alias("numeric"), F.count(F.when(d.isNull(), 1)).alias("non_numeric"),
                  F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.avg(d), 6).alias("mean"),
                  F.count(F.when(d == F.floor(d), 1)).alias("integral"))


def rag_options(df: DataFrame, source: str) -> DataFrame:
    """conservative (boxed only) / medium (+ text pattern) / aggressive
    (+ last int) counts from the D5 answer-source labels."""
    s = F.col(source)
    return df.agg(F.count(F.when(s == "boxed", 1)).alias("conservative"),
                  F.count(F.when(s.isin("boxed", "text_pattern"), 1)).alias("medium"),
                  F.count(F.when(s.isNotNull(), 1)).alias("aggressive"),
                  F.count("*").alias("n"))


def label_change_report(df: DataFrame, original: str, current: str) -> DataFrame:
    """share of rows whose answer was replaced (null-safe comparison)."""
    changed = ~F.col(original).eqNullSafe(F.col(current))
    return df.groupBy(changed.alias("changed")).agg(F.count("*").alias("n"))
