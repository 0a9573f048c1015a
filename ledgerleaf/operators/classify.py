"""Weighted keyword classification of parsed documents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions import text
from ledgerleaf.functions.session import once
from ledgerleaf.functions.stages import counted
from ledgerleaf.operators import keywords
from ledgerleaf.rules import BUILTIN_RULES, Rule

RULES_PER_PASS = 200  # rules held in one expression; longer lists take more passes


def _words(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _rule_literal(number: int, rule: Rule) -> Column:
    return F.struct(
        F.lit(number).alias("rule_no"),
        F.lit(rule.doc_type).alias("document_type"),
        _words(rule.primary).alias("primary"),
        _words(rule.secondary).alias("secondary"),
        _words(rule.headers).alias("headers"),
        _words(rule.negative).alias("negative"),
    )


def _hits(words: Column, corpus: Column) -> Column:
    return F.filter(words, lambda k: F.contains(corpus, k))


def _score(rule: Column, corpus: Column, headers: Column) -> Column:
    """Integer points of a rule; null when a negative keyword vetoes it."""
    points = (
        F.size(_hits(rule["primary"], corpus)) * K.PRIMARY_POINTS
        + F.size(_hits(rule["secondary"], corpus)) * K.SECONDARY_POINTS
        + F.size(_hits(rule["headers"], headers)) * K.HEADER_POINTS
    )
    vetoed = F.exists(rule["negative"], lambda k: F.contains(corpus, k))
    return F.when(~vetoed, F.least(points, F.lit(K.MAX_POINTS)))


@once
def _normal_columns() -> dict[str, Column]:
    headers = F.array_distinct(F.flatten(F.transform("tables", lambda t: t["headers"])))
    return {
        "corpus_upper": F.upper(text.corpus(F.col("pages"))),
        "headers_upper": F.coalesce(F.upper(F.array_join(headers, "\n")), F.lit("")),
    }


def normalized(df: DataFrame) -> DataFrame:
    """Add the upper-case corpus and the upper-case table headers.

    Headers are kept as one line-separated string: no keyword holds a line end,
    so "inside any header" equals "inside the joined headers".
    """
    return df.withColumns(_normal_columns())


def rule_scores(df: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Long form: one row per document and rule, with veto flag and points."""
    table = F.array(*(_rule_literal(n, r) for n, r in enumerate(rules, 1)))
    corpus, headers = F.col("corpus_upper"), F.col("headers_upper")
    scored = F.transform(
        table,
        lambda r: F.struct(
            r["rule_no"].alias("rule_no"),
            r["document_type"].alias("document_type"),
            _score(r, corpus, headers).alias("points"),
        ),
    )
    return (
        normalized(df)
        .select("document_id", F.inline(scored))
        .select(
            "document_id", "rule_no", "document_type",
            F.col("points").isNull().alias("vetoed"),
            F.coalesce("points", F.lit(0)).alias("points"),
        )
    )


def _points(rule: Rule, corpus: Column, headers: Column) -> Column:
    """Points of a rule of known words, zero after a veto. Plain conditions are compiled, functions over arrays are not."""
    parts = [
        F.when(F.contains(searched, F.lit(word)), points).otherwise(0)
        for words, searched, points in (
            (rule.primary, corpus, K.PRIMARY_POINTS), (rule.secondary, corpus, K.SECONDARY_POINTS), (rule.headers, headers, K.HEADER_POINTS)
        )
        for word in words
    ]
    points = F.least(reduce(Column.__add__, parts, F.lit(0)), F.lit(K.MAX_POINTS))
    if not rule.negative:
        return points
    return F.when(~reduce(Column.__or__, (F.contains(corpus, F.lit(word)) for word in rule.negative)), points).otherwise(0)


def _best_of(rules: Sequence[Rule], first_no: int) -> tuple[Column, Column]:
    """Highest score, and among equals the first rule, of one slice of rules.

    Two steps: points and rule as one number ``_mark``, and what it stands for.
    """
    corpus, headers = F.col("corpus_upper"), F.col("headers_upper")
    size = len(rules) + 1
    marks = [_points(r, corpus, headers) * size + (len(rules) - n) for n, r in enumerate(rules)]
    mark = F.greatest(*marks) if len(marks) > 1 else marks[0]
    at = F.lit(len(rules)) - F.pmod(F.col("_mark"), F.lit(size))
    table = F.array(*(_rule_literal(n, r) for n, r in enumerate(rules, first_no)))
    rule = F.get(table, at)
    best = F.struct(
        F.floor(F.col("_mark") / size).cast("int").alias("points"),
        (-(at + first_no)).alias("order"),
        *(rule[name].alias(name) for name in ("document_type", "primary", "secondary", "headers")),
    )
    return mark, best


@once
def _best_builtin() -> tuple[Column, Column]:
    return _best_of(BUILTIN_RULES, 1)


def _with_best_literal(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Best rule of a list; a long one is applied in slices, each one more narrow projection."""
    if not rules:
        raise ValueError("the rule list is empty")
    for first in range(0, len(rules), RULES_PER_PASS):
        mark, here = _best_builtin() if rules is BUILTIN_RULES else _best_of(rules[first : first + RULES_PER_PASS], first + 1)
        df = df.withColumn("_mark", mark).withColumn("_best", here if first == 0 else F.greatest(F.col("_best"), here))
    return df.drop("_mark")


def _signals(label: str, words: Column, corpus: Column) -> Column:
    tag = lambda k: F.concat(F.lit(f"{label}: '"), k, F.lit("'"))
    return F.transform(F.sort_array(_hits(words, corpus)), tag)


@once
def _outcome_columns() -> list[dict[str, Column]]:
    """What the best rule says about a document."""
    corpus, headers = F.col("corpus_upper"), F.col("headers_upper")
    b = F.col("_best")
    scored = b["points"] > 0
    matched = F.when(
        scored,
        F.concat(
            _signals("Primary", b["primary"], corpus),
            _signals("Secondary", b["secondary"], corpus),
            _signals("Header", b["headers"], headers),
        ),
    ).otherwise(_words(()))
    confidence = b["points"] / F.lit(100.0)
    below = b["points"] < K.THRESHOLD_POINTS
    return [
        {"matched_rules": matched},
        {
            "document_type": F.when(below, K.UNKNOWN).otherwise(b["document_type"]),
            "confidence": confidence,
            "reason": F.when(
                below,
                F.concat(
                    F.lit("Confidence score ("), confidence.cast("string"),
                    F.lit(f") was below minimum threshold ({K.THRESHOLD_POINTS / 100})."),
                ),
            ).otherwise(
                F.concat(F.lit("Matched "), F.size("matched_rules"), F.lit(" keyword/header signals."))
            ),
        },
    ]


def classify(df: DataFrame, rules: Sequence[Rule] | DataFrame | None = None) -> DataFrame:
    """Add document_type, confidence, matched_rules and reason to parsed documents.

    ``df`` needs ``pages`` and ``tables``. ``rules`` may be a sequence of rules, which
    become literals of the expression, or a table ``rule_no, doc_type, primary,
    secondary, headers, negative`` of any length, which becomes an automaton over its
    words. Both plans are narrow: no document is shuffled.
    """
    out = normalized(df)
    if isinstance(rules, DataFrame):
        out = keywords.with_best_rule(out, rules, "corpus_upper", "headers_upper", "_best")
    else:
        out = _with_best_literal(out, BUILTIN_RULES if rules is None else rules)
    for step in _outcome_columns():
        out = out.withColumns(step)
    return counted(out.drop("_best", "corpus_upper", "headers_upper"), "classify")
