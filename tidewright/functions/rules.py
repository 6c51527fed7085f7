"""Rule evaluation as column expressions.

Every rule is one ``rlike`` with a literal pattern: the regex is compiled once per task and
the row never leaves the JVM. Joining texts with a rule table instead would multiply the
rows by the number of rules. Words that every match of a pattern holds are looked for first,
by a plain substring search, so most texts never meet most patterns.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANYWHERE = "(?is)"  # ignore case, dot matches newline
LINEWISE = "(?im)"  # ignore case, anchors per line
DOTALL = "(?s)"
AS_WRITTEN = ""


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Literal pieces that every match of ``pattern`` holds; none where that isn't plain to see.

    Classes, optional groups and looks ahead or behind are passed over, as is the last character
    before a quantifier; a choice requires nothing.
    """
    pieces, run, i = [], "", 0

    def end():
        nonlocal run
        if run:
            pieces.append(run)
        run = ""

    while i < len(pattern):
        c, width, literal = pattern[i], _width(pattern, i), ""
        if c == "|":
            return ()
        if c == "(":
            end()
            inner, after = pattern[i + 1 : i + width - 1], pattern[i + width : i + width + 1]
            if inner[:1] != "?" or inner[:2] == "?:":
                pieces.extend(required(inner.removeprefix("?:")) if after not in ("?", "*", "{") else ())
        elif c in "?*{":
            run = run[:-1]
        elif c == "\\":
            literal = "" if pattern[i + 1].isalnum() else pattern[i + 1]
        elif c.isalnum() or c in "_@;:=,#`'\" /":
            literal = c
        if literal and literal.isascii():
            run += literal
        else:
            end()
        i += width
    end()
    return tuple(dict.fromkeys(pieces))


def _width(pattern: str, i: int) -> int:
    """Length of the escape, class, group, count or character that starts at ``i``."""
    c, j = pattern[i], i + 1
    if c == "\\":
        return 2
    if c == "[":
        j += pattern.startswith("^", j)
        j += pattern.startswith("]", j)  # a bracket in front is a member
        while pattern[j] != "]":
            j += 2 if pattern[j] == "\\" else 1
        return j + 1 - i
    if c == "(":
        while pattern[j] != ")":
            j += _width(pattern, j)
        return j + 1 - i
    return pattern.index("}", i) + 1 - i if c == "{" else 1


def _holds(text: Column, pattern: str, flags: str) -> Column | None:
    """Cheap test that a text without the pattern's required pieces fails; None without such pieces."""
    words = required(pattern)
    if not words or "x" in flags:
        return None
    if "i" in flags:  # only ASCII letters are matched in either case
        text, words = F.upper(text), [w.upper() for w in words]
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words])


def matches(text: Column, pattern: str, flags: str = ANYWHERE) -> Column:
    found, holds = text.rlike(flags + pattern), _holds(text, pattern, flags)
    return found if holds is None else holds & found


def any_match(text: Column, patterns, flags: str = ANYWHERE) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p, flags) for p in patterns])


def count_matches(text: Column, patterns, flags: str = AS_WRITTEN) -> Column:
    """How many of the patterns occur at least once."""
    return reduce(lambda a, b: a + b, [matches(text, p, flags).cast("int") for p in patterns])


def hits(text: Column, rules, flags: str = ANYWHERE) -> Column:
    """Messages of the (pattern, message, ..) rules that match, in rule order."""
    found = [F.when(matches(text, r[0], flags), F.lit(r[1])) for r in rules]
    return F.array_compact(F.array(*found))


def keyword_hits(text: Column, rules) -> Column:
    """As ``hits``, for plain upper-case keywords."""
    upper = F.upper(text)
    return F.array_compact(F.array(*[F.when(upper.contains(k), F.lit(m)) for k, m in rules]))


def all_matches(text: Column, pattern: str, group: int = 1, flags: str = ANYWHERE) -> Column:
    found, holds = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)), _holds(text, pattern, flags)
    return found if holds is None else F.when(~holds, F.array().cast("array<string>")).otherwise(found)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def contains_lower(text: Column, word: Column) -> Column:
    return F.contains(F.lower(text), F.lower(word))


def unnest(rows: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per array element, NULL elements and empty arrays left out.

    A plain explode lets the optimizer add a not-empty filter below it, which evaluates an
    expensive array expression a second time; the outer form does not.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def evaluated(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """``rows`` with a column that is evaluated once a row.

    A filter on a projected column is moved below the projection and evaluates the expression again; it stays above a generator.
    """
    return rows.select("*", F.explode_outer(F.array(column)).alias(name))
