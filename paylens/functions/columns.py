"""Expressions shared by the operators. All are JVM-side built-ins.

Long CASE chains are built as SQL text and parsed once: a single call into the
JVM instead of one per branch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of the Unicode white-space characters.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def name(col: str) -> str:
    """A column name as SQL."""
    return "`" + col.replace("`", "``") + "`"


def literal(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def case(branches: Iterable[tuple[str, object]], default=None) -> str:
    """``CASE WHEN`` over (SQL condition, value) pairs, as SQL."""
    whens = " ".join(f"WHEN {condition} THEN {literal(value)}" for condition, value in branches)
    return f"CASE {whens} ELSE {literal(default)} END"


def choose(expr: str, values: dict) -> str:
    """The value listed for the result of ``expr``, or null, as SQL; ``expr`` is evaluated once."""
    pairs = ", ".join(f"{literal(key)}, {literal(value)}" for key, value in values.items())
    return f"try_element_at(map({pairs}), {expr})"


_LITERAL = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\\W)+")


def pattern_test(col: str, pattern: str) -> str:
    """SQL that is true if the regular expression occurs in the text; plain text is searched for as such."""
    if _LITERAL.fullmatch(pattern):
        return f"contains({name(col)}, {literal(re.sub(r'\\(.)', lambda m: m[1], pattern))})"
    return f"rlike({name(col)}, {literal(pattern)})"


def first_match(col: str, rules: Sequence[tuple[str, Sequence[str] | str]], default: str) -> Column:
    """Label of the first rule that the text meets: a list of substrings of which one occurs, or a regular expression."""

    def test(rule):
        if isinstance(rule, str):
            return pattern_test(col, rule)
        return " OR ".join(f"contains({name(col)}, {literal(p)})" for p in rule)

    return F.expr(case(((test(rule), label) for label, rule in rules), default))


def level_rank(col: str, levels: Sequence[str]) -> Column:
    """1-based position of the value in ``levels``; null for any other value."""
    return F.expr(choose(name(col), {level: i for i, level in enumerate(levels, 1)}))


def band_of(col: str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: the first edge not below the value; the last label above all."""
    branches = [(f"{name(col)} IS NULL", None)]
    branches += [(f"{name(col)} <= {literal(edge)}", label) for edge, label in zip(edges, labels)]
    return F.expr(case(branches, labels[-1]))


def null_if_in(col: str, marks: Sequence[str]) -> Column:
    return F.expr(f"CASE WHEN {name(col)} NOT IN ({', '.join(map(literal, marks))}) THEN {name(col)} END")


def null_if_negative(col: str) -> Column:
    return F.expr(f"CASE WHEN NOT {name(col)} < 0 THEN {name(col)} END")


def trim_space(col: str) -> Column:
    """Strip all white space, not only blanks as ``trim`` does."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def to_number(col: str, is_text: bool, to: str = "double") -> Column:
    """Number or null; never NaN or infinite, never an error. As ``int``, a number that is not whole is null."""
    c = name(col)
    if is_text:
        # Java reads "12f" and "12d" as numbers; a data file does not mean that.
        c = f"CASE WHEN NOT rlike({c}, '[0-9.][dDfF][ \\\\t]*$') THEN {c} END"
    number = f"try_cast({c} AS double)"
    finite = f"CASE WHEN abs({number}) < double('Infinity') THEN {number} END"  # NaN is above infinity
    if to == "int":
        return F.expr(f"CASE WHEN {finite} = floor({finite}) THEN try_cast({finite} AS int) END")
    return F.expr(f"CAST({finite} AS {to})")


def r6(c: Column) -> Column:
    """Output rounding: six digits, so that summation order cannot show."""
    return F.round(c.cast("double"), 6)


def avg_if(cond: Column, c: Column) -> Column:
    return F.avg(F.when(cond, c))


def text_round(c: Column, digits: int) -> Column:
    """Half-even rounding as text, without a trailing ``.0``."""
    text = F.bround(c, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, r"\.0+$", "")


def or_na(c: Column) -> Column:
    return F.coalesce(c, F.lit("N/A"))
