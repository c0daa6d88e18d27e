"""Band formulas: a small arithmetic grammar, checked and rewritten as a Column.

    expression = term (('+' | '-') term)*      term = factor (('*' | '/') factor)*
    factor = number | band | '(' expression ')' | ('+' | '-') factor

A division by less than 1e-10 in size gives null, and so does a null in any
given band, named or not. Unlike a lenient parser, text left over after a
complete expression is an error here.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


class FormulaError(ValueError):
    """The formula is not in the grammar, or names an unknown band."""


def tokens(formula: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = formula.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise FormulaError(f"unexpected character at {at} in {formula!r}")
        kind = ("number", "band", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def to_sql(formula: str, bands: list[str]) -> str:
    """SQL text of a formula over columns named as ``bands``, null if any band is."""
    items = tokens(formula)
    pos = 0

    def peek() -> str | None:
        return items[pos][1] if pos < len(items) else None

    def binary(signs: str, part) -> str:
        nonlocal pos
        left = part()
        while peek() is not None and peek() in signs and items[pos][0] == "sign":
            sign = items[pos][1]
            pos += 1
            right = part()
            if sign == "/":
                left = f"(CASE WHEN abs({right}) < 1e-10 THEN NULL ELSE {left} / {right} END)"
            else:
                left = f"({left} {sign} {right})"
        return left

    def factor() -> str:
        nonlocal pos
        if pos >= len(items):
            raise FormulaError(f"{formula!r} ends too early")
        kind, text = items[pos]
        pos += 1
        if kind == "number":
            return f"{text}E0"
        if kind == "band":
            if text not in bands:
                raise FormulaError(f"unknown band {text}")
            return text
        if text in "+-":
            return f"({text}{factor()})"
        if text == "(":
            inner = expression()
            if peek() != ")":
                raise FormulaError(f"a bracket is not closed in {formula!r}")
            pos += 1
            return inner
        raise FormulaError(f"unexpected {text!r} in {formula!r}")

    def expression() -> str:
        return binary("+-", lambda: binary("*/", factor))

    out = expression()
    if pos < len(items):
        raise FormulaError(f"{peek()!r} is left over in {formula!r}")
    check = " OR ".join(f"{b} IS NULL" for b in bands)
    return f"CASE WHEN {check} THEN NULL ELSE {out} END"
