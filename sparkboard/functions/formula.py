"""Formulas of calculator widgets, compiled to Column expressions.

Grammar, loosest first: sums; products with * / %; powers with ^ or **, grouped from
the right; a sign, which binds tighter than a power; numbers, names, calls, brackets.
A comma is a decimal comma outside calls and separates arguments inside them.
Division by zero, logarithms of what has none, and unknown values give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEX = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|([A-Za-z_À-ÿ][\w]*)|(\*\*|[-+*/%^(),]))")


def _guarded(f: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(ok(x), f(x))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": lambda *x: x[0] if len(x) == 1 else F.least(*x),
    "max": lambda *x: x[0] if len(x) == 1 else F.greatest(*x),
    "round": lambda x, n=None: F.floor(x + 0.5).cast("double") if n is None else F.floor(x * F.power(F.lit(10.0), n) + 0.5) / F.power(F.lit(10.0), n),
    "abs": F.abs,
    "sqrt": _guarded(F.sqrt, lambda x: x >= 0),
    "log": _guarded(F.log10, lambda x: x > 0),
    "ln": _guarded(F.ln, lambda x: x > 0),
    "pow": lambda x, y: F.power(x, y),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
}


class FormulaError(ValueError):
    """The formula does not parse, or names what is not there."""


def tokens(text: str) -> list[str]:
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:].strip()!r}")
        found.append(m[0].strip())
        at = m.end()
    return found


def compile_formula(text: str, names: dict[str, Column]) -> Column:
    """The formula as a double Column over ``names``, which are found as written or in upper case."""
    todo = tokens(text)
    at = calls = 0

    def peek() -> str:
        return todo[at] if at < len(todo) else ""

    def take(*wanted: str) -> str:
        nonlocal at
        if peek() and (not wanted or peek() in wanted):
            at += 1
            return todo[at - 1]
        if wanted:
            return ""
        raise FormulaError("the formula ends too soon")

    def total() -> Column:
        value = product()
        while op := take("+", "-"):
            other = product()
            value = value + other if op == "+" else value - other
        return value

    def product() -> Column:
        value = power()
        while op := take("*", "/", "%"):
            other = power()
            value = value * other if op == "*" else F.try_divide(value, other) if op == "/" else F.when(other != 0, value % other)
        return value

    def power() -> Column:
        base = signed()
        return F.power(base, power()) if take("^", "**") else base

    def signed() -> Column:
        if op := take("-", "+"):
            value = signed()
            return -value if op == "-" else value
        return atom()

    def atom() -> Column:
        nonlocal calls
        token = take()
        if token == "(":
            outer, calls = calls, 0
            value = total()
            calls = outer
            if not take(")"):
                raise FormulaError("a bracket is open")
            return value
        if re.match(r"[\d.]", token):
            if not calls and peek() == "," and at + 1 < len(todo) and todo[at + 1].isdigit():
                take()
                token += "." + take()
            return F.lit(float(token))
        if peek() == "(" and token.lower() in FUNCTIONS:
            take()
            calls += 1
            values = [total()]
            while take(","):
                values.append(total())
            calls -= 1
            if not take(")"):
                raise FormulaError("a bracket is open")
            return FUNCTIONS[token.lower()](*values)
        for name in (token, token.upper()):
            if name in names:
                return names[name].cast("double")
        raise FormulaError(f"unknown name {token!r}")

    value = total()
    if at < len(todo):
        raise FormulaError(f"cannot use {peek()!r} here")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)
