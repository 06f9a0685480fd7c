"""Formula measures: text to a Column of doubles, where undefined is null.

Precedence, tightest first: unary minus, ``^`` (right to left), ``* / %``,
``+ -``; so ``-2^2`` is 4. A name takes letters, digits, ``_`` and ``-``, and
``/`` before a letter or ``_``: ``a-b`` without spaces is one name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS, MAX_PARENS, MAX_CALLS = 4096, 512, 32, 16
#: Words and marks that a formula must not hold.
BANNED_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "EXEC", "EXECUTE", "UNION", "FROM", "WHERE", "JOIN", "INTO", "GRANT", "REVOKE", "TRUNCATE")
BANNED_MARKS = ("--", "/*", "*/", ";")
#: Codes of formula errors.
CODES = {"token": "FML_001", "parentheses": "FML_002", "function": "FML_003", "arity": "FML_004", "zero": "FML_005", "domain": "FML_006", "banned": "FML_007", "length": "FML_008", "depth": "FML_009", "tokens": "FML_010", "calls": "FML_011", "variable": "FML_012", "empty": "FML_013"}


class FormulaError(ValueError):
    def __init__(self, kind: str, detail: str):
        self.code = CODES[kind]
        super().__init__(f"{self.code}: {detail}")


def _defined(c: Column) -> Column:
    """NaN and infinities are undefined."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _round(x: Column, n: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), n) if n is not None else F.lit(1.0)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def _extreme(f):
    return lambda *a: a[0] if len(a) == 1 else f(*a)


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull() & (lo <= hi), F.greatest(F.least(x, hi), lo))


@dataclass(frozen=True)
class Function:
    least: int
    most: int | None
    build: Callable[..., Column]


FUNCTIONS: dict[str, Function] = {
    "ABS": Function(1, 1, F.abs), "CEIL": Function(1, 1, lambda x: F.ceil(x).cast("double")), "FLOOR": Function(1, 1, lambda x: F.floor(x).cast("double")),
    "SIGN": Function(1, 1, F.signum), "ROUND": Function(1, 2, _round), "SQRT": Function(1, 1, lambda x: _defined(F.sqrt(x))),
    "LOG": Function(1, 1, F.ln), "LOG10": Function(1, 1, F.log10), "POWER": Function(2, 2, lambda x, y: _defined(F.pow(x, y))),
    "MOD": Function(2, 2, lambda x, y: F.try_mod(x, y)), "NULLIF": Function(2, 2, F.nullif), "COALESCE": Function(1, None, _extreme(F.coalesce)),
    "IF": Function(3, 3, lambda c, a, b: F.when(c.isNull() | (c != 0), a).otherwise(b)),
    "GREATEST": Function(1, None, _extreme(F.greatest)), "LEAST": Function(1, None, _extreme(F.least)), "CLAMP": Function(3, 3, _clamp),
}
OPERATORS: dict[str, tuple[int, bool, Callable[[Column, Column], Column]]] = {
    "+": (1, False, lambda a, b: a + b), "-": (1, False, lambda a, b: a - b), "*": (2, False, lambda a, b: a * b),
    "/": (2, False, lambda a, b: F.try_divide(a, b)), "%": (2, False, lambda a, b: F.try_mod(a, b)), "^": (3, True, lambda a, b: _defined(F.pow(a, b))),
}
UNARY = 4
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[^\W\d](?:[\w-]|/(?=[^\W\d]))*)|(?P<mark>[-+*/%^(),]))")


def check(text: str) -> None:
    """Limits and banned words, before anything is read."""
    if not text.strip():
        raise FormulaError("empty", "nothing to compute")
    if len(text) > MAX_CHARS:
        raise FormulaError("length", f"{len(text)} characters")
    for word in BANNED_WORDS:
        if re.search(rf"\b{word}\b", text, re.I):
            raise FormulaError("banned", word)
    for mark in BANNED_MARKS:
        if mark in text:
            raise FormulaError("banned", mark)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError("token", f"{text[at:at + 10]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
        if len(out) > MAX_TOKENS:
            raise FormulaError("tokens", f"more than {MAX_TOKENS}")
    return out


class _Parser:
    """Precedence climbing over the tokens, building Columns as it goes."""

    def __init__(self, text: str, variable: Callable[[str], Column]):
        check(text)
        self.tokens, self.at, self.variable, self.parens, self.calls = tokens(text), 0, variable, 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def whole(self) -> Column:
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise FormulaError("parentheses" if self.peek()[1] == ")" else "token", f"{self.peek()[1]!r}")
        return out

    def expression(self, least: int) -> Column:
        left = self.operand()
        while (op := OPERATORS.get(self.peek()[1])) and self.peek()[0] == "mark" and op[0] >= least:
            self.take()
            left = op[2](left, self.expression(op[0] if op[1] else op[0] + 1))
        return left

    def operand(self) -> Column:
        kind, text = self.take()
        if kind == "number":
            return F.lit(float(text))
        if kind == "name":
            return self.call(text) if self.peek()[1] == "(" else self.variable(text)
        if text == "-":
            return -self.operand()
        if text == "+":
            return self.operand()
        if text == "(":
            return self.inside(lambda: self.expression(0))
        raise FormulaError("parentheses" if text == ")" or kind == "end" and self.parens else "token", f"{text!r}")

    def inside(self, read):
        self.parens += 1
        if self.parens > MAX_PARENS:
            raise FormulaError("depth", f"more than {MAX_PARENS}")
        out = read()
        if self.take()[1] != ")":
            raise FormulaError("parentheses", "not closed")
        self.parens -= 1
        return out

    def call(self, name: str) -> Column:
        f = FUNCTIONS.get(name.upper())
        if f is None:
            raise FormulaError("function", name)
        self.take()
        self.calls += 1
        if self.calls > MAX_CALLS:
            raise FormulaError("calls", f"more than {MAX_CALLS}")

        def arguments():
            if self.peek()[1] == ")":
                return []
            out = [self.expression(0)]
            while self.peek()[1] == ",":
                self.take()
                out.append(self.expression(0))
            return out

        given = self.inside(arguments)
        self.calls -= 1
        if len(given) < f.least or f.most is not None and len(given) > f.most:
            raise FormulaError("arity", f"{name} with {len(given)}")
        return f.build(*given)


def compile_formula(text: str, variable: Callable[[str], Column]) -> Column:
    """A double column; ``variable`` gives the column of a name, as double and null where undefined."""
    return _defined(_Parser(text, variable).whole().cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is less than 1e-15 from zero."""
    return F.when(F.abs(b) >= 1e-15, a / F.when(F.abs(b) >= 1e-15, b))


def register_function(name: str, least: int, most: int | None, build: Callable[..., Column]) -> None:
    """Add a function of columns to the language."""
    FUNCTIONS[name.upper()] = Function(least, most, build)
