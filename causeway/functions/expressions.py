"""The calculator language, compiled to columns.

``Y = f(X, ...)`` with infix operators by precedence (comparisons, then + and
-, then * and /, then ^), prefix functions, parentheses and names.  Booleans
are 1.0 and 0.0.  No expression runs row by row in Python, except draws from
distributions that Spark has no inverse for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.distributions import sample

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z0-9_.:]*)|(<=|>=|[-+*/^<>=(),]))")


def _flag(c: Column) -> Column:
    return c.cast("double")


def _true(c: Column) -> Column:
    return c == 1.0


class Compiler:
    """Parses an expression over the columns of a table; draws are seeded in order of appearance."""

    def __init__(self, columns: list[str], seed: int = 42, parents: list[str] | None = None) -> None:
        self.columns, self.seed, self.draws, self.parents, self.parameters = set(columns), seed, 0, parents or [], {}

    # Grammar

    def compile(self, text: str) -> Column:
        self.tokens = self._split(text)
        self.at = 0
        out = self._comparison()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _split(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
            at = m.end()
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else None

    def _take(self, sign: str) -> None:
        if self._peek() != sign:
            raise ValueError(f"expected {sign!r}")
        self.at += 1

    def _comparison(self) -> Column:
        left = self._sum()
        while (op := self._peek()) in ("<", "<=", ">", ">=", "="):
            self.at += 1
            right = self._sum()
            left = _flag({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "=": left == right}[op])
        return left

    def _sum(self) -> Column:
        left = self._product()
        while (op := self._peek()) in ("+", "-"):
            self.at += 1
            right = self._product()
            left = left + right if op == "+" else left - right
        return left

    def _product(self) -> Column:
        left = self._unary()
        while (op := self._peek()) in ("*", "/"):
            self.at += 1
            right = self._unary()
            left = left * right if op == "*" else left / right
        return left

    def _unary(self) -> Column:
        if self._peek() == "-":
            self.at += 1
            return -self._unary()
        return self._power()

    def _power(self) -> Column:
        base = self._atom()
        if self._peek() == "^":
            self.at += 1
            return F.pow(base, self._unary())
        return base

    def _atom(self) -> Column:
        if self._peek() == "(":
            self.at += 1
            out = self._comparison()
            self._take(")")
            return out
        if self._peek() in ("+", "*", "<", "<=", ">", ">=", "=", "/") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            op = self._peek()  # operators that may stand before their arguments
            self.at += 1
            args = self._arguments()
            fold = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "<": lambda a, b: _flag(a < b), "<=": lambda a, b: _flag(a <= b), ">": lambda a, b: _flag(a > b), ">=": lambda a, b: _flag(a >= b), "=": lambda a, b: _flag(a == b)}[op]
            out = args[0]
            for a in args[1:]:
                out = fold(out, a)
            return out
        if self.at >= len(self.tokens):
            raise ValueError("unexpected end")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text))
        if kind == "name":
            if text in self.columns and not (text in FUNCTIONS and self._peek() == "("):
                return F.col(f"`{text}`").cast("double")
            if text in FUNCTIONS:
                return FUNCTIONS[text](self, self._arguments() if self._peek() == "(" else [])
            if text in self.parameters:
                return F.lit(self.parameters[text])
            if text.lower() in ("pi", "e"):
                return F.lit(math.pi if text.lower() == "pi" else math.e)
        raise ValueError(f"unknown name {text!r}")

    def _arguments(self) -> list[Column]:
        self._take("(")
        out = []
        if self._peek() != ")":
            out.append(self._comparison())
            while self._peek() == ",":
                self.at += 1
                out.append(self._comparison())
        self._take(")")
        return out

    # Draws

    def uniform(self) -> Column:
        self.draws += 1
        return F.rand(self.seed + self.draws)

    def normal(self) -> Column:
        self.draws += 1
        return F.randn(self.seed + self.draws)

    def draw(self, name: str, *args: Column) -> Column:
        self.draws += 1
        return sample(name, self.seed + self.draws, *args)


def _one(f: Callable[[Column], Column]):
    return lambda c, a: f(*a)


def _fold(f: Callable[[Column, Column], Column]):
    def run(c: Compiler, a: list[Column]) -> Column:
        out = a[0]
        for x in a[1:]:
            out = f(out, x)
        return out

    return run


def _discrete(c: Compiler, a: list[Column]) -> Column:
    """An index with the given probabilities (which are scaled to add up to 1)."""
    u, total = c.uniform(), sum(a[1:], a[0])
    out, seen = F.lit(float(len(a) - 1)), None
    sums = []
    for p in a:
        seen = p if seen is None else seen + p
        sums.append(seen)
    # One draw decides: the index is the number of cumulative shares at most u.
    return F.aggregate(F.array(*[s / total for s in sums]), F.struct(F.lit(0.0).alias("k"), u.alias("u")), lambda s, x: F.struct((s["k"] + (x <= s["u"]).cast("double")).alias("k"), s["u"].alias("u")), lambda s: F.least(s["k"], out))


def _mixture(c: Compiler, a: list[Column]) -> Column:
    """Mixture(a1, b1, c1, ...): normal components of weight, mean and deviation."""
    weights, parts = a[0::3], [a[i + 1] + a[i + 2] * c.normal() for i in range(0, len(a), 3)]
    return F.element_at(F.array(*parts), _discrete(c, weights).cast("int") + 1)


def _split(c: Compiler, a: list[Column]) -> Column:
    """Uniform over a union of intervals given by their ends."""
    lengths = [a[i + 1] - a[i] for i in range(0, len(a), 2)]
    k = _discrete(c, lengths).cast("int") + 1
    return F.element_at(F.array(*a[0::2]), k) + c.uniform() * F.element_at(F.array(*lengths), k)


def _disc_error(c: Compiler, a: list[Column]) -> Column:
    """An index by softmax of logits, decided by a uniform error."""
    top = F.greatest(*a[1:]) if len(a) > 2 else a[1]
    shares = [F.exp(x - top) for x in a[1:]]
    total = sum(shares[1:], shares[0])
    seen, out = F.lit(0.0), F.lit(0.0)
    for s in shares[:-1]:
        seen = seen + s / total
        out = out + (a[0] >= seen).cast("double")
    return out


def _parameter(c: Compiler, a: list[Column]) -> Column:
    return c.uniform() if not a else a[0]


def _template(start: float, f: Callable[[Column, Column], Column]):
    """A sum or product over the parents of the variable that the template is for."""

    def run(c: Compiler, a: list[Column]) -> Column:
        terms = a or [F.col(f"`{p}`").cast("double") for p in c.parents]
        out = F.lit(start)
        for t in terms:
            out = f(out, t)
        return out

    return run


FUNCTIONS: dict[str, Callable[[Compiler, list[Column]], Column]] = {
    "ceil": _one(lambda x: F.ceil(x).cast("double")),
    "floor": _one(lambda x: F.floor(x).cast("double")),
    "signum": _one(F.signum),
    "cos": _one(F.cos), "cosh": _one(F.cosh), "acos": _one(F.acos), "sin": _one(F.sin), "sinh": _one(F.sinh), "asin": _one(F.asin), "tan": _one(F.tan), "tanh": _one(F.tanh), "atan": _one(F.atan),
    "abs": _one(F.abs), "log10": _one(F.log10), "ln": _one(F.log), "sqrt": _one(F.sqrt), "exp": _one(F.exp),
    "round": _one(lambda x: F.floor(x + 0.5).cast("double")),
    "logistic": _one(lambda x: 1 / (1 + F.exp(-x))),
    "pow": _one(lambda x, y: F.pow(x, y)),
    "max": _fold(lambda a, b: F.greatest(a, b)),
    "min": _fold(lambda a, b: F.least(a, b)),
    "AND": lambda c, a: _flag(_all(a)),
    "OR": lambda c, a: 1.0 - _flag(_all([F.when(_true(x), 0.0).otherwise(1.0) for x in a])),
    "XOR": _one(lambda a, b: _flag(_true(a) != _true(b))),
    "IF": _one(lambda a, b, c: F.when(_true(a), b).otherwise(c)),
    "Switch": lambda c, a: F.when((a[0] < 0) | (a[0] >= len(a) - 1), F.raise_error(F.lit("Switch: index out of range")).cast("double")).otherwise(F.element_at(F.array(*a[1:]), F.least(F.greatest(a[0].cast("int"), F.lit(0)), F.lit(len(a) - 2)) + 1)),
    "random": lambda c, a: c.uniform(),
    "Uniform": lambda c, a: a[0] + (a[1] - a[0]) * c.uniform(),
    "U": lambda c, a: a[0] + (a[1] - a[0]) * c.uniform(),
    "Normal": lambda c, a: a[0] + a[1] * c.normal(),
    "N": lambda c, a: a[0] + a[1] * c.normal(),
    "LogNormal": lambda c, a: F.exp(a[0] + a[1] * c.normal()),
    "ExponentialDist": lambda c, a: -a[0] * F.log(1 - c.uniform()),
    "Cauchy": lambda c, a: a[0] + a[1] * F.tan(F.lit(math.pi) * (c.uniform() - 0.5)),
    "Gumbel": lambda c, a: a[0] - a[1] * F.log(-F.log(1 - c.uniform())),
    "Laplace": lambda c, a: _laplace(c, *a),
    "Levy": lambda c, a: a[0] + a[1] / F.pow(c.normal(), F.lit(2)),
    "Pareto": lambda c, a: a[0] / F.pow(1 - c.uniform(), 1 / a[1]),
    "Weibull": lambda c, a: a[1] * F.pow(-F.log(1 - c.uniform()), 1 / a[0]),
    "Triangular": lambda c, a: _triangular(c, *a),
    "Indicator": lambda c, a: _flag(c.uniform() < a[0]),
    "Discrete": _discrete, "Mixture": _mixture, "Split": _split, "DiscError": _disc_error,
    "ChiSquare": lambda c, a: c.draw("chisq", *a), "Gamma": lambda c, a: c.draw("gamma", *a), "Beta": lambda c, a: c.draw("beta", *a), "FDist": lambda c, a: c.draw("f", *a),
    "Nakagami": lambda c, a: c.draw("nakagami", *a), "Poisson": lambda c, a: c.draw("poisson", *a), "StudentT": lambda c, a: c.draw("t", *a), "TruncNormal": lambda c, a: c.draw("truncnormal", *a),
    "NEW": _parameter, "new": _parameter,
    "TSUM": _template(0.0, lambda a, b: a + b), "tsum": _template(0.0, lambda a, b: a + b), "TPROD": _template(1.0, lambda a, b: a * b), "tprod": _template(1.0, lambda a, b: a * b),
}


def _all(a: list[Column]) -> Column:
    out = _true(a[0])
    for x in a[1:]:
        out = out & _true(x)
    return out


def _laplace(c: Compiler, mean: Column, scale: Column) -> Column:
    """The difference of two exponential draws."""
    return mean + scale * (F.log(1 - c.uniform()) - F.log(1 - c.uniform()))


def _triangular(c: Compiler, low: Column, high: Column, mode: Column) -> Column:
    share = (mode - low) / (high - low)
    left, right = F.sqrt((high - low) * (mode - low)), F.sqrt((high - low) * (high - mode))
    return F.aggregate(F.array(c.uniform()), F.lit(0.0), lambda _, u: F.when(u < share, low + F.sqrt(u) * left).otherwise(high - F.sqrt(1 - u) * right))


def transform(df: DataFrame, *equations: str, seed: int = 42) -> DataFrame:
    """Columns set by equations ``Y = f(...)``, one after the other; new ones are added."""
    out = df
    for k, e in enumerate(equations):
        name, _, right = e.partition("=")
        out = out.withColumn(name.strip(), Compiler(out.columns, seed + 1000 * k).compile(right))
    return out
