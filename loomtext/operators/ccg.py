"""Categorial grammar: categories with features, unification, combinators, and chart parsing, sentence by sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Atom:
    name: str
    features: tuple[tuple[str, str], ...] = ()  # a value that begins with an upper-case letter is a variable

    def __str__(self) -> str:
        return self.name + (f"[{','.join(f'{k}={v}' for k, v in self.features)}]" if self.features else "")

    @property
    def arity(self) -> int:
        return 1


@dataclass(frozen=True)
class Slash:
    result: Cat
    slash: str
    argument: Cat

    def __str__(self) -> str:
        side = lambda c: f"({c})" if isinstance(c, Slash) else str(c)
        return side(self.result) + self.slash + side(self.argument)

    @property
    def arity(self) -> int:
        return self.result.arity + 1


Cat = Atom | Slash


class CategoryError(ValueError):
    pass


class UnknownWord(KeyError):
    pass


_TOKEN = re.compile(r"\s*([()/\\]|[A-Za-z_][\w.]*(?:\[[^\]]*\])?)")


def parse_category(text: str) -> Cat:
    """Slashes associate to the left; features are [a=b,c=X]."""
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CategoryError(f"can't read {text!r} from {at}")
        items.append(m[1])
        at = m.end()
    items.append("")
    i = 0

    def one() -> Cat:
        nonlocal i
        t = items[i]
        i += 1
        if t == "(":
            c = many()
            if items[i] != ")":
                raise CategoryError(f"no closing bracket in {text!r}")
            i += 1
            return c
        if not t or t in ")/\\":
            raise CategoryError(f"a category is missing in {text!r}")
        name, _, feats = t.partition("[")
        pairs = [tuple(x.strip() for x in f.split("=", 1)) for f in feats.rstrip("]").split(",") if f.strip()]
        if any(len(p) != 2 for p in pairs):
            raise CategoryError(f"a feature without a value in {text!r}")
        return Atom(name, tuple(pairs))

    def many() -> Cat:
        nonlocal i
        c = one()
        while items[i] and items[i] in "/\\":
            s = items[i]
            i += 1
            c = Slash(c, s, one())
        return c

    out = many()
    if items[i]:
        raise CategoryError(f"{items[i]!r} is left over in {text!r}")
    return out


def is_variable(v: str) -> bool:
    return v[:1].isupper()


def unify(a: Cat, b: Cat, strict: bool = False) -> dict[str, str] | None:
    """The bindings that make two categories equal, or None. Without strict, a variable that is bound twice keeps its last
    value, as grammars in use rely on; with it, two different constants for one variable fail."""
    out: dict[str, str] = {}

    def bind(var: str, value: str) -> bool:
        if strict and var in out and out[var] != value and not is_variable(out[var]) and not is_variable(value):
            return False
        out[var] = value
        return True

    def walk(x: Cat, y: Cat) -> bool:
        if isinstance(x, Slash):
            return isinstance(y, Slash) and x.slash == y.slash and walk(y.argument, x.argument) and walk(y.result, x.result)
        if not isinstance(y, Atom) or x.name != y.name:
            return False
        fx, fy = dict(x.features), dict(y.features)
        for k in fx.keys() & fy.keys():
            v, w = fx[k], fy[k]
            if is_variable(w):
                ok = bind(w, v)
            elif is_variable(v):
                ok = bind(v, w)
            else:
                ok = v == w
            if not ok:
                return False
        return True

    return out if walk(a, b) else None


def substitute(c: Cat, s: dict[str, str]) -> Cat:
    if isinstance(c, Slash):
        return Slash(substitute(c.result, s), c.slash, substitute(c.argument, s))
    return Atom(c.name, tuple((k, s.get(v, v) if is_variable(v) else v) for k, v in c.features))


def renamed(c: Cat, mark: str) -> Cat:
    """The category with its own variables."""
    if isinstance(c, Slash):
        return Slash(renamed(c.result, mark), c.slash, renamed(c.argument, mark))
    return Atom(c.name, tuple((k, f"{v.split('_')[0]}_{mark}" if is_variable(v) else v) for k, v in c.features))


def equal(a: Cat, b: Cat) -> bool:
    """Equality without regard to features."""
    if isinstance(a, Slash):
        return isinstance(b, Slash) and a.slash == b.slash and equal(a.argument, b.argument) and equal(a.result, b.result)
    return isinstance(b, Atom) and a.name == b.name


def forward(x: Cat, y: Cat) -> Cat | None:
    if isinstance(x, Slash) and x.slash == "/" and (s := unify(x.argument, y)) is not None:
        return substitute(x.result, s)
    return None


def backward(x: Cat, y: Cat) -> Cat | None:
    if isinstance(y, Slash) and y.slash == "\\" and (s := unify(y.argument, x)) is not None:
        return substitute(y.result, s)
    return None


def _compose(first: str, second: str, ahead: bool):
    def rule(x: Cat, y: Cat) -> Cat | None:
        if not (isinstance(x, Slash) and isinstance(y, Slash) and x.slash == first and y.slash == second):
            return None
        outer, inner = (x, y) if ahead else (y, x)
        s = unify(outer.argument, inner.result)
        return None if s is None else Slash(substitute(outer.result, s), inner.slash, substitute(inner.argument, s))

    return rule


APPLICATION = (forward, backward)
HARMONIC = (*APPLICATION, _compose("/", "/", True), _compose("\\", "\\", False))
ALL = (*HARMONIC, _compose("/", "\\", True), _compose("/", "\\", False))
RULES = {"AB": APPLICATION, "harmonic": HARMONIC, "all": ALL}


def lexicon(lines: list[str]) -> dict[str, set[Cat]]:
    """From lines `word := category`; blank lines and # comments are passed over."""
    out: dict[str, set[Cat]] = {}
    for line in lines:
        if line.strip() and not line.lstrip().startswith("#"):
            word, sep, cat = line.partition(":=")
            if not sep:
                raise CategoryError(f"no := in {line!r}")
            out.setdefault(word.strip(), set()).add(parse_category(cat))
    return out


def chart_parse(words: list[str], lex: dict[str, set[Cat]], rules=APPLICATION) -> set[Cat]:
    """All categories of the whole sentence; UnknownWord if the lexicon lacks a word."""
    for w in words:
        if w not in lex:
            raise UnknownWord(w)
    n = len(words)
    chart: dict[tuple[int, int], set[Cat]] = {}
    for j in range(n):
        chart[j, j] = set(lex[words[j]])
        for i in range(j - 1, -1, -1):
            cell: set[Cat] = set()
            for k in range(i, j):
                for a in chart[i, k]:
                    for b in chart[k + 1, j]:
                        x, y = renamed(a, "1"), renamed(b, "2")
                        cell |= {c for r in rules if (c := r(x, y)) is not None}
            chart[i, j] = cell
    return chart.get((0, n - 1), set())


def parse_sentences(df: DataFrame, key: str, sentence: str, lex: list[str], rules: str = "AB") -> DataFrame:
    """(key, categories, error): the categories of each sentence, sorted; error names an unknown word."""
    kind = df.schema[key].dataType.simpleString()
    if rules not in RULES:
        raise ValueError(f"no such rules: {rules}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lx, rs = lexicon(lex), RULES[rules]
        for p in parts:
            rows = []
            for k, s in zip(p["key"], p["s"], strict=True):
                try:
                    rows.append((k, sorted(map(str, chart_parse((s or "").split(), lx, rs))), None))
                except UnknownWord as e:
                    rows.append((k, [], f"unknown word: {e.args[0]}"))
            yield pd.DataFrame(rows, columns=["key", "categories", "error"])

    out = df.select(F.col(key).alias("key"), F.col(sentence).alias("s")).mapInPandas(run, f"key {kind}, categories array<string>, error string")
    return out.withColumnRenamed("key", key)


def testbed(df: DataFrame, line: str, lex: list[str], rules: str = "AB") -> DataFrame:
    """(sentence, expected, found, success): a line that begins with * should have no parse as s."""
    d = df.select(F.col(line).alias("line"), F.ltrim(F.regexp_replace(line, r"^\*", "")).alias("sentence"), (~F.col(line).startswith("*")).alias("expected"))
    got = parse_sentences(d, "line", "sentence", lex, rules).select("line", F.exists("categories", lambda c: (c == "s") | c.startswith("s[")).alias("found"))
    return d.join(got, "line").select("sentence", "expected", "found", (F.col("expected") == F.col("found")).alias("success"))
