"""Bracketed trees: parsing, checking, rendering, and flat trees from token lines.

A tree is an array of nodes (id, parent, depth, ord, name, is_token), parents first. Parsing is one pass over the text with a
stack, in an Arrow-batched function: one row in, one row out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "array<struct<id:int,parent:int,depth:int,ord:int,name:string,is_token:boolean>>"
#: A batch of parsed trees is passed on at this number of nodes, so that a task holds no more than these and one row's.
MOST_NODES = 20_000
_LEX = re.compile(r"\s*([()]|[^\s()]+)")


def parse(text: str | None) -> tuple[list[tuple], int, int, str]:
    """(nodes, warnings, errors, what is left) of the first tree of a text. Errors: a node without children, or whose token has
    siblings; a node without exactly one head (a token, or a name that ends in -H). Nodes are empty if there is no whole tree.
    Blanks after the tree are a warning, anything else an error."""
    nodes: list[tuple] = []
    if text is None or not text.strip():
        return [], 0, 1, ""
    open_: list[int] = []
    kids: list[list[int]] = []
    errors, at, expect_name = 0, 0, False
    while True:
        m = _LEX.match(text, at)
        if not m:
            return [], 0, errors + 1, text.strip()
        t, at = m[1], m.end()
        if t == "(":
            if expect_name:
                return [], 0, errors + 1, text.strip()
            expect_name = True
        elif t == ")":
            if expect_name or not open_:
                return [], 0, errors + 1, text.strip()
            k = open_.pop()
            mine = kids[k]
            tokens = sum(nodes[c][5] for c in mine)
            errors += (not mine) or (tokens > 0 and len(mine) != 1)
            errors += sum(nodes[c][5] or nodes[c][4].endswith("-H") for c in mine) != 1
        else:
            parent = open_[-1] if open_ else -1
            i = len(nodes)
            nodes.append((i, parent, len(open_), len(kids[parent]) if open_ else 0, t, not expect_name))
            kids.append([])
            if parent >= 0:
                kids[parent].append(i)
            if expect_name:
                open_.append(i)
            expect_name = False
        if not open_ and not expect_name:
            break
    rest = text[at:]
    return nodes, int(bool(rest) and not rest.strip()), errors + bool(rest.strip()), rest.strip()


def parse_all(text: str) -> list[tuple[list[tuple], int]]:
    """(nodes, errors) of every tree of a text; it ends where no further tree can be read."""
    out = []
    while text and text.strip():
        nodes, _, errors, rest = parse(text)
        if not nodes:
            out.append(([], errors))
            break
        out.append((nodes, errors - bool(rest)))
        text = rest
    return out


def _children(nodes) -> dict[int, list]:
    out: dict[int, list] = {}
    for n in nodes:
        out.setdefault(n[1], []).append(n)
    return out


def canonical(nodes) -> str:
    """`(b (a 1) (c 2) )`; a token alone is itself."""
    if not nodes:
        return ""
    kids, done = _children(nodes), {}
    for n in reversed(nodes):
        if n[5]:
            done[n[0]] = n[4]
        else:
            mine = kids.get(n[0], [])
            body = " ".join(done[c[0]] for c in mine)
            done[n[0]] = f"({n[4]} {body})" if len(mine) == 1 and mine[0][5] else f"({n[4]} {body} )" if mine else f"({n[4]} )"
    return done[nodes[0][0]]


def pretty(nodes) -> str:
    """The same with every node on a line of its own, indented by its depth."""
    if not nodes:
        return ""
    kids, done = _children(nodes), {}
    for n in reversed(nodes):
        if n[5]:
            done[n[0]] = n[4]
        else:
            mine = kids.get(n[0], [])
            body = " ".join(done[c[0]] for c in mine)
            done[n[0]] = "\n" + "  " * n[2] + (f"({n[4]} {body})" if len(mine) == 1 and mine[0][5] else f"({n[4]} {body} )")
    return done[nodes[0][0]]


def parse_trees(lines: DataFrame, key: str, text: str, several: bool = False) -> DataFrame:
    """(key, tree, nodes, n_warn, n_err, rest, canonical): one row for each text, or for each of its trees."""
    kind = lines.schema[key].dataType.simpleString()
    out = lines.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_parsed(several), f"key {kind}, tree int, nodes {NODE}, n_warn int, n_err int, rest string, canonical string")
    return out.withColumnRenamed("key", key)


def _parsed(several: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows, size = [], 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                found = ((n, 0, e, "") for n, e in parse_all(text or "")) if several else [parse(text)]
                for j, (n, w, e, rest) in enumerate(found):
                    rows.append((i, j, n, w, e, rest, canonical(n)))
                    size += len(n) + 1
                    if size >= MOST_NODES:
                        yield _batch(b.column(0), rows)
                        rows, size = [], 0
            if rows:
                yield _batch(b.column(0), rows)

    return run


def _batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (place of the key, tree, nodes, warnings, errors, rest, canonical form) as columns."""
    i, tree, nodes, warn, err, rest, canon = zip(*rows, strict=True)
    bounds = np.concatenate([[0], np.cumsum([len(n) for n in nodes])]).astype(np.int32)
    columns = list(zip(*(x for n in nodes for x in n), strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
    fields = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    flat = pa.StructArray.from_arrays(fields, ["id", "parent", "depth", "ord", "name", "is_token"])
    number = lambda x: pa.array(x, pa.int32())
    arrays = [keys.take(pa.array(i, pa.int64())), number(tree), pa.ListArray.from_arrays(pa.array(bounds), flat), number([int(x) for x in warn]), number([int(x) for x in err]), pa.array(rest, pa.string()), pa.array(canon, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "tree", "nodes", "n_warn", "n_err", "rest", "canonical"])


def tokens(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["is_token"]), lambda n: n["name"])


def tags(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: ~n["is_token"]), lambda n: n["name"])


def heads(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["is_token"] | n["name"].endswith("-H"))


def token_line_tree(line: Column) -> Column:
    """A flat tree of a token line whose sentences `<EOS>` ends: TOP over S over one x for each token; marks have their own name."""
    safe = F.regexp_replace(F.regexp_replace(line, r"\(", "-LRB-"), r"\)", "-RRB-")
    sentences = F.filter(F.transform(F.split(safe, "<EOS>"), lambda x: F.trim(x)), lambda s: s != "")
    leaf = lambda w: F.concat(F.lit("("), F.when(w.isin(".", ",", "...", "?", "!"), w).otherwise(F.lit("x")), F.lit(" "), w, F.lit(")"))
    sentence = lambda s: F.concat(F.lit("\n    (S "), F.array_join(F.transform(F.split(s, r"\s+"), leaf), " "), F.lit(" )"))
    return F.when(F.size(sentences) == 0, F.lit("(TOP )")).otherwise(F.concat(F.lit("(TOP"), F.array_join(F.transform(sentences, sentence), ""), F.lit(" )")))


MARKUP = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}


def check_tokens(trees: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, tree_token, line_token, problem) where the tokens of trees (key, nodes) and of lines (key, tokens) differ.
    Bracket names may stand for brackets; a typographic quote against a plain one is a problem of its own."""
    a = trees.select(key, F.posexplode(tokens(F.col("nodes"))).alias("pos", "tree_token"))
    b = lines.select(key, F.posexplode("tokens").alias("pos", "line_token"))
    plain = lambda c, m: F.coalesce(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[c], c)
    both = a.join(b, [key, "pos"], "full_outer")
    t, w = plain(F.col("tree_token"), MARKUP), plain(F.col("line_token"), MARKUP)
    problem = F.when(F.col("tree_token").isNull(), "missing in tree").when(F.col("line_token").isNull(), "missing in line").when(t == w, None).when(plain(t, QUOTES) == plain(w, QUOTES), "typographic quote").otherwise("different")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def merge(files: DataFrame, most_errors: int = 0) -> DataFrame:
    """Canonical trees of files (path, text), in order of path; an error if there are more parse errors than allowed."""
    t = parse_trees(files, "path", "text", several=True)
    wrong = F.raise_error(F.lit("merge: too many errors in the trees")).cast("long")
    n = t.agg(F.coalesce(F.sum("n_err"), F.lit(0)).alias("__n")).select(F.when(F.col("__n") > most_errors, wrong).otherwise(F.col("__n")).alias("__n"))
    return t.crossJoin(F.broadcast(n)).where("__n >= 0 AND canonical <> ''").select("path", "tree", "canonical").orderBy("path", "tree")
