"""The text query language: lexer, parser, and a compiler to Columns and DataFrames.

    query := or [ "->" or ]     or := and ( ("|" | "or") and )*
    and   := unary ( ["and"] unary )*     unary := ("-" | "not") unary | "(" or ")" | word | "quoted"

Predicates on a node become one Boolean column over nodes and the metrics the query names;
only ``depends-on`` needs a loop, one for all of its targets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.model import Graph
from vinculum.operators import degrees, traversal

_TOKEN = re.compile(r'\s+|(?P<arrow>->)|(?P<mark>[()|-])|"(?P<quoted>[^"]*)"?|(?P<word>(?:(?!->)[^\s()|"])+)')
_FIELD = re.compile(r"(?s)([^:]+):(>=|<=|>|<|=)?(.*)\Z")
#: Names of dependency types, and truths.
DEPENDENCY_NAMES = {"prod": "dependency", "dev": "devDependency", "peer": "peerDependency", "optional": "optionalDependency"}
TRUE = {"true", "1", "yes"}


@dataclass(frozen=True)
class Term:
    """op is one of and, or, not, text, field, path, error."""

    op: str
    items: tuple = ()
    field: str = ""
    compare: str = "="
    value: str = ""


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup]


def _term(word: str, quoted: str | None = None) -> Term:
    m = _FIELD.match(word)
    if not m:
        return Term("text", value=word)
    value = quoted if quoted is not None and not m[2] and not m[3] else m[3]
    sign = m[2]
    if quoted is not None and not sign and (q := re.match(r">=|<=|>|<|=", value)):
        sign, value = q[0], value[q.end() :]
    return Term("field", field=m[1].lower(), compare=sign or "=", value=value)


def parse(text: str) -> Term | None:
    """The query's tree; None for an empty query.  Mistakes are error terms, never exceptions."""
    held = tokens(text)

    def keyword(*words: str) -> bool:
        return bool(held) and (held[0][0] == "word" and held[0][1].lower() in words or held[0] == ("mark", "|") and "or" in words)

    def either() -> Term:
        items = [both()]
        while keyword("or"):
            held.pop(0)
            items.append(both())
        return items[0] if len(items) == 1 else Term("or", tuple(items))

    def both() -> Term:
        items = [one()]
        while held and held[0] != ("mark", ")") and held[0][0] != "arrow" and not keyword("or"):
            if keyword("and"):
                held.pop(0)
            items.append(one())
        return items[0] if len(items) == 1 else Term("and", tuple(items))

    def one() -> Term:
        if not held:
            return Term("error", value="Unexpected end of query")
        if held[0] == ("mark", "-") or keyword("not"):
            held.pop(0)
            return Term("not", (one(),))
        kind, value = held.pop(0)
        if (kind, value) == ("mark", "("):
            inner = either()
            closing = held.pop(0) if held else None
            return inner if closing == ("mark", ")") else Term("error", value="Missing )")
        if kind == "quoted":
            return Term("text", value=value)
        if kind == "word":
            more = held.pop(0)[1] if value.endswith(":") and held and held[0][0] == "quoted" else None
            return _term(value, more)
        return Term("error", value=f'Unexpected "{value}"')

    if not held:
        return None
    tree = either()
    if held and held[0][0] == "arrow":
        held.pop(0)
        tree = Term("path", (tree, either()))
    return Term("error", value=f'Unexpected "{held[0][1]}"') if held else tree


def first_error(tree: Term | None) -> str | None:
    if tree is None:
        return None
    if tree.op == "error":
        return tree.value
    return next((e for t in tree.items if (e := first_error(t))), None)


def number(text: str) -> float | None:
    """A number as the query language reads it: '' is 0, hex, octal and binary prefixes count, junk is none."""
    text = text.strip()
    if not text:
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
        return float(int(text, 0))
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)", text):
        return float(text)
    return None


_METRICS = {"incoming": "n_in", "outgoing": "n_out", "calls": "n_calls"}


class Query:
    """A query over a graph; ``packages`` (filePath, package) feeds ``package:``."""

    def __init__(self, text: str, graph: Graph, packages: DataFrame | None = None):
        self.tree, self.graph, self.packages = parse(text), graph, packages
        self.error = first_error(self.tree)
        self.extra: list[DataFrame] = []

    def _text(self, value: str) -> Column:
        v = F.lit(value.lower())
        return F.contains(F.lower("label"), v) | F.contains(F.lower("filePath"), v)

    def _named(self, name: str, kind: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in self.columns else F.lit(None).cast(kind)

    def _field(self, t: Term) -> Column:
        v = t.value.lower()
        same = lambda c: F.lower(self._named(c, "string", None) if c not in self.columns else F.col(c)) == v
        if t.field in _METRICS:
            n = number(t.value)
            have = F.col(_METRICS[t.field])
            signs = {">": have > n, "<": have < n, ">=": have >= n, "<=": have <= n, "=": have == n} if n is not None else {}
            return signs.get(t.compare, F.lit(False))
        if t.field == "cycle":
            return F.col("in_cycle") == F.lit(v in TRUE)
        if t.field in ("depends-on", "depends_on"):
            targets = self.graph.nodes.filter(self._text(t.value)).select("id")
            name = f"_reach{len(self.extra)}"
            found = traversal.reach(self.graph, targets, forward=False).select("id").withColumn(name, F.lit(True))
            self.extra.append(found)
            return F.coalesce(F.col(name), F.lit(False))
        if t.field == "kind":
            return same("kind")
        if t.field in ("language", "lang"):
            return F.upper(paths.language(F.col("filePath"))) == F.lit(paths.LANGUAGE_NAMES.get(v, t.value).upper())
        if t.field == "path":
            return F.lower("filePath").rlike(paths.query_glob(t.value))
        if t.field in ("environment", "env"):
            return same("environment")
        if t.field == "runtime":
            return F.exists("runtimes", lambda x: F.lower(x) == v) if "runtimes" in self.columns else F.lit(False)
        if t.field in ("category", "role"):
            return same(t.field)
        if t.field in ("package", "pkg"):
            return F.contains(F.lower(F.coalesce("package", "label")), F.lit(v))
        if t.field in ("dependency-type", "dep"):
            return F.lower("dependencyType") == DEPENDENCY_NAMES.get(v, t.value).lower()
        return self._text(t.value)

    def _column(self, t: Term) -> Column:
        if t.op in ("and", "or"):
            out = self._column(t.items[0])
            for x in t.items[1:]:
                out = out & self._column(x) if t.op == "and" else out | self._column(x)
            return out
        if t.op == "not":
            return ~self._column(t.items[0])
        if t.op == "error":
            return F.lit(False)
        return F.coalesce(self._text(t.value) if t.op == "text" else self._field(t), F.lit(False))  # two-valued logic

    def _fields(self, t: Term) -> set[str]:
        return {t.field} | {f for x in t.items for f in self._fields(x)}

    def _select(self, t: Term) -> DataFrame:
        self.columns = set(self.graph.nodes.columns)
        nodes, fields, self.extra = self.graph.nodes, self._fields(t), []
        if fields & set(_METRICS):
            nodes = nodes.join(degrees.degrees(self.graph), "id", "left")
        if "cycle" in fields:
            cyclic = traversal.scc(self.graph).filter("size > 1").select("id", F.lit(True).alias("in_cycle"))
            nodes = nodes.join(cyclic, "id", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
        if fields & {"package", "pkg"}:
            own = self.packages if self.packages is not None else self.graph.nodes.select("filePath").distinct().limit(0).withColumn("package", F.lit(""))
            nodes = nodes.join(own, "filePath", "left")
        wanted = self._column(t)
        for found in self.extra:
            nodes = nodes.join(found, "id", "left")
        return nodes.filter(wanted).select("id")

    def node_ids(self) -> DataFrame:
        if self.tree is None or self.error:
            return self.graph.nodes.select("id").limit(0)
        if self.tree.op == "path":
            e = self._path_edges()
            return e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
        return self._select(self.tree)

    def _path_edges(self) -> DataFrame:
        a, b = (self._select(t) for t in self.tree.items)
        e = self.graph.edges.join(a.withColumnRenamed("id", "source"), "source", "left_semi")
        return e.join(b.withColumnRenamed("id", "target"), "target", "left_semi")

    def edge_ids(self) -> DataFrame:
        """A -> B: the edges between the sets; else the edges between found nodes."""
        if self.tree is not None and not self.error and self.tree.op == "path":
            return self._path_edges().select("id")
        return self.graph.induced(self.node_ids()).edges.select("id")


#: Ready-made queries.
PRESETS = {"cycles": "cycle:true", "hubs": "incoming:>5", "client to server": "env:client -> env:server", "undeclared": "dep:undeclared"}
