"""Acceptance by grammars of any shape, recursive ones included.

A grammar's text (rules `name ::= ...` of literals, classes, groups, choices and repetitions) becomes a
graph: a node's edges read one character of a set, go on freely, or call a rule and come back
to a node. A text is accepted by simulating all ways through the graph at once: each pair of a
rule and the place where it was called is one frame, which keeps who waits for it and where it has
ended so far, so nothing is read twice for the same rule and place, left recursion ends, and ambiguous
grammars stay polynomial. Without recursion frames nest to a fixed depth, and time is linear in the text as
long as rules end at few places. Texts go through in Arrow batches, each distinct one once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GrammarError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:#[^\n]*|(?P<rule>[A-Za-z][\w-]*)\s*::=|(?P<literal>"(?:\\.|[^"\\])*")|(?P<set>\[(?:\\.|[^\]\\])*\])|(?P<times>\{\d+(?:,\d*)?\})|(?P<name>[A-Za-z][\w-]*)|(?P<mark>[()|?*+.]))')
_ESCAPE = {"n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Chars:
    """A set of characters: ranges, or all but them."""

    ranges: tuple[tuple[str, str], ...]
    but: bool = False

    def __contains__(self, c: str) -> bool:
        return any(a <= c <= b for a, b in self.ranges) != self.but


@dataclass
class Graph:
    """Nodes by number: edges on characters, free edges, calls of rules; entry and last node of each rule."""

    reads: list[list[tuple[str | Chars, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    calls: list[list[tuple[str, int]]] = field(default_factory=list)
    rules: dict[str, tuple[int, int]] = field(default_factory=dict)

    def node(self) -> int:
        for edges in (self.reads, self.free, self.calls):
            edges.append([])
        return len(self.reads) - 1


def _chars(token: str) -> Chars:
    """A class as it is written, between its brackets."""
    body, but = token[1:-1], token.startswith("[^")
    out, at = [], int(but)
    one = lambda k: ((_ESCAPE.get(body[k + 1], body[k + 1]), k + 2) if body[k] == "\\" else (body[k], k + 1))
    if re.search(r"\\[xuU]", body):
        body = re.sub(r"\\x(..)|\\u(....)|\\U(.{8})", lambda m: re.escape(chr(int(m[1] or m[2] or m[3], 16))) if chr(int(m[1] or m[2] or m[3], 16)) in "\\]^-" else chr(int(m[1] or m[2] or m[3], 16)), body)
    while at < len(body):
        low, at = one(at)
        high = low
        if at + 1 < len(body) and body[at] == "-":
            high, at = one(at + 1)
        if high < low:
            raise GrammarError(f"empty range in {token}")
        out.append((low, high))
    return Chars(tuple(out), but)


def compile_grammar(source: str) -> Graph:
    """The graph of a grammar's text; an error names what is wrong with it."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise GrammarError(f"can't read: {source[at:].strip()[:30]}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    graph, k, named = Graph(), 0, []

    def choice(start: int, end: int) -> None:
        """Alternatives up to a closing bracket or the next rule, each a way from start to end."""
        nonlocal k
        while True:
            now = start
            while k < len(tokens) and tokens[k][0] != "rule" and tokens[k][1] not in ("|", ")"):
                now = repeated(now)
            graph.free[now].append(end)
            if k < len(tokens) and tokens[k] == ("mark", "|"):
                k += 1
                continue
            return

    def item(start: int, kind: str, value: str) -> int:
        nonlocal k
        end = graph.node()
        if kind == "literal":
            text = json.loads(value)
            if text:
                graph.reads[start].append((text, end))
            else:
                graph.free[start].append(end)
        elif kind == "set":
            graph.reads[start].append((_chars(value), end))
        elif kind == "name":
            graph.calls[start].append((value, end))
            named.append(value)
        elif value == ".":
            graph.reads[start].append((Chars((), True), end))
        elif value == "(":
            inner = graph.node()
            graph.free[start].append(inner)
            choice(inner, end)
            if k >= len(tokens) or tokens[k] != ("mark", ")"):
                raise GrammarError("a bracket isn't closed")
            k += 1
        else:
            raise GrammarError(f"unexpected {value}")
        return end

    def repeated(start: int) -> int:
        """One item with its repetition."""
        nonlocal k
        kind, value = tokens[k]
        first = k = k + 1
        end = item(start, kind, value)
        if k >= len(tokens) or not (tokens[k][0] == "times" or tokens[k][1] in ("?", "*", "+")):
            return end
        sign, after = tokens[k][1], k + 1
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign) or _times(sign)

        def again(at: int) -> int:
            nonlocal k
            k = first
            out = item(at, kind, value)
            k = after
            return out

        if most == 0:
            k = after
            return start
        if least == 0:
            graph.free[start].append(end)  # none at all; what is skipped ends where the item would
        copies, now = 1, end
        while copies < least:
            now, copies = again(now), copies + 1
        if most is None:
            loop, out = graph.node(), graph.node()
            graph.free[now].append(loop)
            graph.free[loop].append(out)
            graph.free[again(loop)].append(loop)
            k = after
            return out
        out = graph.node()
        graph.free[now].append(out)
        while copies < most:
            now, copies = again(now), copies + 1
            graph.free[now].append(out)
        k = after
        return out

    while k < len(tokens):
        kind, name = tokens[k]
        if kind != "rule":
            raise GrammarError(f"no rule before {name}")
        k += 1
        start, end = graph.rules.get(name) or (graph.node(), graph.node())
        graph.rules[name] = (start, end)
        choice(start, end)
        if k < len(tokens) and tokens[k][0] != "rule":
            raise GrammarError(f"unexpected {tokens[k][1]}")
    for name in named:
        if name not in graph.rules:
            raise GrammarError(f"undefined rule: {name}")
    return graph


def _times(token: str) -> tuple[int, int | None]:
    low, comma, high = token[1:-1].partition(",")
    least, most = int(low), int(high) if high else None if comma else int(low)
    if most is not None and most < least:
        raise GrammarError(f"impossible repetition {token}")
    return least, most


class Reader:
    """A graph made ready to read texts: what each node can do by free edges too, and where a character leads, looked up once."""

    def __init__(self, graph: Graph):
        n = len(graph.reads)
        ends = {end: name for name, (_, end) in graph.rules.items()}
        self.rules = graph.rules
        self.longer: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        self.single: list[list[tuple[str | Chars, int]]] = [[] for _ in range(n)]
        self.calls: list[list[tuple[str, int]]] = [[] for _ in range(n)]
        self.ends: list[frozenset[str]] = [frozenset()] * n
        self.moves: list[dict[str, tuple[int, ...]]] = [{} for _ in range(n)]
        for node in range(n):
            reached, work = {node}, [node]
            while work:
                for to in graph.free[work.pop()]:
                    if to not in reached:
                        reached.add(to)
                        work.append(to)
            self.ends[node] = frozenset(ends[k] for k in reached if k in ends)
            for k in reached:
                self.calls[node] += graph.calls[k]
                for what, to in graph.reads[k]:
                    (self.longer if isinstance(what, str) and len(what) > 1 else self.single)[node].append((what, to))

    def leads(self, node: int, c: str) -> tuple[int, ...]:
        got = self.moves[node].get(c)
        if got is None:
            got = self.moves[node][c] = tuple(dict.fromkeys(to for what, to in self.single[node] if c in what))
        return got

    def accepts(self, text: str, root: str = "root") -> bool:
        """Whether the rule `root` can read the whole text."""
        if root not in self.rules:
            raise GrammarError(f"undefined rule: {root}")
        size, top = len(text), (root, 0)
        waiting: dict[tuple[str, int], list] = {top: []}
        ended: dict[tuple[str, int], set[int]] = {top: set()}
        first = (self.rules[root][0], top, 0)
        seen, work = {first}, [first]
        while work:
            node, frame, at = work.pop()
            made = []
            if frame[0] in self.ends[node] and at not in ended[frame]:
                if frame == top and at == size:
                    return True
                ended[frame].add(at)
                made += [(back, caller, at) for back, caller in waiting[frame]]
            if at < size:
                made += [(to, frame, at + 1) for to in self.leads(node, text[at])]
                made += [(to, frame, at + len(what)) for what, to in self.longer[node] if text.startswith(what, at)]
            for name, back in self.calls[node]:
                called = (name, at)
                if called not in waiting:
                    waiting[called], ended[called] = [], set()
                    made.append((self.rules[name][0], called, at))
                waiting[called].append((back, frame))
                made += [(back, frame, end) for end in ended[called]]
            for state in made:
                if state not in seen:
                    seen.add(state)
                    work.append(state)
        return False


def accepts(graph: Graph, text: str, root: str = "root") -> bool:
    """Whether the rule `root` can read the whole text."""
    return Reader(graph).accepts(text, root)


def accepted_by(source: str, text: Column, root: str = "root") -> Column:
    """Whether the grammar accepts the whole text; null for null."""
    compile_grammar(source)  # errors show before any task runs

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(compile_grammar(source))
        for texts in batches:
            known = {t: reader.accepts(t, root) for t in texts.dropna().unique()}
            yield texts.map(lambda t, known=known: known.get(t)).astype("object")

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(judge, T.BooleanType())(text)


#: JSON as a grammar: recursive through values, lists and objects.
JSON = r'''
root   ::= ws value ws
value  ::= object | list | string | number | "true" | "false" | "null"
object ::= "{" ws ( member ( "," ws member )* )? "}"
member ::= string ws ":" ws value ws
list   ::= "[" ws ( value ws ( "," ws value ws )* )? "]"
string ::= "\"" ( [^"\\\x00-\x1F] | "\\" ( ["\\/bfnrt] | "u" [0-9a-fA-F]{4} ) )* "\""
number ::= "-"? ( "0" | [1-9] [0-9]* ) ( "." [0-9]+ )? ( [eE] [+-]? [0-9]+ )?
ws     ::= [ \t\n\r]*
'''
