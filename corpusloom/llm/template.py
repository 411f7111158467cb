"""A sandboxed template language, compiled to Python closures.

Statements: ``{% for x in e %}``, ``{% if e %} {% elif e %} {% else %}``, ``{% set x = e %}``,
``{% generation %}``; each but ``set`` is closed by ``{% end... %}``. Expressions: literals, names,
``a.b``, ``a['b']``, ``not and or in == != < <= > >= + ~``, parentheses and ``e | filter`` with the filters
given at compile time. There are no calls, and members are looked up in mappings alone, so a
template reaches nothing but the values it is given. Constant expressions and branches are folded.

A compiled template is a generator of (text, generated) pieces: it pulls the messages of a loop one
by one, so a conversation of any length is rendered in bounded memory."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "text": lambda x: "" if x is None else str(x)}

_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.\[\]()]))""")


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind and parts: const value | name id | member a key | op symbol a b | not a | filter a name |
    out a | seq items | for name a body | if [(test, body)] else | set name a | gen body."""

    kind: str
    parts: tuple


_LEVELS = [("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~")]
_OPS = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b,
    "+": operator.add, "~": lambda a, b: f"{'' if a is None else a}{'' if b is None else b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    def __init__(self, source: str, filters):
        self.tokens, self.filters, at = [], filters, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i, self.source = 0, source

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, value=None):
        kind, x = self.peek()
        if kind == "end" or value is not None and x != value:
            raise TemplateError(f"expected {value or 'more'} in {self.source!r}")
        self.i += 1
        return kind, x

    def whole(self) -> Node:
        node = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return node

    def level(self, n: int) -> Node:
        if n == len(_LEVELS):
            return self.unary()
        node = self.level(n + 1)
        while self.peek()[0] in ("op", "name") and self.peek()[1] in _LEVELS[n]:
            symbol = self.take()[1]
            node = fold(Node("op", (symbol, node, self.level(n + 1))))
        return node

    def unary(self) -> Node:
        if self.peek() == ("name", "not"):
            self.take()
            return fold(Node("not", (self.unary(),)))
        node = self.primary()
        while self.peek()[1] in (".", "[", "|") and self.peek()[0] == "op":
            symbol = self.take()[1]
            if symbol == ".":
                kind, key = self.take()
                if kind != "name":
                    raise TemplateError(f"a member's name is missing in {self.source!r}")
                node = Node("member", (node, Node("const", (key,))))
            elif symbol == "[":
                node = Node("member", (node, self.level(0)))
                self.take("]")
            else:
                name = self.take()[1]
                if name not in self.filters:
                    raise TemplateError(f"unknown filter {name!r}")
                node = fold(Node("filter", (node, self.filters[name])))
        return node

    def primary(self) -> Node:
        kind, x = self.take()
        if kind == "str":
            return Node("const", (ast.literal_eval(x),))
        if kind == "num":
            return Node("const", (int(x),))
        if kind == "name":
            return Node("const", (_WORDS[x],)) if x in _WORDS else Node("name", (x,))
        if x == "(":
            node = self.level(0)
            self.take(")")
            return node
        raise TemplateError(f"unexpected {x!r} in {self.source!r}")


def fold(node: Node) -> Node:
    """A node whose operands are constants becomes a constant."""
    kind, parts = node.kind, node.parts
    if kind in ("op", "not", "filter"):
        operands = [x for x in parts if isinstance(x, Node)]
        if all(x.kind == "const" for x in operands):
            try:
                return Node("const", (_evaluate(node)({}),))
            except TypeError as e:
                raise TemplateError(str(e)) from e
    if kind == "out" and parts[0].kind == "const":
        return Node("const", ("" if (v := parts[0].parts[0]) is None else str(v),))
    if kind == "if":
        branches, last = [], parts[1]
        for test, body in parts[0]:
            if test.kind != "const":
                branches.append((test, body))
            elif test.parts[0]:
                last = body
                break
        return Node("if", (tuple(branches), last)) if branches else last
    if kind == "seq":
        flat: list[Node] = []
        for x in (y for item in parts for y in (item.parts if item.kind == "seq" else (item,))):
            if x.kind == "const" and flat and flat[-1].kind == "const":
                flat[-1] = Node("const", (flat[-1].parts[0] + x.parts[0],))
            elif x.kind != "const" or x.parts[0]:
                flat.append(x)
        return Node("seq", tuple(flat))
    return node


def parse(source: str, filters=FILTERS) -> Node:
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("tag", m[1]))
        elif m[2] is not None:
            pieces.append(("out", m[2]))
        at = m.end()
    pieces.append(("text", source[at:]))
    i = 0

    def expression(s: str) -> Node:
        return _Expression(s, filters).whole()

    def body(*ends: str) -> tuple[Node, str]:
        nonlocal i
        items: list[Node] = []
        while i < len(pieces):
            kind, x = pieces[i]
            i += 1
            if kind == "text":
                items.append(Node("const", (x,)))
            elif kind == "out":
                items.append(fold(Node("out", (expression(x),))))
            else:
                word, _, rest = x.partition(" ")
                if word in ends:
                    return fold(Node("seq", tuple(items))), x
                items.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return fold(Node("seq", tuple(items))), ""

    def statement(word: str, rest: str) -> Node:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return Node("for", (m[1], expression(m[2]), body("endfor")[0]))
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
            return Node("set", (m[1], expression(m[2])))
        if word == "generation" and not rest:
            return Node("gen", (body("endgeneration")[0],))
        if word == "if":
            branches, test, last = [], expression(rest), Node("seq", ())
            while True:
                inner, end = body("elif", "else", "endif")
                branches.append((test, inner))
                if not end.startswith("elif"):
                    break
                test = expression(end[4:])
            if end == "else":
                last = body("endif")[0]
            return fold(Node("if", (tuple(branches), last)))
        raise TemplateError(f"unknown statement {word} {rest}")

    return body()[0]


def _evaluate(node: Node) -> Callable[[dict], Any]:
    kind, p = node.kind, node.parts
    if kind == "const":
        value = p[0]
        return lambda env: value
    if kind == "name":
        name = p[0]
        return lambda env: env.get(name)
    if kind == "member":
        of, key = _evaluate(p[0]), _evaluate(p[1])

        def member(env):
            x = of(env)
            return x.get(key(env)) if isinstance(x, dict) else None

        return member
    if kind == "not":
        inner = _evaluate(p[0])
        return lambda env: not inner(env)
    if kind == "filter":
        inner, apply = _evaluate(p[0]), p[1]
        return lambda env: apply(inner(env))
    symbol, a, b = p[0], _evaluate(p[1]), _evaluate(p[2])
    if symbol == "and":
        return lambda env: a(env) and b(env)
    if symbol == "or":
        return lambda env: a(env) or b(env)
    do = _OPS[symbol]
    return lambda env: do(a(env), b(env))


Piece = tuple[str, bool]


def _render(node: Node, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    kind, p = node.kind, node.parts
    if kind == "const":
        piece = ((p[0], generated),)
        return lambda env: iter(piece)
    if kind == "out":
        value = _evaluate(p[0])
        return lambda env: iter((("" if (v := value(env)) is None else str(v), generated),))
    if kind == "seq":
        parts = [_render(x, generated) for x in p]

        def sequence(env):
            for part in parts:
                yield from part(env)

        return sequence
    if kind == "gen":
        return _render(p[0], True)
    if kind == "set":
        name, value = p[0], _evaluate(p[1])

        def assign(env):
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        branches = [(_evaluate(test), _render(inner, generated)) for test, inner in p[0]]
        last = _render(p[1], generated)

        def choose(env):
            return next((inner for test, inner in branches if test(env)), last)(env)

        return choose
    name, items, inner = p[0], _evaluate(p[1]), _render(p[2], generated)

    def loop(env):
        ahead = iter(items(env) or ())
        item, index = next(ahead, loop), 0
        while item is not loop:
            after = next(ahead, loop)
            index += 1
            yield from inner(env | {name: item, "loop": {"first": index == 1, "last": after is loop, "index": index}})
            item = after

    return loop


def compile_template(source: str, filters=FILTERS) -> Callable[[Iterable[dict], dict], Iterator[Piece]]:
    """``render(messages, values)`` yields (text, generated) pieces; ``messages`` may be any iterable."""
    body = _render(parse(source, filters), False)
    return lambda messages, values=None: body({**(values or {}), "messages": messages})
