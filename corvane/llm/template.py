"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for x in items %} … {% endfor %}   {% if a %} … {% elif b %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}    marks what a model is to learn

Expressions: 'strings', integers, true, false, none, names, x.key and x['key'] (keys of mappings only), ==, !=,
in, and, or, not, ~ (joins texts), ( ), and | filter with the filters that the caller gives. There are no calls,
assignments or attributes of Python objects. Inside a loop, loop.index0 and loop.first are known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from enum import Enum
from typing import Any, NamedTuple

class Mark(Enum):
    """What a compiled template yields besides texts."""

    BEGIN, END, PAUSE = 1, 2, 3


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Key(NamedTuple):
    of: Any
    key: Any


class Op(NamedTuple):
    op: str
    args: tuple


class Filter(NamedTuple):
    name: str
    of: Any


class Out(NamedTuple):
    value: Any


class For(NamedTuple):
    name: str
    items: Any
    body: tuple


class If(NamedTuple):
    test: Any
    then: tuple
    other: tuple


class Generation(NamedTuple):
    body: tuple


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        at = m.end()
        if m[1]:
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            out.append(("const", int(m[2])))
        elif m[3] in ("true", "false", "none"):
            out.append(("const", {"true": True, "false": False, "none": None}[m[3]]))
        else:
            out.append(("word", m[3]) if m[3] else ("sign", m[4]))
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, ~, then filters and keys."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("word", "sign") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, kind: str, value: Any = None) -> Any:
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            raise TemplateError(f"expected {value or kind}, found {v!r}")
        self.at += 1
        return v

    def whole(self):
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def _chain(self, op: str, part: Callable):
        args = [part()]
        while self.take(op):
            args.append(part())
        return args[0] if len(args) == 1 else Op(op, tuple(args))

    def either(self):
        return self._chain("or", lambda: self._chain("and", self.negated))

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self._chain("~", self.filtered)
        op = self.take("==", "!=", "in")
        return Op(op, (left, self._chain("~", self.filtered))) if op else left

    def filtered(self):
        node = self.primary()
        while sign := self.take("|", ".", "["):
            if sign == "|":
                node = Filter(self.need("word"), node)
            elif sign == ".":
                node = Key(node, Const(self.need("word")))
            else:
                node = Key(node, self.either())
                self.need("sign", "]")
        return node

    def primary(self):
        if self.take("("):
            node = self.either()
            self.need("sign", ")")
            return node
        kind, value = self.peek()
        if kind not in ("const", "word"):
            raise TemplateError(f"expected a value, found {value!r}")
        self.at += 1
        return Const(value) if kind == "const" else Name(value)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = _PARTS.split(source)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Out(_Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                nodes += [Out(Const(part))] if part else []
            else:
                said = part[2:-2].strip()
                word, _, rest = said.partition(" ")
                if word in ends:
                    return tuple(nodes), said
                if word == "for":
                    if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                        raise TemplateError(f"can't read {said!r}")
                    nodes.append(For(m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    nodes.append(conditional(rest))
                elif word == "generation":
                    nodes.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown statement {said!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    def conditional(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other = (conditional(end[4:]),)
        else:
            other = block("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), then, other)

    return block()[0]


def _apply(op: str, args: list) -> Any:
    if op == "not":
        return not args[0]
    if op == "~":
        return "".join(_text(a) for a in args)
    a, b = args
    return a == b if op == "==" else a != b if op == "!=" else b is not None and a in b


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The same tree with constant parts computed, constant branches chosen and adjacent texts joined."""
    if isinstance(node, tuple) and type(node) is tuple:
        out: list = []
        for x in (fold(x, filters) for x in node):
            if isinstance(x, Out) and isinstance(x.value, Const):
                text = _text(x.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(out[-1].value.value + text))
                elif text:
                    out.append(Out(Const(text)))
            elif isinstance(x, If) and isinstance(x.test, Const):
                out += x.then if x.test.value else x.other
            else:
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args) and node.op not in ("and", "or"):
            return Const(_apply(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.items, filters), fold(node.body, filters))
    if isinstance(node, If):
        return If(fold(node.test, filters), fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that gives an expression's value in a scope."""
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Key):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def look_up(scope: dict) -> Any:
            held = of(scope)
            return held.get(key(scope)) if isinstance(held, Mapping) else None

        return look_up
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda scope: f(_text(of(scope)))
    args = [_value(a, filters) for a in node.args]
    if node.op == "and":
        return lambda scope: all(a(scope) for a in args)
    if node.op == "or":
        return lambda scope: any(a(scope) for a in args)
    return lambda scope, op=node.op: _apply(op, [a(scope) for a in args])


def _render(nodes: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator]:
    """A closure that yields a body's texts and marks in a scope."""
    steps: list[Callable[[dict], Iterator]] = []
    for node in nodes:
        if isinstance(node, Out):
            value = _value(node.value, filters)
            steps.append(lambda scope, value=value: iter((_text(value(scope)),)))
        elif isinstance(node, If):
            test, then, other = _value(node.test, filters), _render(node.then, filters), _render(node.other, filters)
            steps.append(lambda scope, test=test, then=then, other=other: (then if test(scope) else other)(scope))
        elif isinstance(node, Generation):

            def marked(scope: dict, body=_render(node.body, filters)) -> Iterator:
                yield Mark.BEGIN
                yield from body(scope)
                yield Mark.END

            steps.append(marked)
        else:

            def loop(scope: dict, name=node.name, items=_value(node.items, filters), body=_render(node.body, filters)) -> Iterator:
                for i, item in enumerate(items(scope) or ()):
                    yield from body(scope | {name: item, "loop": {"index0": i, "first": i == 0}})
                    yield Mark.PAUSE

            steps.append(loop)

    def run(scope: dict) -> Iterator:
        for step in steps:
            yield from step(scope)

    return run


def compiled(source: str, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Iterator]:
    """A function that renders the template in a scope: it yields texts, Mark.BEGIN and Mark.END around what is
    to be learned, and Mark.PAUSE after each pass of a loop. Loops take their items one by one."""
    return _render(fold(parse(source), filters), filters)
