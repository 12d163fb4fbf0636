"""A small sandboxed template language for conversations, compiled to Python closures.

Grammar: text, `{{ expression }}`, `{% if e %} … {% elif e %} … {% else %} … {% endif %}`,
`{% for x in e %} … {% endfor %}` and `{% generation %} … {% endgeneration %}`. Expressions have
string and integer literals, names, `name.field`, `+`, `==`, `!=`, `not`, `and`, `or`,
parentheses and `| filter`. There are no calls, no attribute access on Python objects (a field is
a dictionary key) and no unbounded loops, so a template can neither reach the interpreter nor
run on.

Parsing gives a tree of tuples, `fold` evaluates what depends on no name and merges neighbouring
text, and `compile_template` turns the tree into generator closures that yield
(text, is_generation) chunks while they read the messages one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

Chunk = tuple[str, bool]
Render = Callable[[dict], Iterator[Chunk]]

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORD = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not in the language."""


# --- expressions ---------------------------------------------------------------------------


def _words(source: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    while source[at:].strip():
        m = _WORD.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
        at = m.end()
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("lit", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("lit", int(number)))
        elif name is not None:
            out.append(("word" if name in ("and", "or", "not") else "name", name))
        else:
            out.append(("word", sign))
    return out


class _Expression:
    """Precedence climbing over the word list, loosest operator first."""

    LEVELS = (("or",), ("and",), ("==", "!="), ("+",))

    def __init__(self, source: str):
        self.words, self.source = _words(source), source

    def parse(self) -> tuple:
        tree = self.level(0)
        if self.words:
            raise TemplateError(f"cannot read {self.source!r}")
        return tree

    def take(self, *signs: str) -> str | None:
        if self.words and self.words[0][0] == "word" and self.words[0][1] in signs:
            return self.words.pop(0)[1]
        return None

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.piped()
        if n == 2 and self.take("not"):
            return ("not", self.level(n))
        tree = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            tree = (op, tree, self.level(n + 1))
        return tree

    def piped(self) -> tuple:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("field", tree, self.named())
            elif self.take("|"):
                tree = ("filter", tree, self.named())
            else:
                return tree

    def named(self) -> str:
        if not self.words or self.words[0][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        return self.words.pop(0)[1]

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.level(0)
            if not self.take(")"):
                raise TemplateError(f"unbalanced parentheses in {self.source!r}")
            return tree
        if not self.words or self.words[0][0] == "word":
            raise TemplateError(f"an operand is missing in {self.source!r}")
        kind, value = self.words.pop(0)
        return (kind, value)


# --- statements ----------------------------------------------------------------------------


def parse(source: str) -> tuple:
    """Syntax tree of a template: ('block', [nodes])."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    parts.reverse()
    tree, end = _block(parts)
    if end:
        raise TemplateError(f"{end!r} closes nothing")
    return tree


def _block(parts: list[tuple[str, str]]) -> tuple[tuple, str]:
    nodes: list[tuple] = []
    while parts:
        kind, body = parts.pop()
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "out":
            nodes.append(("out", _Expression(body).parse()))
        else:
            head, _, rest = body.partition(" ")
            if head in ("endif", "endfor", "endgeneration", "else", "elif"):
                return ("block", nodes), body
            nodes.append(_statement(head, rest, parts))
    return ("block", nodes), ""


def _statement(head: str, rest: str, parts: list[tuple[str, str]]) -> tuple:
    if head == "if":
        test = _Expression(rest).parse()
        then, end = _block(parts)
        if end.startswith("elif "):
            return ("if", test, then, _statement("if", end[5:], parts))
        other: tuple = ("block", [])
        if end == "else":
            other, end = _block(parts)
        _closes(end, "endif")
        return ("if", test, then, other)
    if head == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"cannot read the loop {rest!r}")
        body, end = _block(parts)
        _closes(end, "endfor")
        return ("for", m[1], _Expression(m[2]).parse(), body)
    if head == "generation":
        body, end = _block(parts)
        _closes(end, "endgeneration")
        return ("generation", body)
    raise TemplateError(f"unknown statement {head!r}")


def _closes(end: str, wanted: str) -> None:
    if end != wanted:
        raise TemplateError(f"{wanted} is missing, found {end!r}")


# --- folding -------------------------------------------------------------------------------


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions evaluated, dead branches gone and texts merged."""
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for n in (fold(n, filters) for n in node[1]):
            for x in n[1] if n[0] == "block" else [n]:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", out)
    if kind == "out":
        e = fold(node[1], filters)
        return ("text", str(e[1])) if e[0] == "lit" else ("out", e)
    if kind == "if":
        test, then, other = (fold(n, filters) for n in node[1:])
        return (then if test[1] else other) if test[0] == "lit" else ("if", test, then, other)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind in ("lit", "name", "text"):
        return node
    if kind in ("field", "filter"):
        folded = (kind, fold(node[1], filters), node[2])
        ready = kind == "filter" and folded[1][0] == "lit"
    else:
        folded = (kind, *(fold(n, filters) for n in node[1:]))
        ready = all(n[0] == "lit" for n in folded[1:])
    return ("lit", _value(folded, filters)({})) if ready else folded


# --- closures ------------------------------------------------------------------------------


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "lit":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env[n]
    if kind == "field":
        of = _value(node[1], filters)
        return lambda env, f=node[2]: of(env)[f]
    if kind == "filter":
        if node[2] not in filters:
            raise TemplateError(f"unknown filter {node[2]!r}")
        of, call = _value(node[1], filters), filters[node[2]]
        return lambda env: call(of(env))
    if kind == "not":
        of = _value(node[1], filters)
        return lambda env: not of(env)
    a, b = _value(node[1], filters), _value(node[2], filters)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)
    return lambda env: a(env) + b(env)


def _renderer(node: tuple, filters: dict[str, Callable]) -> Render:
    kind = node[0]
    if kind == "text":
        chunk = (node[1], False)
        return lambda env: iter((chunk,))
    if kind == "out":
        of = _value(node[1], filters)
        return lambda env: iter(((str(of(env)), False),))
    if kind == "block":
        parts = [_renderer(n, filters) for n in node[1]]

        def block(env: dict) -> Iterator[Chunk]:
            for p in parts:
                yield from p(env)

        return block
    if kind == "if":
        test, then, other = _value(node[1], filters), _renderer(node[2], filters), _renderer(node[3], filters)
        return lambda env: (then if test(env) else other)(env)
    if kind == "generation":
        body = _renderer(node[1], filters)
        return lambda env: ((text, True) for text, _ in body(env))
    name, items, body = node[1], _value(node[2], filters), _renderer(node[3], filters)

    def loop(env: dict) -> Iterator[Chunk]:
        for item, place in _with_place(items(env)):
            yield from body({**env, name: item, "loop": place})

    return loop


def _with_place(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Each item with loop.index0, loop.first and loop.last; reads one item ahead only."""
    i, nothing = 0, object()
    items = iter(items)
    item = next(items, nothing)
    while item is not nothing:
        following = next(items, nothing)
        yield item, {"index0": i, "first": i == 0, "last": following is nothing}
        item, i = following, i + 1


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Render:
    return _renderer(fold(parse(source), filters), filters)
