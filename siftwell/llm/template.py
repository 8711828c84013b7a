"""A small sandboxed template language, compiled to Python closures.

Source -> tokens -> syntax tree -> folded tree -> closures. There are no calls, no attributes of Python
objects and no imports: a name looks up the context, ``a.b`` and ``a['b']`` look up mappings only, and
filters come from a fixed table. Statements: ``{% for x in xs %}`` (with loop.index, loop.index0,
loop.first, loop.last), ``{% if %} {% elif %} {% else %}``, ``{% set x = expr %}`` and
``{% generation %} ... {% endgeneration %}``, whose output is what a model would have written (the loss
mask). Expressions: strings, integers, true, false, none, names, look-ups, ``not and or``, comparisons,
``in``, ``+ - *``, ``~`` (text concatenation), conditional ``a if c else b`` and filters ``x | f``.

Folding evaluates operators on constants, drops branches that cannot be taken and joins neighbouring
text, so the closures do only what depends on the conversation. Rendering is push-based: a loop pulls
its items one by one and every piece of output goes to ``emit(text, masked)`` at once.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template is malformed or asks for something outside the sandbox."""


# ---- syntax tree ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Lookup:
    base: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    arg: Any
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Any


@dataclass(frozen=True)
class If:
    arms: tuple[tuple[Any, tuple], ...]
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parsing -------------------------------------------------------------------------------------

_SPLIT = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].|~+*=-]))""", re.S)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_RESERVED = {"and", "or", "not", "in", "if", "else"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.toks.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] in ("op", "name") and self.toks[self.at][1] in texts

    def eat(self, *texts: str) -> str | None:
        if self.peek(*texts):
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise TemplateError(f"expected {text!r}")

    def word(self) -> str:
        if self.at >= len(self.toks) or self.toks[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.toks[self.at - 1][1]

    def whole(self) -> Any:
        tree = self.choice()
        if self.at < len(self.toks):
            raise TemplateError(f"left over: {self.toks[self.at][1]!r}")
        return tree

    def choice(self) -> Any:
        yes = self.disjunction()
        if self.eat("if"):
            test = self.disjunction()
            return Choice(test, yes, self.choice() if self.eat("else") else Const(""))
        return yes

    def disjunction(self) -> Any:
        tree = self.conjunction()
        while self.eat("or"):
            tree = Binary("or", tree, self.conjunction())
        return tree

    def conjunction(self) -> Any:
        tree = self.negation()
        while self.eat("and"):
            tree = Binary("and", tree, self.negation())
        return tree

    def negation(self) -> Any:
        return Unary("not", self.negation()) if self.eat("not") else self.comparison()

    def comparison(self) -> Any:
        tree = self.sum()
        while op := self.eat(*_COMPARE, "in"):
            tree = Binary(op, tree, self.sum())
        return tree

    def sum(self) -> Any:
        tree = self.product()
        while op := self.eat("+", "-", "~"):
            tree = Binary(op, tree, self.product())
        return tree

    def product(self) -> Any:
        tree = self.filtered()
        while self.eat("*"):
            tree = Binary("*", tree, self.filtered())
        return tree

    def filtered(self) -> Any:
        tree = self.atom()
        while True:
            if self.eat("|"):
                tree = Filter(tree, self.word())
            elif self.eat("."):
                tree = Lookup(tree, Const(self.word()))
            elif self.eat("["):
                tree = Lookup(tree, self.choice())
                self.need("]")
            else:
                return tree

    def atom(self) -> Any:
        if self.eat("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.toks):
            raise TemplateError("an expression ends too soon")
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name" and text not in _RESERVED:
            return Const(_WORDS[text]) if text in _WORDS else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _SPLIT.split(source)
    for k, p in enumerate(parts):  # white space control: {%- and -%}
        if k % 2 and p[2:3] == "-" and k:
            parts[k - 1] = parts[k - 1].rstrip()
        if k % 2 and p[-3:-2] == "-" and k + 1 < len(parts):
            parts[k + 1] = parts[k + 1].lstrip()
    items = [(k % 2, p) for k, p in enumerate(parts) if p]
    at = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal at
        out: list[Any] = []
        while at < len(items):
            is_tag, p = items[at]
            at += 1
            if not is_tag:
                out.append(Text(p))
                continue
            if p.startswith("{#"):
                continue
            inner = p[2:-2].strip("-").strip()
            if p.startswith("{{"):
                out.append(Output(_Expression(inner).whole()))
                continue
            head, _, rest = inner.partition(" ")
            if head in ends:
                return tuple(out), inner
            if head == "for":
                e = _Expression(rest)
                name = e.word()
                e.need("in")
                items_ = e.whole()
                inside, _ = body(("endfor",))
                out.append(For(name, items_, inside))
            elif head == "if":
                arms, other, test = [], (), _Expression(rest).whole()
                while True:
                    inside, end = body(("elif", "else", "endif"))
                    if test is None:
                        other = inside
                    else:
                        arms.append((test, inside))
                    if end == "endif":
                        break
                    if test is None:
                        raise TemplateError("something follows else")
                    test = _Expression(end.partition(" ")[2]).whole() if end.startswith("elif") else None
                out.append(If(tuple(arms), other))
            elif head == "set":
                e = _Expression(rest)
                name = e.word()
                e.need("=")
                out.append(Assign(name, e.whole()))
            elif head == "generation":
                inside, _ = body(("endgeneration",))
                out.append(Generation(inside))
            else:
                raise TemplateError(f"unknown statement {head!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return body(())[0]


# ---- values, folding -----------------------------------------------------------------------------


def as_text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def lookup(base: Any, key: Any) -> Any:
    """Mappings only: nothing of a Python object is reachable."""
    return base.get(key) if isinstance(base, Mapping) else None


_FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: as_text(v).strip(),
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, Mapping)) else 0,
    "string": as_text,
}


def _binary(op: str, a: Any, b: Any) -> Any:
    if op in _COMPARE:
        try:
            return _COMPARE[op](a, b)
        except TypeError:
            return False
    if op == "in":
        return isinstance(b, (str, list, tuple, Mapping)) and (not isinstance(b, str) or isinstance(a, str)) and a in b
    if op == "~":
        return as_text(a) + as_text(b)
    if isinstance(a, str) or isinstance(b, str):
        if op == "+":
            return as_text(a) + as_text(b)
        raise TemplateError(f"{op} needs numbers")
    return {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](a or 0, b or 0)


def fold_expr(e: Any, filters: Mapping[str, Callable]) -> Any:
    """The expression with everything computed that no context can change."""
    match e:
        case Unary(op, arg):
            arg = fold_expr(arg, filters)
            return Const(not arg.value) if isinstance(arg, Const) else Unary(op, arg)
        case Binary(op, a, b):
            a, b = fold_expr(a, filters), fold_expr(b, filters)
            if op in ("and", "or"):
                if isinstance(a, Const):
                    return b if bool(a.value) == (op == "and") else a
                return Binary(op, a, b)
            return Const(_binary(op, a.value, b.value)) if isinstance(a, Const) and isinstance(b, Const) else Binary(op, a, b)
        case Choice(test, yes, no):
            test = fold_expr(test, filters)
            if isinstance(test, Const):
                return fold_expr(yes if test.value else no, filters)
            return Choice(test, fold_expr(yes, filters), fold_expr(no, filters))
        case Filter(arg, name):
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            arg = fold_expr(arg, filters)
            return Const(filters[name](arg.value)) if isinstance(arg, Const) else Filter(arg, name)
        case Lookup(base, key):
            base, key = fold_expr(base, filters), fold_expr(key, filters)
            return Const(lookup(base.value, key.value)) if isinstance(base, Const) and isinstance(key, Const) else Lookup(base, key)
    return e


def fold(body: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The body with constant output as text, dead branches gone and neighbouring text joined."""
    out: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Text):
            if not node.text:
                return
            if out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
                return
        out.append(node)

    for node in body:
        match node:
            case Output(e):
                e = fold_expr(e, filters)
                add(Text(as_text(e.value)) if isinstance(e, Const) else Output(e))
            case Assign(name, e):
                add(Assign(name, fold_expr(e, filters)))
            case For(name, items, inner):
                add(For(name, fold_expr(items, filters), fold(inner, filters)))
            case Generation(inner):
                add(Generation(fold(inner, filters)))
            case If(arms, other):
                live: list[tuple[Any, tuple]] = []
                rest = fold(other, filters)
                for test, inner in arms:
                    test = fold_expr(test, filters)
                    if isinstance(test, Const) and not test.value:
                        continue
                    if isinstance(test, Const):
                        rest = fold(inner, filters)
                        break
                    live.append((test, fold(inner, filters)))
                if live:
                    add(If(tuple(live), rest))
                else:
                    for sub in rest:
                        add(sub)
            case _:
                add(node)
    return tuple(out)


# ---- closures ------------------------------------------------------------------------------------

Emit = Callable[[str, bool], None]


@dataclass
class Frame:
    names: dict[str, Any]
    emit: Emit
    masked: int = 0
    loops: list[dict[str, Any]] = field(default_factory=list)


def _expr(e: Any, filters: Mapping[str, Callable]) -> Callable[[Frame], Any]:
    match e:
        case Const(value):
            return lambda f: value
        case Name(name):
            return lambda f: f.names.get(name)
        case Lookup(base, Const(key)):
            get = _expr(base, filters)
            return lambda f: lookup(get(f), key)
        case Lookup(base, key):
            get, k = _expr(base, filters), _expr(key, filters)
            return lambda f: lookup(get(f), k(f))
        case Unary(_, arg):
            get = _expr(arg, filters)
            return lambda f: not get(f)
        case Binary("and", a, b):
            x, y = _expr(a, filters), _expr(b, filters)
            return lambda f: x(f) and y(f)
        case Binary("or", a, b):
            x, y = _expr(a, filters), _expr(b, filters)
            return lambda f: x(f) or y(f)
        case Binary(op, a, b):
            x, y = _expr(a, filters), _expr(b, filters)
            return lambda f: _binary(op, x(f), y(f))
        case Choice(test, yes, no):
            t, y, n = (_expr(p, filters) for p in (test, yes, no))
            return lambda f: y(f) if t(f) else n(f)
        case Filter(arg, name):
            get, fn = _expr(arg, filters), filters[name]
            return lambda f: fn(get(f))
    raise TemplateError(f"not an expression: {e!r}")


def _body(body: tuple, filters: Mapping[str, Callable]) -> Callable[[Frame], None]:
    steps = [_step(node, filters) for node in body]

    def run(f: Frame) -> None:
        for step in steps:
            step(f)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any, filters: Mapping[str, Callable]) -> Callable[[Frame], None]:
    match node:
        case Text(text):
            return lambda f: f.emit(text, f.masked > 0)
        case Output(e):
            get = _expr(e, filters)
            return lambda f: f.emit(as_text(get(f)), f.masked > 0)
        case Assign(name, e):
            get = _expr(e, filters)

            def assign(f: Frame) -> None:
                f.names[name] = get(f)

            return assign
        case If(arms, other):
            tests = [(_expr(t, filters), _body(b, filters)) for t, b in arms]
            rest = _body(other, filters) if other else None

            def branch(f: Frame) -> None:
                for test, then in tests:
                    if test(f):
                        return then(f)
                if rest:
                    rest(f)

            return branch
        case Generation(inner):
            run = _body(inner, filters)

            def generation(f: Frame) -> None:
                f.masked += 1
                try:
                    run(f)
                finally:
                    f.masked -= 1

            return generation
        case For(name, items, inner):
            get, run = _expr(items, filters), _body(inner, filters)

            def loop(f: Frame) -> None:
                it = iter(get(f) or ())
                saved = {k: f.names.get(k) for k in (name, "loop")}
                k, end = 0, object()
                item = next(it, end)
                while item is not end:
                    after = next(it, end)  # one item ahead, for loop.last
                    f.names[name] = item
                    f.names["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": after is end}
                    run(f)
                    item, k = after, k + 1
                f.names.update(saved)

            return loop
    raise TemplateError(f"not a statement: {node!r}")


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None) -> Callable[[Mapping[str, Any], Emit], None]:
    """``render(context, emit)``: the template as closures. Values of the context may be iterators."""
    table = _FILTERS | dict(filters or {})
    run = _body(fold(parse(source), table), table)

    def render(context: Mapping[str, Any], emit: Emit) -> None:
        run(Frame(dict(context), emit))

    return render


def render_text(source: str, context: Mapping[str, Any], filters: Mapping[str, Callable[[Any], Any]] | None = None) -> tuple[str, list[tuple[int, int]]]:
    """The output and its masked spans (code points, neighbouring ones joined)."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def emit(text: str, masked: bool) -> None:
        nonlocal at
        if text:
            parts.append(text)
            if masked:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            at += len(text)

    compile_template(source, filters)(context, emit)
    return "".join(parts), spans

