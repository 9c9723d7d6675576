"""Chat templates from files: a small interpreter of the Jinja subset that chat templates use.

No template engine is a dependency. Template files are given by path (the
public ones of model publishers, or a user's own) and rendered inside one
Arrow pass over the records; compiled once per worker.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that cannot be read, or one that raised an exception."""


class Undefined:
    """What an unknown name or key gives: false, empty, printed as nothing."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __iter__(self) -> Iterator:
        return iter(())

    def __len__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None  # type: ignore[assignment]


UNDEFINED = Undefined()
# Delimiters inside string literals end nothing.
_INNER = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|.)*?"""
_PARTS = re.compile(rf"\{{%([-+]?)({_INNER})([-+]?)%\}}|\{{\{{([-+]?)({_INNER})([-+]?)\}}\}}|\{{#(-?).*?(-?)#\}}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>=(){}\[\],.:|]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], "\\" + m[1]), s[1:-1], flags=re.S)


def show(v: Any) -> str:
    if v is None:
        return "None"
    if isinstance(v, bool):
        return "True" if v else "False"
    return v if isinstance(v, str) else str(v)


def to_json(v: Any, indent: int | None = None) -> str:
    if isinstance(v, Undefined):
        return "null"
    return json.dumps(v, ensure_ascii=False, sort_keys=True, indent=indent, separators=(",", ": ") if indent else (",", ":"))


class Expression:
    """Recursive-descent parser that builds closures over a scope."""

    LEVELS = (("or",), ("and",))

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {text[at : at + 30]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r} at {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name at {value!r}")
        self.i += 1
        return value

    def parse(self):  # noqa: ANN201
        a = self.either()
        if self.take("if"):
            test = self.either()
            other = self.parse() if self.take("else") else lambda s: UNDEFINED
            return lambda s: a(s) if test(s) else other(s)
        return a

    def either(self):  # noqa: ANN201
        a = self.both()
        while self.take("or"):
            a = (lambda x, y: lambda s: x(s) or y(s))(a, self.both())
        return a

    def both(self):  # noqa: ANN201
        a = self.negation()
        while self.take("and"):
            a = (lambda x, y: lambda s: x(s) and y(s))(a, self.negation())
        return a

    def negation(self):  # noqa: ANN201
        if self.take("not"):
            a = self.negation()
            return lambda s: not a(s)
        return self.comparison()

    def comparison(self):  # noqa: ANN201
        a = self.sum()
        ops = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
        while True:
            kind, value = self.peek()
            if kind == "op" and value in ops:
                self.i += 1
                a = (lambda x, y, f: lambda s: f(x(s), y(s)))(a, self.sum(), ops[value])
            elif kind == "name" and value == "in":
                self.i += 1
                a = (lambda x, y: lambda s: x(s) in y(s))(a, self.sum())
            elif kind == "name" and value == "not" and self.peek(1)[1] == "in":
                self.i += 2
                a = (lambda x, y: lambda s: x(s) not in y(s))(a, self.sum())
            elif kind == "name" and value == "is":
                self.i += 1
                negated = self.take("not")
                test = TESTS.get(self.name())
                if test is None:
                    raise TemplateError("unknown test")
                a = (lambda x, f, n: lambda s: f(x(s)) != n)(a, test, negated)
            else:
                return a

    def sum(self):  # noqa: ANN201
        a = self.product()
        while self.peek()[0] == "op" and self.peek()[1] in "+-~":
            op = self.peek()[1]
            self.i += 1
            b = self.product()
            f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "~": lambda x, y: show(x) + show(y)}[op]
            a = (lambda x, y, g: lambda s: g(x(s), y(s)))(a, b, f)
        return a

    def product(self):  # noqa: ANN201
        a = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in ("*", "/", "//", "%"):
            op = self.peek()[1]
            self.i += 1
            b = self.unary()
            f = {"*": lambda x, y: x * y, "/": lambda x, y: x / y, "//": lambda x, y: x // y, "%": lambda x, y: x % y}[op]
            a = (lambda x, y, g: lambda s: g(x(s), y(s)))(a, b, f)
        return a

    def unary(self):  # noqa: ANN201
        if self.take("-"):
            a = self.unary()
            return lambda s: -a(s)
        return self.postfix(self.atom())

    def arguments(self) -> tuple[list, dict]:
        args, kwargs = [], {}
        while not self.take(")"):
            if self.peek()[0] == "name" and self.peek(1)[1] == "=":
                key = self.name()
                self.i += 1
                kwargs[key] = self.parse()
            else:
                args.append(self.parse())
            self.take(",")
        return args, kwargs

    def postfix(self, a):  # noqa: ANN001, ANN201
        while True:
            if self.take("."):
                a = (lambda x, k: lambda s: attribute(x(s), k))(a, self.name())
            elif self.take("["):
                a = self.subscript(a)
            elif self.take("("):
                args, kwargs = self.arguments()
                a = (lambda x, p, q: lambda s: x(s)(*[v(s) for v in p], **{k: v(s) for k, v in q.items()}))(a, args, kwargs)
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                args, kwargs = self.arguments() if self.take("(") else ([], {})
                a = (lambda x, f, p, q: lambda s: f(x(s), *[v(s) for v in p], **{k: v(s) for k, v in q.items()}))(a, FILTERS[name], args, kwargs)
            else:
                return a

    def subscript(self, a):  # noqa: ANN001, ANN201
        parts: list = [None]
        while not self.take("]"):
            if self.take(":"):
                parts.append(None)
            else:
                parts[-1] = self.parse()
        if len(parts) == 1:
            return (lambda x, k: lambda s: item(x(s), k(s)))(a, parts[0])
        return (lambda x, p: lambda s: x(s)[slice(*[v(s) if v else None for v in p])])(a, parts)

    def atom(self):  # noqa: ANN201
        kind, value = self.peek()
        self.i += 1
        if kind == "num":
            n = float(value) if "." in value else int(value)
            return lambda s: n
        if kind == "str":
            text = _unquote(value)
            while self.peek()[0] == "str":
                text += _unquote(self.peek()[1])
                self.i += 1
            return lambda s: text
        if kind == "name":
            fixed = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None, "null": None}
            if value in fixed:
                return lambda s: fixed[value]
            return lambda s: s.get(value)
        if value == "(":
            items = [self.parse()]
            tuple_ = False
            while self.take(","):
                tuple_ = True
                if self.peek()[1] != ")":
                    items.append(self.parse())
            self.need(")")
            return (lambda s: tuple(i(s) for i in items)) if tuple_ else items[0]
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.parse())
                self.take(",")
            return lambda s: [i(s) for i in items]
        if value == "{":
            pairs = []
            while not self.take("}"):
                key = self.parse()
                self.need(":")
                pairs.append((key, self.parse()))
                self.take(",")
            return lambda s: {k(s): v(s) for k, v in pairs}
        raise TemplateError(f"cannot read an expression at {value!r}")


class Namespace:
    def __init__(self, **values: Any) -> None:
        self.__dict__.update(values)


METHODS = {
    str: ("split", "strip", "lstrip", "rstrip", "startswith", "endswith", "replace", "upper", "lower", "title", "join"), dict: ("items", "keys", "values", "get"), list: ("append", "index"),
}


def attribute(v: Any, key: str) -> Any:
    if isinstance(v, dict):
        if key in v:
            return v[key]
        return getattr(v, key) if key in METHODS[dict] else UNDEFINED
    if isinstance(v, Namespace):
        return v.__dict__.get(key, UNDEFINED)
    for kind, names in METHODS.items():
        if isinstance(v, kind) and key in names:
            return getattr(v, key)
    return UNDEFINED


def item(v: Any, key: Any) -> Any:
    try:
        return v[key]
    except (KeyError, IndexError, TypeError):
        return attribute(v, key) if isinstance(key, str) else UNDEFINED


TESTS = {
    "defined": lambda v: not isinstance(v, Undefined), "undefined": lambda v: isinstance(v, Undefined), "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict),
    "iterable": lambda v: isinstance(v, (str, list, dict, tuple)), "sequence": lambda v: isinstance(v, (str, list, tuple)), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool), "true": lambda v: v is True, "false": lambda v: v is False,
}
FILTERS = {
    "trim": lambda v: show(v).strip(), "tojson": lambda v, indent=None: to_json(v, indent), "length": len, "count": len, "items": lambda v: list(v.items()) if isinstance(v, dict) else [], "upper": lambda v: show(v).upper(),
    "lower": lambda v: show(v).lower(), "default": lambda v, d="", empty=False: d if isinstance(v, Undefined) or empty and not v else v, "join": lambda v, sep="": sep.join(map(show, v)), "list": list, "string": show,
    "first": lambda v: v[0] if len(v) else UNDEFINED, "last": lambda v: v[-1] if len(v) else UNDEFINED, "replace": lambda v, a, b: v.replace(a, b), "safe": lambda v: v, "int": int, "map": lambda v, attribute_="", **k: [attribute(x, k.get("attribute", attribute_)) for x in v],
}


class Scope:
    """Names of a block; assignments stay inside loops and macros, as chat templates expect."""

    def __init__(self, values: dict, up: Scope | None = None) -> None:
        self.values, self.up = values, up

    def get(self, name: str) -> Any:
        at: Scope | None = self
        while at is not None:
            if name in at.values:
                return at.values[name]
            at = at.up
        return UNDEFINED


def _raise(message: str = "") -> None:
    raise TemplateError(message)


BASE = {
    "namespace": Namespace, "range": lambda *a: list(range(*a)), "dict": dict, "raise_exception": _raise, "raiseException": _raise, "strftime_now": lambda f: datetime.datetime.now(datetime.timezone.utc).strftime(f),
}


class Template:
    """A compiled template; ``render`` takes the context as keywords."""

    def __init__(self, text: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> None:
        self.nodes: list[tuple] = []
        at, strip_next = 0, False
        for m in _PARTS.finditer(text):
            literal = text[at : m.start()]
            block = m[2] is not None
            left, right = (m[1], m[3]) if block else (m[4], m[6]) if m[5] is not None else (m[7], m[8])
            if strip_next:
                literal = literal.lstrip()
            elif trim_blocks and self.nodes and self.nodes[-1][0] == "block" and literal.startswith("\n"):
                literal = literal[1:]
            if left == "-":
                literal = literal.rstrip()
            elif lstrip_blocks and block and left != "+":
                literal = re.sub(r"(^|\n)[ \t]+\Z", r"\1", literal)
            if literal:
                self.nodes.append(("text", literal))
            if block:
                self.nodes.append(("block", m[2].strip()))
            elif m[5] is not None:
                self.nodes.append(("show", Expression(m[5]).parse()))
            strip_next, at = right == "-", m.end()
        rest = text[at:].lstrip() if strip_next else text[at:]
        if rest.endswith("\n"):
            rest = rest[:-1]
        if rest:
            self.nodes.append(("text", rest))
        self.i = 0
        self.body, stop = self._body()
        if stop:
            raise TemplateError(f"unexpected {stop!r}")

    def _body(self, *ends: str) -> tuple[list, str]:
        out: list = []
        while self.i < len(self.nodes):
            kind, value = self.nodes[self.i]
            self.i += 1
            if kind == "text":
                out.append(lambda s, o, t=value: o.append(t))
            elif kind == "show":
                out.append(lambda s, o, e=value: o.append(show(e(s))))
            else:
                word, _, rest = value.partition(" ")
                if word in ends or word.startswith("end") and value in ends:
                    return out, value
                out.append(self._statement(word, rest))
        if ends:
            raise TemplateError(f"a block lacks its {ends[-1]!r}")
        return out, ""

    def _statement(self, word: str, rest: str):  # noqa: ANN202
        if word == "if":
            arms, test = [], Expression(rest).parse()
            while True:
                body, stop = self._body("elif", "else", "endif")
                arms.append((test, body))
                if stop == "endif":
                    break
                test = Expression(stop[4:]).parse() if stop.startswith("elif") else lambda s: True

            def choose(s: Scope, o: list) -> None:
                for t, b in arms:
                    if t(s):
                        run(b, s, o)
                        return

            return choose
        if word == "for":
            e = Expression(rest)
            names = [e.name()]
            while e.take(","):
                names.append(e.name())
            e.need("in")
            source = e.either()
            only = e.either() if e.take("if") else None
            body, stop = self._body("else", "endfor")
            other = self._body("endfor")[0] if stop == "else" else []

            def loop(s: Scope, o: list) -> None:
                items = source(s)
                items = list(items.items() if isinstance(items, dict) and len(names) == 2 else items)
                bound = [dict(zip(names, x)) if len(names) > 1 else {names[0]: x} for x in items]
                if only is not None:
                    bound = [b for b in bound if only(Scope(b, s))]
                for k, b in enumerate(bound):
                    n = len(bound)
                    b["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n, "revindex": n - k, "previtem": bound[k - 1][names[0]] if k else UNDEFINED, "nextitem": bound[k + 1][names[0]] if k + 1 < n else UNDEFINED}
                    run(body, Scope(b, s), o)
                if not bound:
                    run(other, s, o)

            return loop
        if word == "set":
            target, _, value = rest.partition("=")
            expression, target = Expression(value).parse(), target.strip()
            if "." in target:
                owner, key = target.split(".")

                def put(s: Scope, o: list) -> None:
                    setattr(s.get(owner.strip()), key.strip(), expression(s))

                return put

            def assign(s: Scope, o: list) -> None:
                s.values[target] = expression(s)

            return assign
        if word == "macro":
            e = Expression(rest)
            name = e.name()
            e.need("(")
            params: list[tuple[str, Any]] = []
            while not e.take(")"):
                p = e.name()
                params.append((p, e.parse() if e.take("=") else None))
                e.take(",")
            body, _ = self._body("endmacro")

            def define(s: Scope, o: list) -> None:
                def call(*args: Any, **kwargs: Any) -> str:
                    given = {p: args[k] if k < len(args) else kwargs.get(p, d(s) if d else UNDEFINED) for k, (p, d) in enumerate(params)}
                    out: list[str] = []
                    run(body, Scope(given, s), out)
                    return "".join(out)

                s.values[name] = call

            return define
        if word in ("generation", "endgeneration"):
            return lambda s, o: None
        raise TemplateError(f"unknown statement {word!r}")

    def render(self, **context: Any) -> str:
        out: list[str] = []
        run(self.body, Scope(dict(context), Scope(BASE)), out)
        return "".join(out)


def run(body: list, s: Scope, o: list) -> None:
    for f in body:
        f(s, o)


def template_messages(record: dict) -> list[dict]:
    """Messages of a record for a template: turns, each tool output as a ``tool`` message after its turn, neighbours' roles."""

    def value(text: str | None) -> Any:
        if text is None:
            return None
        try:
            return json.loads(text)
        except ValueError:
            return text

    def words(out: dict) -> str:
        if out.get("text"):
            return out["text"]
        blocks = "\n".join(b["text"] for b in out.get("content") or [] if b and b.get("text"))
        raw = value(out.get("raw"))
        return blocks or ("" if raw is None else raw if isinstance(raw, str) else to_json(raw))

    out: list[dict] = []
    for i, t in enumerate(record.get("turns") or []):
        if t is None:
            continue
        m = {"role": t.get("role") or "", "content": t.get("text") or "", "reasoning": t.get("reasoning") or "", "timestamp": t.get("timestamp") or "", "attachments": [b for b in t.get("attachments") or [] if b]}
        calls = [(j, c) for j, c in enumerate(t.get("tool_calls") or []) if c]
        if calls and m["role"] == "assistant":
            m["tool_calls"] = []
            for j, c in calls:
                args = value(c.get("input"))
                args = {} if args is None else args if isinstance(args, dict) else {"value": args}
                f = {"name": c.get("tool") or "", "arguments": args}
                m["tool_calls"].append({"id": f"call_{i}_{j}_{f['name']}", "type": "function", "function": f} | f)
        out.append(m)
        out += [{"role": "tool", "content": words(c["output"]), "name": c.get("tool") or "", "tool_call_id": f"call_{i}_{j}_{c.get('tool') or ''}"} for j, c in calls if c.get("output")]
    for k, m in enumerate(out):
        m |= {"index": k, "is_last": k == len(out) - 1}
        if k:
            m["prev_role"] = out[k - 1]["role"]
        if k + 1 < len(out):
            m["next_role"] = out[k + 1]["role"]
    return out


def render_records(records: DataFrame, template: str, tools: list[dict] | None = None, bos_token: str = "", eos_token: str = "", add_generation_prompt: bool = False) -> DataFrame:
    """(record_id, model, content, error): each record by a template text; a record the template rejects has its error instead.

    ``tools`` is a small configuration list (the tool schemas of the data set).
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for b in batches:
            rows = []
            for rid, model, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                record = json.loads(body)
                context: dict[str, Any] = {"messages": template_messages(record), "bos_token": bos_token, "eos_token": eos_token, "add_generation_prompt": add_generation_prompt, "record": record}
                if tools is not None:
                    context["tools"] = [t | {"function": t} for t in tools]
                try:
                    rows.append((rid, model, compiled.render(**context), None))
                except (TemplateError, TypeError, ValueError) as e:
                    rows.append((rid, model, None, str(e)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["record_id", "model", "content", "error"])

    return records.select("record_id", "model", F.to_json(F.struct("record_id", "model", "turns")).alias("j")).mapInArrow(run_, "record_id string, model string, content string, error string")
