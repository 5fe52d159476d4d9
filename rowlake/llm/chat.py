"""Chat formatting: a small sandboxed template language, compiled to Python closures.

    {{ expr }}   {% for x in expr %} {% endfor %}   {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% set x = expr %}   {% generation %} {% endgeneration %}   a dash at a tag's side strips the white space there

Expressions have strings, integers, true, false, none, names, x.key, x['key'], filters (| name or | name(args)), not and
or, comparisons, in, + and ~ (joins texts), a if b else c, and parentheses. There are no calls, imports or attributes of
Python objects: x.key looks into mappings only, and `loop` has first, last, index, index0 and length.

A template is parsed into a tree, constant parts are folded (expressions, neighbouring texts, decided ifs), and each node
becomes a closure. Rendering gives the text and the spans, in code points, that {% generation %} marks for the loss.
The filter `escape` makes a text free of control strings and `unescape` undoes it: backslashes are doubled, and a lone
backslash is set behind the first character of every place where a control string begins.

A conversation is one training example and is rendered in one task; a task reads its conversations one after the other,
in order of turn. Nulls: a null text or role is empty, null turns come first, and each row without conv_id is a
conversation of its own, so that they needn't meet in one task. Rows of one turn go by role and text; repeated rows are turns of their own. An empty table gives an
empty one. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm.common import map_arrow

#: Strings that models read as control.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
DEFAULT = """{%- for m in messages -%}
<|{{ m.role | escape }}|>
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>
{% endfor -%}"""
_BEGIN = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)


def escape(text: str) -> str:
    return _BEGIN.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "length": lambda x: len(x), "default": lambda x, y: y if x is None or x == "" else x, "replace": lambda x, a, b: str(x).replace(a, b), "join": lambda x, s="": s.join(map(_text, x)),
}
_TAG = re.compile(r"(\{\{-?|\{%-?)((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)(-?\}\}|-?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>.\[\]()|,=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(x) -> str:
    return "" if x is None else str(x)


class Expression:
    """Parses one expression into tuples: ("const", v), ("name", n), ("get", x, key), ("filter", name, args), ("op", name, args), ("if", test, a, b)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            kind = "int" if m[1] else "str" if m[2] else "name" if m[3] else "op"
            self.tokens.append((kind, m[1] or m[2] or m[3] or m[4]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            return self.tokens[self.at][1]
        return None

    def take(self, *values: str) -> str | None:
        got = self.peek(*values)
        self.at += got is not None
        return got

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self):
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            out = ("if", test, out, self.choice())
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = ("op", "or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = ("op", "and", (out, self.negated()))
        return out

    def negated(self):
        return ("op", "not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = ("op", op, (out, self.joined()))
        return out

    def joined(self):
        out = self.added()
        while self.take("~"):
            out = ("op", "~", (out, self.added()))
        return out

    def added(self):
        out = self.filtered()
        while self.take("+"):
            out = ("op", "+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.peek(")"):
                        self.need(",")
            out = ("filter", name, (out, *args))
        return out

    def atom(self):
        if self.take("("):
            out = self.choice()
            self.need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        else:
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "int":
                out = ("const", int(value))
            elif kind == "str":
                out = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "name":
                out = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while mark := self.take(".", "["):
            out = ("get", out, ("const", self.name()) if mark == "." else self.choice())
            if mark == "[":
                self.need("]")
        return out


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a,
}


def _get(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, list) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def fold(e):
    """The expression with its constant parts computed."""
    kind = e[0]
    if kind == "get":
        return ("get", fold(e[1]), fold(e[2]))
    if kind == "if":
        test, a, b = map(fold, e[1:])
        return (a if test[1] else b) if test[0] == "const" else ("if", test, a, b)
    if kind in ("op", "filter"):
        args = tuple(map(fold, e[2]))
        if e[1] in ("and", "or") and kind == "op" and args[0][0] == "const":
            return args[1] if bool(args[0][1]) == (e[1] == "and") else args[0]
        if all(x[0] == "const" for x in args) and (kind == "filter" or e[1] not in ("and", "or")):
            try:
                return ("const", (FILTERS if kind == "filter" else _OPS)[e[1]](*(x[1] for x in args)))
            except TypeError:  # an error only if it is rendered
                return (kind, e[1], args)
        return (kind, e[1], args)
    return e


def compile_expression(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "get":
        x, key = compile_expression(e[1]), compile_expression(e[2])
        return lambda env: _get(x(env), key(env))
    if kind == "if":
        test, a, b = map(compile_expression, e[1:])
        return lambda env: a(env) if test(env) else b(env)
    args = [compile_expression(x) for x in e[2]]
    if kind == "op" and e[1] in ("and", "or"):
        a, b = args
        return (lambda env: a(env) and b(env)) if e[1] == "and" else (lambda env: a(env) or b(env))
    f = (FILTERS if kind == "filter" else _OPS)[e[1]]
    if len(args) == 1:
        return lambda env, x=args[0]: f(x(env))
    return lambda env: f(*(x(env) for x in args))


def parse(source: str) -> list:
    """The tree: ("text", s), ("show", e), ("for", name, e, body), ("if", [(e, body)], else), ("set", name, e), ("generation", body)."""
    stack: list[tuple] = [("root", [])]
    at, strip = 0, False

    def add(node) -> None:
        stack[-1][1].append(node)

    def text(s: str, left: bool, right: bool) -> None:
        s = s.lstrip() if left else s
        s = s.rstrip() if right else s
        if s:
            add(("text", s))

    for m in _TAG.finditer(source):
        text(source[at : m.start()], strip, m[1].endswith("-"))
        at, strip = m.end(), m[3].startswith("-")
        if m[1].startswith("{{") != m[3].endswith("}}"):
            raise TemplateError(f"a tag is not closed: {m[0][:30]!r}")
        if m[1].startswith("{{"):
            add(("show", Expression(m[2]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            e = Expression(rest)
            name = e.name()
            e.need("in")
            stack.append(("for", [], name, e.whole()))
        elif word == "if":
            stack.append(("if", [], [], Expression(rest).whole()))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if" or stack[-1][3] is None:
                raise TemplateError(f"{word} is out of place")
            _, body, done, test = stack.pop()
            stack.append(("if", [], [*done, (test, body)], Expression(rest).whole() if word == "elif" else None))
        elif word == "set":
            e = Expression(rest)
            name = e.name()
            e.need("=")
            add(("set", name, e.whole()))
        elif word == "generation":
            stack.append(("generation", []))
        elif word in ("endfor", "endif", "endgeneration"):
            top = stack.pop()
            if "end" + top[0] != word:
                raise TemplateError(f"{word} is out of place")
            if word == "endfor":
                add(("for", top[2], top[3], top[1]))
            elif word == "endgeneration":
                add(("generation", top[1]))
            else:
                branches = [*top[2], (top[3], top[1])] if top[3] is not None else top[2]
                add(("if", branches, top[1] if top[3] is None else []))
        else:
            raise TemplateError(f"no statement {word!r}")
    text(source[at:], strip, False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return stack[0][1]


def fold_nodes(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if node[0] == "show":
            e = fold(node[1])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("show", e)]
        elif node[0] == "set":
            new = [("set", node[1], fold(node[2]))]
        elif node[0] == "for":
            new = [("for", node[1], fold(node[2]), fold_nodes(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold_nodes(node[1]))]
        elif node[0] == "if":
            branches, last = [], fold_nodes(node[2])
            for test, body in node[1]:
                test = fold(test)
                if test[0] != "const":
                    branches.append((test, fold_nodes(body)))
                elif test[1]:
                    last = fold_nodes(body)
                    break
            new = [("if", branches, last)] if branches else last
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


class _Out:
    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def compile_nodes(nodes: list) -> Callable[[dict, _Out], None]:
    steps = [_compile_node(x) for x in nodes]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def _compile_node(node) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, s=node[1]: out.put(s)
    if kind == "show":
        shown = compile_expression(node[1])
        return lambda env, out: out.put(_text(shown(env)))
    if kind == "set":
        name, value = node[1], compile_expression(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        body = compile_nodes(node[1])

        def generation(env, out):
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return generation
    if kind == "for":
        name, items, body = node[1], compile_expression(node[2]), compile_nodes(node[3])

        def loop(env, out):
            rows = list(items(env) or ())
            outer = {k: env.get(k) for k in (name, "loop")}
            for i, x in enumerate(rows):
                env[name], env["loop"] = x, {"first": i == 0, "last": i == len(rows) - 1, "index": i + 1, "index0": i, "length": len(rows)}
                body(env, out)
            env.update(outer)

        return loop
    branches, last = [(compile_expression(t), compile_nodes(b)) for t, b in node[1]], compile_nodes(node[2])

    def choose(env, out):
        for test, body in branches:
            if test(env):
                return body(env, out)
        return last(env, out)

    return choose


class Template:
    """render(messages, ...) gives the text and its generation spans."""

    def __init__(self, source: str = DEFAULT):
        self.source = source
        self.run = compile_nodes(fold_nodes(parse(source)))

    def render(self, messages: list[dict], **context) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        self.run({**context, "messages": messages}, out)
        return "".join(out.parts), out.spans

    def __reduce__(self):
        return Template, (self.source,)


_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of what DEFAULT has rendered."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_conversations(rows: DataFrame, template: str = DEFAULT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and spans (start, end in code points) for the loss."""
    compiled = Template(template)

    def turns_of(batches: Iterator[pa.RecordBatch]):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for k, turns in groupby(rows, key=lambda r: r[0]):
            if k is None:
                yield from ((k, [r]) for r in turns)
            else:
                yield k, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        for k, turns in turns_of(batches):
            formatted, spans = compiled.render([{"role": r, "text": t} for _, r, t in turns])
            done.append((k, formatted, [{"start": a, "end": b} for a, b in spans]))
            size += len(formatted)
            if size > 1 << 22:
                yield pack(done)
                done, size = [], 0
        if done:
            yield pack(done)

    def pack(done: list[tuple]) -> pa.RecordBatch:
        k, formatted, spans = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(formatted, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "spans"])

    column = lambda name: F.col(f"`{name}`")
    clean = rows.select(column(key).cast("long").alias("k"), column(turn).cast("long").alias("n"), F.coalesce(column(role).cast("string"), F.lit("")).alias("r"), F.coalesce(column(text).cast("string"), F.lit("")).alias("t"))
    alone = F.when(F.col("k").isNull(), F.monotonically_increasing_id())
    ordered = clean.withColumn("alone", alone).repartition("k", "alone").sortWithinPartitions("k", "n", "r", "t").select("k", "r", "t")
    return map_arrow(ordered, run, "conv_id long, formatted string, spans array<struct<start: bigint, end: bigint>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted texts: turns and the text under the loss mask."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(s)
                loss = "".join(unescape(s[x["start"] : x["end"]]) for x in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(s)))
            n, turns, chars, loss, size = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(formatted.select("conv_id", "formatted", "spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
