"""Chat formatting by compiled templates.

A small template language, sandboxed by construction: it knows strings, numbers,
lists, the messages' fields, a fixed set of filters and tests, and no attribute of
any Python object.  A template is read into a syntax tree, constant parts of the
tree are folded, and the tree becomes Python closures that append to a list and note
where text between ``{% generation %}`` and ``{% endgeneration %}`` begins and ends.

Statements: ``for x in e`` with ``loop.index/index0/first/last/length``, ``if``,
``elif``, ``else``, ``set x = e``, ``generation``.  Expressions: literals, names,
``a.b``, ``a[b]``, ``+ - * ~ %``, comparisons, ``in``, ``and/or/not``, ``a if b else
c``, filters ``trim upper lower length default(x) join(x) tojson first last`` and
tests ``is defined``, ``is none``.  ``-`` inside a tag's edge takes white space away.

Nulls, empties and ties: turns are ordered by ``turn``, then role, then text, nulls
first; a null role or text renders as the empty string; repeated rows are repeated
turns; rows with a null conversation are one conversation.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | trim }}{{ '<|im_end|>' }}{% endgeneration %}{{ '\\n' }}"
    "{% else %}{{ m.content | trim }}{{ '<|im_end|>' + '\\n' }}{% endif %}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)

_PIECE = re.compile(r"\{\{-?|\{%-?|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*~%.,|()\[\]<>=:]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_SPACE = " \t\r\n"


class TemplateError(ValueError):
    """A template that cannot be read, or one that asks for what is not allowed."""


class _Undefined(str):
    __slots__ = ()


UNDEFINED = _Undefined()


def _text(v) -> str:
    if v is None:
        return ""
    if v is True or v is False:
        return "True" if v else "False"
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


FILTERS = {
    "trim": lambda v: _text(v).strip(_SPACE),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "default": lambda v, d="": d if v is UNDEFINED or v is None else v,
    "join": lambda v, d="": d.join(map(_text, v)),
    "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True),
    "first": lambda v: v[0] if len(v) else UNDEFINED,
    "last": lambda v: v[-1] if len(v) else UNDEFINED,
}


def _plus(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return _text(a) + _text(b)
    return a + b


BINARY = {
    "+": _plus,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not (isinstance(a, str) or isinstance(b, str)) else _refuse("* on strings"),
    "%": lambda a, b: a % b if not isinstance(a, str) else _refuse("% on strings"),
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
LEVELS = [{"==", "!=", "<", ">", "<=", ">=", "in"}, {"~"}, {"+", "-"}, {"*", "%"}]


def _refuse(what: str):
    raise TemplateError(what)


# Reading: text to a tree of tuples ------------------------------------------------


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at, code = [], 0, code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at : at + 20]!r}")
        at = m.end()
        kind, v = m.lastgroup, m[m.lastgroup]
        if kind == "num":
            v = float(v) if "." in v else int(v)
        elif kind == "str":
            v = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), v[1:-1], flags=re.S)
        out.append((kind, v))
    return out


class _Expressions:
    def __init__(self, code: str) -> None:
        self.todo, self.at = [*_tokens(code), ("end", None)], 0

    def peek(self, *ops: str) -> bool:
        kind, v = self.todo[self.at]
        return kind in ("op", "name") and v in ops

    def take(self, *ops: str) -> bool:
        if self.peek(*ops):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TemplateError(f"expected {op!r}, not {self.todo[self.at][1]!r}")

    def name(self) -> str:
        kind, v = self.todo[self.at]
        if kind != "name" or v.startswith("_"):
            raise TemplateError(f"expected a name, not {v!r}")
        self.at += 1
        return v

    def done(self) -> None:
        if self.todo[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.todo[self.at][1]!r}")

    def whole(self):
        tree = self.choice()
        self.done()
        return tree

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ("const", "")
            return ("choice", test, value, other)
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.postfix()
        left = self.binary(level + 1)
        while True:
            if self.peek(*LEVELS[level]):
                op = self.todo[self.at][1]
                self.at += 1
                left = ("binary", op, left, self.binary(level + 1))
            elif level == 0 and self.peek("not") and self.todo[self.at + 1] == ("name", "in"):
                self.at += 2
                left = ("not", ("binary", "in", left, self.binary(1)))
            else:
                return left

    def postfix(self):
        tree = self.primary()
        while True:
            if self.take("."):
                tree = ("item", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("item", tree, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree, *(self.arguments() if self.take("(") else ()))
            elif self.take("is"):
                no = self.take("not")
                name = self.name()
                if name not in ("defined", "none"):
                    raise TemplateError(f"no test {name!r}")
                tree = ("is", name, tree)
                tree = ("not", tree) if no else tree
            else:
                return tree

    def arguments(self) -> list:
        out = []
        while not self.take(")"):
            out.append(self.choice())
            if not self.peek(")"):
                self.need(",")
        return out

    def primary(self):
        kind, v = self.todo[self.at]
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need(",")
            return ("list", *items)
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.postfix())
        if kind in ("num", "str"):
            self.at += 1
            return ("const", v)
        name = self.name()
        fixed = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
        return ("const", fixed[name]) if name in fixed else ("name", name)


def parse(source: str) -> tuple:
    """The tree of a template: ``("block", ...)``."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    while True:
        m = _PIECE.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip(_SPACE)
        if m and m[0].endswith("-"):
            text = text.rstrip(_SPACE)
        if text:
            parts.append(("text", text))
        if not m:
            break
        if m[0].startswith("{#"):
            at, strip = m.end(), False
            continue
        close = "}}" if m[0].startswith("{{") else "%}"
        end, quote = m.end(), ""
        while end < len(source) and (quote or not source.startswith(close, end)):
            c = source[end]
            if quote and c == "\\":
                end += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            end += 1
        if end >= len(source):
            raise TemplateError("a tag is not closed")
        code = source[m.end() : end]
        strip = code.endswith("-")
        parts.append(("value" if close == "}}" else "tag", code[: len(code) - strip]))
        at = end + 2
    tree, rest = _block(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {parts[rest][1].strip()!r}")
    return tree


def _block(parts, at, ends) -> tuple[tuple, int]:
    out = []
    while at < len(parts):
        kind, code = parts[at]
        if kind == "text":
            out.append(("text", ("const", code)))
        elif kind == "value":
            out.append(("text", _Expressions(code).whole()))
        else:
            word = code.split(None, 1)[0] if code.strip() else ""
            if word in ends:
                return ("block", *out), at
            e = _Expressions(code)
            e.at = 1
            if word == "for":
                name = e.name()
                e.need("in")
                over = e.whole()
                body, at = _block(parts, at + 1, ("endfor",))
                out.append(("for", name, over, body))
            elif word == "if":
                arms, other, test = [], ("block",), e.whole()
                while True:
                    body, at = _block(parts, at + 1, ("elif", "else", "endif"))
                    if test is None:
                        other = body
                    else:
                        arms.append((test, body))
                    if at >= len(parts):
                        raise TemplateError("no endif")
                    e = _Expressions(parts[at][1])
                    e.at = 1
                    turn = parts[at][1].split()[0]
                    if turn == "endif":
                        break
                    test = e.whole() if turn == "elif" else None
                for test, body in reversed(arms):
                    other = ("if", test, body, other)
                out.append(other)
            elif word == "set":
                name = e.name()
                e.need("=")
                out.append(("set", name, e.whole()))
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"no statement {word!r}")
            if at >= len(parts):
                raise TemplateError(f"{word} is not closed")
        at += 1
    return ("block", *out), at


# Folding --------------------------------------------------------------------------


def fold(tree):
    """The tree with all that does not depend on the data worked out."""
    if not isinstance(tree, tuple) or tree[0] in ("const", "name"):
        return tree
    kind, *rest = tree
    rest = [fold(x) if isinstance(x, tuple) else x for x in rest]
    tree = (kind, *rest)
    if kind == "block":
        out = []
        for x in rest:
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and y[1][0] == "const":
                    text = _text(y[1][1])
                    if out and out[-1][0] == "text" and out[-1][1][0] == "const":
                        out[-1] = ("text", ("const", out[-1][1][1] + text))
                    elif text:
                        out.append(("text", ("const", text)))
                else:
                    out.append(y)
        return ("block", *out)
    if kind in ("if", "choice") and rest[0][0] == "const":
        return rest[1] if rest[0][1] else rest[2]
    if kind in ("and", "or") and rest[0][0] == "const":
        return rest[1] if bool(rest[0][1]) == (kind == "and") else rest[0]
    inner = [x for x in rest if isinstance(x, tuple)]
    if kind in ("binary", "filter", "not", "list", "item", "is") and all(x[0] == "const" for x in inner):
        try:
            return ("const", _expression(tree)({}))
        except TemplateError:
            raise
        except Exception as e:
            raise TemplateError(f"a constant cannot be worked out: {e}") from e
    return tree


# Closures -------------------------------------------------------------------------


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


def _expression(tree):
    kind, *rest = tree
    if kind == "const":
        value = rest[0]
        return lambda env: value
    if kind == "name":
        name = rest[0]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "binary":
        f, a, b = BINARY[rest[0]], _expression(rest[1]), _expression(rest[2])
        return lambda env: f(a(env), b(env))
    if kind == "filter":
        f, *args = FILTERS[rest[0]], *map(_expression, rest[1:])
        return lambda env: f(*(x(env) for x in args))
    if kind == "list":
        args = [*map(_expression, rest)]
        return lambda env: [x(env) for x in args]
    if kind == "is":
        a = _expression(rest[1])
        return (lambda env: a(env) is not UNDEFINED) if rest[0] == "defined" else (lambda env: a(env) is None)
    parts = [*map(_expression, rest)]
    a = parts[0]
    if kind == "not":
        return lambda env: not a(env)
    b = parts[1]
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    c = parts[2]
    return lambda env: b(env) if a(env) else c(env)


class _Out:
    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _statement(tree):
    kind, *rest = tree
    if kind == "text":
        if rest[0][0] == "const":
            text = _text(rest[0][1])
            return lambda env, out: out.add(text)
        value = _expression(rest[0])
        return lambda env, out: out.add(_text(value(env)))
    if kind == "block":
        steps = [*map(_statement, rest)]

        def block(env, out):
            for step in steps:
                step(env, out)

        return block
    if kind == "if":
        test, yes, no = _expression(rest[0]), _statement(rest[1]), _statement(rest[2])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "set":
        name, value = rest[0], _expression(rest[1])

        def put(env, out):
            env[name] = value(env)

        return put
    if kind == "for":
        name, over, body = rest[0], _expression(rest[1]), _statement(rest[2])

        def loop(env, out):
            items = over(env)
            if not isinstance(items, list):
                raise TemplateError("for needs a list")
            inner = dict(env)
            for k, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}
                body(inner, out)

        return loop
    body = _statement(rest[0])

    def generation(env, out):
        begin = out.size
        body(env, out)
        out.spans.append((begin, out.size))

    return generation


def compile_template(source: str):
    """A function from the template's variables to text and generation spans."""
    run = _statement(fold(parse(source)))

    def render(**env) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(env, out)
        return "".join(out.parts), out.spans

    return render


def format_chats(turns: DataFrame, template: str = CHATML, add_generation_prompt: bool = False) -> DataFrame:
    """``conv_id, n_turns, rendered, spans``; spans as ``begin:end`` joined by commas.

    Spans count characters of the rendered text.
    """
    compile_template(template)  # a bad template fails here, not in a task
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")))).alias("m"))

    def run(batches):
        render = compile_template(template)
        for batch in batches:
            texts, spans, counts = [], [], []
            for messages in batch.column(1).to_pylist():
                text, marks = render(messages=messages, add_generation_prompt=add_generation_prompt)
                texts.append(text)
                counts.append(len(messages))
                spans.append(",".join(f"{a}:{b}" for a, b in marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["conv_id", "n_turns", "rendered", "spans"])

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns int, rendered string, spans string")


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, '') || chr(10) AS head, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) || '<|im_end|>' AS body
  FROM conversations
), p AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM t
)
SELECT conv_id, count(*)::INT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY upto) AS rendered,
       coalesce(string_agg((upto - 1 - length(body))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY upto) FILTER (role = 'assistant'), '') AS spans
FROM p GROUP BY conv_id
"""
