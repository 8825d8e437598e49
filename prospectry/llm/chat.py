"""Chat formatting with compiled templates.

A template (``{{ expression }}``, ``{% for x in list %}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% set name = expression %}``, ``{% generation %}``, ``{# comment #}``) is parsed
into a syntax tree, constants are folded, and the tree becomes nested Python closures that render a
conversation and note the spans between ``generation`` markers. Names reach only the values handed
in; ``a.b`` and ``a['b']`` look up keys of mappings, never attributes of objects; there are no calls
but the named filters.

Rendering runs once for each conversation inside ``mapInPandas``; a conversation is the unit of
training and therefore one row.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}"
    "[OUT] {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | escape }} [TEXT] {{ m.text | escape }} [/TEXT]{% endif %}"
    "{% endfor %}"
)
#: Strings that mark turns; none has the escape sign in it, and no text has any after escaping.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/TEXT]")
SIGN = "\\"

_control = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_turns = re.compile(
    r"\[INST\] (.*?) \[/INST\]|\[OUT\] (.*?)</s>|\[ROLE\] (.*?) \[TEXT\] (.*?) \[/TEXT\]", re.S)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Doubles the sign, then breaks each control string with a sign after its first character."""
    return _control.sub(lambda m: m[0][0] + SIGN + m[0][1:], text.replace(SIGN, SIGN * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# --- syntax tree: tuples (kind, ...) ---------------------------------------------------------

_pieces = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_words = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.\[\]()]))")
_BINARY = {
    "==": (1, operator.eq), "!=": (1, operator.ne), "<": (1, operator.lt), ">": (1, operator.gt),
    "<=": (1, operator.le), ">=": (1, operator.ge), "in": (1, lambda a, b: a in b),
    "~": (2, lambda a, b: f"{_shown(a)}{_shown(b)}"), "+": (3, operator.add),
}
_FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len,
}
_NAMED = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the words of one expression."""

    def __init__(self, text: str):
        self.words, at, text = [], 0, text.strip()
        while at < len(text):
            m = _words.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:]!r}")
            self.words.append((m.lastindex, m[m.lastindex]))
            at = m.end()

    def peek(self) -> str | None:
        return self.words[0][1] if self.words and self.words[0][0] != 1 else None

    def take(self, wanted: str | None = None) -> tuple[int, str]:
        if not self.words or (wanted is not None and self.peek() != wanted):
            raise TemplateError(f"expected {wanted or 'a value'}, found {self.words[:1]}")
        return self.words.pop(0)

    def whole(self):
        node = self.either()
        if self.words:
            raise TemplateError(f"left over: {self.words}")
        return node

    def either(self):
        node = self.both()
        while self.peek() == "or":
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek() == "and":
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        return self.binary(1)

    def binary(self, level: int):
        node = self.binary(level + 1) if level < 3 else self.filtered()
        while self.peek() in _BINARY and _BINARY[self.peek()][0] == level:
            sign = self.take()[1]
            node = ("binary", sign, node, self.binary(level + 1) if level < 3 else self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def value(self):
        kind, word = self.take()
        if kind == 1:
            node = ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1]))
        elif kind == 2:
            node = ("constant", int(word))
        elif kind == 3:
            node = ("constant", _NAMED[word]) if word in _NAMED else ("name", word)
        elif word == "(":
            node = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {word}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                node = ("key", node, ("constant", self.take()[1]))
            else:
                node = ("key", node, self.either())
                self.take("]")
        return node


def parse(template: str) -> list:
    """The template's statements."""
    pieces = _pieces.split(template)

    def block(at: int, ends: tuple[str, ...]) -> tuple[list, int, str]:
        body = []
        while at < len(pieces):
            piece, at = pieces[at], at + 1
            if piece.startswith("{{"):
                body.append(("show", _Expression(piece[2:-2]).whole()))
            elif piece.startswith("{%"):
                head, _, rest = piece[2:-2].strip().partition(" ")
                if head in ends:
                    return body, at, f"{head} {rest}"
                if head == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"not a loop: {rest}")
                    inner, at, _ = block(at, ("endfor",))
                    body.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif head == "if":
                    branches, end = [], f"if {rest}"
                    while not end.startswith("endif"):
                        word, _, test = end.partition(" ")
                        inner, at, end = block(at, ("elif", "else", "endif"))
                        when = ("constant", True) if word == "else" else _Expression(test).whole()
                        branches.append((when, inner))
                    body.append(("if", branches))
                elif head == "generation":
                    inner, at, _ = block(at, ("endgeneration",))
                    body.append(("generation", inner))
                elif head == "set":
                    name, _, value = rest.partition("=")
                    body.append(("set", name.strip(), _Expression(value).whole()))
                else:
                    raise TemplateError(f"no statement {head}")
            elif piece and not piece.startswith("{#"):
                body.append(("text", piece))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, at, ""

    return block(0, ())[0]


def fold(node):
    """Constant expressions become constants."""
    kind = node[0]
    if kind in ("constant", "name"):
        return node
    folded = (kind, *[fold(x) if isinstance(x, tuple) else x for x in node[1:]])
    if all(x[0] == "constant" for x in folded[1:] if isinstance(x, tuple)):
        return ("constant", _expression(folded)({}))
    return folded


def fold_block(body: list) -> list:
    """Folds all expressions, drops branches that cannot be reached, joins neighbouring texts."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "show":
            value = fold(node[1])
            add(("text", _shown(value[1])) if value[0] == "constant" else ("show", value))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_block(node[3])))
        elif node[0] == "generation":
            add(("generation", fold_block(node[1])))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2])))
        elif node[0] == "if":
            branches = []
            for when, inner in node[1]:
                when = fold(when)
                if when[0] != "constant" or when[1]:
                    branches.append((when, fold_block(inner)))
                if when[0] == "constant" and when[1]:
                    break
            if branches and branches[0][0][0] == "constant":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


# --- closures ---------------------------------------------------------------------------------

def _shown(value) -> str:
    return "" if value is None else str(value)


def _look_up(of, key):
    return of.get(key) if isinstance(of, dict) else of[key] if isinstance(of, list) else None


def _expression(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        return lambda names, v=node[1]: v
    if kind == "name":
        return lambda names, n=node[1]: names.get(n)
    if kind == "binary":
        f, a, b = _BINARY[node[1]][1], _expression(node[2]), _expression(node[3])
        return lambda names: f(a(names), b(names))
    if kind == "filter":
        f, a = _FILTERS[node[1]], _expression(node[2])
        return lambda names: f(a(names))
    if kind == "not":
        a = _expression(node[1])
        return lambda names: not a(names)
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names: _look_up(a(names), b(names))


class Rendered:
    """Text so far, and the spans (start, end in code points) that a model is to generate."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _statement(node) -> Callable[[dict, Rendered], None]:
    kind = node[0]
    if kind == "text":
        return lambda names, out, t=node[1]: out.add(t)
    if kind == "show":
        value = _expression(node[1])
        return lambda names, out: out.add(_shown(value(names)))
    if kind == "set":
        value = _expression(node[2])
        return lambda names, out, n=node[1]: names.__setitem__(n, value(names))
    if kind == "generation":
        inner = _block(node[1])

        def generation(names: dict, out: Rendered) -> None:
            start = out.length
            inner(names, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "if":
        branches = [(_expression(w), _block(b)) for w, b in node[1]]

        def choice(names: dict, out: Rendered) -> None:
            for when, inner in branches:
                if when(names):
                    return inner(names, out)

        return choice
    name, values, inner = node[1], _expression(node[2]), _block(node[3])

    def loop(names: dict, out: Rendered) -> None:
        items = values(names) or []
        if not isinstance(items, list):
            raise TemplateError("only lists can be looped over")
        for i, item in enumerate(items):
            at = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
            inner({**names, name: item, "loop": at}, out)

    return loop


def _block(body: list) -> Callable[[dict, Rendered], None]:
    steps = [_statement(x) for x in body]

    def run(names: dict, out: Rendered) -> None:
        for step in steps:
            step(names, out)

    return run


def compile_template(template: str = TEMPLATE) -> Callable[[dict], Rendered]:
    """A function from names to the rendered text with its spans."""
    body = _block(fold_block(parse(template)))

    def render(names: dict) -> Rendered:
        out = Rendered()
        body(dict(names), out)
        return out

    return render


# --- DataFrames -------------------------------------------------------------------------------

def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from the output of ``TEMPLATE``."""
    turns = []
    for m in _turns.finditer(formatted):
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((unescape(m[3]), unescape(m[4])))
    return turns


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, spans``: one row for each conversation of ``conv_id, turn, role, text``
    rows, in the order of turn, role and text; ``spans`` are the parts to be learned.

    Null roles and texts count as empty; rows with a null ``conv_id`` are one conversation; repeated
    rows are repeated turns; other columns are not used. No rows, no result.
    """
    gathered = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")).alias("message"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("message")).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for batch in batches:
            done = [render({"messages": [m if isinstance(m, dict) else m.asDict() for m in messages]})
                    for messages in batch["messages"]]
            yield pd.DataFrame({
                "conv_id": batch["conv_id"].astype("Int64"),
                "formatted": [x.text for x in done],
                "spans": [[{"start": a, "end": b} for a, b in x.spans] for x in done]})

    return gathered.mapInPandas(
        run, "conv_id bigint, formatted string, spans array<struct<start: bigint, `end`: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, worked out from
    the formatted texts and spans alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv_id"].astype("Int64"), batch["formatted"], batch["spans"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
             " loss_sha256 string, formatted_chars bigint")
