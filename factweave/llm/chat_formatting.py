"""Chat formatting by a compiled template.

The template language is sandboxed: it knows the loop variable's fields, constants,
``==``, ``!=``, ``and``, ``or``, ``not``, ``+``, the filters in ``FILTERS``, and the
tags ``for``, ``if``/``elif``/``else``, ``set`` and ``generation``. It has no calls, no
attribute access on Python objects and no way to name one.

``compile_template`` scans the source, parses it into a syntax tree, folds constants
and turns each node into a Python closure. A closure yields ``(text, generated)``
pieces, so a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Marks each turn; what an assistant says is generated text.
CHATML = """{% for message in messages %}{{ '<|im_start|>' + (message.role | escape_role) + '\n' }}{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' + '\n' }}{% endfor %}"""


def escape(text: str) -> str:
    """Keep control strings out of a text: ``%`` marks an escape, and ``<|`` never survives."""
    return text.replace("%", "%25").replace("<|", "%3C|")


def unescape(text: str) -> str:
    return text.replace("%3C|", "<|").replace("%0A", "\n").replace("%25", "%")


def escape_role(role: str) -> str:
    """As ``escape``, on one line."""
    return escape(role).replace("\n", "%0A")


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "escape_role": escape_role,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "length": len,
}


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


# ---- syntax tree ---------------------------------------------------------------------
# Nodes are tuples: (kind, ...). Expressions: const, name, field, filter, not, and the
# binary kinds of BINARY. Statements: text, print, for, if, set, generation.

_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().+|]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b}


class _Expression:
    """Precedence: or, and, not, comparison, +, filters, fields."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        if self.peek() in BINARY:
            sign = self.peek()
            self.at += 1
            node = (sign, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.field()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def field(self) -> tuple:
        node = self.atom()
        while self.take("."):
            node = ("field", node, self.name())
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if value == "(" and kind == 4:
            self.at += 1
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return node
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 2:
            return ("const", int(value))
        if kind == 3:
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False

    def plain(text: str, before: bool) -> None:
        """Text between tags; a dash inside a tag's bracket takes away the blanks beside it."""
        text = text.lstrip() if trim else text
        text = text.rstrip() if before else text
        if opened := re.search(r"\{[{%#]", text):
            raise TemplateError(f"{opened[0]!r} is not closed")
        if text:
            pieces.append(("text", text))

    for m in _TAG.finditer(source):
        plain(source[at : m.start()], m[0][2] == "-")
        if m[1] is not None:
            pieces.append(("tag", m[1]))
        elif m[2] is not None:
            pieces.append(("print", m[2]))
        at, trim = m.end(), m[0][-3] == "-"
    plain(source[at:], False)
    body, rest = _block(pieces, 0, ())
    if rest != len(pieces):
        raise TemplateError(f"unexpected {pieces[rest][1]!r}")
    return body


def _block(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    body: list[tuple] = []
    while at < len(pieces):
        kind, value = pieces[at]
        if kind == "text":
            body.append(("print", ("const", value)))
            at += 1
            continue
        if kind == "print":
            body.append(("print", _Expression(value).whole()))
            at += 1
            continue
        word = value.split(None, 1)[0] if value else ""
        if word in ends:
            return body, at
        rest = value[len(word) :].strip()
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"not a loop: {value!r}")
            inner, at = _closed(pieces, at + 1, "endfor")
            body.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "generation":
            inner, at = _closed(pieces, at + 1, "endgeneration")
            body.append(("generation", inner))
        elif word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"not an assignment: {value!r}")
            body.append(("set", m[1], _Expression(m[2]).whole()))
            at += 1
        elif word == "if":
            arms, test = [], rest
            while True:
                inner, at = _block(pieces, at + 1, ("elif", "else", "endif"))
                arms.append((_Expression(test).whole(), inner))
                if at >= len(pieces):
                    raise TemplateError("if is not closed")
                head, _, test = pieces[at][1].partition(" ")
                if head == "else":
                    inner, at = _closed(pieces, at + 1, "endif")
                    arms.append((("const", True), inner))
                    break
                if head == "endif":
                    at += 1
                    break
            body.append(("if", arms))
        else:
            raise TemplateError(f"no tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return body, at


def _closed(pieces: list, at: int, end: str) -> tuple[list[tuple], int]:
    body, at = _block(pieces, at, (end,))
    return body, at + 1


# ---- constant folding ----------------------------------------------------------------


def fold(node: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "filter":
        inner = fold(node[2])
        return ("const", _filtered(node[1], inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    left, right = fold(node[1]), fold(node[2])
    if kind in ("and", "or") and left[0] == "const":
        return right if bool(left[1]) == (kind == "and") else left
    if left[0] == right[0] == "const":
        return ("const", _shown(left[1]) + _shown(right[1]) if kind == "+" else BINARY[kind](left[1], right[1]))
    if kind == "+" and right[0] == "const" and left[0] == "+" and left[2][0] == "const":
        return ("+", left[1], ("const", _shown(left[2][1]) + _shown(right[1])))
    return (kind, left, right)


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with folded expressions, dead branches dropped and neighbouring constant prints joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "print":
            value = fold(node[1])
            if value[0] == "const":
                value = ("const", _shown(value[1]))
                if not value[1]:
                    continue
                if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                    out[-1] = ("print", ("const", out[-1][1][1] + value[1]))
                    continue
            out.append(("print", value))
        elif kind == "for":
            out.append(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif kind == "generation":
            out.append(("generation", fold_body(node[1])))
        elif kind == "set":
            out.append(("set", node[1], fold(node[2])))
        else:
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                out.extend(arms[0][1])
            elif arms:
                out.append(("if", arms))
    return out


def _shown(value) -> str:
    return "" if value is None else str(value)


def _filtered(name: str, value):
    """A length is that of the value itself, all other filters take what is shown of it."""
    return FILTERS[name](value if name == "length" and value is not None else _shown(value))


# ---- closures ------------------------------------------------------------------------

Scope = dict
Piece = tuple[str, bool]


def _value(node: tuple) -> Callable[[Scope], object]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        inner, name = _value(node[1]), node[2]

        def field(scope):
            owner = inner(scope)
            return owner.get(name) if isinstance(owner, dict) else None

        return field
    if kind == "filter":
        inner, name = _value(node[2]), node[1]
        return lambda scope: _filtered(name, inner(scope))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    left, right = _value(node[1]), _value(node[2])
    if kind == "+":
        return lambda scope: _shown(left(scope)) + _shown(right(scope))
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    test = BINARY[kind]
    return lambda scope: test(left(scope), right(scope))


def _body(body: list[tuple], generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    steps = [_statement(node, generated) for node in body]

    def run(scope):
        for step in steps:
            yield from step(scope)

    return run


def _statement(node: tuple, generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    kind = node[0]
    if kind == "print":
        value = _value(node[1])

        def show(scope):
            yield _shown(value(scope)), generated

        return show
    if kind == "generation":
        return _body(node[1], True)
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(scope):
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "for":
        name, items, inner = node[1], _value(node[2]), _body(node[3], generated)

        def loop(scope):
            for item in items(scope) or ():
                scope[name] = item
                yield from inner(scope)

        return loop
    arms = [(_value(test), _body(inner, generated)) for test, inner in node[1]]

    def choose(scope):
        for test, inner in arms:
            if test(scope):
                yield from inner(scope)
                return

    return choose


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of named values (``messages=...``) that yields ``(text, generated)`` pieces."""
    run = _body(fold_body(parse(source)), False)
    return lambda **values: run(values)


# ---- reading back --------------------------------------------------------------------


def read_turns(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """``role, text, generated text`` of each turn, from formatted output alone.

    Only the concatenated text and its mask are used, not the way in which it came in pieces.
    """
    text, mask = "", []  # mask: (length, generated) runs of text
    for piece, generated in pieces:
        text += piece
        mask.append((len(piece), generated))
        if not piece.endswith("\n") or (stop := text.find(END + "\n")) < 0:
            continue
        while stop >= 0:
            if not text.startswith(START):
                raise ValueError("a turn doesn't begin with its marker")
            role, _, said = text[len(START) : stop].partition("\n")
            begin = len(START) + len(role) + 1
            at, learned = 0, []
            for n, marked in mask:
                if marked:
                    learned.append(text[max(at, begin) : min(at + n, stop)])
                at += n
            yield unescape(role), unescape(said), unescape("".join(learned))
            cut = stop + len(END) + 1
            text, rest = text[cut:], cut
            left = []
            for n, marked in mask:
                if rest >= n:
                    rest -= n
                    continue
                left.append((n - rest, marked))
                rest = 0
            mask, stop = left, text.find(END + "\n")
    if text:
        raise ValueError("the output ends inside a turn")


# ---- Spark ---------------------------------------------------------------------------


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows of a conversation next to each other, in the order of its turns; ties by role and text, null turns first."""
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation with an iterator over its messages; an unread rest is skipped."""
    rows = (row for batch in batches for row in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()))
    ahead = next(rows, None)
    while ahead is not None:
        current = ahead[0]

        def messages():
            nonlocal ahead
            while ahead is not None and ahead[0] == current:
                yield {"role": ahead[1] or "", "text": ahead[2] or ""}
                ahead = next(rows, None)

        own = messages()
        yield current, own
        for _ in own:
            pass


def format_conversations(rows: DataFrame, template: str = CHATML) -> DataFrame:
    """``conv_id, part, formatted, generated``: the output in order, a piece of text and its mask a row.

    A conversation is the concatenation of its parts in the order of ``part``; it streams through one
    task and is never held whole. Null roles and texts count as empty, rows with a null id are one
    conversation, repeated rows are repeated turns.
    """

    def run(batches):
        render = compile_template(template)
        ids, parts, texts, marks, held = [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, pa.bool_())],
                names=["conv_id", "part", "formatted", "generated"],
            )

        for conv, messages in _conversations(batches):
            for part, (piece, generated) in enumerate(render(messages=messages)):
                ids.append(conv), parts.append(part), texts.append(piece), marks.append(generated)
                held += len(piece)
                if len(ids) >= 10_000 or held > 4_000_000:
                    yield flush()
                    ids, parts, texts, marks, held = [], [], [], [], 0
        if ids:
            yield flush()

    return _sorted_rows(rows).mapInArrow(run, "conv_id long, part long, formatted string, generated boolean")


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """A digest row per conversation, from the output of ``format_conversations``.

    Output that comes straight from there is ``ordered``: its partitions and order are kept. Any other is put in order first.
    """
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "generated"))))
        ahead, out = next(rows, None), []
        while ahead is not None:
            conv, turns, chars, learned_chars = ahead[0], 0, 0, 0
            whole, learned = hashlib.sha256(), hashlib.sha256()

            def pieces(conv=conv):
                nonlocal ahead, chars
                first = True
                while ahead is not None and ahead[0] == conv and (first or ahead[1]):
                    first = False
                    chars += len(ahead[2])
                    yield ahead[2], ahead[3]
                    ahead = next(rows, None)

            for role, text, generated in read_turns(pieces()):
                turns += 1
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned.update(generated.encode("utf-8", "surrogatepass"))
                learned_chars += len(generated)
            out.append((conv, turns, whole.hexdigest(), learned_chars, learned.hexdigest(), chars))
            if len(out) >= 10_000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
