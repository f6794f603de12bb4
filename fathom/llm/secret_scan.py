"""Secret scans by assignment-aware lexing.

A lexer with states (quotes with escapes, triple quotes, comments, brackets, indentation, tags) reads source and
configuration syntax into pairs of a name and literals: assignments with and without types, keys of maps and nested
keys, subscripts, options, arguments of name and value, elements and attributes. Strings that are put together count
as one literal of several spans. A name on the right that is bound in the scope or in one around it stands for its
literals (constants are propagated, through chains as well). What is inside a comment or a string is lexed as a source
of its own that binds nothing outside. A literal is scored by how sensitive the names of its target are and by how
key-like it looks; spans of those at or above the threshold are reported as `lex`. Three base patterns are searched
beside them and always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "lex")

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", re.A)
IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
KEYLIKE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*:-]*", re.A)
ESCAPE = re.compile(r"\\.", re.S)

# --- the lexer's patterns

#: Letters that can stand before a string's quote.
PREFIXES = "rbfuRBFU@$"
TOKEN = re.compile(
    r"""
    (?P<line>\n) | (?P<space>[^\S\n]+)
    | (?P<comment><!-- | /\* | (?<![:/\w])// | (?<!\S)\#)
    | (?P<tag></?[A-Za-z_][\w:.-]*(?=[\s/>]))
    | (?P<option>(?<!\S)--(?P<option_name>[A-Za-z][\w-]*)[ \t]+(?=[^\s-]))
    | (?P<string>(?<!\w)[rbfuRBFU@$]{0,2}(?:\"\"\"|'''|["']))
    | (?P<name>[A-Za-z_$@][\w$]*(?:(?:[.-]|::)[\w$]+)*)
    | (?P<index>(?<=[\w$])\[\s*(?:["'](?P<index_name>[\w.$-]+)["'])?\s*\])
    | (?P<other>===?|!==?|[<>]=|\d[\w.]*)
    | (?P<assign>=>|:=|=|:(?!:))
    | (?P<open>[{\[(]) | (?P<close>[}\])])
    | .
    """,
    re.X | re.S | re.A,
)
PARTNERS = {"}": "{", "]": "[", ")": "("}
#: A line's indentation, and the dash of a list's item.
INDENT = re.compile(r"([ \t]*)(- [ \t]*)*")
QUOTED = {sign: re.compile(rf"{sign}([^{sign}\\\n]*(?:\\.[^{sign}\\\n]*)*){sign}" + end) for sign, end in (('"', ""), ("'", r"(?!\w)"), ("`", ""))}
QUOTED_NAME = re.compile(r"[A-Za-z_$][\w.$ -]{0,79}", re.A)
#: A type between a name's colon and the sign that assigns.
TYPED = re.compile(r"""[ \t]*[&*\w\[(][\w.<>\[\]|?, \t&*()']*?(?:=(?=[ \t]*[rbfuRBFU@$]{0,2}["'`])|[ \t]=(?=[ \t]+[A-Za-z_$]))""", re.A)
VALUE = re.compile(r"""(?P<quote>[rbfuRBFU@$]{0,2}(?:\"\"\"|'''|["'`])) | (?P<bare>[^\s"'`,;(){}\[\]<>|]+)""", re.X)
SPACES, BLANKS = re.compile(r"[ \t]*"), re.compile(r"\s*")
#: Signs that put strings together; inside brackets on several lines.
JOINED, JOINED_ON = re.compile(r"[ \t]*(?:\+|\.\.?|&|\|\||\\\n)[ \t]*(?=[\w$rbfuRBFU@]*[\w$\"'`])"), re.compile(r"\s*(?:\+|\.\.?|&|\|\|)\s*")
CLOSED = re.compile(r"\s*\)")
ATTRIBUTE = re.compile(r"""\s+([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.A)
ELEMENT_TEXT = re.compile(r"\s*>([^<]*)</([\w:.-]+)\s*>", re.A)
#: All of a list item, if it is one literal.
ITEM = re.compile(r"""(?:(["'])([^"'\\\n]*)\1|([^\s"'`,;(){}\[\]<>|]*[^\s"'`,;(){}\[\]<>|:]))[ \t]*$""", re.M)
#: What a text must have for a pair to be in it.
SIGNS = re.compile(r"[=:<]")
# Words of types, words that begin a block with names of its own, keys whose values are a name and its value.
TYPE_WORDS = {"string", "str", "char", "text", "byte", "bytes", "varchar", "object", "any", "int", "bool", "wstring", "securestring"}
SCOPE_WORDS = {"def", "class", "async"}
NAME_FIELDS, VALUE_FIELD = ("name", "key"), "value"
#: Part of the score of a name around the target's own. Sources inside each other that are read, scopes that are kept
#: apart, and names around a target that are looked at.
OUTER_PART, MOST_DEPTH, MOST_SCOPES, MOST_NAMES = 0.9, 6, 64, 8

# How sensitive a word of a target's name is.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "bearer": 0.9,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "access": 0.5, "api": 0.5, "auth": 0.6, "client": 0.3, "signing": 0.6,
    "encryption": 0.6, "key": 0.5, "session": 0.4, "salt": 0.6, "cookie": 0.4,
}
# Words that make a name or a literal harmless.
HARMLESS = {"public", "example", "placeholder", "changeme", "none", "null", "true", "false", "undefined", "xxx", "todo", "count", "length", "limit", "max", "name", "type"}
#: Score from which a literal is reported, and the shortest one that is looked at.
THRESHOLD, LEAST_LITERAL = 1.25, 8


@lru_cache(maxsize=1 << 16)
def name_score(name: str) -> float:
    """Sum of the scores of the words in a target's name, at most 1; 0 if a word makes it harmless."""
    words = [w.lower() for w in WORD.findall(name)]
    return 0.0 if HARMLESS & set(words) else min(1.0, sum(NAME_SCORES.get(w, NAME_SCORES.get(w.removesuffix("s"), 0.0)) for w in words))


def path_score(path: tuple[str, ...]) -> float:
    """The score of a name inside others: its own, or the best of those around it, a little less."""
    if HARMLESS & {w.lower() for w in WORD.findall(path[-1])}:
        return 0.0
    return max(name_score(path[-1]), *(OUTER_PART * name_score(n) for n in path[:-1]), 0.0)


def literal_score(value: str, escaped: str | None = None) -> float:
    """0 to 1: by entropy a character and mix of classes; 0 for words, phrases, references and short values.

    escaped: the literal as it is written, if it has escapes; characters that are escaped can be any.
    """
    plain = value if escaped is None else ESCAPE.sub("", escaped)
    if len(value) < LEAST_LITERAL or not KEYLIKE.fullmatch(plain) or value.lower() in HARMLESS or value.startswith(("$", "http")):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4) * min(1.0, 0.4 + 0.2 * classes) if classes > 1 else 0.0


Span = tuple[int, int]


@dataclass
class Frame:
    """An open bracket, an indented block or an element: the names around what is in it."""

    kind: str
    path: tuple[str, ...] = ()
    indent: int = 0
    scope: bool = False
    # the spans bound to the keys in it that can make a pair of name and value
    fields: dict[str, list[Span]] = field(default_factory=dict)


class Lexer:
    """Reads a text and collects the spans of literals that reach a sensitive name."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: set[Span] = set()
        self.scopes: list[dict[str, list[Span]]] = [{}]
        # open brackets of each kind, by how deep their source is inside others
        self.brackets: Counter[tuple[int, str]] = Counter()

    def lex(self, at: int, end: int, depth: int = 0) -> None:
        """One source from at to end. Its brackets and names are its own; it sees the names of what is around it."""
        outer = len(self.scopes)
        self.scopes.append({})
        for kind in PARTNERS.values():
            self.brackets[depth, kind] = 0
        frames = [Frame("top")]
        head: list[str] = []
        first, indent, waiting, fresh = "", 0, None, True
        while at < end:
            if fresh:
                # a line's start: blocks end and begin by its indentation
                fresh, head, first = False, [], ""
                line = INDENT.match(self.text, at, end)
                if line.end() < end and self.text[line.end()] != "\n":
                    indent = line.end() - at
                    level = line.end(1) - at
                    while frames[-1].kind == "block" and frames[-1].indent > level:
                        self._pop(frames, depth)
                    if waiting is not None and level >= waiting.indent:
                        self._push(frames, waiting, depth)
                    waiting = None
                    if line[2]:
                        self._push(frames, Frame("block", frames[-1].path, level + 1), depth)
                        item = ITEM.match(self.text, line.end(), end)
                        if item and frames[-1].path:
                            self._consider(frames[-1].path, [item.span(2 if item[2] is not None else 3)])
                at = line.end()
                continue
            m = TOKEN.match(self.text, at, end)
            kind, at = m.lastgroup, m.end()
            if kind == "space":
                continue
            if kind == "line":
                fresh = True
                continue
            if kind == "comment":
                stop = {"/*": "*/", "<!--": "-->"}.get(m[0], "\n")
                close = self.text.find(stop, at, end)
                close = end if close < 0 else close
                if depth < MOST_DEPTH:
                    self.lex(at, close, depth + 1)
                at = close if stop == "\n" else min(end, close + len(stop))
                continue
            if kind == "string":
                inner = self._string(m, end)
                if inner is None:
                    at = m.start() + 1
                    head = []
                    continue
                at = inner[2]
                self._nested(inner, depth)
                if frames[-1].kind == "[" and frames[-1].path and not head:
                    self._consider(frames[-1].path, [inner[:2]])
                elif frames[-1].kind == "(" and len(head) == 1 and frames[-1].fields.get(","):
                    # a call's arguments: a name and its value
                    self._consider((head[0],), [inner[:2]])
                value = self.text[inner[0] : inner[1]]
                head.append(value if QUOTED_NAME.fullmatch(value) else "")
                continue
            if kind == "name":
                first = first or m[0]
                head.append(m[0])
                continue
            if kind == "option":
                at = self._assign(frames, (m["option_name"],), at, end, "=", depth)[0]
                head = []
                continue
            if kind == "index":
                head.append(m["index_name"] or (head[-1] if head else ""))
                continue
            if kind == "tag":
                at = self._element(m, at, end)
                head = []
                continue
            if kind == "assign":
                name = self._target(head, m[0])
                head = []
                if not name:
                    if m[0] == ":" and first in SCOPE_WORDS:
                        waiting = Frame("block", (), indent + 1, True)
                    continue
                typed = TYPED.match(self.text, at, end) if m[0] == ":" else None
                at, opened = self._assign(frames, (*frames[-1].path, name), typed.end() if typed else at, end, "=" if typed else m[0], depth)
                if opened == ":":
                    waiting = Frame("block", (*frames[-1].path, name)[-MOST_NAMES:], indent + 1)
                elif opened:
                    self._push(frames, Frame(opened, (*frames[-1].path, name)[-MOST_NAMES:]), depth)
                continue
            if kind == "open":
                block = m[0] == "{"
                self._push(frames, Frame(m[0], frames[-1].path if frames[-1].kind in PARTNERS.values() else (), scope=block), depth)
                head = []
                continue
            if kind == "close":
                if self.brackets[depth, PARTNERS[m[0]]]:
                    while self._pop(frames, depth).kind != PARTNERS[m[0]]:
                        pass
                head = []
                continue
            if m[0] == "," and frames[-1].kind == "(" and len(head) == 1 and not frames[-1].fields:
                frames[-1].fields[","] = [(0, 0)]
                continue
            head = []
        del self.scopes[outer:]

    def _push(self, frames: list[Frame], frame: Frame, depth: int) -> None:
        frame.scope = frame.scope and len(self.scopes) < MOST_SCOPES
        frames.append(frame)
        self.brackets[depth, frame.kind] += 1
        if frame.scope:
            self.scopes.append({})

    def _pop(self, frames: list[Frame], depth: int) -> Frame:
        gone = frames.pop()
        self.brackets[depth, gone.kind] -= 1
        if gone.scope:
            self.scopes.pop()
        return gone

    @staticmethod
    def _target(head: list[str], sign: str) -> str:
        """The name that a sign assigns to: the last one, but for a type after it."""
        if len(head) > 1 and sign in ("=", ":=") and head[-1].lower() in TYPE_WORDS and head[-2]:
            return head[-2]
        return head[-1] if head else ""

    def _string(self, m: re.Match, end: int) -> tuple[int, int, int] | None:
        """(start, end, after) of the contents of a string that opens at a match; None if it does not end."""
        sign = m[0].lstrip(PREFIXES)
        if len(sign) == 3:
            close = self.text.find(sign, m.end(), end)
            return None if close < 0 else (m.end(), close, close + 3)
        whole = QUOTED[sign].match(self.text, m.end() - 1, end)
        return (whole.start(1), whole.end(1), whole.end()) if whole else None

    def _nested(self, inner: tuple[int, int, int], depth: int) -> None:
        if depth < MOST_DEPTH and SIGNS.search(self.text, inner[0], inner[1]):
            self.lex(inner[0], inner[1], depth + 1)

    def _lookup(self, name: str) -> list[Span] | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def _assign(self, frames: list[Frame], path: tuple[str, ...], at: int, end: int, sign: str, depth: int) -> tuple[int, str]:
        """Read what is assigned to a name. Gives where it ends, and the bracket (or `:` for a block) that it opens."""
        spans: list[Span] = []
        around = wanted = False
        while True:
            at = (BLANKS if around else SPACES).match(self.text, at, end).end()
            sort = VALUE.match(self.text, at, end)
            if sort is None:
                if sign == ":" and not spans and (at >= end or self.text[at] == "\n"):
                    return at, ":"
                if not spans and at < end and self.text[at] in "{[":
                    return at + 1, self.text[at]
                if not spans and not around and at < end and self.text[at] == "(":
                    at, around = at + 1, True
                    continue
                break
            if sort.lastgroup == "quote":
                inner = self._string(sort, end)
                if inner is None:
                    break
                self._nested(inner, depth)
                spans.append(inner[:2])
                at = inner[2]
            else:
                word = sort["bare"].rstrip(".")
                own = IDENTIFIER.fullmatch(word) is not None and sort.end() < end and self.text[sort.end()] == "("
                if own or (spans and not wanted):
                    break
                bound = self._lookup(word)
                if bound is not None:
                    spans += bound
                elif not spans and (around or sign != "=" or not JOINED.match(self.text, sort.end(), end)):
                    spans.append((at, at + len(word)))
                at += len(word)
            wanted = False
            more = (JOINED_ON if around else JOINED).match(self.text, at, end)
            if more:
                at, wanted = more.end(), True
        if around:
            closed = CLOSED.match(self.text, at, end)
            at = closed.end() if closed else at
        if spans:
            self._bind(frames, path, spans)
        return at, ""

    def _bind(self, frames: list[Frame], path: tuple[str, ...], spans: list[Span]) -> None:
        top = frames[-1]
        if (top.kind in PARTNERS.values() and top.path) or (top.kind == "block" and not top.scope):
            # a key of a map is no variable, but can be named through the map
            self.scopes[-1][".".join(path)] = spans
        else:
            self.scopes[-1][path[-1]] = spans
        self._consider(path, spans)
        if top.kind != "top" and path[-1].lower() in (*NAME_FIELDS, VALUE_FIELD):
            top.fields[path[-1].lower()] = spans
            self._fields(top.fields)

    def _fields(self, fields: dict[str, list[Span]]) -> None:
        """A name and its value, given side by side."""
        name = next((self._value(fields[f]) for f in NAME_FIELDS if f in fields), "")
        if name and VALUE_FIELD in fields:
            self._consider((name,), fields[VALUE_FIELD])

    def _element(self, m: re.Match, at: int, end: int) -> int:
        """A tag's attributes, and the text of an element that holds nothing else."""
        if m[0].startswith("</"):
            return at
        fields: dict[str, list[Span]] = {}
        while attribute := ATTRIBUTE.match(self.text, at, end):
            group = 2 if attribute[2] is not None else 3
            fields[attribute[1].lower()] = [attribute.span(group)]
            self._consider((attribute[1],), fields[attribute[1].lower()])
            at = attribute.end()
        self._fields(fields)
        inner = ELEMENT_TEXT.match(self.text, at, end)
        if inner and inner[2] == m[0][1:] and inner[1].strip():
            names = [self._value(fields[f]) for f in NAME_FIELDS if f in fields]
            start = inner.start(1) + len(inner[1]) - len(inner[1].lstrip())
            self._consider((m[0][1:], *names[:1]), [(start, start + len(inner[1].strip()))])
        return at

    def _value(self, spans: list[Span]) -> str:
        return "".join(self.text[a:b] for a, b in spans)

    def _consider(self, path: tuple[str, ...], spans: list[Span]) -> None:
        named = path_score(path)
        if not named:
            return
        written = self._value(spans)
        value = ESCAPE.sub(lambda e: e[0][1], written) if "\\" in written else written
        if named + literal_score(value, written if value != written else None) >= THRESHOLD:
            self.found.update(s for s in spans if s[0] < s[1])


def lexed_spans(text: str) -> list[Span]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    # a name scores by its words, so a text with none of these has nothing to find
    low = text.lower()
    if not any(w in low for w in NAME_SCORES):
        return []
    lexer = Lexer(text)
    lexer.lex(0, len(text))
    return sorted(lexer.found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches, in code points."""
    low, found = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by start and then kind as listed."""
    base = base_spans(text)
    more = [("lex", a, b) for a, b in lexed_spans(text)] if SIGNS.search(text) else []
    by = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=by), sorted(base + more, key=by)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive).

    Null counts as empty text, which has no spans; an empty table gives an empty result. Texts are scanned whole. Rows
    that repeat an id or a text are scanned each, in no order; other columns are ignored, so their names cannot clash.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scan(x.as_py()) for x in batch.column(1)]
            listed = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *listed], ["doc_id", "base", "spans"])

    item = "array<struct<kind:string,start:long,end:long>>"
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, base {item}, spans {item}")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """text with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for _, a, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
