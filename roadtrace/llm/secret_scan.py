"""Secret scans: fixed patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer walks a text from target to target (NAME = , a, NAME = , name: type = , name: ,
NAME["key"] = , "key": , += , --name , <name>, key="name" value= , setName( , put("name", ) and
reads the value behind it: strings, prefixed and triple-quoted ones too, joined by + or in
parentheses also over lines, bare words, bracketed lists, YAML lists and block literals. It keeps
what names hold in scopes, which braces and the indentation of functions and classes open
and close, follows a name on the right-hand side to the literals behind it, and scores a
literal by how sensitive the target's name is and how random the literal looks. Comments
are read like other lines, since a secret in one leaks as well.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame

from roadtrace.llm import spans as S

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "literal"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a target's name and how sensitive they make it.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "passcode": 3.0, "secret": 3.0, "credential": 3.0, "credentials": 3.0,
    "apikey": 3.0, "token": 2.5, "bearer": 2.5, "auth": 2.0, "authorization": 2.5, "private": 1.5, "signing": 1.5, "encryption": 1.5,
    "access": 1.0, "api": 1.0, "client": 0.5, "session": 1.0, "cookie": 1.0, "key": 1.5, "salt": 1.5, "pin": 1.5, "dsn": 1.5, "webhook": 1.0,
}
#: Literals that stand for a secret but are none.
PLACEHOLDERS = ("changeme", "example", "placeholder", "your", "xxxx", "****", "dummy", "redacted", "todo", "insert", "sample")
LEAST_SCORE = 4.0
LEAST_LENGTH = 8

_TRIPLE = r'"""(?:[^\\]|\\[\s\S])*?"""' + r"|'{3}(?:[^\\]|\\[\s\S])*?'{3}"
_PREFIX = r"""(?:[bBrRuUfF]{1,2}(?=["']))?+"""
_STRING = "(?:" + _PREFIX + "(?:" + _TRIPLE + r'|"(?:[^"\\\n]|\\[\s\S])*"' + r"|'(?:[^'\\\n]|\\[\s\S])*'|`[^`]*`))"
_TERM = rf"(?:{_STRING}|[A-Za-z0-9_$][A-Za-z0-9_$+/=.@!#%^&*~-]*)"
# Over a line's end a + joins strings, and a name only behind it: no key of a next line, as a difference of files has them.
_NO_KEY = r"(?![ \t]*+[:=])"
_JOINED = rf"(?:[ \t]*+\+[ \t]*+{_TERM}|\s*+\+\s*+(?>{_STRING}){_NO_KEY}|[ \t]*+\+\s*+[A-Za-z_$][A-Za-z0-9_$.]*+{_NO_KEY})"
# A name is read from its beginning, so blanks and names of any length are read once.
_NAMED = r"(?<![A-Za-z0-9_$.-])[0-9.-]*+(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*+)"
_SIGN = r"(?P<sign>:=|=>|\+?=(?!=)|:(?![:/]))"
_TOKEN = re.compile(
    rf"""(?P<target>{_NAMED}(?:\[?[\"']?\]?)[ \t]*+{_SIGN}[ \t]*+)
    |(?P<flag>(?<![\w-])--(?P<option>[A-Za-z][A-Za-z0-9-]*+)[ \t]++)
    |<(?P<tag>[A-Za-z_][\w.-]*+)>
    |^(?P<indent>[ \t]*+)(?:async[ \t]++)?(?:def|class)\b
    |(?P<call>(?<![A-Za-z0-9_$])(?P<method>[A-Za-z_$][A-Za-z0-9_$]*+)\((?=\s*+[bBrRuUfF]?["']))
    |(?P<open>\{{)|(?P<close>\}})""",
    re.M | re.X,
)
_VALUE = re.compile(rf"{_TERM}{_JOINED}*")
_LIST = re.compile(rf"\[(?P<items>\s*+(?:(?>{_STRING}|[A-Za-z0-9_$+/=.@!%^&*~-]++)\s*+,?\s*+)*+)\]")
_LINES = re.compile(r"(?:[ \t\r]*+\n[ \t]*+-[ \t]++(?![^\s:]*+:(?:[ \t\r]|$))[^\n]*+)++", re.M)
_LINE_ITEM = re.compile(rf"\n[ \t]*+-[ \t]++(?P<item>{_STRING}|[^\s#][^\n#]*?)[ \t\r]*+(?:#[^\n]*+)?(?=\n|\Z)")
_BLOCK = re.compile(r"[|>][-+0-9]*+[ \t\r]*+\n(?P<value>(?:[ \t]*+\n)*+(?P<inner>[ \t]++)[^\n]*+(?:\n(?:(?P=inner)[^\n]*+|[ \t]*+(?=\n)))*+)")
_ELEMENT = re.compile(r"\s*+(?P<value>[^<>\s]++(?:[ \t\r]*+\n\s*+[^<>\s]++)*+)\s*+</(?P<tag>[A-Za-z_][\w.-]*+)>")
_PART = re.compile(_TERM)
#: Strings in parentheses, one behind the other, over lines as well.
_ADJOINED = re.compile(rf"\(\s*+(?P<strings>(?>{_STRING})(?:\s*+\+?\s*+(?>{_STRING}))*+)\s*+,?\s*+\)")
#: A type between a name and its value, and a call's arguments.
_ANNOTATION = re.compile(rf"[A-Za-z_][\w.\[\], |]*+=[ \t]*+(?={_STRING}|\(\s*+[bBrRuUfF]?[\"'])")
_CALLED = re.compile(r"""\(\s*+[bBrRuUfF]?["']""")
_ARGUMENTS = re.compile(rf"\s*+(?P<one>{_STRING})(?:\s*+,\s*+(?P<two>{_STRING}))?")
_SETTER = re.compile(r"(?:set|with|put|add|use)_?(?=[A-Z_]|[a-z])")
_PAIRED = re.compile(r"(?:set|put|add|define|export|env|header|property|param|secret|config)", re.I)
#: Names in front of a name, and the comma between values.
_NAMES_BEFORE = re.compile(r"(?<![A-Za-z0-9_$.])(?:[A-Za-z_$][A-Za-z0-9_$.]*+[ \t]*+,[ \t]*+)++\Z")
_COMMA = re.compile(r"[ \t]*+,[ \t]*+")
_FILLER = re.compile(r"(?:name|key|id)", re.I)
#: Names of fields that hold the value of another name.
VALUE_NAMES = ("value", "val", "default", "text", "data", "content", "literal", "string", "plain")
_ITEM = re.compile(rf"{_STRING}|[A-Za-z0-9_$+/=.@!%^&*~-]++")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*\Z")
_INDENT = re.compile(r"[ \t]*+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[S.Span]:
    out: list[S.Span] = []
    low = text.lower()
    if any(n in low for n in _ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """The sum of the weights of a name's words; words are cut at case changes and signs."""
    words = [w.lower() for w in _WORD.findall(name)]
    joined = {"".join(words[i : i + 2]) for i in range(len(words) - 1)}
    return sum(NAME_WEIGHTS.get(w, 0.0) for w in dict.fromkeys([*words, *joined]))


class Literals:
    """What a name holds: spans and other names' literals by reference, and what scoring needs of their joined text."""

    __slots__ = ("chars", "head", "held", "parts", "tail")
    EDGE = max(map(len, PLACEHOLDERS))

    def __init__(self, parts: list[tuple[tuple[int, int] | None, str, Literals | None]]):
        """parts: (span, its text, None) or (None, "", the literals of a name)."""
        self.parts = [span or held for span, _, held in parts]
        self.chars: Counter = Counter()
        self.head = self.tail = ""
        self.held = False  # a placeholder
        for span, text, of in parts:
            head, tail = (text, text) if of is None else (of.head, of.tail)
            edge = (self.tail + head[: self.EDGE]).lower()
            self.held |= any(p in edge for p in PLACEHOLDERS) or (any(p in text.lower() for p in PLACEHOLDERS) if of is None else of.held)
            self.chars.update(text if of is None else of.chars)
            if len(self.head) < self.EDGE:
                self.head = (self.head + head)[: self.EDGE]
            self.tail = (self.tail + tail)[-self.EDGE :]

    def score(self) -> float:
        """How random the joined text looks: bits a character, kinds of characters; placeholders and plain words lose."""
        n = sum(self.chars.values())
        if n < LEAST_LENGTH or self.held or self.head.startswith(("$", "{", "<", "http")):
            return -10.0
        bits = -sum(c / n * math.log2(c / n) for c in self.chars.values())
        kinds = sum(any(f(c) for c in self.chars) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in self.chars)
        return (bits - 2.0) + 0.5 * (kinds - 1) - (2.0 if " " in self.chars else 0.0)


def literal_score(value: str) -> float:
    return Literals([((0, len(value)), value, None)]).score()


def _part(text: str, start: int, end: int) -> tuple:
    """A term of a value: the span of a literal without its quotes, with its name where it may be a constant's."""
    word = text[start:end]
    at = 0
    while at < 2 and at + 1 < len(word) and word[at] in "bBrRuUfF" and word[-1] in "\"'":
        at += 1
    if at and word[at] in "\"'":
        start, word = start + at, word[at:]
    if word[0] in "\"'`":
        n = 3 if len(word) >= 6 and word[:3] in ('"""', "\'\'\'") else 1
        return start + n, end - n
    return (start, end, word) if _NAME.match(word) else (start, end)


def _values(text: str, at: int, indent: int) -> tuple[list[list[tuple]], int]:
    """The values behind a sign, each a list of parts that are joined, and where they end."""
    if m := _LIST.match(text, at):
        return [[_part(text, *i.span())] for i in _ITEM.finditer(text, *m.span("items"))], m.end()
    if m := _LINES.match(text, at):
        return [[_part(text, *i.span("item"))] for i in _LINE_ITEM.finditer(text, m.start(), m.end())], m.end()
    if (m := _BLOCK.match(text, at)) and len(m["inner"]) > indent:
        start, end = m.span("value")
        return [[(end - len(m["value"].lstrip()), end)]], end
    if m := _ADJOINED.match(text, at):
        return [[_part(text, *t.span()) for t in _ITEM.finditer(text, *m.span("strings")) if t[0] != "+"]], m.end()
    if m := _VALUE.match(text, at):
        return [[_part(text, *t.span()) for t in _PART.finditer(text, m.start(), m.end())]], m.end()
    return [], at


def _before(text: str, low: int, high: int, name: str) -> list[str] | None:
    """The names of a, b, name = ..., if there are any before the name."""
    m = _NAMES_BEFORE.search(text, low, high)
    return [*(n.strip() for n in m[0].split(",")[:-1]), name] if m else None


def lex(text: str) -> Iterator[tuple[str, str, bool, list]]:
    """What stands in the text, in order: ("pair", target name, whether it keeps what it held, parts), or a scope's ("open", the name it belongs to, ...) and ("close", ...).

    A part is the span of a literal, or that and a name whose literals are meant.
    """
    breaks = [m.start() for m in re.finditer("\n", text)]
    functions: list[int] = []  # indents of the functions and classes that stand open
    labelled: tuple[int, int] | None = None  # where the literal of a field called name or key stands
    age = ended = at = 0
    while m := _TOKEN.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind in ("open", "close"):
            yield kind, "", False, []
            continue
        k = bisect_left(breaks, m.start())
        line = breaks[k - 1] + 1 if k else 0
        indent = _INDENT.match(text, line).end() - line
        first = line + indent == m.start() or kind == "indent"
        while first and functions and indent <= functions[-1]:
            functions.pop()
            yield "close", "", False, []
        if kind == "indent":
            functions.append(indent)
            yield "open", "", False, []
        elif kind == "tag":
            if (e := _ELEMENT.match(text, at)) and e["tag"] == m["tag"]:
                at = e.end()
                yield "pair", m["tag"], False, [e.span("value")]
        elif kind == "call":
            if (c := _ARGUMENTS.match(text, at)) is None:
                continue
            if c["two"] and _PAIRED.search(m["method"]) and _NAME.match(key := text[slice(*_part(text, *c.span("one"))[:2])]):
                yield "pair", key, False, [_part(text, *c.span("two"))]
                at = c.end()
            elif s := _SETTER.match(m["method"]):
                yield "pair", m["method"][s.end() :], False, [_part(text, *c.span("one"))]
                at = c.end("one")
        else:
            name = m["name"] or m["option"]
            if m["sign"] == ":" and (t := _ANNOTATION.match(text, at)):
                at = t.end()
            values, to = _values(text, at, indent)
            if not values and text[at : at + 1] == "{":  # a scope of its own
                yield "open", name, False, []
                at += 1
                continue
            names = _before(text, max(ended, line), m.start(), name) if m["sign"] in ("=", ":=") and len(values) == 1 else None
            if names:  # as many values as names, each to its own
                each = [values[0]]
                while len(each) < len(names) and (c := _COMMA.match(text, to)) and (v := _VALUE.match(text, c.end())):
                    each.append([_part(text, *t.span()) for t in _PART.finditer(text, v.start(), v.end())])
                    to = v.end()
                if len(each) == len(names):
                    for n, parts in zip(names, each):
                        yield "pair", n, False, parts
                    at = ended = to
                    continue
            # A field called value belongs to the name or key that stands in the pair before.
            label = text[slice(*labelled)] if labelled and name.lower() in VALUE_NAMES else None
            for parts in values:
                yield "pair", label if label and _NAME.match(label) else name, m["sign"] == "+=", parts
            fresh = values[0][0][:2] if len(values) == 1 and len(values[0]) == 1 and _FILLER.fullmatch(name) else None
            labelled, age = (fresh, 0) if fresh else (labelled, age + 1) if age < 1 and not label else (None, 0)
            at = ended = to


def literal_spans(text: str) -> list[S.Span]:
    """Literals that reach a sensitive name, directly or through names assigned before in the same or an outer scope."""
    if not ("=" in text or ":" in text or "--" in text or "</" in text or "(" in text and _CALLED.search(text)):
        return []
    names: dict[str, list[tuple[int, Literals]]] = {}  # what a name holds, by the depth of its scope, the innermost last
    scopes: list[tuple[str, list[str]]] = [("", [])]  # the name that a scope belongs to, and the names that it defines
    out: set[tuple[int, int]] = set()
    emitted: set[int] = set()
    alive: list[Literals] = []  # so that no id is used twice

    def holder(name: str) -> Literals | None:
        return names[name][-1][1] if names.get(name) else None

    for kind, name, keeps, parts in lex(text):
        if kind == "open":
            scopes.append((name, []))
            continue
        if kind == "close":
            if len(scopes) > 1:
                for gone in scopes.pop()[1]:
                    names[gone].pop()
            continue
        was = holder(name) if keeps else None
        held = [(None, "", was)] if was else []
        for p in parts:
            of = holder(p[2]) if len(p) == 3 else None  # a bare word: a known constant, else a literal of its own
            held.append((None, "", of) if of else (p[:2], text[p[0] : p[1]], None))
        node = Literals(held)
        alive.append(node)
        depth, known = len(scopes) - 1, names.setdefault(name, [])
        if was or known and known[-1][0] == depth:
            known[-1] = (known[-1][0], node)
        else:
            known.append((depth, node))
            scopes[-1][1].append(name)
        weight = name_score(name)
        if weight <= 0 and name.lower() in VALUE_NAMES:
            weight = name_score(scopes[-1][0])
        if weight > 0 and weight + node.score() >= LEAST_SCORE:
            todo = [node]
            while todo:
                if id(top := todo.pop()) in emitted:
                    continue
                emitted.add(id(top))
                for p in top.parts:
                    if isinstance(p, Literals):
                        todo.append(p)
                    elif p[1] > p[0]:
                        out.add(p)
    return [("literal", a, b) for a, b in out]


def find(text: str) -> list[S.Span]:
    """All spans by start, then kind."""
    found = base_spans(text) + literal_spans(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of secrets in every whole text.

    docs: doc_id long, text string; other columns are ignored. Kinds: assign, access, hex
    (fixed patterns, leftmost and non-overlapping within a kind) and literal (the lexer's).
    Null or empty texts have no spans; texts, names and literals of any length are read
    whole; spans that start together stand in the order of the kinds; repeated rows are
    scanned again; a null doc_id stays null. An empty table gives an empty result.
    """
    return S.scan(docs, find)


def _mark(kind: str, word: str) -> str:
    return f"[{word}]"


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the spans of find_secrets in text replaced by [SECRET], overlapping ones as one.

    All rows and columns stay, whatever their names; null and empty texts stay as they are,
    texts of any length are read whole, and repeated rows change alike.
    """
    return S.redact(docs, find, partial(_mark, word="SECRET"))
