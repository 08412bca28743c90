"""Personal data: fixed patterns, and an offset-preserving deobfuscator in front of them.

Transducers rewrite every text: letters and digits of other scripts that look like or stand
for ASCII ones become those, invisible characters vanish, character references are read,
digits spelled in four languages become digits, at and dot in brackets or between words
become signs. Each rewritten stretch remembers the source characters it came from, so what
the patterns find there is mapped back to spans of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

from pyspark.sql import DataFrame

from roadtrace.llm import spans as S

BASE_KINDS = ["email", "ip", "card", "phone"]
HIDDEN = {k: f"hidden_{k}" for k in BASE_KINDS}
KINDS = [*BASE_KINDS, *HIDDEN.values()]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_SIGN = re.compile(r"[0-9]\.[0-9]")
# A number's inner digits cannot begin what its first digit could not, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Names of the digits 0 to 9 in English, German, French and Spanish.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT_WORDS = {w: str(i) for names in DIGIT_NAMES.values() for i, w in enumerate(names.split())} | {"zwo": "2", "fuenf": "5"}
#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    **dict(zip("аеорсухіјѕԁһкмтвнԛԝпгАЕОРСУХІЈЅКМТВНԚԜ", "aeopcyxijsdhkmtbhqwnrAEOPCYXIJSKMTBHQW")),  # Cyrillic
    **dict(zip("οαρνιкηυγτκΟΑΡΝΙΚΕΒΗΜΤΧΖΥ", "oapviknuytkOAPNIKEBHMTXZY")),  # Greek
    **dict(zip("աոսօցհյԼՍՕ", "wnuoghjLUO")),  # Armenian
    **dict(zip("ɑɡıɩʟɴʀʏᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜱ", "agiilnryacdejkmoptuvwzs")),  # Latin letters of other alphabets
    **dict(zip("ᎠᎡᎢᎪᎬᎳᎷᎻᏀᏃᏎᏒᏔᏚᏞᏟᏢ", "DRTAEWMHGZ4RWSLCP")),  # Cherokee
    **dict(zip("‐‑‒–—−﹣", "-------")),
    **dict(zip("。｡․﹒", "....")),
}
#: Words that stand for the signs.
AT_WORDS, DOT_WORDS = "at|ät|arroba|arobase", "dot|punkt|punto|point"
_AT_LIST, _DOT_LIST = [*AT_WORDS.split("|"), "@"], [*DOT_WORDS.split("|"), "."]
#: Characters that are not seen.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFE0F, 0xFEFF)))

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Letters that a pattern without case takes for ASCII ones, though lower() does not.
_FOLD = str.maketrans("ſıİ" + chr(0x212A), "siik")

_BRACKETED = re.compile(rf"[\[({{<]\s{{0,3}}(?:(?P<at>{AT_WORDS}|@)|{DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_DOMAIN_AHEAD = re.compile(rf"\s{{1,3}}(?=[\w-]{{1,63}}(?:\s{{1,3}}(?:{DOT_WORDS}|\.)\s{{1,3}}|\.)\w)", re.I)
_LABEL_AHEAD = re.compile(r"\s{1,3}(?=[\w-])")
_NUMBER_AHEAD = re.compile(rf"[ ]{{1,2}}(?=(?:{_WORDS}|[0-9]))", re.I)
_REFERENCE = re.compile(r"&\#(?:x[0-9a-f]{1,6}|[0-9]{1,7});|&(?:commat|period);|%(?:40|2e)", re.I)


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain takes the characters before it, so long runs are read once."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[S.Span]:
    """By kind as listed, then start."""
    out: list[S.Span] = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    if _IP_SIGN.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


@lru_cache(4096)
def _ascii(c: str) -> str:
    """What a character stands for: ASCII, nothing where it is not seen, or itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and len(plain) <= 2 else c


@lru_cache(4096)
def _referred(reference: str) -> str:
    """The character of &#64; or %40, where it is a visible ASCII one."""
    if reference[0] == "%":
        return chr(int(reference[1:], 16))
    name = reference[1:-1].lower()
    if name[0] != "#":
        return {"commat": "@", "period": "."}[name]
    code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
    return chr(code) if 32 < code < 127 else reference


def _found(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


@lru_cache(1024)
def _any_of(chars: str) -> re.Pattern:
    return re.compile("[" + re.escape(chars) + "]")


def _stretches(text: str) -> Iterator[tuple[int, int, int, int, str]]:
    """What the transducers rewrite: (first start, rank, last start, end, new characters).

    A stretch may give up blanks before its last start to the one before it. Words are looked
    up one by one and their surroundings checked, since few of them stand alone.
    """
    low = text.lower()
    if len(low) != len(text) or any(c in text for c in "ſıİ" + chr(0x212A)):
        low = text.translate(_FOLD)
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in low)

    def blanks(at: int) -> int:
        """How many of the three characters before `at` are blanks, without a gap."""
        n = 0
        while n < 3 and at - n > 0 and text[at - n - 1].isspace():
            n += 1
        return n

    for m in _BRACKETED.finditer(text) if any(c in text for c in "[({<") else ():
        yield m.start() - blanks(m.start()), 0, m.start(), m.end(), "@" if m["at"] else "."
    for words, ahead, sign, rank in ((_AT_LIST, _DOMAIN_AHEAD, "@", 2), (_DOT_LIST, _LABEL_AHEAD, ".", 3)):
        for w in words:
            for at in _found(low, w):
                end = at + len(w)
                if at and text[at - 1].isspace() and end < len(text) and text[end].isspace() and (m := ahead.match(text, end)):
                    yield at - blanks(at), rank, at - 1, m.end(), sign
    for w, digit in DIGIT_WORDS.items():
        for at in _found(low, w):
            end = at + len(w)
            if not (at and text[at - 1].isalpha()) and not (end < len(text) and text[end].isalpha()):
                yield at, 5, at, end, digit
    for at in _found(low, "plus"):
        if not (at and text[at - 1].isalpha()) and (m := _NUMBER_AHEAD.match(text, at + 4)):
            yield at, 4, at, m.end(), "+"
    for m in _REFERENCE.finditer(text) if "&" in text or "%" in text else ():
        if (chars := _referred(m[0])) != m[0]:
            yield m.start(), 6, m.start(), m.end(), chars
    if not text.isascii():
        foreign = "".join(sorted(c for c in set(text) if c > "\x7f" and _ascii(c) != c))
        for m in _any_of(foreign).finditer(text) if foreign else ():
            yield m.start(), 7, m.start(), m.end(), _ascii(m[0])


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The plain text, and its changed stretches: start and end in it, start and end in the source.

    Of overlapping stretches the earlier one is rewritten, of those that start together the
    one of the smaller rank.
    """
    out, edits = [], []
    at = size = 0
    for start, _, last, end, chars in sorted(_stretches(text)):
        if last < at:
            continue
        start = max(start, at)
        out += [text[at:start], chars]
        size += start - at
        edits.append((size, size + len(chars), start, end))
        size += len(chars)
        at = end
    return "".join([*out, text[at:]]), edits


_LONG_NUMBER = re.compile(r"[0-9](?:[\s,.()-]{0,2}[0-9]){8,14}(?![0-9])")


def hidden_spans(text: str, known: list[S.Span]) -> list[S.Span]:
    """What shows only after rewriting, as source spans; what the fixed patterns found already is left out."""
    plain, edits = rewritten(text)
    if not edits:
        return []
    starts, ends = [e[0] for e in edits], [e[1] for e in edits]

    def source(i: int) -> tuple[int, int]:
        """The source characters of a plain one."""
        k = bisect_right(starts, i) - 1
        if k < 0:
            return i, i + 1
        _, b, start, end = edits[k]
        return (start, end) if i < b else (end + i - b, end + i - b + 1)

    def changed(s: int, e: int) -> int:
        """Stretches that lie in plain[s:e], vanished ones between its characters."""
        first = bisect_right(ends, s)
        last = bisect_left(starts, e)
        return max(0, last - first)

    found = base_spans(plain)
    taken = sorted((s, e) for _, s, e in found)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _LONG_NUMBER.finditer(plain):  # a spelled number needs no plus sign
        k = bisect_left(begins, m.end())
        if changed(*m.span()) >= 7 and not (k and reach[k - 1] > m.start()):
            found.append(("phone", *m.span()))
    # Known spans of a kind do not overlap, so only the last that begins before may hold another.
    held = {kind: sorted((s, e) for k, s, e in known if k == kind) for kind in BASE_KINDS}
    firsts = {kind: [s for s, _ in spans] for kind, spans in held.items()}
    out = []
    for kind, s, e in found:
        if not changed(s, e):
            continue
        start, end = source(s)[0], source(e - 1)[1]
        k = bisect_right(firsts[kind], start)
        if not (k and held[kind][k - 1][1] >= end):
            out.append((HIDDEN[kind], start, end))
    return out


def find(text: str) -> list[S.Span]:
    """All spans by kind, then start."""
    found = base_spans(text)
    found = found + hidden_spans(text, found)
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of personal data in every whole text.

    docs: doc_id long, text string; other columns are ignored. Kinds: email, ip, card and
    phone (fixed patterns, leftmost and non-overlapping within a kind) and hidden_ forms
    of these, found in the rewritten text. Null or empty texts have no spans; texts of any
    length are read whole; spans of a kind that start together stand by their ends; repeated
    rows are scanned again; a null doc_id stays null. An empty table gives an empty result.
    """
    return S.scan(docs, find)


def _mark(kind: str) -> str:
    return f"[{kind.removeprefix('hidden_').upper()}]"


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """docs with the spans of find_personal_data in text replaced by their kind, overlapping ones as one.

    All rows and columns stay, whatever their names; null and empty texts stay as they are,
    texts of any length are read whole, and repeated rows change alike.
    """
    return S.redact(docs, find, partial(_mark))
