"""Texts, codes, hashes and cells as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadtrace.schemas import PLATE_LETTERS

# Letters that are folded, digits of two scripts, the characters that start a formula.
FOLD_FROM, FOLD_TO = "أإآٱىئؤة", "ااااييوه"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
FORMULA_START = r"^[=+\-@\t\r]"


def normalize_arabic(text: Column) -> Column:
    """Without marks and stretching, letters folded, digits ASCII, white space collapsed; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]", "")
    return F.trim(F.regexp_replace(F.translate(bare, FOLD_FROM + DIGITS_FROM, FOLD_TO + DIGITS_TO), r"(?U)\s+", " "))


def normalize_plate(raw: Column) -> Column:
    kept = F.regexp_replace(F.upper(normalize_arabic(raw)), f"[^0-9A-Z {PLATE_LETTERS}]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def looks_like_plate(text: Column) -> Column:
    plate = normalize_plate(text)
    digits = F.length(F.regexp_replace(plate, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(plate, "[0-9 ]", ""))
    return digits.between(3, 4) & letters.between(2, 4)


def display_name(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, the code itself where it has none."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def sanitize_cell(text: Column) -> Column:
    """Cells that a spreadsheet would read as a formula get an apostrophe."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def phash_distance(a: Column, b: Column, digits: int = 64) -> Column:
    """Different bits of two hashes of `digits` hexadecimal digits; null where one is malformed."""
    good = F.lower(a).rlike(f"^[0-9a-f]{{{digits}}}$") & F.lower(b).rlike(f"^[0-9a-f]{{{digits}}}$")
    part = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("bigint")
    bits = sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(1, digits, 8)), F.lit(0))
    return F.when(good, bits)


def pseudonymize_plate(plate: Column, key: str) -> Column:
    """PLATE- and ten digits of HMAC-SHA256 under a secret key; null and empty plates stay null."""
    if not key:
        raise ValueError("a secret key is needed")
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in raw)) for x in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(plate, "UTF-8")), 256))), 256)
    return F.when(F.length(plate) > 0, F.concat(F.lit("PLATE-"), F.upper(F.substring(digest, 1, 10))))


def violation_moment(recorded_at: Column, start_ms: Column) -> Column:
    """recorded_at and the whole seconds of start_ms, halves to even."""
    return recorded_at + F.make_interval(secs=F.bround(start_ms / 1000.0).cast("decimal(18,6)"))


def fps_or_default(fps: Column) -> Column:
    return F.when(fps != 0, fps).otherwise(30.0)
