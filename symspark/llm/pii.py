"""Personal data with offset-preserving deobfuscation.

Two passes over each text. The base pass finds plain identifiers. The second passes the text through a
transducer that rewrites homoglyphs, spelled digits and at/dot disguises and keeps an alignment of
output to source pieces, detects identifiers in the rewritten text and maps each span back to source
characters. Base spans stay; a mapped span is added unless it is a base span of the same kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ (an address has one, so neither part can cross another)."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _number(part: str) -> int:
    """The value of a part of an address, at most 256 (a long part needs no conversion)."""
    part = part.lstrip("0")
    return 256 if len(part) > 3 else int(part or 0)


def find_base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain identifiers, ends exclusive, by start and then by kind as listed in KINDS."""
    spans = [(a, b, "email") for a, b in find_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if max(map(_number, m[0].split("."))) <= 255]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    if len(spans) > 1:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


# Characters that look like an ASCII letter or digit (Cyrillic, Greek), in alphabetical order of what they look like.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ο": "o", "о": "o", "р": "p", "ѕ": "s", "υ": "u", "ν": "v", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
}
#: Full-width forms of ! to ~ are ASCII shifted by a constant; other decimal digits by their zero.
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, *range(0x1D7CE, 0x1D800, 10)) for d in range(10)}
HOMOGLYPHS |= {c: "." for c in "․。｡"} | {"﹫": "@", "‐": "-", "‑": "-", "–": "-", " ": " "}
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_GLYPHS = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "​‌‍⁠﻿­]")
_SPELLED = "|".join(DIGIT_WORDS)
# Top-level domains after which a bare "at" before a plain host name is taken for an address.
_TLD = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu"
_TELL_MARK = re.compile(r"[\[({<] *(?:[aA][tT]|[dD][oO][tT]|@|\.) *[\])}>]")
_TELL_AT = re.compile(r" at +[a-z0-9-]+(?: +dot +[a-z0-9]|(?:\.[a-z0-9-]+)*\.(?:" + _TLD + r")\b)")
_TELL_SPACE = re.compile(r"[A-Za-z0-9] @|@ [A-Za-z0-9]")
_LONGER = tuple(w for w in DIGIT_WORDS if w != "one")
_TELL_WORD = re.compile(r"(?:" + "|".join(_LONGER) + r")[ .,-]{1,3}(?:" + _SPELLED + r"|[0-9])|(?:" + _SPELLED + r"|[0-9])[ .,-]{1,3}(?:" + "|".join(_LONGER) + r")")
_TELL_ONES = re.compile(r"one[ .,-]{1,3}(?:one|[0-9])|[0-9][ .,-]{1,3}one")
_MARK = re.compile(r"(?i)(?<! ) *[\[({<] *(?P<in>at|dot|@|\.) *[\])}>] *")
_BARE_AT = re.compile(r"(?i)(?<=[A-Za-z0-9_%+-]) +(?:at +(?=[A-Za-z0-9-]+(?: +dot +[A-Za-z0-9]|(?:\.[A-Za-z0-9-]+)*\.(?:" + _TLD + r")\b))|@ *(?=[A-Za-z0-9-]+(?: +dot +|\.)[A-Za-z0-9]))|(?<=[A-Za-z0-9_%+-])@ +(?=[A-Za-z0-9-]+(?: +dot +|\.)[A-Za-z])")
_BARE_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9]) +dot +(?=[A-Za-z0-9])")
_RUN = re.compile(r"(?i)\b(?:plus +)?(?:" + _SPELLED + r"|[0-9]+)(?:[ .,-]{1,3}(?:" + _SPELLED + r"|[0-9]+)\b)*")
_WORD = re.compile(r"(?i)plus +|" + _SPELLED + r"|[0-9]+|[ .,-]+")


class Tape:
    """A text with its alignment: output piece k starts at out[k] and came from source [src[k], end[k]).

    A piece is copied character by character or, where `same` is false, rewritten as a whole.
    """

    def __init__(self, text: str):
        self.text, self.out, self.src, self.end, self.same = text, [0], [0], [len(text)], [True]

    def source(self, at: int, last: bool) -> int:
        """The source offset of output character `at`: its start, or (last) the end of it."""
        k = bisect_right(self.out, at) - 1
        if self.same[k]:
            return self.src[k] + at - self.out[k] + last
        return self.end[k] if last else self.src[k]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace [start, end) by the given text, for sorted, disjoint edits of the present text."""
        if not edits:
            return self
        made = Tape("")
        made.out, made.src, made.end, made.same = [], [], [], []
        parts: list[str] = []
        size = at = 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            k = bisect_right(self.out, a) - 1
            while a < b:
                stop = min(b, self.out[k + 1] if k + 1 < len(self.out) else len(self.text))
                if stop > a:
                    made.out.append(size)
                    made.src.append(self.src[k] + (a - self.out[k] if self.same[k] else 0))
                    made.end.append(self.src[k] + stop - self.out[k] if self.same[k] else self.end[k])
                    made.same.append(self.same[k])
                    parts.append(self.text[a:stop])
                    size += stop - a
                a, k = stop, k + 1

        for a, b, new in edits:
            copy(at, a)
            if new:
                made.out.append(size)
                made.src.append(self.source(a, False))
                made.end.append(self.source(b - 1, True))
                made.same.append(False)
                parts.append(new)
                size += len(new)
            at = b
        copy(at, len(self.text))
        made.text = "".join(parts)
        if not made.out:
            made.out, made.src, made.end, made.same = [0], [0], [0], [True]
        return made


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write spelled digits beside others or figures in figures: separators without a dot beside a spelled one go."""
    edits = []
    for m in _RUN.finditer(text):
        tokens = [(t.start(), t.end(), t[0]) for t in _WORD.finditer(text, m.start(), m.end())]
        spelled = [t[2].lower() in DIGIT_WORDS for t in tokens]
        if not any(spelled) or sum(spelled) + sum(t[2][0].isdigit() for t in tokens) < 2:
            continue
        for k, (a, b, word) in enumerate(tokens):
            low = word.lower()
            if low in DIGIT_WORDS:
                edits.append((a, b, DIGIT_WORDS[low]))
            elif low.startswith("plus"):
                edits.append((a, b, "+"))
            elif not word[0].isdigit() and 0 < k < len(tokens) - 1 and (spelled[k - 1] or spelled[k + 1]) and "." not in word:
                edits.append((a, b, ""))
    return edits


def _disguised(text: str) -> bool:
    """Whether the text shows any at/dot disguise or digit words that could be part of an identifier (no false negatives)."""
    low = text.lower()
    if _TELL_MARK.search(text) or " dot " in low or (" at " in low and _TELL_AT.search(low)) or ("@" in text and _TELL_SPACE.search(text)):
        return True
    return any(w in low for w in _LONGER) and _TELL_WORD.search(low) is not None or "one" in low and _TELL_ONES.search(low) is not None


def _may_have_glyphs(text: str) -> bool:
    """False for most Latin-1 texts: of that range only the no-break space and the soft hyphen are rewritten."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xa0" in text or "\xad" in text


def normalise(text: str) -> Tape | None:
    """The text rewritten, or None where there is nothing to rewrite."""
    glyphs = not text.isascii() and _may_have_glyphs(text) and _GLYPHS.search(text) is not None
    if not glyphs and not _disguised(text):
        return None
    tape = Tape(text)
    if glyphs:
        tape = tape.rewrite([(m.start(), m.end(), HOMOGLYPHS.get(m[0], "")) for m in _GLYPHS.finditer(text)])
    tape = tape.rewrite([(m.start(), m.end(), "@" if m["in"].lower() in ("at", "@") else ".") for m in _MARK.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), "@") for m in _BARE_AT.finditer(tape.text)])
    tape = tape.rewrite([(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(tape.text)])
    return tape.rewrite(_digits(tape.text))


def find_disguised(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in source characters of identifiers that only the rewritten text shows whole; they may overlap base spans."""
    tape = normalise(text)
    if tape is None or tape.text == text:
        return []
    taken = set(base)
    mapped = [(tape.source(a, False), tape.source(b - 1, True), kind) for a, b, kind in find_base(tape.text)]
    return [span for span in mapped if span not in taken]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        base_of, all_of = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = find_base(text)
            found = base + find_disguised(text, base)
            if len(found) > len(base):
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            for kind in KINDS:
                counts[kind].append(sum(s[2] == kind for s in base) if base else 0)
            base_of.append(hashlib.sha256(digest(base).encode()).hexdigest() if base else empty)
            all_of.append(digest(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], type=pa.int64()) for k in KINDS), pa.array(base_of), pa.array(all_of)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, and all spans as kind:start:end.

    Disguises known: look-alike and full-width characters, digits of other scripts, invisible characters, English digit
    words, and at/dot in brackets, in words or set apart by blanks. A bare word `at` before a host name without a
    spelled dot counts only before the top-level domains listed in _TLD, as prose is full of that word.

    Null and empty texts have no spans; rows with a null or repeated doc_id are kept as they are; other
    columns are ignored. Offsets are code points, ends exclusive. One pass without a shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every span, plain or disguised, replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    base = find_base(text)
    out, at = [], 0
    for a, b, kind in sorted(base + find_disguised(text, base)):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], mark.format(kind)]
        at = b
    return "".join(out) + text[at:]
