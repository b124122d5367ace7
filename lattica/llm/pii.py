"""Personal data behind disguises, found and masked at the source's own characters.

Two finite-state transducers rewrite a text and remember where each of their output characters comes from:
``fold`` turns look-alike letters and foreign digits into ASCII and drops invisible characters; ``spoken`` turns
spelled digits ("plus four nine", "five five five dash one") and written-out signs ("[at]", "(dot)", "_at_", " at ...
dot com") into the characters they stand for.  A plain "at" counts only before a top-level domain, and not after words
that come before the preposition ("look at example.com").  Identifiers are detected in the rewritten text; their spans are then mapped back through both
edits to the characters of the source.
"""

from __future__ import annotations

import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .domains import BEFORE_AT, NO_LABEL, TOP_LEVEL
from .shared import release

SCHEMA = "doc_id bigint, kind string, start int, end int, source string, value string"

_LOOKALIKE = {
    **dict(zip("аАВсСеЕһНіІјЈкКмМоОрРѕЅтТуУхХԁԛԝѵӏ", "aABcCeEhHiIjJkKmMoOpPsStTyYxXdqwvl", strict=True)),
    **dict(zip("αΑΒΕεΖΗΙιΚκΜΝνΟοΡρΤτΥυΧχ", "aABEeZHIiKkMNvOoPpTtYuXx", strict=True)),
    **dict(zip("օսոցһաɡɑıꞌ‐‑‒–—−․·∙", "ounghwgai'------...", strict=True)),
}
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
_SIGNS = set("@.-+()_ %")


def _table() -> dict[str, str]:
    table = dict.fromkeys(_INVISIBLE, "")
    for point in range(128, sys.maxunicode + 1):
        c = chr(point)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category == "Nd":
            table[c] = str(unicodedata.digit(c))
            continue
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in _SIGNS):
            table[c] = plain
    return table | _LOOKALIKE


FOLD = _table()

_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3}
_SPELLED = r"(?:(?:double|triple)[\s-])?(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SAID = rf"(?:{_SPELLED}|[0-9])(?!\w)"
_DASH = r"(?:dash|hyphen|minus|strich|bindestrich|tiret|trait|guion|guión|raya)"
_BETWEEN = rf"\s*+(?:(?:[,.()/-]|{_DASH}(?!\w))\s*+)?"
#: Four digits at least that stand alone, spelled or as figures; signs may be said between them, and a plus before.
_SPOKEN_RUN = re.compile(rf"(?<!\w)(?:plus\s++)?{_SAID}(?:{_BETWEEN}{_SAID}){{3,}}+", re.I)
_ONE_SAID = re.compile(rf"(?<!\w)(?:({_SAID})|(plus)(?!\w)|({_DASH})(?!\w))", re.I)

_AT_WORD, _DOT_WORD = r"(?:at|ät|arroba|arobase|klammeraffe)", r"(?:dot|punkt|punto|point|pt)"
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
_AT = re.compile(rf"({_OPEN}(?:{_AT_WORD}|chez|@){_CLOSE})|(?<=[^\W_])([_-]){_AT_WORD}\2(?=[^\W_])|(?<!\w)({_AT_WORD})(?!\w)|@", re.I)
_DOT = re.compile(rf"(\.)(?=[^\W_])|\s*+{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s*+|\s++({_DOT_WORD})\s++|([_-]){_DOT_WORD}\3", re.I)
#: A part of a domain; DNS allows 63 characters.  A hyphen may belong to a "-dot-" after it.
_LABEL = re.compile(rf"[^\W_](?:[^\W_]|-(?!{_DOT_WORD}-)){{0,62}}", re.I)
_ENDING = re.compile(r"[a-z]{2,24}", re.I)
_ONLY_AT = re.compile(_AT_WORD, re.I)
#: The same read backwards: the local part, 64 characters at most, stands before its sign.
_LOCAL = re.compile(r"[\w%+.-]{1,64}")
_DOT_BACK = re.compile(rf"\s*+[\])}}>]\s*+(?:{'|'.join(w[::-1] for w in _DOT_WORD[3:-1].split('|'))}|\.)\s*+[\[({{<]\s*+|\s++(?:{'|'.join(w[::-1] for w in _DOT_WORD[3:-1].split('|'))})\s++", re.I)
_LOOK_BACK, _LABELS = 400, 127  # characters of a disguised local part; parts of a domain, by DNS

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])")
_CARD = re.compile(r"(?<![\w.])[2-6][0-9]{3}(?:[ -]?[0-9]){9,15}(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(
    r"(?<![\w.])(?:\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})){2,6}|(?:1[ .-])?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|00[1-9][0-9]{8,13}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?!\w)"
)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_DIGIT = re.compile(r"[0-9]")


def _ranges(points: list[int]) -> str:
    out, at = [], 0
    for k in range(1, len(points) + 1):
        if k == len(points) or points[k] != points[k - 1] + 1:
            out.append(rf"\x{{{points[at]:x}}}-\x{{{points[k - 1]:x}}}")
            at = k
    return "".join(out)


#: For RE2, over a whole batch at once: a text without any of this has no identifier.
_RARE = "(?:un|oh|null)"  # digits that are common words count only where two come together
_MAY_HOLD = (
    rf"[0-9@]|:[a-f]{{0,4}}:|[\s_-]{_DOT_WORD}[\s_-]|[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]|(?:^|[^a-z])(?:{_AT_WORD}|chez)[\s_\])}}>-]+[a-z0-9-]+\.[a-z0-9]"
    + r"|(?:^|[^a-z\x{df}-\x{ff}])(?:" + "|".join(sorted(set(_DIGITS) - {"un", "oh", "null"})) + rf")(?:[^a-z\x{{df}}-\x{{ff}}]|$)|\b{_RARE}\W+(?:{_DASH}\W+)?{_RARE}\b"
)
_MAY_FOLD = "[" + _ranges(sorted(ord(c) for c in FOLD)) + "]"


def may_hold(texts: pa.Array) -> list[bool]:
    texts = texts.cast(pa.large_string())
    return pc.fill_null(pc.or_(pc.match_substring_regex(texts, _MAY_HOLD, ignore_case=True), pc.match_substring_regex(texts, _MAY_FOLD)), False).to_pylist()


class Edited:
    """A text after an edit: ``text``, and where in the text before it each character begins and ends."""

    def __init__(self, before: str, edits: list[tuple[int, int, str]]):
        parts, at, out = [], 0, 0
        self.edits: list[tuple[int, int, int, int]] = []
        for start, end, put in edits:
            parts += [before[at:start], put]
            out += start - at
            self.edits.append((out, out + len(put), start, end))
            out += len(put)
            at = end
        parts.append(before[at:])
        self.text = "".join(parts)
        self.starts = [e[0] for e in self.edits]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the old text behind a non-empty span of the new one."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        start, end, old_start, old_end = self.edits[k]
        if start <= i < end:
            return old_start, old_end
        return old_end + i - end, old_end + i - end + 1


def fold(text: str) -> Edited | None:
    """Look-alikes and foreign digits to ASCII, invisible characters to nothing; None if there are none."""
    if text.isascii() or not (held := FOLD.keys() & set(text)):
        return None
    edits = [(m.start(), m.end(), FOLD[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, sorted(held))) + "]", text)]
    return Edited(text, edits)


def _said(text: str, edits: list[tuple[int, int, str]]) -> None:
    """Spelled digits, with what is said between them."""
    for run in _SPOKEN_RUN.finditer(text):
        said = list(_ONE_SAID.finditer(text, run.start(), run.end()))
        if sum(m[1] is not None and not m[1].isdigit() for m in said) < 2:
            continue
        end = None
        for m in said:
            if end is not None and not text[end : m.start()].strip(" \t\r\n\f\v,"):
                if end < m.start():
                    edits.append((end, m.start(), ""))
            if m[1] is None:
                edits.append((m.start(), m.end(), "+" if m[2] else "-"))
            else:
                times, _, word = re.sub(r"[\s-]", " ", m[1].lower()).rpartition(" ")
                edits.append((m.start(), m.end(), _DIGITS.get(word, word) * _TIMES.get(times, 1)))
            end = m.end()


def _signs(text: str, edits: list[tuple[int, int, str]]) -> None:
    """The signs of addresses: each at-sign, word or bracket is looked at from both sides, by bounded parts."""
    done = 0
    for m in _AT.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        plain_word, joined = m[3] is not None, m[2] is not None
        if not joined:
            while start > done and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
        if plain_word and (start == m.start() or end == m.end()):
            continue
        back = text[max(done, start - _LOOK_BACK) : start][::-1]
        local = _LOCAL.match(back)
        if not local or not (first := _LABEL.match(text, end)) or plain_word and first[0].lower() in NO_LABEL:
            continue
        own = [(start, end, "@")] if text[start:end] != "@" else []
        name = local
        while (dot := _DOT_BACK.match(back, name.end())) and (more := _LOCAL.match(back, dot.end())):
            own.append((start - dot.end(), start - dot.start(), "."))
            name = more
        if plain_word and name is local and local[0][::-1].lower() in BEFORE_AT:
            continue
        at, seps, best = first.end(), [], None
        while len(seps) < _LABELS and (dot := _DOT.match(text, at)) and (label := _LABEL.match(text, dot.end())):
            if _ONLY_AT.fullmatch(label[0]) and label[0].lower() != "at":
                break
            seps.append((dot.start(), dot.end(), "."))
            at = label.end()
            spelled = plain_word or joined or dot[2] is not None or dot[3] is not None
            if label[0].lower() in TOP_LEVEL if spelled else _ENDING.fullmatch(label[0]):
                best = (at, len(seps))
        if not best or best[0] < len(text) and (text[best[0]] in "@_" or plain_word and text[best[0]] == "/"):
            continue
        own += [e for e in seps[: best[1]] if text[e[0] : e[1]] != "."]
        edits += own
        done = best[0]


def spoken(text: str) -> Edited | None:
    """Spelled digits and signs to the characters they stand for; None if there are none."""
    edits: list[tuple[int, int, str]] = []
    _said(text, edits)
    _signs(text, edits)
    if not edits:
        return None
    edits.sort()
    apart = edits[:1]
    for e in edits[1:]:
        if e[0] >= apart[-1][1]:
            apart.append(e)
    return Edited(text, apart)


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ipv6(value: str) -> bool:
    """Three groups at least, so that no scope of a program ("a::b") counts."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(map(bool, value.split(":"))) >= 3


def _card(value: str) -> bool:
    digits = re.sub("[ -]", "", value)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _ends(pattern: re.Pattern, text: str, m: re.Match, limit: int) -> Iterator[int]:
    """Where a match may end, the longest first: its own end, then those between its groups, none beyond ``limit``."""
    if m.end() <= limit:
        yield m.end()
    for e in range(min(m.end() - 1, limit), m.start(), -1):
        if text[e] in " .-(" and text[e - 1] not in " .-(" and pattern.fullmatch(text, m.start(), e):
            yield e


def detect(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of identifiers in a plain text; they don't overlap, and stronger kinds come first."""
    found: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str, holds=lambda value: True) -> None:
        """The longest end of each match that holds and overlaps nothing; without one, the search goes on inside the match."""
        at = 0
        while m := pattern.search(text, at):
            start = m.start()
            k = bisect_right(found, (start, len(text) + 1))
            if k and start < found[k - 1][1]:
                at = found[k - 1][1]
                continue
            limit = found[k][0] if k < len(found) else len(text)
            end = next((e for e in _ends(pattern, text, m, limit) if holds(text[start:e])), None)
            if end is None:
                at = start + 1
            else:
                found.insert(k, (start, end, kind))
                at = end

    if "@" in text:
        add(_EMAIL, "email")
    if ":" in text:
        add(_IPV6, "ip", _ipv6)
    if _DIGIT.search(text):
        add(_IPV4, "ip")
        add(_IBAN, "iban", _iban)
        add(_CARD, "card", _card)
        add(_SSN, "ssn")
        add(_PHONE, "phone", lambda value: 8 <= sum(c.isdigit() for c in value) <= 15)
    return iter(found)


_TEN = re.compile(r"(?<![\w.])(?:1?[2-9][0-9]{9}|0[1-9][0-9]{8,10})(?!\w)")


def find(text: str | None) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, source characters, normalised value) of every identifier, by start.

    Offsets count characters.  A run of ten digits counts as a phone number only where it was spelled out.
    """
    if not text:
        return []
    folded = fold(text)
    plain = folded.text if folded else text
    said = spoken(plain)
    final = said.text if said else plain
    spans = list(detect(final))
    if said:
        spelled = []
        for m in _TEN.finditer(final):
            k, n = bisect_left(said.starts, m.start()), bisect_left(spans, (m.start(), 0, ""))
            free = (n == 0 or spans[n - 1][1] <= m.start()) and (n == len(spans) or spans[n][0] >= m.end())
            if free and k < len(said.starts) and said.starts[k] < m.end():
                spelled.append((m.start(), m.end(), "phone"))
        spans = sorted(spans + spelled)
    out = []
    for start, end, kind in spans:
        value = final[start:end]
        if said:
            start, end = said.back(start, end)
        if folded:
            start, end = folded.back(start, end)
        out.append((kind, start, end, text[start:end], value))
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers in each document: ``doc_id, kind, start, end, source, value``.

    ``start`` and ``end`` are character offsets into the text as given, ``source`` its characters there and
    ``value`` the identifier without its disguise.  Kinds are email, phone, ip, card (Luhn), iban (mod 97), ssn.
    A null or empty text has none; a repeated row gives its findings again; a null id is kept.  Texts of any
    length are read whole; other columns are not read, so none can clash.  An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string()), ("value", pa.string())])

    def scan(batches):
        for batch in batches:
            hits = batch.filter(pa.array(may_hold(batch.column(1)), pa.bool_()))
            rows = [(i, *found) for i, text in zip(hits.column(0).to_pylist(), hits.column(1).to_pylist(), strict=True) for found in find(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def mask(text: str | None) -> str | None:
    """The text with ``<KIND>`` in place of each identifier."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end, _, _ in find(text):
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]]) if at else text


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with identifiers masked in its texts, and ``length_col``, where there is one, counted anew for those.

    The columns, their order and the number of rows stay the same; null and empty texts stay as they are.
    """

    flag = "__changed"
    while flag in docs.columns:
        flag += "_"
    schema = StructType([*docs.schema.fields, StructField(flag, BooleanType())])

    def masked(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            hits = [k for k, may in enumerate(may_hold(texts)) if may]
            old = [texts[k].as_py() for k in hits]
            new = [mask(t) for t in old]
            changed = np.zeros(len(texts), bool)
            changed[[k for k, a, b in zip(hits, old, new, strict=True) if a is not b]] = True
            changed = pa.array(changed)
            if any(a is not b for a, b in zip(old, new, strict=True)):
                texts = pc.replace_with_mask(texts, changed, pa.array([b for a, b in zip(old, new, strict=True) if a is not b], texts.type))
            yield batch.set_column(at, batch.schema.field(at), texts).append_column(flag, changed)
        release()

    rows = docs.mapInArrow(masked, schema)
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.when(F.col(flag), F.length(F.col(text_col)).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*docs.columns)
