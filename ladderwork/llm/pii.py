"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the source text. Then transducers rewrite a copy of it (homoglyphs, spelled digits,
disguised at and dot signs); every output character keeps the source span it came from, so identifiers that are found
only in the rewritten text map back to source characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name
from .words import release_memory

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can begin only where no digit stands before it (else its first part would have begun earlier and failed alike).
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones, and the Latin letter.
_GLYPHS = dict(zip("аАеЕоОрРсСхХуУіІѕЅјЈԁɡһВМНКТαΑεΕοΟρΡνΝιΙκΚτΤχΧυΒΖΗΜΥ", "aAeEoOpPcCxXyYiIsSjJdghBMHKTaAeEoOpPvNiIkKtTxXuBZHMY"))
_GLYPHS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
_GLYPHS |= {chr(base + k): str(k) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_GLYPH = re.compile("[" + re.escape("".join(_GLYPHS)) + "]")
#: Digits as words in English, German, French and Spanish.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: Runs of at least four spelled digits, with single marks between; "plus" may lead and "dot" may stand between.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+)?(?:{_DIGIT_WORD}|[0-9]+)(?:[ ,.-]{{1,2}}(?:dot[ -])?(?:{_DIGIT_WORD}|[0-9]+)){{3,}}(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(plus)|(dot)|({_DIGIT_WORD})(?!\w)|([0-9]+)|([ ,.-]+)")
_STRONG_AT = r"(?:\s?[(\[{<]\s?(?:at|@|arroba|ät)\s?[)\]}>]\s?|@)"
_WEAK_AT = r"\s(?:at|AT|arroba)\s"
_HIDDEN_DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.|punkt|point|punto)\s?[)\]}>]\s?|\s(?:dot|DOT|punkt|punto)\s)"
_DOT = rf"(?:{_HIDDEN_DOT}|\.)"
#: A disguised address: a bracketed at sign or @ with any dots after it, or a plain word "at" with a disguised dot after it.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_HIDDEN_DOT}[A-Za-z0-9._%+-]+)*"
    rf"(?:{_STRONG_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+|{_WEAK_AT}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_HIDDEN_DOT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*)"
)
_SIGN = re.compile(rf"({_STRONG_AT}|{_WEAK_AT})|({_DOT})")
#: Cheap tests that hold wherever the patterns above match.
_BRACKETED_AT = re.compile(r"[(\[{<]\s?(?:at|@|arroba|ät)\s?[)\]}>]")
_HIDDEN = re.compile(rf"(?:{_WEAK_AT}|@)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_HIDDEN_DOT}")


def _branches(words: list[str]) -> str:
    """A pattern for the words that tests each first letter once."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in first.items())


_TWO_SPELLED = re.compile(rf"[ ,.\n\t(-](?:{_branches(list(_DIGITS))})[ ,.-]{{1,2}}(?:dot[ -])?(?:{_branches(list(_DIGITS))}|[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from its at signs, in time linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of base identifiers, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if text.count(".") > 2:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Tape:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def span(self, s: int, e: int) -> tuple[int, int]:
        """Source span of the rewritten characters from s to e (e > s)."""
        return (s, e) if self.start is None else (self.start[s], self.end[e - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint spans, in order. Each new character stands for the whole span it replaces."""
        if not edits:
            return
        old_start = self.start or range(len(self.text))
        old_end = self.end or range(1, len(self.text) + 1)
        text, start, end, at = [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            start.extend(old_start[at:s])
            end.extend(old_end[at:s])
            start.extend([old_start[s]] * len(new))
            end.extend([old_end[e - 1]] * len(new))
            at = e
        text.append(self.text[at:])
        start.extend(old_start[at:])
        end.extend(old_end[at:])
        self.text, self.start, self.end = "".join(text), start, end


def _spelled(match: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into digits; only runs with a digit word are touched."""
    edits, words, last = [], 0, ""
    for m in _SPELLED_PART.finditer(match[0]):
        s, e = match.start() + m.start(), match.start() + m.end()
        plus, dot, word, digits, mark = m.groups()
        if plus:
            edits.append((s, e, "+"))
        elif dot:
            edits.append((s, e, "."))
        elif word:
            words += 1
            edits.append((s, e, _DIGITS[word.lower()]))
        elif mark and not (mark == "." or mark.strip() == "." and last != "dot"):
            edits.append((s, e, ""))
        last = "dot" if dot else ""
    return edits if words >= 4 else []


def _is_latin(text: str) -> bool:
    """No character is above U+00FF, where all look-alikes are."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None where no transducer has anything to do."""
    tape = Tape(text)
    if not _is_latin(text):
        tape.rewrite([(*m.span(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(text)])
    if _TWO_SPELLED.search(" " + tape.text.lower()):
        tape.rewrite([edit for m in _SPELLED.finditer(tape.text) for edit in _spelled(m)])
    if _BRACKETED_AT.search(tape.text) or _HIDDEN.search(tape.text):
        edits = []
        for m in _DISGUISED.finditer(tape.text):
            for sign in _SIGN.finditer(m[0]):
                new = "@" if sign[1] else "."
                if sign[0] != new:
                    edits.append((m.start() + sign.start(), m.start() + sign.end(), new))
        tape.rewrite(edits)
    return None if tape.start is None else tape


def all_identifiers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added): added ones overlap no base or other added span of their kind."""
    base = identifiers(text)
    tape = deobfuscate(text)
    added: list[tuple[int, int, int]] = []
    if tape is not None:
        # Spans of a kind that are taken, in order; none overlaps another, so only its neighbours can overlap a new one.
        taken = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]
        for kind, s, e in identifiers(tape.text):
            s, e = tape.span(s, e)
            own = taken[kind]
            at = bisect_left(own, (s, e))
            if (at == 0 or own[at - 1][1] <= s) and (at == len(own) or e <= own[at][0]):
                added.append((kind, s, e))
                own.insert(at, (s, e))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes <KIND>; overlapping ones become one, named by the first."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
FOUND = T.StructType().add("base", _SPAN).add("added", _SPAN).add("spans", "string").add("base_spans", "string").add("redacted", "string")


@F.arrow_udf(FOUND)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    made = pa.struct([("base", pa.list_(kind)), ("added", pa.list_(kind)), ("spans", pa.string()), ("base_spans", pa.string()), ("redacted", pa.string())])
    for column in batches:
        rows = []
        for text in column.to_pylist():
            base, added = all_identifiers(text or "")
            name = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]
            rows.append({"base": name(base), "added": name(added), "spans": _joined(base + added), "base_spans": _joined(base), "redacted": redact(text, base + added) if base or added else text})
        yield pa.array(rows, made)
        rows.clear()
        release_memory()


def personal_data(docs: DataFrame) -> DataFrame:
    """docs with `pii`: base and added identifiers (kind, start, end in code points), their digests and the redacted text.

    Null texts have no identifiers and stay null; empty and very long texts are whole; repeated rows get equal results; an
    existing column named pii is replaced. Spans of one kind never overlap; those of different kinds may.
    """
    return docs.withColumn("pii", _scan("text"))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op10: n_* count base identifiers, n_added those that only deobfuscation shows."""
    count = lambda kind: F.size(F.filter("pii.base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return personal_data(docs.select("doc_id", "text")).select(
        "doc_id", *map(count, KINDS), F.sha2("pii.base_spans", 256).alias("base_sha256"), "pii.spans", F.size("pii.added").cast("bigint").alias("n_added")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every identifier replaced by its kind; n_chars follows the new text where docs has it.

    All other columns are kept as they are, one named pii too. Null texts stay null; a very long text is one cell in one task;
    repeated rows get equal texts; an empty table gives no rows."""
    name = free_name(docs, "found")
    out = docs.withColumn(name, _scan("text")).withColumn("text", F.col(f"{name}.redacted"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))
    return out.select(*docs.columns)
