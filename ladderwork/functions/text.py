"""Text and step functions on columns. White space and digits are Unicode's, as (?U) asks for."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A step marker; a caller's own pattern takes its place.
STEP_MARKER = r"(?i)Step\s+\d+\s*:"
#: White space of (?U)\s. Trimming by a list of characters looks at the ends of a text only, a pattern at each of its places.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once however often then uses it. Neither may hold a Python function."""
    return F.transform(F.array(c), then).getItem(0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def normalize_whitespace(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_outer_punctuation(c: Column) -> Column:
    """Without trailing sentence marks and leading currency signs and colons."""
    # The two sets of characters.
    return F.ltrim(F.rtrim(c, F.lit(WHITE_SPACE + ".。!！?？,，;；:")), F.lit(WHITE_SPACE + "$￥£€:："))


@lru_cache(maxsize=1)
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that full case folding changes, to one character and to several, by the language's own table."""
    changed = {chr(k): chr(k).casefold() for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and chr(k).casefold() != chr(k)}
    return {a: b for a, b in changed.items() if len(b) == 1}, {a: b for a, b in changed.items() if len(b) > 1}


def fold_case(c: Column) -> Column:
    """Full case folding. Characters that fold to several are looked for first: few texts have any."""
    single, several = _foldings()

    def folded(text: Column) -> Column:
        ascii_only = ~text.rlike(r"[^\x00-\x7F]")
        one = F.translate(text, "".join(single), "".join(single.values()))
        # What a character folds to is folded already, so the order doesn't matter.
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several.items()])
        more = F.aggregate(pairs, one, lambda done, p: F.replace(done, p["a"], p["b"]))
        return F.when(ascii_only, F.lower(text)).when(text.rlike("[" + "".join(several) + "]"), more).otherwise(one)

    return bound(c, folded)


def canonicalize_text(c: Column) -> Column:
    """For comparing answers that are no numbers: white space, outer punctuation and case don't count."""
    return fold_case(strip_outer_punctuation(normalize_whitespace(c)))


def normalize_numeric(c: Column) -> Column:
    """A number's text with ASCII signs and without currency signs, group marks and spaces."""
    # All white space goes, so runs of it needn't be made one space first.
    return F.translate(strip_outer_punctuation(c), "−．／$￥£€,，" + WHITE_SPACE, "-./")


def normalize_block(c: Column) -> Column:
    """Line ends as \\n, stripped. Null stays null."""
    return strip(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def _stripped(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def split_on_markers(c: Column, marker: str = STEP_MARKER) -> Column:
    """Pieces from each marker on; none for fewer than two markers. Text before the first marker is dropped."""

    def body(text: Column) -> Column:
        rest = lambda pieces: F.when(text.rlike(f"^(?:{marker})"), pieces).otherwise(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
        marked = _stripped(bound(F.split(text, f"(?={marker})"), rest))
        return F.when(F.regexp_count(text, F.lit(marker)) >= 2, marked).otherwise(F.array().cast("array<string>"))

    return bound(c, body)


def split_on_lines(c: Column) -> Column:
    return _stripped(F.split(c, "\n"))


def truncate_step(c: Column, max_chars: int = 512) -> Column:
    """At most max_chars characters (0: all), stripped."""
    return strip(F.substring(strip(c), 1, max_chars)) if max_chars > 0 else strip(c)


def split_steps(c: Column, marker: str = STEP_MARKER, max_chars: int = 512, cut=None) -> Column:
    """Reasoning steps of a text: by markers, else by lines, else the text. `cut`, a function on columns of arrays of
    strings, may shorten the steps further (by tokens, say); null gives no steps."""

    def pieces(text: Column) -> Column:
        by_lines = bound(split_on_lines(text), lambda lines: F.when(F.size(lines) > 1, lines).otherwise(F.array(text)))
        return bound(split_on_markers(text, marker), lambda marked: F.when(F.size(marked) > 0, marked).otherwise(by_lines))

    steps = F.transform(bound(normalize_block(F.coalesce(c, F.lit(""))), pieces), lambda x: truncate_step(x, max_chars))
    steps = cut(steps) if cut else steps
    return F.filter(steps, lambda x: x != "")


def first_step(c: Column, **options) -> Column:
    return F.try_element_at(split_steps(c, **options), F.lit(1))


def join_steps(steps: Column) -> Column:
    return F.array_join(_stripped(steps), "\n")


def continuation_prompt(prompt: Column, prefix: Column) -> Column:
    """The prompt and what has been reasoned so far, each ended by a line end."""
    state = rstrip(F.coalesce(prefix, F.lit("")))
    return F.concat(rstrip(prompt), F.lit("\n"), F.when(state != "", F.concat(state, F.lit("\n"))).otherwise(""))


def merge_prediction(prefix: Column, continuation: Column) -> Column:
    left, right = rstrip(F.coalesce(prefix, F.lit(""))), strip(F.coalesce(continuation, F.lit("")))
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.lit("\n"), right))


def render_prompt(template: str, question: Column) -> Column:
    """The template with {question} filled in; {{ and }} stand for braces."""
    if "{question}" not in template:
        raise ValueError("the template must contain {question}")
    if re.search(r"\{(?!question\})", template.replace("{{", "").replace("}}", "")):
        raise ValueError("the template has another placeholder than {question}")
    hold = "\x00question\x00"
    plain = template.replace("{{", "\x00l").replace("}}", "\x00r").replace("{question}", hold).replace("\x00l", "{").replace("\x00r", "}")
    parts = plain.split(hold)
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        out += [question, F.lit(part)]
    return F.concat(*out)
