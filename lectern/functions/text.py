"""Text cleaning expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from .base import WHITESPACE, col, strip


def _accent_table() -> tuple[str, str]:
    """Every letter that decomposes into an ASCII letter or digit plus combining marks."""
    source, target = [], []
    for code in range(0x80, 0x2200):
        char = chr(code)
        base, *marks = unicodedata.normalize("NFD", char)
        if base != char and base.isascii() and base.isalnum() and all(0x300 <= ord(m) <= 0x36F for m in marks):
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Drop diacritics of Latin letters, precomposed or combining."""
    return F.regexp_replace(F.translate(col(c), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def sanitize(c: Column | str) -> Column:
    """Remove NUL characters."""
    return F.regexp_replace(col(c), "\\x00", "")


def strip_blank_lines(c: Column | str) -> Column:
    """Trim each line and drop the blank ones."""
    lines = F.transform(F.split(col(c), "\n"), lambda line: F.btrim(line, F.lit(WHITESPACE)))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def normalize_input(c: Column | str) -> Column:
    """Lower case, no accents, only ``[a-z0-9_-]`` words separated by single blanks."""
    plain = strip_accents(F.lower(col(c)))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9_-]+", " "))


# Code point ranges treated as emoji or symbols when a text is read aloud.
SPOKEN_SYMBOLS = (
    "[\\u2700-\\u27BF\\uE000-\\uF8FF\\x{1F000}-\\x{1F7FF}\\u2011-\\u26FF\\x{1F900}-\\x{1FBFF}]"
)
# A digit that has another digit after it, inside a free-standing run of four or more digits.
_LONG_NUMBER_DIGIT = (
    "(?:\\G(?!^)|(?<![A-Za-z0-9_])(?=[0-9]{4,}(?![A-Za-z0-9_])))([0-9])(?=[0-9])"
)


def plain_text(c: Column | str) -> Column:
    """Markdown and emoji removed, long numbers spelled digit by digit, paragraphs as sentences."""
    # What is taken away or replaced, in this order.
    steps = [
        (SPOKEN_SYMBOLS, ""),
        ("(?s)```.*?```", ""),
        ("`[^`]*`", ""),
        ("[*_~#>]", ""),
        ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
        (_LONG_NUMBER_DIGIT, "$1 "),
        ("\\n{2,}", ". "),
    ]
    out = col(c)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


# How answers write quiz options, the title of references and references run together on one line.
_OPTION = "(?m)(?:^|\\s)(?:\\*\\*)?([A-D])\\)(?:\\*\\*)?(?=\\s)"
_REFERENCE_TITLE = (
    "(?isu)^(.*?)(?:\\*\\*Refer[êe]ncias:?\\*\\*|Refer[êe]ncias:?)\\s*(?:•|-|\\*)?\\s*"
)
_RUN_ON_REFERENCE = "(?iu)(\\n- [^\\n]+)\\s+(?:•|-|\\*)\\s*(Refer[êe]ncia:)"


def normalize_answer_layout(c: Column | str) -> Column:
    """Quiz options on bold lines of their own when A-D are all there; references as a list."""
    text = col(c)
    labels = F.regexp_extract_all(text, F.lit(_OPTION), F.lit(1))
    complete = F.size(F.array_intersect(labels, F.array(*[F.lit(x) for x in "ABCD"]))) == 4
    text = F.when(complete, F.regexp_replace(text, _OPTION, "\n\n**$1)**")).otherwise(text)
    listed = F.regexp_replace(text, _REFERENCE_TITLE, "$1**Referências:**\n\n- ")
    listed = F.regexp_replace(listed, _RUN_ON_REFERENCE, "$1\n- $2")
    return F.when(F.rlike(text, F.lit("(?iu)refer[êe]ncias:")), listed).otherwise(text)
