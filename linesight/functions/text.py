"""Column-level text functions (all JVM-side expressions, no Python UDFs).

Regex notes (Java regex vs. the Python ``re`` module the studied scripts used):
* ``(?U)`` makes ``\\s``, ``\\w``, ``\\b``, ``\\d`` Unicode-aware as in Python 3.
* ``(?d)`` (UNIX lines) makes ``.``, ``^`` and ``$`` stop only at ``\\n``.
* A ``$`` in a replacement string must be escaped (``\\$``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the studied scripts' formats.
LINE_SEP = "\n"            # documents are split on newline only
LIST_SEP = "/~/"           # encoded list of flawed lines
INT_SEP = ","              # encoded list of flawed line indices
PREFIX_LEN = 150           # ground-truth prefix blocking length
PREVIEW_WIDTH = 200        # preview cut
PREVIEW_MARK = "... [truncated]"
BLANK = r"[\s\x1c-\x1f]"     # with (?U): what Python's str.split() and strip() take as white space


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_lines(text) -> Column:
    """``text.split('\\n')``: keeps empty and trailing pieces; ``""`` -> ``[""]``."""
    return F.split(_c(text), LINE_SEP, -1)


def decode_line_list(col) -> Column:
    """``/~/``-joined lines -> newline-joined text."""
    return F.replace(_c(col), F.lit(LIST_SEP), F.lit(LINE_SEP))


def split_line_list(col) -> Column:
    """``/~/``-joined lines -> array of lines (null stays null)."""
    return F.split(_c(col), "/~/", -1)


def parse_int_list(col) -> Column:
    """null or ``""`` -> empty array; else comma separated ints (bad items -> null)."""
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<int>")).otherwise(
        F.transform(F.split(c, INT_SEP, -1), lambda x: F.trim(x).try_cast("int")))


def encode_lines(arr) -> Column:
    return F.array_join(_c(arr), LIST_SEP)


def encode_ints(arr) -> Column:
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), INT_SEP)


def normalize_whitespace(col) -> Column:
    """Delete all (Unicode) whitespace; null -> ``""``."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), rf"(?U){BLANK}+", "")


def text_prefix(col, n: int = PREFIX_LEN) -> Column:
    return F.substring(_c(col), 1, n)


def starts_with_either(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.startswith(a, b) | F.startswith(b, a)


def word_tokens(col) -> Column:
    """Whitespace tokens without empty strings (``str.split()``)."""
    return F.filter(word_pieces(col), lambda t: t != "")


def word_pieces(col) -> Column:
    """The tokens with the empty strings before and after them, for steps that skip these."""
    return F.split(_c(col), rf"(?U){BLANK}+", -1)


def mask_literals(col, strings: bool = True, numericals: bool = True) -> Column:
    """(Fixed patterns and replacements.)  Replace string literals by ``"STR$ID"`` and integers by ``NUM%ID``."""
    c = _c(col)
    if strings:
        c = F.regexp_replace(c, r"(?d)(\"[^\"]*\"|'.*?')", '"STR\\$ID"')
    if numericals:
        c = F.regexp_replace(c, r"(?U)\b\d+\b", "NUM%ID")
    return c


def strip_includes(col) -> Column:
    """Without #include lines (fixed pattern)."""
    return F.regexp_replace(_c(col), r"(?md)^\s*#include\s+.+?(\n|$)", "")


def strip_comments(col) -> Column:
    """Without line and block comments (fixed patterns)."""
    c = F.regexp_replace(_c(col), r"(?d)//.*", "")
    return F.regexp_replace(c, r"/\*[\s\S]*?\*/", "")


def lower_text(col) -> Column:
    return F.lower(_c(col))


def strip_blank_lines(col) -> Column:
    """Without blank lines (fixed pattern)."""
    return F.regexp_replace(_c(col), r"(?md)^\s*\n", "")


def strip_lines(arr) -> Column:
    """Trim every line (Unicode whitespace) and drop blanks."""
    trimmed = F.transform(_c(arr), lambda x: F.regexp_replace(x, rf"(?U)^{BLANK}+|{BLANK}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def same_prefix(a, b) -> Column:
    """Equality up to the shorter length after removing ``\\r`` and stripping."""
    def norm(c):
        return F.regexp_replace(F.replace(_c(c), F.lit("\r"), F.lit("")), rf"(?U)^{BLANK}+|{BLANK}+$", "")
    na, nb = norm(a), norm(b)
    n = F.least(F.length(na), F.length(nb))
    return F.left(na, n) == F.left(nb, n)


def preview_text(col, width: int = PREVIEW_WIDTH) -> Column:
    c = _c(col)
    return F.when(F.length(c) > width,
                  F.concat(F.substring(c, 1, width), F.lit(PREVIEW_MARK))).otherwise(c)


def metadata_json(col) -> Column:
    """Nested struct -> JSON text, null -> ``""``."""
    return F.coalesce(F.to_json(_c(col)), F.lit(""))
