"""JVM regular expressions that follow other engines' rules: white space, trims, sentinels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the two original languages take as white space, as parts of a Java character class.
PY_SPACE = r"\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JS_SPACE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def replace_all(col: Column, *rules: tuple[str, str]) -> Column:
    """The rules one after the other; replacements use Java's ``$1``."""
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def literal_all(col: Column, *rules: tuple[str, str]) -> Column:
    """Literal replacements one after the other."""
    for old, new in rules:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


#: The same classes as sets of characters.
_WIDE = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = {PY_SPACE: " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" + _WIDE, JS_SPACE: " \t\n\x0b\f\r" + _WIDE + "\ufeff"}


def strip(col: Column, space: str = PY_SPACE) -> Column:
    """Looks at the ends alone; a pattern for the end would be tried at every character."""
    return F.btrim(col, F.lit(SPACES[space]))


def matches_of(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def let(col: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A Column is an expression: naming it twice doubles its tree, and chains of that explode.
    """
    return F.element_at(F.transform(F.array(col), body), 1)


def rewrite_matches(col: Column, pattern: str, convert) -> Column:
    """Each match replaced by ``convert(match)``, a Column function: split, convert, zip, join."""
    pair = lambda p, m: F.concat(p, F.coalesce(convert(m), F.lit("")))
    return let(col, lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), matches_of(t, pattern), pair), ""))
