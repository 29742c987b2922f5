"""LaTeX repairs that regular expressions can express, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import JS_SPACE, PY_SPACE, let, literal_all, matches_of, replace_all, rewrite_matches

# Characters that XML text may not hold.
XML_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x84\x86-\x9F\uFDD0-\uFDEF\uFFFE\uFFFF]"

# Unicode mathematics and the commands that replace it.
SYMBOLS = {
    "≤": r"\le ", "≥": r"\ge ", "≠": r"\ne ", "±": r"\pm ", "×": r"\times ", "÷": r"\div ", "·": r"\cdot ",
    "∞": r"\infty ", "π": r"\pi ", "α": r"\alpha ", "β": r"\beta ", "θ": r"\theta ", "Δ": r"\Delta ", "∈": r"\in ",
    "⊂": r"\subset ", "∪": r"\cup ", "∩": r"\cap ", "→": r"\to ", "⇒": r"\Rightarrow ", "∑": r"\sum ", "∏": r"\prod ",
    "∫": r"\int ", "∠": r"\angle ", "∴": r"\therefore ", "∵": r"\because ", "≈": r"\approx ", "≡": r"\equiv ",
    "⊆": r"\subseteq ", "⊇": r"\supseteq ", "∉": r"\notin ", "∀": r"\forall ", "∃": r"\exists ", "∂": r"\partial ",
    "∇": r"\nabla ", "√": r"\sqrt ",
}


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), XML_ILLEGAL, "")


def _roman(letters: str, s: str) -> str:
    r"""Pattern of letters that were set one by one: ``{ \rm{ l } }``."""
    return rf"[{s}]*".join(rf"\{{[{s}]*\\rm\{{[{s}]*{x}[{s}]*\}}[{s}]*\}}" for x in letters)


def _log_with_base(text: Column, s: str) -> Column:
    """``l o g _{ 2 }`` set letter by letter becomes one command; the base loses its blanks."""
    pattern = rf"(?i){_roman('log', s)}[{s}]*_([{s}]*\{{?[{s}]*[0-9n]+[{s}]*\}}?)"
    join = lambda m: F.concat(F.lit(r"\log_{"), F.regexp_replace(F.regexp_extract(m, pattern, 1), rf"[{s}]+", ""), F.lit("}"))
    return let(text, lambda t: F.when(t.contains("_"), rewrite_matches(t, pattern, join)).otherwise(t))


def clean_decoded(text: Column) -> Column:
    """Repairs of LaTeX decoded from equation binaries."""
    s = PY_SPACE
    text = replace_all(text, (rf"\\begin\{{array\}}[{s}]*\{{[{s}]*\}}", r"\\begin{array}{l}"))
    text = _log_with_base(text, s)
    text = replace_all(
        text,
        (rf"(?i){_roman('log', s)}", r"\\log"),
        (rf"(?i)\{{[{s}]*\\rm\{{[{s}]*\\pi[{s}]*\}}[{s}]*\}}", r"\\pi"),
        (rf"\\sqrt[{s}]*\[[{s}]*\][{s}]*\{{", r"\\sqrt{"),
    )
    return xml_safe(text)


def unicode_to_latex(text: Column) -> Column:
    return clean_decoded(literal_all(text, *SYMBOLS.items()))


def decode_entities(text: Column) -> Column:
    """Named entities; the ampersand goes first, so ``&amp;lt;`` is decoded twice."""
    return replace_all(text, ("(?i)&amp;", "&"), ("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"))


def unescape_markdown(text: Column) -> Column:
    """Undo what Markdown writers escape in options, numbers and formulas."""
    text = decode_entities(F.replace(text, F.lit("＄"), F.lit("$")))
    # The patterns of the rules, in their order.
    text = replace_all(
        text,
        (r"(?i)</?(?:span|div|p|font|em|strong|i|b|u)[^>]*>", ""),
        (r"([A-Da-d])\\([.．、])", "$1$2"),
        (r"([0-9]+)\\([.．])", "$1$2"),
        (r"\\\$", r"\$"),
        (r"\\\\([()\[\]])", r"\\$1"),
    )
    return F.replace(text, F.lit("\\_"), F.lit("_"))


def word_artifacts(text: Column) -> Column:
    """Column specifications, empty arrays and split function names that word processors leave."""
    s = JS_SPACE
    # The patterns of the rules, in their order.
    text = replace_all(
        text,
        (r"(?i)\{\*\{[0-9]+\}\{([clmr])\}\}", "{$1}"),
        (r"(?i)\{\*\{[0-9]+\}\{([clmr])\}", "{$1"),
        (rf"\\begin\{{array\}}[{s}]*\{{[{s}]*\}}", r"\\begin{array}{l}"),
        *[(rf"\\begin\{{array\}}\{{[lcr]*\}}[{s}]*\\end\{{array\}}", "")] * 6,
        (rf"\\left[{s}]*\\?\{{(?:[{s}]*\\begin\{{array\}}\{{[lcr]*\}})+[{s}]*\\right[{s}]*\.", ""),
        (rf"\\left[{s}]*\\?\{{[{s}]*\\right[{s}]*\.", ""),
    )
    text = _log_with_base(text, s)
    pair = rf"\{{[{s}]*\\rm\{{[{s}]*lo[{s}]*\}}[{s}]*\}}[{s}]*\{{[{s}]*\\rm\{{[{s}]*g[{s}]*\}}[{s}]*\}}"
    return replace_all(
        text,
        (rf"(?i){_roman('log', s)}", r"\\log"),
        (rf"(?i){pair}", r"\\log"),
        (r"\{\{\\rm\{lo\}\}\{\{\\rm\{g\}\}_(\{?[0-9n]+\}?)\}\}", r"\\log_{$1}"),
        (rf"\{{\\rm\{{lo\}}\}}[{s}]*\{{\{{\\rm\{{g\}}\}}_(\{{?[0-9n]+\}}?)\}}", r"\\log_{$1}"),
        (rf"(?i)\{{[{s}]*\\rm\{{[{s}]*\\pi[{s}]*\}}[{s}]*\}}", r"\\pi"),
        (rf"\\sqrt[{s}]*\[[{s}]*\][{s}]*\{{", r"\\sqrt{"),
        (rf"\\begin\{{array\}}\{{[lcr]+\}}([{s}]*)\\begin\{{array\}}\{{[lcr]+\}}([\s\S]*?)\\end\{{array\}}([{s}]*)\\end\{{array\}}", r"\\begin{array}{l}$2\\end{array}"),
    )


def count_of(text: Column, pattern: str) -> Column:
    return F.size(matches_of(text, pattern)).cast("long")


def formula_listing(latex: Column) -> Column:
    """An array of formulas as numbered blocks."""
    block = lambda x, i: F.concat(F.lit("===== 公式 "), (i + 1).cast("string"), F.lit(" =====\nLaTeX:\n$"), x, F.lit("$\n"))
    return F.array_join(F.transform(latex, block), "\n")


# Fixed values are the commands in the pattern.
def latex_like(text: Column) -> Column:
    """Whether a body looks like LaTeX: a telling command, line breaks with groups, or two commands."""
    telling = text.rlike(r"\\(?:begin|end|left|right|frac|dfrac|sqrt|mathrm|mathbf|rm|array|cases|log)")
    return telling | (text.contains("\\\\") & text.rlike(r"[{}^_]")) | (F.size(matches_of(text, r"\\[a-zA-Z]+")) >= 2)
