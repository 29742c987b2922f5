"""The web pipeline's Markdown, warnings and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.html_markdown import structured_markdown
from ..operators.markdown_html import markdown_html
from ..operators.latex_repair import options_wrapped
from .regex import JS_SPACE, let, replace_all, rewrite_matches, strip

#: Converter messages that say nothing to a user.
NOISE = r"(?i)unrecognised element|oMath|v:path|OLEObject|wmf|emf"


def drop_empty_images(html: Column) -> Column:
    return F.regexp_replace(html, r"""(?i)<img\b[^>]*src=(""|'')[^>]*>""", "")


def web_markdown(html: Column) -> Column:
    """HTML to Markdown with its structure, pictures on their own, numbers, options and sections on new lines."""
    text = structured_markdown(drop_empty_images(html))
    text = strip(replace_all(text, ("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")), JS_SPACE)
    text = replace_all(text, (r"(?md)(^|\n)([ \t]*)([0-9]+)\\([.．])", "$1$2$3$4"), (r"([A-Da-d])\\([.．、])", "$1$2"), (r"\\\$", r"\$"), (r"(?i)</?(?:span|div|font)[^>]*>", ""))
    # The marks of sections, numbers and options.
    text = replace_all(
        options_wrapped(text),
        ("(【答案】|【分析】|【详解】)", "\n$1"),
        (rf"(?d)(\A|\n)([0-9]+[{JS_SPACE}]*(?:\\[.．]|[.．、]))", "\n\n$2"),
        (rf"([^\n])[{JS_SPACE}]+([A-Da-d][.．、][{JS_SPACE}]*)", "$1\n$2"),
        (r"\n{3,}", "\n\n"),
    )
    return F.concat(strip(text, JS_SPACE), F.lit("\n"))


def warnings(messages: Column, most: int = 8) -> Column:
    """``array<struct<type, message>>``: warnings and errors but for noise, once each, the first eight."""
    told = F.filter(messages, lambda m: m["type"].isin("warning", "error") & ~m["message"].rlike(NOISE))
    return F.slice(F.array_distinct(F.transform(told, lambda m: m["message"])), 1, most)


def is_markdown(path: Column, mime: Column) -> Column:
    return path.rlike(r"(?i)\.(md|markdown|mdown)\z") | F.coalesce(mime, F.lit("")).rlike("(?i)markdown")


def pick_markdown(files: DataFrame, by: list[str]) -> DataFrame:
    """Of ``files(by, path, type)`` the Markdown file of least depth, then first by name."""
    depth = F.size(F.split("path", r"[/\\]", -1))
    candidates = files.where(is_markdown(F.col("path"), F.col("type")))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(depth, "path"))
    return candidates.withColumn("__n", first).where("__n = 1").drop("__n")


def is_image(path: Column, mime: Column) -> Column:
    return F.lower(path).rlike(r"\.(jpe?g|png|gif|webp|bmp|svg)\z") | F.coalesce(mime, F.lit("")).rlike(r"(?i)\Aimage/")


def tag_images(markdown: Column, job: Column) -> Column:
    """``![..](assets/..)`` as image tags that say whether they show a formula or a figure."""

    def one(match: Column) -> Column:
        alt, name = (F.regexp_extract(match, r"!\[([^\]]*)\]\(assets/([^)]+)\)", k) for k in (1, 2))
        kind = F.when(name.rlike(r"(?i)\A(formula|glyph)[0-9]+\."), "formula").otherwise("figure")
        return F.concat(F.lit('<img class="'), kind, F.lit('" src="/files/'), job, F.lit("/assets/"), name, F.lit('" alt="'), alt, F.lit('">'))

    pattern = r"!\[[^\]]*\]\(assets/[^)]+\)"
    return let(markdown, lambda t: rewrite_matches(t, pattern, one))


def preview_html(markdown: Column, job: Column) -> Column:
    """The page body of a preview: pictures of the job as tagged images, then HTML; other images are tagged by their address."""
    html = markdown_html(tag_images(markdown, job))
    other = lambda kind: rf'(?i)<img(?![^>]*class=)([^>]*src="[^"]*(?:{kind})[^"]*"[^>]*)>'
    return replace_all(html, (other("formula|glyph"), '<img class="formula"$1>'), (other("/image"), '<img class="figure"$1>'))
