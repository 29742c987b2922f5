"""What in a Word file makes conversion risky: counts of its elements, and reports on them.

A file's counts are made while its XML is read (``sources.tally``), a row per part, and summed up by one group-by with partial
sums.  Reports are arrays built from the wide row of counts, so no further shuffle follows.  Single counts can also be had from the table of elements.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latex import count_of
from ..functions.regex import strip
from ..sources import docx as D
from ..sources.tally import tallies
from .formulas import longest_run

# Program ids of equation objects; extensions of pictures.
EQUATION_IDS = ["equation.dsmt4", "equation.dsmt3", "equation.3", "equation.2", "mathtype.equation"]
RASTER = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff"]

#: count -> element, or elements added up
ELEMENTS = {
    "o_math": ["m:oMath"], "o_math_para": ["m:oMathPara"], "ins": ["w:ins"], "dels": ["w:del"], "rpr_change": ["w:rPrChange"], "ppr_change": ["w:pPrChange"],
    "comment_marks": ["w:commentRangeStart", "w:commentReference"], "rendered_breaks": ["w:lastRenderedPageBreak"], "vanish": ["w:vanish"],
    "textboxes": ["w:txbxContent", "v:textbox"], "anchors": ["wp:anchor"], "tables": ["w:tbl"], "sdt": ["w:sdt"], "hyperlinks": ["w:hyperlink"],
    "bookmarks": ["w:bookmarkStart"], "tabs": ["w:tab"], "frames": ["w:framePr"], "imagedata": ["v:imagedata"], "blips": ["a:blip"],
    "drawings": ["wp:inline", "wp:anchor"], "sections": ["w:sectPr"],
}


def is_element(name: str) -> Column:
    prefix, local = name.split(":")
    return (F.col("ns") == D.NS[prefix]) & (F.col("local") == local)


def is_equation(prog: Column) -> Column:
    return F.exists(F.array(*map(F.lit, EQUATION_IDS)), lambda p: F.contains(F.lower(prog), p))


def _tag_columns(where: Column | None = None) -> list[Column]:
    """One conditional count per entry of ``ELEMENTS``, page breaks and inline formulas."""
    inside = F.lit(True) if where is None else where
    counts = [F.count_if(inside & _any(names)).alias(c) for c, names in ELEMENTS.items()]
    pages = is_element("w:br") & (F.col("attrs")[f"{{{D.NS['w']}}}type"] == "page")
    inline = is_element("m:oMath") & ~F.col("in_math_para")
    return [*counts, F.count_if(inside & pages).alias("page_breaks"), F.count_if(inside & inline).alias("inline_omml")]


def tag_counts(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """All element counts of a document in one pass."""
    return nodes.groupBy(by).agg(*_tag_columns())


def _any(names: list[str]) -> Column:
    out = is_element(names[0])
    for n in names[1:]:
        out = out | is_element(n)
    return out


def section_types(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Histogram of section types; a section without one is ``nextPage(default)``."""
    sections = nodes.where(is_element("w:sectPr")).select(by, "part", F.col("node_id").alias("parent_id"))
    kinds = nodes.where(is_element("w:type")).select(by, "part", "parent_id", F.col("attrs")[f"{{{D.NS['w']}}}val"].alias("val"))
    kind = F.coalesce(F.nullif("val", F.lit("")), F.lit("nextPage(default)"))
    return sections.join(kinds, [by, "part", "parent_id"], "left").groupBy(by, kind.alias("type")).agg(F.count("*").alias("n"))


def _note_columns(where: Column) -> list[Column]:
    kind = F.coalesce(F.col("attrs")[f"{{{D.NS['w']}}}type"], F.lit(""))
    real = ~kind.isin("separator", "continuationSeparator")
    return [F.count_if(where & is_element(f"w:{n}") & (F.col("part") == f"word/{n}s.xml") & real).alias(f"{n}s") for n in ("footnote", "endnote")]


def notes(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Footnotes and endnotes but for separators."""
    return nodes.groupBy(by).agg(*_note_columns(F.lit(True)))


def _empty() -> Column:
    return (strip(F.col("text")) == "") & ~F.col("has_object")


def _paragraph_columns(where: Column) -> list[Column]:
    heading = F.coalesce(F.lower("style").startswith("heading") | F.col("style").contains("标题"), F.lit(False))
    return [F.count_if(where).alias("paragraphs"), F.count_if(where & _empty()).alias("empty_paragraphs"), F.count_if(where & heading).alias("headings")]


def paragraph_counts(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Paragraphs, empty ones, the longest run of them, and headings."""
    flagged = paragraphs.withColumn("empty", _empty())
    sums = flagged.groupBy(by).agg(*_paragraph_columns(F.lit(True)))
    return sums.join(longest_run(flagged, [by], ["ord"], "empty", "max_empty_run"), by)


MARGIN = r"/(header|footer).*\.xml\z"


def header_footer(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Header and footer parts, how many say something, whether any has a page field."""
    rows = nodes.where(F.col("part").rlike(MARGIN)).withColumn("kind", F.regexp_extract("part", "/(header|footer)", 1))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")
    fields = F.bool_or(F.col("text").contains("PAGE"))
    parts = rows.groupBy(by, "kind", "part").agg(strip(said).alias("said"), (strip(said) != "").alias("text"), F.bool_or(is_element("v:imagedata") | is_element("a:blip")).alias("image"), fields.alias("fields"))
    full = F.col("text") | F.col("image")
    shown = F.when(F.length("said") > 40, F.concat(F.substring("said", 1, 40), F.lit("…"))).when(F.col("text"), F.col("said")).otherwise("(含图片/域)")
    # headers first, then footers, each by name; at most four of a document's few parts
    samples = F.array_sort(F.collect_list(F.when(full, F.struct((F.col("kind") == "footer").alias("footer"), "part", shown.alias("preview")))))
    return parts.groupBy(by).agg(
        F.count_if(F.col("kind") == "header").alias("header_parts"), F.count_if(F.col("kind") == "footer").alias("footer_parts"),
        F.count_if((F.col("kind") == "header") & full).alias("nonempty_headers"), F.count_if((F.col("kind") == "footer") & full).alias("nonempty_footers"),
        F.bool_or("fields").alias("page_number_fields"),
        F.slice(F.transform(samples, lambda s: F.struct(s["part"], s["preview"])), 1, 4).alias("header_samples"),
    )


def suffix(part: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.element_at(F.split(part, "/", -1), -1), r".(\.[^.]*)\z", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def _media_columns(where: Column) -> list[Column]:
    name = F.col("part")
    media = where & name.startswith("word/media/") & ~name.endswith("/")
    has = lambda p: F.bool_or(where & (name == p))
    return [
        F.count_if(media).alias("media"), F.count_if(media & (suffix(name) == ".wmf")).alias("wmf"), F.count_if(media & (suffix(name) == ".emf")).alias("emf"),
        F.count_if(media & suffix(name).isin(RASTER)).alias("raster"), F.count_if(where & name.startswith("word/embeddings/") & ~name.endswith("/")).alias("embeddings"),
        has("word/comments.xml").alias("comments_part"), has("word/numbering.xml").alias("numbering"),
    ]


def media_counts(parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pictures by kind, embedded files, and which optional parts are there."""
    return parts.groupBy(by).agg(*_media_columns(F.lit(True)))


def media_by_extension(parts: DataFrame, folder: str = "word/media/", by: str = "doc_id") -> DataFrame:
    """``(doc_id, ext, n, place)`` of a folder; places count the most frequent first, then by name."""
    counted = D.members_under(parts, folder).groupBy(by, suffix(F.col("part")).alias("ext")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "ext")))


def media_sample(parts: DataFrame, most: int = 12, by: str = "doc_id") -> DataFrame:
    """The first names of the media in the order of the file."""
    media = D.members_under(parts, "word/media/").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", F.element_at(F.split("part", "/", -1), -1).alias("name")))).alias("m"))
    return media.select(by, F.size("m").alias("media"), F.slice(F.col("m.name"), 1, most).alias("sample"))


def ole_programs(nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """``(doc_id, prog, n, first_node)`` of embedded objects."""
    prog = F.coalesce(F.col("attrs")["ProgID"], F.lit(""))
    return nodes.where(is_element("o:OLEObject")).groupBy(by, prog.alias("prog")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"))


def _raw_columns(c: Column) -> dict[str, Column]:
    """Counts over XML as text."""
    times = lambda x: F.floor((F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) / len(x)).cast("long")
    low = F.lower(c)
    return {
        "fields": times("<w:fldChar") + times("w:instrText"), "toc": count_of(c, r"TOC\\") + times("TOC "), "page_fields": count_of(c, r"\bPAGE\b|\bNUMPAGES\b"),
        "alternate": times("mc:AlternateContent"), "watermark": low.contains("watermark"),
        "smartart": F.floor((F.length(low) - F.length(F.replace(low, F.lit("dgm:relids"), F.lit("")))) / 10).cast("long") + times("wps:wsp"),
        "dollar": count_of(c, r"(?<!\\)\$(?!\$)[^$\n]{1,80}\$"), "display_tex": count_of(c, r"(?s)\\\[.+?\\\]|\$\$[^$]+\$\$"),
        "latex_commands": count_of(c, r"\\(frac|dfrac|sqrt|sum|int|alpha|beta|theta|cdot|times)\b"),
    }


def raw_counts(parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Counts over the body's XML as text; bytes that are no UTF-8 count as one character each."""
    rows = parts.where("part = 'word/document.xml'").select(by, F.make_valid_utf8(F.col("data").cast("string")).alias("raw"))
    return rows.select(by, *(v.alias(k) for k, v in _raw_columns(F.col("raw")).items()))


def _margins(found: Column) -> list[Column]:
    """The columns of ``header_footer`` from the array ``(footer, part, said, image, pages)`` of one document's headers and footers, in order."""
    full = lambda p: (p["said"] != "") | p["image"]
    shown = lambda t: F.when(F.length(t) > 40, F.concat(F.substring(t, 1, 40), F.lit("…"))).when(t != "", t).otherwise("(含图片/域)")
    count = lambda f: F.size(F.filter(found, f)).cast("long")
    return [
        count(lambda p: ~p["footer"]).alias("header_parts"), count(lambda p: p["footer"]).alias("footer_parts"),
        count(lambda p: ~p["footer"] & full(p)).alias("nonempty_headers"), count(lambda p: p["footer"] & full(p)).alias("nonempty_footers"),
        F.exists(found, lambda p: p["pages"]).alias("page_number_fields"),
        F.transform(F.slice(F.filter(found, full), 1, 4), lambda p: F.struct(p["part"].alias("part"), shown(p["said"]).alias("preview"))).alias("header_samples"),
    ]


#: count -> what the automaton calls it
TOLD = {
    **ELEMENTS, "page_breaks": ["page"], "inline_omml": ["inline"], "ole_objects": ["o:OLEObject"], "mathtype": ["mathtype"], "ms_equation": ["equation"],
    "paragraphs": ["paragraph"], "empty_paragraphs": ["empty"], "headings": ["heading"],
}


def counts(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """The wide row of counts per document on which all reports rest, with ``error`` for what can't be read.

    Each file is read once and counted while its XML is parsed; a document's few rows, one per part, are summed up.
    """
    rows = tallies(docs, by).withColumn("part", F.coalesce("part", F.lit("")))
    part, zero = F.col("part"), F.lit(0).cast("long")
    body = part == "word/document.xml"
    told = lambda where, names: F.sum(F.when(where, reduce(add, (F.coalesce(F.col("tally")[n], zero) for n in names))).otherwise(zero))
    margin = F.when(part.rlike(MARGIN) & F.col("tally").isNotNull(), F.struct((F.regexp_extract("part", "/(header|footer)", 1) == "footer").alias("footer"), "part", strip(F.col("said")).alias("said"), "image", "pages"))
    raw = [F.max(F.coalesce(F.when(body, v), F.lit(False) if k == "watermark" else zero)).alias(k) for k, v in _raw_columns(F.col("raw")).items()]
    kinds = F.transform(F.map_entries("kinds"), lambda e: F.concat(F.when(e["key"] == "", "nextPage(default)").otherwise(e["key"]), F.lit("×"), e["value"].cast("string")))
    # no value of these is null, so that no more expressions come between them and the reports
    wide = rows.groupBy(by).agg(
        *(told(body, names).alias(c) for c, names in TOLD.items()), *(told(part == f"word/{n}s.xml", ["note"]).alias(f"{n}s") for n in ("footnote", "endnote")), *_media_columns(F.lit(True)), *raw,
        F.array_sort(F.collect_list(margin)).alias("margins"), F.max(F.coalesce("longest", zero)).alias("max_empty_run"), F.max(F.nullif(F.array_join(F.array_sort(kinds), ", "), F.lit(""))).alias("section_kinds"), F.max("error").alias("error"),
    )
    out = wide.select("*", *_margins(F.col("margins"))).drop("margins")
    return out.withColumn("revisions", F.col("ins") + F.col("dels") + F.col("rpr_change") + F.col("ppr_change"))


def _text(*xs: str) -> Column:
    """Words and counts in turn; a name in braces is a count."""
    return F.concat(*(F.col(x[1:-1]).cast("string") if x.startswith("{") else F.lit(x) for x in xs))


def structure_rows() -> Column:
    """``array<struct<name, present, count, detail, impact, status>>`` from the wide row.

    Fixed values: the names, details and notes of the report.
    """
    has = lambda c: F.col(c) > 0
    flag = lambda c: F.when(F.col(c), 1).otherwise(0)
    t = _text
    yes = F.when(F.col("comments_part"), "有").otherwise("无")
    rows = [
        ("修订 / 跟踪更改", has("revisions"), F.col("revisions"), F.concat(t("插入 ", "{ins}", "，删除 ", "{dels}", "，属性更改 "), (F.col("rpr_change") + F.col("ppr_change")).cast("string")), "未接受修订时正文会混入删改痕迹"),
        ("批注", F.col("comments_part") | has("comment_marks"), F.col("comment_marks"), F.concat(F.lit("comments.xml="), yes, t("，标记 ", "{comment_marks}")), "批注标记会变成杂讯或断开句子"),
        ("页眉", has("nonempty_headers"), F.col("nonempty_headers"), t("{header_parts}", " 个页眉部件，非空 ", "{nonempty_headers}"), "Markdown 无页眉，应删除以免混入正文"),
        ("页脚", has("nonempty_footers"), F.col("nonempty_footers"), t("{footer_parts}", " 个页脚部件，非空 ", "{nonempty_footers}"), "同上，页脚文字不应进入正文"),
        ("页码域", F.col("page_number_fields") | has("page_fields"), F.col("page_fields") + flag("page_number_fields"), F.lit("PAGE / NUMPAGES 域（正文或页眉页脚）"), "页码对 Markdown 无意义，可能变成裸数字"),
        ("分节符", F.col("sections") > 1, F.col("sections"), F.concat(F.lit("类型: "), F.coalesce("section_kinds", F.lit("—"))), "分节常用于换页/栏，Markdown 中应忽略或变成分隔线"),
        ("分页符", has("page_breaks"), F.col("page_breaks"), t("显式分页 ", "{page_breaks}", "，渲染分页标记 ", "{rendered_breaks}"), "分页在 Markdown 中无对应结构"),
        ("空段落", has("empty_paragraphs"), F.col("empty_paragraphs"), t("共 ", "{paragraphs}", " 段，空段 ", "{empty_paragraphs}", "，最长连续空段 ", "{max_empty_run}"), "产生多余空行，需后处理合并"),
        ("隐藏文字", has("vanish"), F.col("vanish"), F.lit("w:vanish"), "隐藏文字可能泄漏进 Markdown 或造成空白"),
        ("文本框 / 文本框内容", has("textboxes"), F.col("textboxes"), F.lit("txbxContent / v:textbox"), "文本框内容可能丢失或出现在错误位置"),
        ("浮动图形 (anchor)", has("anchors"), F.col("anchors"), F.lit("wp:anchor"), "环绕排版无法保留，图片可能跑到段末"),
        ("脚注", has("footnotes"), F.col("footnotes"), F.lit("word/footnotes.xml"), "需转为 Markdown 脚注 [^n]"),
        ("尾注", has("endnotes"), F.col("endnotes"), F.lit("word/endnotes.xml"), "需转为文末注释"),
        ("表格", has("tables"), F.col("tables"), F.lit("w:tbl"), "复杂合并单元格可能变成错位 pipe table"),
        ("内容控件 (SDT)", has("sdt"), F.col("sdt"), F.lit("w:sdt"), "控件外壳应去掉，只保留显示文本"),
        ("超链接", has("hyperlinks"), F.col("hyperlinks"), F.lit("w:hyperlink"), "应转为 [text](url)，域代码需展开"),
        ("书签", has("bookmarks"), F.col("bookmarks"), F.lit("w:bookmarkStart"), "交叉引用可能变成残留书签名"),
        ("制表符", has("tabs"), F.col("tabs"), F.lit("w:tab"), "对齐用 Tab 在 Markdown 中会乱，需改空格/表格"),
        ("域 (含目录等)", has("fields"), F.col("fields"), t("fldChar/instrText，TOC 痕迹 ", "{toc}"), "未展开的域会留下乱码或重复目录"),
        ("编号/列表定义", F.col("numbering"), flag("numbering"), F.lit("word/numbering.xml"), "多级列表缩进可能不准"),
        ("标题样式段落", has("headings"), F.col("headings"), F.lit("Heading / 标题样式"), "用于生成 # / ##，样式丢失则全成普通段"),
        ("AlternateContent 兼容包装", has("alternate"), F.col("alternate"), F.lit("mc:AlternateContent"), "可能重复导出新旧两套图形"),
        ("图文框 framePr", has("frames"), F.col("frames"), F.lit("w:framePr"), "绝对定位框无法映射"),
        ("水印", F.col("watermark"), flag("watermark"), F.lit("header 水印/VML"), "可能被当成背景图导出"),
        ("SmartArt / 形状", has("smartart"), F.col("smartart"), F.lit("drawingML 形状"), "多转为图片，结构丢失"),
    ]
    struct = lambda n, p, c, d, i: F.struct(F.lit(n).alias("name"), p.alias("present"), c.cast("long").alias("count"), d.alias("detail"), F.lit(i).alias("impact"), F.when(p, "有").otherwise("无").alias("status"))
    return F.array(*(struct(*r) for r in rows))


def math_types() -> Column:
    """``array<struct<kind, count, present>>`` of how formulas and pictures are stored."""
    latex = F.col("dollar") + F.col("display_tex") + F.when(F.col("latex_commands") > 0, 1).otherwise(0)
    other = F.col("ole_objects") - F.col("mathtype") - F.col("ms_equation")
    kinds = {
        "omml_display": F.col("o_math_para"), "omml_inline": F.col("inline_omml"), "mathtype_ole": F.col("mathtype"), "ms_equation_ole": F.col("ms_equation"), "other_ole": other,
        "wmf_emf": F.col("wmf") + F.col("emf"), "raster": F.col("raster"), "drawingml": F.col("drawings"), "latex_text": latex,
    }
    return F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("long").alias("count"), (n > 0).alias("present")) for k, n in kinds.items()))


def primary() -> Column:
    return (
        F.when(F.col("mathtype") > 0, "mathtype_ole").when(F.col("o_math") + F.col("o_math_para") > 0, "omml").when(F.col("wmf") + F.col("emf") > 0, "wmf_emf")
        .when(F.col("raster") > 0, "raster").when(F.col("ms_equation") > 0, "ms_equation_ole").otherwise("none")
    )


def summary() -> Column:
    bits = F.concat_ws(
        "；", F.when(F.col("mathtype") > 0, _text("MathType ", "{mathtype}", " 个")), F.when(F.col("o_math") + F.col("o_math_para") > 0, _text("OMML ", "{o_math_para}", " 段+", "{o_math}", " 个")),
        F.when(F.col("wmf") + F.col("emf") > 0, F.concat(F.lit("WMF/EMF "), (F.col("wmf") + F.col("emf")).cast("string"), F.lit(" 张"))), F.when(F.col("revisions") > 0, "含修订"), F.when(F.col("comment_marks") > 0, "含批注"),
    )
    return F.when(bits == "", "未发现明显公式对象，请检查是否为纯文本或图片试卷。").otherwise(F.concat(bits, F.lit("。")))


#: Structures that are told as risks, and the notes on what the formulas are.
RISKS = ["修订 / 跟踪更改", "批注", "页眉", "页脚", "文本框 / 文本框内容", "浮动图形 (anchor)", "分页符", "空段落"]
PRIMARY_NOTES = {
    "mathtype_ole": ("高", "主体公式是 MathType OLE", "默认会导出为 PNG，而不是 LaTeX。"),
    "omml": ("中", "主体公式是 OMML", "可转 LaTeX，复杂结构仍可能有缺口。"),
    "wmf_emf": ("高", "公式主要是 WMF/EMF 图", "只能当图片，无法得到可编辑 LaTeX。"),
}


def impact(rows: Column) -> Column:
    note = lambda level, item, text: F.struct(level.alias("level"), item.alias("item"), text.alias("note"))
    first = F.array(*(F.when(primary() == k, note(*map(F.lit, v))) for k, v in PRIMARY_NOTES.items()))
    risky = F.transform(F.filter(rows, lambda r: r["present"] & r["name"].isin(RISKS)), lambda r: note(F.lit("中"), r["name"], r["impact"]))
    many = F.array(F.when(F.col("media") > 200, note(F.lit("中"), F.lit("媒体文件很多"), _text("{media}", " 个 media，转换和预览会较慢。"))))
    return F.filter(F.concat(first, risky, many), lambda x: x.isNotNull())


def inspect(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row per document: ``primary, summary, types, rows, impact``, the counts and ``error``."""
    wide = counts(docs, by).withColumns({"primary": primary(), "summary": summary(), "types": math_types(), "rows": structure_rows()})
    return wide.withColumn("impact", impact(F.col("rows")))


def report(inspected: DataFrame, by: str = "doc_id") -> DataFrame:
    """``doc_id, report``: the inspection as one JSON text each."""
    math, structure = F.struct("primary", "summary", "types"), F.struct("rows", "section_kinds", "header_samples")
    return inspected.select(by, F.to_json(F.struct(math.alias("math"), structure.alias("structure"), "impact", "error")).alias("report"))
