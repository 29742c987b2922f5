"""Exam papers: numbered questions, their sections and notices, as JVM array expressions.

A paper stays one row: heads are marked with control characters, the text is split at them, and a
fold picks the chain of consecutive numbers.  Exploding the result is the caller's choice, so no
shuffle is needed to go from papers to questions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import JS_SPACE, let, literal_all, replace_all, strip

# What starts a question, which marks start sections, openings that are no content.
HEAD = rf"(?:\A|\n)[{JS_SPACE}]*(?:#{{1,6}}[{JS_SPACE}]*)?(?:第[{JS_SPACE}]*([0-9]+)[{JS_SPACE}]*题|([0-9]+)[{JS_SPACE}]*(?:\\[.．]|[.．、]))(?:[{JS_SPACE}]+|(?=[^{JS_SPACE}]))"
MARKS = {"【答案】": "answer", "【解析】": "analysis", "【分析】": "analysis", "【详解】": "detail"}
OPENINGS = r"\A(?:学科网|机密|注意事项)"
LEAST_PREAMBLE = 40

START, NUMBER, BODY = "\u0001", "\u0002", "\u0003"


def normalize(raw: Column) -> Column:
    text = replace_all(raw, (r"\A﻿", ""))
    return strip(literal_all(text, ("\r\n", "\n"), ("\r", "\n"), (" ", " ")), JS_SPACE)


def _chain(numbers: Column, start: Column) -> Column:
    """Positions of start, start + 1, ... taken greedily from the left."""
    positions = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    none = F.struct(start.cast("long").alias("e"), F.array().cast("array<int>").alias("c"))
    step = lambda a, x: F.when(x["n"] == a["e"], F.struct((a["e"] + 1).alias("e"), F.array_append(a["c"], x["i"]).alias("c"))).otherwise(a)
    return F.aggregate(positions, none, step, lambda a: a["c"])


def _best_chain(numbers: Column) -> Column:
    """From 1; without a 1, the first of the longest chains over all starting numbers."""
    empty = F.array().cast("array<int>")
    longest = F.aggregate(F.transform(F.array_distinct(numbers), lambda n: _chain(numbers, n)), empty, lambda a, c: F.when(F.size(c) > F.size(a), c).otherwise(a))
    return let(_chain(numbers, F.lit(1)), lambda c: F.when(F.size(c) > 0, c).otherwise(longest))


def _bodies(segments: Column) -> Column:
    """Of segments ``number NUMBER head BODY text`` and the text before: ``(index, body)``."""
    heads = F.slice(segments, F.lit(2), F.size(segments))
    number = lambda s: F.element_at(F.split(s, NUMBER, 2), 1).try_cast("long")
    whole = lambda s: F.replace(F.element_at(F.split(s, NUMBER, 2), 2), F.lit(BODY), F.lit(""))
    text = lambda s: F.element_at(F.split(s, BODY, 2), 2)
    joined = lambda xs: F.array_join(F.transform(xs, whole), "")

    def bodies(hits: Column, chain: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(chain, k + 1), F.size(hits))
            own = strip(F.concat(text(F.get(hits, at)), joined(F.slice(hits, at + 2, end - at - 1))), JS_SPACE)
            before = strip(F.concat(F.element_at(segments, 1), joined(F.slice(hits, F.lit(1), at))), JS_SPACE)
            kept = let(before, lambda b: F.when((F.length(b) >= LEAST_PREAMBLE) & ~b.rlike(OPENINGS), F.concat(b, F.lit("\n\n"))).otherwise(""))
            body = F.when(k == 0, strip(F.concat(kept, own), JS_SPACE)).otherwise(own)
            return F.struct(number(F.get(hits, at)).alias("index"), body.alias("body"))

        return F.filter(F.transform(chain, one), lambda q: q["body"] != "")

    return let(heads, lambda hits: let(_best_chain(F.transform(hits, number)), lambda chain: bodies(hits, chain)))


def sections(body: Column) -> Column:
    """``(stem, answer, analysis, detail)``; a repeated section goes on in a new line."""
    mark = "|".join(MARKS)
    parts = F.split(F.regexp_replace(body, f"({mark})", START + "$1"), START, -1)

    def bucket(parts: Column, key: str) -> Column:
        marks = [m for m, k in MARKS.items() if k == key]
        own = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substring(p, 1, 4).isin(marks))
        content = F.transform(own, lambda p: strip(F.substring(p, 5, 1 << 30), JS_SPACE))
        return F.aggregate(content, F.lit(""), lambda a, c: F.when(a == "", c).otherwise(F.concat(a, F.lit("\n"), c)))

    return let(parts, lambda p: F.struct(strip(F.element_at(p, 1), JS_SPACE).alias("stem"), *(bucket(p, k).alias(k) for k in ("answer", "analysis", "detail"))))


def questions(raw: Column) -> Column:
    """``array<struct<index, stem, answer, analysis, detail>>`` in order of index, then place."""
    text = F.regexp_replace(normalize(raw), f"[{START}{NUMBER}{BODY}]", "")
    segments = F.split(F.regexp_replace(text, HEAD, f"{START}$1$2{NUMBER}$0{BODY}"), START, -1)

    def made(q: Column, i: Column) -> Column:
        return let(sections(q["body"]), lambda s: F.struct(q["index"].alias("index"), i.alias("place"), *(s[k].alias(k) for k in ("stem", "answer", "analysis", "detail"))))

    return F.array_sort(F.transform(let(segments, _bodies), made))


def notices(raw: Column, found: Column, keys: Column | None = None, missing: Column | None = None) -> Column:
    """``array<struct<level, text>>`` of a paper and its ``questions``.

    ``keys``: under how many names pictures are at hand; ``missing``: references without a picture, as they come.
    """
    note = lambda level, *text: F.struct(F.lit(level).alias("level"), F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)).alias("text"))
    whole = lambda q: F.concat_ws("\n", q["stem"], q["answer"], q["analysis"], q["detail"])
    bare = F.filter(F.array_sort(found, lambda a, b: a["place"] - b["place"]), lambda q: (q["answer"] == "") & (q["analysis"] == "") & (q["detail"] == ""))
    tips = F.transform(bare, lambda q: note("tip", "第 ", q["index"], " 题未找到【答案】/【分析】/【详解】标记。"))
    maths = F.size(F.filter(found, lambda q: whole(q).rlike(r"\$[^$]+\$|\$\$[\s\S]+?\$\$")))
    images = F.size(F.filter(found, lambda q: whole(q).rlike(r"(?i)!\[[^\]]*\]\([^)]+\)|!\[\[[^\]]+\]\]|<img\b")))
    none = F.array().cast("array<struct<level:string,text:string>>")
    some = lambda n, *text: let(n, lambda n: F.when(n > 0, F.array(note("ok", "其中 ", n, *text))).otherwise(none))
    matched = F.lit("") if keys is None else F.when(keys > 0, F.concat(F.lit("已匹配本地图片 "), keys.cast("string"), F.lit(" 个。"))).otherwise("")
    # Fixed value: the text of the notice.
    lost = "张图片未加载成功（多为相对路径）。请在选择文件时同时选中 .md 与对应的 .jpg/.png 等图片文件。例如："
    gone = none if missing is None else F.when(F.size(missing) > 0, F.array(note("tip", "有 ", F.size(missing), f" {lost}", F.array_join(F.slice(missing, 1, 3), "、")))).otherwise(none)
    full = F.concat(F.array(note("ok", "成功从 Markdown 识别 ", F.size(found), " 道题。")), tips, some(maths, " 题含 LaTeX 公式，已用 KaTeX 渲染。"), some(images, " 题含图片引用。", matched), gone)
    unnumbered = "未识别到大题题号。请确认题号在段首，格式如：1.  / 1． / 1、 / 第1题（小题（1）不会当作大题）。"
    return F.when(normalize(raw) == "", F.array(note("warn", "文件内容为空。"))).when(F.size(found) == 0, F.array(note("warn", unnumbered))).otherwise(full)
