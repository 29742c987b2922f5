"""Word files as DataFrames: zip parts, XML nodes, paragraphs, relationships.

Zip and XML have no JVM built-in that fits, so two Arrow table functions read them; everything
after is relational.  Each works part by part in the partition where the bytes are: no shuffle.
"""

from __future__ import annotations

import io
import lzma
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .files import below, qualified, scan_files

# XML namespaces of Word files, by their usual prefix.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "v": "urn:schemas-microsoft-com:vml",
    "o": "urn:schemas-microsoft-com:office:office",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``doc_id, path, content`` of the ``.docx`` files under a path, lock files left out.

    In no order, as sorting would move all contents; ``listing`` sorts paths alone.  Paths are whole, with their scheme.
    """
    files = scan_files(spark, path, "*.[dD][oO][cC][xX]", recursive).withColumn("path", F.concat(F.lit(qualified(spark, path) + "/"), "path"))
    kept = files.where(~F.element_at(F.split("path", "/", -1), -1).startswith("~$"))
    return kept.select(F.sha1("path").alias("doc_id"), "path", "content")


def listing(files: DataFrame, root: str, out: str) -> DataFrame:
    """``doc_id, path, out_path`` of scanned files by path, contents unread; outputs mirror the folders under ``root``."""
    return files.select("doc_id", "path", output_path(F.col("path"), qualified(files.sparkSession, root), out).alias("out_path")).orderBy("path")


def output_path(path: Column, root: str, out: str) -> Column:
    """``out`` and the path below ``root``, with ``.md`` for ``.docx``; a file elsewhere keeps its name alone."""
    name = F.coalesce(below(path, root.rstrip("/")), F.element_at(F.split(path, "/", -1), -1))
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(name, r"(?i)\.docx\z", ".md"))


def _each(rows: DataFrame, keep: list[str], column: str, read, schema: str) -> DataFrame:
    """``keep`` columns with the rows that ``read(bytes)`` yields for each value of ``column``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keep).schema}
    head = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    arrow = pa.schema(_arrow(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(len(keep))):
                made = list(read(value.as_py()))
                if made:
                    tail = pa.RecordBatch.from_pylist(made, schema=arrow)
                    index = pa.array([i] * len(made), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(len(keep))), *tail.columns], names=[*keep, *arrow.names])

    return rows.select(*keep, column).mapInArrow(run, f"{head}, {schema}")


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "long": pa.int64(), "map<string,long>": pa.map_(pa.string(), pa.int64())}
    return [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


#: What reading a damaged zip or a damaged member of one raises.
BROKEN = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, ValueError, EOFError, NotImplementedError, RuntimeError, OSError)


class Package:
    """A file's members by name; contents are read when asked for, and damaged ones are None."""

    def __init__(self, content: bytes | None) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content or b""))
            self.items = {i.filename.replace("\\", "/"): i for i in self.zip.infolist()}
        except BROKEN:
            self.zip, self.items = None, {}

    def read(self, part: str) -> bytes | None:
        try:
            return self.zip.read(self.items[part]) if part in self.items else None
        except BROKEN:
            return None


def _members(content: bytes | None, under: str = "") -> Iterator[dict]:
    package = Package(content)
    for k, part in enumerate(package.items):
        if part.startswith(under):
            yield {"ord": k, "part": part, "data": package.read(part)}


def parts(docs: DataFrame, by: str = "doc_id", content: str = "content", under: str = "") -> DataFrame:
    """``(doc_id, ord, part, data)`` of the members whose names begin so; what is no zip gives no rows."""
    return _each(docs, [by], content, lambda data: _members(data, under), "ord int, part string, data binary")


def parse(data: bytes | str | None) -> ET.Element | None:
    try:
        return ET.fromstring(data) if data else None
    except ET.ParseError:
        return None


def split_tag(tag: str) -> tuple[str, str]:
    ns, _, local = tag.rpartition("}")
    return ns[1:], local.rpartition(":")[2]


def _nodes(data: bytes | None) -> Iterator[dict]:
    root = parse(data)
    if root is None:
        return
    rows: list[dict] = []
    stack = [(root, -1, 0, False)]
    while stack:
        el, parent, depth, shown = stack.pop()
        if el is None:  # all below rows[parent] are out
            rows[parent]["last_desc"] = len(rows) - 1
            continue
        ns, local = split_tag(el.tag)
        me = len(rows)
        rows.append({"node_id": me, "parent_id": parent, "last_desc": me, "depth": depth, "in_math_para": shown, "ns": ns, "local": local, "attrs": list(el.attrib.items()), "text": el.text or "", "tail": el.tail or ""})
        stack.append((None, me, depth, False))
        shown = shown or (local == "oMathPara" and ns == NS["m"])
        stack += [(c, me, depth + 1, shown) for c in reversed(el)]
    yield from rows


def nodes(part_rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """XML elements in document order; ``node_id .. last_desc`` spans an element's descendants.

    ``in_math_para`` says whether an element stands in a display formula, so that no interval join
    is needed to tell inline formulas.
    """
    schema = "node_id int, parent_id int, last_desc int, depth int, in_math_para boolean, ns string, local string, attrs map<string,string>, text string, tail string"
    return _each(part_rows, [by, "part"], "data", _nodes, schema)


def _q(name: str) -> str:
    prefix, local = name.split(":")
    return f"{{{NS[prefix]}}}{local}"


def holds(el: ET.Element, *names: str) -> bool:
    return any(next(el.iter(_q(n)), None) is not None for n in names)


def _paragraphs(data: bytes | None) -> Iterator[dict]:
    root = parse(data)
    if root is None:
        return
    for k, p in enumerate(root.iter(_q("w:p"))):
        style = p.find(f"{_q('w:pPr')}/{_q('w:pStyle')}")
        text = "".join(t.text or "" for t in p.iter(_q("w:t")))
        yield {"ord": k, "text": text, "style": None if style is None else style.get(_q("w:val")) or "", "has_object": holds(p, "w:object", "m:oMath", "wp:inline", "v:imagedata")}


def paragraphs(part_rows: DataFrame, by: str = "doc_id") -> DataFrame:
    return _each(part_rows, [by, "part"], "data", _paragraphs, "ord int, text string, style string, has_object boolean")


def _margin(part: str) -> bool:
    return re.search(r"/(header|footer).*\.xml\Z", part) is not None


def relationships(node_rows: DataFrame, rule: str = "math", by: str = "doc_id") -> DataFrame:
    """``(doc_id, rid, target)``; the rule says how a target becomes a part's name.

    ``math``: leading slashes off, ``word/`` before what was relative; ``image``: ``word/`` before all that
    doesn't start with it, slashes off first; ``raw``: as it stands.
    """
    target = F.col("attrs")["Target"]
    bare = F.regexp_replace(target, r"\A/+", "")
    made = {
        "math": F.when(target.startswith("/"), bare).otherwise(F.concat(F.lit("word/"), target)),
        "image": F.when(target.startswith("word/"), target).otherwise(F.concat(F.lit("word/"), bare)),
        "raw": target,
    }[rule]
    return node_rows.where(F.col("local") == "Relationship").select(by, F.col("attrs")["Id"].alias("rid"), made.alias("target"))


def part_of(target: str) -> str:
    """The part that a relationship of the main document points to, by the rule ``math``."""
    target = target.replace("\\", "/")
    return target.lstrip("/") if target.startswith("/") else "word/" + target


def targets(rels: bytes | None) -> dict[str, str]:
    """Relationship id -> target as it stands."""
    root = parse(rels)
    return {r.get("Id") or "": (r.get("Target") or "").replace("\\", "/") for r in root} if root is not None else {}


def members_under(part_rows: DataFrame, prefix: str) -> DataFrame:
    """Files under a folder, folders left out."""
    return part_rows.where(F.col("part").startswith(prefix) & ~F.col("part").endswith("/"))


def zipped(members: Iterable[tuple[str, bytes]]) -> bytes:
    """A zip file; the same members give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


@F.pandas_udf(BinaryType())
def pack_parts(names, bodies):
    """A zip file of parallel arrays of names and binary bodies."""
    import pandas as pd

    return pd.Series([zipped((n, bytes(b)) for n, b in zip(ns, bs, strict=True)) for ns, bs in zip(names, bodies, strict=True)])


def rebuild(part_rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """Parts back to files, in their order."""
    held = part_rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "part", "data"))).alias("p"))
    return held.select(by, pack_parts(F.col("p.part"), F.col("p.data")).alias("content"))
