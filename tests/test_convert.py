"""Conversions end to end: files on disk, a broken one among them, and the file stream."""

import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.clean import objects_as_latex
from quillspark.plans.convert import questions, to_markdown, write_markdown
from quillspark.sources import docx as D
from quillspark.sources.tally import _tallies
from quillspark.streaming.ingest import convert_arriving

DOC = f'<w:document xmlns:w="{D.NS["w"]}" xmlns:m="{D.NS["m"]}"><w:body><w:p><w:r><w:t>1. 题干</w:t></w:r></w:p><m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath></m:oMathPara><w:p><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></w:p><w:p><w:r><w:t>【答案】B</w:t></w:r></w:p></w:body></w:document>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.docx", "a.DOCX", "~$b.docx"):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            z.writestr("word/document.xml", DOC)
    (tmp_path / "in" / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "other.txt").write_text("x")
    return tmp_path


def test_batch(spark, folder):
    docs = D.scan(spark, str(folder / "in"))
    listed = D.listing(docs, str(folder / "in"), "/out").collect()
    assert [(r["path"].rpartition("/")[2], r["out_path"]) for r in listed] == [("a.DOCX", "/out/a.md"), ("b.docx", "/out/b.md"), ("broken.docx", "/out/broken.md")]
    rows = sorted(to_markdown(docs).collect(), key=lambda r: r["error"] is not None)
    good = [r["md"] for r in rows if r["error"] is None]
    assert good == ["1. 题干\n$$\\dfrac{a}{b}$$\n$y$\n\n【答案】B\n"] * 2 or all("$$\\dfrac{a}{b}$$" in m and "$y$" in m for m in good)
    assert [r["error"] for r in rows if r["md"] is None] == ["no readable word/document.xml"]
    assert [f["formula_id"] for f in rows[0]["formulas"]] == ["001", "002"] and rows[0]["formulas"][0]["display"]
    found = questions(to_markdown(docs)).collect()
    assert {(q["index"], q["answer"]) for q in found} == {(1, "B")} and len({q["id"] for q in found}) == 2
    write_markdown(to_markdown(docs), str(folder / "out"))
    assert spark.read.parquet(str(folder / "out")).count() == 3


def test_objects_become_latex(spark):
    """An object that decodes goes into the text, and its part and relationships go; in Markdown by choice."""
    from test_mtef import char, compound, line, native

    from quillspark.plans.convert import without_objects

    data = compound("Equation Native", native(line(char("x"), char("+"), char("1"))) + bytes(300))
    names = " ".join(f'xmlns:{p}="{u}"' for p, u in D.NS.items() if p != "rel")
    shape = "<w:object><v:shape style='width:30pt;height:12pt'><v:imagedata r:id='r3'/></v:shape><o:OLEObject ProgID='Equation.DSMT4' r:id='r4'/></w:object>"
    xml = f"<w:document {names}><w:body><w:p><w:r><w:t>a</w:t></w:r><w:r>{shape}</w:r></w:p><w:p><w:r><o:OLEObject r:id='r9'/></w:r></w:p></w:body></w:document>"
    rels = f'<Relationships xmlns="{D.NS["rel"]}"><Relationship Id="r3" Target="media/m.wmf"/><Relationship Id="r4" Target="embeddings/o.bin"/><Relationship Id="r9" Target="embeddings/none.bin"/></Relationships>'
    content = D.zipped([("word/document.xml", xml.encode()), ("word/_rels/document.xml.rels", rels.encode()), ("word/media/m.wmf", b"w"), ("word/embeddings/o.bin", data)])
    docs = spark.createDataFrame([("d", content), ("none", b"no zip"), ("null", None)], "doc_id string, content binary")
    rows = {r["doc_id"]: r for r in without_objects(docs).collect()}
    assert bytes(rows["none"]["content"]) == b"no zip" and rows["null"]["content"] is None and rows["none"]["formulas"] == []
    assert [f["latex"] for f in rows["d"]["formulas"]] == ["x+1"]
    package = D.Package(bytes(rows["d"]["content"]))
    assert "word/embeddings/o.bin" not in package.items and b"$x+1$" in package.read("word/document.xml") and D.targets(package.read("word/_rels/document.xml.rels")) == {"r9": "embeddings/none.bin"}
    shown = {o: to_markdown(docs.where("doc_id = 'd'"), objects=o).first()["md"] for o in ("picture", "latex")}
    assert shown == {"picture": "a![001](image/formula001.wmf)\n", "latex": "a$x+1$\n"}


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_damage_never_raises(data):
    """Bytes changed, cut out or put in anywhere: parts and records come or don't, and nothing is raised."""
    whole = bytearray(D.zipped([("word/document.xml", DOC.encode()), ("word/_rels/document.xml.rels", b"<a/>"), ("word/media/\u00e9.png", b"y" * 50)]))
    for _ in range(data.draw(st.integers(1, 4))):
        at = data.draw(st.integers(0, len(whole) - 1))
        kind = data.draw(st.integers(0, 2))
        if kind == 0:
            whole[at] = data.draw(st.integers(0, 255))
        elif kind == 1:
            del whole[at : at + data.draw(st.integers(1, 30))]
        else:
            whole[at:at] = data.draw(st.binary(max_size=10))
        if not whole:
            whole = bytearray(b"PK")
    assert isinstance(list(D._members(bytes(whole))), list) and isinstance(list(_tallies(bytes(whole))), list)
    assert isinstance(objects_as_latex(bytes(whole), [])[1], list)


def test_damaged_files(spark):
    """Bytes that are no UTF-8, a cut zip, a damaged member: rows with errors, and the others go on."""
    from quillspark.operators.inspector import inspect, raw_counts

    whole = D.zipped([("word/document.xml", DOC.encode()), ("word/media/a.png", b"y")])
    latin = D.zipped([("word/document.xml", b"<w:document>\xff PAGE </w:document>")])
    at = whole.find(b"word/document.xml") + 40
    torn = whole[:at] + b"\xff" * 20 + whole[at + 20 :]
    docs = spark.createDataFrame([("good", whole), ("latin", latin), ("torn", torn), ("cut", whole[:50]), ("null", None), ("empty", D.zipped([]))], "doc_id string, content binary")
    rows = {r["doc_id"]: r for r in inspect(docs).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"good": None, "latin": "word/document.xml is no XML", "torn": "no word/document.xml", "cut": "no zip file", "null": "no zip file", "empty": "no word/document.xml"}
    assert rows["good"]["o_math_para"] == 1 and rows["latin"]["page_fields"] == 1 and rows["torn"]["media"] == 1 and rows["cut"]["summary"]
    assert {r["doc_id"]: r["page_fields"] for r in raw_counts(D.parts(docs)).collect() if r["page_fields"] is not None} == {"good": 0, "latin": 1}
    assert {r["doc_id"]: r["error"] is None for r in to_markdown(docs).collect()} == {"good": True, "latin": False, "torn": False, "cut": False, "null": False, "empty": False}


def test_stream(spark, folder):
    for _ in range(2):
        convert_arriving(spark, str(folder / "in"), str(folder / "stream"), str(folder / "marks")).awaitTermination(60)
    assert spark.read.parquet(str(folder / "stream")).count() == 2  # b.docx and broken.docx; the glob is case-sensitive


def test_few_bytes_of_many_files_are_many_tasks(spark):
    """Adaptive execution doesn't put the rewriting of small files into one task."""
    from pyspark.sql import functions as F
    from quillspark.plans import convert_queries
    from quillspark.plans.convert import without_objects

    made = without_objects(convert_queries._pictured(spark, "/root/testdata/sf0.01"), "s_suppkey")
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
