"""Table and scalar functions in SQL, with their checks and damaged input."""

import pytest

from quillspark.functions.table_functions import register
from quillspark.sources.docx import zipped


@pytest.fixture
def sql(spark):
    register(spark)
    return lambda text, **tables: [tuple(r) for r in spark.sql(text, **tables).collect()]


def test_parts_and_nodes(spark, sql):
    good = zipped([("a.xml", b"<r x='1'>t<c/>u</r>"), ("b/c.bin", b"\x00")])
    files = spark.createDataFrame([(1, good), (2, b"no zip"), (3, None)], "id int, content binary")
    assert sql("SELECT id, p.ord, p.part, p.data FROM {f}, LATERAL docx_parts(content) p ORDER BY p.ord", f=files) == [(1, 0, "a.xml", b"<r x='1'>t<c/>u</r>"), (1, 1, "b/c.bin", b"\x00")]
    assert sql("SELECT p.part FROM {f}, LATERAL docx_parts(content, 'b/') p", f=files) == [("b/c.bin",)]
    nodes = sql("SELECT n.local, n.parent_id, n.last_desc, n.attrs['x'], n.text, n.tail FROM {f}, LATERAL docx_parts(content, 'a') p, LATERAL xml_nodes(p.data) n ORDER BY n.node_id", f=files)
    assert nodes == [("r", -1, 1, "1", "t", ""), ("c", 0, 1, None, "", "u")]
    assert sql("SELECT * FROM xml_nodes(CAST('<a' AS BINARY))") == [] == sql("SELECT * FROM docx_parts(CAST(NULL AS BINARY))")


def test_arguments_are_checked(spark, sql):
    for text in ("SELECT * FROM docx_parts('x')", "SELECT * FROM docx_parts(CAST('x' AS BINARY), 1)", "SELECT * FROM xml_nodes(1)"):
        with pytest.raises(Exception, match="docx_parts|xml_nodes"):
            sql(text)


def test_scalars(sql):
    assert sql("SELECT mathml_to_latex('<math><mi>&pi;</mi></math>'), mathml_to_latex('<'), html_to_md('<h2>a</h2>'), ole_to_latex(CAST('x' AS BINARY)).latex, latex_prepare('$a$')") == [("\\pi", None, "## a", "【无法提取】", "$a$")]
