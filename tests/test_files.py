"""Folders scanned and written: names of any kind, failed tasks, repeated runs; addresses as JavaScript has them."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import uris as U
from quillspark.plans import batch, folders
from quillspark.plans.convert import parse_papers
from quillspark.sources.files import MARKER, FileWriter, checked, scan_files, write_files

FILES = "path string, data binary"


def listed(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("sub", ["in/in", "exam (1)", "a b/图 é", "x%20y", "[q]{z},w", "a\\b"])
def test_round_trip(spark, tmp_path, sub):
    root = tmp_path / sub
    rows = [("p1/a (1).md", b"x"), ("in/in/b%20c.md", b"z"), ("p2/图/[1].png", b"yy"), ("p2/none", None)]
    write_files(spark.createDataFrame(rows, FILES).repartition(3), str(root))
    assert listed(root) == {p: d for p, d in rows if d is not None} | {MARKER: json.dumps({"files": 3, "bytes": 4}).encode()}
    assert sorted((r["path"], bytes(r["content"])) for r in scan_files(spark, str(root)).collect()) == sorted((p, d) for p, d in rows if d is not None)
    assert [r["path"] for r in scan_files(spark, str(root) + "/", "*.png").collect()] == ["p2/图/[1].png"]
    write_files(spark.createDataFrame([("p1/a (1).md", b"new")], FILES), str(root))
    assert listed(root)["p1/a (1).md"] == b"new" and "in/in/b%20c.md" in listed(root)


def test_names_stay_out_of_the_driver(spark, tmp_path):
    """As Spark's own source finds them, but in splits of many files and without a list of them in the plan; large contents come in several batches."""
    from quillspark.sources.files import _spark_files, qualified

    root = tmp_path / "a,{b}"
    odd = ["_SUCCESS", ".x/y.md", "_x/y.md", "_a=b/c.md", "_metadata", "_metadata.d/z.md", "p/._z", "p/q._COPYING_", "p/q/r/s/t.MD", "p/empty.md", "p/a%20b [1].png", "图/é.md"]
    data = {**{f"d{k}/n{k}.md": b"x%d" % k for k in range(40)}, **{o: b"odd" for o in odd}, "p/empty.md": b"", **{f"big/{k}": bytes([k]) * 3_000_000 for k in range(5)}}
    for path, content in data.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "none.md").symlink_to(root / "nowhere")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for pattern in (None, "*.[mM][dD]", "{n1,n2}?.*", "[^n]*"):
            made = scan_files(spark, str(root), pattern)
            told = lambda df: sorted((r["path"], r["length"], r["modificationTime"].replace(microsecond=0), bytes(r["content"])) for r in df.collect())
            assert told(made) == told(_spark_files(spark, qualified(spark, str(root)), pattern, True))
        assert [r["path"] for r in scan_files(spark, str(root / "p"), recursive=False).collect()] == ["a%20b [1].png"]
        names = scan_files(spark, str(root))
        assert names.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        plan = names._jdf.queryExecution().optimizedPlan()
        assert "quill_names" in plan.toString() and int(plan.stats().sizeInBytes()) > 1 << 40
        (root / "p/q/r/s/t.MD").unlink()
        assert names.select("path").where("path LIKE 'p/q/%'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="nothing here"):
        scan_files(spark, str(tmp_path / "nothing here")).count()


def test_failed_tasks_leave_nothing(spark, tmp_path):
    write_files(spark.createDataFrame([("a/x", b"old")], FILES), str(tmp_path))

    def rows():
        yield {"path": "a/x", "data": b"new"}
        yield {"path": "b/y", "data": b"z"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        FileWriter(f"file:{tmp_path}").write(rows())
    assert {k: v for k, v in listed(tmp_path).items() if k != MARKER} == {"a/x": b"old"}
    with pytest.raises(Exception, match="not a path below"):
        write_files(spark.createDataFrame([("a/ok", b"1"), ("../out", b"2")], FILES).coalesce(1), str(tmp_path))
    assert not (tmp_path.parent / "out").exists() and not [k for k in listed(tmp_path) if k.startswith("a/.")]
    for path in ("", "/a", "a//b", "a/", ".", "a/../b"):
        with pytest.raises(ValueError):
            checked(path)


def test_folders_are_papers(spark, tmp_path):
    text = "1. a ![x](img/%E5%9B%BE.png)\n【答案】b".encode()
    rows = [("in/a.md", text), ("in/img/图.png", b"1"), ("in/in/z.md", b"9. no"), ("in (1)/a.md", text), ("in (1)/in/img/图.png", b"2"), ("loose.md", text)]
    root = tmp_path / "in" / "in"
    write_files(spark.createDataFrame(rows, FILES), str(root))
    made = {r["doc_id"]: r for r in folders.parse_folders(folders.scan_folders(spark, str(root))).collect()}
    assert set(made) == {"in", "in (1)"} and all(r["missing"] == [] for r in made.values())
    assert "base64,MQ==" in made["in"]["questions"][0]["stem_html"] and "base64,Mg==" in made["in (1)"]["questions"][0]["stem_html"]
    one = folders.parse_folders(folders.scan_folders(spark, str(root / "in"), each=False)).collect()
    assert [r["doc_id"] for r in one] == ["in"] and "base64,MQ==" in one[0]["questions"][0]["stem_html"]
    batch.write_papers(spark, str(root), str(tmp_path / "out"))
    assert {k for k in listed(tmp_path / "out") if k != MARKER} == {"in.json", "in (1).json"}
    assert json.loads(listed(tmp_path / "out")["in.json"])["unresolvedImages"] == []


def test_contents_are_joined_once(spark, tmp_path):
    """No contents below the explosion of keys."""
    write_files(spark.createDataFrame([("a/a.md", b"1. x"), ("a/i.png", b"1")], FILES), str(tmp_path))
    plan = folders.parse_folders(folders.scan_folders(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Generate explode" in line and "key" in line:
            assert "content" not in line and "base64" not in line


def test_other_columns_are_no_notices(spark):
    rows = spark.createDataFrame([("d", "1. a\n【答案】b", 99, ["x"])], "doc_id string, text string, keys long, missing array<string>")
    plain = parse_papers(rows.select("doc_id", "text")).select("notices").first()
    assert parse_papers(rows).select("notices").first() == plain
    assert parse_papers(rows, keys="keys", missing="missing").select("notices").first() != plain


def test_rewriting_onto_the_source(spark, tmp_path):
    with pytest.raises(ValueError, match="source"):
        batch.rewrite_folder(spark, str(tmp_path), f"file:{tmp_path}/")


def test_addresses(spark):
    cases = {
        "a%20b+c": ("a b+c", "a b+c", "a%20b+c"), "%E5%9B%BE": ("图", "图", "%E5%9B%BE"), "%zz": (None, None, "%zz"), "%E5%9B": (None, None, "%E5%9B"), "a%2Fb": ("a/b", "a%2Fb", "a%252Fb"), "%ED%A0%80": (None, None, "%ED%A0%80"),
        "�%20": ("� ", "� ", "%EF%BF%BD%20"), "%EF%BF%BD": ("�", "�", "%EF%BF%BD"), "~!*'();/?:@&=+$,#-_.": ("~!*'();/?:@&=+$,#-_.",) * 3, "": ("", "", ""), "é 𝒳": ("é 𝒳", "é 𝒳", "%C3%A9%20%F0%9D%92%B3"),
    }
    t = F.col("t")
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(t, U.decode_component(t), U.decode_uri(t), U.normal_uri(t)).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == cases


def test_rows_are_dealt_out(spark, tmp_path):
    """One row group in more splits than cores is one task's work, unless rows are dealt out by their number."""
    from quillspark.plans import docx_queries, paper_queries, repair_queries
    from quillspark.sources import tables

    def sizes(df):
        return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())

    n = 40_000
    k = F.col("id")
    made = {
        "orders": spark.range(n).select(k.alias("o_orderkey"), (k % 7).alias("o_custkey")), "part": spark.range(n).select(k.alias("p_partkey"), F.lit("p").alias("p_name"), (k % 50).alias("p_size")),
        "supplier": spark.range(n).select(k.alias("s_suppkey"), F.lit("s").alias("s_name")),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = tables.table(spark, str(tmp_path), "supplier")
        assert one.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sizes(tables.spread(one)) == [n]
        assert len(sizes(tables.spread(one, 5_000))) == 8 and max(sizes(tables.spread(one, 5_000))) < 6_000
        for df in (paper_queries.papers(spark, str(tmp_path)), repair_queries._part(spark, str(tmp_path), x=F.col("p_size")), docx_queries.files(one, "s_suppkey", {"a": F.col("s_name")})):
            assert max(sizes(df)) < n // 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_keys_of_pictures_are_dealt_out(spark):
    """Adaptive execution doesn't join the partitions in which the keys are sorted."""
    from quillspark.operators import assets as A

    refs = spark.createDataFrame([(1, "image/a.png")], "paper long, src string")
    made = A.resolve(refs, spark.createDataFrame([(1, "x/a.png", "u", 1)], "paper long, path string, url string, seq long"), ["paper"])
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString() and made.first()["url"] == "u"
