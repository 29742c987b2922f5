"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; one small file is dealt out over the cores."""
    return spread(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licences

    found = licences(documents(spark, sf_dir))
    sure = F.filter("found", lambda x: x["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_licences"),
        F.array_join(families, ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",").alias("spans"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "host", "path", "score", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import NearDup, near_dedup

    return near_dedup(documents(spark, sf_dir), NearDup(words=5, percent=85)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    found = secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(told(F.filter("found", lambda s: s["base"])), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), told(F.col("found")).alias("spans"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_score

    return lm_score(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(spread(table(spark, sf_dir, "pages")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_quality_classifier, op3_line_dedup, op4_best_fit_packing, op5_minhash_near_dedup, op6_decontamination, op7_toxicity, op8_secret_scan, op9_lm_score, op10_exact_dedup, op11_html_extraction, op12_ranked_search, op13_prefix_trie)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z lower-cased; the six ASCII white-space characters.
FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
#: Terms of ranked search.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

SQL = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, ord, line, trim({FOLD.format("line")}, {SPACE}) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)),
hot AS (SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.ord, l.line, (h.k IS NOT NULL AND h.last_id <> l.doc_id) AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({FOLD.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN []
    WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS sh FROM s WHERE len(g) > 0),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(g) AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) m ON s.doc_id = m.x""",
    "op10_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)""",
    "op12_ranked_search": f"""
WITH d AS (
  SELECT doc_id, no, a, len(a) AS n
  FROM (SELECT doc_id, row_number() OVER () AS no, regexp_extract_all({FOLD.format("text")}, '{TERM}') AS a FROM documents WHERE text IS NOT NULL)
  WHERE len(a) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
asked AS (
  SELECT no, item_id, t, count(*) AS r
  FROM (SELECT row_number() OVER () AS no, item_id, unnest(regexp_extract_all({FOLD.format("text")}, '{TERM}')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT no AS doc_no, doc_id, n, t, count(*) AS tf FROM (SELECT no, doc_id, n, unnest(a) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (
  SELECT no, item_id, doc_no, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM asked JOIN p USING (t) JOIN w USING (t), g GROUP BY no, item_id, doc_no, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, max(pos) AS own,
         xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
             lambda crc, c: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, c)),
             4294967295), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, t.pos AS part, t.r, t.x FROM convs c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos + 1000000 AS part, t.r, t.x FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (SELECT conv_id, list(sha256(length(r) || ':' || r || x) ORDER BY part) AS path, list(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) ORDER BY part) AS words FROM rebuilt GROUP BY conv_id),
full_convs AS (SELECT c.conv_id, coalesce(s.path, []) AS path, coalesce(s.words, []) AS words FROM convs c LEFT JOIN s USING (conv_id)),
steps AS (SELECT conv_id, path, words, unnest(range(0, len(path) + 1)) AS depth FROM full_convs),
keyed AS (SELECT conv_id, depth, array_to_string(path[1:depth], ',') AS k, array_to_string(path[1:depth - 1], ',') AS up, len(path) = depth AS ended,
                 CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS n_words FROM steps),
nodes AS (SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_words) AS n_words,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM keyed GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT a.depth, a.k, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.n_words) AS saved_tokens
  FROM nodes n LEFT JOIN kids c ON c.depth = n.depth AND c.k = n.k JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.k = n.k
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = n.up
LEFT JOIN kids c ON c.depth = n.depth AND c.k = n.k""",
}
