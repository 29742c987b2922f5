"""Picture references resolved by equi-joins: keys, last writer wins, first candidate wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import base_key, path_key
from ..functions.regex import JS_SPACE, let, rewrite_matches, strip
from ..functions.uris import decode_component, normal_uri
from ..sources.tables import dealt

# Folders under which a picture is commonly referred to.
FOLDERS = ["image", "images", "img", "imgs", "media", "assets", "pic", "pics", "static", "figures", "figure"]


def keys_of(path: Column) -> Column:
    """All keys under which a picture is registered: every suffix and the common folders, with ./ too."""

    def made(norm: Column) -> Column:
        parts = F.filter(F.split(norm, "/", -1), lambda x: x != "")
        suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        folders = F.array(*(F.concat(F.lit(f"{d}/"), base_key(norm)) for d in FOLDERS))
        plain = F.concat(F.array(norm), suffixes, folders)
        dotted = F.transform(plain, lambda k: F.concat(F.lit("./"), k))
        return F.array_distinct(F.concat(plain, dotted, F.array(base_key(norm))))

    return let(path_key(path), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(made(n)))


def is_direct(src: Column) -> Column:
    """Whether a reference holds its picture or says where on the web it is."""
    return strip(src, JS_SPACE).rlike(r"(?i)\A(https?:|data:|blob:)")


def _both(*keys: Column) -> Column:
    """Each key with and without ``./``, once each, in order; null and empty ones are none."""
    each = F.filter(F.array(*keys), lambda k: F.coalesce(k, F.lit("")) != "")
    return F.array_distinct(F.flatten(F.transform(each, lambda k: F.array(k, F.concat(F.lit("./"), k)))))


def resolve(refs: DataFrame, assets: DataFrame, by: list[str]) -> DataFrame:
    """``refs(by, src)`` with the ``url`` of the same document's ``assets(by, path, url, seq)`` or null; http and data stay, as normal addresses.

    A reference is tried as it stands, by its last segment, both with its escapes decoded, and without ``/./``.
    All fallbacks of a reference need the same last segment, so after the exact candidates one
    equi-join on it is left.  Keys are reduced to their last writer before the join.  All keys hold the document and
    the path, so one document with very many pictures is spread over all tasks.
    """
    keys = assets.select(*by, F.explode(keys_of(F.col("path"))).alias("key"), "url", "seq")
    # dealt out before they are sorted, as hardly any key is told twice and tasks that adaptive execution joins sort many keys at once
    last = dealt(keys, *by, "key").groupBy(*by, "key").agg(F.max_by("url", "seq").alias("hit"))
    bases = assets.groupBy(*by, base_key(F.col("path")).alias("base")).agg(F.min_by("url", "seq").alias("near"))
    src = F.replace(strip(F.col("src"), JS_SPACE), F.lit("\\"), F.lit("/"))
    direct = is_direct(F.col("src"))
    candidates = let(src, lambda s: let(decode_component(s), lambda d: _both(path_key(s), base_key(s), path_key(d), base_key(d), path_key(F.replace(s, F.lit("/./"), F.lit("/"))))))
    tried = refs.select(*by, "src", F.posexplode(candidates).alias("pos", "key")).join(last, [*by, "key"])
    best = tried.groupBy(*by, "src").agg(F.min_by("hit", "pos").alias("hit"))
    joined = refs.withColumn("base", base_key(src)).join(best, [*by, "src"], "left").join(bases, [*by, "base"], "left")
    return joined.withColumn("url", F.when(direct, normal_uri(src)).otherwise(F.coalesce("hit", "near"))).drop("base", "hit", "near")


def unresolved(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Each document's references without a picture, once each."""
    return resolved.where("url is null").select(*by, "src").distinct()


def rewrite_images(docs: DataFrame, images: DataFrame, by: list[str], text: str, folder: str) -> DataFrame:
    """``![..](..)`` by file name, else stem, else number, as ``folder/name``; others stay.

    ``images(by, name, seq)``: ``seq`` is the picture's number.  A document's images are one small
    map; formula and glyph pictures only get the folder where they have none.
    """
    named = images.select(*by, F.lower("name").alias("k"), "name", "seq")
    stem = images.select(*by, F.lower(F.regexp_replace("name", r"\.[^.]*\z", "")).alias("k"), "name", "seq")
    number = images.select(*by, F.format_string("#%03d", F.col("seq").cast("int")).alias("k"), "name", "seq")
    keys = named.unionByName(stem).unionByName(number).groupBy(*by, "k").agg(F.max_by("name", "seq").alias("name"))
    table = keys.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("__names"))

    joined = docs.join(table, by, "left")
    return joined.withColumn(text, F.when(F.col("__names").isNull(), F.col(text)).otherwise(rewritten(F.col(text), F.col("__names"), folder))).drop("__names")


def rewritten(text: Column, names: Column, folder: str) -> Column:
    """The text with its picture links rewritten by a map of lower-case names, stems and ``#`` numbers to names."""

    def one(match: Column) -> Column:
        alt, path = F.regexp_extract(match, r"!\[([^\]]*)\]\(([^)]+)\)", 1), F.regexp_extract(match, r"!\[([^\]]*)\]\(([^)]+)\)", 2)
        norm = F.replace(F.regexp_replace(F.element_at(F.split(F.trim(path), " "), 1), "[\"']", ""), F.lit("\\"), F.lit("/"))
        base = F.element_at(F.split(norm, "/", -1), -1)
        file = F.lower(base)
        digits = F.regexp_extract(file, r"image([0-9]+)", 1).try_cast("int")
        name = F.coalesce(
            F.try_element_at(names, file), F.try_element_at(names, F.regexp_replace(file, r"\.[^.]*\z", "")), F.when(digits.isNotNull(), F.try_element_at(names, F.format_string("#%03d", digits)))
        )
        own = file.rlike(r"\A(formula|glyph)[0-9]+\.(png|wmf|emf)\z")
        link = lambda x: F.concat(F.lit("!["), alt, F.lit(f"]({folder}/"), x, F.lit(")"))
        return F.when(own & norm.contains("/"), match).when(own, link(base)).when(name.isNull(), match).otherwise(link(name))

    return let(text, lambda t: rewrite_matches(t, r"!\[[^\]]*\]\([^)]+\)", one))
