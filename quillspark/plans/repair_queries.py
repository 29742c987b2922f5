"""Queries over broken LaTeX built from table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fragment as H
from ..operators import latex_repair as R
from ..sources.tables import TEXTS, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _part(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), TEXTS).select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def _s(*xs):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))


N = F.col


@query(r"""SELECT p_partkey, '\frac{' || p_size || '}{b} \left\{x\right\} {y} z' AS fixed, '\frac' || p_size AS single, '\left\{' || p_size || ',3 \right\}' AS closed FROM part""")
def tex_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N("p_size")
    return _part(spark, sf_dir, fixed=R.tex_fix(_s(r" <b>\frac { ", n, r" } { b } \left{x\right} { y }   z ")), single=R.tex_fix(_s(r"\\frac", n)), closed=R.tex_fix(_s(r"\left\{", n, r",3} \right")))


@query(r"""SELECT p_partkey, '\sin x(' || p_size || ')\mathrm{a}{b}<' AS tex FROM part""")
def tex_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, tex=R.tex_normalize(_s("sin x（", N("p_size"), r"）\rm{a}{{b}}&lt;")))


@query(r"""SELECT p_partkey, '\begin{cases} a \\ ' || p_size || ' \end{cases} x>0' AS cases, '\begin{cases}b \\ c\end{cases}' AS nested, 'q\begin{array}{l}\end{array}' AS ends FROM part""")
def tex_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _s(r"\left\{ \begin{array}{l} a \\ ", N("p_size"), r" \end{array} x>0 \right.")
    return _part(spark, sf_dir, cases=R.tex_cases(one), nested=R.tex_cases(F.lit(r"\left\{\begin{array}{l}\begin{array}{c}b \\ c\end{array}\end{array}\right.")), ends=R.tex_cases(F.lit(r"q\end{array}\begin{array}{l}\end{array}\end{array}")))


@query(r"""SELECT p_partkey, '\left\{x \mid y=\sqrt{' || p_size || '}\right\}' AS sets FROM part""")
def tex_setbuilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, sets=R.tex_sets(_s(r"\left\{ \begin{array}{l} x \left| { y=\sqrt{", N("p_size"), r"} } \right. \end{array} \right\}")))


@query(r"""SELECT p_partkey, 'a ⟨x^' || p_size || '⟩ b c ⟨\begin{array}{l}1' || chr(10) || '2\end{array}⟩ $ d' AS marked FROM part""")
def inline_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, marked=R.inline_marked(_s("a $x^", N("p_size"), "$ b c $\\begin{array}{l}1\n2\\end{array}$ $ d")))


@query(r"""SELECT p_partkey, '$\frac{' || p_size || '}{2}$' AS bare, 'k $\frac{1}{' || p_size || '}$ t' AS opened, '$\frac{a}$ $\frac{b}$$' AS apart FROM part""")
def recover_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N("p_size")
    return _part(spark, sf_dir, bare=R.dollars_recovered(_s(r"\frac{", n, "}{2}")), opened=R.dollars_recovered(_s(r"k \frac{1}{", n, "}$ t")), apart=R.dollars_recovered(F.lit(r"$\frac{a}$$\frac{b}$")))


@query(r"""SELECT p_partkey, 'A. $\frac{' || p_size || '}{2}$ B. ' || p_size || chr(10) || 'C. 约$\pi$ D. $x$' AS wrapped FROM part""")
def wrap_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N("p_size")
    return _part(spark, sf_dir, wrapped=R.options_wrapped(_s(r"A. \frac { ", n, r" } { 2 } B. ", n, "\n", r"C. 约\pi D. \(x\)")))


@query(r"""SELECT p_partkey, 'A<' || p_size || '&中 "' AS decoded FROM part""")
def decode_numeric_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, decoded=R.entities_decoded(_s("&#65;&lt;", N("p_size"), "&amp;&#x4e2d; &quot;")))


@query(
    """SELECT p_partkey, '<h3 class="md-h">' || p_name || '</h3><br/><strong>b</strong> <span class="katex">x^' || p_size || '</span> &lt; <img src="a b.png" alt="题目配图" loading="lazy" /><br/>A. y' AS html FROM part"""
)
def markdown_fragment_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, html=H.fragment_html(_s("# ", N("p_name"), "\n**b** $x^", N("p_size"), '$ < ![](<a b.png> "t")\nA. y ')))
