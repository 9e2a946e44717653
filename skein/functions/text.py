"""Text functions as Column expressions; all stay inside code generation.

Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Single characters and words that are no keywords, and the English ones of the composite reranker.
STOP_CHARACTERS = "的 了 是 在 和 与 或 等 中 上 下 为 有 以 及 将 对 从 到 由 被 把".split()
STOP_WORDS = "the a an and or but in on at to for of with by from as is was are were be".split()
FEW_STOP_WORDS = "the a an and or but in on at to for".split()
# Words that the LIKE search drops, in two languages.
LIKE_STOP_WORDS = (
    "的 了 和 是 就 都 而 及 与 着 或 一个 没有 我们 你们 他们 它 解释 是什么 含义 文章 图片 这个 篇 请问 以及 什么 如何 怎么 为什么 分析 介绍 描述 "
    "what is the of in and to a an are explain describe tell me about how why paper article"
).split()


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def terms(text: Column) -> Column:
    """The distinct lower-cased stretches between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != ""))


def keywords(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Single CJK characters and lower-cased Latin words of two letters or more, without stop words."""
    cjk = F.regexp_extract_all(text, F.lit("[一-鿿]"), F.lit(0))
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_like(w, F.lit("^[a-z]{2,}$")))
    return F.array_except(F.array_distinct(F.concat(cjk, latin)), F.array(*map(F.lit, [*STOP_CHARACTERS, *stop_words])))


def proper_nouns(text: Column) -> Column:
    """Capitalised words, runs of capitals and runs of two CJK characters or more."""
    capitalised = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.regexp_like(w, F.lit("^[A-Z][a-z]+$")))
    return F.array_distinct(F.concat(capitalised, F.regexp_extract_all(text, F.lit("[A-Z]{2,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))))


def token_overlap(query: Column, content: Column) -> Column:
    """80 where one text contains the other, ignoring case; else the percentage of the query's terms that the content has; 0 without terms."""
    q, c = F.lower(query), F.lower(content)
    t = terms(query)
    share = F.when(F.size(t) > 0, 100.0 * F.size(F.array_intersect(t, terms(content))) / F.size(t)).otherwise(0.0)
    return F.when(F.contains(c, q) | F.contains(q, c), F.lit(80.0)).otherwise(share)


def length_score(content: Column) -> Column:
    """100 from 200 to 600 characters, less for shorter and longer texts, never below 50."""
    n = F.length(content)
    return F.when(n < 200, 50 + 50.0 * n / 200).when(n <= 600, 100.0).otherwise(100 - F.least(F.lit(50.0), (n - 600) / 20.0))


def normal_name(name: Column) -> Column:
    """An entity name in lower case without leading article, trailing company form or punctuation, white space squeezed."""
    x = F.lower(F.trim(name))
    x = F.regexp_replace(x, r"^(the|a|an)\s+", "")
    x = F.regexp_replace(x, r"\s+(inc|llc|ltd|corp|corporation|company)\.?$", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slug(name: Column) -> Column:
    """A name as part of a path: trimmed, lower-cased, spaces as "-", only letters, digits, "-" and "_"; null where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), " ", "-"), r"[^\p{L}\p{N}_-]", "")
    return F.nullif(x, F.lit(""))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def final_answer(text: Column) -> Column:
    """What FINAL(...) holds in triple or single quotes of either kind, the first kind that matches; null without one."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r'(?s)FINAL\("""(.*?)"""\)', r"(?s)FINAL\('''(.*?)'''\)", r'(?s)FINAL\("([^"]*)"\)', r"(?s)FINAL\('([^']*)'\)")]
    return F.coalesce(*found)


def final_variable(text: Column) -> Column:
    """The name in FINAL_VAR(name), or null."""
    return F.nullif(F.regexp_extract(text, r"FINAL_VAR\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)", 1), F.lit(""))


def response_quality(text: Column, success_ratio: Column | None = None) -> Column:
    """A score from 0 to 1 of a response's form: its length, its structure (headings, lists, bold, numbers), its sentences, and the share of code blocks that ran."""
    n = F.length(text)
    score = F.when((n >= 300) & (n <= 3000), 0.3).when(n > 100, 0.15).otherwise(0.0)
    for p in (r"(?m)^#+\s", r"(?m)^\s*[-*]\s", r"(?m)^\s*\d+\.\s", r"\*\*.*?\*\*"):
        score = score + F.when(F.regexp_like(text, F.lit(p)), 0.05).otherwise(0.0)
    if success_ratio is not None:
        score = score + 0.2 * F.coalesce(success_ratio, F.lit(0.0))
    sentences = F.size(F.regexp_extract_all(text, F.lit(r"[.!?]+"), F.lit(0)))
    score = score + F.when(sentences >= 3, 0.1).otherwise(0.0) + F.when(sentences >= 6, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(score, 6))


def report_score(text: Column) -> Column:
    """The first "n/100" or "score: n" of a report, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int") for p in (r"(\d{1,3})\s*/\s*100", r"(?i)score[:\s]+(\d{1,3})")])


def report_grade(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").when(score.isNotNull(), "Poor")


def code_blocks(text: Column) -> Column:
    """The contents of all fenced python blocks, or of all fenced blocks where there are none."""
    python = F.regexp_extract_all(text, F.lit(r"(?s)```python\s*\n(.*?)```"), F.lit(1))
    return F.when(F.size(python) > 0, python).otherwise(F.regexp_extract_all(text, F.lit(r"(?s)```[a-z]*\s*\n(.*?)```"), F.lit(1)))


def named_phrases(text: Column) -> Column:
    """Seeds for graph expansion: runs of two to four capitalised words, and quoted stretches of 2 to 30 characters."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+){1,3}"), F.lit(0))
    quoted = F.regexp_extract_all(text, F.lit(r'"([^"]{2,30})"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(runs, quoted)))
