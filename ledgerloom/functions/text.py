"""Parsers of cells, titles and URLs as column expressions (no Python in the plan), and Arrow UDFs where Spark has no function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Signs and word lists of the documents' language.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
SAME_AS_ABOVE = ("同上", "同 上", "〃")
SCHOOL_ALIASES = {
    "sysu": ("sysu", "中山大学", "中大", "中山"),
    "scut": ("scut", "华南理工大学", "华工", "华南理工"),
    "jnu": ("jnu", "暨南大学", "暨大", "暨南"),
    "scnu": ("scnu", "华南师范大学", "华师", "华南师范", "华南师大"),
}
DOC_TYPES = (
    ("推免.*(?:名单|名册)|接收推免", "tm_admit_list"),
    ("拟录取|录取名单|录取结果", "admission_list"),
    ("复试名单|入围|复试结果|复试成绩", "retest_list"),
    ("推免.*目录", "tm_catalog"),
    ("专业目录", "catalog"),
    ("简章|章程", "brochure"),
    ("分数线|基本要求|成绩要求", "score_line"),
    ("复试", "retest_rules"),
    ("推免|推荐免试", "tm_policy"),
    ("初试科目|科目调整", "subject_change"),
    ("计划", "plan_quota"),
    ("学费|奖助", "fees"),
)
PERSONAL_TITLE = "名单|名册|复试结果|录取结果|成绩公示|拟录取.{0,12}公示|公示.{0,12}拟录取"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or NULL without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def clean(text: Column) -> Column:
    """STR-01: ideographic and no-break spaces as spaces, trimmed of all white space; NULL is empty."""
    return F.coalesce(F.regexp_replace(F.translate(text, "　 ", "  "), r"(?U)^\s+|\s+$", ""), F.lit(""))


def compact(text: Column, also: str = "") -> Column:
    """STR-02: without white space (and without the characters of ``also``)."""
    return F.regexp_replace(text, rf"(?U)[\s{re.escape(also)}]+", "")


def parse_count(text: Column) -> Column:
    """STR-03: struct(value, is_upper_bound, pool_scope): a pooled sum in brackets, an upper bound, or digits; else no value."""
    raw = compact(clean(text))
    pooled = r"^[（(]?(\d{4})合计[≤＜<]?=?(\d+)[)）]?$"
    upper = r"^(?:≤|<=|＜=|不超过)(\d+)$"
    digits = r"^(\d+)$"
    value = F.coalesce(extract(raw, pooled, 2), extract(raw, upper), extract(raw, digits)).cast("int")
    bound = (raw.rlike(pooled) & raw.rlike("[≤<＜]")) | raw.rlike(upper)
    return F.struct(value.alias("value"), F.coalesce(bound, F.lit(False)).alias("is_upper_bound"), extract(raw, pooled).alias("pool_scope"))


def parse_total_quota(text: Column) -> Column:
    """STR-04: ``48(17)`` is (48, 17), ``20`` is (20, NULL)."""
    raw = compact(clean(text))
    pattern = r"^(\d+)(?:[（(](\d+)[)）])?$"
    return F.struct(extract(raw, pattern).cast("int").alias("total"), F.when(extract(raw, pattern, 2) != "", extract(raw, pattern, 2)).cast("int").alias("quota"))


def split_subjects(text: Column) -> Column:
    """STR-05: array of struct(code, name): parts that begin with three digits, between circled numbers, lines, wide spaces,
    or a space from a Chinese character or bracket to three digits."""
    border = rf"[{CIRCLED}\n\r]+|\s{{2,}}|(?<=[一-鿿）)])\s+(?=\d{{3}})"
    parts = F.transform(F.split(clean(text), border), lambda x: F.regexp_replace(x, rf"^[{CIRCLED}\s]+|\s+$", ""))
    own = r"^(\d{3})\s*(.+)$"
    return F.transform(F.filter(parts, lambda x: x.rlike(own)), lambda x: F.struct(F.regexp_extract(x, own, 1).alias("code"), F.regexp_extract(x, own, 2).alias("name")))


def program_code(text: Column) -> Column:
    """STR-06: four digits and two digits or capitals, else NULL."""
    raw = F.upper(compact(clean(text)))
    return F.when(raw.rlike(r"^\d{4}[0-9A-Z]{2}$"), raw)


def subject_lines(text: Column) -> Column:
    """STR-07: four numbers as they are, of three the last twice, else NULLs; a trailing bracket is the note."""
    raw = clean(text)
    note = r"[（(]([^）)]*)[）)]\s*$"
    numbers = F.regexp_extract_all(F.regexp_replace(raw, note, ""), F.lit(r"\d+"), 0)
    n = F.size(numbers)
    at = lambda i, j: F.when(n == 4, F.try_element_at(numbers, F.lit(i))).when(n == 3, F.try_element_at(numbers, F.lit(j))).cast("int")
    return F.struct(at(1, 1).alias("s1"), at(2, 2).alias("s2"), at(3, 3).alias("s3"), at(4, 3).alias("s4"), F.coalesce(extract(raw, note), F.lit("")).alias("note"))


def college_name(text: Column) -> Column:
    """STR-08: leading three digits are the code, a trailing bracket the campus."""
    raw = clean(text)
    campus = r"[（(]([^）)]+)[）)]\s*$"
    rest = clean(F.regexp_replace(raw, campus, ""))
    own = r"^(\d{3})\s*(.+)$"
    return F.struct(extract(rest, own).alias("code"), F.coalesce(extract(rest, own, 2), rest).alias("name"), extract(raw, campus).alias("campus"))


def source_urls(text: Column) -> Column:
    """STR-09: parts between `` ; ``, each up to its first bracket, without the empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+;\s+|;\s*$"), lambda x: clean(F.regexp_replace(x, r"(?s)[（(].*$", "")))
    return F.filter(parts, lambda x: x != "")


def leading_year(text: Column) -> Column:
    """DAT-01."""
    return extract(clean(text), r"^(\d{4})").cast("int")


def leading_int(text: Column) -> Column:
    """STR-22."""
    return extract(clean(text), r"^(\d{1,9})(?!\d)").cast("int")


def study_mode(text: Column) -> Column:
    """STR-22: part-time words win over full-time ones, as they hold them."""
    return F.when(text.contains("非全"), "非全日制").when(text.contains("全日制"), "全日制")


def title_year(title: Column, published: Column) -> Column:
    """DAT-02: the title's year, else that of publication, from September on the next."""
    month = extract(published, r"^\d{4}-(\d{2})").cast("int")
    return F.coalesce(extract(title, r"(20\d{2})\s*(?:年|级)").cast("int"), extract(published, r"^(\d{4})-\d{2}").cast("int") + F.when(month >= 9, 1).otherwise(0))


def url_date(url: Column) -> Column:
    """DAT-03: ``/2024/0317/`` or ``/2024-03/17/`` and their like; NULL if there is no such day."""
    a, b = r"/(20\d{2})/(\d{2})(\d{2})/", r"/(20\d{2})[-/](\d{1,2})[-/](\d{1,2})(?:/|$)"
    parts = lambda p: F.concat_ws("-", F.regexp_extract(url, p, 1), F.lpad(F.regexp_extract(url, p, 2), 2, "0"), F.lpad(F.regexp_extract(url, p, 3), 2, "0"))
    return F.when(url.rlike(a), parts(a)).when(url.rlike(b), parts(b)).try_cast("date")


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """STR-21: the name of the first pattern that is found."""
    (pattern, name), *rest = rules
    out = F.when(text.rlike(pattern), name)
    for pattern, name in rest:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def file_format(name: Column) -> Column:
    """STR-21: by the ending."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin("htm", "html", "shtml", "jsp"), "html").when(ending.isin("jpg", "jpeg", "png", "gif", "bmp"), "image").when(ending.isin("pdf", "doc", "docx", "xls", "xlsx", "csv", "txt", "zip", "rar"), ending).otherwise("file")


def singles_text(*values: Column) -> Column:
    """STR-20: values joined by a slash, a missing one as None; empty if all are missing."""
    return F.when(F.coalesce(*values).isNull(), "").otherwise(F.concat_ws("/", *[F.coalesce(v.cast("string"), F.lit("None")) for v in values]))


def clean_cell(text: Column) -> Column:
    """STR-12: a line break between Chinese characters vanishes, another is a space; runs of spaces are one; ``3.0`` is ``3``."""
    joined = F.regexp_replace(clean(text), r"(?<=[一-鿿（）、，。])\s*\n\s*|\s*\n\s*(?=[一-鿿（）、，。])", "")
    spaced = F.regexp_replace(joined, r"\s+", " ")
    return F.regexp_replace(spaced, r"^(-?\d+)\.0$", "$1")


def full_width(text: Column) -> Column:
    """STR-13: ASCII punctuation beside Chinese characters in full width; no space before an opening bracket there."""
    text = F.regexp_replace(text, r"(?<=[一-鿿])\s+(?=\()", "")
    for ascii_sign, wide in (("(", "（"), (")", "）"), (",", "，"), (":", "："), (";", "；")):
        s = re.escape(ascii_sign)
        text = F.regexp_replace(text, rf"(?<=[一-鿿（]){s}|{s}(?=[一-鿿])", wide)
    return F.regexp_replace(text, r"(（[^（()]*)\)", "$1）")


def safe_filename(name: Column, limit: int = 80) -> Column:
    """STR-15: runs of unsafe characters are one underscore; cut to ``limit`` with the ending kept."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\s]+', "_"), r"^[._]+|[._]+$", "")
    safe = F.when(safe == "", "file").otherwise(safe)
    ending = F.regexp_extract(safe, r"(\.[^.]{1,5})$", 1)
    return F.when(F.length(safe) <= limit, safe).otherwise(F.concat(F.substring(safe, F.lit(1), F.lit(limit) - F.length(ending)), ending))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[。；;\n.!?]+\s*"), lambda x: x != "")


def sentence_with(text: Column, needles: Sequence[str], must: Sequence[str] = ()) -> Column:
    """STR-24: the first sentence with the first needle that any has, and all required words."""
    def having(array: Column, word: str) -> Column:
        return F.filter(array, lambda x: x.contains(word))

    found = sentences(text)
    for word in must:
        found = having(found, word)
    return F.coalesce(*[F.try_element_at(having(found, n), F.lit(1)) for n in needles])


def any_word(text: Column, words: Sequence[str]) -> Column:
    """STR-25, FLT-14."""
    return text.rlike("|".join(re.escape(w) for w in words))


def tokens(text: Column) -> Column:
    """STR-19: lower-case words, then Chinese characters, then pairs of successive ones, across gaps."""
    low = F.lower(text)
    chinese = F.regexp_extract_all(low, F.lit(r"[一-鿿]"), 0)
    n = F.size(chinese)
    pairs = F.when(n > 1, F.zip_with(F.slice(chinese, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chinese, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0), chinese, pairs)


def numbers(text: Column) -> Column:
    """JON-15: numbers in canonical form: no separators, no needless zeros."""
    plain = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    found = F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), 0)
    return F.transform(found, canonical_number)


def canonical_number(token: Column) -> Column:
    """STR-18."""
    short = F.when(token.contains("."), F.regexp_replace(F.regexp_replace(token, "0+$", ""), r"\.$", "")).otherwise(token)
    return F.regexp_replace(short, r"^0+(?=\d)", "")


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """JON-15: the answer's numbers that the evidence lacks; years 1990 to 2035 are exempt."""
    years = F.transform(F.sequence(F.lit(1990), F.lit(2035)), lambda y: y.cast("string"))
    return F.array_except(F.array_distinct(numbers(answer)), F.concat(numbers(evidence), years))


@F.pandas_udf(StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """STR-14: a key for comparing URLs; Spark's own functions treat + and / otherwise."""
    ports = {"http": 80, "https": 443}

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        try:
            parts = urlsplit(url.strip())
            port = parts.port
        except ValueError:
            return url.strip()
        scheme = parts.scheme.lower()
        host = (parts.hostname or "").lower() + (f":{port}" if port and port != ports.get(scheme) else "")
        path = quote(unquote(parts.path), safe="/:@!$&'()*+,;=~-._")
        return urlunsplit(("https" if scheme == "http" else scheme, host, path.rstrip("/") or "/", quote(unquote(parts.query), safe="/?:@!$&'()*+,;=~-._"), ""))

    return urls.map(one)


_COUNTED = {c: str(i) for i, c in enumerate("零一二三四五六七八九")} | {"两": "2", "十": "10"}


@F.pandas_udf(StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """STR-17: NFKC, no separators or white space, counted numerals as digits, ``N万`` times 10000."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        text = unicodedata.normalize("NFKC", re.sub(r"(?<=\d)[,，](?=\d{3}(?!\d))", "", text))
        text = re.sub(r"\s+", "", text).replace("∶", ":").replace("～", "~").replace("—", "-").replace("–", "-")
        text = re.sub(r"(?<![零一二三四五六七八九十百千万])([一二两三四五六七八九十])(?=[门个名人项次科])", lambda m: _COUNTED[m[1]], text)
        return re.sub(r"(\d+(?:\.\d+)?)万", lambda m: f"{float(m[1]) * 10000:.10g}", text)

    return texts.map(one)


def alias_finder(aliases: dict[str, Sequence[str]] = SCHOOL_ALIASES):
    """STR-11: ids in order of appearance; longer aliases first, no overlaps; an ASCII alias needs borders that are no ASCII
    letters or digits (so it is found beside Chinese characters)."""
    by_alias = sorted(((a.lower(), i) for i, names in aliases.items() for a in names), key=lambda x: (-len(x[0]), x[0]))

    def one(text: str | None) -> list[str]:
        low, found, taken = (text or "").lower(), [], []
        for alias, own in by_alias:
            pattern = rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])" if alias.isascii() else re.escape(alias)
            for m in re.finditer(pattern, low):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append(m.span())
                    found.append((m.start(), own))
        return list(dict.fromkeys(own for _, own in sorted(found)))

    @F.pandas_udf(ArrayType(StringType()))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return find


def alias_id(text: Column, aliases: dict[str, Sequence[str]] = SCHOOL_ALIASES) -> Column:
    """STR-10: exact lookup."""
    pairs = [F.lit(x) for i, names in aliases.items() for a in names for x in (a.lower(), i)]
    return F.try_element_at(F.create_map(*pairs), F.lower(clean(text)))
