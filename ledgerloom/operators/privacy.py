"""Redaction of personal data as regular expressions that Spark evaluates itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compound surnames, and words that are roles instead of names.
COMPOUND_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "长孙", "宇文", "司徒", "夏侯", "轩辕", "端木", "独孤", "南宫", "西门", "百里")
ROLES = "考生|学生|推免生|研究生|新生|人员|同学|同志"
LEAD_VERBS = "拟录取|拟接收|拟推荐|录取|接收|同意"


def mask_name(name: Column) -> Column:
    """PRV-01: the surname and 某; white space removed, empty stays empty."""
    raw = F.regexp_replace(name, r"(?U)\s+", "")
    two = f"^(?:{'|'.join(COMPOUND_SURNAMES)})."
    return F.when(raw == "", "").otherwise(F.concat(F.when(raw.rlike(two), F.substring(raw, 1, 2)).otherwise(F.substring(raw, 1, 1)), F.lit("某")))


def mask_lead_names(text: Column) -> Column:
    """PRV-05: the first name of a list is masked unless it holds a role."""
    name = rf"(?!(?:[一-鿿]{{0,3}}?)(?:{ROLES})等)[一-鿿]"
    tail = r"(?=等\s*\d+\s*[名人位])"
    two = "|".join(COMPOUND_SURNAMES)
    text = F.regexp_replace(text, rf"({LEAD_VERBS})(?![一-鿿]*?(?:{ROLES})[一-鿿]*等)({two})[一-鿿]{{1,2}}{tail}", "$1$2某")
    return F.regexp_replace(text, rf"({LEAD_VERBS})(?!(?:{two})某等)({name})(?!某等)[一-鿿]{{1,3}}?{tail}", "$1$2某")


def drop_ids(text: Column, exam: int = 15, identity: int = 18) -> Column:
    """PRV-04: identity numbers (the last may be X) before examination numbers; longer runs of digits stay."""
    text = F.regexp_replace(text, rf"(?<!\d)\d{{{identity - 1}}}[\dXx](?![\dXx])", "")
    return F.regexp_replace(text, rf"(?<!\d)\d{{{exam}}}(?!\d)", "")


def mask_known(text: Column, names: Column) -> Column:
    """PRV-04: a document's known names (two characters or more), longest first."""
    order = F.array_sort(F.filter(names, lambda n: F.length(n) >= 2), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(order, text, lambda out, n: F.replace(out, n, mask_name(n)))


def redact(text: Column, names: Column | None = None) -> Column:
    """PRV-04: known names, first names of lists, identity and examination numbers."""
    return drop_ids(mask_lead_names(mask_known(text, names) if names is not None else text))


def policy(personal: Column, listed: Column) -> Column:
    """DOC-04: how a document is loaded."""
    return F.when(personal | listed, "redact").otherwise("mask_leads")
