"""Aliases by automaton against the regular expressions, and questions as structs."""

import random
import re

from ledgerloom.functions.text import SCHOOL_ALIASES
from ledgerloom.operators import questions


def by_regex(text, aliases):
    low, found, taken = (text or "").lower(), [], []
    for alias, own in sorted(((a.lower(), i) for i, names in aliases.items() for a in names), key=lambda x: (-len(x[0]), x[0])):
        pattern = rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])" if alias.isascii() else re.escape(alias)
        for m in re.finditer(pattern, low):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                found.append((m.start(), own))
    return list(dict.fromkeys(own for _, own in sorted(found)))


def test_automaton_equals_regex():
    rng = random.Random(2)
    aliases = {"a": ("ab", "中大", "abc"), "b": ("b c", "大学", "中大学"), "c": ("C", "学", "ＡB")} | SCHOOL_ALIASES
    one, own = questions.find_aliases(aliases), questions.find_aliases()
    pieces = ["ab", "abc", "c", "C ", "b c", "中大", "大学", "学", "1", " ", "，", "中山大学", "SYSU", "华工", "暨大", "İ", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
        if len(text.lower()) == len(text):
            assert one(text)[0] == by_regex(text, aliases), text
            assert own(text)[0] == by_regex(text, SCHOOL_ALIASES), text
    assert own("对比中山大学与SCUT的线") == (["sysu", "scut"], "对比 与 的线") and own(None) == ([], "")
    assert questions.find_aliases({})("x") == ([], "x")


def test_intents(spark):
    asked = [
        "中山大学计算机学院081200 2026年复试线多少分？", "四校复试线", "哪些专业考 408、全日制学硕、统招 > 20？", "暨大有没有软件工程专硕", "拟录取名单里有没有张三", "导出 0812 计划，统考不少于5", "不考408的专业有哪些", "不考数学一的有哪些专硕", "天气", None,
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, q string")
    got = {r.id: r.intent for r in questions.intents(df, "q").collect()}
    a = got[0]
    assert (a.schools, a.codes, a.prefixes, a.colleges, a.year, a.kinds, a.numeric, a.in_field) == (["sysu"], ["081200"], [], ["计算机学院"], 2026, ["score_line"], True, True)
    assert got[1].kinds == ["score_line", "compare"]
    f = got[2].filters
    assert (f.is_408, f.study_mode, f.degree_type, f.min_public_plan) == (True, "全日制", "学硕", 21) and got[2].kinds == ["plan", "subjects", "filter"]
    assert got[3].name == "软件工程" and got[3].schools == ["jnu"] and got[3].kinds == ["directions"]
    assert got[4].privacy and got[4].name is None and "privacy" in got[4].kinds
    assert (got[5].export, got[5].prefixes, got[5].filters.min_public_plan, got[5].kinds) == (True, ["0812"], 5, ["plan", "export", "filter"])
    assert got[6].filters.is_408 is False and got[7].filters.exclude_subject == "301" and got[7].filters.degree_type == "专硕" and got[7].filters.is_408 is None
    assert got[8].kinds == got[9].kinds == ["narrative"] and not got[8].in_field and got[9].schools == []
