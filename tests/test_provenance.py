"""The source of a fact against a pass over all documents."""

import random
import re

from ledgerloom.operators import notes, provenance

DOC = "doc string, position int, school string, doc_type string, title string, doc_college_code string, doc_college_name string, school_level boolean, intake_year int, local_path string, page_url string, attachment_url string, personal boolean"
FACT = "fact int, row int, source_kind string, school string, college_code string, college_name string, code string, mode string, year int, url string"


def score(d, f, in_row):
    kind = provenance.KINDS[f["source_kind"]]
    if d["doc_type"] not in kind.types:
        return None
    word = any(w in (d["title"] or "") for w in kind.words)
    if kind.must and not word:
        return None
    total = 100 - 10 * kind.types.index(d["doc_type"]) + 20 * in_row + 15 * word + 2 * (kind.attachment and d["attachment_url"] is not None) - 3 * bool(d["personal"])
    if not d["school_level"]:
        same = d["doc_college_code"] == f["college_code"] if f["college_code"] else d["doc_college_name"] == f["college_name"]
        total += 30 if same else -50
    if f["year"] is not None and d["intake_year"] is not None:
        total += 10 if f["year"] == d["intake_year"] else -40
    codes = re.findall(provenance.CODE, d["title"] or "")
    total -= 50 * bool(codes and f["code"] and f["code"] not in codes)
    if "非全日制" in (d["title"] or "") + (d["local_path"] or ""):
        total += 10 if f["mode"] == "非全日制" else -20
    return total


def choose(f, docs, listed):
    own = [next(d for d in docs if d["doc"] == x) for _, x in sorted((p, x) for r, x, p in listed if r == f["row"])]

    def top(rows):
        found = [(s, d) for d, in_row in rows if (s := score(d, f, in_row)) is not None]
        return max(found, key=lambda x: x[0])[1]["doc"] if found else None

    if f["url"] and (doc := top([(d, True) for c in ("attachment_url", "page_url") for d in docs if d[c] == f["url"]])):
        return doc
    return top([(d, True) for d in own] + [(d, False) for d in docs if d["school"] == f["school"] and d not in own]) or next((d["doc"] for d in sorted(own, key=lambda d: bool(d["personal"]))), None)


def test_sources_equal_a_pass(spark):
    rng = random.Random(8)
    types = sorted({t for k in provenance.KINDS.values() for t in k.types})
    docs = [
        dict(zip([c.split()[0] for c in DOC.split(", ")], (f"d{i:03}", i, rng.choice("ab"), rng.choice(types), rng.choice(["2026年目录", "复试方案 081200", "统考可用计划", "分数线 非全日制", "拟录取", None]), rng.choice(["041", "042", None]), rng.choice(["x", "y"]), rng.random() < 0.3, rng.choice([2026, 2027, None]), rng.choice(["p", "非全日制.pdf", None]), f"page{i % 30}", rng.choice([None, f"file{i % 20}"]), rng.random() < 0.2), strict=True))
        for i in range(120)
    ]
    facts = [
        dict(zip([c.split()[0] for c in FACT.split(", ")], (i, i % 50, rng.choice([*provenance.KINDS]), rng.choice("abc"), rng.choice(["041", "042", None]), rng.choice(["x", "z"]), rng.choice(["081200", "083500", None]), rng.choice(["全日制", "非全日制", None]), rng.choice([2026, 2027, None]), rng.choice([None, None, f"page{i % 40}", f"file{i % 25}"])), strict=True))
        for i in range(300)
    ]
    listed = [(r, f"d{n:03}", p) for r in range(40) for p, n in enumerate(rng.sample(range(120), rng.randint(0, 3)))]
    df = lambda rows, schema: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {r.fact: r.doc for r in provenance.best_sources(df(facts, FACT), df(docs, DOC), spark.createDataFrame(listed, "row int, doc string, position int")).collect()}
    assert got == {f["fact"]: choose(f, docs, listed) for f in facts} and len({*got.values()}) > 20


def test_notes_name_their_kind_of_source():
    note = "2026：目录30（含推免）；统招计划12，复试20人。另退役3；统考招生计划9（x）（https://a/b）。"
    found = [(f["kind"], f["value"], f["source_kind"], f["is_upper_bound"], f["url"]) for f in notes.facts_of(note, "081200")]
    assert found == [("special_veteran", 3, "special", False, None), ("college_exam_plan", 9, "college_exam_plan", False, "https://a/b"), ("catalog_total", 30, "catalog", False, None), ("public_exam", 12, "retest_plan", False, None), ("retest_count", 20, "retest_count", False, None)]
    assert next(f["definition"] for f in notes.facts_of("统考计划7", "")) == "学院通知“统考计划”" and {s for r in notes.RULES for s in r.source} <= {*provenance.KINDS}
