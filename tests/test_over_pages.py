"""Running values over partitions, catalogues over page breaks, and tables that go on: equal to a pass in order, however rows are dealt."""

import random
import re
from collections import Counter

import pytest

from ledgerloom.operators import blocks, over_pages, scans


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_running_values_equal_a_pass(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), i, rng.choice([None, rng.randint(-5, 5)])) for i in range(600)]
    want, last, total, count = set(), {}, Counter(), Counter()
    for key, i, x in rows:
        last[key] = last.get(key) if x is None else x
        total[key] += x or 0
        count[key] += 1
        want.add((key, i, count[key], total[key], last[key]))
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "key string, i int, x int")
        laid = scans.laid_out(df, ["key"], ["i"]).fillna(0, ["x"]).withColumnRenamed("x", "y")
        laid = laid.join(df.select("i", "x"), "i")
        got = scans.running(laid, ["key"], {"n": ("count", None), "s": ("sum", "y"), "l": ("last", "x")}).collect()
        assert {(r.key, r.i, r.n, r.s, r.l) for r in got} == want
        assert {(r.key, r.i, r.number) for r in scans.numbered(df, ["key"], ["i"]).collect()} == {w[:3] for w in want}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        scans.running(laid, ["key"], {"n": ("median", "y")})


def catalogue(rng, rows):
    """Rows of one catalogue, and its facts by a pass in order."""
    out, facts, college, block = [], [], None, None

    def flush():
        if not block or block["college"] is None:
            return
        modes = {d[2] for d in block["dirs"]}
        mode = modes.pop() if len(modes) == 1 else None
        facts.append(("catalog_total", block["college"], block["code"], mode, block["n"], None))
        text = block["subjects"] or next((d[3] for d in block["dirs"] if d[3]), "")
        if block["none"]:
            facts.append(("no_exam", block["college"], block["code"], mode, None, None))
        elif text:
            facts.append(("subjects", block["college"], block["code"], mode, None, "/".join(" ".join(x) for x in re.findall(r"(\d{3})([一-龥]+)", text))))
        facts.extend(("direction", block["college"], block["code"], d[2], None, f"{d[0]} {d[1]}") for d in block["dirs"])

    for _ in range(rows):
        kind = rng.choice(["college", "program", "program", "direction", "direction", "direction", "noise", "header"])
        subjects = rng.choice(["", "①101政治②201英语"])
        shown = [subjects + " 复试专业课：④888别"] if subjects else []
        if kind == "college":
            flush()
            block, college = None, f"{rng.randrange(1000):03}"
            out.append([f"{college} 学院", "12"])
        elif kind == "program":
            flush()
            n, none = rng.choice([None, 7, 65]), rng.random() < 0.3
            block = {"college": college, "code": f"{rng.randrange(10000):04}Z1", "n": n, "subjects": subjects, "none": none, "dirs": []}
            out.append([f"{block['code']} 名", *([str(n)] if n else []), *shown, *(["仅招收推免生"] if none else [])])
        elif kind == "direction":
            d = (f"{rng.randrange(100):02}", "不分方向", rng.choice(["全日制", "非全日制"]), subjects)
            out.append([f"{d[0]} {d[1]} ({d[2]})", *shown])
            if block:
                block["dirs"].append(d)
        else:
            out.append(["学科代码", "人数"] if kind == "header" else rng.choice([["备注"], []]))
    flush()
    return out, facts


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_catalogue_equals_a_pass(spark, parts):
    rng = random.Random(parts)
    rows, want = [], Counter()
    for doc, n in (("long", 400), ("short", 3), ("b", 60)):
        own, facts = catalogue(rng, n)
        rows += [(doc, i // 7, i % 7, i // 7, v, v[-1] if v else None) for i, v in enumerate(own)]
        want.update((doc, *f) for f in facts)
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "doc string, `table` int, row int, page int, values array<string>, last string")
        got = Counter((r.doc, r.kind, r.college, r.code, r["mode"], r.value, r.detail) for r in over_pages.catalogue_facts(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and want


def test_tables_that_go_on(spark):
    tables = {
        0: [["专业代码", "人数"], ["081200", "≤3"]],
        1: [["083500", "4"]],  # goes on by its width
        2: [["学院", "代码", "人数"], ["软件", "081200", "5"]],
        3: [["计算机", "", "085400", "6"]],  # no header of its width: by its kinds of columns
        4: [["x", "y", "z", "w", "v"]],  # none fits
    }
    rows = [("d", t, i, c) for t, own in tables.items() for i, c in enumerate(own)] + [("e", 0, 0, ["083500", "4"])]
    df = spark.createDataFrame(rows, "doc string, `table` int, row int, cells array<string>")
    got = {(r.doc, r.table): r.header for r in over_pages.with_headers(df, ["专业代码", "代码"]).collect()}
    assert got == {("d", 0): tables[0][0], ("d", 1): tables[0][0], ("d", 2): tables[2][0], ("d", 3): tables[2][0], ("d", 4): None, ("e", 0): None}


def test_merged_columns_are_filled(spark):
    rows = [("d", 0, 0, "软件学院", "a"), ("d", 0, 1, "", "b"), ("d", 0, 2, None, ""), ("d", 1, 0, " ", "c"), ("d", 1, 1, "新学院", "d")]
    df = spark.createDataFrame(rows, "doc string, `table` int, row int, college string, x string")
    got = {(r.table, r.row): (r.college, r.x) for r in over_pages.filled_down(df, ["college"]).collect()}
    assert got == {(0, 0): ("软件学院", "a"), (0, 1): ("软件学院", "b"), (0, 2): ("软件学院", ""), (1, 0): ("", "c"), (1, 1): ("新学院", "d")}


def test_lists_over_pages(spark):
    text = ["张 081200 李", "王 083500", "赵 无", "钱 0854", "00 孙", "周 081200 083500", "12", "081200 吴"]
    pages = [(1, text[:4]), (2, text[4:7]), (3, text[7:])]  # 0854|00 is one code; 12|081200 is not
    df = spark.createDataFrame([("d", p, i, t) for p, lines in pages for i, t in enumerate(lines)] + [("e", 1, 0, None)], "doc string, page int, line int, text string")
    assert {(r.doc, r.code): r.people for r in over_pages.roster_counts(df).collect()} == {("d", "081200"): 2, ("d", "083500"): 1, ("d", "085400"): 1}


def packed(rows, caption, size):
    """Blocks of one table by a pass in order."""
    label = lambda v: len({*v}) > 1 and not any(re.search(blocks.NUMERIC_CELL, x) or re.search(blocks.LEADING_CODE, x) for x in v)
    at = next((i for i, (v, _) in enumerate(rows[:8]) if label(v)), None)
    head = [] if at is None else [i for i in range(at, min(at + 3, len(rows))) if all(label(rows[j][0]) for j in range(at, i + 1))]
    prefix = [x for x in (caption, *(" | ".join(rows[i][0]) for i in head)) if x]
    out, body, n, college, program = [], [], 0, "", ""
    for i, (values, width) in enumerate(rows):
        line = " | ".join(values)
        if not values or i in head or line in prefix[bool(caption) :]:
            continue
        group = len({*values}) <= max(2, width // 2)
        is_college = group and re.search(blocks.COLLEGE_ROW, values[0])
        is_program = group and not is_college and re.search(blocks.PROGRAM_ROW, values[0])
        college, program = (line, "") if is_college else (college, line if is_program else program)
        if n and (is_college or is_program and n + len(line) > size // 2 or len("\n".join(prefix)) + n + len(line) + 1 > size):
            out.append("\n".join(prefix + body))
            body, n = [], 0
        if not body:
            body = [x for x in (college, program) if x and x != line]
            n = sum(len(x) + 1 for x in body)
        body, n = [*body, line], n + len(line) + 1
    return out + (["\n".join(prefix + body)] if body else [])


@pytest.mark.parametrize("size", [60, 200])
def test_table_blocks_equal_a_pass(spark, size):
    rng, rows, want = random.Random(size), [], {}
    for t in range(12):
        own = []
        for i in range(rng.choice([0, 3, 40])):
            kind = rng.choice(["label", "college", "program", "row", "row", "row", "blank", "long"]) if i else "label"
            own.append(({"label": ["学院", "专业", "人数"], "college": [f"04{i % 10}学院"], "program": [f"0854{i:02} 专业"], "row": [f"方向{i}", "全日制", str(i)], "blank": [], "long": ["x" * 150, "y", "z"]}[kind], 3))
        caption = rng.choice(["", "表一："])
        rows += [("d", t, i, w, caption, v) for i, (v, w) in enumerate(own)]
        want[t] = packed(own, caption, size)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, `table` int, row int, width int, caption string, values array<string>")
    got = {t: [] for t in want}
    for r in sorted(blocks.table_blocks(df, size).collect(), key=lambda r: (r.section, r.number)):
        got[r.table].append(r.text)
    assert got == want


def test_parts_are_bounded(spark):
    """A window of one task holds 2^16 rows of a key at most, and partitions follow the rows."""
    laid = scans.laid_out(spark.range(200_000).selectExpr("1 AS k", "id"), ["k"], ["id"])
    assert laid.groupBy("k", "part").count().agg({"count": "max"}).first()[0] <= 1 << 16
    ran = scans.running(laid, ["k"], {"n": ("count", None), "last": ("last", "id")})
    assert ran.where("n = id + 1 AND last = id").count() == 200_000
