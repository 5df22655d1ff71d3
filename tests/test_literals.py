"""Small literal cases with known results."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import evaluate, facts, privacy, resolve, retrieval, windows
from ledgerloom.plans import documents
from ledgerloom.schema import conform, violations
from ledgerloom.sources import files, html
from ledgerloom.sources.sinks import VersionedTable, markdown_table


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_counts(spark):
    got = values(spark, ["55", "≤41", "（0812合计≤19）", "未知", None, " 不超过 7"], T.parse_count)
    assert [tuple(x) for x in got] == [(55, False, None), (41, True, None), (19, True, "0812"), (None, False, None), (None, False, None), (7, True, None)]
    got = values(spark, ["48(17)", "50（4）", " 20 ", "", "若干"], T.parse_total_quota)
    assert [tuple(x) for x in got] == [(48, 17), (50, 4), (20, None), (None, None), (None, None)]


def test_names_and_codes(spark):
    assert values(spark, ["0854\n04", " 0812z3 ", "0812"], T.program_code) == ["085404", "0812Z3", None]
    assert tuple(values(spark, ["政治50/外语50/业务课70（学校基本线）"], T.subject_lines)[0]) == (50, 50, 70, 70, "学校基本线")
    assert tuple(values(spark, ["041人工智能学院（佛山南海）"], T.college_name)[0]) == ("041", "人工智能学院", "佛山南海")
    assert values(spark, ["2027（推免目录）/2026（复试）"], T.leading_year) == [2027]
    assert [[s.code for s in x] for x in values(spark, ["①101政治②204英语③302数学④408专业", "101政治  201英语  301数学  408专业", "101政治\n204英语\n302数学\n884数据"], T.split_subjects)] == [["101", "204", "302", "408"], ["101", "201", "301", "408"], ["101", "204", "302", "884"]]
    assert values(spark, ["对比中山大学、华工和暨大的085404", "jnu-010 与 SCUTS"], lambda c: T.alias_finder()(c)) == [["sysu", "scut", "jnu"], ["jnu"]]


def test_canonical_text(spark):
    assert values(spark, ["2.5 万元", "16,000", "加试两门", "１∶１．２", "二十年"], T.canonical_text) == ["25000元", "16000", "加试2门", "1:1.2", "二十年"]
    assert values(spark, ["学\n术\n学\n位", "Computer\nScience", "3.0"], T.clean_cell) == ["学术学位", "Computer Science", "3"]
    assert values(spark, ["英语 (一)"], T.full_width) == ["英语（一）"]


def test_url_keys(spark):
    a, b, c, d, e = values(spark, ["http://YZ.example.org:80/a/#top", "https://yz.example.org/a", "https://yz.example.org/%E4%B8%AD", "https://yz.example.org/中", "https://yz.example.org/a?page=2"], T.normalize_url)
    assert a == b and c == d and len({a, c, e}) == 3


def test_masks(spark):
    assert values(spark, ["测试甲", "欧阳测试", " 李 四 ", ""], privacy.mask_name) == ["测某", "欧阳某", "李某", ""]
    assert values(spark, ["拟录取测试甲等2582人为研究生", "接收推免生等100人"], privacy.mask_lead_names) == ["拟录取测某等2582人为研究生", "接收推免生等100人"]
    assert values(spark, ["同意接收欧阳测试等 12 名", "经审核，拟录取测试甲等2582人为硕士研究生", "录取人数为50人"], privacy.mask_lead_names) == ["同意接收欧阳某等 12 名", "经审核，拟录取测某等2582人为硕士研究生", "录取人数为50人"]
    ids = "a 123456789012345 b 11010519491231002X c 13800138000 d 1234567890123456"
    assert values(spark, [ids], privacy.drop_ids) == ["a  b  c 13800138000 d 1234567890123456"]
    assert values(spark, ["李四来了，李四走"], lambda c: privacy.mask_known(c, F.array(F.lit("李四")))) == ["李某来了，李某走"]


def test_grounding(spark):
    df = spark.createDataFrame([("复试线 379，推免 999 人，统招 12.5。", "379 2026-03-17"), ("1:2 3 月 2026", "1:2.00 03")], "a string, e string")
    assert [r.v for r in df.select(T.unsupported_numbers(F.col("a"), F.col("e")).alias("v")).collect()] == [["999", "12.5"], []]


def test_carry_down(spark):
    rows = spark.createDataFrame([(1, "101", "408"), (2, "同上", "同上"), (3, "同上", "302")], "i int, a string, b string")
    same = lambda c: F.col(c).isin(*T.SAME_AS_ABOVE)
    got = windows.carry_down(rows.withColumn("g", F.lit(1)), {"a": same("a"), "b": same("b")}, ["g"], "i").orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [("101", "408"), ("101", "408"), ("101", "302")]


PLANS = "id long, program string, year int, kind string, value int, is_upper_bound boolean, source string, pool string"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "p", 2026, "public", 49, False, "a", None), (2, "p", 2026, "catalog", 210, False, "b", None), (3, "p", 2026, "quota", 165, False, "c", None)], {(49, "exact"), (45, "exact")}),
        ([(1, "p", 2027, "catalog", 54, False, "a", None), (2, "p", 2027, "quota", 41, True, "a", None)], {(13, "lower")}),
        ([(1, "p", 2026, "catalog", 24, False, "a", "0812"), (2, "p", 2026, "public", 10, False, "a", "0812")], set()),
    ],
)
def test_estimates(spark, rows, want):
    plans = spark.createDataFrame(rows, PLANS)
    got = facts.estimates(plans, explicit=["public"], catalog="catalog", quota="quota")
    assert {(r.value, r.bound) for r in got.collect()} == want


def test_basis_is_of_the_latest_year(spark):
    plans = spark.createDataFrame([(1, "p", 2026, "public", 51, False, "a", None), (2, "p", 2027, "catalog", 62, False, "a", None), (3, "p", 2027, "quota", 25, False, "a", None)], PLANS)
    got = facts.basis(facts.estimates(plans, explicit=["public"], catalog="catalog", quota="quota")).collect()
    assert [(r.year, r.value) for r in got] == [(2027, 37)]


def test_disciplines(spark):
    assert values(spark, ["085404", "081200", "140500"], facts.discipline) == ["0854", "08", "14"]


def test_regressions_and_changes(spark):
    before = spark.createDataFrame([("codes", "all", 1.0), ("exact", "all", 0.9)], "metric string, grouping string, score double")
    now = spark.createDataFrame([("codes", "all", 0.95), ("exact", "all", 0.89)], "metric string, grouping string, score double")
    assert [r.metric for r in evaluate.regressions(now, before, 0.02).collect()] == ["codes"]
    known = spark.createDataFrame([("a", "codes"), ("a", "year")], "row string, field string")
    current = spark.createDataFrame([("a", "codes"), ("b", "codes")], "row string, field string")
    assert {tuple(r) for r in evaluate.failure_changes(current, known).collect()} == {("b", "codes", "new"), ("a", "year", "fixed")}


def test_pool_references(spark):
    programs = spark.createDataFrame([(i, "s", "010", "010", "c", f"0812{i:02}", "full") for i in range(4)], "program int, school string, college_id string, college_code string, college_name string, code string, mode string")
    refs = spark.createDataFrame([(1, "s", "010", "0812", None, True), (2, "s", None, "0812", None, True), (3, "s", None, "081203", None, False)], "fact int, school string, college string, code string, mode string, pool boolean")
    got = resolve.resolve_references(refs, programs).collect()
    assert sorted((r.fact, r.status) for r in got) == [(1, "resolved")] * 4 + [(2, "unresolved"), (3, "resolved")]


def test_grids():
    cells, origins = html.place_spans([[("学院", 1, 2), ("019", 2, 1)], [("a", 1, 1), ("b", 1, 1)]])
    assert cells == [["学院", "学院", "019"], ["a", "b", "019"]]
    assert html.row_text(cells[0], origins[0]) == "学院 | 019"
    assert html.split_blocks([["t", ""], ["a", "b"], ["", ""], ["c", "d"]]) == [(["t"], [["a", "b"]]), ([], [["c", "d"]])]
    assert html.visible_text("<p>a<script>x</script> b</p> 浏览次数：12") == "a b"


def office_file(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "a.docx").write_bytes(office_file({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}))
    (tmp_path / "b.xlsx").write_bytes(office_file({"xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>head</t></is></c></row><row><c r="A2"><v>3.0</v></c><c r="B2"><v>4</v></c></row></sheetData></worksheet>'}))
    (tmp_path / "c.txt").write_text(" x \n\n y\x00")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.status) for r in files.load_documents(files.list_files(spark, str(tmp_path))).collect()}
    assert got[("a.docx", 1)] == ("one", "ok") and got[("a.docx", 2)] == ("two\nx | y", "ok")
    assert got[("b.xlsx", 1)] == ("head\n3 | 4", "ok") and got[("c.txt", 1)] == ("x\ny", "ok")
    assert got[("d.pdf", 1)][1] == "needs_ocr" and got[("e.docx", 1)][1] == "failed: BadZipFile"


def test_versioned_table(spark, tmp_path):
    target = VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert target.read("id int, v string").count() == 0
    target.upsert(one, ["id"])
    target.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    assert target.delete(v=["a"]) == 1 and target.delete(v=["zzz"]) == 0
    assert sorted(map(tuple, target.read().collect())) == [(2, "c"), (3, "d")]
    assert markdown_table(one.where("id = 1")).endswith("| 1 | a |\n")


def test_upsert_roundtrip_deletes_every_id(spark, tmp_path):
    """More ids to delete than fit a list: 106,666 of 1.6 million."""
    spark.range(1, 1_600_001).withColumnRenamed("id", "c_custkey").write.parquet(f"file://{tmp_path}/customer.parquet")
    got = documents.upsert_roundtrip(spark, str(tmp_path))
    assert got.where("value <> 'added' AND id % 3 > 0 AND id % 10 = 1").count() == 0
    assert got.where("value <> 'added'").count() == 1_600_000 - sum(i % 3 > 0 and i % 10 == 1 for i in range(1, 1_600_001))


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both start from one version: the second finds the number taken and does its change again."""
    one, other = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    one.replace(rows(1))
    began = []

    def change(now):
        if not began:
            began.append(now.count())
            other.append(rows(2, 3, 4))
        return now.unionByName(rows(5, 6, 7))

    one.change(change)
    assert sorted(r.id for r in one.read().collect()) == [1, 2, 3, 4, 5, 6, 7] and began == [1]
    one.append_numbered(rows(0, 0).withColumn("id", F.lit(0)).withColumn("v", F.monotonically_increasing_id()), ["v"])
    assert sorted(r.id for r in one.read().collect()) == list(range(1, 10))
    assert one.vacuum(1) == 3 and one.read().count() == 9 and one.vacuum(1) == 0


def test_first_free_version(spark):
    ids = spark.createDataFrame([(x,) for x in ("p", "p-v3", "q", "q-v2", "q-v3", "q-v5", "r-v4", "s", "s-v2", "s-v2")], "id string")
    assert {r.base: r.next for r in windows.next_version(ids).collect()} == {"p": "p-v2", "q": "q-v4", "r": "r-v2", "s": "s-v3"}


def test_repeats_in_later_files_are_dropped(spark, tmp_path):
    from ledgerloom.streaming import jobs

    for i, day in enumerate(("2024-01-01", "2024-03-01", "2024-06-01")):
        rows = spark.createDataFrame([(day, "a"), (day, f"b{i}")], "ts string, k string").selectExpr("cast(ts as timestamp) as ts", "k")
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = jobs.events_stream(spark, f"{tmp_path}/in/*", "ts timestamp, k string", files=1)
    found = jobs.run_available(jobs.first_seen(stream, "k").select("k"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted(r.k for r in found.collect()) == ["a", "b0", "b1", "b2"]


def test_nearest_of_odd_vectors(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, 2.0, 1.0]), (62, [1.0, 2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = v.where("vec_id % 20 = 0 OR vec_id = 62").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in retrieval.dense_top(v, queries, 5).collect())

    def near(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 12)

    want = []
    for q, a in {i: x for i, x in rows if x and any(x) and (i % 20 == 0 or i == 62)}.items():
        order = sorted((-near(a, b), i) for i, b in rows if b and any(b))
        want += [(q, n + 1, i) for n, (_, i) in enumerate(order[:5])]
    assert got == sorted(want)


def test_delete_by_keys(spark, tmp_path):
    target = VersionedTable(spark, f"file://{tmp_path}/t")
    target.replace(spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 4)], "v string, k int"))
    assert target.delete(spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "v string")) == 2
    assert sorted(r.k for r in target.read().collect()) == [1, 3] and target.read().columns == ["v", "k"]
    assert target.delete(spark.createDataFrame([(3, "b")], "k int, v string")) == 0


def test_dense_top_in_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    queries = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    n = queries.count()
    want = sorted(map(tuple, retrieval.dense_top(v, queries, 3).collect()))
    assert len(want) == 3 * n and sorted(map(tuple, retrieval.dense_top(v, queries, 3, max_queries=n // 2).collect())) == want


def test_schema_checks(spark):
    docs = conform(spark.createDataFrame([("a", "active"), ("a", "odd"), (None, "removed")], "id string, status string"), "documents")
    assert {r.rule for r in violations(docs, "documents").collect()} == {"status not allowed", "key repeated", "key missing"}


def test_intents(spark):
    from ledgerloom.plans import agent

    got = values(spark, ["哪些专业考 408、全日制、统招 > 20？", "哪些专业统招≥20", "2026 年 0854 电子信息复试线", "给我身份证"], agent.intent)
    assert (got[0].is_408, got[0].mode, got[0].least, got[1].least) == (True, "全日制", 21, 20)
    assert (list(got[2].prefixes), got[2].year, got[2].lines, got[3].private) == (["0854"], 2026, True, True)
    assert agent.plan(got[3].asDict()) == ["refuse"] and agent.plan(got[2].asDict()) == ["lines"]
    assert agent.calls({"lines": True, "codes": ["a", "b"], "year": 2026}) == [("lines", {"code": "a", "year": 2026}), ("lines", {"code": "b", "year": 2026})]
    answer, removed = agent.strip_unsupported("复试线 379，推免 999 人，统招 12.5。2026 年", "379")
    assert removed == ["999", "12.5"] and answer.count(agent.MARKER) == 2
    tools = {"lines": lambda **a: spark.createDataFrame([(379,)], "line int"), "retrieve": lambda **a: 1 / 0}
    assert "379" in agent.Agent(tools).answer("q", {"lines": True})["answer"]
    told = agent.Agent(tools, model=lambda text: "12345 and 379").answer("is it 12345?", {"lines": True, "year": 2031})
    assert told["removed"] == ["12345"] and told["answer"].startswith(f"{agent.MARKER} and 379") and "2031" in told["answer"]
    assert agent.Agent(tools).answer("q", {})["evidence"] == ["retrieve failed: ZeroDivisionError"] and "error" in agent.validated(year=1)


def test_answers_keep_to_the_evidence(spark):
    from ledgerloom.plans import agent

    tools = {"lines": lambda **a: spark.createDataFrame([(77, 379, "国家线")], "program_id int, line_408 int, note string"), "plans": lambda **a: spark.createDataFrame([], "value int"), "retrieve": lambda **a: spark.createDataFrame([("text 55",)], "text string")}
    said = []

    def model(text):
        said.append(text)
        return "379" if "Use no numbers" in text else "379 or 408 or 77"

    told = agent.Agent(tools, model=model).answer("q", {"lines": True, "codes": ["081200"]})
    # A column's name and an id are no evidence; the second answer stands.
    assert told["asked_again"] and len(said) == 2 and told["removed"] == [] and told["answer"] == "379\nNothing was found for 081200."
    stubborn = agent.Agent(tools, model=lambda text: "77").answer("q", {"lines": True})
    assert stubborn["removed"] == ["77"] and stubborn["answer"] == agent.MARKER
    found = agent.Agent(tools, model=lambda text: "55").answer("q", {"plans": True})  # nothing structured: the text is searched
    assert found["answer"] == "55" and found["evidence"] == ["text: text 55"] and not found["asked_again"]
    assert agent.Agent({"plans": tools["plans"]}, model=model).answer("q", {"plans": True})["answer"] == "Nothing found."
    assert agent.Agent(tools).answer("q", {"private": True})["answer"].startswith("Personal data")


def test_extraction(spark):
    from ledgerloom.operators import documents as D

    registry = D.Registry()
    registry.register(D.Extractor("plans", F.col("doc").startswith("p"), D.plan_table))
    rows = [["专业 代码", "拟招生人数", "推免人数"], ["085404", "48", "≤17"], ["", "5", "x"]]
    docs = spark.createDataFrame([("p1", 2026, rows), ("q", 2026, rows), ("p2", 2026, [["none"]])], "doc string, year int, rows array<array<string>>")
    assert {(r.kind, r.code, r.value, r.is_upper_bound) for r in registry.run(docs).collect() if r.doc == "p1"} == {("catalog", "085404", 48, False), ("quota", "085404", 17, True), ("catalog", "085404", 5, False)}
    boxes = spark.createDataFrame([("d", 0.0, 10.0, 10.0, "计算机"), ("d", 50.0, 11.0, 10.0, "学院"), ("d", 0.0, 40.0, 10.0, "第二行")], "doc string, x double, y double, height double, text string")
    assert [r.text for r in D.group_lines(boxes).orderBy("line").collect()] == ["计算机 学院", "第二行"]
    assert D.markdown_tables("标题\n| a | b |\n|---|---|\n| 1 | 2 |\n注：示例") == ([[["a", "b"], ["1", "2"]]], ["标题", "注：示例"])
    assert all(b.startswith("cap\nhead\n") and len(b) <= 40 for b in D.table_blocks("cap", "head", [f"row number {i}" for i in range(10)], 40))
    mask = lambda n: n[0] + "某"
    for header in ("考生编号", "考试编号", "准考证", "准考证号", "身份证", "身份证号", "证件号", "证件号码", "报名号", "学号"):
        for name in ("姓名", "考生姓名", "姓 名", "姓名（拼音）"):
            assert D.redact_rows([["名单", ""], [name, header, "分"], ["李四", "1", "9"]], mask) == [["名单"], [name, "分"], ["李某", "9"]]
    tables, names = D.redact_tables([[["序号", "姓名", "学号"], ["1", "李四", "77"]], [["2", "王五", "78"]], [["a", "b"]]], mask)
    assert tables == [[["序号", "姓名"], ["1", "李某"]], [["2", "王某"]], [["a", "b"]]] and names == {"李四", "王五"}
    registry.register(D.Extractor("broken", F.col("doc") == "q", lambda rows: 1 / 0))
    found = registry.run(docs)
    assert [(r.doc, r.kind, r.evidence) for r in found.collect() if r.extractor == "broken"] == [("q", "failed", "ZeroDivisionError: division by zero")]
    listed = spark.createDataFrame([("p1", False, False), ("p2", False, False), ("q", False, False), ("r", False, True), ("s", True, False), ("t", False, False)], "doc string, missing boolean, needs_ocr boolean")
    listed = listed.withColumn("year", F.lit(2026)).withColumn("rows", F.array().cast("array<array<string>>"))
    assert {r.doc: (r.status, r.facts) for r in registry.statuses(listed, found).collect()} == {"p1": ("ok", 3), "p2": ("empty", 0), "q": ("failed", 0), "r": ("needs_ocr", 0), "s": ("missing", 0), "t": ("no_extractor", 0)}
    df = spark.createDataFrame([("招 生 12 人", "招生12人", 12), ("a", "b 12", 12)], "t string, e string, v int")
    assert [r.g for r in df.select(D.grounded(F.col("t"), F.col("e"), F.col("v")).alias("g")).collect()] == [True, False]


NOTES = {
    "学院细则为总13/已招推免9/公开4": {("plan", "rules_total", 13), ("plan", "tm", 9), ("plan", "public_exam", 4)},
    "学院细则（图片）为总53/已招推免30/公开23": {("plan", "rules_total", 53), ("plan", "tm", 30), ("plan", "public_exam", 23)},
    "推免数取自学院2026复试细则（总65/已招推免55/公开招考10）": {("plan", "rules_total", 65), ("plan", "tm", 55), ("plan", "public_exam", 10)},
    "另有退役大学生计划2名，复试线339": {("plan", "special_veteran", 2), ("score", "special_veteran", 339)},
    "另退役3；含退役大学生士兵计划3": {("plan", "special_veteran", 3)},
    "少干2名（线303）；统考可用计划PDF也写22": {("plan", "special_minority", 2), ("score", "special_minority", 303), ("plan", "available_exam", 22)},
    "2026：0854按一级学科复试，统招计划9人，复试20人": {("plan", "public_exam", 9), ("stat", "retest_count", 20)},
    "2026：0812按一级学科复试，统招计划9人，复试20人": set(),
    "2026目录中分专业计划：085404 12，085410 9": {("plan", "catalog_total", 12)},
    "复试名单30人（初试350–401）": {("stat", "retest_count", 30), ("stat", "score_min", 350), ("stat", "score_max", 401)},
    "没有数字": set(),
    "": set(),
}


def test_note_facts(spark):
    from ledgerloom.operators import notes

    rows = spark.createDataFrame([(i, n, "085404") for i, n in enumerate(NOTES)] + [(99, None, None)], "id int, note string, code string")
    got = {}
    for r in notes.note_facts(rows, "note", "code").collect():
        got.setdefault(r.id, set()).add((r.table, r.kind, r.value))
    assert got == {i: want for i, want in enumerate(NOTES.values()) if want}
    one = notes.facts_of("甲。退役线288（30/30/48/48）（https://a.b/c）；统考拟录取8人，由名单计数", "085404")
    assert one[0]["lines"] == [30, 30, 48, 48] and one[0]["evidence"].startswith("退役线288") and one[0]["url"] == "https://a.b/c"
    assert one[1]["definition"] == "2026年统考拟录取人数（由名单计数）"


def test_collection(spark):
    from ledgerloom.operators import crawl

    assert values(spark, ["/a/b/../c", "/a/./c/", "//a//c", "/../a/c"], crawl.canonical_path) == ["/a/c"] * 4
    assert values(spark, ["/a/c", "/a/c/d", "/a/cd", "/a/c/../d"], lambda c: crawl.is_within(c, F.lit("/a/c"))) == [True, True, False, False]
    links = [("s", 1, "k", "u1", None, None, "短", None), ("s", 2, "k", "u2", "更多", None, "一个长些的题", "2026-01-02"), ("s", 3, "k", "u3", "属性", None, "x", None), ("s", 4, "k", "u4", None, "内层标题很长很长", "", "2026-01-03"), ("s", 5, "m", "u5", None, None, "更多", None)]
    df = spark.createDataFrame(links, "source string, position int, key string, url string, attribute string, inner string, text string, day string")
    assert [(r.key, r.url, r.title, r.day) for r in crawl.list_entries(df).collect()] == [("k", "u3", "属性", "2026-01-02")]
    known = spark.createDataFrame([("a", 5), ("b", 1)], "school string, id int")
    tried = spark.createDataFrame([("a", 4, 200), ("a", 6, 404), ("a", 7, 200), ("a", 8, 404), ("a", 9, 404), ("a", 10, 200), ("b", 2, 200), ("b", 3, 500), ("b", 4, 200)], "school string, id int, status int")
    assert sorted(map(tuple, crawl.probe_ids(known, tried).collect())) == [("a", 7), ("b", 2)]
    next_links = spark.createDataFrame([("p1", 1, "上一页", "p0"), ("p1", 2, " Next ", "p2"), ("p2", 1, "下一页", "javascript:x"), ("p3", 1, "下一页", "p3")], "source string, position int, text string, href string")
    assert [tuple(r) for r in crawl.next_page(next_links).collect()] == [("p1", "p2")]


def test_views(spark):
    from ledgerloom.operators import views

    assert views.render_page("a\n[[TABLE:2]]\n\n b [[TABLE:9]]", {1: "t1", 2: "x | y\nz"}) == "a\nx | y\nz\nb\nt1"
    deep = '{"a":[{"b":{"program_id":"p","score_lines":[{"scope":"college","year":2026,"total":300,"politics":50,"source":{"doc_id":"d"}}],"directions":[{"code":"01","advisors":""},{"code":"02","advisors":"x"}]}}]}'
    odd = '[{"program_id":7,"plans":[{"kind":"tm","value":null,"year":"soon"}],"lines":[{"x":{"program_id":"q","plans":[{"value":3,"year":2025}]}}],"exam_subjects":[{"year":2026,"subjects":[{"slot":4,"code":"408"},{"code":"101"}]}]},{"plans":[{"value":1}]}]'
    outputs = spark.createDataFrame([(1, deep), (2, odd), (3, "no"), (4, None), (5, deep)], "id int, output string")
    got = sorted(((r.id, r.table, r.program_id, r.kind or "", r.year or 0, r.field, r.value or "", r.source or "") for r in views.tool_facts(outputs, "output").collect()), key=str)
    own = [("directions", "p", "02", 0, "total", "x", ""), ("score_lines", "p", "college", 2026, "politics", "50", "d"), ("score_lines", "p", "college", 2026, "total", "300", "d")]
    more = [("exam_subjects", "7", "slot4", 2026, "total", "408", ""), ("exam_subjects", "7", "slotNone", 2026, "total", "101", ""), ("plans", "7", "tm", 0, "total", "", ""), ("plans", "q", "", 2025, "total", "3", "")]
    assert got == sorted([(i, *f) for i in (1, 5) for f in own] + [(2, *f) for f in more], key=str)
    df = spark.createDataFrame([("x" * 50, None)], "a string, b string")
    assert [r.j for r in df.select(views.slim_json(["a", "b"], 10).alias("j")).collect()] == ['{"a":"xxxx…[截断]']


PAGE = """<html><head><title> A page </title><style>x{}</style></head><body><nav>menu</nav><div class="top-nav x">crumbs</div><div id="share">share</div>
<h1>Head</h1><p>one <b>two</b>&amp;three</p><script>no()</script><table><caption>c</caption><tr><th colspan=2>a</th><th rowspan="2">b</th></tr><tr><td>1</td><td>2</td></tr></table>
<table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table><table><tr><td></td></tr></table><footer>end <table><tr><td>kept</td></tr></table></footer>
<img src="/p.png" alt=" pic "><img src="data:image/png;base64,aGk="><img src="data:image/png;base64,%%%"><a href="f.pdf">f</a><div pdfsrc="g.pdf"></div><a href="#x">x</a><p>last"""


def test_whole_pages(spark):
    import hashlib

    page = html.read_page(PAGE)
    assert page["title"] == "A page" and page["tables"] == [[["a", "a", "b"], ["1", "2", "b"]], [["inner"]], [["kept"]]]
    assert page["text"].split("\n") == ["A page", "Head", "one two&three", "a | b", "1 | 2 | b", "outer", "inner", "end", "kept", "f", "x", "last"]
    assert [(i["url"], i["mime"], i["sha256"], i["alt"], i["needs_ocr"]) for i in page["images"]] == [("/p.png", None, None, "pic", False), (None, "image/png", hashlib.sha256(b"hi").hexdigest(), "", True)]
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open <table><tr><td>x")], "id int, html string")
    got = {r.id: r for r in html.page_documents(df).collect()}
    assert got[1].text == page["text"] and got[2].text == "" and got[3].tables == [[["x"]]]
    assert values(spark, [PAGE], html.linked_files) == [["f.pdf", "/p.png", "g.pdf"]]


def test_workbooks_and_vectors(spark, tmp_path):
    from ledgerloom.sources import sinks

    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([{"k": "a<b", "n": 3}, {"n": 4.5, "k": None}, "skipped"], "t/x"))
    (tmp_path / "b.xlsx").write_bytes(sinks.workbook([["x", [1]], [None, True]]))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.load_documents(files.list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.xlsx": "k | n\na<b | 3\n4.5", "b.xlsx": "x | [1]\nTrue"}
    with pytest.raises(ValueError):
        sinks.workbook([])
    target = VersionedTable(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame([(1, [3.0, 4.0], "en"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0, 0.0], None)], "vec_id long, embedding array<float>, lang string")
    sinks.upsert_vectors(target, rows, ["lang"])
    sinks.upsert_vectors(target, rows.where("vec_id = 4").selectExpr("vec_id", "array(0f, 2f) as embedding", "'de' as lang"), ["lang"])
    assert {r.vec_id: ([round(x, 3) for x in r.embedding], r.metadata) for r in target.read().collect()} == {1: ([0.6, 0.8], '{"lang":"en"}'), 4: ([0.0, 1.0], '{"lang":"de"}')}


def test_line_tables(spark):
    from ledgerloom.operators import documents as D

    lines = [
        ["序号", "专业代码", "专业名称", "复试分数线", "复试分数线", "复试分数线", "复试分数线", "复试分数线", "备注"],
        ["序号", "专业代码", "专业名称", "总分", "政治", "外语", "业务课一", "业务课二", ""],
        ["1", "085404", "计算机技术", "379", "50", "50", "60", "60", ""],
        ["2", "085404", "计算机技术", "303", "50", "50", "60", "", "少干计划"],
        ["3", "0812 00", "计算机科学与技术", "339", "45", "45", "60", "60", "退役士兵计划"],
        ["", "合计", "", "9", "", "", "", "", ""],
    ]
    plans = [["学科专业代码", "名称", "总计划", "已招推免生", "公开招考计划", "备注"], ["081200", "x", "15", "7", "8", ""], ["085410", "y", "1", "0", "1", "少干计划"]]
    registry = D.Registry([D.Extractor("lines", F.lit(True), D.line_table)])
    docs = spark.createDataFrame([("a", 2026, lines), ("b", 2026, plans), ("c", 2026, [["x"]])], "doc string, year int, rows array<array<string>>")
    got = {(r.doc, r.kind, r.code, r.value, tuple(r.lines or ())) for r in registry.run(docs).collect()}
    assert got == {("a", "college", "085404", 379, (50, 50, 60, 60)), ("a", "special_minority", "085404", 303, (50, 50, 60, None)), ("a", "special_veteran", "081200", 339, (45, 45, 60, 60)), ("b", "rules_total", "081200", 15, ()), ("b", "tm", "081200", 7, ()), ("b", "public_exam", "081200", 8, ()), ("b", "special_minority", "085410", 1, ())}


def test_intent_scores(spark):
    kind = "struct<schools:array<string>,codes:array<string>,prefixes:array<string>,year:int,operation:string,metrics:array<string>,privacy:boolean>"
    right = (["b", "a"], ["085404"], ["0812"], 2026, "lookup", ["lines", "plans"], None)
    rows = [(1, (["a", "b"], ["0812", "085404"], None, 2026, "lookup", ["plans"], False), right), (2, (None, None, None, None, "filter", None, True), (None, None, None, 2026, "filter", ["x"], True))]
    got = {r.id: r for r in evaluate.intent_scores(spark.createDataFrame(rows, f"id int, expected {kind}, predicted {kind}")).collect()}
    assert got[1].exact and got[1].metrics_ok and not got[2].exact and not got[2].year_ok and got[2].metrics_ok is None and got[2].privacy_ok
    checks = spark.createDataFrame([("s", 1, True, True, True), ("s", 1, False, False, True), ("s", 2, True, False, True), ("s", 3, False, False, False)], "split string, row int, found boolean, source_matches boolean, scorable boolean")
    assert [tuple(r) for r in evaluate.recall_summary(checks, "split").collect()] == [("s", 2, 1, 1, 3, 2, 1)]


def test_models_over_tables(spark):
    from ledgerloom.operators import model

    texts = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, " "), (5, None)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in model.embed(texts, "text", lambda part: [[float(len(t)), float(len(part))] for t in part], batch=1).collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0], 4: None, 5: None}
    assert model.parse_items('say [1] then [{"a": [1]}, 2] [{"b": 1}]') == [{"a": [1]}] and model.parse_items("[broken") == model.parse_items(None) == []
    item = {"table": "plans", "kind": "tm", "program_code": "085404", "value": 12, "evidence": "招 12 人"}
    reasons = {None: {}, "unknown kind": {"kind": "x"}, "evidence not in document": {"evidence": "招 13 人"}, "evidence looks like personal data": {"evidence": "123456789012345"}, "no value": {"value": None}, "value not in evidence": {"value": 1}, "bad code": {"program_code": "08"}, "no program": {"program_code": ""}}
    for reason, change in reasons.items():
        assert model.judged(item | change, "本专业招12人 123456789012345")["dropped"] == reason

    def answer(text):
        return 1 / 0

    failed = model.model_facts(texts.where("id < 3"), answer).collect()
    assert [(r.id, r.dropped) for r in failed] == [(1, "model failed: ZeroDivisionError"), (2, "model failed: ZeroDivisionError")]


def test_politeness(spark):
    from ledgerloom.operators import crawl

    urls = spark.createDataFrame([("s", f"https://{h}/{i}", i) for i, h in enumerate(["a.org", "A.org", "b.org", "a.org", "a.org"])], "school string, url string, position int")
    assert {r.position: r.earliest for r in crawl.schedule(urls, 3.0, 4).collect()} == {0: 0.0, 1: 3.0, 2: 0.0, 3: 6.0}
    old = spark.createDataFrame([("u", "e0", None), ("v", "e0", "m0")], "url string, etag string, last_modified string")
    answers = spark.createDataFrame([("u", 1, None, "m1"), ("u", 2, "", None), ("w", 1, "e1", None)], "url string, at int, etag string, last_modified string")
    assert {tuple(r) for r in crawl.newest_validators(old, answers).collect()} == {("u", None, "m1"), ("v", "e0", "m0"), ("w", "e1", None)}
    events = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "queued"), ("a", 4, "done"), ("a", 5, "running"), ("b", 1, "running"), ("c", 1, "queued"), ("c", 2, "done"), ("c", 3, "error")], "job string, at int, state string")
    assert {tuple(r) for r in crawl.job_states(events).collect()} == {("a", "done", 2), ("b", None, 1), ("c", "error", 1)}


def test_links_against_their_base(spark):
    from ledgerloom.sources import html as H

    rows = [
        (1, '<base target="x"><BASE href="/files/"><a href="a.pdf">x</a><img src="../b.png"><a href="a.pdf"></a><a href="//o.org/c"></a>', "https://h.org/p/q.html"),
        (2, '<a href="?n=2">x</a><a href="https://o.org/d">y</a><a href="http://[bad">z</a>', "https://h.org/p/q.html"),
        (3, '<a href="e">x</a>', None), (4, None, "https://h.org"),
    ]
    df = spark.createDataFrame(rows, "id int, html string, url string")
    got = {r.id: r.u for r in df.select("id", H.resolved_files(F.col("html"), F.col("url")).alias("u")).collect()}
    assert got[1] == ["https://h.org/files/a.pdf", "https://o.org/c", "https://h.org/b.png"]
    assert got[2] == ["https://h.org/p/q.html?n=2", "https://o.org/d"] and got[3] == ["e"] and not got[4]


def test_plan_tables():
    from ledgerloom.operators import documents as D

    rows = [["学院", "专业代码", "招生人数"], ["软件", "081200", "48(17)"], ["", "", "≤3"], ["短", "083500"], ["x", "085400", "待定"]]
    assert [x[:4] for x in D.plan_table(rows)] == [("catalog", "081200", 48, False), ("quota", "081200", 17, False), ("catalog", "081200", 3, True)]
    own = [[*rows[0], "推免人数"], ["软件", "081200", "48（17）", "16"]]
    assert [x[:3] for x in D.plan_table(own)] == [("catalog", "081200", 48), ("quota", "081200", 16)]


def test_facts_that_ask_alike_are_resolved_once(spark):
    """Only what differs in the references meets the programs; each fact still has all programs of its pool."""
    programs = spark.createDataFrame([(i, "s", "010", "010", "c", f"0812{i:02}", "full") for i in range(20)], "program int, school string, college_id string, college_code string, college_name string, code string, mode string")
    refs = spark.range(300).selectExpr("id AS fact", "'s' AS school", "'c' AS college", "'0812' AS code", "CAST(NULL AS string) AS mode", "true AS pool")
    got = resolve.resolve_references(refs, programs)
    assert {(r.fact, r.program) for r in got.collect()} == {(f, p) for f in range(300) for p in range(20)}
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union"), "pairs of facts and programs are not exchanged again"
