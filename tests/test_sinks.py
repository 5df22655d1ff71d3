"""Files named by content, schemas that grow, numbers without one task, and the incremental run."""

import hashlib
import json
from collections import Counter
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.sources import content, sinks
from ledgerloom.sources import files as sources
from ledgerloom.streaming import listing


def files(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and p.suffix != ".crc" and not p.name.endswith(".crc"))


def test_content_files(spark, tmp_path):
    rows = [("a b.txt", b"one"), ("a b.txt", b"one"), ("c.txt", b"one"), ("a b.txt", b"two"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    want = sorted(f"{hashlib.sha256(c).hexdigest()[:12]}_{n.replace(' ', '_')}" for n, c in {*rows} if c)
    content.save_files(df, str(tmp_path))
    made = {f: (tmp_path / f).stat().st_mtime_ns for f in files(tmp_path)}
    content.save_files(df, f"file://{tmp_path}")  # again: nothing is written
    assert files(tmp_path) == want == sorted(made) and all((tmp_path / f).stat().st_mtime_ns == t for f, t in made.items())
    bad = df.withColumn("name", F.when(F.col("name") == "c.txt", F.expr("raise_error('stop')").cast("string")).otherwise(F.concat(F.lit("x"), "name")))
    with pytest.raises(Exception, match="stop"):
        content.save_files(bad, str(tmp_path))
    assert not [f for f in files(tmp_path) if f.startswith("_unfinished")]
    assert [r[0] for r in df.where("name = 'c.txt'").select(content.saved_name(F.col("content"), F.col("name"))).collect()] == [w for w in want if w.endswith("c.txt")]
    with pytest.raises(Exception, match="never overwritten"):
        df.write.format("content_files").mode("overwrite").option("path", str(tmp_path)).save()


def test_writer_tasks_are_harmless_twice(tmp_path):
    from pyspark.sql.types import Row

    first, again = (content.ContentWriter({"path": str(tmp_path)}, False) for _ in range(2))
    rows = [Row(folder="s", name="n", content=b"x" * 10), Row(folder="s", name="n", content=b"x" * 10)]
    said = first.write(iter(rows))
    assert (said.made, said.there, said.bytes) == (1, 1, 10)
    assert again.write(iter(rows)).made == 0
    (tmp_path / content.UNFINISHED / again.job).mkdir(parents=True)
    again.abort([None])
    first.commit([said])
    assert files(tmp_path) == [f"s/{hashlib.sha256(b'x' * 10).hexdigest()[:12]}_n"] and not list((tmp_path / content.UNFINISHED).iterdir())


def test_schemas_grow(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    t.replace(spark.createDataFrame([(1, "a")], "id int, old string"))
    assert t.declare("id bigint, page int, note string", {"page": 1}) == ["page", "note"]
    assert t.declare("id bigint, page int, note string", {"page": 1}) == []  # again: no change
    assert [tuple(r) for r in t.read().collect()] == [(1, 1, None, "a")]
    t.append(spark.createDataFrame([(2, None, "n", "b")], "id bigint, page int, note string, old string"))
    assert sorted(map(tuple, t.read().collect())) == [(1, 1, None, "a"), (2, None, "n", "b")]
    assert t.declare("id bigint, page bigint, note string, more double") == ["more"]
    assert t.read().dtypes == [("id", "bigint"), ("page", "bigint"), ("note", "string"), ("more", "double"), ("old", "string")]
    with pytest.raises(TypeError):
        t.declare("id string")
    assert schema.difference(None, "a int")["added"] == ["a"]


def test_numbers_need_no_single_task(spark, tmp_path):
    t = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    turns = spark.range(100_000).select(F.xxhash64("id").alias("at"), F.lit("x").alias("text")).repartition(7)
    t.append_numbered(turns, ["at"])
    t.append_numbered(turns.limit(10), ["at"])
    rows = [(r.id, r["at"]) for r in t.read().orderBy("id").collect()]
    assert [i for i, _ in rows] == list(range(1, 100_011)) and [a for _, a in rows[:100_000]] == sorted(a for _, a in rows[:100_000])


def entry_rows():
    return [(f"s{i % 3}", i % 9, i, f"k{i % 20}", f"t{i}", str(i // 40 % 2)) for i in range(180)]


def statuses(rows):
    known, out = {}, Counter()
    for school, page, position, key, title, digest in sorted(rows, key=lambda r: (r[1], r[2])):
        before = known.get((school, key))
        out[school, page, key, title, "new" if before is None else "same" if before == digest else "changed"] += 1
        known[school, key] = digest
    return out


def found(spark, path):
    return Counter((r.school, r.page, r.key, r.title, r.status) for r in spark.read.parquet(path).collect())


def test_incremental_runs_equal_one(spark, tmp_path):
    rows = entry_rows()
    lists = f"file://{tmp_path}/lists"
    listing.listed(spark.createDataFrame(rows, "school string, page int, position int, key string, title string, digest string"), lists)
    assert listing.dry_run(spark, lists, f"file://{tmp_path}/dry").count() == 9 and not (tmp_path / "dry").exists()
    for name, budget, runs in (("once", 100, 1), ("parts", 2, 2)):
        target, state = f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state"
        for i in range(runs):
            listing.run(spark, lists, target, state, budget, timedelta(hours=1) if name == "parts" else None)
            if name == "parts" and i == 0:
                assert {(r.school, r.page) for r in listing.dry_run(spark, lists, state, budget).collect()} == {(f"s{s}", s + 6) for s in range(3)}
        assert found(spark, target) == statuses(rows)
        assert listing.run(spark, lists, target, state, budget)["rows"] == 0  # nothing new
        assert found(spark, target) == statuses(rows)


def test_planned_batches_are_kept(tmp_path):
    for p in (1, 2, 10):
        (tmp_path / f"lists/school=a/page={p}").mkdir(parents=True)
        (tmp_path / f"lists/school=a/page={p}/part-0.json").write_text(json.dumps({"key": str(p)}) + "\n\n")
    options = {"path": str(tmp_path / "lists"), "progress": str(tmp_path / "p/taken.json"), "budget": "2"}
    reader = listing.ListingReader(options)
    assert reader.latestOffset() == {"a": 2}
    assert [p.page for p in reader.partitions({}, {"a": 2})] == [1, 2]
    again = listing.ListingReader(options)  # a driver that begins anew
    assert again.latestOffset() == {"a": 3} and [p.page for p in again.partitions({"a": 2}, {"a": 3})] == [10]
    assert [r[3] for r in again.read(listing.Page("a", 10))] == ["10"]


def test_json_lines_are_read_again(spark, tmp_path):
    first = ['{"id": "a", "v": 1}', "", '{"id": "b", "v": 2}', "{broken", '"text"', "[1]", '{"v": 3}', '{"id": "c", "v": "no number"}', "   "]
    (tmp_path / "1.jsonl").write_text("\n".join(first) + "\n")
    (tmp_path / "2.jsonl").write_text('{"id": "a", "v": 9, "more": 1}\n{"id": "a", "v": 8}\n')
    rows, problems = sources.read_lines(spark, str(tmp_path), "id string, v int", "id")
    assert sorted(map(tuple, rows.collect())) == [("a", 8), ("b", 2)]
    assert sorted((r.file.rsplit("/")[-1], r.line, r.problem) for r in problems.collect()) == [("1.jsonl", n, p) for n, p in ((2, "blank"), (4, "bad"), (5, "bad"), (6, "bad"), (7, "no key"), (8, "bad"), (9, "blank"))]


def test_answers_are_asked_for_once(spark, tmp_path):
    from ledgerloom.operators import model

    calls = tmp_path / "calls"
    calls.mkdir()

    def ask(text):
        if text == "fails" and not (calls / "fails").exists():
            (calls / "fails").touch()
            raise ValueError
        (calls / f"{text}-{len(list(calls.iterdir()))}").touch()
        return text[::-1]

    cache = sinks.VersionedTable(spark, f"file://{tmp_path}/cache")
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "fails")], "id int, content string").coalesce(1)
    run = lambda rows, backend: {r.id: r.answer for r in model.cached_answers(rows, cache, backend, ask).collect()}
    assert run(df, "x") == {1: "ba", 2: "ba", 3: None, 4: None}
    assert run(df, "x") == {1: "ba", 2: "ba", 3: None, 4: "sliaf"}  # only what failed is asked for again
    assert run(df.where("id = 1"), "y") == {1: "ba"} and run(df.limit(0), "y") == {}
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["ab", "ab", "fails", "fails"]
    assert cache.read().count() == 3
