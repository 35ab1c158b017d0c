import json

import pytest
from pyspark.sql import functions as F

from coursewright.sources import tree
from coursewright.sources.tree import read_files, read_tree, write_tree


def rows(spark, n=40):
    path = F.concat_ws("/", F.lit("content/sets"), (F.col("id") % 3).cast("string"), F.lit("lessons"), F.concat(F.col("id").cast("string"), F.lit(".json")))
    return spark.range(n).select(path.alias("path"), F.concat(F.lit('{"id": "é'), F.col("id").cast("string"), F.lit('"}\n')).alias("raw"))


def files_of(folder):
    return {str(p.relative_to(folder)): p.read_bytes().decode() for p in folder.rglob("*") if p.is_file()}


def test_written_files_are_read_back(spark, tmp_path, monkeypatch):
    made = rows(spark).repartition(5)
    write_tree(made, str(tmp_path / "t"))
    want = {r.path: r.raw for r in made.collect()}
    assert files_of(tmp_path / "t") == want  # nothing staged is left
    got = read_tree(spark, f"file://{tmp_path}/t").collect()
    assert {r.path: r.raw for r in got} == want and all(r.set == "content/sets/" + r.path.split("/")[2] and r.file == r.path.split("/")[-1] and r.error is None for r in got)
    monkeypatch.setattr(tree, "PART_FILES", 7)
    reader = tree.TreeReader(str(tmp_path / "t"), ".json", None)
    assert [len(p.paths) for p in reader.partitions()] == [7] * 5 + [5]


def test_only_the_folders_asked_for_are_opened(spark, tmp_path):
    write_tree(rows(spark), str(tmp_path / "t"))
    every = read_tree(spark, str(tmp_path / "t"))
    some = every.filter((F.col("set") == "content/sets/1") & F.col("file").isin("1.json", "4.json", "5.json"))
    assert sorted(r.file for r in some.collect()) == ["1.json", "4.json"]
    assert " Filter " not in some._jdf.queryExecution().executedPlan().toString()  # all of it is pushed
    assert every.filter("set = 'content/sets/none'").collect() == []
    assert every.filter("set IN ('content/sets/0', 'content/sets/2') AND raw LIKE '%12%'").count() == 1
    reader = tree.TreeReader(str(tmp_path / "t"), ".json", None)
    assert list(reader.pushFilters([tree.EqualTo(("set",), "content/sets/1"), tree.In(("file",), ("1.json",))])) == []
    (tmp_path / "t/content/sets/0").chmod(0)  # no matter to who is root, but nobody lists it
    seen = []
    real = tree.pafs.FileSelector
    try:
        tree.pafs.FileSelector = lambda base, **kw: seen.append(base) or real(base, **kw)
        assert [p.paths for p in reader.partitions()] == [["content/sets/1/lessons/1.json"]]
    finally:
        tree.pafs.FileSelector = real
        (tmp_path / "t/content/sets/0").chmod(0o755)
    assert seen == [str(tmp_path / "t/content/sets/1")]


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    home = tmp_path / "a/b/c/lessons"
    home.mkdir(parents=True)
    (home / "good.json").write_text("{}")
    (home / "odd.json").write_bytes(b"{\xff}")
    (home / "link.json").symlink_to(home / "nothing")
    (home / ".hidden.json").write_text("{}")
    (home / "note.txt").write_text("x")
    got = {r.file: (r.raw, r.error) for r in read_tree(spark, str(tmp_path)).collect()}
    assert got["good.json"] == ("{}", None) and got["odd.json"] == (None, "not UTF-8: invalid start byte at byte 1")
    assert set(got) - {"link.json"} == {"good.json", "odd.json"}
    wanted = ["a/b/c/lessons/good.json", "a/b/c/lessons/gone.json", "a/b/c"]
    got = {r.path: (r.raw, r.error) for r in read_files(spark, str(tmp_path), wanted).collect()}
    assert got[wanted[0]] == ("{}", None) and got[wanted[1]] == (None, f"no such file: {wanted[1]}") and got[wanted[2]][1].startswith("cannot be read")


def test_nothing_is_written_over_or_twice(spark, tmp_path):
    root = str(tmp_path / "t")
    write_tree(rows(spark, 5), root)
    before = files_of(tmp_path / "t")
    with pytest.raises(Exception, match="there already"):
        write_tree(rows(spark, 6), root)
    with pytest.raises(Exception, match="written twice"):
        write_tree(rows(spark, 9).union(rows(spark, 9)).filter("path LIKE '%8.json'"), root)
    for wrong in ("../x.json", "/x.json", "a/../../x", "a//b", "", None):
        with pytest.raises(Exception, match="not a path below the root"):
            write_tree(spark.createDataFrame([(wrong, "{}")], "path string, raw string"), root)
    assert files_of(tmp_path / "t") == before
    write_tree(rows(spark, 6).withColumn("raw", F.lit("new")), root, overwrite=True)
    assert set(files_of(tmp_path / "t").values()) == {"new"} and len(files_of(tmp_path / "t")) == 6
    write_tree(rows(spark, 0), str(tmp_path / "none"))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    bad = rows(spark).repartition(4).withColumn("raw", F.when(F.col("path").endswith("/17.json"), F.raise_error(F.lit("lost"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="lost"):
        write_tree(bad, str(tmp_path / "t"))
    late = tree.TreeWriter(str(tmp_path / "u"), ["path", "raw"], False)
    late.abort([])
    monkeypatch.setattr(tree.TaskContext, "get", staticmethod(lambda: Context(0, 0)))
    with pytest.raises(RuntimeError, match="has ended"):  # a task that outlives its job writes no more
        late.write(iter([{"path": "a/b/c/1.json", "raw": "{}"}]))
    assert files_of(tmp_path / "u") == {}
    assert files_of(tmp_path / "t") == {}


def test_the_driver_names_no_files_of_a_large_tree(spark, tmp_path, monkeypatch):
    write_tree(rows(spark), str(tmp_path / "t"))
    reader = tree.TreeReader(str(tmp_path / "t"), ".json", None)
    names = sorted(p for part in reader.partitions() for p in part.paths)
    monkeypatch.setattr(tree, "NAMED", 10)
    monkeypatch.setattr(tree, "PART_FILES", 6)
    parts = reader.partitions()
    assert {type(p) for p in parts} == {tree.Share} and len(parts) == 9  # 14, 13 and 13 files
    assert sorted(r[2] for p in parts for r in reader.read(p)) == names and len(names) == 40
    list(reader.pushFilters([tree.EqualTo(("set",), "content/sets/1")]))
    assert sorted(r[2] for p in reader.partitions() for r in reader.read(p)) == [n for n in names if n.startswith("content/sets/1/")]
    monkeypatch.setattr(tree.TaskContext, "get", staticmethod(lambda: Context(0, 0)))
    said = tree.TreeWriter(str(tmp_path / "u"), ["path", "raw"], False).write({"path": f"a/b/c/{i}.json", "raw": "{}"} for i in range(50))
    assert ".json" not in str(said)


def test_one_path_of_two_tasks_is_seen_before_any_file_moves(tmp_path, monkeypatch):
    writer, done = tree.TreeWriter(str(tmp_path), ["path", "raw"], False), []
    for part, names in enumerate((["a-b", "a", "c"], ["b", "a", "a0"])):
        monkeypatch.setattr(tree.TaskContext, "get", staticmethod(lambda part=part: Context(part, part)))
        done.append(writer.write({"path": f"x/{n}/1.json", "raw": n} for n in names))
    with pytest.raises(ValueError, match="written twice: ..x/a/1.json"):
        writer.commit(done)
    assert files_of(tmp_path) == {}


class Context:
    def __init__(self, part, attempt):
        self.part, self.attempt = part, attempt

    def partitionId(self):
        return self.part

    def taskAttemptId(self):
        return self.attempt


def test_an_attempt_that_failed_and_one_that_ran_twice(tmp_path, monkeypatch):
    def row(name):
        return {"path": f"a/b/c/lessons/{name}.json", "raw": json.dumps(name)}

    def lost():
        yield row("one")
        raise OSError("executor lost")

    writer = tree.TreeWriter(str(tmp_path), ["path", "raw"], False)

    def attempt(part, number, made):
        monkeypatch.setattr(tree.TaskContext, "get", staticmethod(lambda: Context(part, number)))
        return writer.write(iter(made))

    with pytest.raises(OSError):
        attempt(0, 0, lost())
    kept = attempt(0, 1, [row("one"), row("two")])
    attempt(1, 2, [row("three")])  # a copy that ran beside the one that counts
    other = attempt(1, 3, [row("three")])
    writer.commit([kept, None, other])
    assert files_of(tmp_path) == {f"a/b/c/lessons/{n}.json": json.dumps(n) for n in ("one", "two", "three")}
