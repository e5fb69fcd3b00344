import json

from corpusloom.sources.changes import ChangesReader, watch_tree
from corpusloom.streaming.scan import latest, rescan_stream


def test_saved_files_are_scanned_again(spark, tmp_path):
    tree, log, out, mark = (tmp_path / n for n in ("tree", "log", "out", "mark"))
    (tree / "sub").mkdir(parents=True)

    def run():
        rescan_stream(watch_tree(spark, str(tree), str(log)), str(out), str(mark)).awaitTermination()
        return sorted((r.path, r.rule_id, r.line_number) for r in latest(spark, str(out)).collect())

    (tree / "a.py").write_text("eval(x)\n")
    (tree / "sub" / "b.py").write_text("x = 1\neval(x)\n")
    (tree / "c.py").write_text("exec(x)\n")
    assert run() == [("a.py", "POI-002", 1), ("c.py", "POI-002", 1), ("sub/b.py", "POI-002", 2)]
    (tree / "a.py").write_text("x = 12\n")  # mended
    (tree / "c.py").unlink()  # gone
    (tree / "d.py").write_text("\n\neval(x)\n")  # new
    assert run() == [("d.py", "POI-002", 3), ("sub/b.py", "POI-002", 2)]
    batches = len(list(out.glob("batch=*")))
    assert run() == [("d.py", "POI-002", 3), ("sub/b.py", "POI-002", 2)] and len(list(out.glob("batch=*"))) == batches
    (tree / "c.py").write_text("eval(x)\n")
    assert run() == [("c.py", "POI-002", 1), ("d.py", "POI-002", 3), ("sub/b.py", "POI-002", 2)]


def test_late_versions_replace_nothing(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "path string, version long, content binary"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run():
        rescan_stream(spark.readStream.schema(schema).parquet(source), out, mark).awaitTermination()
        return sorted((r.path, r.line_number) for r in latest(spark, out).collect())

    write([("a.py", 5, b"eval(x)\n"), ("b.py", 5, b"eval(x)\n"), ("b.py", 4, b"\neval(x)\n")])
    assert run() == [("a.py", 1), ("b.py", 1)]
    write([("a.py", 4, b"x = 1\n"), ("b.py", 6, None)])  # the first is late
    assert run() == [("a.py", 1)]
    write([("b.py", 5, b"eval(x)\n"), ("a.py", 9, b"\n\neval(x)\n"), ("a.py", 8, b"eval(x)\n")])
    assert run() == [("a.py", 3)]


def test_offsets_are_listings(tmp_path):
    tree, log = tmp_path / "tree", tmp_path / "log"
    tree.mkdir()
    reader = ChangesReader(str(tree), str(log), "scan")
    assert reader.latestOffset() == reader.initialOffset() == {"listing": 0}
    (tree / "a.py").write_text("1")
    first = reader.latestOffset()
    assert first == reader.latestOffset() == {"listing": 1}
    (tree / "b.py").write_text("2")
    (tree / "a.py").unlink()
    again = ChangesReader(str(tree), str(log), "scan")
    second = again.latestOffset()
    rows = [r for p in again.partitions(first, second) for r in again.read(p)]
    assert rows == [("a.py", 2, None), ("b.py", 2, b"2")]
    assert [r[0] for p in again.partitions({"listing": 0}, first) for r in again.read(p)] == ["a.py"]
    again.commit(second)
    assert json.loads((log / "2.json").read_text()).keys() == {"b.py"}
