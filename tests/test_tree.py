import os

from corpusloom.operators import tablefunctions
from corpusloom.sources import tree
from corpusloom.sources.tree import list_tree, read_tree, walk


def grow(top):
    """A lopsided tree: many names in one folder, a deep branch, names of all kinds."""
    (top / "wide").mkdir()
    for i in range(60):
        (top / "wide" / f"f{i}.py").write_text("x" * i)
    at = top
    for i in range(12):
        at = at / f"d{i}"
        at.mkdir()
        (at / ".hidden").write_text("h")
        (at / "_n.py").write_text("n")
    for name in ("node_modules", ".git", "build"):
        (top / name).mkdir()
        (top / name / "a.py").write_text("no")
    (top / "yarn.lock").write_text("no")
    (top / "x.PNG").write_text("no")
    (top / "big.py").write_text("b" * (5 * 1024 * 1024 + 1))
    os.symlink(top / "wide", top / "link")
    os.symlink(top / "nowhere", top / "broken.py")


def plain(top, folders, scan):
    out = set()
    for at, below, names in os.walk(top):
        below[:] = [d for d in below if d not in folders]
        for n in names:
            path = os.path.join(at, n)
            if scan and (n in tree.SKIPPED_NAMES or n.lower().endswith(tuple(tree.SKIPPED_ENDINGS)) or not os.path.exists(path) or os.path.getsize(path) > tree.MAX_BYTES):
                continue
            out.add(os.path.relpath(path, top))
    return out


def test_listing_by_tasks_is_that_of_a_walk(spark, tmp_path, monkeypatch):
    grow(tmp_path)
    monkeypatch.setattr(tree, "LISTED", 10)
    monkeypatch.setattr(tree, "PACK_FILES", 7)
    for exclude, folders in (("scan", tree.SKIPPED_FOLDERS), ("deep", tree.SKIPPED_DEEP_FOLDERS), ("none", [])):
        want = plain(tmp_path, folders, exclude == "scan")
        packs = list_tree(spark, str(tmp_path), exclude).collect()
        found = [p for r in packs for p in r.paths]
        assert len(found) == len(set(found)) and set(found) == want == set(walk(str(tmp_path), exclude))
        assert max(len(r.paths) for r in packs) <= 7
    rows = {r.path: r for r in read_tree(spark, str(tmp_path), "deep").collect()}
    assert bytes(rows["wide/f9.py"].content) == b"x" * 9 and rows["wide/f9.py"].length == 9
    assert rows["broken.py"].content is None and len(rows["big.py"].content) == 5 * 1024 * 1024 + 1


def test_one_file_and_nothing(spark, tmp_path):
    (tmp_path / "a.lock").write_text("1")
    assert [r.path for r in read_tree(spark, str(tmp_path / "a.lock")).collect()] == ["a.lock"]
    (tmp_path / "empty").mkdir()
    assert read_tree(spark, str(tmp_path / "empty")).count() == 0
    assert read_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_parsers_as_a_table_function(spark):
    tablefunctions.register(spark)
    files = spark.createDataFrame([("a.py", "python", "f(x)\n"), ("b.go", "go", "func g() { h(1) }\n"), ("c.md", None, "i()"), ("d.py", "python", "(")], "path string, language string, content string")
    rows = spark.sql("SELECT path, fact, f.name, line FROM {files}, LATERAL syntax_facts(language, content) f WHERE fact IN ('call', 'function', 'error')", files=files).collect()
    got = {(r.path, r.fact, r["name"] if r.fact != "error" else None, r.line) for r in rows}
    assert got == {("a.py", "call", "f", 1), ("b.go", "function", "g", 1), ("b.go", "call", "h", 1), ("d.py", "error", None, None)}
