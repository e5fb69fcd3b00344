import json

from corpusloom.__main__ import main


def test_deep_analyses_other_languages_by_text(spark, capsys, tmp_path):
    (tmp_path / "a.js").write_text("const cmd = req.query.c;\nlet line = cmd;\nexec(line);\n")
    (tmp_path / "b.go").write_text("package main\n")
    code = main([str(tmp_path), "--deep", "--json"], spark)
    (row,) = json.loads(capsys.readouterr().out)["files"]
    assert (row["path"].rsplit("/")[-1], row["language"], len(row["taint_paths"]), row["errors"]) == ("a.js", "javascript", 1, [])
    assert code == (2 if row["attack_chains"] else 1)


def test_all_findings_are_printed(spark, capsys, tmp_path):
    (tmp_path / "a.py").write_text("eval(x)\n" * 250)
    main([str(tmp_path)], spark)
    assert sum(" POI-002 " in line for line in capsys.readouterr().out.split("\n")) == 250
    main([str(tmp_path), "--json"], spark)
    got = json.loads(capsys.readouterr().out)
    assert got["findings_count"] == len(got["findings"]) >= 250


def test_deep_json_quiet_and_text(spark, capsys, tmp_path):
    (tmp_path / "a.py").write_text("import requests\ndef run():\n    page = requests.get(u)\n    code = base64.decode(page)\n    exec(page)\n")
    (tmp_path / "b.py").write_text("def (\n")
    assert main([str(tmp_path), "--deep", "--json"], spark) == 2
    got = json.loads(capsys.readouterr().out)
    assert (got["files_analyzed"], got["reported_files"], got["errors"]) == (2, 2, 1)
    a, b = got["files"]
    assert (a["symbols_count"], a["call_edges"], b["taint_paths"], len(b["errors"])) == (1, 3, [], 1)
    assert a["taint_paths"] == [{"source_line": 3, "sink_line": 5, "source_var": "page", "source_kind": "network_recv", "sink_name": "exec", "sink_kind": "code_exec", "confidence": 0.85}]
    assert {c["chain_name"] for c in a["attack_chains"]} == {"Download & Execute", "Dynamic Code Injection"}
    main([str(tmp_path), "--deep", "--quiet"], spark)
    assert capsys.readouterr().out.startswith("1 taint paths, ")
    main([str(tmp_path), "--deep"], spark)
    text = capsys.readouterr().out
    assert "line 3 page (network_recv) -> line 5 exec (code_exec), 85%" in text and "error: SyntaxError" in text


def test_report_has_groups_numbers_and_advice(spark, capsys, tmp_path):
    (tmp_path / "a.py").write_text("requests.get(u)\nos.system(c)\nx = random.choice(tokens)\n")
    main([str(tmp_path)], spark)
    lines = capsys.readouterr().out.split("\n")
    groups = [x for x in lines if x.startswith("== ")]
    assert groups[0] == "== critical ==" and groups[-1] == "== what to do =="
    assert [x.split()[0] for x in lines if " a.py:" in x] == ["1", "2", "3"]
    assert any(x.startswith("alerts: remote control: 1") for x in lines)


def test_out_is_written_by_tasks_as_a_whole(spark, capsys, tmp_path):
    code, out = tmp_path / "code", tmp_path / "out"
    code.mkdir()
    (code / "a.py").write_text("eval(x)\n" * 30)
    (code / "b.js").write_text("const cmd = req.query.c;\nlet line = cmd;\nexec(line);\n")
    assert main([str(code), "--out", str(out)], spark) == 2
    rows = [json.loads(x) for f in out.glob("part-*.json") for x in f.read_text().splitlines()]
    assert len(rows) >= 30 and {r["rule_id"] for r in rows} >= {"POI-002"} and (out / "_SUCCESS").exists()
    assert f"{len(rows)} findings" in capsys.readouterr().out
    deep = tmp_path / "deep"
    assert main([str(code), "--deep", "--syntax", "--out", str(deep)], spark) >= 1
    [row] = [json.loads(x) for f in deep.glob("part-*.json") for x in f.read_text().splitlines()]
    assert row["path"] == "b.js" and row["taint_paths"][0]["sink_name"] == "exec"
