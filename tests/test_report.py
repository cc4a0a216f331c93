"""Sinks, the command line, the RPC server and the streaming form."""

import json

import pytest

from copse import cli, rpc
from copse.operators import scan
from copse.report import render, sink
from copse.streaming.counts import running_counts


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    block = "".join(f"if (a{i} && b) {{ call{i}(); }}\n" for i in range(6))
    for name, body in {"src/a.ts": block, "src/b.ts": "// note\n" + block, "test/a.test.ts": "x\n", "docs/x.md": "words\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def ran(capsys, spark, *argv):
    code = cli.main(argv, spark)
    got = capsys.readouterr()
    return code, got.out, got.err


def test_json_of_every_analysis(capsys, spark, project):
    want = {
        "count": {"totalFiles": 2, "totalCode": 12, "totalComment": 1}, "dup": {"percentage": 100.0, "duplicatedLines": 12}, "cx": {}, "ctx": {"window": 200_000, "budget": 50_000}, "agent": {"measured": 2},
    }
    for command, part in want.items():
        code, out, _ = ran(capsys, spark, command, str(project), "--json")
        payload = json.loads(out)
        assert code == 0 and payload["schema"] == 1 and payload["command"] == command and payload["root"] == str(project) and "unavailable" not in payload
        assert {k: payload["result"][k] for k in part} == part
    assert [f["path"] for f in json.loads(ran(capsys, spark, "cx", str(project), "--json")[1])["result"]["files"]] == ["src/a.ts", "src/b.ts"]
    for command in ("refactor", "coupling", "comments"):
        payload = json.loads(ran(capsys, spark, command, str(project), "--json")[1])
        assert payload["result"] is None and payload["unavailable"] == "no-git"


def test_json_written_by_tasks_has_the_same_bytes(capsys, spark, project, tmp_path):
    for command in ("count", "dup", "cx", "ctx", "agent", "refactor"):
        folder = tmp_path / command
        assert ran(capsys, spark, command, str(project), "--json-dir", str(folder))[:2] == (0, "")
        want = ran(capsys, spark, command, str(project), "--json")[1].removesuffix("\n")
        parts = sorted(folder.glob("part-*"))
        assert "".join(p.read_text() for p in parts) == want and {p.name for p in folder.iterdir()} == {p.name for p in parts} | {sink.DONE}
    assert ran(capsys, spark, "cx", str(project), "--json-dir", str(folder))[0] == 1 and ran(capsys, spark, "ctx", str(project), "--json-dir", str(tmp_path / "x"), "--max", "1")[0] == 1
    with pytest.raises(FileNotFoundError):
        sink.copy_to(str(tmp_path), None)


def test_listing_over_many_tasks(spark, tmp_path):
    """Parts in the order of rows, empty tasks, names, nested rows, line ends of every kind, and an empty listing."""
    rows = spark.range(0, 1000, 1, 16).selectExpr("id AS some_id", "named_struct('in_ner', array(id, null), 'text', concat('a\"', decode(unhex('0AE280A85CC3A9C2850D'), 'UTF-8'))) AS nested_row", "id / 3 AS share").where("some_id % 125 > 60 AND some_id > 200")
    report = sink.Report(str(tmp_path / "r"))
    result = {"few": 1, "rows": report.listing(rows), "none": report.listing(rows.where("false")), "first": report.listing(rows.orderBy("some_id"), 3), "text": "\0listing"}
    report.finish("cx", "/r", result)
    from copse.report.results import rows as collected

    want = render.envelope("cx", "/r", {"few": 1, "rows": collected(rows), "none": [], "first": collected(rows.orderBy("some_id"), 3), "text": "\0listing"})
    with open(tmp_path / "out", "w", newline="") as f:
        sink.copy_to(report.folder, f)
    assert (tmp_path / "out").read_bytes().decode() == want and len(list((tmp_path / "r").glob("part-*"))) > 8
    with pytest.raises(FileExistsError):
        sink.Report(report.folder)


def test_a_listing_that_fails_leaves_no_rows(spark, tmp_path):
    report = sink.Report(str(tmp_path / "r"))
    with pytest.raises(Exception, match="bad row"):
        report.listing(spark.range(0, 100, 1, 4).selectExpr("if(id = 90, raise_error('bad row'), id) AS id"))
    assert [p for p in (tmp_path / "r").rglob("*") if p.is_file()] == []


def test_text_gates_and_errors(capsys, spark, project):
    code, out, _ = ran(capsys, spark, "dup", str(project))
    assert code == 0 and "src/a.ts:1-6, src/b.ts:2-7" in out
    assert "branch  loop  bool" in ran(capsys, spark, "cx", str(project), "--explain")[1] and "medianCode" in ran(capsys, spark, "count", str(project), "--distribution")[1]
    assert "% of a window of 200k tokens" in ran(capsys, spark, "ctx", str(project))[1] and "safe: 0 (no sign of risk)" in ran(capsys, spark, "agent", str(project))[1]
    assert ran(capsys, spark, "dup", str(project), "--max-duplication", "99")[0] == 2 and ran(capsys, spark, "dup", str(project), "--max-duplication", "100%")[0] == 0
    assert ran(capsys, spark, "ctx", str(project), "--max", "1")[0] == 2 and ran(capsys, spark, "ctx", str(project), "--max", "1m")[0] == 0
    code, _, err = ran(capsys, spark, "count", str(project / "none"))
    assert code == 1 and "no such directory" in err
    assert ran(capsys, spark, "count", str(project), "--diff", "nope")[0] == 1 and ran(capsys, spark, "count", str(project), "--readme", "--diff", "x")[0] == 1


def test_readme_and_html(capsys, spark, project):
    (project / "README.md").write_text("# Title\n")
    assert ran(capsys, spark, "count", str(project), "--readme", "--html", str(project / "out.html"))[0] == 0
    first = (project / "README.md").read_text()
    assert first.startswith("# Title\n\n" + render.START) and "| TypeScript | 2 | 12 | 1 | 0 |" in first
    ran(capsys, spark, "count", str(project), "--readme")
    assert (project / "README.md").read_text() == first
    assert "<td>TypeScript</td>" in (project / "out.html").read_text()
    (project / "README.md").unlink()
    (project / "out.html").unlink()


def test_duplication_reports(capsys, spark, project):
    code, out, _ = ran(capsys, spark, "dup", str(project), "--renamed", "--html", str(project / "dup.html"))
    assert code == 0 and "groups: 1, 6 lines to save" in out and "size: 100 % under 10 lines, median 6, largest 6" in out and "where: 100 % in one directory" in out
    assert "src/a.ts +1      6       2          6" in out
    page = (project / "dup.html").read_text()
    (project / "dup.html").unlink()
    assert "<li>src/b.ts:2-7</li>" in page and "<pre><code>if (a0 &amp;&amp; b) { call0(); }" in page and "6 lines, 2 copies" in page
    assert "code" not in json.loads(ran(capsys, spark, "dup", str(project), "--json")[1])["result"]["clones"][0]
    clone = {"lineCount": 90, "fragments": [{"path": "<a>.ts", "startLine": 1, "endLine": 90}] * 2}
    shape = {"groups": 1, "removable": 90, "underTen": 0.0, "medianLines": 90, "maxLines": 90, "topTenShare": 100.0, "byLocation": {"withinFile": 1, "sameDirectory": 0, "samePackage": 0, "crossPackage": 0}}
    result = {"clones": [clone], "ranked": [{"files": ["<a>.ts"], "copies": 2, "lineCount": 90, "removable": 90}], "perFile": [], "shape": shape, "totalLines": 180, "duplicatedLines": 180, "percentage": 100.0}
    page = render.page("dup", result, ["\n".join(f"l{i}" for i in range(90))])
    assert "(30 more lines)" in page and "&lt;a&gt;.ts:1-90" in page and "l59" in page and "l60" not in page
    told = render.duplication(result | {"churn": {"<a>.ts": 0}}, 10, now=800 * 86400)
    assert "last change" in told[1] and told[1].endswith("2y") and render.duplication(result | {"shape": shape | {"groups": 0}, "clones": [], "ranked": []}, 10) == ["no duplicated blocks", "", ""]


def test_argument_parsers():
    assert [cli.token_count(x) for x in ("5000", "200k", "1.5M")] == [5000, 200_000, 1_500_000] and cli.row_count("all") is None and cli.row_count("0") is None and cli.row_count("7") == 7 and cli.percentage("20%") == 20
    for parse, bad in ((cli.token_count, "-1"), (cli.token_count, "x"), (cli.percentage, "101"), (cli.positive, "0"), (cli.row_count, "-3")):
        with pytest.raises((ValueError, Exception)):
            parse(bad)


def test_layout():
    assert render.wrap("aa bb cc", 5) == "aa bb\ncc" and render.multiple(30, 20) == "1.5x" and render.multiple(1, 0) == "-"
    assert render.number(1234567) == "1,234,567" and render.number(2.5) == "2.5" and render.compact(1234) == "1.2k" and render.money(0.001) == "$0.0010" and render.age(400 * 86400) == "1y"
    assert render.shorten("a/very/long/path.ts", 8) == "…path.ts" and render.table(["a", "n"], [["x", 1], ["yy", 1000]]) == "a       n\n--  -----\nx       1\nyy  1,000"
    assert json.loads(render.envelope("cx", "/r", {"a": 1})) == {"schema": 1, "tool": "copse", "version": render.VERSION, "command": "cx", "root": "/r", "result": {"a": 1}}


def test_rpc(spark, project):
    ask = lambda **x: rpc.respond(spark, json.dumps({"jsonrpc": "2.0", **x}))
    assert rpc.respond(spark, "{")["error"]["code"] == -32700 and ask(id=1)["error"]["code"] == -32600 and ask(method="notifications/initialized") is None
    assert ask(id=1, method="initialize")["result"]["serverInfo"]["name"] == "copse" and len(ask(id=2, method="tools/list")["result"]["tools"]) == 8 and ask(id=3, method="ping")["result"] == {}
    assert ask(id=4, method="nope")["error"]["code"] == -32601 and ask(id=5, method="tools/call", params={"name": "nope"})["error"]["code"] == -32602
    body = json.loads(ask(id=6, method="tools/call", params={"name": "cx", "arguments": {"dir": str(project), "top": 1.9}})["result"]["content"][0]["text"])
    assert [f["path"] for f in body["files"]] == ["src/a.ts"]
    assert ask(id=7, method="tools/call", params={"name": "count", "arguments": {"dir": "/no/such"}})["result"]["isError"]
    out = []
    rpc.serve(["", json.dumps({"jsonrpc": "2.0", "id": 1, "method": "ping"}) + "\n"], out.append, spark)
    assert len(out) == 1


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [("a.ts", "x\n// y\n"), ("b.ts", "if (a) {}\n"), ("c.py", "# a\n")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "path string, content string").write.parquet(str(tmp_path / "in"), mode="append" if i else "overwrite")
    stream = spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    from copse.operators import counts

    batch = counts.by_language(scan.measured(scan.with_lines(spark.createDataFrame(rows, "path string, content string"))))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, batch.collect()))
