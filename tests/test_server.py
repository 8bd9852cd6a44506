"""The stdio server and set-up helpers."""

import io
import json

from codegraph import setup
from codegraph.engine import Engine
from codegraph.server import describe, serve


def test_server_answers_and_survives_errors(spark, tmp_path):
    e = Engine(spark, files=spark.createDataFrame([("a.ts", "export class A {}\n")], "path string, content string"), home=str(tmp_path))
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "find_def", "arguments": {"symbol": "A", "pathGlob": "*.ts"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "dep_graph", "arguments": {"depth": 9}}},
        {"id": 5, "method": "tools/call", "params": {"name": "rm"}}, {"id": 6, "method": "ping"},
    ]
    out = io.StringIO()
    serve(e, io.StringIO("\n".join([*map(json.dumps, asked), "junk", "3"]) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, None, None]
    assert len(got[1]["result"]["tools"]) == 9
    assert "a.ts:1" in got[2]["result"]["content"][0]["text"] and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"] and "depth" in got[3]["result"]["content"][0]["text"]
    assert "error" in got[4] and got[5]["result"] == {}
    assert describe("call_graph")["inputSchema"]["required"] == ["symbol"]


def test_setup_is_idempotent_and_keeps_others(tmp_path):
    root = str(tmp_path)
    (tmp_path / ".mcp.json").write_text('{"x": 1, "mcpServers": {"other": {"command": "o"}}}')
    (tmp_path / ".gitignore").write_text("dist\n.codegraph/\n")
    for _ in range(2):
        setup.write_client(root)
    config = json.loads((tmp_path / ".mcp.json").read_text())
    assert config["x"] == 1 and set(config["mcpServers"]) == {"other", "codegraph"}
    assert setup.ensure_ignored(root) and not setup.ensure_ignored(root)
    assert (tmp_path / ".gitignore").read_text().splitlines() == ["dist", "", *setup.BLOCK]
    (tmp_path / ".mcp.json").write_text("broken")
    setup.write_client(root)
    assert "codegraph" in json.loads((tmp_path / ".mcp.json").read_text())["mcpServers"]
    assert setup.package_version(root) == "0.0.0"
    (tmp_path / "package.json").write_text('{"version": "1.2.3"}')
    assert setup.package_version(root) == "1.2.3"
    assert setup.relative_to(root, f"{root}/bin/x") == "bin/x" and setup.relative_to(root, "/usr/bin/x") == "/usr/bin/x"
