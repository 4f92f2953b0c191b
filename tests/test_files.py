import json

import pytest

from tessergraph.cli import routed, run
from tessergraph.engine import Engine
from tessergraph.graph import Graph, GraphError
from tessergraph.operators.selection import select_subgraph
from tessergraph.plans import render
from tessergraph.server import PARAMS, PARSE, REQUEST, Refusal, budget_of, respond
from tessergraph.sources.artifacts import artifacts_path, load_or_build
from tessergraph.sources.audit import log_query, read_audit, top_nodes
from tessergraph.sources.code import code_block, inject_code, parse_line, safe_path
from tessergraph.sources.parsers import module_id, parse_go, parse_python, parse_typescript
from tessergraph.sources.project import clashes, index_project, index_project_incremental, parse_project, source_files
from tessergraph.sources.readers import as_bool, as_float, as_int, detect_format, find_relationships, load_graph, load_json, parse_json
from tessergraph.sources.writers import convert_graph, save_tables, write_json
from tessergraph.streaming.audit import audit_stream, node_counts

RICH = {
    "nodes": [
        dict(id="a", label="Alpha", type="function", file_type="code", description="entry point", importance=0.9, community=0, is_god=True, source_file="a.py", custom=dict(k=[1])),
        dict(id="b", label="Beta", type="class", importance="NaN", community="2.9", god="false"), dict(id=3, file_type="weird", community=2.9, label=None),
    ],
    "links": [dict(source="a", target="b", relation="calls", weight="inf", confidence_score=0.5, note="x"), dict(source="b", target=3), dict(source="a", target="z"), "junk", dict(source="a")],
    "hyperedges": [dict(id="h", nodes=["a", "b", 3], confidence_score=0.8)],
}


def file(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(p)


def test_json_and_round_trips(spark, tmp_path):
    g = load_graph(spark, file(tmp_path, "g.json", RICH))
    n = {r["id"]: r for r in g.nodes.collect()}
    assert set(n) == {"a", "b", "3"} and n["a"]["extra"] == {"custom": '{"k": [1]}'}
    assert (n["b"]["importance"], n["b"]["community"], n["b"]["is_god"]) == (0.0, None, True)
    assert (n["3"]["community"], n["3"]["file_type"], n["3"]["label"]) == (2, "concept", "3")
    e = {(r["src"], r["dst"]): r for r in g.edges.collect()}
    assert set(e) == {("a", "b"), ("b", "3")} and e["a", "b"]["weight"] == 1.0 and e["a", "b"]["extra"] == dict(note='"x"')
    again = load_graph(spark, str(write_json(g, tmp_path / "out.json")))
    assert again.to_dict() == g.to_dict() and again.fingerprint() == g.fingerprint()
    save_tables(g, str(tmp_path / "t.parquet"))
    assert load_graph(spark, str(tmp_path / "t.parquet")).to_dict() == g.to_dict()
    (xml,) = convert_graph(g, tmp_path / "x", "graphml")
    back = load_graph(spark, str(xml)).to_dict()
    assert [x["label"] for x in back["nodes"]] == ["Alpha", "Beta", "3"] and back["links"][0]["confidence_score"] == 0.5 and back["nodes"][0]["is_god"]
    paths = convert_graph(g, tmp_path / "y", "neo4j")
    assert find_relationships(str(paths[0])) == str(paths[1])
    back = load_graph(spark, str(paths[0]))
    assert {r["id"]: (r["label"], r["type"], r["is_god"]) for r in back.nodes.collect()} == {"3": ("3", "", False), **dict(a=("Alpha", "function", True), b=("Beta", "class", True))}
    assert back.edges.count() == 2
    with pytest.raises(GraphError):
        convert_graph(g, tmp_path / "z", "other")


def test_neo4j_columns(spark, tmp_path):
    p = file(tmp_path, "n.csv", ":ID,name,:LABEL,importance,more\na,Alpha,Fn,0.5,x\nb,,Cl,junk,\n,lost,Fn,1,\n")
    file(tmp_path, "relationships.csv", ":START_ID,:END_ID,:TYPE,weight\na,b,CALLS,2.5\na,,BAD,1\na,zz,BAD,1\n")
    g = load_graph(spark, p)
    n = {r["id"]: r for r in g.nodes.collect()}
    assert set(n) == {"a", "b"} and n["a"]["extra"] == dict(more='"x"') and n["b"]["label"] == "Cl" and n["b"]["importance"] == 0.0
    assert [(r["relation"], r["weight"]) for r in g.edges.collect()] == [("CALLS", 2.5)]


def test_graphml_aliases(spark, tmp_path):
    keys = '<key id="k0" for="node" attr.name="name" attr.type="string"/><key id="k1" for="node" attr.name="kind" attr.type="string"/><key id="k2" for="edge" attr.name="label" attr.type="string"/><key id="k3" for="edge" attr.name="weight" attr.type="double"/>'
    body = '<node id="a"><data key="k0">Alpha</data><data key="k1">fn</data></node><node id="b"/><edge source="a" target="b"><data key="k2">calls</data><data key="k3">3</data></edge>'
    g = load_graph(spark, file(tmp_path, "g.graphml", f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">{body}</graph></graphml>'))
    assert {(r["label"], r["type"]) for r in g.nodes.collect()} == {("Alpha", "fn"), ("b", "")}
    assert [(r["relation"], r["weight"]) for r in g.edges.collect()] == [("calls", 3.0)]


@pytest.mark.parametrize("text", ["[1]", "{", '{"nodes": []}', '{"nodes": {"a": 1}}', '{"nodes": [1]}', '{"nodes": [{"label": "x"}]}'])
def test_bad_documents(text):
    with pytest.raises(GraphError):
        list(parse_json(text))


def test_bad_files(spark, tmp_path):
    for name, content in (("bad.json", "{"), ("x.txt", "a"), ("n.csv", "label\nx\n"), ("m.csv", ":ID,name\n")):
        with pytest.raises(GraphError):
            load_graph(spark, file(tmp_path, name, content))
    with pytest.raises(GraphError, match="not found"):
        load_json(spark, str(tmp_path / "missing.json"))


def test_coercion():
    assert [as_float(x, 7.0) for x in (None, "", "x", "NaN", "-inf", True, "2.5", 3)] == [7.0, 7.0, 7.0, 7.0, 7.0, 1.0, 2.5, 3.0]
    assert [as_int(x) for x in (None, "", 2.9, "2.9", "3", float("nan"))] == [None, None, 2, None, 3, None]
    assert [as_bool(x) for x in ("true", " YES ", "1", "false", "", 1, 0, None)] == [True, True, True, False, False, True, False, False]
    assert [detect_format(x) for x in (dict(nodes=[dict(id=1)]), dict(nodes=[dict(id=1, type="x")]), dict(links=[1]))] == ["generic", "graphify", "graphify"]


PY = "import os, json as j\nfrom .a import b\nclass Validate:\n    def check(self):\n        import sys\nasync def login():\n    pass\nif True:\n    def hidden(): pass\n"
TS = "import x from 'mod';\nimport 'side';\nexport default class Client {}\nexport interface Shape {}\nexport async function go() {}\nexport const arrow = async (a: number): Promise<void> => {\nlet v = 3\n"
GO = 'package store\nimport (\n  "fmt"\n  alias "net/http" // )\n)\nimport "os"\ntype DB struct {\ntype Reader interface {\nfunc Open(a int) {\nfunc (d *DB) Save() {\nfunc Map[T any](x T) {\n'


def test_parsers():
    ids = lambda found: [(n["id"], n["type"]) for n in found[0]]
    assert ids(parse_python(PY, "auth/session.py", "m"))[1:] == [("m_os", "import"), ("m_j", "import"), ("m_a_b", "import"), ("m_validate", "class"), ("m_check", "function"), ("m_sys", "import"), ("m_login", "function")]
    assert ("m_validate_check", "function") in ids(parse_python(PY, "auth/session.py", "m", True))
    assert parse_python("def (", "x.py", "m") == ([], [])
    assert ids(parse_typescript(TS, "c.ts", "m"))[1:] == [("m_mod", "import"), ("m_side", "import"), ("m_client", "class"), ("m_shape", "interface"), ("m_go", "function"), ("m_arrow", "function")]
    assert ids(parse_go(GO, "d.go", "m"))[1:] == [("m_fmt", "import"), ("m_net_http", "import"), ("m_os", "import"), ("m_db", "class"), ("m_reader", "interface"), ("m_open", "function"), ("m_save", "function"), ("m_map", "function")]
    assert ("m_db_save", "function") in ids(parse_go(GO, "d.go", "m", True))
    classes = "export class Box<T> {\n  private n = 1;\n  public async put(x: T): Promise<void> {\n    if (x) {\n      call();\n    }\n  }\n  get size(): number { return 1; }\n}\nfunction after() {}\n"
    nodes, edges = parse_typescript(classes, "c.ts", "m", methods=True)
    assert [(n["id"], n["type"]) for n in nodes][1:] == [("m_box", "class"), ("m_put", "function"), ("m_size", "function"), ("m_after", "function")]
    assert [(e["source"], e["target"]) for e in edges] == [("m", "m_box"), ("m_box", "m_put"), ("m_box", "m_size"), ("m", "m_after")]
    odd = "import { a,\nimport('x')\nconst f = x => 1\nlet g = (a) => a\nvar h: Fn = async () => 1\nexport default function* gen() {}\nconst n = (1 + 2)\nimport type { T } from \"t\"\n"
    assert ids(parse_typescript(odd, "c.ts", "m"))[1:] == [("m_g", "function"), ("m_h", "function"), ("m_gen", "function"), ("m_t", "import")]
    assert ids(parse_go('import . "dot"\nimport _ "blank"\nfunc (s Set[T]) Add(x T) {\ntype X int\nfunc (\n', "d.go", "m", True))[1:] == [("m_dot", "import"), ("m_blank", "import"), ("m_set_add", "function")]
    assert [module_id("a/b/Util.py"), module_id("top.py", "root"), module_id("top.py"), module_id("a/b/u.py", strict=True)] == ["b_util", "root_top", "top", "a_b_u"]


def test_project_index(spark, tmp_path):
    root = tmp_path / "proj"
    file(root, "pkg/a.py", "class A: pass\n")
    file(root, "pkg/b.go", "func B() {\n")
    file(root, "x/pkg/a.py", "def Z(): pass\n")
    file(root, "node_modules/n.ts", "class N {}\n")
    (root / "bad.py").write_bytes(b"\xff\xfe class")
    (root / "link.py").symlink_to(root / "pkg/a.py")
    assert source_files(root) == ["bad.py", "pkg/a.py", "pkg/b.go", "x/pkg/a.py"]
    g = index_project(spark, root)
    assert {r["id"]: r["source_file"] for r in g.nodes.collect()} == dict(pkg_a="pkg/a.py", pkg_a_a="pkg/a.py", pkg_b="pkg/b.go", pkg_b_b="pkg/b.go", pkg_a_z="x/pkg/a.py")
    assert [tuple(r) for r in clashes(parse_project(spark, root)).collect()] == [("pkg_a", "pkg/a.py", "x/pkg/a.py")]
    assert g.edges.count() == 3
    few = index_project(spark, root, ignore=lambda node, i: node["source_file"].startswith("x/"))
    assert few.nodes.count() == 4
    shot = f"file://{tmp_path}/shot"
    assert index_project_incremental(spark, root, shot).to_dict() == g.to_dict()
    file(root, "pkg/b.go", "func C() {\n")
    (root / "x/pkg/a.py").unlink()
    assert {r["id"] for r in index_project_incremental(spark, root, shot).nodes.collect()} == {"pkg_a", "pkg_a_a", "pkg_b", "pkg_b_c"}


def test_code(spark, tmp_path):
    text = "import os\n\n\ndef alpha():\n    x = 1\n\n    return x\n\n\ny = 2\n"
    assert code_block(text, 4, False) == "def alpha():\n    x = 1\n\n    return x" and code_block(text, 4, False, 2) == "def alpha():\n    x = 1"
    assert code_block("a\nfunction f() {\n  if (x) { y }\n}\nz\n", 2, True) == "function f() {\n  if (x) { y }\n}" and code_block("no brace\nx", 1, True) == "no brace"
    assert code_block(text, 99, False) is None
    assert [parse_line(x) for x in ("L42", "l7", "8", 9, 0, "L0", "-1", True, None, "", "x")] == [42, 7, 8, 9, None, None, None, None, None, None, None]
    for bad in ("../secret.txt", "/etc/passwd", "../../../../etc/passwd"):
        assert safe_path(tmp_path, bad) is None
    file(tmp_path, "m.py", text)
    g = Graph.from_records(spark, [dict(id="a", source_file="m.py", source_location="L4"), dict(id="b", source_file="/etc/passwd", source_location="L1"), dict(id="c")])
    assert [n.get("code_block") for n in inject_code(g, tmp_path).to_dict()["nodes"]] == ["def alpha():\n    x = 1\n\n    return x", None, None]
    assert inject_code(g, tmp_path, max_nodes=2) is g


def test_audit(spark, tmp_path):
    assert read_audit(spark, tmp_path).count() == 0
    for q, top in (("one", ["a", "b"]), ("two", ["b", *map(str, range(20))])):
        log_query(q, "g.json", dict(nodes_selected=2, tokens_used=9), top, tmp_path)
    with (tmp_path / "audit.jsonl").open("a") as out:
        out.write('{broken\n\n"text"\n[1]\n')
    rows = read_audit(spark, tmp_path).orderBy("timestamp").collect()
    assert [r["query"] for r in rows] == ["one", "two"] and len(rows[1]["top_nodes"]) == 10 and rows[0]["nodes_total"] is None
    assert [tuple(r) for r in top_nodes(read_audit(spark, tmp_path), 2).collect()] == [("b", 2), ("0", 1)]
    stream = node_counts(audit_stream(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / ".state")).start()
    q.awaitTermination()
    assert {r["id"]: r["count"] for r in spark.table("counts").collect()}["b"] == 2


@pytest.fixture(scope="module")
def shop(spark):
    return Graph.from_records(
        spark,
        [dict(id="auth", label="Auth", type="class", description="login: checks", importance=9.0, is_god=True, community=1, source_file="auth.py"), dict(id="login", label="login", type="function"), dict(id="db", label="</script>", type="class")],
        [dict(source="auth", target="login", relation="calls"), dict(source="login", target="db", relation="uses", weight=0.8)],
    )


def test_rendering(spark, shop):
    scores = spark.createDataFrame([("auth", 0.9), ("login", 1.0), ("db", 0.2)], "id string, score double")
    s = select_subgraph(shop, scores, 1000)
    md = render.format_subgraph(s, "markdown", scores, "log in")
    assert md.index("### login (function) · score: 1.00") < md.index("### Auth (class) · score: 0.90") and "- auth → calls → login" in md and "→ File: auth.py" in md and md.startswith("┌")
    few = select_subgraph(shop, scores, 20)
    assert f"Tip: {3 - few.stats['nodes_selected']} node(s)" in render.format_subgraph(few)
    data = json.loads(render.format_subgraph(s, "json", scores))
    assert [n["id"] for n in data["nodes"]] == ["login", "auth", "db"] and data["edges"][1] == dict(source="login", target="db", relation="uses", weight=0.8) and data["nodes"][0]["score"] == 1.0
    yml = render.format_subgraph(s, "yaml")
    assert 'description: "login: checks"' in yml and yml.index("id: auth") < yml.index("id: db")
    with pytest.raises(ValueError):
        render.format_subgraph(s, "xml")
    assert render.export_context(s, " ", "claude").startswith("<knowledge_graph_context>") and "the current task" in render.export_context(s, " ", "chatgpt") and "┌" not in render.export_context(s, "q", "claudemd")
    page = render.build_html(s, scores, "<b>")
    assert "&lt;b&gt;" in page and page.count("</script>") == 1 and "<polygon" in page
    view = render.View(s)
    assert {r["id"]: r["value"] for r in render.node_records(view)} == dict(auth=25.0, login=40.0, db=25.0)
    assert "No nodes selected" in render.build_html(select_subgraph(shop, scores, 0))


def test_engine_and_server(spark, shop, tmp_path):
    folder = f"file://{tmp_path}"
    engine = Engine(shop, folder, max_iter=5)
    assert (tmp_path / artifacts_path(shop, "x", 5).removeprefix("x/")).exists()
    ask = lambda method, mid=1, **params: respond(engine, json.dumps(dict(jsonrpc="2.0", id=mid, method=method, params=params)))
    tool = lambda name, **args: ask("tools/call", name=f"tessergraph_{name}", arguments=args)
    text = lambda r: r["result"]["content"][0]["text"]
    assert ask("initialize")["result"]["protocolVersion"] and ask("ping")["result"] == {} and len(ask("tools/list")["result"]["tools"]) == 4
    assert "### login" in text(tool("query", query="login", budget=500.0))
    assert "- Auth (auth) -[calls]-> login" in text(tool("explain", node="login")) and "god node: yes" in text(tool("explain", node="auth"))
    assert "directed path (2 hop(s))" in text(tool("path", source="auth", target="db")) and "undirected" in text(tool("path", source="db", target="auth"))
    assert "- nodes: 3\n- edges: 2" in text(tool("stats"))
    for bad in (tool("query"), tool("query", query="x", budget=1.5), tool("query", query="x", format="xml"), tool("explain", node="zz"), tool("other"), ask("tools/call")):
        assert bad["error"]["code"] == PARAMS
    assert ask("nothing")["error"]["code"] == -32601
    assert respond(engine, "{")["error"]["code"] == PARSE and respond(engine, "[1]")["error"]["code"] == REQUEST and respond(engine, '{"id": 1}')["error"]["code"] == REQUEST
    assert respond(engine, "  ") is None and respond(engine, '{"jsonrpc": "2.0", "method": "ping"}') is None
    for bad in (True, 0, -1, 1.5, "9", float("nan"), None):
        with pytest.raises(Refusal):
            budget_of(bad)
    kept = load_or_build(shop, folder)
    assert kept.costs.count() == 3


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert routed(["auth"]) == ["query", "auth"] and routed(["stats"]) == ["stats"]
    with pytest.raises(GraphError, match="did you mean 'stats'"):
        routed(["statss"])
    assert run(spark, ["stats"]) == 1 and "no graph found" in capsys.readouterr().err
    file(tmp_path, "graph.json", RICH)
    assert run(spark, ["stats"]) == 0 and "- nodes: 3" in capsys.readouterr().out
    assert run(spark, ["alpha entry", "-b", "500", "--no-cache"]) == 0 and "### Alpha" in capsys.readouterr().out
    assert run(spark, ["audit"]) == 0 and "alpha entry" in capsys.readouterr().out
    assert run(spark, ["path", "a", "3"]) == 0 and "2 hop" in capsys.readouterr().out
    assert run(spark, ["explain", "zz"]) == 1
    assert run(spark, ["init"]) == 0 and (tmp_path / ".tessergraphignore").exists()
    file(tmp_path, "new.json", dict(nodes=[dict(id="a", label="Changed")], links=[]))
    assert run(spark, ["diff", "graph.json", "new.json"]) == 0 and "-2 removed" in capsys.readouterr().out
    file(tmp_path, "src/a.py", "def f(): pass\n")
    assert run(spark, ["index", "src", "-o", "out/graph.json"]) == 0 and "Indexed 1 files: 2 nodes, 1 edges" in capsys.readouterr().out


def test_documents_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    odd = 'a "b" <c> & d\n\te\r,f  \\ é'
    nodes = [dict(id=f"n{i}", label=odd if i % 3 == 0 else "", description=odd, importance=i / 7, community=None if i % 2 else i, is_god=i == 5, source_file=None if i % 4 else "x.py", extra=dict(k='{"is_god": true}', s='"x\\n<"', f="1.5", b="true", i="3", n="null") if i % 5 == 0 else {}) for i in range(40)]
    edges = [dict(source=f"n{i}", target=f"n{i * 7 % 40}", relation=odd, weight=0.1 * i, confidence_score=0.5, extra=dict(more='{"confidence_score": 1}') if i == 3 else {}) for i in range(40)]
    g = Graph.from_records(spark, nodes, edges, [dict(id="h", nodes=["n1", "n2", "n3"], confidence_score=0.25)])
    want = g.to_dict()
    # Neither may gather the graph on the driver or parse it in one task.
    monkeypatch.setattr(Graph, "to_dict", lambda self: pytest.fail("gathered"))
    monkeypatch.setattr("tessergraph.sources.readers.parse_json", lambda text: pytest.fail("parsed whole"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        path = write_json(g, tmp_path / "lines.json")
        assert json.loads((tmp_path / "lines.json").read_text()) == want | {"layout": "one record a line"}
        (xml,) = convert_graph(g, tmp_path / "lines", "graphml")
        back, from_xml = load_graph(spark, path), load_graph(spark, xml)
        csv = load_graph(spark, convert_graph(g, tmp_path / "lines", "neo4j")[0])
        monkeypatch.undo()
        assert back.to_dict() == want
        plain = lambda d: [{k: v for k, v in x.items() if k not in ("source_file", "source_location", "source_url", "n")} for x in d]
        assert plain(from_xml.to_dict()["nodes"]) == [x | ({"k": '{"is_god": true}'} if "k" in x else {}) for x in plain(want["nodes"])]
        assert [(x["source"], x["target"], x["relation"], x["weight"]) for x in from_xml.to_dict()["links"]] == [(x["source"], x["target"], x["relation"], x["weight"]) for x in want["links"]]
        assert {r["id"]: (r["label"], r["community"]) for r in csv.nodes.collect()} == {x["id"]: (x["label"], x["community"]) for x in want["nodes"]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
