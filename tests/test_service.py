import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from semlake.__main__ import main
from semlake.engine import Engine
from semlake.plans.catalog import Catalog
from semlake.plans.discovery import discover
from tests.test_mappings import RML

Q = "PREFIX v: <http://v/> SELECT ?d ?m { ?d v:label ?m } ORDER BY ?d"


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    at = tmp_path_factory.mktemp("service")
    (at / "drug.tsv").write_text("id\tlabel\tmass\tsame\tt\n1\taspirin\t180.2\thttp://e/x\t7\n2\tcure\t\t\t\n")
    (at / "target.tsv").write_text("id\tlabel\n7\tseven\n")
    (at / "maps.ttl").write_text(RML)
    t = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    (at / "rdf.nt").write_text(f'<http://e/x> <{t}> <http://v/Extern> .\n<http://e/x> <http://v/near> <http://e/y> .\n<http://e/y> <{t}> <http://v/Place> .\n<http://e/y> <http://v/note> "n" .\n<http://e/y> <{t}> <http://www.w3.org/2002/07/owl#Thing> .\n')
    sources = {"datasources": [{"name": "files", "url": str(at), "type": "tsv", "params": {}, "mappings": ["maps.ttl"]}, {"name": "rdf", "url": str(at / "rdf.nt"), "type": "ntriples", "params": {}, "mappings": []}]}
    (at / "sources.json").write_text(json.dumps(sources))
    return at


def test_discovery(spark, lake):
    c = discover(spark, Catalog.from_json(lake / "sources.json"))
    assert c.molecules["http://v/Extern"].predicates == {"http://v/near": {"http://v/Place"}} and c.molecules["http://v/Extern"].sources == {"rdf": {"http://v/near"}}
    assert c.molecules["http://v/Drug"].predicates["http://v/same"] == {"http://v/Extern"}
    assert not any("owl#" in m for m in c.molecules)


def test_command_line(spark, lake, capsys):
    assert main(["catalog", "-s", str(lake / "sources.json"), "-o", str(lake / "config.json")]) == 0
    made = json.loads((lake / "config.json").read_text())
    assert {t["rootType"] for t in made["templates"]} >= {"http://v/Drug", "http://v/Place"} and made["datasources"][0]["mappings"] == ["maps.ttl"]
    main(["query", "-c", str(lake / "config.json"), "-q", Q])
    assert capsys.readouterr().out.splitlines() == ["d\tm", "http://d/drug/1\taspirin", "http://d/drug/2\tcure", "http://d/target/7\tseven"]
    (lake / "q1").write_text(Q)
    main(["query", "-c", str(lake / "config.json"), "-q", str(lake / "q1"), "-s"])
    line = capsys.readouterr().out.strip().split("\t")
    assert line[0] == "q1" and line[5:] == ["done", "3"]
    main(["query", "-c", str(lake / "config.json"), "-q", Q, "-e"])
    assert "star of ?d" in capsys.readouterr().out


def test_http(spark, lake):
    from semlake.service import serve

    server = serve(Engine(spark, Catalog.from_json(lake / "sources.json")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def get(path, **params):
        with urllib.request.urlopen(f"{base}{path}?{urllib.parse.urlencode(params)}") as r:
            return json.loads(r.read())

    whole = get("/sparql", query=Q)
    assert whole["totalRows"] == 3 and whole["vars"] == ["d", "m"] and whole["result"][0]["m"] == {"type": "literal", "value": "aspirin", "xml:lang": "en"} and len(whole["querytriples"]) == 1
    first = get("/sparql", query=Q, blocking=0)
    assert len(first["result"]) == 1
    assert [len(get("/nextresult", query=Q)["result"]) for _ in range(4)] == [1, 1, 0, 0]
    for path, code in (("/sparql?query=SELECT", 400), ("/other", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == code
    server.shutdown()
