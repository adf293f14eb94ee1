import json
import threading
import urllib.request

import pytest

from sparkvec.service import Service, serve


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return Service(spark, str(tmp_path_factory.mktemp("service")))


def test_routes(service):
    h = service.handle
    assert h("GET", "/health")[1]["status"] == "ok"
    made = h("POST", "/collections?name=c", {"dim": 4})
    assert made[0] == 200 and {k: v for k, v in made[1].items() if k != "created_at"} == {"name": "c", "dim": 4, "metric": "l2", "index_type": "flat", "index_params": {}, "num_items": 0, "enable_wal": False}
    assert h("POST", "/collections?name=c", {"dim": 4})[0] == 400
    assert h("POST", "/collections?name=../x", {"dim": 4})[0] == 400
    assert h("POST", "/collections?name=d", {"dim": 4, "index_type": "ivf", "index_params": {"zz": 1}})[0] == 400
    assert h("POST", "/collections?name=d", {})[0] == 422 == h("POST", "/collections", {"dim": 2})[0]
    assert h("POST", "/collections/c/insert", {"id": 1, "vector": [0.1, 0.2, 0.3, 0.4], "metadata": {"category": "A"}})[0] == 200
    more = [{"id": 2, "vector": [0.5, 0.6, 0.7, 0.8], "metadata": {"category": "B"}}, {"id": 3, "vector": [0.9, 0.8, 0.7, 0.6], "metadata": {"category": "A"}}]
    assert h("POST", "/collections/c/insert_many", {"records": more})[1]["message"] == "2 vectors inserted"
    assert h("POST", "/collections/c/insert", {"id": "1", "vector": []})[0] == 422
    status, out = h("POST", "/collections/c/search", {"query": [0.1, 0.2, 0.3, 0.4], "top_k": 2})
    assert status == 200 and [r["id"] for r in out["results"]][0] == 1 and len(out["results"]) == 2 and out["query_time_ms"] > 0
    only = h("POST", "/collections/c/search", {"query": [0.1, 0.2, 0.3, 0.4], "filter": {"category": "A"}})[1]["results"]
    assert [r["metadata"]["category"] for r in only] == ["A", "A"]
    assert h("POST", "/collections/c/search", {"query": [0.1] * 4, "top_k": 0})[0] == 422
    assert h("POST", "/collections/c/delete", {"id": 2})[0] == 200
    assert h("GET", "/collections/c/stats")[1]["num_items"] == 2 == h("GET", "/collections/c")[1]["num_items"]
    assert [c["name"] for c in h("GET", "/collections")[1]] == ["c"]
    assert h("POST", "/collections/c/checkpoint")[0] == 404
    assert h("GET", "/collections/none")[0] == 404 == h("GET", "/nowhere")[0]
    assert h("DELETE", "/collections/c")[0] == 200 and h("DELETE", "/collections/c")[0] == 404


def test_durable_collections_return(spark, tmp_path):
    first = Service(spark, str(tmp_path))
    first.handle("POST", "/collections?name=w", {"dim": 1, "enable_wal": True})
    first.handle("POST", "/collections/w/insert", {"id": 1, "vector": [1.0]})
    second = Service(spark, str(tmp_path))
    assert second.handle("GET", "/collections/w/stats")[1]["num_items"] == 1
    assert second.handle("POST", "/collections/w/checkpoint") == (200, {"message": "Checkpoint completed"})


def test_index_parameters_are_told(spark, tmp_path):
    h = Service(spark, str(tmp_path)).handle
    for name, kind, params in (("i", "ivf", {"nlist": 10, "nprobe": 3}), ("h", "hnsw", {"M": 16, "ef_search": 64})):
        h("POST", f"/collections?name={name}", {"dim": 4, "index_type": kind, "index_params": params})
        told = h("GET", f"/collections/{name}")[1]
        assert told["index_type"] == kind and params.items() <= told["index_params"].items()
    assert {c["name"] for c in h("GET", "/collections")[1]} == {"i", "h"}


def test_over_http(service):
    server = serve(service, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=60) as answer:
            assert json.load(answer)["status"] == "ok"
    finally:
        server.shutdown()
        server.server_close()
