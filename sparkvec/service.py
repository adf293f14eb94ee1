"""The HTTP surface: a dispatcher without a framework, and an adapter of the standard library.

``python -m sparkvec.service --port 8000 --data-dir DIR`` serves it.
"""

from __future__ import annotations

import argparse
import json
import re
import time
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from sparkvec.plans.config import CollectionConfig
from sparkvec.sources.catalog import Catalog


class BadRequest(ValueError):
    """A body that does not fit its route."""


def _field(body: dict, name: str, kind, default=...):
    value = body.get(name, default)
    if value is ...:
        raise BadRequest(f"{name} is missing")
    if value is not default and (not isinstance(value, kind) or isinstance(value, bool)):
        raise BadRequest(f"{name} has the wrong type")
    return value


class Service:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.catalog = spark, Catalog(spark, data_dir)
        one = r"/collections/([^/]+)"
        self.routes = [
            ("GET", r"/health", self.health),
            ("POST", r"/collections", self.create),
            ("GET", r"/collections", lambda body, query: [self.info(n) for n in sorted(self.catalog.open)]),
            ("GET", one, lambda body, query, name: self.info(name)),
            ("DELETE", one, self.drop),
            ("GET", one + "/stats", lambda body, query, name: self.catalog.get(name).stats()),
            ("POST", one + "/insert", self.insert),
            ("POST", one + "/insert_many", self.insert_many),
            ("POST", one + "/delete", self.delete),
            ("POST", one + "/search", self.search),
            ("POST", one + "/checkpoint", self.checkpoint),
        ]

    def info(self, name: str) -> dict:
        """What the service tells of a collection."""
        c = self.catalog.get(name)
        known = c.config
        return {
            "name": name, "dim": known.dim, "metric": known.metric, "index_type": known.index_type, "index_params": known.params,
            "num_items": len(c), "enable_wal": known.enable_wal, "created_at": known.created_at,
        }

    def handle(self, method: str, target: str, body: dict | None = None) -> tuple[int, dict | list]:
        """(status, JSON) of a request: 400 bad input, 404 unknown route or name, 422 a body of the wrong shape."""
        url = urlsplit(target)
        query = {k: v[-1] for k, v in parse_qs(url.query).items()}
        for verb, pattern, handler in self.routes:
            if verb == method and (m := re.fullmatch(pattern, url.path)):
                try:
                    return 200, handler(body or {}, query, *m.groups())
                except BadRequest as e:
                    return 422, {"detail": str(e)}
                except KeyError as e:
                    return 404, {"detail": str(e.args[0])}
                except ValueError as e:
                    return (400 if url.path == "/collections" else 404), {"detail": str(e)}
        return 404, {"detail": "no such route"}

    def health(self, body, query):
        self.spark.sql("select 1").first()
        return {"status": "ok", "timestamp": datetime.now(timezone.utc).isoformat()}

    def create(self, body, query):
        if "name" not in query:
            raise BadRequest("name is missing")
        known = {"dim", "metric", "index_type", "index_params", "enable_wal", "auto_checkpoint_threshold"}
        if extra := set(body) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        _field(body, "dim", int)
        self.catalog.create(query["name"], CollectionConfig(**{k: v for k, v in body.items() if v is not None}))
        return self.info(query["name"])

    def drop(self, body, query, name):
        self.catalog.delete(name)
        return {"message": f"Collection '{name}' deleted"}

    def insert(self, body, query, name):
        self.catalog.get(name).insert(_field(body, "id", int), _field(body, "vector", list), _field(body, "metadata", dict, None))
        return {"message": "Vector inserted"}

    def insert_many(self, body, query, name):
        records = _field(body, "records", list)
        parts = [(_field(r, "id", int), _field(r, "vector", list), _field(r, "metadata", dict, None)) for r in records]
        self.catalog.get(name).insert_many(*([p[i] for p in parts] for i in range(3)))
        return {"message": f"{len(records)} vectors inserted"}

    def delete(self, body, query, name):
        self.catalog.get(name).delete(_field(body, "id", int))
        return {"message": "Vector deleted"}

    def search(self, body, query, name):
        vector, top_k = _field(body, "query", list), _field(body, "top_k", int, 5)
        if top_k <= 0:
            raise BadRequest("top_k must be positive")
        began = time.perf_counter()
        hits = self.catalog.get(name).enriched(vector, top_k, _field(body, "filter", dict, None))
        return {"results": [{"id": i, "distance": d, "metadata": m} for i, d, m in hits], "query_time_ms": 1000 * (time.perf_counter() - began)}

    def checkpoint(self, body, query, name):
        collection = self.catalog.get(name)
        if not collection.config.enable_wal:
            raise ValueError(f"{name} has no write-ahead log")
        collection.checkpoint()
        return {"message": "Checkpoint completed"}


def serve(service: Service, host: str, port: int) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = service.handle(self.command, self.path, json.loads(raw) if raw else None)
            except json.JSONDecodeError as e:
                status, out = 422, {"detail": str(e)}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args):
            pass

    return HTTPServer((host, port), Handler)


def main() -> None:
    options = argparse.ArgumentParser(description="Serve collections over HTTP.")
    options.add_argument("--host", default="127.0.0.1")
    options.add_argument("--port", type=int, default=8000)
    options.add_argument("--data-dir", required=True)
    given = options.parse_args()
    service = Service(SparkSession.builder.appName("sparkvec").getOrCreate(), given.data_dir)
    try:
        serve(service, given.host, given.port).serve_forever()
    finally:
        service.catalog.close()


if __name__ == "__main__":
    main()
