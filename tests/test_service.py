"""Paged services, played by a small server of this machine over rows in DuckDB."""

import contextlib
import io
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from strataflow.sources import service

FIELDS = [("OBJECTID", "esriFieldTypeOID", "bigint"), ("name", "esriFieldTypeString", "varchar"), ("depth", "esriFieldTypeDouble", "double"), ("kind", "esriFieldTypeSmallInteger", "int")]
N = 2345


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        part = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(part.query).items()}
        server = self.server
        server.seen[part.path, q.get("resultOffset")] += 1
        server.wheres.append(q.get("where"))
        con = server.con.cursor()
        answer: dict = {"error": {"code": 404}}
        if part.path == "/layer":
            answer = {"fields": [{"name": n, "type": t} for n, t, _ in FIELDS], "maxRecordCount": 1000}
        elif part.path == "/layer/query":
            where = q["where"] + (" and x between {0} and {2} and y between {1} and {3}".format(*q["geometry"].split(",")) if "geometry" in q else "")
            if "returnCountOnly" in q:
                answer = {"count": con.execute(f"select count(*) from rows where {where}").fetchone()[0] + server.lie}
            elif server.broken and server.seen[part.path, q["resultOffset"]] == 1 and q["resultOffset"] == "1000":
                answer = {"error": {"code": 500}}
            else:
                columns = "OBJECTID, name, depth, kind" if q["outFields"] == "*" else q["outFields"]
                found = con.execute(f"select {columns}, x, y from rows where {where} order by {q['orderByFields']} limit {q['resultRecordCount']} offset {q['resultOffset']}")
                names = [d[0] for d in found.description][:-2]
                answer = {"features": [{"attributes": dict(zip(names, r, strict=False)), "geometry": {"x": r[-2], "y": r[-1]}} for r in found.fetchall()]}
        elif part.path == "/table":
            o = int(q["resultOffset"])
            answer = {"features": [{"attributes": {"k": i}} for i in range(o, min(o + 70, 200))], "exceededTransferLimit": o + 70 < 200}
        elif part.path == "/search":
            o = int(q["start"])
            answer = {"catalog": {"results": [{"k": i, "title": f"t{i}"} for i in range(o, min(o + 30, 101))], "filter": {"total_count": "100"}}}
        elif part.path.startswith("/linked"):
            p = int(part.path[7:] or 0)
            answer = {"features": [{"type": "Feature", "properties": {"k": p}, "geometry": None}], "links": [{"rel": "self", "href": "x"}] + ([{"rel": "next", "href": f"{server.url}/linked{p + 1}"}] if p < 4 else [])}
        body = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.con, s.seen, s.wheres, s.lie, s.broken = duckdb.connect(), Counter(), [], 0, False
    s.con.execute(f"create table rows as select i as OBJECTID, case when i % 7 = 0 then null else 'it''s ' || i % 13 end as name, (i / 10.0)::double as depth, (i % 5)::int as kind, (-81 + i / 1000.0)::double as x, 33.0::double as y from range({N}) t(i)")
    s.url = f"http://127.0.0.1:{s.server_port}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_scan_reads_every_page_once(spark, server, tmp_path):
    df = service.scan(spark, f"{server.url}/layer", pages=str(tmp_path))
    assert dict(df.dtypes) == {"OBJECTID": "bigint", "name": "string", "depth": "double", "kind": "int", "geometry": "string"}
    got = df.collect()
    assert [(r.OBJECTID, r.name, r.depth, r.kind) for r in sorted(got)] == server.con.execute("select OBJECTID, name, depth, kind from rows order by 1").fetchall()
    assert json.loads(got[0].geometry)["y"] == 33.0 and df.rdd.getNumPartitions() == 3
    asked = {k: n for k, n in server.seen.items() if k[1] is not None}
    assert asked == {("/layer/query", str(o)): 1 for o in (0, 1000, 2000)}
    # A later read, or a task that runs again, finds the pages.
    assert service.scan(spark, f"{server.url}/layer", pages=str(tmp_path)).count() == N
    assert asked == {k: n for k, n in server.seen.items() if k[1] is not None}
    lost = sorted(tmp_path.glob("*.json"))[0]
    lost.unlink()
    assert service.scan(spark, f"{server.url}/layer", pages=str(tmp_path)).count() == N
    assert sorted(n for k, n in server.seen.items() if k[1] is not None) == [1, 1, 2]


def test_filters_are_pushed_down(spark, server, tmp_path):
    df = service.scan(spark, f"{server.url}/layer", where="kind < 4", pages=str(tmp_path)).where("depth >= 100 and name = \"it's 3\" and kind in (1, 2) and length(name) > 2")
    want = server.con.execute("select OBJECTID from rows where kind in (1, 2) and depth >= 100 and name = 'it''s 3' order by 1").fetchall()
    assert sorted((r.OBJECTID,) for r in df.collect()) == want and want
    assert any(w and "depth >= 100.0" in w and "name = 'it''s 3'" in w and "kind IN (1, 2)" in w and w.startswith("(kind < 4)") for w in server.wheres)
    text = plan(df)
    assert "PushedFilters" in text and "depth" in text.split("PushedFilters")[1].split("\n")[0]
    assert "depth" not in " ".join(x for x in text.split("\n") if x.startswith("Condition"))
    assert service.scan(spark, f"{server.url}/layer", pages=str(tmp_path)).where("name like 'it%' and kind is not null").count() == server.con.execute("select count(*) from rows where name is not null").fetchone()[0]


def test_columns_box_and_nothing(spark, server, tmp_path):
    df = service.scan(spark, f"{server.url}/layer", columns=["OBJECTID", "kind"], bbox=(-80.5, 32, -80.0, 34), page=100, pages=str(tmp_path))
    assert df.columns == ["OBJECTID", "kind", "geometry"]
    assert sorted(r.OBJECTID for r in df.collect()) == list(range(500, 1001))
    assert service.scan(spark, f"{server.url}/layer", where="kind > 99", pages=str(tmp_path)).collect() == []
    odd = service.scan(spark, f"{server.url}/layer", "OBJECTID int, name int, depth string, missing double, kind boolean", where="OBJECTID = 3", pages=str(tmp_path)).collect()
    assert [tuple(r) for r in odd] == [(3, None, "0.3", None, None)]


def test_wrong_counts_and_errors_fail(spark, server, tmp_path):
    server.lie = 5
    with pytest.raises(Exception, match="expected"):
        service.scan(spark, f"{server.url}/layer", pages=str(tmp_path)).collect()
    server.lie, server.broken = 0, True
    assert service.scan(spark, f"{server.url}/layer", pages=str(tmp_path / "new")).count() == N
    with pytest.raises(Exception, match="404"):
        service.scan(spark, f"{server.url}/none", "a int", pages=str(tmp_path)).collect()


def test_pages_that_lead_to_each_other(spark, server):
    ks = lambda df: sorted(r.k for r in df.select(F.col("k")).collect())
    assert ks(service.chain(spark, f"{server.url}/table", "k long", "more", {"where": "1=1"})) == list(range(200))
    assert ks(service.chain(spark, f"{server.url}/search", "k long, title string", "total", offset="start", first=1, total="catalog.filter.total_count")) == list(range(1, 101))
    assert ks(service.chain(spark, f"{server.url}/linked", "k long", "next")) == [0, 1, 2, 3, 4]


def test_conditions():
    names = {"a", "b"}
    E, N = service.EqualTo, service.Not  # noqa: N806
    assert service.condition(E(("a",), "x'y"), names) == "a = 'x''y'"
    assert service.condition(N(service.In(("a",), (1, None, 2.5))), names) == "NOT (a IN (1, 2.5))"
    assert [service.condition(f, names) for f in (E(("c",), 1), E(("a", "b"), 1), E(("a",), True), E(("a",), float("nan")), service.StringStartsWith(("a",), "5%"), N(E(("a",), None)))] == [None] * 6
