"""Work budgets of the kernel, and lookups in services, against a server in this process."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from spawnlens.operators import kernel
from spawnlens.plans import intake
from spawnlens.sources import explorer, fetch


def steps(code, enhanced=False):
    p = kernel.Program(code)
    depth = p.depths() if enhanced else p.reachable()
    for k in sorted(depth):
        p.creations(k, enhanced)
    return p.steps


def test_work_is_bounded_by_steps_and_not_by_length():
    slow = "5b57" * 300 + "f0" * 300  # blocks that jump, and creations that are looked around
    easy = "60" + "00" * 20 + "00" * 3000  # longer, and it stops at once
    assert len(easy) > len(slow) and steps(easy, True) < steps(slow, True)
    may = steps(easy, True)
    assert kernel.guarded(easy, True, None, may)[-1] is None and kernel.guarded(slow, True, None, may)[-1] == "timeout"
    for code in (slow, easy, "", "0x", None, "f0", "zz"):
        for enhanced in (False, True):
            if code is not None and kernel.Program(code).ops:
                n = steps(code, enhanced)
                assert kernel.guarded(code, enhanced, None, n) == kernel.detect(code, enhanced)
                assert kernel.guarded(code, enhanced, None, n - 1)[-1] == "timeout"
            else:
                assert kernel.guarded(code, enhanced, None, 1) == kernel.detect(code, enhanced)
    # A very long code is not read beyond its budget.
    began = time.process_time()
    assert kernel.guarded("5b" * 5_000_000, True, None, 1000)[-1] == "timeout" and time.process_time() - began < 1


def test_budgeted_query_counts_steps(spark, sf_dir):
    rows = intake.detect_budgeted(spark, sf_dir).collect()
    codes = {r["bytecode_hash"]: r["code"] for r in intake._codes(spark, sf_dir).collect()}
    assert {r["bytecode_hash"] for r in rows} == set(codes)
    late = 0
    for r in rows:
        over = steps(codes[r["bytecode_hash"]]) > intake.STEPS
        late += over
        want = (False, "NONE", "timeout") if over else tuple(kernel.detect(codes[r["bytecode_hash"]])[k] for k in (0, 1, 13))
        assert (r["is_factory"], r["factory_type"], r["error"]) == want
    assert 0 < late < len(rows)


class Service(BaseHTTPRequestHandler):
    seen: dict = {}
    open_now, most = 0, 0
    lock = threading.Lock()

    def log_message(self, *args):
        pass

    def reply(self, status, body, **headers):
        raw = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        with Service.lock:
            Service.open_now += 1
            Service.most = max(Service.most, Service.open_now)
        try:
            time.sleep(0.01)
            self.answer()
        finally:
            with Service.lock:
                Service.open_now -= 1

    def answer(self):
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        with Service.lock:
            n = Service.seen[self.path] = Service.seen.get(self.path, 0) + 1
        if u.path != "/api":
            files = {"/repo/partial_match/1/0xab/metadata.json": {"sources": {"A b.sol": {}, "in.sol": {"content": "inline"}}, "compiler": {"version": "0.8"}}}
            if u.path == "/repo/partial_match/1/0xab/sources/A%20b.sol":
                return self.reply(200, b"contract A {}")
            return self.reply(200, files[u.path]) if u.path in files else self.reply(404, b"")
        a, source = q["address"], q["action"] == "getsourcecode"
        if a == "0xbusy" and n < 3:
            return self.reply(429, b"", Retry_After="0")
        if a == "0xdown":
            return self.reply(503, b"")
        if a == "0xdenied":
            return self.reply(403, b"")
        if a == "0xodd":
            return self.reply(200, b"<html>")
        if a == "0xnone":
            return self.reply(200, {"status": "0", "result": "no"} if source else {"result": "0x"})
        if a == "0xempty":
            return self.reply(200, {"status": "1", "result": [{"SourceCode": ""}]} if source else {"result": ""})
        return self.reply(200, {"status": "1", "result": [{"SourceCode": f"src {a}", "ContractName": "N", "CompilerVersion": "v"}]} if source else {"result": f"0x60{a[2:]}"})


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_explorer_lookups(spark, service):
    names = ["0xbusy", "0xdown", "0xdenied", "0xodd", "0xnone", "0xempty", *(f"0x{k:02}" for k in range(40))]
    rows = spark.createDataFrame([(a,) for a in [*names, "0x01", None]], "address string")
    Service.seen, Service.most = {}, 0
    got = {r["address"]: r for r in explorer.look_up(rows, explorer.Explorer(f"{service}/api", "key", tries=3, wait_s=0.01), tasks=2, in_flight=3).collect()}
    assert set(got) == set(names) and Service.most <= 2 * 3
    for k in range(40):
        r = got[f"0x{k:02}"]
        assert (r["source_code"], r["contract_name"], r["bytecode"], r["problem"]) == (f"src 0x{k:02}", "N", f"0x60{k:02}", None)
    assert got["0xbusy"]["source_code"] == "src 0xbusy" and got["0xbusy"]["problem"] is None
    for a in ("0xnone", "0xempty"):  # no answer is not a failure
        assert (got[a]["source_code"], got[a]["bytecode"], got[a]["problem"]) == (None, None, None)
    assert "status 503, 3 times" in got["0xdown"]["problem"] and "status 403" in got["0xdenied"]["problem"] and got["0xodd"]["problem"].count(":") >= 2
    tries = {a: sum(n for p, n in Service.seen.items() if f"address={a}&" in p) for a in ("0xdown", "0xdenied", "0x07")}
    assert tries == {"0xdown": 6, "0xdenied": 2, "0x07": 2}


def test_nothing_listens():
    row = explorer.Explorer("http://127.0.0.1:9/api", tries=2, wait_s=0.01).look_up("0x1")
    assert row[:5] == ("0x1", None, None, None, None) and row[5].startswith("source: ") and "2 times" in row[5]


def test_answers_are_handed_on_in_order_and_few_are_held():
    begun, handed = [], []

    def work(k):
        begun.append(k)
        return k

    for k in explorer.in_order(range(50), work, 5):
        handed.append(k)
        assert len(begun) - len(handed) <= 5
    assert handed == list(range(50))


def test_packages_from_a_repository_service(spark, service):
    spark.dataSource.register(fetch.PackageSource)
    df = spark.read.format("contract_sources").options(chain="1", addresses="0xab,0xcd", provider="spawnlens.sources.explorer:HttpProvider").load(f"{service}/repo")
    rows = df.collect()
    assert len(rows) == 1 and (rows[0]["source_status"], rows[0]["compiler"]) == ("partial_match", "0.8")
    assert [tuple(f) for f in rows[0]["files"]] == [("A b.sol", "contract A {}"), ("in.sol", "inline")]
