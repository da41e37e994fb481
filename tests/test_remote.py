"""Sources on a server in this process that breaks off, grows and is asked again."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from luminal.sources import remote

FAST = {"retries": 8, "backoff": 0.01, "timeout": 5}


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):
        s, name = self.server, self.path.strip("/")
        s.asked.append((name, self.headers.get("Range"), self.headers.get("Last-Event-ID")))
        if name == "events":
            return self.events()
        if name not in s.files:
            return self.send_error(404)
        if s.fail.get(name, 0) > 0:
            s.fail[name] -= 1
            return self.send_error(503)
        body, own = s.files[name], self.headers.get("Range")
        if own and name not in s.plain:
            a, b = own.removeprefix("bytes=").split("-")
            a, b = int(a), min(len(body), int(b) + 1)
            if a >= len(body):
                self.send_response(416)
                self.send_header("Content-Length", "0")
                return self.end_headers()
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(body)}")
            body = body[a:b]
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        limit = s.breaks.get(name)
        self.wfile.write(body[:limit] if limit and len(body) > 1 else body)
        if limit and len(body) > limit:
            s.breaks[name] = limit * 3
            self.close_connection = True

    def events(self):
        s, last = self.server, int(self.headers.get("Last-Event-ID") or 0)
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.end_headers()
        for k in range(last + 1, min(s.count, last + s.burst) + 1):
            self.wfile.write(f": note\nid: {k}\nevent: tick\ndata: {{\"type\":\"u\",\ndata: \"data\":{{\"id\":\"e{k}\",\"value\":{k}}}}}\n\n".encode())
        if s.count > last + s.burst:
            self.wfile.write(b"id: 999\ndata: half")  # broken off within an event


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.files, s.plain, s.breaks, s.fail, s.asked, s.count, s.burst = {}, set(), {}, {}, [], 0, 3
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_address[1]}/"
    yield s
    s.shutdown()


def body(n, end=b"\n"):
    return b"\n".join(f"line {i} é {'x' * (i % 17)}".encode() for i in range(n)) + end


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_ranges_give_every_line_once(spark, server, chunk):
    server.files = {"a": body(40 if chunk < 64 else 300), "b": body(3, b"") + b"\r\n\n\n", "c": b"", "d": b"one"}
    rows = remote.http_lines(spark, [server.url + n for n in "abcd"], chunk=chunk, **FAST).collect()
    for name, data in server.files.items():
        lines = data.split(b"\n")
        lines = lines[:-1] if not lines[-1] else lines
        own = sorted((r.offset, r.value) for r in rows if r.url.endswith("/" + name))
        assert [v for _, v in own] == [x.removesuffix(b"\r").decode() for x in lines]
        assert all(data[o : o + 4].decode(errors="ignore").startswith(v[:1]) for o, v in own)


def test_broken_connections_busy_servers_and_no_ranges(spark, server):
    server.files = {"a": body(500), "p": body(500, b"")}
    server.plain, server.breaks, server.fail = {"p"}, {"a": 11, "p": 29}, {"a": 2, "p": 1}
    rows = remote.http_lines(spark, [server.url + "a", server.url + "p"], chunk=3000, **FAST).collect()
    want = body(500, b"").decode().split("\n")
    for name in "ap":
        assert [r.value for r in sorted((r for r in rows if r.url.endswith(name)), key=lambda r: r.offset)] == want


def test_a_missing_resource_fails(spark, server):
    with pytest.raises(Exception, match="404"):
        remote.http_lines(spark, server.url + "none", **FAST).collect()
    with pytest.raises(Exception, match="url is needed"):
        remote.http_lines(spark, "", **FAST).collect()


def test_json_and_csv(spark, server):
    server.files = {"j": b'{"id":1,"v":"a"}\nbroken\n\n{"id":2,"v":null}\n', "c": b'id,v\n1,"a,b"\n2,\n'}
    assert sorted(tuple(r) for r in remote.http_json(spark, server.url + "j", "id int, v string", chunk=5, **FAST).collect()) == [(1, "a"), (2, None)]
    assert sorted(tuple(r) for r in remote.http_csv(spark, server.url + "c", "id int, v string", **FAST).collect()) == [(1, "a,b"), (2, None)]


def run(stream, path, got):
    q = stream.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", path).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_a_growing_resource_is_followed_over_restarts(spark, server, tmp_path):
    server.files, server.breaks, got = {"a": body(50) + b"half a li"}, {"a": 40}, []
    for more in (b"", b"ne\nnext\n", body(60), b"end"):
        server.files["a"] += more
        run(remote.follow_lines(spark, server.url + "a", chunk=100, **FAST), str(tmp_path / "log"), got)
    want = server.files["a"].decode().split("\n")[:-1]
    assert [r.value for r in sorted(got, key=lambda r: r.offset)] == want and want[-1] != "end"


def test_events_are_followed_over_breaks_and_restarts(spark, server, tmp_path):
    got, server.count = [], 8
    run(remote.follow_messages(spark, server.url + "events", wait=0.5, **FAST), str(tmp_path / "log"), got)
    assert [r.data.id for r in got] == [f"e{k}" for k in range(1, 9)]
    server.count = 12
    run(remote.follow_messages(spark, server.url + "events", wait=0.5, **FAST), str(tmp_path / "log"), got)
    assert [r.data.id for r in got] == [f"e{k}" for k in range(1, 13)]
    assert "8" in [a[2] for a in server.asked]
