"""Fixtures and requests on executors: line ends, the first fault of a file, answers kept over failures."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from assayer.sources import fixtures, http_provider
from assayer.sources.fixtures import FixtureError
from assayer.sources.journal import Journal


def output(i, text="o"):
    return json.dumps({"eval_id": f"e{i}", "output": text}, ensure_ascii=False)


def put(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_lines_end_as_text_files_do(spark, tmp_path):
    """Only line feeds and carriage returns end a line; other separators may stand in a JSON string."""
    odd = "a\u2028b\u2029c\u0085d"
    text = "﻿" + output(1, odd) + "\r\n" + output(2) + "\r" + output(3) + "\n" + output(4, "")
    got = {r.eval_id: r.output for r in fixtures.read_outputs(spark, put(tmp_path / "f", text), "baseline").collect()}
    assert got == {"e1": odd, "e2": "o", "e3": "o", "e4": ""}
    with pytest.raises(FixtureError, match="line 2: "):  # a form feed is no white space of JSON, and ends no line
        fixtures.read_outputs(spark, put(tmp_path / "g", output(1, odd) + "\n\x0c" + output(2)), "baseline")


@pytest.mark.parametrize(
    ("lines", "fault"),
    [
        ([output(1), "{", output(1)], "line 2: "),
        ([output(1), output(2), output(1), "{"], "line 3: e1 is repeated"),
        ([output(2), output(1), output(1), output(2), output(1)], "line 3: e1 is repeated"),
        ([output(1), "", output(2)], "line 2: "),
        ([output(1), '{"eval_id": " ", "output": ""}'], "line 2: both must be text"),
        ([output(1), '{"eval_id": "x"}'], "line 2: exactly eval_id, output"),
    ],
)
def test_the_first_fault_of_a_file(spark, tmp_path, lines, fault):
    with pytest.raises(FixtureError, match=fault):
        fixtures.read_outputs(spark, put(tmp_path / "f", "\n".join(lines)), "baseline")


def test_bytes_that_are_no_text(spark, tmp_path):
    with pytest.raises(FixtureError, match="UTF-8"):
        fixtures.read_outputs(spark, put(tmp_path / "f", b'{"eval_id": "\xff", "output": ""}'), "baseline")


def test_line_numbers_over_blocks(spark, tmp_path):
    """A file of many blocks: the same line numbers as in one piece."""
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        n = 20_000
        path = put(tmp_path / "f", "\n".join(output(i) for i in range(n)))
        assert fixtures.read_outputs(spark, path, "baseline").count() == n
        path = put(tmp_path / "g", "\n".join([*(output(i) for i in range(n)), output(7), output(3)]))
        with pytest.raises(FixtureError, match=f"line {n + 1}: e7 is repeated"):
            fixtures.read_outputs(spark, path, "baseline")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_judge_fixtures(spark, tmp_path):
    line = lambda **k: json.dumps({"eval_id": "e", "role": "baseline", "outputs": ["x"]} | k)
    rows = fixtures.read_judge(spark, put(tmp_path / "f", line() + "\n" + line(role="candidate", outputs=["x", "y"]))).collect()
    assert sorted((r.role, len(r.outputs)) for r in rows) == [("baseline", 1), ("candidate", 2)]
    for bad, fault in ((line() + "\n" + line(), "line 2: baseline:e is repeated"), (line(outputs=[]), "one or two"), (line(role="x"), "a role"), ('{"eval_id": "e", "eval_id": "e"}', "repeated")):
        with pytest.raises(FixtureError, match=fault):
            fixtures.read_judge(spark, put(tmp_path / "g", bad))


@pytest.fixture
def service():
    """A model that fails every call beyond a limit, and counts calls and how many ran at once."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with server.lock:
                server.calls += 1
                server.running += 1
                server.most = max(server.most, server.running)
                well = server.calls <= server.limit
            body = json.dumps({"response": f"to {asked['prompt']}", "done": True} if well else {"error": "no more"}).encode()
            self.send_response(200 if well else 500)
            self.end_headers()
            self.wfile.write(body)
            with server.lock:
                server.running -= 1

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.lock, server.calls, server.running, server.most, server.limit = threading.Lock(), 0, 0, 0, 10**9
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_a_task_that_runs_again_asks_for_what_is_missing(spark, tmp_path, service):
    rows = spark.createDataFrame([("baseline", f"e{i:03}", f"p{i}") for i in range(100)], "role string, eval_id string, prompt string").coalesce(1)
    provider, journal = http_provider.HttpProvider(f"http://127.0.0.1:{service.server_port}", "m"), Journal(f"file://{tmp_path}/journal")
    service.limit = 50
    with pytest.raises(Exception, match="no more"):
        http_provider.generate(rows, provider, journal).collect()
    asked = service.calls
    assert 50 < asked <= 50 + http_provider.PARALLEL + 100 and service.most <= http_provider.PARALLEL
    service.limit, service.calls = 10**9, 0
    got = {r.eval_id: r.output for r in http_provider.generate(rows, provider, journal).collect()}
    assert got == {f"e{i:03}": f"to p{i}" for i in range(100)} and service.calls == 50
    http_provider.generate(rows, provider, journal).collect()
    assert service.calls == 50
    events = {r.event: r.n for r in journal.entries(spark).groupBy("event").count().withColumnRenamed("count", "n").collect()}
    assert events["answered"] == 100 and events["begun"] == asked + 50 and events["failed"] == asked - 50
    attempts = journal.entries(spark).filter("event = 'answered'").select("attempt").distinct().collect()
    assert {r.attempt for r in attempts} <= {1, 2}


def test_another_request_has_another_key(spark, tmp_path, service):
    journal = Journal(f"file://{tmp_path}/journal")
    rows = lambda prompt: spark.createDataFrame([("baseline", "e", prompt)], "role string, eval_id string, prompt string")
    url = f"http://127.0.0.1:{service.server_port}"
    for prompt, model in (("a", "m"), ("b", "m"), ("a", "n"), ("a", "m")):
        http_provider.generate(rows(prompt), http_provider.HttpProvider(url, model), journal).collect()
    assert service.calls == 3 and Journal(f"file://{tmp_path}/none").entries(spark).count() == 0
