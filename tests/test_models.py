import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pagewright.functions import replies
from pagewright.sources import chat
from pyspark.sql import functions as F


def test_objects_in_replies():
    for text in ('{"a": 1}', 'Sure:\n```json\n{"a": 1}\n```\nDone', 'It is {"a": 1} so', '"{" then {"a": 1} {"b": 2}', '} {"a": 1}'):
        assert json.loads(replies.extract_json(text)) == {"a": 1}
    assert replies.extract_json('x {"a": "}') is None and replies.extract_json("none") is None and replies.extract_json(None) is None
    assert replies.extract_json('t {"a": "\\"}"} u') == '{"a": "\\"}"}'


def test_parse_and_strict():
    assert replies.parse('{"sufficient": true, "response": "x", "more": 1}', replies.READING) == {"sufficient": True, "response": "x", "absent": False, "quote": ""}
    for bad in ('{"sufficient": "maybe", "response": "x"}', '{"response": "x"}', "[]", "{"):
        assert replies.parse(bad, replies.READING) is None
    assert replies.parse('{"terms": ["a", 1]}', replies.TERMS) is None
    nested = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}}}}}
    tight = replies.strict(nested)
    assert tight["required"] == ["a"] and tight["properties"]["a"]["items"] == {"type": "object", "properties": {"b": {"type": "string"}}, "additionalProperties": False, "required": ["b"]}
    assert "required" not in nested


def test_clipped_titles(spark):
    df = spark.createDataFrame([(1, ["one", "two"]), (2, []), (3, ["x" * 300] * 4)], "i int, t array<string>")
    got = {r.i: r.x for r in df.select("i", replies.clip_titles(F.col("t")).alias("x")).collect()}
    assert got[1] == "- one\n- two" and got[2] == "(no headings)" and got[3] == "- " + "x" * 300 + "\n- … (3 more)"


@pytest.fixture
def server():
    seen, queue = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = queue.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, queue
    http.shutdown()


def test_models_over_http(server, monkeypatch):
    url, seen, queue = server
    monkeypatch.setattr(chat.time, "sleep", lambda s: None)
    asked = [chat.message("user", "q")]
    queue += [(503, {}), (200, {"message": {"content": '{"terms": ["a"]}'}})]
    assert chat.OllamaChat(url, "m").structured(asked, replies.TERMS, 9) == {"terms": ["a"]}
    assert seen[-1][0] == "/api/chat" and seen[-1][1]["options"] == {"temperature": 0.0, "seed": 0, "num_predict": 9} and seen[-1][1]["format"]["additionalProperties"] is False
    queue += [(200, {"choices": [{"message": {"content": "no"}}]}), (200, {"choices": [{"message": {"content": '{"terms": []}'}}]})]
    assert chat.OpenAIChat(url, "m").structured(asked, replies.TERMS) == {"terms": []}
    assert len(seen[-1][1]["messages"]) == 3 and seen[-1][1]["response_format"]["json_schema"]["strict"]
    queue += [(200, {"choices": [{"message": {"content": "no"}}]})] * 2
    with pytest.raises(chat.ReplyError):
        chat.OpenAIChat(url, "m", structured_mode="none").structured(asked, replies.TERMS)
    before = len(seen)
    queue += [(400, {}), (200, {})]
    with pytest.raises(chat.BackendError):
        chat.OllamaChat(url, "m").complete(asked)
    assert len(seen) == before + 1  # a bad request is not sent again
    with pytest.raises(chat.BackendError):
        chat.OllamaChat(url, "m").for_model("n").complete(asked)
    assert seen[-1][1]["model"] == "n" and not chat.OllamaChat("http://127.0.0.1:9", "m").health()
