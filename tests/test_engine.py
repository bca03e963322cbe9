"""Import and match from end to end, policies, stores, streams, the command line and the hook."""

import hashlib
import http.server
import json
import math
import os
import pathlib
import threading
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.functions import policy, text, vectors
from recallspark.operators import evaluate, match, ranking
from recallspark.operators.exact import normalize_exact
from recallspark.operators.legacy import normalize_calls
from recallspark.operators.semantic import normalize_semantic
from recallspark.plans import api, cli, hook
from recallspark.sources.embedders import TextEmbedder, create_embedder, embedded, features, squash
from recallspark.sources.tables import MOST_DELTAS, StaleTable, exact_table, semantic_table
from recallspark.streaming import imports

def hashing(n):
    return create_embedder("hashing", dimensions=n)


SEARCH = "https://html.duckduckgo.com/html/?q="
T0 = 1783497601


def record(key, tool, call, text_="ok", ended="2026-07-08T08:00:01Z", source="tool", **response):
    kind = {"terminal": "TerminalObservation", "web_search": "SearchObservation"}.get(tool, "BrowserObservation")
    answer = {"kind": kind, "is_error": False, "content": [{"type": "text", "text": text_}]} | ({"exit_code": 0} if tool == "terminal" else {}) | response
    out = {"record_key": key, "tool_name": tool, "tool_input": call, "tool_response": answer, "started_at": ended, "ended_at": ended}
    return out | ({"execution_source": source} if source else {})


def log(path, *records):
    (path / "tool_calls.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    return str(path)


def curl(q, tail=""):
    return {"kind": "TerminalAction", "command": f"curl -s '{SEARCH}{q}'{tail}"}


def calls(spark, *rows):
    return spark.createDataFrame([(k, t, json.dumps(c)) for k, (t, c) in enumerate(rows)], "query_id long, tool_name string, tool_input string")


@pytest.fixture(scope="module")
def exact_db(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("exact")
    records = [
        record("a", "terminal", curl("one"), "first"), record("b", "terminal", curl("one"), "again", "2026-07-08T08:00:11Z"), record("c", "terminal", curl("two"), exit_code=1),
        record("d", "web_search", {"kind": "SearchAction", "query": "three"}), record("e", "web_search", {"query": "four"}, "Cookie: sessionid=abc"),
        record("f", "terminal", curl("five"), source="hook_replacement"), record("g", "terminal", curl("six"), source=None), record("h", "terminal", {"command": "curl --url foo"}),
        record("i", "browser_navigate", {"url": SEARCH + "seven"}), {"tool_name": "terminal", "tool_input": curl("x")}, "[1, 2]", record("j", "terminal", {"command": "ls"}),
    ]
    report = api.ingest_exact_records(spark, log(at, *records), str(at / "db"), "s")
    return at, report


def test_exact_report(exact_db):
    _, r = exact_db
    assert (r["seen"], r["imported"], r["unsupported"]) == (11, 5, 6)
    assert r["operation_counts"] == {"web_search_curl": 3, "web_search": 1, "web_search_browser": 1} and r["status_counts"] == {"success": 4, "failed": 1}
    assert r["outcome_counts"] == {"imported": 5, "secret_response": 1, "origin": 2, "broken_url": 1, "invalid": 1, "unsupported": 1}
    assert r["provenance_counts"]["execution_source='hook_replacement' is not an origin"] == 1
    assert r["database"]["total"] == 5


def test_exact_match(spark, exact_db):
    db = str(exact_db[0] / "db")
    ask = lambda tool, call, now, **o: api.match_exact(spark, db, tool, call, now, cache_scope=o.pop("scope", "s"), **o)
    hit = ask("terminal", curl("one"), T0 + 60)
    assert hit["reusable"] and hit["match_count"] == 2 and hit["selected"]["record_key"] == "b" and hit["tool_response"]["content"][0]["text"] == "again"
    assert [m["record_key"] for m in hit["matches"]] == ["b", "a"] and hit["reason"] == match.REUSE
    assert not ask("terminal", curl("one"), T0 + 10_000)["reusable"] and ask("terminal", curl("one"), T0 + 10_000)["reason"] == match.STALE
    assert ask("terminal", curl("one"), T0, scope="other")["reason"] == match.NO_KEY
    failed = ask("terminal", curl("two"), T0 + 1)
    assert failed["matched"] and failed["reason"] == match.FAILED + "exit_code=1" and "tool_response" not in failed
    assert ask("terminal", {"command": "ls"}, T0)["supported"] is False
    assert "changes tab state" in ask("browser_navigate", {"url": SEARCH + "seven"}, T0)["reason"]
    assert ask("terminal", curl("one", " || x"), T0 + 1)["reason"] == match.STALE  # the same key, but not to be answered
    assert ask("terminal", curl("one"), T0 + 1, limit=1)["match_count"] == 1


def test_rebuild_and_snapshots(spark, tmp_path):
    src, db = tmp_path / "log", str(tmp_path / "db")
    src.mkdir()
    with pytest.raises(FileNotFoundError):
        exact_table(spark, db).read()
    assert not (tmp_path / "db").exists()
    path = log(src, record("a", "web_search", {"query": "x"}), record("a", "web_search", {"query": "y"}))
    assert api.ingest_exact_records(spark, path, db)["database"]["total"] == 1
    before = exact_table(spark, db).read()
    assert json.loads(before.first()["tool_input"]) == {"query": "y"}  # of records with one key the last one stays
    assert api.ingest_exact_records(spark, path, db)["database"]["total"] == 1
    log(src, record("a", "terminal", {"command": "ls"}))
    assert api.ingest_exact_records(spark, path, db)["database"]["total"] == 0
    assert before.count() == 1  # a reader keeps its snapshot
    exact_table(spark, db).vacuum(1)
    log(src, record("a", "terminal", {"command": "ls"}), "", "[1]", "{broken")
    with pytest.raises(ValueError, match=r"Invalid JSON at .*tool_calls\.jsonl:4: "):
        api.ingest_exact_records(spark, path, db)
    assert exact_table(spark, db).read().count() == 0


def test_normalize_exact(spark):
    rows = [
        ("web_search", {"query": "a"}), ("web_search", {"q": " "}), ("Browser_Search", {"text": "b"}), ("web_search", {"query": "a", "max_tokens": 1}), ("database_search_and_delete", {"query": "a"}),
        ("browser_navigate", {"url": "https://e.com/page"}), ("browser_navigate", {"url": "HTTPS://E.com:443/search?q=1#x", "new_tab": True}), ("browser_navigate", {"url": "https://e.com/search?q=1"}),
        ("terminal", curl("x", " | tee f")), ("terminal", {"command": "curl https://e.com/page"}), ("browser_get_state", {}),
    ]
    got = [r["exact"] for r in normalize_exact(calls(spark, *rows)).orderBy("query_id").collect()]
    assert [g is not None for g in got] == [True, False, True, False, False, False, True, True, True, False, False]
    assert got[0]["replayable"] and got[0]["ttl_seconds"] == 600 and got[6]["exact_key"] != got[7]["exact_key"]
    assert got[8]["replay_policy"] == "match_only" and json.loads(got[7]["canonical_json"])["url"] == "https://e.com/search?q=1"
    assert json.dumps(json.loads(got[7]["canonical_json"]), sort_keys=True, separators=(",", ":")) == got[7]["canonical_json"]
    assert normalize_exact(calls(spark, rows[0]), " ").first()["exact"] is None


def test_semantic_calls(spark):
    rows = [
        ("terminal", {"command": "curl https://docs.example.com/guide | head -20"}), ("browser_navigate", {"url": "https://docs.example.com/guide"}), ("web_search", {"query": "中文  Embedding 模型", "domains": ["b", "a"]}),
        ("browser_navigate", {"url": "https://me:pw@e.com/"}), ("terminal", {"command": "curl -d a=b https://e.com"}), ("terminal", curl("token=abc")), ("terminal", {"command": "git clone https://e.com/a"}),
    ]
    got = [r["semantic"] for r in normalize_semantic(calls(spark, *rows)).orderBy("query_id").collect()]
    assert [g and g["operation_kind"] for g in got] == ["web_fetch_curl", "browser_page", "web_search", None, None, "web_search_curl", "web_fetch_curl"]
    assert got[0]["semantic_text"] == "web fetch http get docs.example.com guide head -20" and got[1]["semantic_text"] == "browser navigate web page docs.example.com guide"
    assert got[2]["semantic_text"] == "web search query 中文 embedding 模型" and got[2]["metadata"]["domains"] == ["a", "b"]
    assert got[0]["metadata"]["method"] == "GET" and got[0]["metadata"]["host"] == "docs.example.com"


class Reverse:
    model_id = "reverse"

    def score(self, query, documents):
        return [0.7 + 0.01 * k for k in range(len(documents))]


def page(url, body):
    return f"<url>{url}</url>\n<webpage_content>\n{body}\n</webpage_content>"


def test_semantic_pipeline(spark, tmp_path):
    url = "https://docs.example.com/guide"
    records = [
        record("q1", "terminal", curl("vector+search")), record("q2", "terminal", curl("cooking+rice"), ended="2026-07-08T08:00:02Z"), record("n", "browser_navigate", {"url": SEARCH + "vector"}),
        record("p", "browser_get_content", {"start_from_char": 0}, page(url, "y" * 12_500 + " Cookie: abc")), record("empty", "browser_get_content", {}, page(url, "")),
        record("s", "browser_get_content", {}, page("https://e.com/?token=a", "text")), record("st", "browser_get_state", {}, json.dumps({"url": url + "/state", "title": "t"})),
        record("r", "terminal", curl("x"), source="hook_replacement"),
    ]
    path, db, embedder = log(tmp_path, *records), str(tmp_path / "db"), hashing(64)
    r = api.ingest_semantic_records(spark, path, db, embedder, "s")
    assert (r["seen"], r["imported"], r["unsupported"]) == (8, 5, 3) and r["unsupported_tool_counts"] == {"browser_get_content": 2, "invalid_record": 1}
    assert r["database"]["total"] == 5 and api.ingest_semantic_records(spark, path, db, embedder, "s")["database"]["total"] == 5
    entries = semantic_table(spark, db).read()
    body = entries.where("record_key = 'p'").first()
    assert body["metadata"]["content_chars"] == 12_512 and body["metadata"]["indexed_content_chars"] == 12_000 and "abc" not in body["response_text"]
    ask = lambda tool, call, **o: api.match_semantic(spark, db, tool, call, o.pop("embedder", embedder), o.pop("scope", "s"), T0 + 60, **o)
    found = ask("terminal", curl("vector+search"))
    assert found["matched"] and not found["reusable"] and found["candidate_count"] == 2 and found["candidates"][0]["record_key"] == "q1" and found["candidates"][0]["final_score"] == 1.0
    seen = ask("browser_navigate", {"url": url})
    assert seen["candidates"][0]["record_key"] == "p" and seen["candidates"][0]["metadata_boost"] >= 0.7
    assert ask("terminal", curl("vector"), scope="other")["candidate_count"] == 0 and ask("terminal", curl("vector"), embedder=hashing(32))["candidate_count"] == 0
    assert ask("terminal", curl("vector"), candidate_k=1)["candidate_count"] == 1
    again = ask("terminal", curl("vector+search"), reranker=Reverse(), min_score=0.1)
    assert [c["record_key"] for c in again["candidates"]] == ["q2", "q1"] and again["candidates"][0]["rerank_score"] == 0.71
    assert ask("web_search", {"query": " "})["supported"] is False
    for bad in ({"dense_weight": 0, "lexical_weight": 0}, {"top_k": 0}, {"scope": " "}):
        with pytest.raises(ValueError):
            ask("terminal", curl("x"), **bad)


def test_policies(spark):
    cases = [("https://e.com/latest", "volatile"), ("https://e.com/search/x", "search"), ("https://e.com/a?q=1", "search"), ("https://github.com/a/b/commit/abcdef1", "immutable"),
             ("https://arxiv.org/abs/2401.12345", "immutable"), ("https://e.com/docs/a", "static"), ("https://e.com/a.yml", "static"), ("https://e.com/a", "web"), ("https://e.com/newspaper", "web")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert all(r[0] == r[1] for r in df.select(policy.freshness_for_url(F.col("u"))["freshness_class"], "want").collect())
    legacy = spark.createDataFrame([("web search: weather", "web_search", "volatile"), ("google x", "curl", "search"), ("x /raw/ y", "curl", "static_web"), ("x", "curl", "web"), ("x", "generic", "generic")], "t string, k string, w string")
    assert all(r[0] == r[1] for r in legacy.select(policy.freshness_for_text(F.col("t"), F.col("k"))["freshness_class"], "w").collect())
    times = [("2026-07-08T08:00:01Z", T0), ("20260708T080001Z", T0), ("2026-07-08T10:00:01+02:00", T0), ("2026-07-08 08:00:01", T0), ("x", None), ("", None), (None, None), ("2026-07-08", T0 - 28801)]
    got = spark.createDataFrame(times, "t string, w long").select(policy.iso_epoch(F.col("t")), "w").collect()
    assert all(r[0] == r[1] for r in got)
    status = [("TerminalObservation", "false", None, "0", "terminal", "success"), ("TerminalObservation", "false", None, '"0"', "terminal", "tool_response.exit_code is not an integer"),
              ("TerminalObservation", "false", "true", None, "terminal", "tool_response.timeout=true"), ("BrowserObservation", "false", None, None, "terminal", "observation kind 'BrowserObservation' does not match tool 'terminal'"),
              (None, "false", None, None, "x", "missing or unrecognized observation kind"), ("ToolObservation", "0", None, None, "x", "tool_response.is_error is not explicitly false"),
              ("ToolObservation", "false", None, "7", "x", "exit_code=7"), ("ToolObservation", "false", "false", "null", "web_search", "success")]
    df = spark.createDataFrame(status, "k string, e string, t string, c string, tool string, w string")
    assert all(r[0] == r[1] for r in df.select(policy.response_status(*map(F.col, ("k", "e", "t", "c", "tool")))["reason"], "w").collect())


def test_text_functions(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x")).alias("c")).first()["c"]
    assert one(text.tokens, "Ab_1 x.y 中文字") == ["ab_1", "x", ".", "y", "中文字", "中", "文", "字", "中文", "文字"]
    assert one(text.clean, "  A　b\n c ") == "a b c" and one(text.query_text, "HTTPS://E.com/a?b=c d") == "e.com/a b c d"
    assert one(text.redact, "password: hunter2, bearer abc.def eyJa.b.c ghp_12345678 ok") == "password: <redacted>, <redacted> <redacted> <redacted> ok"
    assert one(text.has_secret, "https://u:p@e.com") and one(text.has_secret, "https://e.com/?Api-Key=1") and not one(text.has_secret, "https://e.com/?token=") and not one(text.has_secret, "tokens")
    assert one(lambda c: text.first_block(c, "url"), "a <URL> x\ny </url> <url>z</url>") == "x\ny" and one(lambda c: text.first_block(c, "url"), "none") is None


def test_scores(spark):
    docs = [(0, "a", "semantic embedding search"), (0, "b", "cooking rice at home"), (1, "a", "zzz"), (1, "b", "yyy")]
    df = spark.createDataFrame([(*d, "semantic embedding search") for d in docs], "query_id long, record_key string, t string, q string")
    got = {(r["query_id"], r["record_key"]): r["lexical_score"] for r in ranking.bm25(df, "q", "t", ["query_id"], ["record_key"]).collect()}
    assert got == {(0, "a"): 1.0, (0, "b"): 0.0, (1, "a"): 0.0, (1, "b"): 0.0}
    bounded = {(r["query_id"], r["record_key"]): r["lexical_score"] for r in ranking.bm25_of_bounded(df, "q", "t", ["query_id"]).collect()}
    assert bounded == got
    rows = [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, w double")
    assert all(math.isclose(r[0], r[1]) for r in df.select(vectors.cosine(F.col("a"), F.col("b")), "w").collect())
    assert squash(0.3) == 0.3 and squash([2.0, 1.0]).round(4).tolist() == [0.8808, 1.0]
    e = hashing(64)
    assert e.embed_query("a b") == e.embed_documents(["a b"])[0] and math.isclose(sum(x * x for x in e.embed_query("a b c")), 1)
    ids = {create_embedder("openai-compatible", model="m", base_url=u, dimensions=d, query_prefix=p).index_id for u in ("http://a", "http://b") for d in (None, 8) for p in ("", "q")}
    assert len(ids) == 8 and len(create_embedder("hashing").embed_query("a")) == 384
    with pytest.raises(ValueError):
        create_embedder("nothing")
    with pytest.raises(RuntimeError):
        create_embedder("sentence-transformers")


def test_hashed_features(spark):
    """The batch function against one text, feature by feature."""
    texts = ["", "Ab_1 x.y", "中文字 a", "a a a"]
    for text_, found in zip(texts, hashing(16).embed_documents(texts), strict=True):
        want = [0.0] * 16
        for f in features(text_):
            n = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            want[n % 16] += -1.0 if n >> 63 else 1.0
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert all(math.isclose(x / size, y, abs_tol=1e-12) for x, y in zip(want, found, strict=True))
    assert features("Ab 中文") == ["ab", "中文", "中", "文", "中文", "ab::中文", "中文::中", "中::文", "文::中文"]


def test_embedding_service(spark):
    seen = []

    class Fake(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            rows = [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in enumerate(body["input"])][::-1]
            if "short" in body["input"]:
                rows = rows[1:]
            self.send_response(500 if "fail" in body["input"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": rows}).encode())

        def log_message(self, *_):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Fake) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        e = create_embedder("openai-compatible", model="m", base_url=f"http://127.0.0.1:{server.server_port}/v1/", api_key="k", dimensions=2, document_prefix="d ")
        assert e.embed_documents(["a", ""]) == [[1.0, 0.0], [1.0, 0.0]] and seen[-1] == ("/v1/embeddings", "Bearer k", {"model": "m", "input": ["d a", "d "], "dimensions": 2})
        texts = spark.createDataFrame([(f"t{k}",) for k in range(5)], "t string").coalesce(1)
        assert embedded(texts, "t", e, batch_size=2).count() == 5 and [len(b["input"]) for _, _, b in seen[-3:]] == [2, 2, 1]
        plain = create_embedder("openai-compatible", model="m", base_url=f"http://127.0.0.1:{server.server_port}")
        assert plain.embed_query("abc") == [1.0, 0.0] and "dimensions" not in seen[-1][2]
        with pytest.raises(Exception, match="500"):
            plain.embed_query("fail")
        with pytest.raises(Exception, match="wrong batch size"):
            embedded(spark.createDataFrame([("short",)], "t string"), "t", plain).collect()
        server.shutdown()


def test_each_text_is_embedded_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    def counting(texts):
        (notes / uuid.uuid4().hex).write_text(json.dumps(texts))
        return np.array([[len(t), t.count("a") + 1.0] for t in texts], float).reshape(len(texts), 2)

    def sent():
        out = [t for f in notes.iterdir() for t in json.loads(f.read_text())]
        for f in notes.iterdir():
            f.unlink()
        return sorted(out)

    e = TextEmbedder("counting", "counting-1", counting)
    path, db = log(tmp_path, *(record(f"k{k}", "terminal", curl(f"word{k}+x")) for k in range(6))), str(tmp_path / "db")
    api.ingest_semantic_records(spark, path, db, e, "s")
    assert len(sent()) == 6
    for reranker in (None, Reverse()):
        found = api.match_semantic(spark, db, "terminal", curl("word1+x"), e, "s", T0 + 60, reranker=reranker, min_score=0.1)
        assert found["candidate_count"] == 6 and len(sent()) == 1


def test_layout_and_modes(spark, tmp_path):
    path, db = log(tmp_path, record("a", "web_search", {"query": "x"})), str(tmp_path / "db")
    api.ingest_exact_records(spark, path, db)
    assert {oct(os.stat(f).st_mode & 0o777) for f in pathlib.Path(db).rglob("*.parquet")} == {"0o600"} and os.stat(db).st_mode & 0o777 == 0o700
    at = exact_table(spark, db)
    old = exact_table(spark, db)
    old.layout = "exact-v4"
    old.replace(at.read())
    with pytest.raises(StaleTable, match="rebuild"):
        at.read()
    assert api.ingest_exact_records(spark, path, db)["database"]["total"] == 1  # a writer makes it anew


def test_deltas(spark, tmp_path):
    at = exact_table(spark, str(tmp_path / "t"))
    rows = lambda key, text_: spark.createDataFrame([(0, key, "old"), (1, key, text_)], "seq int, record_key string, response_text string").select("seq", *(F.col(c) if c in ("record_key", "response_text") else F.lit(None).cast(t).alias(c) for c, t in spark.createDataFrame([], at.schema).dtypes))
    for k in range(MOST_DELTAS + 3):
        at.append(rows(f"k{k % 2}", f"t{k}"))
        want = {f"k{j % 2}": f"t{j}" for j in range(k + 1)}
        assert {r["record_key"]: r["response_text"] for r in at.read().collect()} == want
    assert len(at._current()["deltas"]) <= 2


def test_keys_before_windows(spark, exact_db):
    queries = spark.createDataFrame([(1, "x", True)], "query_id long, exact_key string, replayable boolean")
    plan = match.match_keys(queries, exact_table(spark, str(exact_db[0] / "db")).read(), T0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Window")  # below it


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    path, db, sdb = log(tmp_path, record("a", "web_search", {"query": "x"})), str(tmp_path / "db"), str(tmp_path / "sdb")

    def run(*argv):
        assert cli.main(list(argv)) == 0
        return json.loads(capsys.readouterr().out)

    assert run("exact-ingest", "--db", db, "--records", path, "--scope", "s")["imported"] == 1
    assert run("exact-stats", "--db", db)["total"] == 1
    assert run("exact-match", "--db", db, "--tool", "web_search", "--input-json", '{"query": "x"}', "--scope", "s", "--full-response")["matched"]
    model = ("--provider", "hashing", "--dimensions", "16")
    assert run("semantic-ingest", "--db", sdb, "--records", path, "--scope", "s", *model)["imported"] == 1
    assert run("semantic-match", "--db", sdb, "--tool", "web_search", "--input-json", '{"query": "x"}', "--scope", "s", "--include-stale", *model)["candidates"][0]["record_key"] == "a"
    assert run("semantic-stats", "--db", sdb, "--scope", "s")["total"] == 1
    with pytest.raises(SystemExit):
        cli.main(["exact-match", "--db", db, "--tool", "x", "--input-json", "[1]", "--scope", "s"])


def test_legacy_calls(spark):
    rows = [("terminal", {"command": "curl 'https://e.com/a?b=c'"}), ("terminal", {"command": "curl --url foo"}), ("Search", {"query": [{"text": "now x"}]}), ("x", {"b": 1, "a": [2]})]
    got = [r["normalized"] for r in normalize_calls(calls(spark, *rows)).orderBy("query_id").collect()]
    assert got[1] is None and [g["kind"] for g in got if g] == ["curl", "web_search", "generic"]
    assert (got[0]["intent_text"], got[0]["freshness_class"], got[0]["ttl_seconds"]) == ("curl get e.com /a b c", "web", 3600)
    assert (got[2]["intent_text"], got[2]["freshness_class"]) == ("web search: now x", "volatile") and got[3]["intent_text"] == 'x: {"a":[2],"b":1}'
    assert json.loads(got[0]["fingerprint"])["query_pairs"] == [{"name": "b", "value": "c"}]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.5), (2, "c", 1, 0.8), (2, "d", 2, 0.7)], "query_id long, record_key string, rank int, score double")
    relevant = spark.createDataFrame([(1, "a"), (1, "z"), (2, "d"), (3, "q")], "query_id long, record_key string")
    s = evaluate.summary(evaluate.ranking_quality(ranked, relevant, 2)).first()
    assert s["queries"] == 3 and math.isclose(s["recall_at_k"], 0.5) and math.isclose(s["mrr"], 0.5) and math.isclose(s["precision_at_k"], 1 / 3)
    sweep = {r["threshold"]: (r["returned"], r["hits"]) for r in evaluate.threshold_sweep(ranked, relevant, [0.5, 0.75]).collect()}
    assert sweep == {0.5: (4, 2), 0.75: (2, 1)}
    decided = spark.createDataFrame([(1, True, "a"), (2, True, "x"), (3, False, None)], "query_id long, reusable boolean, record_key string")
    r = evaluate.false_reuse(decided, relevant).first()
    assert r["false_reuse_rate"] == 0.5 and math.isclose(r["coverage"], 2 / 3)


def test_hook(spark, exact_db):
    env = {"RECALL_DB": str(exact_db[0] / "db"), "RECALL_SCOPE": "s"}
    fresh = lambda *a, **o: api.match_exact(spark, *a, now_epoch=T0 + 5, **o)
    out, code = hook.decide(json.dumps({"tool_name": "terminal", "tool_input": curl("one")}), env, fresh)
    assert code == 2 and out["decision"] == "deny" and out["toolResponseMetadata"]["cacheRecordKey"] == "b" and "cached_tool_response" in json.loads(out["additionalContext"])
    for event, e in (("{", env), ("[]", env), ("{}", env), (json.dumps({"tool_name": "terminal", "tool_input": curl("none")}), env), ("{}", {})):
        assert hook.decide(event, e, fresh) == (hook.ALLOW, 0)


def test_hook_of_a_session_that_stays(spark, exact_db, tmp_path):
    stop, path = threading.Event(), str(tmp_path / "s")
    fresh = lambda *a, **o: api.match_exact(spark, *a, now_epoch=T0 + 5, **o)
    server = threading.Thread(target=hook.serve, args=(path, fresh, stop.is_set))
    server.start()
    env = {"RECALL_DB": str(exact_db[0] / "db"), "RECALL_SCOPE": "s", "RECALL_SOCKET": path}
    try:
        for _ in range(100):
            if os.path.exists(path):
                break
            time.sleep(0.05)
        hook.ANSWER_SECONDS = 60.0
        out, code = hook.decide(json.dumps({"tool_name": "terminal", "tool_input": curl("one")}), env)
        assert code == 2 and out["toolResponseMetadata"]["cacheRecordKey"] == "b"
        assert hook.decide(json.dumps({"tool_name": "terminal", "tool_input": curl("none")}), env) == (hook.ALLOW, 0)
        assert hook.decide(json.dumps({"tool_name": "terminal", "tool_input": curl("one")}), env | {"RECALL_DB": "/none"}) == (hook.ALLOW, 0)
    finally:
        stop.set()
        server.join()
    assert hook.decide(json.dumps({"tool_name": "terminal", "tool_input": curl("one")}), env) == (hook.ALLOW, 0)  # nobody answers


def test_streams(spark, tmp_path):
    src, db = tmp_path / "in", str(tmp_path / "db")
    src.mkdir()
    (src / "1.jsonl").write_text(json.dumps(record("a", "web_search", {"query": "x"})) + "\n" + json.dumps(record("b", "web_search", {"query": "y"}, source="hook_replacement")) + "\n")
    reports = []
    run = lambda: imports.import_exact(imports.lines(spark, str(src)), db, str(tmp_path / "ck"), "s", report=lambda _, r: reports.append(r)).trigger(availableNow=True).start().awaitTermination(120)
    run()
    (src / "2.jsonl").write_text(json.dumps(record("a", "web_search", {"query": "z"})) + "\nnot json\n")
    run()
    rows = exact_table(spark, db).read().collect()
    assert [json.loads(r["tool_input"])["query"] for r in rows] == ["z"]
    assert [(r["seen"], r["imported"], r["broken_lines"]) for r in reports] == [(2, 1, 0), (1, 1, 1)]
    events = tmp_path / "events"
    events.mkdir()
    (events / "e.json").write_text("\n".join(json.dumps({"query_id": k, "tool_name": "web_search", "tool_input": json.dumps({"query": q}), "now": n}) for k, q, n in ((1, "z", T0 + 1), (2, "z", T0 + 9999), (3, "w", T0))))
    stream = spark.readStream.schema("query_id long, tool_name string, tool_input string, now long").json(str(events))
    name = f"d{int(time.time())}"
    imports.decisions(stream, exact_table(spark, db).read(), "s").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["query_id"], r["reusable"], r["record_key"]) for r in spark.table(name).collect()} == {(1, True, "a"), (2, False, None), (3, False, None)}
    imports.distinct_records(imports.lines(spark, str(src))).writeStream.format("memory").queryName(name + "r").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table(name + "r").count() == 2
