"""The hook before a call: an event on standard input, a decision on standard output. Whatever fails, the call is allowed.

A session takes longer to start than a hook may take, so one stays: `hook serve` keeps it and answers on a socket of the
file system (RECALL_SOCKET), and each hook is a client of it that allows the call when no answer comes in time. Without
that variable the hook starts a session of its own.
"""

from __future__ import annotations

import json
import os
import socket
import sys
from collections.abc import Callable, Mapping

ALLOW = {"decision": "allow"}
#: Less than the time that callers give a hook.
ANSWER_SECONDS = 4.0


def decision_of(result: Mapping) -> tuple[dict, int]:
    """(decision, exit code) for the result of an exact match: a reusable response stops the call."""
    if result.get("reusable") is not True:
        return ALLOW, 0
    record, response = result.get("selected") or {}, result.get("tool_response")
    hit = {"hit_type": "exact-v5", "exact_key": result.get("exact_key"), **{k: record.get(k) for k in ("record_key", "ended_at", "freshness_class", "ttl_seconds")}}
    hit["note"] = "The tool call was not executed because exact-v5 found a fresh, successful, replayable response."
    context = json.dumps({"cache_hit": hit, "cached_tool_response": response}, ensure_ascii=False)
    about = {"cacheHitType": "exact", "cacheRecordKey": record.get("record_key"), "cacheObservedAt": record.get("ended_at")}
    return {"decision": "deny", "reason": "tool reuse cache exact hit", "additionalContext": context, "toolResponse": response, "toolResponseMetadata": about}, 2


def decide(text: str, environment: Mapping[str, str], match: Callable[..., dict] | None = None) -> tuple[dict, int]:
    path, scope = environment.get("RECALL_DB"), environment.get("RECALL_SCOPE")
    if not path or not scope:
        return ALLOW, 0
    try:
        event = json.loads(text)
        tool, call = event.get("tool_name"), event.get("tool_input")
        if not isinstance(tool, str) or not isinstance(call, dict):
            return ALLOW, 0
        if match is None and environment.get("RECALL_SOCKET"):
            return decision_of(asked(environment["RECALL_SOCKET"], {"db": path, "scope": scope, "tool_name": tool, "tool_input": call}))
        return decision_of((match or matcher())(path, tool, call, include_response=True, cache_scope=scope))
    except Exception as e:  # the call must go on
        print(f"hook failed open: {e}", file=sys.stderr)
        return ALLOW, 0


def matcher() -> Callable[..., dict]:
    """The exact match of a session that is started here."""
    from recallspark.plans import api, cli

    spark = cli.session()
    return lambda *args, **named: api.match_exact(spark, *args, **named)


def asked(path: str, question: dict) -> dict:
    """What the session behind a socket answers, a line for a line."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.settimeout(ANSWER_SECONDS)
        s.connect(path)
        s.sendall(json.dumps(question).encode() + b"\n")
        return json.loads(s.makefile("rb").readline())


def serve(path: str, match: Callable[..., dict], stop: Callable[[], bool] = lambda: False) -> None:
    """Answers questions on a socket until told to stop; one that fails gets an answer that reuses nothing."""
    if os.path.exists(path):
        os.unlink(path)
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.bind(path)
        os.chmod(path, 0o600)
        s.listen()
        s.settimeout(0.2)
        while not stop():
            try:
                client, _ = s.accept()
            except TimeoutError:
                continue
            with client:
                try:
                    client.settimeout(ANSWER_SECONDS)
                    q = json.loads(client.makefile("rb").readline())
                    answer = match(q["db"], q["tool_name"], q["tool_input"], include_response=True, cache_scope=q["scope"])
                except Exception as e:
                    answer = {"reusable": False, "reason": str(e)}
                try:
                    client.sendall(json.dumps(answer, ensure_ascii=False).encode() + b"\n")
                except OSError:  # the client has gone
                    pass


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["serve"]:
        serve(os.environ["RECALL_SOCKET"], matcher())
        return 0
    decision, code = decide(sys.stdin.read(), os.environ)
    print(json.dumps(decision, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
