"""Work of Python is dealt by the row, and bounded however large batches are."""

import json
import random
import shlex
import time

import pyarrow as pa
import pytest

from recallspark.functions import batches, documents, shell
from recallspark.plans.queries import QUERIES

DEALT = ["redact_calls", "exact_key_curl", "semantic_text_curl", "curl_fingerprint", "legacy_calls", "import_entries", "exact_reason", "facts_of_calls", "semantic_text_search", "import_report", "reuse_coverage"]


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt(spark, sf, name):
    """Calls and lines of a table with one row group do not stay in one task."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "ArrowEvalPython" in plan
    assert "RoundRobinPartitioning" in plan


def test_slices():
    """Rows become objects of Python a few at a time, and fewer where they are large."""
    alive, most = [0], [0]

    def row(x):
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return x and x[:3]

    def sizes(column):
        for out in batches.in_slices(iter([(column,)]), row, pa.string()):
            alive[0] = 0
            yield len(out)

    assert list(sizes(pa.array(["abcd"] * 1100))) == [512, 512, 76] and most[0] == 512
    most[0] = 0
    assert sum(sizes(pa.array(["x" * 40_000] * 300))) == 300 and most[0] <= 53
    assert [x.to_pylist() for x in batches.in_slices(iter([(pa.array(["abcd", None]),)]), lambda x: x and x[:3], pa.string())] == [["abc", None]]
    assert not list(sizes(pa.array([], pa.string())))


def test_words():
    """Words are those of shlex, also where quotes are not ended, in time that does not grow faster than the command."""
    made = random.Random(5)
    signs = ["a", "b", " ", "'", '"', "\\", "\n", "\t", "$", "é", "|", "x y", "''", '""', '\\"', "\\\\", "\x0b", " ", "#", "&&"]
    for _ in range(5000):
        command = "".join(made.choices(signs, k=made.randint(0, 14)))
        try:
            want = shlex.split(command)
        except ValueError:
            want = None
        assert shell.words(command) == want, command
    began = time.time()
    assert shell.words('"' + "a" * 20_000) is shell.words('"' + "ab\\\\" * 20_000) is shell.words("x '" + "a " * 20_000) is None
    assert time.time() - began < 2


def test_secrets_need_a_cue():
    for text, found in (("PASSWORD: x", True), ("passport: x", False), ("toKen=x", True), ("Basic a", True), ("sk_abcdefghi", True), ("eyJa.b.c", True), ("nothing", False)):
        assert documents.has_secret(text) is found, text
        assert (documents.redact_text(text) != text) is found


def test_page_of_an_observation():
    """A page is read without the rest of the observation."""
    answer = json.dumps({"content": [{"type": "text", "text": "<url>https://e.com/a?q=1</url><webpage_content> hello </webpage_content>"}]})
    page, whole = (documents.facts_of("browser_get_content", "{}", answer, "local", parts) for parts in (("key", "page"), ("key", "response")))
    assert page["body"] == whole["body"] == "hello" and page["page"] == whole["page"] and page["seen"] == whole["seen"]
    assert page["safe_response"] is None and whole["safe_response"]
