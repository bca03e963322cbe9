"""Each query over a whole small table against a plain version of its contract."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from recallspark.llm import language_id
from recallspark.llm.common import Scratch
from recallspark.llm.queries import QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"]) for r in t]


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def by_id(found, key="doc_id"):
    out = {r[key]: r for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, sf, documents):
    found = by_id(rows(spark, sf, "op1_secrets"))
    for i, text, _ in documents:
        r = found[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == brute.secrets(text)
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert brute.sha(base) == r["base_sha256"]


def test_op2(spark, sf, documents):
    want = brute.substring_dedup([(i, t) for i, t, _ in documents])
    found = by_id(rows(spark, sf, "op2_substring_dedup"))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found.items()} == {i: x[:3] for i, x in want.items()}
    assert any(r["n_removed"] for r in found.values())


def test_op3(spark, sf, documents):
    found = by_id(rows(spark, sf, "op3_language_id"))
    for i, _, _ in documents:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(lang, found[i]["lang_pred"]) for i, _, lang in documents if found[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    # a plain predictor that learned from the same sample
    rows_ = spark.read.parquet(f"{sf}/documents.parquet").where(language_id.in_training())
    sample = language_id.sampled(rows_, "doc_id", "text", "lang", language_id.PER_LANGUAGE, language_id.SAMPLE_CHARS, Scratch(spark, "test")).collect()
    plain = brute.Languages([(r["lang"], r["text"]) for r in sample])
    for i, text, _ in documents:
        lang, score = plain.predict(text)
        assert found[i]["lang_pred"] == lang and abs(found[i]["score"] - score) < 1e-9


def test_op4(spark, sf, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: encoder.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in documents}
    found = rows(spark, sf, "op4_packing")
    parts, sequences = {}, {}
    for r in found:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == brute.ids_crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(parts) == set(ids)
    for each in [*parts.values(), *sequences.values()]:
        each.sort()
        assert each[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(each, each[1:]))
    assert all(sum(parts[i][-1]) == len(ids[i]) for i in ids)
    total = [sum(x[-1]) for x in sequences.values()]
    assert all(n <= 4096 and n & n - 1 == 0 for n in total)  # none is padded


def test_op5(spark, sf, documents):
    import public_tokenizers
    import sentencepiece

    bpe = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(rows(spark, sf, "op5_sentencepiece"))
    for i, text, _ in documents:
        ids = bpe.encode(text or "")
        assert (found[i]["n_merged"], found[i]["merged_crc32"]) == (len(ids), brute.ids_crc32(ids))
        assert found[i]["decodes"]
    # best paths, word by word
    path, known = brute.best_path(bpe), {}
    for i, text, _ in documents:
        words = re.findall(r"▁+[^▁\n]*|\n+|[^▁\n]+", (" " + text).replace(" ", "▁")) if text else []
        for w in words:
            if w not in known:
                known[w] = path(w)
        ids = [x for w in words for x in known[w]]
        assert (found[i]["n_pieces"], found[i]["ids_crc32"]) == (len(ids), brute.ids_crc32(ids)), i


def test_op6(spark, sf, documents):
    import public_tokenizers
    import sentencepiece

    bpe = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(rows(spark, sf, "op6_token_counts"))
    for i, text, _ in documents:
        n = len(bpe.encode(text or ""))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), n, n > 4096)


def test_op7(spark, sf, documents):
    found = by_id(rows(spark, sf, "op7_simhash"))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == brute.simhash_components([(i, t) for i, t, _ in documents])


def test_op8(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    found = by_id(rows(spark, sf, "op8_vector_dedup"), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == brute.vector_links([(r["vec_id"], r["embedding"]) for r in t])


def test_op9(spark, sf, documents):
    found = by_id(rows(spark, sf, "op9_pii"))
    for i, text, _ in documents:
        r = found[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == brute.personal(text)


def test_op10(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    found = rows(spark, sf, "op10_topk_search")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(brute.top_scores([(r["vec_id"], r["embedding"]) for r in t]))
