"""The command line: import, match and statistics of both indexes; results are JSON documents."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from recallspark.plans import api
from recallspark.sources.embedders import DEFAULT_MODEL, LOCAL, PROVIDERS, create_embedder, cross_encoder


def session() -> SparkSession:
    spark = SparkSession.builder.appName("recallspark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="recallspark")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *required: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=help_)
        for r in ("--db", *required):
            one.add_argument(r, required=True)
        return one

    def embedding(one: argparse.ArgumentParser) -> None:
        one.add_argument("--provider", choices=tuple(PROVIDERS), default=LOCAL)
        one.add_argument("--model", default=DEFAULT_MODEL)
        one.add_argument("--api-key-env", default="EMBEDDING_API_KEY")
        one.add_argument("--dimensions", type=int)
        for name, default in (("--base-url", None), ("--query-prefix", ""), ("--document-prefix", ""), ("--device", None)):
            one.add_argument(name, default=default)

    one = command("exact-ingest", "import records into the exact index", "--records", "--scope")
    one.add_argument("--trust-legacy-origins", action="store_true")
    one = command("exact-match", "match a call exactly", "--tool", "--input-json", "--scope")
    one.add_argument("--limit", type=int, default=20)
    one.add_argument("--full-response", action="store_true")
    command("exact-stats", "statistics of the exact index")
    one = command("semantic-ingest", "embed and import records", "--records", "--scope")
    one.add_argument("--trust-legacy-origins", action="store_true")
    one.add_argument("--batch-size", type=int, default=32)
    embedding(one)
    one = command("semantic-match", "retrieve candidates", "--tool", "--input-json", "--scope")
    for name, kind, default in (("top-k", int, 5), ("candidate-k", int, 50), ("min-score", float, 0.65), ("dense-weight", float, 0.8), ("lexical-weight", float, 0.2), ("rerank-top-n", int, 10)):
        one.add_argument(f"--{name}", type=kind, default=default)
    for name in ("--include-stale", "--full-response"):
        one.add_argument(name, action="store_true")
    one.add_argument("--reranker-model")
    embedding(one)
    command("semantic-stats", "statistics of the semantic index", "--scope")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    call = json.loads(a.input_json) if hasattr(a, "input_json") else None
    if call is not None and not isinstance(call, dict):
        raise SystemExit("--input-json must decode to an object")
    options = ("model", "base_url", "dimensions", "query_prefix", "document_prefix", "device")
    embedder = create_embedder(a.provider, a.api_key_env, **{k: getattr(a, k) for k in options}) if hasattr(a, "provider") else None
    spark = session()
    if a.command == "exact-ingest":
        out = api.ingest_exact_records(spark, a.records, a.db, a.scope, a.trust_legacy_origins)
    elif a.command == "exact-match":
        out = api.match_exact(spark, a.db, a.tool, call, include_response=a.full_response, limit=a.limit, cache_scope=a.scope)
    elif a.command == "exact-stats":
        out = api.exact_stats(spark, a.db)
    elif a.command == "semantic-ingest":
        out = api.ingest_semantic_records(spark, a.records, a.db, embedder, a.scope, a.trust_legacy_origins, a.batch_size)
    elif a.command == "semantic-match":
        reranker = cross_encoder(a.reranker_model, a.device) if a.reranker_model else None
        options = {"top_k": a.top_k, "candidate_k": a.candidate_k, "min_score": a.min_score, "dense_weight": a.dense_weight, "lexical_weight": a.lexical_weight, "rerank_top_n": a.rerank_top_n}
        out = api.match_semantic(spark, a.db, a.tool, call, embedder, a.scope, reranker=reranker, include_response=a.full_response, fresh_only=not a.include_stale, **options)
    else:
        out = api.semantic_stats(spark, a.db, a.scope)
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
