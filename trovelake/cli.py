"""Command line: prepare, build-index, ask, evaluate-retrieval, compare-chunking, ...

Runs on the session of spark-submit when there is one, else on a local session.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from trovelake import fixed_values as fv
from trovelake.operators.embedding import create_embedder
from trovelake.operators.generators import create_generator
from trovelake.plans.evaluate import (
    compare_chunking,
    evaluate_answers,
    evaluate_retrieval,
    measure_latency,
)
from trovelake.plans.index import build_index, embed_chunks, open_index
from trovelake.plans.answers import AnswerPipeline
from trovelake.runtime import local_session, ship_package
from trovelake.operators.chunking import chunk_documents
from trovelake.sources.documents import load_documents, load_questions, write_clean_documents
from trovelake.sources.vector_store import VectorCollection

DATA = Path(__file__).resolve().parents[1] / "data"
ARTIFACTS = Path("artifacts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trovelake", description=__doc__)
    p.add_argument("--documents", default=str(DATA / "documents.json"))
    p.add_argument("--questions", default=str(DATA / "questions.json"))
    p.add_argument("--lines", action="store_true", help="inputs are JSON Lines, not one array")
    p.add_argument("--index-path", default=str(ARTIFACTS / "index"))
    commands = p.add_subparsers(dest="command", required=True)

    prepare = commands.add_parser("prepare", help="store the documents in cleaned form")
    prepare.add_argument("--output", default=str(ARTIFACTS / "clean_documents"))

    build = commands.add_parser("build-index", help="embed and store the chunks")
    build.add_argument("--strategy", choices=fv.CHUNK_STRATEGIES, default="recursive")
    build.add_argument("--store", choices=["table", "collection"], default="table")
    build.add_argument("--embedding-backend", choices=["hash", "sentence-transformers"], default="hash")
    build.add_argument("--collection-path", default=str(ARTIFACTS / "collections"))

    ask = commands.add_parser("ask", help="answer one question")
    ask.add_argument("question")
    ask.add_argument("--product-type", choices=fv.PRODUCT_TYPES)
    ask.add_argument("--mode", choices=fv.SEARCH_MODES, default="hybrid")
    ask.add_argument("--build", action="store_true", help="build the index first; else a stored one is opened")

    evaluate = commands.add_parser("evaluate-retrieval", help="hit rate and mean reciprocal rank")
    evaluate.add_argument("--strategy", choices=fv.CHUNK_STRATEGIES, default="recursive")
    evaluate.add_argument("--k", type=int, default=fv.TOP_K)

    commands.add_parser("compare-chunking", help="metrics of every chunking strategy")
    commands.add_parser("evaluate-rag", help="answer quality")
    commands.add_parser("performance", help="latency with and without the answer cache")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Run one command and return what it prints."""

    def documents():
        return load_documents(spark, args.documents, lines=args.lines)

    def index(strategy: str = "recursive", backend: str = "hash", path: str = args.index_path):
        return build_index(spark, documents(), path, strategy, create_embedder(backend))

    def asked():
        return load_questions(spark, args.questions, lines=args.lines)

    if args.command == "prepare":
        return {"output": write_clean_documents(documents(), args.output)}

    if args.command == "build-index":
        if args.store == "collection":
            chunks = chunk_documents(documents(), args.strategy)
            collection = VectorCollection(spark, args.collection_path)
            collection.upsert(embed_chunks(chunks, create_embedder(args.embedding_backend)))
            return {"store": "collection", "path": collection.path}
        built = index(args.strategy, args.embedding_backend)
        return {"store": "table", "path": built.path, "chunks": built.n}

    if args.command == "ask":
        try:
            found = index() if args.build else open_index(spark, args.index_path)
        except ValueError as error:
            raise SystemExit(f"no index at {args.index_path}: run build-index, or ask with --build") from error
        pipeline = AnswerPipeline(found, create_generator())
        response = pipeline.answer(args.question, product_type=args.product_type, mode=args.mode)
        return {
            "answer": response.answer,
            "latency_ms": response.latency_ms,
            "metadata": response.metadata,
        }

    if args.command == "evaluate-retrieval":
        metrics = evaluate_retrieval(index(args.strategy), asked(), args.k)["metrics"].first()
        return {"strategy": args.strategy, **metrics.asDict()}

    if args.command == "compare-chunking":
        indexes = {s: index(s, path=f"{args.index_path}-{s}") for s in fv.CHUNK_STRATEGIES}
        rows = compare_chunking(indexes, asked()).collect()
        found = {r.strategy: r.asDict() for r in rows}
        return {s: {k: v for k, v in found[s].items() if k != "strategy"} for s in indexes}

    if args.command == "evaluate-rag":
        return evaluate_answers(AnswerPipeline(index(), create_generator()), asked())

    return measure_latency(index())


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session("trovelake")
    ship_package(spark)
    result = run(spark, args)
    if args.command == "ask":
        print(result.pop("answer"))
    print(json.dumps(result, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
