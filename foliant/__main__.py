"""Command line: discover-urls, build-corpus, search, ask, evaluate and evaluate-answers."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .errors import EngineError
from .operators import answers, metrics
from .plans import corpus, url_rules
from .session import session
from .settings import RetrievalSettings
from .sources import runs, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build-corpus")
    build.add_argument("html_dir")
    build.add_argument("folder")
    build.add_argument("--base-url", default="https://www.example.com")
    discover = sub.add_parser("discover-urls")
    discover.add_argument("sitemaps", help="a folder of sitemap files")
    discover.add_argument("links", help="where the kept links go")
    for name in ("search", "ask", "evaluate", "evaluate-answers"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("query", help="a query, or a file of evaluation queries")
        c.add_argument("--k", type=int, default=50 if name == "evaluate" else None)
        c.add_argument("--method", choices=("vector", "bm25", "hybrid"), default="hybrid")
        c.add_argument("--category")
        c.add_argument("--rerank", action=argparse.BooleanOptionalAction, default=name != "evaluate-answers")
        c.add_argument("--fetch-k", type=int)
        c.add_argument("--title-weight", type=float)
        c.add_argument("--text-weight", type=float)
        c.add_argument("--run-dir")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if a.command not in ("build-corpus", "discover-urls"):
            answers.require_positive(k=a.k, fetch_k=a.fetch_k, title_weight=a.title_weight, text_weight=a.text_weight)
        return run(a)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace) -> int:
    spark = session("foliant", a.master)
    settings = RetrievalSettings.from_env("RAG_")
    if a.command == "build-corpus":
        row = corpus.build(tables.html_folder(spark, a.html_dir), a.folder, a.base_url, settings).first()
        print(f"{row.n_articles} articles, {row.n_chunks} chunks")
        return 0
    if a.command == "discover-urls":
        found = tables.sitemap_folder(spark, a.sitemaps)
        links, counts = url_rules.discover(found, url_rules.SITE_RULES, url_rules.THIRD_PARTY)
        links.write.mode("overwrite").parquet(a.links)
        kept = spark.read.parquet(a.links).count()
        print(f"{found.count()} urls in sitemaps, {kept} kept", *(f"{r.level_1} {r.n}" for r in counts.collect()), sep="\n")  # a row a category
        return 0
    given = {k: v for k, v in (("title_weight", a.title_weight), ("text_weight", a.text_weight)) if v is not None}
    settings = RetrievalSettings(**{**settings.__dict__, **given})
    retriever = corpus.load(spark, a.folder, settings)
    options = {"method": a.method, "rerank": a.rerank}
    if a.command in ("search", "ask"):
        asked = spark.createDataFrame([(1, a.query)], "query_id bigint, query string")
        options |= {"k": a.k or settings.search_k, "category": a.category, "fetch_k": a.fetch_k or settings.rerank_fetch_k}
        if a.command == "search":
            for r in retriever.search(asked, **options).orderBy("rank").collect():  # k rows
                print(f"{r.rank}. {r.score:.4f} {r.title} [{r.chunk_id}] {r.url}")
            return 0
        r = corpus.ask(retriever, asked, **options).first()
        print(r.text, *(f"[{c.n}] {c.title} {c.url}" for c in r.citations), sep="\n")
        if r.invented:
            print(f"invented citations: {r.invented}", file=sys.stderr)
        return 0
    queries = tables.eval_queries(spark, a.query)
    if a.command == "evaluate":
        results, summary, hits = corpus.evaluate(retriever, queries, a.k, **options)
        line = metrics.summary_line(ks=metrics.measured_ks(a.k))
        shown = metrics.misses(results, hits)
    else:
        results, summary = corpus.evaluate_answers(retriever, queries, k=a.k or settings.search_k, **options)
        line = F.format_string("n=%d  retrieved %.2f  cited %.2f  refused %.2f  invented %.2f", *[F.col(c) for c in ("n_queries", "retrieval_rate", "citation_rate", "refusal_rate", "invented_citation_rate")])
        shown = results.filter("invented_citation")
    for r in summary.select("grouping", "key", line.alias("line")).orderBy("grouping", "key").collect():  # a row a group
        print(f"{r.grouping:<9} {r.key or '':<20} {r.line}")
    print(f"{shown.count()} {'misses' if a.command == 'evaluate' else 'answers with invented citations'}")
    if a.run_dir:
        print(runs.write_run(summary, results, a.run_dir, a.command, method=a.method, rerank=a.rerank, k=a.k, **settings.__dict__))
    return 0


if __name__ == "__main__":
    sys.exit(main())
