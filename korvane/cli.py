"""Command line: build an index, count terms, search, serve a search page."""

from __future__ import annotations

import argparse
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.operators import boolean, index, zipf
from korvane.sources import files


def build(spark: SparkSession, documents: str, out: str, limit: int | None) -> None:
    """docs, postings (ordered by term, so that a query reads few row groups), frequencies and statistics of a table of (doc_id, text, ...)."""
    df = spark.read.parquet(documents)
    df = df.where(F.length("text") > 0) if limit is None else df.orderBy("doc_id").limit(limit).where(F.length("text") > 0)
    index.write_postings(index.postings(df), f"{out}/postings")
    df.select(*(c for c in ("doc_id", "url") if c in df.columns)).write.mode("overwrite").parquet(f"{out}/docs")
    ranked = zipf.zipf_rank(index.term_frequency(df))
    files.write_freq(ranked, f"{out}/freq")
    index.index_stats(df).write.mode("overwrite").json(f"{out}/stats")


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/docs")


def serve(spark: SparkSession, folder: str, port: int) -> None:
    rows, docs = tables(spark, folder)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            query = boolean.query_of_request("GET", self.path)
            try:
                hits = boolean.search_page(rows, docs, query or "").collect()
                page = boolean.render_page(query or "", hits[0]["total"], [(r["doc_id"], str(r[1])) for r in hits if r["doc_id"] is not None])
            except boolean.QuerySyntaxError as e:
                page = boolean.render_page(f"{query} ({e})", 0, [])
            body = page.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:  # noqa: N802
            self.send_error(404)

    HTTPServer(("", port), Handler).serve_forever()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="korvane", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("documents")
    one.add_argument("out")
    one.add_argument("--limit", type=int)
    one = sub.add_parser("search")
    one.add_argument("index")
    one.add_argument("query")
    one = sub.add_parser("serve")
    one.add_argument("index")
    one.add_argument("--port", type=int, default=8080)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("korvane").getOrCreate()
    if given.command == "index":
        build(spark, given.documents, given.out, given.limit)
    elif given.command == "search":
        hits = boolean.search(*tables(spark, given.index), given.query)
        print(f"Results: {hits.count()}")
        for r in hits.toLocalIterator():
            print("\t".join(str(x) for x in r))
    else:
        serve(spark, given.index, given.port)


if __name__ == "__main__":
    main()
