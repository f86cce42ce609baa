from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from korvane.operators import boolean, index

CORPUS = ["Linux и Windows", "windows python", "linux PYTHON e-mail", "Я дома", "домами unity", "rock'n'roll unity выстрел"]
RESULTS = {
    "(linux or windows) and not python": [0], "linux windows": [0], "linux или не python": [0, 2, 3, 4, 5], "не linux": [1, 3, 4, 5], "Unity и не выстрел": [4], "Unity выстрел": [5],
    "linux or windows and python": [0, 1, 2], "(linux or windows) python": [1, 2], "not (linux or windows)": [3, 4, 5], "linux -python": [2], "дом": [], "а": [0, 3], "e-mail": [2], "e-mail-": [], "c++": [],
    "missing": [], "": [], "()": [], "linux)": [0, 2], "(linux": [0, 2], "not not linux": [0, 2],
}


@pytest.fixture(scope="module")
def parts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    return index.postings(docs).cache(), docs.select("doc_id")


@pytest.mark.parametrize("query", RESULTS)
def test_results(parts: tuple[DataFrame, DataFrame], query: str) -> None:
    assert [r["doc_id"] for r in boolean.search(*parts, query).collect()] == RESULTS[query]


@pytest.mark.parametrize("query", ["linux and", "and linux", "() linux and", "not"])
def test_missing_operand(parts: tuple[DataFrame, DataFrame], query: str) -> None:
    with pytest.raises(boolean.QuerySyntaxError):
        boolean.search(*parts, query)


def test_arrays_give_the_same(parts: tuple[DataFrame, DataFrame]) -> None:
    rows, docs = parts
    for query in ("(linux or windows) and not python", "не linux"):
        assert boolean.search_arrays(index.inverted_index(rows), docs, query).collect() == boolean.search(rows, docs, query).collect()


def test_laws(parts: tuple[DataFrame, DataFrame]) -> None:
    rows, docs = parts
    got = lambda q: [r[0] for r in boolean.search(rows, docs, q).collect()]
    assert got("not (linux or python)") == got("not linux and not python")
    assert got("unity and not unity") == []
    assert got("unity or not unity") == list(range(len(CORPUS)))


def test_plan_needs_no_outer_join(parts: tuple[DataFrame, DataFrame]) -> None:
    rows, docs = parts
    plan = boolean.search(rows, docs, "linux and not python")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Inner" in plan


def test_requests_and_page() -> None:
    assert boolean.query_of_request("GET", "/search?q=a%2Bb+c%zz&x=1") == "a+b c%zz&x=1"
    assert boolean.query_of_request("POST", "/?q=a") is None
    assert boolean.query_of_request("GET", "/?x=1") == ""
    assert "<script>" not in boolean.render_page("<script>", 1, [(0, 'http://a/"><script>')])


def test_command_line(spark: SparkSession, tmp_path, capsys: pytest.CaptureFixture[str]) -> None:
    from korvane import cli

    spark.createDataFrame([(i, t, f"http://d/{i}") for i, t in enumerate(CORPUS)], "doc_id bigint, text string, url string").write.parquet(f"{tmp_path}/documents")
    cli.main(["index", f"{tmp_path}/documents", f"{tmp_path}/index"])
    cli.main(["search", f"{tmp_path}/index", "unity не выстрел"])
    assert capsys.readouterr().out == "Results: 1\n4\thttp://d/4\n"


def test_terms_are_pushed_to_the_scan(spark: SparkSession, tmp_path) -> None:
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    index.postings(docs).write.parquet(f"{tmp_path}/postings")
    stored = spark.read.parquet(f"{tmp_path}/postings")
    plan = boolean.search(stored, docs.select("doc_id"), "linux and unity")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [linux,unity])" in plan and "tf" not in plan.split("ReadSchema")[1].split("\n")[0]
