from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from korvane.functions import text as tx


def is_token(c: str) -> bool:
    return c.isascii() and c.isalnum() or "Ѐ" <= c <= "ѿ"


def model_tokens(s: str) -> list[str]:
    out, cur = [], ""
    for i, c in enumerate(s):
        if is_token(c):
            cur += c
        elif c in "-'" and cur and i + 1 < len(s) and is_token(s[i + 1]):
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out + [cur] * bool(cur)


def model_term(t: str) -> str:
    low = "".join(c.lower() if c.isascii() or "А" <= c <= "Я" or c == "Ё" else c for c in t)
    for s in tx.SUFFIXES:
        if low.endswith(s):
            return low[: -len(s)]
    return low


def model_strip(h: str) -> str:
    """Scanner over a page: tags are skipped without ending a token, a joiner before a tag ends it."""
    out, i = [], 0
    while i < len(h):
        if h[i] == "<":
            end = h.find(">", i)
            if end < 0:
                break
            i = end
        elif h[i] in "-'" and h[i + 1 : i + 2] == "<":
            out.append(" ")
        else:
            out.append(h[i])
        i += 1
    return "".join(out)


def test_golden_terms(spark: SparkSession) -> None:
    cases = {
        "Ёлки-палки, rock'n'roll и У я ОГО! Їжак 3.14 C++ e‑mail a--b -x- café": ["ёлки-палк", "rock'n'roll", "", "", "", "", "Їжак", "3", "14", "c", "e", "mail", "a", "b", "x", "caf"],
        "домами Windows-ами КѠ tail\n": ["дом", "windows-", "кѠ", "tail"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", F.transform(tx.raw_tokens(F.col("t")), tx.term).alias("terms")).collect():
        assert row["terms"] == cases[row["t"]]


def test_golden_html(spark: SparkSession) -> None:
    df = spark.createDataFrame([("<p>сло<b>во</b></p><p>foo-<b>bar</b> x<y",)], "h string")
    assert df.select(tx.raw_tokens(tx.html_strip(F.col("h")))).first()[0] == ["словоfoo", "bar", "x"]


def test_random_strings(spark: SparkSession) -> None:
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("Az09 -'-'<>ЁёІѢҐяамиые.\n é—ß") for _ in range(rnd.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", F.transform(tx.raw_tokens(F.col("t")), tx.term).alias("a"), tx.raw_tokens(tx.html_strip(F.col("t"))).alias("b"))
    for r in df.collect():
        assert r["a"] == [model_term(x) for x in model_tokens(r["t"])], r["t"]
        assert r["b"] == model_tokens(model_strip(r["t"])), r["t"]


def test_null_text(spark: SparkSession) -> None:
    row = spark.createDataFrame([(None,)], "t string").select(tx.raw_tokens(F.col("t")), tx.input_units(F.col("t"))).first()
    assert row[0] is None and row[1] is None
