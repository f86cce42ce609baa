"""Boolean queries: lexer, parser, and one Spark plan for a whole query."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvane.functions import text as tx

# Words that are operators, after lowering.
OPERATORS = {"and": "AND", "и": "AND", "or": "OR", "или": "OR", "not": "NOT", "не": "NOT"}
_BINDING = {"OR": 1, "AND": 2, "NOT": 3}
_LEXEME = re.compile(rf"[()]|[{tx.TOKEN_CLASS}][{tx.TOKEN_CLASS}'-]*")
_LOWER, _STEM = str.maketrans(tx.CAPITALS, tx.SMALL), re.compile(rf"(?:{'|'.join(tx.SUFFIXES)})\Z")


class QuerySyntaxError(ValueError):
    """A query lacks an operand."""


@dataclass(frozen=True)
class Token:
    kind: str  # TERM, AND, OR, NOT, ( or )
    text: str = ""


def lex(query: str) -> list[Token]:
    """Tokens of a query with the ANDs that stand between neighbours unsaid. Unlike in texts, - and ' stay at the end of a term."""
    out: list[Token] = []
    for lexeme in _LEXEME.findall(query):
        word = lexeme.translate(_LOWER)
        if lexeme in "()":
            token = Token(lexeme)
        elif kind := OPERATORS.get(word):
            token = Token(kind)
        else:
            token = Token("TERM", _STEM.sub("", word))
        if out and out[-1].kind in ("TERM", ")") and token.kind in ("TERM", "(", "NOT"):
            out.append(Token("AND"))
        out.append(token)
    return out


def postfix(tokens: list[Token]) -> list[Token]:
    """Operands before operators; NOT binds closer than AND, AND than OR. A stray ) and an unclosed ( are ignored."""
    out: list[Token] = []
    waiting: list[Token] = []
    for t in tokens:
        if t.kind == "TERM":
            out.append(t)
        elif t.kind == "(":
            waiting.append(t)
        elif t.kind == ")":
            while waiting and waiting[-1].kind != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            # NOT stands before its operand, so it never ends another operator.
            while t.kind != "NOT" and waiting and waiting[-1].kind != "(" and _BINDING[waiting[-1].kind] >= _BINDING[t.kind]:
                out.append(waiting.pop())
            waiting.append(t)
    out += [t for t in reversed(waiting) if t.kind != "("]
    return out


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(t.text for t in lex(query) if t.kind == "TERM"))


def predicate(tokens: list[Token], flags: dict[str, Column]) -> Column | None:
    """One Boolean column for a query in postfix order; None for an empty one."""
    stack: list[Column] = []
    for t in tokens:
        if t.kind == "TERM":
            stack.append(F.coalesce(flags[t.text], F.lit(False)))
            continue
        need = 1 if t.kind == "NOT" else 2
        if len(stack) < need:
            raise QuerySyntaxError(f"{t.kind} lacks an operand")
        b = stack.pop()
        stack.append(~b if t.kind == "NOT" else stack.pop() & b if t.kind == "AND" else stack.pop() | b)
    return stack[-1] if stack else None


def search(rows: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, url or whatever docs has) of the documents that satisfy a query, in order of doc_id.

    rows: (term, doc_id, ...) postings. All terms are read in one scan with a pushed filter and aggregated to flags per document; a query
    that needs a term becomes an inner join, one that a document without any term satisfies keeps the documents on the outer side.
    """
    order = postfix(lex(query))
    words = terms_of(query)
    flags = {w: F.col(f"f{i}") for i, w in enumerate(words)}
    wanted = predicate(order, flags)
    if wanted is None:
        return docs.where(F.lit(False)).orderBy("doc_id")
    found = rows.where(F.col("term").isin(words)).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == w).alias(f"f{i}") for i, w in enumerate(words)))
    return docs.join(found, "doc_id", "left").where(wanted).select(*docs.columns).orderBy("doc_id")


def search_arrays(index: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """search over an index with arrays of postings."""
    return search(index.where(F.col("term").isin(terms_of(query))).select("term", F.explode("postings").alias("doc_id")), docs, query)


def search_page(rows: DataFrame, docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first hits by doc_id, in that order, with `total`, the number of all of them; without any hit one row of nulls and a total of 0."""
    hits = search(rows, docs, query)
    total = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    first = hits.limit(limit).withColumn("_at", F.lit(1))
    return total.join(first, F.col("_one") == F.col("_at"), "left").select(*docs.columns, "total").orderBy("doc_id")


def query_of_request(method: str, target: str) -> str | None:
    """The query of a request line: only of a GET whose first parameter is q; all that follows belongs to it. None: not found."""
    from urllib.parse import unquote_plus

    if method != "GET":
        return None
    given = target.partition("?")[2]
    return unquote_plus(given[2:], errors="replace") if given.startswith("q=") else ""


def render_page(query: str, total: int, hits: list[tuple[int, str]]) -> str:
    """A result page; the query and addresses are escaped."""
    rows = "".join(f'<li><a href="{html.escape(u, True)}">{html.escape(u)}</a></li>' for _, u in hits)
    return f'<!doctype html><form><input name="q" value="{html.escape(query, True)}"><button>Search</button></form><p>Results: {total}</p><ul>{rows}</ul>'
