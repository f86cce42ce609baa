"""Occurrences and records of every distinct term or value, counted in burst tries.

A trie holds terms by their prefixes. A leaf keeps the rest of its terms in a small table with two counters each; when a leaf
outgrows its bound it bursts into a node with one leaf for each next character. A worker counts all that it reads in one trie and
emits each leaf once, in order and packed. From the leaves of all workers a plan of prefixes is drawn that splits the vocabulary
into even routes, deep where terms crowd; each emitted leaf is cut along the plan, and matching subtrees meet and merge.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm.terms import terms

#: Terms of a leaf before it bursts; prefixes of a plan, at most; longest prefix that routes.
LEAF, PLAN, DEPTH = 2048, 2048, 12
_PACKED, _PACKED_KIND = ["names", "occurrences", "records"], "names array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters each, in leaves that burst into nodes."""

    def __init__(self, leaf: int = LEAF) -> None:
        self.leaf = leaf
        self.root: list = [None, {}]  # [children or None, table of the leaf]

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, n = self.root, 0, len(term)
        while (children := node[0]) is not None:
            c = term[at : at + 1]
            if (child := children.get(c)) is None:
                child = children[c] = [None, {}]
            node = child
            if at >= n:
                break
            at += 1
        table = node[1]
        rest = term[at:]
        if (old := table.get(rest)) is None:
            table[rest] = (occurrences, records)
            if len(table) > self.leaf:
                self._burst(node)
        else:
            table[rest] = (old[0] + occurrences, old[1] + records)

    def _burst(self, node: list) -> None:
        children: dict[str, list] = {}
        for rest, counters in node[1].items():
            c = rest[:1]
            if (child := children.get(c)) is None:
                child = children[c] = [None, {}]
            child[1][rest[1:]] = counters
        node[0], node[1] = children, {}
        for child in children.values():
            if len(child[1]) > self.leaf:
                self._burst(child)

    def leaves(self) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """(prefix, its terms in order with their counters), prefixes in order."""
        stack = [("", self.root)]
        while stack:
            prefix, (children, table) = stack.pop()
            if children is None:
                if table:
                    yield prefix, sorted((prefix + rest, o, r) for rest, (o, r) in table.items())
            else:
                stack += sorted(((prefix + c, child) for c, child in children.items()), key=lambda x: x[0], reverse=True)


def _plan(weights: list[tuple[str, int]], routes: int) -> list[str]:
    """Borders of routes of about even weight, in order of terms: routes - 1 of them, at most."""
    total, borders, sum_so_far = sum(w for _, w in weights), [], 0
    for prefix, weight in sorted(weights):
        if prefix and sum_so_far * routes >= total * (len(borders) + 1):
            borders.append(prefix)
        sum_so_far += weight
    return borders


def trie_counts(values: DataFrame, split_terms: bool, leaf: int = LEAF) -> DataFrame:
    """(value, occurrences, records) of a one-column frame `value`: of the terms of each row's text, or of each row as it stands.

    Null rows hold nothing. Counts cover every row; the plan of prefixes only decides where counters meet. What is shuffled is each
    worker's distinct terms, so a term that a third of all rows hold is one entry a worker.
    """
    spark = values.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = BurstTrie(leaf)
        for b in batches:
            occurrences: Counter[str] = Counter()
            records: Counter[str] = Counter()
            for x in b["value"]:
                if x is None:
                    continue
                own = terms(x) if split_terms else (x,)
                occurrences.update(own)
                records.update(set(own))
            for term, n in occurrences.items():
                trie.add(term, n, records[term])
        yield pd.DataFrame([(prefix, len(entries), *map(list, zip(*entries))) for prefix, entries in trie.leaves()], columns=["prefix", "size", *_PACKED])

    leaves = runtime.written(values.mapInPandas(count, f"prefix string, size int, {_PACKED_KIND}"), "term-leaves")
    # Bounded by the plan's length: the heaviest prefixes say enough of where terms crowd.
    weights = leaves.groupBy(F.substring("prefix", 1, DEPTH).alias("prefix")).agg(F.sum("size").alias("w")).orderBy(F.desc("w"), "prefix").limit(PLAN)
    borders = _plan([(r["prefix"], r["w"]) for r in weights.collect()], runtime.shuffle_width(spark))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for names, occurrences, records in zip(*(b[c] for c in _PACKED)):
                own, at = list(names), 0
                while at < len(own):
                    route = bisect_right(borders, own[at])
                    end = bisect_left(own, borders[route], at) if route < len(borders) else len(own)
                    rows.append((route, own[at:end], occurrences[at:end], records[at:end]))
                    at = end
            yield pd.DataFrame(rows, columns=["route", *_PACKED])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        trie = BurstTrie(leaf)
        for names, occurrences, records in zip(*(group[c] for c in _PACKED)):
            for term, o, r in zip(names, occurrences.tolist(), records.tolist()):
                trie.add(term, o, r)
        return pd.DataFrame([e for _, entries in trie.leaves() for e in entries], columns=["value", "occurrences", "records"])

    routed = leaves.select(*_PACKED).mapInPandas(cut, f"route int, {_PACKED_KIND}")
    return routed.groupBy("route").applyInPandas(merge, "value string, occurrences bigint, records bigint")


def marked(counts: DataFrame, total: int | DataFrame, rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """counts with `mark`: common above the share of all records, else rare up to rare_records, else null."""
    common = F.col("records") * F.lit(1.0) > F.lit(float(common_share)) * F.lit(total)
    return counts.withColumn("mark", F.when(common, "common").when(F.col("records") <= rare_records, "rare"))


def text_term_counts(df: DataFrame, text: str = "text", rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """(value, occurrences, records, mark) of every term; records are the rows with non-null text, empty ones too."""
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("value"))
    return marked(trie_counts(texts, True), texts.count(), rare_records, common_share)


def value_counts(df: DataFrame, value: str = "freq", record: str = "rank", rare_records: int = 2, common_share: float = 0.2) -> DataFrame:
    """(value, occurrences, records, mark) of every distinct non-null value, as a string.

    A record is a distinct value of `record`; one that is written twice holds a value once. occurrences counts rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"), F.col(record).alias("record"))
    held = trie_counts(rows.where(F.col("record").isNotNull()).distinct().select("value"), False).select("value", "records")
    rows_of = trie_counts(rows.select("value"), False).select("value", "occurrences")
    counts = rows_of.join(held, "value", "left").select("value", "occurrences", F.coalesce("records", F.lit(0)).alias("records"))
    return marked(counts, rows.select("record").where(F.col("record").isNotNull()).distinct().count(), rare_records, common_share)
