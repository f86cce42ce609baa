"""Records whose texts are nearly the same, by signature trees.

In each group of `shingles.routed` one tree stands over all sets, an entry for each shingle by which a set was routed there. A leaf has a
set's token bitmap, its size and the shingle; a node combines its children: bitmaps by OR, sizes as a range. The tree is descended against
itself: a pair of nodes goes on only if some pair of sets below could still overlap enough, which the bitmaps and size ranges bound
from above. What is left is added up over all groups: similar sets meet in a known number of shingles at least, and pairs that reach it
are compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime
from korvane.llm import shingles

#: Children of a node; pairs of nodes that are expanded at a time; bits of a bitmap of routed shingles.
FAN, WIDE, ROUTE = 8, 20_000, 256


class SignatureTree:
    """A tree over a group's entries (a shingle and a set that holds it) in order of shingle and size; level 0 has the entries.

    A node holds, combined by OR over its entries, bitmaps of the shingles it was routed by and the token bitmap of its sets, and the range
    of their sizes. The routed shingles have two bitmaps of ROUTE bits each: of which part of the group's shingles an entry has, and of which
    part of that part, so neighbours share their bits and distant nodes have none in common.
    """

    def __init__(self, sets: shingles.Group, shingle: np.ndarray, places: np.ndarray) -> None:
        """shingle: number of each entry's shingle in order; places: its set."""
        self.sets, self.shingle, self.places = sets, shingle, places
        cell = shingle * (ROUTE * ROUTE) // (int(shingle[-1]) + 1)
        self.first: list[np.ndarray] = []
        self.low, self.high, self.ones, self.bits, self.route = [sets.sizes[places]], [sets.sizes[places]], [sets.ones[places]], [], []
        starts = np.arange(0, len(shingle), FAN)
        while True:
            self.first.append(np.r_[starts, len(self.low[-1])])
            if not self.bits:
                parts = np.zeros((len(shingle), 2 * ROUTE // 64), dtype=np.uint64)
                for half, own in enumerate((cell // ROUTE, cell % ROUTE)):
                    parts[np.arange(len(shingle)), half * (ROUTE // 64) + own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
                bits = sets.bits[places]
            else:
                parts, bits = self.route[-1], self.bits[-1]
            self.route.append(np.bitwise_or.reduceat(parts, starts, axis=0))
            self.bits.append(np.bitwise_or.reduceat(bits, starts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.ones.append(np.minimum.reduceat(self.ones[-1], starts))
            if len(starts) == 1:
                break
            starts = np.arange(0, len(starts), FAN)

    def possible(self, level: int, u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
        """Whether sets below the nodes could share a shingle of this group and be similar to t: by sizes, and by the most they could share."""
        low, high, ones = self.low[level], self.high[level], self.ones[level]
        some = (high[u] >= t * low[v] - 1e-9) & (high[v] >= t * low[u] - 1e-9)
        if level:
            meet = self.route[level - 1][u] & self.route[level - 1][v]
            some &= meet[:, : ROUTE // 64].any(axis=1) & meet[:, ROUTE // 64 :].any(axis=1)
        else:
            some &= self.shingle[u] == self.shingle[v]
        at = np.flatnonzero(some)
        u, v = u[at], v[at]
        both = self.bits[level - 1][u] & self.bits[level - 1][v] if level else self.sets.bits[self.places[u]] & self.sets.bits[self.places[v]]
        common = np.bitwise_count(both).sum(axis=1).astype(np.int64)
        # Each bit that is set in one and cannot be in the other stands for a shingle that they do not share.
        most = np.minimum(high[u] - np.maximum(ones[u] - common, 0), high[v] - np.maximum(ones[v] - common, 0))
        some[at] = most >= t / (1 + t) * (low[u] + low[v]) - 1e-9
        return some

    def pairs(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of sets of the pairs of entries that no bound rules out, by dual descent from the root."""
        root = np.zeros(1, dtype=np.int64)
        stack, found = [(len(self.low) - 1, root, root)], []
        while stack:
            level, u, v = stack.pop()
            if level == 0:
                found.append((self.places[u], self.places[v]))
                continue
            if len(u) > WIDE:
                stack += [(level, u[i : i + WIDE], v[i : i + WIDE]) for i in range(0, len(u), WIDE)]
                continue
            first = self.first[level - 1]
            a, b = first[u][:, None] + np.arange(FAN), first[v][:, None] + np.arange(FAN)
            a_in, b_in = a < first[u + 1][:, None], b < first[v + 1][:, None]
            x, y = np.broadcast_to(a[:, :, None], (len(u), FAN, FAN)), np.broadcast_to(b[:, None, :], (len(u), FAN, FAN))
            use = a_in[:, :, None] & b_in[:, None, :] & ((u != v)[:, None, None] | (x < y if level == 1 else x <= y))
            x, y = x[use], y[use]
            good = self.possible(level - 1, x, y, t)
            if good.any():
                stack.append((level - 1, x[good], y[good]))
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def group_pairs(rows: pd.DataFrame, t: float) -> pd.DataFrame:
    """(a, b, covered, need): pairs of classes, smaller first, that the tree of one group leaves; in how many shingles of the group they meet;
    and in how many a pair of their sizes meets at least over all groups."""
    sets = shingles.Group(rows)
    order = np.lexsort((sets.docs, sets.sizes[sets.docs], sets.keys))
    keys, docs = sets.keys[order], sets.docs[order]
    same = keys[1:] == keys[:-1]
    often = np.r_[same, False] | np.r_[False, same]  # a shingle that one set holds has no pair
    keys, docs = keys[often], docs[often]
    if not len(docs):
        return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("a", "b", "covered", "need")})
    u, v = SignatureTree(sets, np.cumsum(np.r_[0, keys[1:] != keys[:-1]]), docs).pairs(t)
    both, covered = np.unique(np.minimum(u, v) * len(sets.classes) + np.maximum(u, v), return_counts=True)  # places are in order of class
    u, v = both // len(sets.classes), both % len(sets.classes)
    return pd.DataFrame({"a": sets.classes[u], "b": sets.classes[v], "covered": covered, "need": shingles.least_covered(sets.sizes[u], sets.sizes[v], t)})


def class_links(df: DataFrame, key: str, text: str, t: float = 0.8, k: int = 5, min_terms: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, class) of each record that has at least min_terms terms, and (a, b), each pair of different classes
    whose sets of k-term shingles are similar to at least t, smaller name first.

    Exact: the routes miss no pair at t and the trees rule out only pairs that cannot reach it. Null, empty and short texts have no
    class; records with equal sets share one, so any number of copies costs one entry and no pairs among themselves; an empty table
    gives two empty ones; further columns are not read.
    """
    table = shingles.shingle_table(df, key, text, k, min_terms)
    parts = shingles.routed(table, t).groupBy("p").applyInPandas(lambda rows: group_pairs(rows, t), "a bigint, b bigint, covered bigint, need bigint")
    candidates = parts.groupBy("a", "b").agg(F.sum("covered").alias("covered"), F.min("need").alias("need")).where(F.col("covered") >= F.col("need")).select("a", "b")
    links = runtime.written(shingles.verified(candidates, table, t), "links")
    return table.where((F.col("part") < 0) & F.col("class").isNotNull()).select(key, "class"), links


def near_duplicate_pairs(df: DataFrame, key: str = "article_id", text: str = "text", t: float = 0.5, k: int = 3, min_terms: int = 20) -> DataFrame:
    """(key_a, key_b), smaller first: every pair of records that are near-duplicates, copies included."""
    members, links = class_links(df, key, text, t, k, min_terms)
    a, b = members.select(F.col(key).alias("x"), F.col("class").alias("a")), members.select(F.col(key).alias("y"), F.col("class").alias("b"))
    between = links.join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def near_duplicate_classes(df: DataFrame, key: str = "article_id", text: str = "text", t: float = 0.5, k: int = 3, min_terms: int = 20) -> DataFrame:
    """(key, class, links): each record, its class and how many other classes are linked to it; null and 0 for short or null texts."""
    members, links = class_links(df, key, text, t, k, min_terms)
    counts = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    own = members.join(counts, "class", "left")
    return df.select(key).join(own, key, "left").select(key, "class", F.coalesce("links", F.lit(0)).alias("links"))
