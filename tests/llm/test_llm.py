from __future__ import annotations

import itertools
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvane.llm import bpe, history, markup, near_duplicates, packing, queries, repeated_lines, shingles, templates, term_counts, text_quality, urls
from korvane.llm.terms import terms

CLASHING = ["key", "class", "part", "h", "p", "a", "b", "host", "value", "kind", "n", "id", "line_no"]
WORDS = "аист буря ветер город дождь ель жук зима игра кот лес мост нос окно пирог река снег трава утро флаг хлеб цветок чай шар щит".split()


def articles(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """(article_id, batch_no, source, url, title, text); extra: with columns of clashing names."""
    df = spark.createDataFrame(rows, "article_id bigint, batch_no int, source string, url string, title string, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if extra else df


def prose(rnd: random.Random, n: int) -> list[str]:
    return [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n)]


def sets_of(text: str | None, k: int = 3, least: int = 20) -> set[tuple[str, ...]]:
    t = terms(text)
    return set(zip(*(t[i:] for i in range(k)))) if len(t) >= least else set()


def similar(a: set, b: set, t: float = 0.5) -> bool:
    return bool(a and b) and len(a & b) >= t * len(a | b)


def family(seed: int, n: int = 60) -> list[tuple]:
    """Records with edits of each other, copies, shared phrases, short, empty and null texts, spread over batches and addresses."""
    rnd = random.Random(seed)
    rows, texts = [], []
    for i in range(1, n + 1):
        r = rnd.random()
        if r < 0.06:
            text = rnd.choice([None, "", "  ", "короткий текст"])
        elif r < 0.5 and texts:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randrange(1 + len(words) // 9)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            text = " ".join(words)
        elif r < 0.6 and texts:
            text = rnd.choice(texts)
        else:
            text = " ".join(["общая фраза сайта для всех"] * rnd.randrange(3) + prose(rnd, rnd.randrange(18, 70)))
        if text and len(text) > 40:
            texts.append(text)
        url = None if rnd.random() < 0.1 else rnd.choice(["http://www.a.example/p/{}?utm_source=x", "https://a.example/p/{}/", "https://A.example:443/p/{}#top"]).format(rnd.randrange(n))
        rows.append((i, rnd.randrange(4), "s" if rnd.random() < 0.5 else None, url, None, text))
    return rows


def same_names() -> list[tuple[str, str]]:
    return [
        ("http://www.a.example/p/1/?utm_source=x&b=2&a=1#top", "https://A.EXAMPLE:443/p/1?a=1&b=2"),
        ("https://a.example/%D0%B0", "https://a.example/а"),
        ("https://a.example", "http://a.example/"),
        ("https://a.example/a/../b/./c", "https://a.example/b/c"),
    ]


def test_page_keys() -> None:
    for a, b in same_names():
        assert urls.page_key(a) == urls.page_key(b), (a, b)
    for a, b in (("https://a.example/P", "https://a.example/p"), ("https://m.a.example/p", "https://a.example/p"), ("https://a.example/p?page=2", "https://a.example/p"), ("https://a.example/p/comments", "https://a.example/p")):
        assert urls.page_key(a) != urls.page_key(b)
    assert urls.page_key(None) is None and urls.page_key("  ") is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicate_pairs_against_brute_force(spark: SparkSession, seed: int) -> None:
    rows = family(seed)
    own = {r[0]: sets_of(r[5]) for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if similar(own[a], own[b])}
    got = near_duplicates.near_duplicate_pairs(articles(spark, rows, True))
    assert got.columns == ["article_id_a", "article_id_b"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_near_duplicate_classes(spark: SparkSession) -> None:
    rows = family(4)
    own = {r[0]: sets_of(r[5], 5, 5) for r in rows}
    got = {r["article_id"]: (r["class"], r["links"]) for r in near_duplicates.near_duplicate_classes(articles(spark, rows), t=0.8, k=5, min_terms=5).collect()}
    assert set(got) == set(own)
    for a, s in own.items():
        assert (got[a][0] is None) == (not s)
        others = {frozenset(x) for x in own.values() if x != s and similar(s, x, 0.8)}
        assert got[a][1] == len(others)
    for a, b in itertools.combinations(own, 2):
        if own[a] and own[b]:
            assert (got[a][0] == got[b][0]) == (own[a] == own[b])
    assert near_duplicates.near_duplicate_classes(articles(spark, [])).count() == 0


def test_many_copies_stay_one_entry(spark: SparkSession) -> None:
    text = " ".join(prose(random.Random(1), 60))
    rows = [(i, 0, "s", None, None, text) for i in range(400)] + [(1000, 0, "s", None, None, text + " ещё слово")]
    members, links = near_duplicates.class_links(articles(spark, rows), "article_id", "text", 0.5, 3, 20)
    assert members.select("class").distinct().count() == 2 and links.count() == 1


@pytest.mark.parametrize("shingles_held", [1, 40])
def test_tree_equals_all_pairs(shingles_held: int) -> None:
    rnd = np.random.default_rng(3)
    base = [np.unique(rnd.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[: len(b) - int(c)], rnd.integers(0, 1 << 40, int(c), dtype=np.uint64)])) for b in base for c in rnd.integers(0, 25, 9)]

    class Given:
        classes = np.arange(len(sets))
        sizes = np.array([len(s) for s in sets])
        bits = np.array([shingles.signature(s) for s in sets])
        ones = np.bitwise_count(np.array([shingles.signature(s) for s in sets])).sum(axis=1).astype(np.int64)

    order = np.argsort(Given.sizes, kind="stable")  # every set under each of so many shingles
    u, v = near_duplicates.SignatureTree(Given, np.repeat(np.arange(shingles_held), len(sets)), np.tile(order, shingles_held)).pairs(0.5)
    assert len(set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist()))) * shingles_held == len(u)
    found = {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())}
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if shared >= 0.5 * (len(sets[i]) + len(sets[j]) - shared):
            assert (i, j) in found
    assert len(found) < len(sets) * (len(sets) - 1) // 4


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_repeats_against_brute_force(spark: SparkSession, seed: int) -> None:
    rows = family(seed)
    own = {r[0]: sets_of(r[5]) for r in rows}
    accepted: list[tuple] = []
    want = set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        name = urls.page_key(r[3])
        if r[1] and any((name and name == urls.page_key(e[3])) or similar(own[r[0]], own[e[0]]) for e in accepted):
            want.add(r[0])
        else:
            accepted.append(r)
    got = [r[0] for r in history.repeats(articles(spark, rows, True)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", [5, 8])
def test_archive_gives_what_one_pass_gives(spark: SparkSession, tmp_path, seed: int) -> None:
    rows = family(seed, 90)
    df = articles(spark, rows)
    want = {r[0] for r in history.repeats(df).collect()}
    archive = history.Archive(spark, str(tmp_path))
    got = {r[0] for n in range(4) for r in archive.add(df.where(F.col("batch_no") == n)).collect()}
    assert got == want
    assert len(archive.parts) <= 3


def test_archive_goes_on_in_a_new_object(spark: SparkSession, tmp_path) -> None:
    df = articles(spark, family(6, 70))
    want = {r[0] for r in history.repeats(df).collect()}
    stale = history.Archive(spark, str(tmp_path))
    got = {r[0] for n in range(4) for r in history.Archive(spark, str(tmp_path)).add(df.where(F.col("batch_no") == n)).collect()}
    assert got == want
    with pytest.raises(ValueError):
        stale.add(df)
    with pytest.raises(ValueError):
        history.Archive(spark, str(tmp_path), t=0.6)
    (tmp_path / "old" / "batch=0").mkdir(parents=True)
    with pytest.raises(ValueError):
        history.Archive(spark, str(tmp_path / "old"))


def test_repeats_of_nothing(spark: SparkSession) -> None:
    assert history.repeats(articles(spark, [])).count() == 0
    assert history.repeats(articles(spark, [(1, 0, None, None, None, None), (2, 1, None, None, None, None), (3, 1, None, None, None, "")])).count() == 0


def test_segments_are_sorted_and_find_what_they_hold(spark: SparkSession) -> None:
    rows = [r for r in family(7, 60) if len(sets_of(r[5])) > 0]
    table = history._table(articles(spark, rows), "article_id", None, "url", "text", 3, 20)
    packed = history._stretches(table.where(F.col("class").isNotNull()), 0.5, 3, np.zeros(shingles.SKETCH, dtype=np.uint32), 2).toPandas()
    own = {r["class"]: history._set_of(r["sequence"], 3) for r in table.where(F.col("class").isNotNull()).collect()}
    whole = history.Segment.built(packed[packed["p"] == 0], 3)
    first, second = whole.keys(whole.places.astype(np.int64))
    order = list(zip(first.tolist(), second.tolist()))
    assert order == sorted(order) and len(set(whole.classes.tolist())) == len(whole.classes)
    half = len(packed[packed["p"] == 0]) // 2
    one, two = (history.Segment.built(g, 3) for g in (packed[packed["p"] == 0].iloc[:half], packed[packed["p"] == 0].iloc[half:]))
    merged = one.merged(two)
    again = merged.keys(merged.places.astype(np.int64))[0]
    assert (np.diff(again.astype(object)) >= 0).all() and sorted(again.tolist()) == sorted(first.tolist())
    assert sorted(merged.classes.tolist()) == sorted(whole.classes.tolist())
    # Both groups together: coverage is the number of chosen windows that a pair shares, and no similar pair stays below its need.
    covered: Counter = Counter()
    need = {}
    for p in (0, 1):
        s = history.Segment.built(packed[packed["p"] == p], 3)
        for r in s.covered(s, 0.5, True).itertuples(index=False):
            covered[min(r.a, r.b), max(r.a, r.b)] += r.covered
            need[min(r.a, r.b), max(r.a, r.b)] = r.need
    for a, b in itertools.combinations(sorted(own), 2):
        shared = len(np.intersect1d(own[a], own[b]))
        assert covered[a, b] <= shared
        if shared >= 0.5 * (len(own[a]) + len(own[b]) - shared):
            assert covered[a, b] >= need[a, b]


def test_archive_sends_the_batch_to_the_stored_arrays(spark: SparkSession, tmp_path) -> None:
    """The plan of a look-up neither sorts nor shuffles what is stored, and reads no sequence of a text that no pair asks for."""
    df = articles(spark, family(6, 70))
    archive = history.Archive(spark, str(tmp_path))
    archive.add(df.where(F.col("batch_no") == 0))
    stored = archive._read("segments", archive.parts)
    asks = F.broadcast(stored.select(*(F.col(c).alias(f"n_{c}") for c in history._COLUMNS)))
    plan = stored.join(asks, F.col("p") == F.col("n_p"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan
    with pytest.raises(ValueError):
        history.Archive(spark, str(tmp_path / "x"), k=9)


def test_term_counts_against_counters(spark: SparkSession) -> None:
    texts = [(i, r[5]) for i, r in enumerate(family(8, 80))] + [(900, "Rock'n'roll rock'n'roll ЇЖАК"), (901, "слово " * 30_000)]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("value", F.lit(1))
    occurrences, records = Counter(), Counter()
    for _, t in texts:
        own = terms(t)
        occurrences.update(own)
        records.update(set(own))
    total = sum(t is not None for _, t in texts)
    got = {r["value"]: r for r in term_counts.text_term_counts(df).collect()}
    assert {v: (r["occurrences"], r["records"]) for v, r in got.items()} == {t: (occurrences[t], records[t]) for t in occurrences}
    for t, r in got.items():
        assert r["mark"] == ("common" if records[t] > 0.2 * total else "rare" if records[t] <= 2 else None)
    assert term_counts.text_term_counts(df.limit(0)).count() == 0


def test_value_counts(spark: SparkSession) -> None:
    rows = [(1, 5), (1, 5), (2, 5), (3, 7), (4, None), (None, 7), (5, 9), (6, 9), (7, 9)]
    got = {r["value"]: (r["occurrences"], r["records"], r["mark"]) for r in term_counts.value_counts(spark.createDataFrame(rows, "rank bigint, freq bigint")).collect()}
    assert got == {"5": (3, 2, "common"), "7": (2, 1, "rare"), "9": (3, 3, "common")}


def test_burst_trie() -> None:
    rnd = random.Random(2)
    trie, plain = term_counts.BurstTrie(8), Counter()
    for _ in range(3000):
        t = "".join(rnd.choice("abя") for _ in range(rnd.randrange(7)))
        trie.add(t, 1, 2)
        plain[t] += 1
    flat = [e for _, own in trie.leaves() for e in own]
    assert {t: o for t, o, _ in flat} == plain and all(r == 2 * o for _, o, r in flat)
    assert [t for t, _, _ in flat] == sorted(plain)
    assert max(len(own) for _, own in trie.leaves()) <= 8


def test_frequent_lines_against_brute_force(spark: SparkSession) -> None:
    rnd = random.Random(4)
    pool = ["Поделиться: 12", "поделиться 99", "ПОДЕЛИТЬСЯ!", "abc", "© 2020 Сайт", "обычная строка"]
    rows = []
    for i in range(120):
        lines = [rnd.choice(pool) if rnd.random() < 0.4 else " ".join(prose(rnd, 5)) for _ in range(rnd.randrange(1, 6))]
        rows.append((i, 0, rnd.choice(["a", "b", None]), None, None, rnd.choice([None, "", "\n".join(lines), "\r\n".join(lines)])))
    letters = lambda x: "".join(c for c in x if c.isalpha()).lower()
    held, size = defaultdict(set), Counter()
    for i, _, s, _, _, t in rows:
        if t:
            size[s] += 1
            for x in t.split("\n"):
                held[s, letters(x)].add(i)
    want = {(i, n) for i, _, s, _, _, t in rows if t for n, x in enumerate(t.split("\n"), 1) if len(letters(x)) >= 4 and len(held[s, letters(x)]) >= max(5, 0.05 * size[s])}
    df = articles(spark, rows, True)
    assert {tuple(r) for r in repeated_lines.frequent_lines(df).collect()} == want
    kept = {r["article_id"]: r["text"] for r in repeated_lines.without_frequent_lines(df).collect()}
    for i, _, _, _, _, t in rows:
        assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want))
    assert repeated_lines.frequent_lines(df.limit(0)).count() == 0


MARKED = [
    ("plain text, a < b and b > c, 5*3*2, List<String>, C:\\temp\\new_1 and my_long_name, [1], #tag, R&D, $5 or $ 6 per unit, • item", set()),
    ("Хабы > Обзоры\n1) раз;\n— два\n", set()),
    ("<p class=\"x\">a</p>", {"html"}), ("a &nbsp; b", {"html"}), ("cut <div class=\"adv", {"html"}), ("a <!-- b -->", {"html"}), ("&lt;b&gt;x&lt;/b&gt;", {"html"}),
    ("## Head", {"markdown"}), ("a **b** c", {"markdown"}), ("```\ncode\n```", {"markdown"}), ("[a](https://b)", {"markdown"}), ("Title\n=====\ntext", {"markdown"}), ("- a\n- b", {"markdown"}), ("a `b` c", {"markdown"}),
    ("[[a|b]]", {"wiki"}), ("== A ==", {"wiki"}), ("{{t|1}}", {"wiki"}), ("'''a'''", {"wiki"}), ("{| class=\"x\"\n|-\n|}", {"wiki"}), ("[http://a b]", {"wiki"}),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("$x_{1} + y^2$", {"latex"}), ("\\[ E = \\sum_i x \\]", {"latex"}), ("f(x) = \\sqrt{x^{8}}", {"latex"}), ("$$\\int_0^1 g$$", {"latex"}),
    ("<b>x</b> **y** [[z]] \\emph{w}", {"html", "markdown", "wiki", "latex"}),
    (None, set()), ("", set()), ("слово " * 50_000, set()),
]


def test_markup_languages(spark: SparkSession) -> None:
    rows = [(i, 0, "s" if i % 2 else None, None, None, t) for i, (t, _) in enumerate(MARKED)]
    got = defaultdict(set)
    for r in markup.markup_languages(articles(spark, rows, True)).collect():
        got[r["article_id"]].add(r["markup"])
    for i, (t, want) in enumerate(MARKED):
        assert got[i] == want, t
    assert markup.markup_languages(articles(spark, [])).count() == 0


def test_clean_text(spark: SparkSession) -> None:
    assert markup.clean_text("<h2>A</h2><p>x &amp; <b>y</b></p><ul><li>i</li></ul>") == "## A\n\nx & y\n\n- i"
    assert markup.clean_text("== A ==\n[[b|c]] '''d'''") == "## A\nc d"
    assert markup.clean_text("**a** [b](https://c)\n```py\nx = **1**\n```") == "a b\n\n```\nx = **1**\n```"
    assert markup.clean_text("\\section{A}\nсм. $x_{1}$ \\emph{b}") == "# A\n\nсм. $x_{1}$ b"
    assert markup.clean_text("a < b") == "a < b" and markup.clean_text(None) is None and markup.clean_text("") == ""
    rows = [(1, 0, None, None, None, None), (2, 0, None, None, None, "<b>x</b>")]
    assert {r["article_id"]: r["text"] for r in markup.clean_texts(articles(spark, rows, True)).collect()} == {1: None, 2: "x"}


def test_clean_texts_by_winning_paths(spark: SparkSession) -> None:
    texts = [("m", "**a** b\n* один\n+ два\n> цитата\n# Глава")] * 3 + [("m", "* три\n> слова"), ("p", "* три\n> слова\n# пункт"), (None, "* три")]
    texts += [("w", "[[ссылка]]\n# пункт\n## ещё")] * 3 + [("w", "# пункт")]
    got = {r["article_id"]: r["text"] for r in markup.clean_texts(articles(spark, [(i, 0, h, None, None, t) for i, (h, t) in enumerate(texts)], True)).collect()}
    assert got[0] == "a b\n- один\n- два\nцитата\n# Глава" and got[3] == "- три\nслова"
    assert got[4] == "* три\n> слова\n# пункт" and got[5] == "* три"
    assert got[6] == "ссылка\n- пункт\n- ещё" and got[9] == "- пункт"


def page(body: str, top: str = "Меню сайта", bottom: str = "Все права защищены") -> str:
    return f"<html><body><header>{top}</header><main><h1>T</h1>{body}</main><footer>{bottom}</footer></body></html>"


def test_pages_by_voted_container(spark: SparkSession) -> None:
    rows = [(f"u{i}", bytearray(page(f"<p>{'длинный текст статьи ' * 5}{i}</p>").encode()), "s") for i in range(4)] + [("v", None, "s"), ("w", bytearray(b""), "s")]
    got = {r["url"]: (r["path"], r["text"]) for r in markup.extract_pages(spark.createDataFrame(rows, "url string, html binary, source string")).collect()}
    assert got["u0"][0] == "html/body/main" and "Меню" not in got["u0"][1] and "статьи" in got["u0"][1]
    assert got["v"][1] is None and got["w"][1] == ""


def test_template_lines(spark: SparkSession) -> None:
    rnd = random.Random(9)
    rows, saved = [], []
    for i in range(60):
        own = [" ".join(prose(rnd, 14)).capitalize() + "." for _ in range(3)]
        menu, note, by = "Главная | Новости | Форум", f"Просмотры: {rnd.randrange(9999)}", f"Автор: {rnd.choice(WORDS)}"
        lines = [menu, *own[:2], note, own[2], "", by, "© 2020 Сайт. Все права защищены"]
        url = f"http://s/{i}"
        rows.append((i, 0, "s", url, None, "\n".join(lines)))
        if i % 2:
            saved.append((url, bytearray(page("".join(f"<p>{x}</p>" for x in own), f"{menu}</header><header>{note}</header><header>{by}", lines[-1]).encode()), "s"))
    rows += [(100, 0, "s", None, None, None), (101, 0, None, None, None, ""), (102, 0, "s", None, "Главная новость дня", "Главная новость дня\n" + " ".join(prose(rnd, 20)) + ".")]
    pages = spark.createDataFrame(saved, "url string, html binary, source string")
    found = defaultdict(set)
    df = articles(spark, rows, True)
    for r in templates.template_lines(df, pages).collect():
        found[r["article_id"]].add(r["line_no"])
    assert all(found[i] == {1, 4, 7, 8} for i in range(60))
    assert not found[100] and not found[101] and not found[102]
    texts = {r["article_id"]: r["text"] for r in templates.main_texts(df, pages).collect()}
    assert texts[100] is None and texts[0].count("\n") == 3
    without = templates.template_lines(df, pages.limit(0))
    assert (0, 1) in {tuple(r) for r in without.collect()}
    assert templates.template_lines(df.limit(0), pages).count() == 0


def test_recurrence_is_exact_among_many_lines(spark: SparkSession) -> None:
    names = ["".join(x) for x in itertools.product("абвгдежз", repeat=7)]
    rnd = random.Random(3)
    rnd.shuffle(names)
    own = [[f"строка {x}" for x in names[i * 11_000 : (i + 1) * 11_000]] for i in range(60)]  # 660,000 lines that stand once
    rows = [(i, 0, "s", None, None, "\n".join([*x, *["в четырёх записях"] * (i < 4), *["в пяти записях"] * 2 * (i < 5)])) for i, x in enumerate(own)]
    rows += [(0, 0, "s", None, None, rows[0][5]), (90, 0, "t", None, None, "один\nв четырёх записях")]  # the same record again; another host
    got = Counter(tuple(r) for r in templates.template_lines(articles(spark, rows), spark.createDataFrame([], "url string, html binary, source string")).collect())
    want = Counter((i, n) for i in range(5) for n in ((11_002, 11_003) if i < 4 else (11_001, 11_002)))
    assert got == want + Counter({(0, 11_002): 1, (0, 11_003): 1})


def test_share_of_a_host_decides_and_one_title_counts_once(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "url string, html binary, source string")
    rnd = random.Random(5)
    rows = [(i, 0, "s", None, f"Заголовок {i}", " ".join(prose(rnd, 9)) + "\nНаш канал в сети") for i in range(12)]
    rows += [(100 + i, 0, "s", None, "Статья", "строка одной статьи\nвторая строка") for i in range(12)]  # delivered again and again
    rows += [(200 + i, 0, "t", None, f"Т {i}", " ".join(prose(rnd, 9)) + ("\nредкая строка" if i < 5 else "")) for i in range(120)]  # 5 of 120
    got = {tuple(r) for r in templates.template_lines(articles(spark, rows), none).collect()}
    assert got == {(i, 2) for i in range(12)}


def test_long_lines_are_told_by_the_whole(spark: SparkSession) -> None:
    ends = "Условия пользования сайтом " * 6
    notice, alike = ends + "и файлы для всех " * 5 + ends, [ends + "и слово " * i + ends for i in range(8, 14)]
    keys = [set(templates.subtrees(x, "s", 0, 0, 1)[0]) for x in (notice, alike[0])]
    assert all(any(k[0] == c for k in keys[0] - keys[1]) for c in "FH")
    rows = [(i, 0, "s", None, None, f"{x}\n{notice}") for i, x in enumerate(alike)]
    got = templates.template_lines(articles(spark, rows), spark.createDataFrame([], "url string, html binary, source string")).collect()
    assert {tuple(r) for r in got} == {(i, 2) for i in range(6)}


TEXTS = ["", None, " ", "Hello  world\n\n it's 12345 — naïve ½ ² \x1c a\u00a0 b\t\tc", "слово " * 500, "a" * 5000, "ab" * 400 + "привет" * 300, "x" * 70_000 + " конец", "日本語テスト👩‍🔬🇺🇸", "don't WE'LL 'tis <|endoftext|>", "\n" * 300 + "z", "́a\u200bb\ufeff"]


def reference_encoder():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_reference(spark: SparkSession) -> None:
    enc = reference_encoder()
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab дом'1 2\n\tё.,—́Я½ \x1c") for _ in range(rnd.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit("x"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (enc.encode_ordinary(t) if t else []), repr(t)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_stream_settles_within_its_window() -> None:
    enc, t = reference_encoder(), bpe.transducer(bpe.vocabulary_path())
    rnd = random.Random(2)
    for alphabet in ("ab", "етоан", "aA1é"):
        text = "".join(rnd.choice(alphabet) for _ in range(3000))
        data = text.encode()
        taken = 0

        def chunks():
            nonlocal taken
            for i in range(0, len(data), 100):
                taken = i + 100
                yield data[i : i + 100]

        ids, bytes_out, behind = [], 0, 0
        for i in t.stream(chunks()):
            ids.append(i)
            bytes_out += len(t.tokens[i])
            if taken < len(data):
                behind = max(behind, taken - bytes_out)
        whole = [x for p in t.pattern.findall(text) for x in np.frombuffer(t.piece(p), "<i4").tolist()]
        assert whole == enc.encode_ordinary(text)
        if alphabet != "aA1é":
            assert ids == whole and behind <= 8 * t.lookahead


def test_stream_holds_a_bounded_window_of_hostile_strings() -> None:
    """Any length and any chunks: the same ids, and never more than the stated bytes held."""
    enc, t = reference_encoder(), bpe.transducer(bpe.vocabulary_path())
    rnd = random.Random(9)
    assert max(map(len, t.ranks)) <= t.lookahead < 2000
    parts = ["ing", "tion", "ация", "ение", "s", "the", "a", "ст", "о"]
    for text in ("a" * 20_000, "ab" * 9_000, "-=" * 9_000, "".join(rnd.choice(parts) for _ in range(6000)), "й" * 9_000, "0" * 20_000):
        want = enc.encode_ordinary(text)
        for piece_ids in (1, 700):
            ids: list[int] = []
            for piece in t.pattern.findall(text):
                data = piece.encode()
                stream = t.stream(data[j : j + piece_ids] for j in range(0, len(data), piece_ids))
                for i in stream:
                    ids.append(i)
                    own = stream.gi_frame.f_locals
                    assert len(own["held"]) <= 3 * t.lookahead and len(own["token_at"]) <= 3 * t.lookahead + 1
            assert ids == want


def test_decode_is_the_inverse() -> None:
    t = bpe.transducer(bpe.vocabulary_path())
    for x in TEXTS:
        if x:
            assert "".join(t.decode(np.frombuffer(t.encode(x), "<i4"))) == x
    half = t.ranks["п".encode()[:1]]
    assert "".join(t.decode([half])) == "�"


def brute_containers(sizes: list[int], capacity: int) -> int:
    best = len(sizes)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_packing_against_brute_force() -> None:
    rnd = random.Random(3)
    extra = 0
    for _ in range(60):
        sizes = [rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 9))]
        at = packing.pack(np.array(sizes), 100)
        sums = np.bincount(at, weights=sizes)
        assert sums.max() <= 100 and (sums > 0).all()
        extra += len(sums) - brute_containers(sizes, 100)
    assert extra <= 3


def test_differencing_is_near_equal() -> None:
    sizes = np.random.default_rng(1).integers(1, 1000, 400)
    sums = np.bincount(packing.difference(sizes, 20), weights=sizes, minlength=20)
    assert sums.max() - sums.min() <= 5 and sums.sum() == sizes.sum()


def test_packed_documents(spark: SparkSession) -> None:
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(prose(rnd, rnd.randrange(1, 300))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("key", F.lit("x"))
    t = bpe.transducer(bpe.vocabulary_path())
    rows = packing.pack_documents(df.repartition(3), lot=40).collect()
    parts, room = defaultdict(dict), Counter()
    for r in rows:
        assert r["part_no"] not in parts[r["doc_id"]]
        parts[r["doc_id"]][r["part_no"]] = r["n_tokens"]
        room[r["container_id"]] += r["n_tokens"]
    for i, x in enumerate(texts):
        n = len(t.encode(x)) // 4
        assert sum(parts[i].values()) == n and len(parts[i]) == -(-n // 2048)
    assert max(room.values()) <= 2048 and sum(room.values()) / 2048 / len(room) > 0.9
    assert packing.pack_documents(df.limit(0)).count() == 0


def quality_rows() -> list[tuple[int, str | None, str | None]]:
    rnd = random.Random(6)
    out: list[tuple[int, str | None, str | None]] = []

    def add(kind: str | None, text: str | None) -> None:
        out.append((len(out), text, kind))

    verbs = "видит знает строит ищет берёт".split()
    for _ in range(160):
        add("prose", " ".join(f"{rnd.choice(WORDS).capitalize()} в этом году {rnd.choice(verbs)} {rnd.choice(WORDS)} и {rnd.choice(WORDS)}." for _ in range(rnd.randrange(2, 9))))
    for _ in range(60):
        add("list", "\n".join(f"{rnd.choice('•-*')} {rnd.choice(WORDS)} {rnd.choice(WORDS)}" for _ in range(rnd.randrange(5, 15))))
        add("table", "\n".join("|".join(str(rnd.randrange(999)) for _ in range(4)) for _ in range(rnd.randrange(4, 12))))
        add("junk", "".join(rnd.choice("{}[]<>@#$%^&*_+=~|/ ") for _ in range(rnd.randrange(80, 300))))
    for t in (None, "", "  \n\u00a0", "a"):
        add(None, t)
    return out


def test_text_kinds_on_held_out_rows(spark: SparkSession) -> None:
    rows = quality_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").withColumn("kind", F.lit("x")).withColumn("key", F.lit("x"))
    labels = spark.createDataFrame([(i, a, k) for i, _, k in rows if k and i % 5 == 0 for a in "ab"] + [(0, "c", "junk"), (5, "d", None)], "doc_id bigint, annotator string, kind string")
    got = {r["doc_id"]: r for r in text_quality.text_kinds(df, labels).collect()}
    held = [(i, k) for i, _, k in rows if k and i % 5]
    assert sum(got[i]["kind"] == k for i, k in held) / len(held) > 0.95
    blank = [i for i, t, _ in rows if t is None or not t.strip()]
    assert not set(blank) & set(got)
    some = got[0]
    assert some["words"] > 0 and 0 <= some["symbol_share"] <= 1 and 0 <= some["punctuated_lines"] <= 1 and 0 <= some["common_words"] <= 1
    assert text_quality.text_kinds(df.limit(0), labels).count() == 0


def test_held_out_documents_are_neither_trained_nor_calibrated_on(spark: SparkSession) -> None:
    rows = quality_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "a", k) for i, _, k in rows if k and i % 2 == 0], "doc_id bigint, annotator string, kind string")
    report = text_quality.held_out_report(df, labels).collect()
    n = sum(r["documents"] for r in report)
    assert 20 < n < 80 and sum(r["documents"] for r in report if r["kind"] == r["said"]) > 0.95 * n
    # Wrong labels cannot teach the trees: labelled documents are out of the training sample.
    wrong = labels.withColumn("kind", F.lit("junk"))
    model, _, _ = text_quality._fitted(text_quality._statistics_table(df, "doc_id", "text"), wrong, "doc_id", 8000, 5000)
    assert model.trees
    assert text_quality.held_out_report(df, labels.limit(0)).count() == 0


def test_statistics_without_numpy_wrappers() -> None:
    """Values equal plain definitions, and no mean, deviation or median of numpy runs for each document."""
    rnd, signs = random.Random(10), "aBк1.!?… \n\r\t\u2028\x85\u00a0|;,\"#(0xdeadbeef’-\ufffd😀İ"
    texts = ["".join(rnd.choice(signs) if rnd.random() < 0.8 else rnd.choice(("0xdeadbeef", "00deadbeef00", "slow.  Er", "aBaB")) for _ in range(rnd.choice((1, 3, 20, 200)))) for _ in range(2000)]
    pairs, wrapped, made = np.random.default_rng(1).normal(-6, 2, (text_quality._CLASSES, text_quality._CLASSES)), [], []

    def seen(frame, event, arg) -> None:
        if event == "call" and "numpy" in frame.f_code.co_filename and frame.f_code.co_name in ("_mean", "_std", "_var", "median"):
            wrapped.append(frame.f_code.co_name)

    texts = [t for t in texts if t.strip()]
    text_quality.statistics("warm", set(), pairs)
    sys.setprofile(seen)
    try:
        made = [text_quality.statistics(t, {"a"}, pairs) for t in texts]
    finally:
        sys.setprofile(None)
    assert not wrapped
    for text, own in zip(texts, made):
        lines = [x.strip("\r ") for x in text.split("\n") if x.strip()]
        sizes, lengths, codes = np.array([len(x) for x in lines], float), np.array([len(w) for w in text_quality._WORD.findall(text)] or [0], float), np.array([ord(c) for c in text])
        sentences = [x.strip() for x in re.split(r"(?<=[.!?…])\s+|\n+", text) if x.strip()]
        plain = {
            "mean_word_length": lengths.mean(), "word_spread": lengths.std(), "single_letters": (lengths == 1).mean(), "short_lines": (sizes < 60).mean(), "line_spread": sizes.std() / (sizes.mean() + 1),
            "line_words": np.median([len(x.split()) for x in lines]), "distinct_sentences": len(set(sentences)) / max(1, len(sentences)), "latin1": ((codes >= 0x80) & (codes < 0x100)).mean(), "controls": ((codes >= 0x7F) & (codes < 0xA0)).mean(),
            "longest_word": np.log1p(max(map(len, text.split()), default=0)),
        }
        assert {k: own[text_quality._AT[k]] for k in plain} == plain
        parts = [x.split() for x in lines]
        assert text_quality._hex_runs(parts, "0x" in text) == len(text_quality._HEX.findall(text))


@pytest.mark.parametrize("line", ["Конец.", "конец", "Он сказал «да».", "so (see p. 3).", "x. #tag #other", "a; b", "wait... ", "one. two, three", "1. Punkt", "Ende?)", "«Да!» — сказал", ""])
def test_sentence_ends_are_those_of_the_pattern(line: str) -> None:
    assert text_quality._ends_sentence(line) == (text_quality._SENTENCE_END.search(line) is not None)


def test_majority_of_labels(spark: SparkSession) -> None:
    rows = [(1, "a", "list"), (1, "a", "list"), (1, "b", "prose"), (2, "a", "junk"), (2, "b", "junk"), (2, "c", "prose"), (3, "a", None)]
    got = text_quality.majority(spark.createDataFrame(rows, "doc_id bigint, annotator string, kind string"))
    assert [tuple(r) for r in got.collect()] == [(2, "junk")]


def test_trees_learn_and_calibrate() -> None:
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(900, 5))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0)
    model = text_quality.Trees(rounds=40).fit(x[:600], y[:600], 4)
    assert (model.score(x[600:]).argmax(axis=1) == y[600:]).mean() > 0.85
    scale = text_quality.Calibration(4).fit(model.score(x[600:750]), y[600:750])
    p = scale.probabilities(model.score(x[750:]))
    assert np.allclose(p.sum(axis=1), 1) and -np.log(p[np.arange(150), y[750:]]).mean() < 0.7


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark: SparkSession, data: str, name: str) -> None:
    same(queries.queries()[name](spark, data), connect(data), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark: SparkSession, data: str, name: str) -> None:
    assert queries.queries()[name](spark, data).count() > 0
