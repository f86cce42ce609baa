"""Markup residue in texts: which languages a text holds, and the clean text that keeps headings, lists, code and formulas.

Every construct of a text is a container with a generalised path: language, tag or construct, class with digits masked. It scores
`WHOLE` when it is well formed, `DAMAGED` when only its own mark can be seen, and `WEAK` when plain text has such signs too. All
containers are put to a vote of their host: the records that hold a path add their scores. A path that is never more than weak needs many
records and the company of others of its language; any other wins with one score of DAMAGED. Texts are then read again by their
host's winning paths alone: the languages found are those of their winning containers, and only what won is rewritten. Saved pages vote
in the same way on the tag-class path of the container that holds the article, and are extracted again by the winner.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane import runtime

WHOLE, DAMAGED, WEAK = 3, 2, 1
#: Records of a host that must hold a weak path, at least, and their share of the host's records.
VOTES, SHARE = 3, 0.002
#: Hosts whose winners (a short list of kinds each) are sent to all tasks; beyond, they meet the texts in a join, each host's in so many parts.
HOSTS_SENT, SALTS = 20_000, 16

# Element names of HTML.
_TAGS = (
    "a abbr article aside audio b blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta "
    "nav noscript object ol option p picture pre q s samp script section select small source span strike strong style sub summary sup "
    "svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
# Commands of LaTeX that stand without an argument in braces.
_COMMANDS = (
    "item alpha beta gamma delta epsilon varepsilon zeta eta theta lambda mu nu xi pi rho sigma tau phi varphi chi psi omega Gamma Delta "
    "Theta Lambda Pi Sigma Phi Psi Omega le leq ge geq ne neq approx equiv times cdot cdots ldots dots infty partial nabla sum prod int "
    "iint oint lim left right in notin subset cup cap forall exists to rightarrow Rightarrow leftarrow mapsto quad qquad hline newpage "
    "maketitle tableofcontents centering noindent bf it em tt sc small large Large par textbackslash LaTeX TeX"
).split()

_SP = r"(?:\s|&nbsp;|&#160;)"
_TAG = rf"</?(?P<tag>{'|'.join(_TAGS)})(?P<rest>{_SP}[^<>]*|/)?>"
_RULES: tuple[tuple[str, str, int, str], ...] = (
    ("html", "tag", WHOLE, rf"(?i:{_TAG})"),
    ("html", "cut", DAMAGED, rf"(?i:</?(?:{'|'.join(_TAGS)})(?:{_SP}+[\w:-]+{_SP}*=[^<>\n]*|{_SP}*/?)(?=$|<|\r|\n))"),
    ("html", "cut", DAMAGED, r"(?i:</(?:[a-z][a-z0-9]{0,11})>|<[a-z][a-z0-9]{0,11}\s+(?:class|href|src|style|id|alt|rel)\s*=)"),
    ("html", "comment", WHOLE, r"<!--.*?-->"),
    ("html", "comment", DAMAGED, r"<!--|-->|<!DOCTYPE|<!\[CDATA\["),
    ("html", "entity", WHOLE, r"&(?:[A-Za-z][A-Za-z0-9]{1,9}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("markdown", "fence", WHOLE, r"^[ \t]*(?:```|~~~)[\w+#.-]*[ \t]*\r?$"),
    ("markdown", "image", WHOLE, r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("markdown", "link", WHOLE, r"(?<!!)\[[^\]\n]+\]\((?:https?:|/|#|mailto:)[^)\n]*\)"),
    ("markdown", "link", DAMAGED, r"\]\((?:https?:|/)|!\[[^\]\n]+\]"),
    ("markdown", "strong", WHOLE, r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])"),
    ("markdown", "strong", DAMAGED, r"\*\*(?=[^\W\d_])|(?<=[^\W\d_])\*\*"),
    ("markdown", "strike", WHOLE, r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    ("markdown", "strike", DAMAGED, r"~~(?=[^\W\d_])|(?<=[^\W\d_])~~"),
    ("markdown", "code", WHOLE, r"(?<!`)`(?!`)[^`\n]+`(?!`)"),
    ("markdown", "code", DAMAGED, r"(?<![`\w])`(?=\w)|(?<=\w)`(?![`\w])|```"),
    ("markdown", "heading", WHOLE, r"^#{2,6}[ \t]+(?!\[\[)\S"),
    ("markdown", "heading", WHOLE, r"^#[ \t]+[^\W\d_][^\n]*[^\s;,]\r?$"),
    ("markdown", "heading", WEAK, r"^#[ \t]+(?!\[\[)\S"),
    ("markdown", "setext", WHOLE, r"(?<=\S\n)(?:={3,}|-{3,})[ \t]*\r?$|(?<=\S\r\n)(?:={3,}|-{3,})[ \t]*\r?$"),
    ("markdown", "table", WHOLE, r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t|:-]*\r?$"),
    ("markdown", "quote", WEAK, r"^>[ \t]+\S"),
    ("markdown", "list", WHOLE, r"(?:^[ \t]*- +[^\n]*[^\s.;,:!?][ \t]*\r?\n){1,}[ \t]*- +\S"),
    ("markdown", "list", WEAK, r"^[ \t]*[-+*] +(?!\[\[)\w"),
    ("wiki", "link", WHOLE, r"\[\[[^\[\]\n]+\]\]"),
    ("wiki", "link", DAMAGED, r"\[\[(?=\w)|(?<=\w)\]\]"),
    ("wiki", "template", WHOLE, r"\{\{[^{}\n]+\}\}"),
    ("wiki", "template", DAMAGED, r"(?<![\\{^_\w}])\{\{(?=\w)"),
    ("wiki", "quotes", WHOLE, r"'''?(?=\S)[^'\n]+'''?"),
    ("wiki", "quotes", DAMAGED, r"'''"),
    ("wiki", "heading", WHOLE, r"^={2,6}[ \t]*[^=\s][^\n]*?={1,6}[ \t]*\r?$"),
    ("wiki", "heading", DAMAGED, r"^={2,6}[ \t]*[^\W\d_]"),
    ("wiki", "table", WHOLE, r"^\{\||^\|\}|^\|-[ \t]*\r?$"),
    ("wiki", "external", WHOLE, r"(?<!\[)\[https?://[^\s\]]+[ \t][^\]\n]+\]"),
    ("wiki", "external", DAMAGED, r"(?<![\[(])\[https?://"),
    ("wiki", "reference", WHOLE, r"<ref\b[^>]*>|</ref>|<nowiki|__(?:TOC|NOTOC|FORCETOC)__"),
    ("latex", "command", WHOLE, r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    ("latex", "command", WHOLE, rf"\\(?:{'|'.join(_COMMANDS)})(?![A-Za-z])"),
    ("latex", "group", WHOLE, r"\{\\[a-z]{2,}[ \t]"),
    ("latex", "display", WHOLE, r"\\\[.+?\\\]|\\\(.+?\\\)|\$\$[^$\n]+\$\$"),
    ("latex", "display", DAMAGED, r"\\\[|\\\]|\$\$(?=\S)"),
    ("latex", "inline", WHOLE, r"(?<![\\$\w])\$(?=[^\s$])[^$\n\\^_{]*+[\\^_{][^$\n]*+\$(?![\d$])"),
)
_ONE = tuple((language, what, score, re.compile(pattern, re.MULTILINE)) for language, what, score, pattern in _RULES)
#: A character that each rule needs: most texts have few of them, so most rules are never tried.
_NEEDS = {"html": "<&-", "markdown": "`*_~[#=-|>!+", "wiki": "[]{}'=|<_", "latex": "\\$"}
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)


def containers(text: str | None) -> dict[tuple[str, str], int]:
    """(language, generalised path) of each construct in a text, with its best score; none for a null or empty text."""
    found: dict[tuple[str, str], int] = {}
    if not text:
        return found
    for language, what, score, pattern in _ONE:
        if found.get((language, what), 0) >= score or not any(c in text for c in _NEEDS[language]):
            continue
        m = pattern.search(text)
        if m is None:
            continue
        path = what
        if what == "tag":
            css = _CLASS.search(m["rest"] or "")
            path = "tag/" + m["tag"].lower() + ("." + re.sub(r"\d+", "0", css[1].lower()) if css else "")
        found[language, path] = max(found.get((language, path), 0), score)
    return found


_OF_BOTH = (("markdown", "heading"), ("markdown", "list"))
_ENTRY = re.compile(r"^#[ \t]+(?!\[\[)\S", re.MULTILINE)


def _sure_of(found: dict[tuple[str, str], int], language: str) -> bool:
    """Whether a text holds a sure construct of a language, other than the headings and lists whose signs Markdown and wiki share."""
    return any(p[0] == language and score > WEAK and p not in _OF_BOTH for p, score in found.items())


def _rewritten(text: str | None) -> dict[tuple[str, str], int]:
    """`containers`, and the weak path of wiki's numbered entries where nothing says that the text is Markdown."""
    found = containers(text)
    if found and not _sure_of(found, "markdown") and _ENTRY.search(text or ""):
        found["wiki", "entry"] = WEAK
    return found


def _votes(df: DataFrame, key: str, host: str, text: str, paths: Callable[[str | None], dict[tuple[str, str], int]] = containers) -> DataFrame:
    """(key, host, markup, path, score): a row for each container path of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, h, language, path, score) for k, h, x in zip(b["key"], b["host"], b["text"]) for (language, path), score in paths(x).items()]
            yield pd.DataFrame(rows, columns=["key", "host", "markup", "path", "score"])

    kind = dict(df.dtypes)[key]
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, host string, markup string, path string, score int")


def _winners(votes_table: DataFrame, df: DataFrame, host: str, text: str, votes: int, share: float) -> DataFrame:
    """(w_host, w_markup, w_path): paths that win their host's vote; see `markup_languages`. Pre-aggregated to a row for each host and path."""
    sure = votes_table.where(F.col("score") > WEAK).select("key", "markup").distinct()
    held = votes_table.groupBy("host", "markup", "path").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sum("score").alias("score"))
    weak = votes_table.where(F.col("score") == WEAK).join(sure, ["key", "markup"], "left_semi").groupBy("host", "markup", "path").agg(F.count(F.lit(1)).alias("backed"))
    at = [F.col("host").eqNullSafe(F.col("b_host")), F.col("markup") == F.col("b_markup"), F.col("path") == F.col("b_path")]
    tally = held.join(weak.select(*(F.col(c).alias(f"b_{c}") for c in ("host", "markup", "path")), "backed"), at, "left")
    totals = df.where(F.length(text) > 0).groupBy(F.col(host).alias("t_host")).agg(F.count(F.lit(1)).alias("records"))
    enough = (F.col("n") >= votes) & (F.col("n") >= share * F.col("records")) & (2 * F.coalesce("backed", F.lit(0)) >= F.col("n"))
    won = F.when(F.col("best") > WEAK, F.col("score") >= DAMAGED).otherwise(enough)
    return tally.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(won).select(F.col("host").alias("w_host"), F.col("markup").alias("w_markup"), F.col("path").alias("w_path"))


def markup_languages(df: DataFrame, key: str = "article_id", host: str = "source", text: str = "text", votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(key, markup): each record and language of which its text holds at least one construct, whole or damaged, on a path that wins
    its host's vote.

    A path that some record of the host has more than weakly wins with a score of DAMAGED in all; one that is only weak needs
    `votes` records and `share` of the host's records with text, and at least half of those must hold a sure construct of that language
    too. Null and empty texts hold nothing; records without host vote together; repeated rows give one row per key; an empty table gives
    none; further columns are not read. The vote is pre-aggregated to one row per host and path, so a host with a third of all rows sends
    a few rows from each task.
    """
    votes_table = runtime.written(_votes(df, key, host, text), "markup-votes")
    won = runtime.written(_winners(votes_table, df, host, text, votes, share), "winning-paths")
    at = F.col("host").eqNullSafe(F.col("w_host")) & (F.col("markup") == F.col("w_markup")) & (F.col("path") == F.col("w_path"))
    return votes_table.join(won, at, "left_semi").select("key", "markup").distinct().withColumnRenamed("key", key)


_BLOCKS = re.compile(r"(?i)</?(?:p|div|tr|ul|ol|dl|table|tbody|thead|section|article|header|footer|main|aside|nav|figure|blockquote|form)\b[^<>]*>")
_CODE = re.compile(r"(?is)<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>|^```[^\n]*\n(.*?)^```[ \t]*\r?$|\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", re.MULTILINE)
_FORMULA = re.compile(r"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|gather|displaymath)(\*?)\}.*?\\end\{\1\2\}|(?<![\\$\w])\$(?=[^\s$])[^$\n\\^_{]*+[\\^_{][^$\n]*+\$(?![\d$])")


def _without_html(t: str) -> str:
    t = re.sub(r"(?s)<!--.*?(?:-->|$)|(?i:<(script|style)\b.*?</\1>)", "", t)
    t = re.sub(r"(?i)&amp;(?=(?:[a-z]{2,8}|#\d+);)", "&", t)
    t = re.sub(r"(?i)&lt;(/?(?:" + "|".join(_TAGS) + r")\b[^&<>]*)&gt;", r"<\1>", t)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = re.sub(r"(?is)<h([1-6])\b[^<>]*>(.*?)</h\1>", lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n", t)
    t = re.sub(r"(?i)<li\b[^<>]*>", "\n- ", t)
    t = re.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t)
    t = _BLOCKS.sub("\n", t)
    return re.sub(rf"(?i){_TAG}|</?(?:{'|'.join(_TAGS)})\b[^<>\n]*(?=<|$|\n)", "", t, flags=re.MULTILINE)


def _without_wiki(t: str, read: set[str]) -> str:
    if "heading" in read:
        t = re.sub(r"(?m)^(={2,6})[ \t]*([^=\n]+?)[ \t]*=*[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t)
    if "link" in read:
        t = re.sub(r"(?m)^[*#]+[ \t]*(?=\[\[)", "- ", t)
        t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", lambda m: "" if re.match(r"(?i)(?:категория|category|kategorie|файл|file|datei):", m[1]) else m[1], t)
    if "external" in read:
        t = re.sub(r"(?<!\[)\[https?://\S+[ \t]+([^\]\n]+)\]", r"\1", t)
    if "template" in read:
        t = re.sub(r"\{\{[^{}\n]*\}\}", "", t)
    if "table" in read:
        t = re.sub(r"(?m)^\{\|.*$|^\|\}.*$|^\|-.*$", "", t)
        t = re.sub(r"(?m)^[!|][ \t]*(?=\S)(.*(?:!!|\|\|).*)$", lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m[1]), t)
    return re.sub(r"'{2,3}", "", t) if "quotes" in read else t


def _without_markdown(t: str, read: set[str]) -> str:
    if "setext" in read:
        t = re.sub(r"(?m)^([^\n]+)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t)
    if read & {"image", "link"}:
        t = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)?", r"\1", t)
        t = re.sub(r"\[([^\]\n]+)\]\((?:https?:|/|#|mailto:)[^)\n]*\)?", r"\1", t)
    if "strong" in read:
        t = re.sub(r"\*\*|(?<!\w)__(?=[^\s_])|(?<=[^\s_])__(?!\w)", "", t)
    if "strike" in read:
        t = t.replace("~~", "")
    if "table" in read:
        t = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t|:-]*$", "", t)
    return re.sub(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", r"\1", t) if "code" in read else t


def _without_latex(t: str) -> str:
    t = re.sub(r"\\(sub)*section\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * (1 + m[0].count("sub")) + " " + m[2] + "\n", t)
    t = re.sub(r"(?m)^[ \t]*\\item[ \t]*", "- ", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}|\\(?:cite|ref|label|footnote)\w*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", t)
    t = re.sub(r"\\[A-Za-z]{2,}\*?\{([^{}\n]*)\}", r"\1", t)
    return re.sub(r"\{\\[a-z]{2,}[ \t]+([^{}\n]*)\}", r"\1", t)


def _kind(path: tuple[str, str]) -> tuple[str, str]:
    """A path without what it says of tag and class: there are as many as rules."""
    return path[0], path[1].partition("/")[0]


def clean_text(text: str | None, won: frozenset[tuple[str, str]] | None = None) -> str | None:
    """The text without markup: headings as `# `, entries as `- `, code between fences, formulas between dollars; links and emphasis
    leave their words. Null stays null, empty stays empty; a text without markup is returned as it is. won: kinds of path that win the vote
    of the text's host; only those of them that the text holds are rewritten. None: all that the text holds and that are more than weak."""
    if not text or not (found := containers(text)):
        return text
    read = {_kind(p) for p, score in found.items() if (score > WEAK if won is None else _kind(p) in won)}
    if won is None:
        won = frozenset(read)
    if ("wiki", "entry") in won:
        read.add(("wiki", "entry"))
    if not read:
        return text
    of = {language for language, _ in read}
    kept: list[str] = []

    def keep(block: str) -> str:
        kept.append(block)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match[str]) -> str:
        body = next((x for x in m.groups() if x is not None), "")
        return "\n" + keep("```\n" + html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body)).strip("\r\n") + "\n```") + "\n"

    def formula(m: re.Match[str]) -> str:
        body = re.sub(r"^(?:\$\$?|\\\[|\\\(|\\begin\{\w+\*?\})|(?:\$\$?|\\\]|\\\)|\\end\{\w+\*?\})$", "", m[0].strip()).strip()
        return keep(f"${body}$")

    t = text.replace("\r\n", "\n")
    if of & {"html", "latex"} or ("markdown", "fence") in read:
        t = _CODE.sub(code, t)
    if "latex" in of:
        t = _FORMULA.sub(formula, t)
    if "html" in of or ("wiki", "reference") in read:
        t = _without_html(t)
    if ("markdown", "quote") in read:
        t = re.sub(r"(?m)^(?:>[ \t]+)+(?=\S)|^>[ \t]*$", "", t)
    if ("wiki", "entry") in read and not _sure_of(found, "markdown"):
        t = re.sub(r"(?m)^#{1,6}[ \t]+(?=\S)" if _sure_of(found, "wiki") else r"(?m)^#[ \t]+(?=\S)", "- ", t)
    if ("markdown", "list") in read:
        t = re.sub(r"(?m)^([ \t]*)(?:\*{1,6}|\+) +(?![*+\- \t]+$)(?=\S)", r"\1- ", t)
    if "wiki" in of:
        t = _without_wiki(t, {what for language, what in read if language == "wiki"})
    if "markdown" in of:
        t = _without_markdown(t, {what for language, what in read if language == "markdown"})
    if "latex" in of:
        t = _without_latex(t)
    if "html" in of:
        t = html.unescape(t).replace("\xa0", " ")
    t = re.sub(r"[ \t]+$", "", t, flags=re.MULTILINE)
    t = re.sub(r"\n{3,}", "\n\n", t).strip("\n")
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)


def clean_texts(df: DataFrame, key: str = "article_id", text: str = "text", host: str = "source", votes: int = VOTES, share: float = SHARE) -> DataFrame:
    """(key, text): every record with its clean text, read by the weak paths that win its host's vote; null stays null.

    The vote is that of `markup_languages`, with the path of numbered wiki entries added. Records without host vote together. The winners
    are a row for each host; no task gets all texts of one.
    """
    won = _winners(runtime.written(_votes(df, key, host, text, _rewritten), "text-votes"), df, host, text, votes, share)
    kinds = F.collect_set(F.concat_ws("/", "w_markup", F.substring_index("w_path", "/", 1)))
    of_host = runtime.written(won.groupBy("w_host").agg(kinds.alias("won")), "winners-of-host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [frozenset(tuple(p.split("/", 1)) for p in w) if w is not None else frozenset() for w in b["won"]]
            yield pd.DataFrame({"key": b["key"], "text": pd.Series([clean_text(x, w) for x, w in zip(b["text"], own)], index=b.index, dtype=object)})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(host).alias("host"))
    at = F.col("host").eqNullSafe(F.col("w_host"))
    if of_host.count() <= HOSTS_SENT:
        joined = rows.join(F.broadcast(of_host), at, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        joined = salted.join(of_host.withColumn("w_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), at & (F.col("salt") == F.col("w_salt")), "left")
    return joined.select("key", "text", "won").mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


_ASIDE = re.compile(r"(?:a|nav|header|footer|aside|button|form)(?:[#.]|$)")
_INNER = re.compile(r"(?:p|h\d|li|ul|ol|td|th|tr|tbody|table|code|pre|b|i|em|strong|span)(?:[#.]|$)")


class _Tree(HTMLParser):
    """Containers of a page: path of tags and classes, and the text and link text inside."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.parts: list[tuple[str, str, str]] = []  # (path, tag, text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            return
        own = dict(attrs)
        name = tag + ("#" + re.sub(r"\d+", "0", own["id"]) if own.get("id") else "") + ("." + re.sub(r"\d+", "0", own["class"].split()[0]) if (own.get("class") or "").split() else "")
        if tag in ("p", "li", "td", "tr") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        self.open.append((tag, name))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(t in ("script", "style", "title") for t, _ in self.open):
            self.parts.append(("/".join(n for _, n in self.open), self.open[-1][0] if self.open else "", data))


def page_text(data: object) -> str | None:
    """A page's characters: bytes as UTF-8, or as windows-1251 where they are no UTF-8."""
    if data is None or isinstance(data, str):
        return data
    raw = bytes(data)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("windows-1251", "replace")


def best_of(tree: _Tree) -> str | None:
    """Path of the container with the best score, the deepest of them: characters of its paragraphs, less those in links, headers,
    footers and navigation."""
    scores: dict[str, float] = {}
    for path, _, text in tree.parts:
        names = path.split("/")
        aside = any(_ASIDE.match(n) for n in names)
        gain = -2.0 * len(text) if aside else float(len(text))
        for i in range(1, len(names) + 1):
            prefix = "/".join(names[:i])
            scores[prefix] = scores.get(prefix, 0.0) + gain
    scores = {p: s for p, s in scores.items() if s > 0 and not _INNER.match(p.rsplit("/", 1)[-1])}
    return max(scores, key=lambda p: (scores[p], p.count("/"), p)) if scores else None


def best_container(page: str | None) -> str | None:
    """Path of the container that holds a page's article; None for a null or empty page."""
    if not page:
        return None
    tree = _Tree()
    tree.feed(page)
    return best_of(tree)


def extract_container(page: str | None, path: str | None) -> str | None:
    """Text of a page inside a container path, a line for each block; of its own best container where the page lacks that path."""
    if page is None:
        return None
    tree = _Tree()
    tree.feed(page)
    inside = [(p, t) for p, _, t in tree.parts if path and (p == path or p.startswith(path + "/"))]
    if not inside:
        own = best_of(tree)
        inside = [(p, t) for p, _, t in tree.parts if own and (p == own or p.startswith(own + "/"))]
    return "\n".join(x for x in (re.sub(r"[^\S\n]+", " ", t).strip() for _, t in inside) if x)


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html", host: str = "source") -> DataFrame:
    """(url, path, text): each saved page's article, by the container path that wins its host's vote.

    Every page names the path of its best container; the path that most pages of a host name wins (ties: the first in order). Pages
    without it are read by their own best container. Null and empty pages vote for nothing and give null and empty text; bytes are
    read as UTF-8, or as windows-1251 where they are no UTF-8; repeated pages give repeated rows.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "path": [best_container(page_text(x)) for x in b["page"]]}).dropna(subset=["path"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "path": b["path"], "text": [extract_container(page_text(x), p) for x, p in zip(b["page"], b["path"])]})

    rows = pages.select(F.col(url).alias("url"), F.col(page).alias("page"), F.col(host).alias("host"))
    votes = rows.where(F.octet_length("page") > 0).select("host", "page").mapInPandas(vote, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    winners = votes.groupBy(F.col("host").alias("w_host")).agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path"))
    kind = dict(pages.dtypes)[url]
    return rows.join(winners, F.col("host").eqNullSafe(F.col("w_host")), "left").select("url", "page", "path").mapInPandas(read, f"url {kind}, path string, text string").withColumnRenamed("url", url)
