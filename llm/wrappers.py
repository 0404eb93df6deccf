"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tags and texts. Its expression has a group for each block element, named by its tag and
classes, with a slot for the text of its own. Neighbouring groups of one name are folded into a repeated group. Expressions
of one host are aligned, one after the other: groups that match in order are merged, a group that one side lacks becomes
optional, texts that differ make the slot variable, and the characters in slots and links are added up. The result, one
expression per host, is the wrapper. The group that holds the article is chosen on the wrapper; a page's text is what the
slots of that group hold on the page.

Alignment happens within the input partition first, then among the partials of a host and salt, then among those of a host;
what is combined are expressions of a few hundred groups, never pages.

Defined results: a null, empty or tagless page gives its bare text; a null address is a host of its own; broken markup is
closed where the next block demands it, and a comment or script without an end reaches to the end of the page; elements below
`DEEPEST` levels count as part of the text around them; repeated rows each give a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import cut, look_up, plain

#: Levels of nesting that are told apart, groups of a group, salts of a host, hosts that a task aligns at once.
DEEPEST, WIDEST, SALTS, HOSTS = 60, 200, 32, 2000
#: Pages on which a text must be the same to be the template's.
FIXED = 3

# Fixed lists of element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
OUT = frozenset("head nav header footer aside form button select option dialog menu object audio video canvas map".split())
OUT_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
#: An element that opens ends an open one of the names given, up to the boundary names.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|\Z)""", re.S)
CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("name", "key", "out", "parts")

    def __init__(self, name: str, attributes: str = ""):
        marks = [m for found in CLASS.findall(attributes) for m in "".join(found).lower().split()] if attributes else []
        self.name, self.parts = name, []
        self.key = ".".join([name, *sorted({re.sub(r"[0-9]+", "#", m) for m in marks})])
        words = {w for m in marks for w in re.split(r"[-_]+", m)} if marks else ()
        self.out = name in OUT or bool(marks) and (not OUT_CLASS.isdisjoint(words) or not OUT_CLASS.isdisjoint(marks))


def parse(page: str) -> Node:
    """The page as a tree; parts of a node are texts, None for a break, and nodes."""
    root = Node("")
    stack, at = [root], 0
    closing: dict[str, re.Pattern] = {}
    while True:
        tag = TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        if not tag:
            return root
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not tag[1]:
                end = closing.setdefault(name, re.compile(rf"</{name}\b[^>]*>?", re.I)).search(page, at)
                at = end.end() if end else len(page)
        elif tag[1]:
            if name not in VOID and any(n.name == name for n in stack):
                while stack.pop().name != name:
                    pass
        elif name in VOID:
            stack[-1].parts.append(None if name in ("br", "hr") else "")
        else:
            ends, until = ENDS.get(name, ({"p"}, {"table", "article", "body"}) if name not in INLINE else ((), ()))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in until:
                    break
                if stack[depth].name in ends:
                    del stack[depth:]
                    break
            if len(stack) < DEEPEST:
                stack[-1].parts.append(node := Node(name, tag[3]))
                stack.append(node)
            elif name not in INLINE:
                stack[-1].parts.append(None)


def text_of(node: Node, within: bool = True) -> list[str]:
    """Pieces of text in page order without what stands outside the article; blocks and breaks are spaces."""
    out: list[str] = []
    for part in node.parts:
        if part is None:
            out.append(" ")
        elif isinstance(part, str):
            out.append(part)
        elif not part.out:
            block = part.name not in INLINE
            out += [" ", *text_of(part), " "] if block else text_of(part)
    return out


def joined(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def group(key: str, out: bool) -> dict:
    """A group of an expression: name, outside the article, pages, characters of text and of links, its constant text (a
    checksum; none yet: 0; variable: -1), optional, repeated, groups within."""
    return {"key": key, "out": out, "n": 1, "text": 0, "link": 0, "slot": 0, "opt": False, "rep": False, "in": []}


def expression(node: Node) -> dict:
    """The expression of one page; inline elements belong to the slot of the block around them."""
    made = group(node.key, node.out)
    pieces: list[str] = []

    def gather(parts: list, linked: bool) -> None:
        for part in parts:
            if isinstance(part, str):
                pieces.append(part)
                made["link"] += len(part) * linked
            elif part is None:
                pieces.append(" ")
            elif part.name in INLINE and not part.out:
                gather(part.parts, linked or part.name == "a")
            else:
                add(made["in"], expression(part))

    gather(node.parts, False)
    own = joined(pieces)
    made["text"], made["slot"] = len(own), zlib.crc32(own.encode("utf-8", "replace")) if own else 0
    return made


def add(groups: list[dict], new: dict) -> None:
    """Put a group behind others; one of the same name as the last makes that a repeated group."""
    if groups and groups[-1]["key"] == new["key"]:
        n = groups[-1]["n"]
        groups[-1] = merge(groups[-1], new) | {"n": n, "rep": True}
    elif len(groups) < WIDEST:
        groups.append(new)
    else:  # beyond that all is one variable group
        groups[-1] = merge(groups[-1], new | {"key": groups[-1]["key"]}) | {"n": groups[-1]["n"], "rep": True}


def merge(a: dict, b: dict) -> dict:
    """Two groups of one name aligned."""
    slot = a["slot"] if a["slot"] == b["slot"] or not b["slot"] else b["slot"] if not a["slot"] else -1
    return {
        "key": a["key"], "out": a["out"] and b["out"], "n": a["n"] + b["n"], "text": a["text"] + b["text"], "link": a["link"] + b["link"],
        "slot": slot, "opt": a["opt"] or b["opt"], "rep": a["rep"] or b["rep"], "in": align(a["in"], b["in"]),
    }


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Two runs of groups: the longest common run of names is merged, other groups become optional in their place."""
    if [x["key"] for x in a] == [x["key"] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["key"] == b[j]["key"] else max(best[i + 1][j], best[i][j + 1])
    out: list[dict] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["key"] == b[j]["key"]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"opt": True})
            i += 1
        else:
            out.append(b[j] | {"opt": True})
            j += 1
    folded: list[dict] = []
    for x in out:
        if len(folded) < 2 * WIDEST or folded[-1]["key"] == x["key"]:
            add(folded, x) if folded and folded[-1]["key"] == x["key"] else folded.append(x)
        else:
            folded[-1] = merge(folded[-1], x | {"key": folded[-1]["key"]})
    return folded


def weight(node: dict, fixed: float = FIXED) -> int:
    """Characters in slots of a group and those within that may belong to an article. Links don't count, nor does a text
    that is the same on all of `fixed` pages or more: that is the template's."""
    if node["out"]:
        return 0
    own = 0 if node["slot"] > 0 and node["n"] >= fixed else max(0, node["text"] - node["link"])
    return own + sum(weight(x, fixed) for x in node["in"])


def article_path(wrapper: dict) -> list[str]:
    """Names from the root to the group that holds the article: an article or main element that has most of the text, else
    down from the root as long as one group holds most of what is left."""
    fixed = FIXED if weight(wrapper) else float("inf")
    named: list[tuple[int, int, list[str]]] = []

    def look(node: dict, path: list[str]) -> None:
        for x in node["in"]:
            if not x["out"]:
                here = [*path, x["key"]]
                if x["key"].split(".")[0] in ("article", "main") or "main" in x["key"].split(".")[1:]:
                    named.append((weight(x, fixed), -len(here), here))
                look(x, here)

    look(wrapper, [])
    if named:
        most = max(named)[0]
        return min((x for x in named if 2 * x[0] >= most), key=lambda x: (not x[2][-1].startswith("article"), x[1] if x[2][-1].startswith("article") else -x[1]))[2]
    path, node = [], wrapper
    while True:
        parts = [x for x in node["in"] if x["key"].split(".")[0] not in ("p", "li", "td", "tr", "h1", "h2", "h3", "blockquote", "pre")]
        best = max(parts, key=lambda x: weight(x, fixed), default=None)
        if best is None or 5 * weight(best, fixed) < 4 * weight(node, fixed) or not weight(best, fixed):
            return path
        path.append(best["key"])
        node = best


def extract(page: str, path: list[str] | None) -> str:
    """The text of the groups at a path; of a page that has none, at the path of its own expression."""
    root = parse(page)

    def at(node: Node, rest: list[str]) -> Iterator[Node]:
        if not rest:
            yield node
            return
        for part in node.parts:
            if isinstance(part, Node):
                if part.key == rest[0]:
                    yield from at(part, rest[1:])
                elif part.name in INLINE:
                    yield from at(part, rest)

    found = list(at(root, path)) if path is not None else []
    if not found:
        found = list(at(root, article_path(expression(root))))
    return joined([piece for node in found for piece in [*text_of(node), " "]])


def host(url: str):
    """The host of an address, in lower case, without port."""
    return F.lower(F.coalesce(F.regexp_extract(plain(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host over the pages of an input partition."""

    def flush():
        names = list(found)
        n = [found[x]["n"] for x in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([json.dumps(found[x]) for x in names], pa.string()), pa.array(n, pa.int64())], ["host", "wrapper", "n"])

    found: dict[str, dict] = {}
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = expression(parse(page))
            found[name] = merge(found[name], new) if name in found else new
        if len(found) >= HOSTS:
            yield flush()
            found.clear()
    if found:
        yield flush()


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = sorted(zip(rows["wrapper"], rows["n"]))
    wrapper = json.loads(ordered[0][0])
    for text, _ in ordered[1:]:
        wrapper = merge(wrapper, json.loads(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "n": [wrapper["n"]]})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, wrapper (JSON), n (pages)."""
    rows = pages.select(host(url_col).alias("host"), F.coalesce(plain(html_col), F.lit("")).alias("html"))
    schema = "host string, wrapper string, n bigint"
    partial = rows.mapInArrow(_partial, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    return partial.groupBy("host", "salt").applyInPandas(_combine, schema).groupBy("host").applyInPandas(_combine, schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [json.dumps(article_path(json.loads(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), batch.column(2)], ["host", "path", "n"])

    paths = cut(wrappers(pages, url_col, html_col).mapInArrow(choose, "host string, path string, n bigint"))
    rows = pages.select(plain(id_col).alias("id"), plain(url_col).alias("url"), host(url_col).alias("host"), F.coalesce(plain(html_col), F.lit("")).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, json.loads(path) if path else None) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    found = look_up(rows, paths, "host", "n", "path").select("id", "url", "html", "found")
    kind = rows.schema["id"].dataType.simpleString()
    return found.mapInArrow(read, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
