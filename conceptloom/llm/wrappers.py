"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of block elements (labels: tag, classes and id) with text slots.  A wrapper is such a tree whose
parts may be optional or repeated.  Equal neighbours fold into a repeated part; two wrappers are aligned by the longest
common subsequence of their children, what has no partner becomes optional, and texts that differ become slots that
vary.  Each partition folds its pages into one wrapper per host, and Spark merges those of a host, so a host has as
many rows as partitions hold it, whatever its number of pages.

Main parts are the article and main elements found on the page itself, whole as they are.  On a page without, a text is
part of the template if the same text stands at the same path of labels on ``TEMPLATE_PAGES`` different pages of the host
and on half of its pages with that path; the main region is the deepest of the wrapper's regions on the page (containers
with varying slots) that holds over half of the page's other text.  If nothing is left, template texts count as well.

Navigation, footers, asides and what an attribute hides are told by tag and attribute, unless they hold all main parts of
the page.  Whole class and id tokens (and forms, and headers outside main parts) are hints: they drop parts that hold
neither a main part nor over half of the page's text; inside main parts no paragraph, heading or item goes for its class.

Defined results: null and empty pages, and pages with no text outside of asides, give an empty text; a null or hostless url
belongs to the host named by the empty string; a repeated page is extracted like any other; elements nested deeper than
``DEEPEST`` count as parts of the element at that depth; unclosed elements end with their parent; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from conceptloom.llm.common import lookup
from conceptloom.scratch import Scratch

DEEPEST = 100
#: Children of one element that are aligned one by one; more become a repeated group of optional parts.
WIDEST = 64
#: A text that is the same on so many different pages, and on half of all, is part of the template.
TEMPLATE_PAGES = 3
HOSTS_HELD = 10_000

# Elements of the HTML language, by their role here.
BLOCKS = frozenset(
    "html body div section article main nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption address details summary hr center menu dialog".split()
)
UNREAD = "script|style|noscript|template|title|textarea|svg|iframe|select|button|object|canvas|math|audio|video"
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "thead", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd th tr td caption figcaption".split())
CONTAINERS = frozenset(["", *"html body div section article main td center form fieldset details".split()])
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer header masthead banner ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent notice notices popup modal overlay newsletter subscribe signup share sharing "
    "social related recommended recommendations comment comments disqus replies respond breadcrumb breadcrumbs pagination pager "
    "widget toolbar login search copyright legal hidden".split()
)
MAIN_ASIDE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments related".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNREAD})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_NO_LABEL = str.maketrans("./", "__", "0123456789")
#: Label word of an element that an attribute hides.
HIDDEN = "=hidden"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"

SLOT = "#"
# A wrapper: [label, optional, repeated, children, text's digest (slots: "*" if it varies), characters, pages]
LABEL, OPTIONAL, REPEATED, CHILDREN, TEXT, CHARS, PAGES = range(7)


def _label(tag: str, attributes: str) -> str:
    words = set()
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop"):
            role = "role" if name in ("role", "itemprop") else ""
            words |= {role + w for w in (x.strip("-_") for x in value.lower().translate(_NO_LABEL).split()) if w}
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _UNSHOWN.search(value)):
            words.add(HIDDEN)
    return ".".join([tag, *sorted(words)])


def page_tree(page: str) -> list:
    """[label, children] of the page's block elements; texts are children of type str."""
    root = ["", []]
    open_, run = [root], []

    def text() -> None:
        words = " ".join("".join(run).split())
        run.clear()
        if words:
            open_[-1][1].append(words)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "br":
            run.append(" ")
        if tag not in BLOCKS:
            continue
        text()
        if m[2]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0].split(".")[0] == tag:
                    del open_[k:]
                    break
            continue
        while len(open_) > 1 and tag in CLOSED_BY.get(open_[-1][0].split(".")[0], ()):
            open_.pop()
        node = [_label(tag, m[4]), []]
        if len(open_) <= DEEPEST:
            open_[-1][1].append(node)
            if tag not in VOID:
                open_.append(node)
    run.append(entities.unescape(page[at:]))
    text()
    return root


@lru_cache(1 << 16)
def is_main(label: str) -> bool:
    tag, *words = label.split(".")
    return (tag in ("article", "main") or "rolemain" in words or "rolearticlebody" in words) and not MAIN_ASIDE_WORDS & set(words)


def asides(tree: list) -> set[int]:
    """The elements of a page (by Python's id) that are no part of its text."""
    inner: dict[int, tuple] = {}
    out: set[int] = set()

    def count(node: list) -> tuple[int, int]:
        """Characters and main parts within."""
        chars, mains = 0, int(is_main(node[0]))
        for c in node[1]:
            a, b = (len(c), 0) if isinstance(c, str) else count(c)
            chars, mains = chars + a, mains + b
        inner[id(node)] = chars, mains
        return chars, mains

    whole, mains = count(tree)

    def is_aside(node: list, inside: bool) -> bool:
        tag, *words = node[0].split(".")
        if tag in ("html", "body"):
            return False
        if HIDDEN in words:
            return True
        if is_main(node[0]):
            return False
        chars, within = inner[id(node)]
        hint = set() if inside and tag in TEXTUAL else ASIDE_WORDS & set(words)
        if tag in ASIDE_TAGS or hint & MAIN_ASIDE_WORDS:
            return not mains or within < mains
        return bool(hint or tag == "form" or (tag == "header" and not inside)) and not within and 2 * chars <= whole

    def walk(node: list, inside: bool) -> None:
        for c in node[1]:
            if not isinstance(c, str):
                if is_aside(c, inside):
                    out.add(id(c))
                else:
                    walk(c, inside or is_main(c[0]))

    walk(tree, False)
    return out


def wrapper_of(node) -> list:
    """A page's own wrapper."""
    if isinstance(node, str):
        return [SLOT, 0, 0, [], hashlib.md5(node.encode("utf-8", "surrogatepass")).hexdigest()[:12], len(node), 1]
    return [node[0], 0, 0, _folded([wrapper_of(c) for c in node[1]]), "", 0, 1]


def _folded(parts: list) -> list:
    """Equal neighbours as one repeated part."""
    out: list = []
    for p in parts:
        if out and out[-1][LABEL] == p[LABEL]:
            out[-1] = merged(out[-1], p)
            out[-1][REPEATED], out[-1][PAGES] = 1, max(out[-1][PAGES] - p[PAGES], p[PAGES])
        else:
            out.append(p)
    if len(out) <= WIDEST:
        return out
    by_label: dict = {}
    for p in out:
        if p[LABEL] in by_label:
            p = merged(by_label[p[LABEL]], p)
        p[OPTIONAL] = p[REPEATED] = 1
        by_label[p[LABEL]] = p
    return list(by_label.values())


def merged(a: list, b: list) -> list:
    """The least wrapper of this kind that both are cases of; their labels are equal."""
    same = a[TEXT] if a[TEXT] == b[TEXT] else "*"
    return [a[LABEL], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], _aligned(a[CHILDREN], b[CHILDREN]), same,
            a[CHARS] + b[CHARS], a[PAGES] + b[PAGES]]


def _aligned(a: list, b: list) -> list:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][LABEL] == b[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def alone(p: list) -> None:
        out.append([p[LABEL], 1, *p[REPEATED:]])

    while i < n and j < m:
        if a[i][LABEL] == b[j][LABEL]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            alone(a[i])
            i += 1
        else:
            alone(b[j])
            j += 1
    for p in [*a[i:], *b[j:]]:
        alone(p)
    return _folded(out)


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    inner = "".join(map(expression, w[CHILDREN]))
    body = (SLOT if w[TEXT] == "*" else "text") if w[LABEL] == SLOT else f"<{w[LABEL]}>{inner}</>" if w[LABEL] else inner
    mark = {(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[w[OPTIONAL], w[REPEATED]]
    return f"({body}){mark}" if mark else body


def _upwards(path: str) -> Iterator[str]:
    """The containers of a path, itself first."""
    while True:
        if path.rsplit("/", 1)[-1].split(".")[0] in CONTAINERS:
            yield path
        if not path:
            return
        path = path.rsplit("/", 1)[0]


def rules(w: list) -> dict:
    """What extraction needs of a wrapper: its regions, the paths of containers whose texts vary."""
    regions: set[str] = set()

    def walk(node: list, path: str) -> None:
        for c in node[CHILDREN]:
            if c[LABEL] != SLOT:
                walk(c, f"{path}/{c[LABEL]}")
            elif c[TEXT] == "*" or c[PAGES] < TEMPLATE_PAGES:
                regions.update(_upwards(path))

    walk(w, "")
    return {"regions": sorted(regions)}


def _shown(tree: list) -> tuple[list[str], list[tuple[str, str]]]:
    """Texts within main parts, and all texts with their paths; without those of asides."""
    drop, main, every = asides(tree), [], []

    def walk(node: list, path: str, inside: bool) -> None:
        for c in node[1]:
            if isinstance(c, str):
                every.append((path, c))
                if inside:
                    main.append(c)
            elif id(c) not in drop:
                walk(c, f"{path}/{c[0]}", inside or is_main(c[0]))

    walk(tree, "", False)
    return main, every


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def slot(path: str, text: str) -> str:
    return f"{_hash(path)}:{_hash(text)}"


def main_text(page: str, rule: dict | None, fixed: frozenset[str] = frozenset()) -> str:
    tree = page_tree(page)
    main, every = _shown(tree)
    if main or not every:
        return "\n\n".join(main)
    rule = rule or rules(wrapper_of(tree))
    own = [(p, t) for p, t in every if not fixed or slot(p, t) not in fixed] or every
    mass: dict[str, int] = {}
    for path, text in own:
        for holder in _upwards(path):
            mass[holder] = mass.get(holder, 0) + len(text)
    # Of two containers with over half of the text one holds the other.
    regions = set(rule["regions"]) & mass.keys() or mass.keys()
    best = max((r for r in regions if 2 * mass[r] > mass[""]), key=lambda r: r.count("/"), default="")
    return "\n\n".join(t for p, t in own if p == best or p.startswith(f"{best}/"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, text and page as hashes of every text of pages without a main part; text is null once a path."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            main, every = _shown(page_tree(page))
            if not main and every:
                digest = _hash(page)
                rows += {(host, _hash(p), x, digest) for p, t in every for x in (None, _hash(t))}
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "path", "text", "page"])


def template_texts(pages: DataFrame) -> DataFrame:
    """host, fixed: its template texts as path:text, joined by commas; copies of a page count once."""
    seen = pages.select("host", "html").mapInArrow(_slots, "host string, path bigint, text bigint, page bigint").distinct()
    counted = seen.groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    often = counted.where((F.col("n") >= TEMPLATE_PAGES) & F.col("text").isNotNull())
    paths = counted.where("text IS NULL").select("host", "path", F.col("n").alias("n_path"))
    return often.join(paths, ["host", "path"]).where("2 * n >= n_path").groupBy("host").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "path", "text")))).alias("fixed"))


def _partition_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out():
        rows = [pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()], pa.string()),
                pa.array([w[PAGES] for w in held.values()], pa.int64())]
        return pa.RecordBatch.from_arrays([rows[0].cast(pa.string()), *rows[1:]], names=["host", "wrapper", "pages"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            new = wrapper_of(page_tree(page))
            held[host] = merged(held[host], new) if host in held else new
            if len(held) > HOSTS_HELD:
                yield out()
                held.clear()
    yield out()


def _host_rules(group: pa.Table) -> pa.Table:
    whole = None
    for text in group["wrapper"]:
        w = json.loads(text.as_py())
        whole = w if whole is None else merged(whole, w)
    return pa.table({"host": [group["host"][0].as_py()], "pages": pa.array([whole[PAGES]], pa.int64()),
                     "rule": [json.dumps(rules(whole))], "expression": [expression(whole)]})


def infer(pages: DataFrame) -> DataFrame:
    """host, pages, rule (JSON), expression of every host of (host, html)."""
    parts = pages.select("host", "html").mapInArrow(_partition_wrappers, "host string, wrapper string, pages bigint")
    return parts.groupBy("host").applyInArrow(_host_rules, "host string, pages bigint, rule string, expression string")


@F.pandas_udf(StringType())
def _extracted(pages: pd.Series, texts: pd.Series, template: pd.Series) -> pd.Series:
    parsed: dict = {}
    out = []
    for page, *key in zip(pages, texts, template, strict=True):
        key = tuple(key)
        if key not in parsed:
            parsed[key] = (json.loads(key[0]) if key[0] is not None else None), frozenset(key[1].split(",") if key[1] else ())
        out.append(main_text(page, *parsed[key]))
    return pd.Series(out, dtype=object)


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    )
    scratch = Scratch(spark, "wrappers")
    found = scratch.save(infer(rows).join(template_texts(rows), "host", "left"), "hosts")
    total = found.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    with_rule = lookup(rows, found.select("host", "pages", "rule", "fixed"), "host", "pages", total, F.struct("page_id", "url"))
    return with_rule.select("page_id", "url", _extracted("html", "rule", "fixed").alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
