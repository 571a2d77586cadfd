"""Main text of web pages by site style trees.

1. Every page is parsed into element nodes; a node's place in its site's style
   tree is the path of tags and classes that leads to it.
2. Pages of one host are merged: for each place, how many distinct pages have
   it, in which presentations (sequences of children), and with which contents.
   A presentation that varies and contents that seldom repeat make a place
   important; a place that looks and reads the same everywhere is not, and the
   less so the more pages show it.
3. Pages are parsed again: branches whose role says what they are (menus,
   forms, adverts, comments ...) and branches at places of low importance are left
   out, and the blocks of the article are joined.

Merging is a grouped count by host and place; no host is gathered in a task.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

#: Places below this importance are left out.
LEAST_IMPORTANCE = 0.25
#: Pages that count as unlike the others, so that a place of few pages is not judged by them alone.
PRIOR_PAGES = 1
#: Share of the contents in the importance of a place (the rest is the presentation's).
CONTENT_SHARE = 0.9
#: Tables of unimportant places up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_PLACES = 100_000

# no alternative but a comment or a quoted value runs past the next "<", so that broken tags take linear time
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("head script style title noscript template iframe object embed svg canvas audio video map nav footer aside form button select option textarea input dialog menu noembed noframes xmp".split())
#: Words of class, id and role that say that a container is not the article, beside words that say nothing of its content.
_ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager comment comments disqus replies respond share sharing social related recommended widget login signup search "
    "complementary contentinfo dialog cc copyright".split()
)
_PLAIN = frozenset(
    "area bar block body bottom box button buttons col column container content desktop fixed form full global group holder icons inner item items left link links list main menu mobile "
    "outer panel primary reader readers right row secondary section site slot sticky thread top unit user users window wrap wrapper".split()
)
#: Names of a container that holds the article, whatever else it is called.
_HOLDERS = frozenset("main-content maincontent content-main article-content article-body post-content post-body entry-content page-content".split())
#: Elements that such words are looked for in; headings, text and tables are never judged by them.
_CONTAINERS = frozenset("div section aside ul ol dl nav header footer form details fieldset address".split())
#: Ends an open paragraph.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the second kind ends where one of the first kind starts, up to a container of the third.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_FENCES = frozenset("article main section div td th table body html li blockquote form nav aside footer header".split())


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


class Node:
    """An open element: tag, hash of its path in the style tree, whether it is left out, whether it is in an article or in the main part, and the block it is in."""

    __slots__ = ("tag", "path", "out", "kind", "children", "block")

    def __init__(self, tag: str, path: int, out: bool, kind: int, block: Node | None):
        self.tag, self.path, self.out, self.kind, self.children = tag, path, out, kind, []
        self.block = block if tag in _INLINE and block else self


#: What may leave a branch out: tags that no text is read in, forms, and names.
ALL, BUT_FORMS, TAGS = 2, 1, 0


def _left_out(tag: str, attributes: dict[str, str], kind: int, strict: int = ALL) -> bool:
    if tag in _DROPPED and (tag != "form" or strict == ALL) or tag == "header" and not kind:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if strict == TAGS or tag not in _CONTAINERS or not attributes:
        return False
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split()
    if _HOLDERS & set(names):
        return False
    for name in names:
        words = {w for w in re.split(r"[^a-z]+", name) if len(w) > 1}  # sizes and versions say nothing
        if words & _ROLES and words <= _ROLES | _PLAIN or words and words <= {"header"} | _PLAIN and "header" in words and not kind:
            return True
    return False


def blocks(page: str | None, low: frozenset[int] = frozenset(), strict: int = ALL) -> tuple[list[tuple[int, int, str]], dict[int, set[tuple[str, ...]]]]:
    """Blocks (1 in an article, 2 in the main part, 0 elsewhere; hash of the path; text) that no role or place leaves out, and the presentations of each path."""
    page = page or ""
    top = Node("", 0, False, 0, None)
    stack, text, found = [top], [], []
    styles: dict[int, set[tuple[str, ...]]] = {}
    still_open: Counter[str] = Counter()

    def end_block() -> None:
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if s and not stack[-1].out:
                n = stack[-1].block
                found.append((n.kind, n.path, s))

    def close(i: int) -> None:
        """Ends the open elements from the i-th on."""
        if any(n.tag not in _INLINE or n.out for n in stack[i:]):
            end_block()
        for n in stack[i:]:
            still_open[n.tag] -= 1
            if not n.out and n.tag not in _INLINE:
                styles.setdefault(n.path, set()).add(tuple(n.children))
        del stack[i:]

    def last(tags, fences) -> int:
        if not any(still_open[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in fences:
                return 0
        return 0

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at and not stack[-1].out:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br" or tag == "p" and not last({"p"}, _FENCES):
                end_block()
            elif i := last({tag}, _FENCES - {tag} if tag in _INLINE or tag == "p" else ()):
                close(i)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag not in _INLINE:
                end_block()
            continue
        if tag in _BLOCKS and (i := last({"p"}, _FENCES)):
            close(i)
        if tag in _SIBLINGS and (i := last(*_SIBLINGS[tag])):
            close(i)
        if tag in _VOID:
            if tag in ("br", "hr"):
                text.append(" ") if tag == "br" else end_block()
            continue
        raw = m[3] or m[6] or ""
        attributes = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}
        parent = stack[-1]
        kind = parent.kind
        name = tag + "".join("." + c for c in sorted(set(attributes.get("class", "").lower().split())))
        path = _hash(f"{parent.path}/{name}")
        out = parent.out or _left_out(tag, attributes, kind, strict) or path in low
        if tag == "article" or tag == "main" or attributes.get("role", "").lower() in ("main", "article"):
            kind = 1 if tag == "article" or kind == 1 or attributes.get("role", "").lower() == "article" else 2
        if tag not in _INLINE or out and not parent.out:
            end_block()
            parent.children.append(name)
        if not raw.rstrip().endswith("/") or tag not in ("svg", "path"):
            still_open[tag] += 1
            stack.append(Node(tag, path, out, kind, parent.block))
    if not stack[-1].out:
        text.append(page[at:])
    close(1)
    end_block()
    return found, styles


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The blocks that are left, joined by a space. Where articles and the main part hold half of their text or more, what comes behind or between them is left out; a title and lead ahead of them stay.

    A page that would be empty is read again with forms as containers, as some sites put all of a page into one,
    then without the judgement of names, and at last without that of places.
    """
    found, _ = blocks(page, low)
    for strict, places in ((BUT_FORMS, low), (TAGS, low), (TAGS, frozenset())):
        if found or not page:
            break
        found, _ = blocks(page, places, strict)
    marked = sum(len(s) for k, _, s in found if k)
    only = 2 * marked >= sum(len(s) for _, _, s in found)
    first = next((i for i, (k, _, _) in enumerate(found) if k), 0)
    return " ".join(s for i, (k, _, s) in enumerate(found) if k or not only or i < first)


def host() -> F.Column:
    h = F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", h)


def unimportant_places(pages: DataFrame) -> DataFrame:
    """(host, place) of the nodes of the sites' style trees that have low importance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], []]
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = page.as_py() or ""
                found, styles = blocks(own)
                doc, seen = _hash(own), {(p, 2, _hash(s)) for _, p, s in found}
                seen |= {(p, 0, 0) for _, p, _ in found}
                seen |= {(p, 1, _hash(" ".join(c))) for _, p, _ in found for c in styles.get(p, ())}
                for p, kind, x in seen:
                    for c, v in zip(cols, (h, p, kind, x, doc), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "place", "kind", "x", "page"])

    rows = pages.select(host().alias("host"), "html").filter("host is not null").mapInArrow(run, "host string, place long, kind int, x long, page long")
    counts = rows.distinct().groupBy("host", "place", "kind", "x").agg(F.count("*").alias("n"))
    some = counts.groupBy("host", "place").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("shown_log"),
        F.avg(F.when(F.col("kind") == 2, F.log("n"))).alias("content_log"),
        F.count(F.when(F.col("kind") == 2, True)).alias("contents"),
    )
    some = some.filter("m > 1")
    size = F.log("m")
    presentation = F.coalesce(F.least(F.lit(1.0), (F.log("shown") - F.col("shown_log") / F.col("shown")) / size), F.lit(0.0))
    content = F.greatest(F.lit(0.0), 1 - F.col("content_log") / size)
    importance = (1 - CONTENT_SHARE) * presentation + CONTENT_SHARE * content
    sure = (F.col("m") - 1) / (F.col("m") - 1 + PRIOR_PAGES)
    return some.filter(1 - sure * (1 - importance) <= LEAST_IMPORTANCE).select("host", "place")


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and any others) without html, with ``text`` and ``n_chars`` (code points).

    Null or empty html, and pages without a block, give empty text. A null url, or
    one without a host, belongs to no site: only roles leave branches out. Copies
    of a page count once in its site's tree. Input columns with the names of
    results are replaced. Repeated rows get equal results; an empty table gives no rows.
    """
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    low = saved(unimportant_places(pages))
    n = low.count()
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host().alias("_host"), F.col("html").alias("_html"))
    by_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("place").alias("_low"))
    rows = rows.join(F.broadcast(by_host) if n <= BROADCAST_PLACES else by_host, "_host", "left") if n else rows.withColumn("_low", F.lit(None).cast("array<long>"))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "_host", "_low", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            k = batch.num_columns
            text = []
            for h, x, p in zip(batch.column(k - 3).to_pylist(), batch.column(k - 2), batch.column(k - 1), strict=True):
                if h not in sets:
                    if len(sets) > 200:
                        sets.clear()
                    sets[h] = frozenset(x.as_py() or ())
                text.append(main_text(p.as_py(), sets[h]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: k - 3], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*keep, "text", "n_chars"])

    out = T.StructType([rows.schema[c] for c in keep]).add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
