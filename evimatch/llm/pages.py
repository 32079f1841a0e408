"""Main text of web pages, with site templates removed by counting element subtrees per host.

1. Every page reports the hashes of its element subtrees, once each: of tags, classes, ids and all text below, and, for containers
   outside an article, of the tags, classes and ids alone (the frame), which stays the same where a site changes the words.
2. Spark counts pages per (host, hash), pre-aggregated, and keeps those on many pages of their host.  What is on at least SHARE of a
   host's pages can be one of few: a host has at most (subtrees of a page / SHARE) of them.
3. Every page is read again with its host's hashes: those subtrees are deleted, then what HTML itself or a class or id marks as not
   being the article (scripts, forms, navigation, notices, ...), and the text of what is left is taken by blocks.

Inside an <article> or <main> a recurring paragraph, heading or list item is kept, since articles do share sentences; recurring
containers go.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimatch.llm.tables import Scratch

#: A subtree is a template if it is on at least so many pages and at least this share of its host's pages.
MIN_PAGES, SHARE = 5, 0.05
#: A frame is the site's if it is on at least this share of its host's pages.
FRAME_SHARE = 0.5
#: Parts that a host's pages are dealt into where they meet its templates by a shuffle.
SALTS = 16
#: Template hashes (of all hosts together) that are broadcast; with more, pages meet their host's hashes in a shuffle.
BROADCAST_HASHES = 200_000

_TOKEN = re.compile(r"<!--|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)|<[!?][^>]*>?")
_QUOTED = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of an article.
_DROP = _RAW | set("head nav aside footer form button select option input label fieldset menu dialog svg canvas object audio video map".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: Words in a class or id that mark what is not the article.
_WORDS = set("ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe signup paywall share sharing social related recommended comment comments disqus respond sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar popup modal overlay skip toolbar".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ARTICLE = {"article", "main"}
_KEPT_IN_ARTICLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "b", "i", "em", "strong", "a", "span", "br", "tr", "code", "figcaption", "summary"}


class _Element:
    __slots__ = ("parts", "tag", "marks", "drop", "hash", "frame", "size")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.parts, self.hash, self.marks, self.frame, self.size = tag, [], 0, "", 0, 0
        self.drop = tag in _DROP
        if attrs and attrs.strip(" /"):
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            self.marks = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
            words = set(re.split(r"[^a-z]+", self.marks)) if self.marks else set()
            self.drop |= bool(words & _WORDS) or found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
            self.drop |= "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in ("html", "body", "main", "article"):
            self.drop = False


class _Quotes:
    """Where tags end.  What is known not to come any more is looked for once, so that no page takes more than linear time."""

    def __init__(self, text: str) -> None:
        self.text, self.gone, self.dead = text, set(), set()

    def _find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes start at ``at``, not counting those in quotes; -1 if there is none.

        A quote that is never closed counts as a plain character.
        """
        passed = []
        while m := _QUOTED.search(self.text, at):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            passed.append(m.start())
            end = self._find(m[0], m.end())
            at = end + 1 if end >= 0 else m.end()
        self.dead.update(passed)  # from these quotes on no tag ends
        return -1

    def end_of_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of a script or the like that starts before ``at``; the end of the text if there is none."""
        found = re.compile(rf"</{tag}\b", re.IGNORECASE).search(self.text, at) if tag not in self.gone else None
        if found is None:
            self.gone.add(tag)
            return len(self.text)
        end = self._find(">", found.end())
        return end + 1 if end >= 0 else len(self.text)


def parse(text: str) -> _Element:
    """A tree of elements and strings.  Unclosed elements end where their parent does; a block ends an open paragraph."""
    root = _Element("#root", "")
    stack, quotes, opened = [root], _Quotes(text), Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].parts.append(_html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(_html.unescape(text[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0] == "<!--":
                end = text.find("-->", at)
                at = end + 3 if end >= 0 else n
            continue
        end = quotes.end_of_tag(at)
        if end < 0:  # no tag after all
            stack[-1].parts.append(_html.unescape(m[0]))
            continue
        attrs, at = text[at:end], end + 1
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:
                    break  # an inline end tag does not close the blocks around it
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SAME[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "menu", "tbody", "thead", "tfoot"):
                    break
        node = _Element(tag, attrs)
        stack[-1].parts.append(node)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            at = quotes.end_of_raw(tag, at)
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _below(root: _Element) -> list[_Element]:
    """All elements, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in node.parts if isinstance(x, _Element))
    return out


def _number(said: str) -> int:
    return xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass")) >> 1 or 1


def _hash_all(root: _Element) -> list[_Element]:
    """Hash every subtree, children first; returns those with any text.

    hash is over tags, classes, ids and all text below; frame is over tags, classes and ids alone, runs of equal children counting once,
    so it is the same for a menu, notice or footer whose words change from page to page.
    """
    found = []
    for node in reversed(_below(root)):
        if node.tag in _RAW:
            continue
        said, shape = [f"<{node.tag} {node.marks}>"], [f"<{node.tag} {node.marks}>"]
        text = False
        for x in node.parts:
            if isinstance(x, str):
                own = " ".join(x.split())
                if own:
                    said.append(own)
                    node.size += len(own)
                    text = True
            elif x.hash:
                node.size += x.size
                said.append(f"\x00{x.hash}")
                if shape[-1] != (step := f"\x00{x.frame}"):
                    shape.append(step)
                text = True
        if text:
            node.hash, node.frame = _number("\x01".join(said)), _number("\x02".join(shape))
            if node.tag not in ("#root", "html", "body"):
                found.append(node)
    return found


def _frames(root: _Element) -> set[int]:
    """Frames of containers outside the article: what a site could repeat around its pages' own text."""
    out, todo = set(), [root]
    while todo:
        for x in todo.pop().parts:
            if isinstance(x, _Element) and x.tag not in _ARTICLE and x.tag not in _RAW:
                if x.frame and x.tag not in _KEPT_IN_ARTICLE and x.tag not in ("html", "body"):
                    out.add(x.frame)
                todo.append(x)
    return out


def main_text(root: _Element, templates: set[int]) -> str:
    """Blocks of the article, each with single spaces, joined by line breaks.

    templates holds hashes of subtrees and, negated, frames.  Where no element is marked as the article, containers with a frame of the
    site's go too, but for one with more text than the rest: that is where the site puts its articles.
    """
    roots = [x for x in _below(root) if x.tag in ("article", "main")]
    if len(roots) > 1:
        articles = [x for x in roots if x.tag == "article"] or roots
        inside = {id(y) for x in articles for y in _below(x) if y is not x}
        roots = [x for x in articles if id(x) not in inside]
    order = {id(x): i for i, x in enumerate(_in_order(root))} if len(roots) > 1 else {}
    roots.sort(key=lambda x: order.get(id(x), 0))
    blocks: list[str] = []
    now: list[str] = []

    def end_block() -> None:
        line = " ".join("".join(now).split())
        if line:
            blocks.append(line)
        now.clear()

    framed = set() if roots else {id(x) for x in _framed(root, templates)}
    for start in roots or [root]:
        article = bool(roots)
        todo: list = [start]
        while todo:
            x = todo.pop()
            if x is None:
                end_block()
            elif isinstance(x, str):
                now.append(x)
            else:
                template = x.hash in templates and x is not start and not (article and x.tag in _KEPT_IN_ARTICLE)
                if (x.drop and x is not start) or template or id(x) in framed or (x.tag == "header" and not article):
                    if x.tag in _BLOCK:
                        end_block()
                    continue
                if x.tag == "br":
                    now.append(" ")
                if x.tag in _BLOCK:
                    end_block()
                    todo.append(None)
                todo.extend(reversed(x.parts))
        end_block()
    return "\n".join(blocks)


def _framed(root: _Element, templates: set[int]) -> list[_Element]:
    """The outermost containers with a frame of the site's, without the largest where it has more text than all that is in none."""
    found, todo = [], [root]
    while todo:
        for x in todo.pop().parts:
            if isinstance(x, _Element) and not x.drop and x.hash not in templates:
                if x.frame and -x.frame in templates and x.tag not in _KEPT_IN_ARTICLE:
                    found.append(x)
                else:
                    todo.append(x)
    found.sort(key=lambda x: x.size)
    rest = root.size - sum(x.size for x in found)
    return found[:-1] if found and found[-1].size > rest else found


def _in_order(root: _Element) -> list[_Element]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, _Element))
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, int], int] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            root = parse(html.as_py() or "")
            own = {x.hash for x in _hash_all(root)}
            own.update(-x for x in _frames(root))
            own.add(0)  # stands for the page itself
            for h in own:
                counts[host, h] = counts.get((host, h), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["host", "h", "n"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        known: dict[str, set[int]] = {}
        for html, host, templates in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
            if host not in known:
                known[host] = set(templates.as_py() or ())
            root = parse(html.as_py() or "")
            if known[host]:
                _hash_all(root)
            out.append(main_text(root, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """Per row: page_id, url, text (main text, '' if none), n_chars.

    Character references are decoded; white space inside a block becomes one space, blocks are trimmed and joined by a line break.
    A null html counts as empty, an empty table gives an empty result, other columns are ignored.  A null or malformed url puts the page on the host ''.  Repeated rows are kept, each with its text.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    counted = own.select("host", "html").mapInArrow(_subtrees, "host string, h long, n long").groupBy("host", "h").agg(F.sum("n").alias("n"))
    counted = counted.where(f"n >= {min_pages} or h = 0")
    scratch = Scratch(pages.sparkSession, "pages")
    counted = scratch.table(counted, "subtrees")
    totals = counted.where("h = 0").select("host", F.col("n").alias("pages"))
    known = counted.where("h <> 0").join(totals, "host").where(F.col("n") >= F.col("pages") * F.when(F.col("h") > 0, share).otherwise(FRAME_SHARE))
    templates = scratch.table(known.groupBy("host").agg(F.collect_list("h").alias("templates")), "templates")
    n = templates.agg(F.sum(F.size("templates"))).first()[0] or 0
    if n <= BROADCAST_HASHES:
        met = own.join(F.broadcast(templates), "host", "left")
    else:  # a host may have a third of all pages
        dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "host", "templates").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
