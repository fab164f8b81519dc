"""Main text of web pages by equivalence classes of template tokens.

1. Every page is read into elements and text blocks. An element's token is its path of structural
   tags with their classes and ids, digits made alike (a long path goes on from a hash of its beginning).
2. A token's occurrence vector over the pages of its host is kept as a fingerprint (xor of the hashes
   of page and count) with counts, so it is aggregated with partial results, however many pages a host
   has. Tokens of one host with equal vectors form an equivalence class.
3. Classes are valid if they have support and their tokens occur once on their pages; valid tokens
   nest by their paths into the host's template.
4. A page's content slot is found by going down that nest: from a slot to the slot in it that holds at
   least SLOT_SHARE of its varying text, in means over the pages of each slot's class, among the slots that
   the page has. Constant slots and those marked as none of the article hold no varying text.
5. Extraction takes the blocks inside the element at the slot, without what is marked as menu, header,
   footer, sidebar, notice, advert, form, script, style or reader comment, and without slots whose text
   is the same on all of a host's pages, at least CONSTANT_PAGES distinct ones (but not in an article or main
   element). Names are the last resort: an element named as the article's is looked for inside the slot, and on
   pages without a template in the whole page; pages with neither are taken whole.

Null html is the empty text. Pages with null or odd urls share one nameless host. Rows are independent,
so repeated rows each get their text; pages of any length and depth are read whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, spare_name

#: Share of a host's pages that a template token is on; distinct pages on which equal text counts as the template's; bytes of templates up to which they are broadcast.
SUPPORT, CONSTANT_PAGES, BROADCAST_BYTES = 0.1, 5, 32 << 20
#: Share of a slot's varying text that a slot in it must hold to be gone into; characters of a path that is kept in the clear.
SLOT_SHARE, PATH_CHARS = 0.8, 400

# Names of HTML elements by how they are laid out or meant.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
STRUCTURAL = frozenset("html body header nav main article section aside footer div form table ul ol dl h1 dialog figure".split())
DROPPED = frozenset("nav footer aside form button select dialog svg canvas object audio video map menu datalist search".split())
NOT_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Words of a class, id or role that mark an element as no part of the article, wherever they stand in a name; and whole names that do.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored cookie cookies gdpr notice notices newsletter breadcrumb breadcrumbs menu nav navbar navigation sidebar footer comment comments commentlist replies disqus pagination complementary contentinfo".split()
)
MARKED_NAMES = frozenset(
    "sponsor sponsors promo promotion consent alert subscribe subscription signup share sharing share-buttons social social-links respond reply related related-posts related-articles related-links recommended recommendations popup modal overlay widget widgets toolbar pager login search banner paywall dialog".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies".split())
#: Words that mark an element as the article's, where no element says so by its name.
GOOD = frozenset("article articlebody post entry story content text main body".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")), "tbody": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",))}

_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|</?([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")


def marked(names: list[str]) -> bool:
    """Whether the classes, ids and roles of an element mark it as no part of the article."""
    return any(x in MARKED_NAMES or not MARKS.isdisjoint(_NAMES.split(x)) for x in names)


class Element:
    __slots__ = ("tag", "names", "marked", "hidden", "parent", "path")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.names, self.marked, self.hidden = tag, parent, frozenset(), False, False
        label = tag
        if attributes and tag in BLOCK | {"span"}:
            said = {}
            for m in _ATTRIBUTE.finditer(attributes):
                said.setdefault(m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")).lower())
            names = [x for key in ("class", "id", "role", "itemprop") for x in said.get(key, "").split()]
            self.names = frozenset(w for x in names for w in _NAMES.split(x) if w)
            self.marked = marked(names)
            self.hidden = "hidden" in said or said.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", "")))
            if names:
                label = tag + "." + ".".join(sorted({re.sub(r"[>.]", "_", re.sub(r"\d+", "0", x)) for x in names}))
        if parent is None:
            self.path = label
        elif tag in STRUCTURAL:
            self.path = f"{parent.path}>{label}" if parent.path else label
            if len(self.path) > PATH_CHARS:
                self.path = f"#{xxhash.xxh64_hexdigest(parent.path.encode('utf-8', 'surrogatepass'))}>{xxhash.xxh64_hexdigest(label.encode('utf-8', 'surrogatepass')) if len(label) > PATH_CHARS // 2 else label}"
        else:
            self.path = parent.path

    def inside(self, other: Element) -> bool:
        e: Element | None = self
        while e is not None:
            if e is other:
                return True
            e = e.parent
        return False


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements in page order, and blocks: (innermost element, text with references decoded and white space made single)."""
    root = Element("", "", None)
    elements, blocks = [root], []
    stack, held = [root], []

    def close_block() -> None:
        if held:
            # a block belongs to the innermost element that all of its pieces share: that of its first piece, up to a block
            text = " ".join("".join(x for _, x in held).split())
            if text:
                e = held[0][0]
                while e.tag not in BLOCK and e.parent is not None and not e.hidden:
                    e = e.parent
                blocks.append((e, text))
            held.clear()

    def pop_to(e: Element) -> None:
        while stack[-1] is not e:
            stack.pop()
        stack.pop()

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            held.append((stack[-1], entities.unescape(page[at:])))
            break
        if m.start() > at:
            held.append((stack[-1], entities.unescape(page[at : m.start()])))
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[m.start() + 1] == "/":
            if tag in BLOCK:
                close_block()
            for e in reversed(stack[1:]):
                if e.tag == tag:
                    pop_to(e)
                    break
                if e.tag in ("article", "main", "body") and tag not in ("main", "body", "html"):
                    break  # a stray end tag doesn't end the article around it
            continue
        if tag in BLOCK:
            close_block()
        elif tag == "br":
            held.append((stack[-1], " "))
        if tag in NOT_IN_P:
            for e in reversed(stack[1:]):
                if e.tag == "p":
                    pop_to(e)
                    break
                if e.tag in BLOCK:
                    break
        if tag in SELF_CLOSING:
            ends, scope = SELF_CLOSING[tag]
            for e in reversed(stack[1:]):
                if e.tag in scope:
                    break
                if e.tag in ends.split():
                    pop_to(e)
                    if not (set(ends.split()) & {x.tag for x in stack[1:]} and tag in ("tr", "tbody", "thead", "tfoot")):
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        e = Element(tag, m[2], stack[-1])
        elements.append(e)
        if not (m[2].endswith("/") and tag == "svg"):
            stack.append(e)
    close_block()
    return elements, blocks


def dropped(e: Element, root: Element) -> bool:
    """Whether an element between a block and the content root is none of the article."""
    while e is not root and e is not None:
        if e.hidden or e.tag in DROPPED or (e.marked and e.tag not in ("html", "body", "main")):
            return True
        if e.tag in ("header", "head") and root.tag not in ("article", "main"):
            return True
        e = e.parent
    return False


def tokens(page: str | None) -> list[tuple[str, int, int, int]]:
    """(token, times on the page, characters of its text, hash of its text) of a page; the empty token is the page's own."""
    elements, blocks = parse(page or "")
    count: dict[str, int] = {"": 1}
    chars: dict[str, int] = {}
    said: dict[str, xxhash.xxh3_64] = {}
    for e in elements[1:]:
        if e.tag in STRUCTURAL:
            count[e.path] = count.get(e.path, 0) + 1
    for e, text in blocks:
        seen = set()
        while e is not None:
            if e.path not in seen:
                seen.add(e.path)
                chars[e.path] = chars.get(e.path, 0) + len(text)
                said.setdefault(e.path, xxhash.xxh3_64()).update(text.encode("utf-8", "surrogatepass"))
            e = e.parent
    return [(p, n, chars.get(p, 0), (said[p].intdigest() >> 1) if p in said else 0) for p, n in count.items()]


def host_of(url: str = "url"):
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@|:\d*$", ""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): of each host with two pages or more, its valid tokens as JSON rows (token, class, characters, whether its text is always the same)."""
    small_batches(pages.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # the page's own token, the first, tells copies of a page by their text
            rows = [(host, key, found[0][3], *t) for host, key, page in zip(pdf.host, pdf.page_key, pdf.html, strict=True) if (found := tokens(page)) for t in found]
            yield pd.DataFrame(rows, columns=["host", "page_key", "whole", "token", "times", "chars", "said"])

    rows = pages.select(host_of().alias("host"), F.xxhash64("page_id", "url").alias("page_key"), "html")
    seen = rows.mapInPandas(count, "host string, page_key long, whole long, token string, times int, chars long, said long")
    classes = seen.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum((F.col("times") == 1).cast("long")).alias("once"),
        F.bit_xor(F.xxhash64("page_key", "times")).alias("vector"),
        F.sum("chars").alias("chars"),
        # equal text says something only over distinct pages, on which other text varies
        ((F.min("said") == F.max("said")) & (F.count_distinct("whole") >= CONSTANT_PAGES)).alias("same"),
    )
    classes = materialize(classes.where("pages > 1"), "tokens")
    totals = classes.where("token = ''").select(F.col("host").alias("host_"), F.col("pages").alias("total"))
    valid = classes.join(totals, F.col("host") == F.col("host_")).where((F.col("pages") >= SUPPORT * F.col("total")) & (F.col("once") >= 0.9 * F.col("pages")))
    # At most 1 / SUPPORT times the tokens of an average page are left of a host.
    row = F.struct("token", F.concat_ws("/", "pages", "vector").alias("class"), "chars", "same")
    return valid.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("template"))


class Template:
    """A host's template: valid tokens in classes of equal occurrence, nested by path, with the varying text of each."""

    def __init__(self, text: str | None):
        rows = json.loads(text) if text else []
        self.classes: dict[str, list[str]] = {}
        for r in rows:
            self.classes.setdefault(r["class"], []).append(r["token"])
        self.constant = frozenset(r["token"] for r in rows if r["same"])
        # nest: a token's parent is the longest valid token that is a prefix of its path
        self.parent: dict[str, str] = {}
        self.inner: dict[str, list[str]] = {}
        known = {r["token"] for r in rows}
        for t in known:
            p = t
            while (p := p.rpartition(">")[0]) and p not in known:
                pass
            self.parent[t] = p
            if t:
                self.inner.setdefault(p, []).append(t)
        pages = {t: int(c.partition("/")[0]) for c, tokens in self.classes.items() for t in tokens}
        varying = {r["token"]: r["chars"] for r in rows}
        # constant and marked slots are taken out of all that they nest in, the outermost of them once; where one
        # that is named as the article's is constant, the host holds copies
        self.fixed = {t for t in varying if t and (t in self.constant and not rank_of(t.rpartition(">")[2]) or any(map(rank_of_mark, t.split(">"))))}
        for t in self.fixed:
            above = [t]
            while above[-1]:
                above.append(self.parent[above[-1]])
            if self.fixed.isdisjoint(above[1:]):
                for p in above[1:]:
                    if p in varying:
                        varying[p] -= varying[t]
        self.mean = {t: varying[t] / pages[t] for t in varying}

    def slot(self, present: set[str]) -> str | None:
        """The innermost slot, of those that a page has, on the way along most of the varying text; None for the whole page."""
        slot = ""
        while self.mean.get(slot, 0) > 0 and (found := [t for t in self.inner.get(slot, ()) if t in present and t not in self.fixed and not is_heading(t)]):
            top = max(found, key=lambda t: (self.mean[t], t))
            if self.mean[top] < SLOT_SHARE * self.mean[slot]:
                break
            slot = top
        return None if slot.rpartition(">")[2].partition(".")[0] in ("", "html", "body") else slot


def is_heading(token: str) -> bool:
    return token.rpartition(">")[2].partition(".")[0] == "h1"


def rank_of(label: str) -> int:
    """How surely a label names the article's element: 0 for not at all."""
    tag, _, names = label.partition(".")
    words = set(_NAMES.split(names))
    if tag == "article":
        return 5
    if "articlebody" in words:
        return 4
    if tag == "main" or "main" in names.split("."):
        return 3
    return 1 if tag in ("div", "section") and words & GOOD else 0


def rank_of_mark(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in DROPPED or tag == "header" or tag not in ("html", "body", "main", "") and marked(names)


@lru_cache(maxsize=512)
def _template(text: str | None) -> Template:
    return Template(text)


def content_root(elements: list[Element], blocks: list[tuple[Element, str]], template: Template) -> Element:
    """The page's element at its template's content slot, or one in it that is named as the article's; without a slot the best by name, else the whole page."""
    volume: dict[int, int] = {}
    for e, text in blocks:
        x: Element | None = e
        while x is not None:
            volume[id(x)] = volume.get(id(x), 0) + len(text)
            x = x.parent
    shown = [e for e in elements[1:] if e.tag in STRUCTURAL and not e.hidden and volume.get(id(e))]
    slot = template.slot({e.path for e in shown}) if template.mean else None
    at_slot = [e for e in shown if e.path == slot]
    found = max(at_slot, key=lambda e: volume[id(e)]) if at_slot else elements[0]
    best = (rank_of(found.path.rpartition(">")[2]), 0) if at_slot else (0, 0)
    for e in shown:
        if e.tag == "article" and e.names & COMMENTS:
            continue  # a reader's comment, however long
        rank = rank_of(e.path.rpartition(">")[2])
        if (rank, volume[id(e)]) > best and rank > best[0] - (not at_slot) and not _any_marked(e):
            # what is named as the article's but lies beside the slot counts only without a slot
            if not at_slot or e.inside(max(at_slot, key=lambda x: volume[id(x)])):
                best, found = (rank, volume[id(e)]), e
    return found


def _any_marked(e: Element | None) -> bool:
    while e is not None:
        if e.tag in DROPPED or e.tag == "header" or e.marked and e.tag not in ("html", "body", "main"):
            return True
        e = e.parent
    return False


def main_text(page: str | None, template: Template | None = None) -> str:
    template = template or _template(None)
    elements, blocks = parse(page or "")
    if not blocks:
        return ""
    root = content_root(elements, blocks, template)
    inside = [(e, text) for e, text in blocks if e.inside(root) and not dropped(e, root)]
    out = [text for e, text in inside if root.tag in ("article", "main") or not template.constant or not _constant(e, root, template)]
    return "\n\n".join(out)


def _constant(e: Element, root: Element, template: Template) -> bool:
    """Whether a slot between a block and the content root is constant; the root's own path (also that of a p in it) is not asked."""
    while e is not root and e is not None and e.path != root.path:
        if e.path in template.constant:
            return True
        e = e.parent
    return False


def extracted(pages: DataFrame) -> DataFrame:
    """pages with their main text in a column `text` (with leading underscores where there is one)."""
    spark = pages.sparkSession
    small_batches(spark)
    made = materialize(templates(pages), "templates")
    host, of_host, template, name = (spare_name(pages, x) for x in ("host", "host_", "template", "text"))
    if (made.agg(F.sum(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        made = F.broadcast(made)
    made = made.select(F.col("host").alias(of_host), F.col("template").alias(template))

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, said in batches:
            yield pd.Series([main_text(p, _template(t)) for p, t in zip(page, said, strict=True)], dtype=object)

    joined = pages.withColumn(host, host_of()).join(made, F.col(host) == F.col(of_host), "left")
    return joined.withColumn(name, extract(F.col("html"), F.col(template))).drop(host, template, of_host)
