"""Main text of web pages by site style trees.

Pages of a host are merged into a tree of element paths. A path's presentation importance is the
entropy of the child sequences it has over the host's pages; its content importance is one less the
mean entropy of the text blocks below it over those pages: what stands on every page is spread evenly
and counts nothing, what stands on one page counts fully. All visible branches are in the tree.

Branches with low importance are removed from each page, one by one and whatever share of the page
they are. A low branch that holds most of the host's distinct text stays whole, which keeps hosts of
copies; so does a branch on too few pages.

Tags, roles and classes that speak of menus, headers, footers, sidebars, notices, adverts, forms or
comments are prior weights: such a branch is dropped unless its text, weighed down by its prior,
outweighs the text outside all such branches: over the host, by distinct text and importance, for any
mark; on the single page for the weak marks that wrappers carry too. A marked article or main element
weighs likewise: if it holds only a small part of the text that is kept, all of that text counts, and
else what is in it. What a browser does not show (head, scripts, styles, hidden elements) is no text.

Per page the tree is kept as counts (host, path, feature), added up by partial aggregation, so a host
with a third of all pages is no task of its own. The table of low branches is broadcast if it is
measured to be small and joined otherwise.

Null and empty html give empty text. Rows may
repeat; a null url is a host of its own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import settled
from notegrid.session import broadcast_if_small

TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[a-zA-Z/!?][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# How HTML sorts its elements.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure",
            "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
            "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
P_BOUNDS = {"button", "caption", "object", "table", "td", "th", "template"}

# What is never shown, and what speaks against a branch; the weak marks stand on wrappers of main texts too.
UNSEEN_TAGS = {"canvas", "head", "iframe", "noscript", "object", "script", "style", "svg", "template", "textarea", "title"}
NOISE_TAGS = {"aside", "button", "dialog", "footer", "form", "menu", "nav", "select"}
WEAK_TAGS = {"form", "header"}
WEAK_ROLES = {"form"}
WEAK_WORDS = {"alert", "copyright", "disclaimer", "header", "legal", "login", "masthead", "modal", "notice", "notification", "overlay",
              "paywall", "promo", "promotion", "related", "share", "sharing", "social", "subscription", "topbar", "widget"}
NOISE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation",
               "search", "toolbar"}
NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb",
               "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer",
               "gdpr", "legal", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
               "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related", "replies",
               "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
               "subscription", "toolbar", "widget"}
HEAD_WORDS = {"header", "masthead", "topbar"}
MAIN_NOISE = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "recommended", "reply", "sponsored"}
# Weights of marked branches; the characters from which a page alone may overrule weak marks; the share of the
# kept text from which a marked article is taken for all of it; the share of a group's heaviest branch that stands beside it.
WEAK, STRONG = 0.25, 0.05
LEAST_CHARS = 200
MAIN_SHARE = 0.25
BESIDE = 0.25

DEPTH = 48  # deeper elements share the path of the 48th


class Page:
    """Elements as parallel lists and text blocks (element, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.unseen, self.main, self.depth = [-1], [""], [""], [False], [False], [0]
        self.region, self.prior = [0], [1.0]  # nearest marked element, product of the marks' weights down to here
        self.children: dict[int, list[str]] = defaultdict(list)
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes else {}
        marks = f"{names.get('class', '')} {names.get('id', '')}"
        words = {w.lower() for w in NAME_PART.findall(marks)} if marks != " " else set()
        role = names.get("role", "").lower()
        article = tag in ("article", "main") or role == "main"
        inside = self.main[parent]
        unseen, weight = self.unseen[parent], 1.0
        if tag not in ("html", "body"):
            unseen = (unseen or tag in UNSEEN_TAGS or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
                      or "display:none" in names.get("style", "").replace(" ", "").lower())
            listed = words & (MAIN_NOISE if article else NOISE_WORDS)
            top = not inside and not article
            heads = words & HEAD_WORDS if top else set()
            header = top and tag == "header"
            if (tag in NOISE_TAGS - WEAK_TAGS or role in NOISE_ROLES - WEAK_ROLES or listed - (set() if article else WEAK_WORDS)):
                weight = STRONG
            elif tag in NOISE_TAGS or role in NOISE_ROLES or listed or heads or header:
                weight = WEAK
        sign = f"{tag}.{'-'.join(sorted(words))}" if words else tag
        depth = self.depth[parent] + 1
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(f"{self.path[parent]}>{sign}" if depth <= DEPTH else self.path[parent])
        self.unseen.append(unseen)
        self.main.append(inside or article)
        self.region.append(len(self.tag) - 1 if weight < 1 else self.region[parent])
        self.prior.append(self.prior[parent] * weight)
        self.depth.append(depth)
        kids = self.children[parent]
        if not kids or kids[-1] != sign:  # repeated siblings count once
            kids.append(sign)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        held: list[str] = []

        def flush() -> None:
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                held.clear()
                if text:
                    self.blocks.append((stack[-1][1], text))

        def close(names: set[str], bounds: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    flush()
                    del stack[k:]
                    return
                if stack[k][0] in bounds:
                    return

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                held.append(source[at:])
                break
            if m.start() > at:
                held.append(source[at:m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            tag = name.lower()
            if m[1]:
                if tag in INLINE:  # an inline end tag closes nothing beyond the block it stands in
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            if stack[k][1] != stack[k - 1][1]:
                                flush()
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                elif tag == "br":
                    held.append("\n")
                else:
                    flush()
                    close({tag}, set())
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag in VOID:
                if tag == "br":
                    held.append("\n")
                elif tag == "hr":
                    flush()
                continue
            if tag in INLINE:
                here = stack[-1][1]
                if m[3]:
                    element = self._open(here, tag, m[3])
                    if (self.unseen[element] and not self.unseen[here]) or self.region[element] == element:
                        flush()
                        here = element
                stack.append((tag, here))
                continue
            flush()
            if tag == "body" or (tag in CLOSES_P and stack[-1][0] == "head"):
                close({"head"}, {"body"})
            if tag in CLOSES_P:
                close({"p"}, P_BOUNDS)
            if tag in SIBLINGS:
                for _ in range(2):
                    close(SIBLINGS[tag], BOUNDS[tag])
            stack.append((tag, self._open(stack[-1][1], tag, m[3])))
            if m[3] and m[3].endswith("/") and tag in ("path", "circle", "rect", "g", "use"):
                stack.pop()
        flush()

    def features(self) -> Counter:
        """(path, kind, feature): child sequences of elements and text blocks."""
        out: Counter = Counter()
        for e in range(1, len(self.tag)):
            if not self.unseen[e]:
                out[self.path[e], 0, " ".join(self.children.get(e, ()))] += 1
        for e, text in self.blocks:
            if not self.unseen[e]:
                out[self.path[e], 1, text] += 1
        return out

    def marks(self) -> dict[str, tuple[int, float]]:
        """Per path the length of the path of its nearest marked element, 0 if there is none, and the prior weight."""
        return {self.path[e]: (len(self.path[self.region[e]]), self.prior[e]) for e in range(1, len(self.tag)) if not self.unseen[e]}

    def _lifted(self, blocks: list[tuple[int, str]], live: frozenset[str] | set[str]) -> set[int]:
        """Marked elements whose text stays: those the host's tree speaks for, and weak ones that outweigh the rest of this page."""
        held: Counter = Counter()
        for e, text in blocks:
            held[self.region[e]] += len(text)
        lifted = {r for r in held if r and self.path[r] in live}
        base = held[0] + sum(held[r] for r in lifted)
        for prior in sorted({self.prior[r] for r in held if r and r not in lifted}, reverse=True):
            if prior in (WEAK, WEAK * WEAK):
                group = [r for r in held if r and r not in lifted and self.prior[r] == prior]
                heaviest = max(held[r] for r in group)
                group = [r for r in group if held[r] >= max(LEAST_CHARS, BESIDE * heaviest) and held[r] * prior > base]
                lifted.update(group)
                base += sum(held[r] for r in group)
        for r in list(lifted):
            while r:
                lifted.add(r)
                r = self.region[self.parent[r]]
        return lifted

    def text(self, low: frozenset[str] | set[str] = frozenset(), live: frozenset[str] | set[str] = frozenset()) -> str:
        gone = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            gone[e] = gone[self.parent[e]] or self.unseen[e] or self.path[e] in low
        blocks = [(e, t) for e, t in self.blocks if not gone[e]]
        lifted = self._lifted(blocks, live) | {0}
        kept = [(e, t) for e, t in blocks if self.region[e] in lifted]
        main = [(e, t) for e, t in kept if self.main[e]]
        if sum(len(t) for _, t in main) >= MAIN_SHARE * sum(len(t) for _, t in kept):
            kept = main or kept
        return " ".join(t for _, t in kept)


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/]*://([^/?#]*)", 1))


def low_branches(pages: DataFrame, threshold: float = 0.2, least_pages: int = 8, presentation: float = 0.1,
                 most_distinct: float = 0.5) -> DataFrame:
    """(host, paths, live): branches of each host's tree whose importance is under ``threshold``, and marked ones that are content.

    Only branches on ``least_pages`` distinct pages are judged. A low branch with ``most_distinct`` of
    the host's distinct text, or inside such a one, is not listed.
    """
    def count(batches):
        for batch in batches:
            seen: dict = {}
            on: dict = defaultdict(set)  # the least hashes of the pages that have a path; more than least_pages tell nothing new
            marked: dict = {}
            for page, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html"))):
                tree = Page(source or "")
                for (path, kind, feature), n in tree.features().items():
                    key = (host, path, kind, feature if kind == 0 else hash_text(feature))
                    got = seen.setdefault(key, [0, 0.0, len(feature) if kind else 0])
                    got[0] += n
                    got[1] += n * math.log(n)
                name = hash_text(str(page) if page is not None else source or "")
                for path, mark in tree.marks().items():
                    known = marked.setdefault((host, path), mark)
                    marked[host, path] = (max(known[0], mark[0]), min(known[1], mark[1]))
                    least = on[host, path]
                    least.add(name)
                    if len(least) > least_pages:
                        least.remove(max(least))
            for (host, path), names in on.items():
                for name in names:
                    seen[host, path, 2, name] = [1, 0.0, 0]
            keys = list(seen)
            for at in range(0, len(keys), 20_000):
                part = keys[at:at + 20_000]
                marks = [marked.get(k[:2], (0, 1.0)) for k in part]
                yield pa.RecordBatch.from_pydict({
                    "host": pa.array([k[0] for k in part], pa.string()), "path": pa.array([k[1] for k in part], pa.string()),
                    "kind": pa.array([k[2] for k in part], pa.int32()), "feature": pa.array([str(k[3]) for k in part], pa.string()),
                    "n": pa.array([seen[k][0] for k in part], pa.int64()), "nlogn": pa.array([seen[k][1] for k in part], pa.float64()),
                    "chars": pa.array([seen[k][2] for k in part], pa.int64()),
                    "region": pa.array([m[0] for m in marks], pa.int32()), "prior": pa.array([m[1] for m in marks], pa.float64())})

    rows = (pages.select("page_id", host().alias("host"), "html")
            .mapInArrow(count, "host string, path string, kind int, feature string, n long, nlogn double, chars long, region int, prior double"))
    # Spread of a feature over pages: log N less the mean log of its number on each page.
    each = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"), F.max("chars").alias("chars"),
                                                               F.max("region").alias("region"), F.min("prior").alias("prior"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    spread = F.log("n") - F.col("nlogn") / F.col("n")
    node = each.groupBy("host", "path").agg(
        F.coalesce(F.sum(F.when(style, F.col("n"))), F.lit(0)).alias("m"), F.sum(F.when(style, F.col("n") * F.log("n"))).alias("m_log"),
        F.coalesce(F.sum(F.when(content, spread)), F.lit(0.0)).alias("spread"),
        F.sum(content.cast("int")).alias("blocks"), F.sum("chars").alias("chars"), F.sum((F.col("kind") == 2).cast("int")).alias("pages"),
        F.max("region").alias("region"), F.min("prior").alias("prior"))
    many = F.col("m") > 1
    node = node.withColumn("shape", F.when(many, (F.log("m") - F.col("m_log") / F.col("m")) / F.log("m")).otherwise(1.0))
    node = settled(node.withColumn("spread", F.when(many, F.least(F.col("spread") / F.log("m"), F.col("blocks").cast("double"))).otherwise(0.0)))
    # Text outside marked branches and in each of them, by importance.
    own = F.when(F.col("blocks") > 0, F.col("chars") * (1 - F.col("spread") / F.col("blocks"))).otherwise(0.0)
    regions = (node.withColumn("marked", F.substring("path", F.lit(1), F.col("region"))).groupBy("host", "marked")
               .agg(F.sum(own).alias("weight"), F.sum("chars").alias("chars"), F.min("prior").alias("prior"), F.max("pages").alias("pages")))
    plain = F.col("marked") == ""
    hosts = settled(regions.groupBy("host").agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum(F.when(plain, F.col("weight"))), F.lit(0.0)).alias("base"),
                                                F.max(F.when(~plain, F.col("weight"))).alias("heaviest")))
    live = (regions.filter(~plain & (F.col("pages") >= least_pages)).join(hosts, "host")
            .filter((F.col("weight") * F.col("prior") > F.col("base")) & (F.col("weight") >= BESIDE * F.col("heaviest")))
            .groupBy("host").agg(F.sort_array(F.collect_set("marked")).alias("live")))
    # What a branch holds is the sum over the paths below it: each path counts for all its beginnings.
    parts = F.filter(F.split("path", ">"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit(">"), F.array_join(F.slice(parts, F.lit(1), k), ">")))
    below = (node.filter("blocks > 0 AND path != ''").select("host", F.explode(above).alias("path"), "spread", "blocks", F.col("chars").alias("held"))
             .groupBy("host", "path").agg(F.sum("spread").alias("spread"), F.sum("blocks").alias("blocks"), F.sum("held").alias("held")))
    importance = presentation * F.col("shape") + (1 - presentation) * (1 - F.col("spread") / F.col("blocks"))
    low = (node.filter(many).select("host", "path", "pages", "shape").join(below, ["host", "path"])
           .filter((F.col("pages") >= least_pages) & (importance < threshold)).join(hosts, "host")
           .groupBy("host").agg(F.collect_set("path").alias("all"), F.collect_set(F.when(F.col("held") >= most_distinct * F.col("all_chars"), F.col("path"))).alias("safe")))
    paths = F.filter("all", lambda p: ~F.exists("safe", lambda s: (p == s) | F.startswith(p, F.concat(s, F.lit(">")))))
    low = low.select("host", F.sort_array(paths).alias("paths"))
    return low.join(live, "host", "full")


def hash_text(text: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def extract(pages: DataFrame, **tree) -> DataFrame:
    """page_id, text and n_chars of every page."""
    low = broadcast_if_small(low_branches(pages, **tree))
    rows = pages.select("page_id", host().alias("host"), "html").join(low, "host", "left").select("page_id", "html", "paths", "live")
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches):
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            out = []
            for source, *lists in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "live"))):
                low, live = (known.setdefault(key, frozenset(key)) for key in (tuple(x or ()) for x in lists))
                out.append(Page(source or "").text(low, live))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "text": pa.array(out, pa.string()),
                                              "n_chars": pa.array([len(t) for t in out], pa.int64())})
    return rows.mapInArrow(work, f"page_id {kind}, text string, n_chars long")
