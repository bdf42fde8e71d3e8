"""Main text of web pages: page furniture by its elements, site templates by recurring subtrees.

Each block element of a page's main part is hashed as a subtree (its tag, its texts, the hashes of what it holds).  Spark counts, for each
host, in how many different main texts a subtree occurs.  One that occurs in at least ``share`` of them, and in so many
that a phrase which ``chance`` of all pages use would reach this by accident with a probability below a level, is site template and is
deleted, unless it holds most of the page's text.  There are two levels: pages that name their main part (an article or main element) hold
little template in it, so it takes more evidence there.  The evidence is a bound on the binomial tail, so that
it takes 2 pages at least elsewhere and 6 in an article, and there is no least size of a host.

Without counts go: elements that are furniture by their kind; elements that are named as adverts; containers named as furniture, of
which fewer names count inside an article; and a page's header, but not an article's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

SHARE, CHANCE, LEVEL, MAIN_LEVEL = 0.5, 0.1, 0.0101, 1e-6
HOT = 1_000_000  # pages of a host from which on its rows are spread

# fixed values: elements by what HTML makes of them
RAW = "script style textarea title iframe xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
FURNITURE = frozenset("nav aside form dialog menu footer head template noscript svg object canvas audio video button select".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table article div section td th caption button object".split())
# fixed values: what furniture is called
ADVERTS = "ads? advert\\w* adsense sponsor\\w*".split()
IN_ARTICLES = "promo\\w* comments? respond disqus\\w* cookies? consent gdpr newsletter subscribe signup share sharing social related recommended sidebar breadcrumbs? navbar navigation".split()
ON_PAGES = "banner menu nav header masthead footer notices? alert popup modal widget".split()
CONTAINERS = frozenset("div section aside ul ol dl table header center span".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())

_ATTRS = r"(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"  # a quote means something behind an equals sign only
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|</(?P<end>[a-z][^\s/>]*){_ATTRS}(?:>|\Z)|</(?![a-z])[^>]*(?:>|\Z)|<(?P<tag>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_named = lambda names: re.compile(rf"(?:^|[\s_-])(?:{'|'.join(names)})(?:$|[\s_-])", re.I)
ADVERT, INSIDE, OUTSIDE = _named(ADVERTS), _named(IN_ARTICLES), _named(IN_ARTICLES + ON_PAGES)


def is_furniture(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_main:
        return True
    if not attrs.strip() or tag in ("html", "body", "article", "main"):
        return False
    a = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    if "hidden" in a or a.get("role", "").lower() in ROLES:
        return True
    names = [a[k] for k in ("class", "id") if a.get(k)]
    return any(ADVERT.search(n) for n in names) or tag in CONTAINERS and any((INSIDE if in_main else OUTSIDE).search(n) for n in names)


class Page:
    """Texts of a page with the elements they lie in.

    An element lies in the one with the number ``up``, which is smaller than its own; -1 is the page.
    """

    def __init__(self, source: str):
        self.up: list[int] = []
        self.tags: list[str] = []
        self.tree: list[int] = []  # hash of the subtree
        self.parts: list[tuple[str, bool, bool, int]] = []  # text, block break before, in the main part, element
        has_main = False
        texts: list[tuple[str, bool, bool, bool, int]] = []
        stack: list[tuple[str, int, bool, bool, list[bytes]]] = []  # tag, element, in furniture, in main, what it holds
        held: dict[str, int] = {}
        at, gap = 0, True

        def close(upto: int) -> None:
            while len(stack) > upto:
                tag, e, _, _, inside = stack.pop()
                held[tag] -= 1
                digest = xxhash.xxh64_digest(b"\0".join(inside))
                self.tree[e] = int.from_bytes(digest, "little", signed=True)
                if stack:
                    stack[-1][4].append(digest)

        def text(s: str) -> None:
            nonlocal gap
            _, e, off, main, inside = stack[-1] if stack else ("", -1, False, False, [])
            texts.append((s, gap, off, main, e))
            inside.append(" ".join(s.split()).encode("utf-8", "surrogatepass"))
            gap = False

        def opened(tags) -> int | None:
            """Place of the innermost open element with one of the tags, unless a scope lies within it."""
            if any(held.get(t) for t in tags):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in tags:
                        return k
                    if stack[k][0] in SCOPES:
                        break
            return None

        for m in TOKEN.finditer(source):
            if m.start() > at:
                text(html.unescape(source[at : m.start()]))
            at = m.end()
            if m["end"]:
                tag = m["end"].lower()
                gap = gap or tag in BLOCK
                if held.get(tag):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if tag == "br":
                if not gap:
                    text(" ")
                continue
            gap = gap or tag in BLOCK
            if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            ends = CLOSES.get(tag, ()) if tag not in ENDS_P else ("p",)
            k = opened(ends) if ends else None
            if k is not None:
                close(k)
            if tag in VOID or tag == "svg" and m["attrs"].endswith("/"):
                continue
            _, e, off, main, _ = stack[-1] if stack else ("", -1, False, False, [])
            off = off or is_furniture(tag, m["attrs"], main)
            main = main or tag in ("article", "main") and not off
            has_main |= main
            self.up.append(e)
            self.tags.append(tag)
            self.tree.append(0)
            stack.append((tag, len(self.up) - 1, off, main, [tag.encode(), " ".join(m["attrs"].split()).encode("utf-8", "surrogatepass")]))
            held[tag] = held.get(tag, 0) + 1
        if at < len(source):
            text(html.unescape(source[at:]))
        close(0)
        self.has_main = has_main
        self.parts = [(s, new, not off and (main or not has_main), e) for s, new, off, main, e in texts]

    def blocks(self, without: frozenset[int] = frozenset()) -> str:
        """The main part's text without some elements."""
        out: list[list[str]] = []
        gone: list[bool] = []
        for e, up in enumerate(self.up if without else ()):
            gone.append(e in without or up >= 0 and gone[up])
        gap = True
        for s, new, kept, e in self.parts:
            gap = gap or new
            if not kept or without and e >= 0 and gone[e]:
                continue
            if gap:
                out.append([])
                gap = False
            out[-1].append(s)
        lines = (" ".join("".join(b).split()) for b in out)
        return "\n".join(x for x in lines if x)

    def sizes(self) -> list[int]:
        """Characters of the main part's text in each element, white space apart."""
        n = [0] * len(self.up)
        for s, _, kept, e in self.parts:
            if kept and e >= 0:
                n[e] += sum(map(len, s.split()))
        for e in range(len(n) - 1, -1, -1):
            if self.up[e] >= 0:
                n[self.up[e]] += n[e]
        return n

    def subtrees(self) -> dict[int, int]:
        """Hash of each block element with text of the main part, but for the main elements themselves."""
        return {e: self.tree[e] for e, n in enumerate(self.sizes()) if n and self.tags[e] in BLOCK and self.tags[e] not in ("html", "body", "article", "main")}

    def without(self, recurring: set[int]) -> str:
        if not recurring:
            return self.blocks()
        n = self.sizes()
        total = sum(sum(map(len, s.split())) for s, _, kept, _ in self.parts if kept)
        return self.blocks(frozenset(e for e, h in self.subtrees().items() if h in recurring and 2 * n[e] <= total))


def evident(n: Column, of: Column, chance: float, level: float) -> Column:
    """Whether n of ``of`` is more than chance explains: exp(-of * divergence) bounds the binomial tail."""
    p = n / of
    rest = F.when(n < of, (1 - p) * F.log((1 - p) / (1 - chance))).otherwise(0.0)
    return (p > chance) & (of * (p * F.log(p / chance) + rest) >= log(1 / level))


def extracted(pages: DataFrame, share: float = SHARE, chance: float = CHANCE, level: float = LEVEL, main_level: float = MAIN_LEVEL) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...).

    Null html counts as empty, a page without main text gets an empty one.  Pages with a null url or one without a host have no site, so
    no templates.  Repeated rows are extracted alike and count once towards a template, as do pages of one main text.  Other columns are not read.
    """
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))).alias("host")
    rows = pages.select("page_id", "url", host, "html")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                out: list[tuple] = []
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    p = Page(source or "")
                    content = xxhash.xxh64_intdigest(p.blocks()) - (1 << 63)
                    out += [(host, None, content), *((host, h, content) for h in set(p.subtrees().values()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "tree", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = []
                for source, some, most in zip(*(b.column(c).to_pylist() for c in ("html", "trees", "sure")), strict=True):
                    p = Page(source or "")
                    texts.append(p.without(set((most if p.has_main else some) or ())))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    seen = rows.where("host is not null").select("host", "html").mapInArrow(trees, "host string, tree long, content long").distinct()
    counted = saved(seen.groupBy("host", "tree").agg(F.count("*").alias("n")))
    whole = counted.where("tree is null").select("host", F.col("n").alias("pages"))
    found = lambda x: evident(F.col("n"), F.col("pages"), chance, x)
    often = counted.where(F.col("tree").isNotNull() & (F.col("n") > 1)).join(whole, "host").where((F.col("n") >= share * F.col("pages")) & found(level))
    # at least ``share`` of a host's pages hold each: no more than a page's subtrees / share of them
    often = often.groupBy("host").agg(F.collect_list("tree").alias("trees"), F.collect_list(F.when(found(main_level), F.col("tree"))).alias("sure"))
    # a host with very many pages is joined in parts; there are no more such hosts than pages / HOT
    hot = F.broadcast(rows.where("host is not null").groupBy("host").agg(F.floor(F.count("*") / HOT).alias("parts")).where("parts > 0"))
    parts = F.coalesce("parts", F.lit(0))
    often = saved(often.join(hot, "host", "left").select("host", "trees", "sure", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part")))
    rows = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts + 1)).drop("parts")
    return rows.join(often, ["host", "part"], "left").select("page_id", "url", "html", "trees", "sure").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
