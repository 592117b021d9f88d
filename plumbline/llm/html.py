"""Operator 10, HTML extraction with removal of site templates.

Every page is parsed into a tree of elements. Each element that holds a block of its own is hashed with all it contains; Spark counts on how many different pages of a host each hash occurs, and
subtrees found on at least ``MIN_PAGES`` of them and on ``MIN_SHARE`` of all different pages of the host are deleted.
Pages of a host with the same main text count once, so that copies of a page do not make a template of it. Of what is
left, the article's text is taken: inside ``<article>`` or ``<main>`` if the page has one, else the body; menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role and
class name. Elements inside the article count too, so that boxes which a host repeats in its articles go; the article
element itself does not, and an article that a host shows on many pages counts once and stays whole.

Hot hosts are safe: counts are aggregated before the shuffle, and only hashes on MIN_PAGES rows of a host go on to the
count of different pages; pages meet them in a join on (host, hash).

Defined cases: null or empty html gives empty text; a null url is a host of its own (empty); repeated rows count as one
page and each get the text; html without any markup is one block; unclosed and stray tags are repaired, of any number and
depth: time and memory grow with the length of the html alone; an empty table gives an empty table; extra columns are
kept, whatever their names (text and n_chars are overwritten).
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.llm.common import add_columns, read, stored
from plumbline.llm.urls import url_host

MIN_PAGES, MIN_SHARE = 5, 0.5

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body p div section article main aside nav header footer h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address hr details summary fieldset form center".split()
)
ENDS_P = BLOCKS - {"caption", "thead", "tbody", "tfoot", "tr", "td", "th", "html", "body", "li", "dt", "dd"}
DROPPED = frozenset("head title script style noscript template nav aside footer form iframe object embed svg canvas audio video map select option button textarea input dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr
    notice notices alert popup modal overlay sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comments comment
    disqus replies reply newsletter subscribe signup login share sharing social related recommended skip toolbar widget widgets pagination pager copyright""".split()
)
#: Elements whose recurrence on a host makes them template.
COUNTED = frozenset("p div section aside nav header footer h1 h2 h3 h4 h5 h6 ul ol li dl table blockquote pre figure form center details address".split())
CONTENT = ("article", "main")


#: A comment, a declaration, a tag (slash, name, attributes), a tag with unpaired quotes (skipped), or text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|</?[a-zA-Z][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is no markup, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
NAMED = re.compile(r"\b(?:class|id|role|hidden)\b", re.I)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Page:
    """Elements in document order: tag, parent, attributes, and their texts and children in order."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attrs, self.kids = ["#root"], [-1], [{}], [[]]
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # where in ``open`` each tag stands, so that nothing is searched for
        at, size, token = 0, len(html), TOKEN.match
        while at < size:
            m = token(html, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    self.kids[self.open[-1]].append(unescape(text) if "&" in text else text)
            elif m[1]:
                self.end(tag.lower())
            else:
                tag = tag.lower()
                self.start(tag, m[3])
                if tag in RAW:
                    close = RAW[tag].search(html, at)
                    at = close.start() if close else size

    def _pop_to(self, tag: str, stop: frozenset[str] | set[str]) -> None:
        """Close the innermost open ``tag`` and what is in it, unless an element of ``stop`` stands between."""
        found = self.at.get(tag)
        if not found or any(self.at.get(s) and self.at[s][-1] > found[-1] for s in stop):
            return
        for node in reversed(self.open[found[-1] :]):
            self.at[self.tags[node]].pop()
            self.open.pop()

    def start(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            self._pop_to("p", {"div", "section", "article", "main", "aside", "nav", "header", "footer", "li", "td", "th", "blockquote", "form", "button", "object"})
        if tag == "li":
            self._pop_to("li", {"ul", "ol"})
        elif tag in ("dt", "dd"):
            self._pop_to("dt", {"dl", "dd"})
            self._pop_to("dd", {"dl"})
        elif tag in ("td", "th"):
            self._pop_to("td", {"tr", "table"})
            self._pop_to("th", {"tr", "table"})
        elif tag == "tr":
            self._pop_to("tr", {"table"})
        elif tag == "option":
            self._pop_to("option", {"select"})
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.attrs.append({k.lower(): unescape(v or w or x) for k, v, w, x in ATTRIBUTE.findall(attrs)} if attrs and NAMED.search(attrs) else {})
        self.kids.append([])
        self.kids[self.open[-1]].append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        self._pop_to(tag, frozenset(CONTENT) - {tag} if tag not in ("html", "body") else frozenset())

    def dropped(self, node: int, in_article: bool) -> bool:
        tag, attrs = self.tags[node], self.attrs[node]
        if tag in DROPPED or "hidden" in attrs or attrs.get("role", "").lower() in DROPPED_ROLES:
            return True
        if tag == "header":
            return not in_article
        if tag in ("html", "body", *CONTENT) and not in_article:
            return False
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().replace("-", " ").replace("_", " ").split()
        return any(n in DROPPED_NAMES or n == "header" and not in_article for n in names)

    def regions(self) -> list[int]:
        """The outermost article or main elements that no dropped element holds; the root if there is none."""
        out = []
        for kind in CONTENT:
            inside = [False] * len(self.tags)
            for i in range(1, len(self.tags)):
                p = self.parents[i]
                inside[i] = inside[p] or self.tags[i] == kind or self.dropped(i, False)
                if self.tags[i] == kind and not inside[p] and not self.dropped(i, False):
                    out.append(i)
            if out:
                break
        return out or [0]

    def parsed(self) -> tuple[list[str], list[tuple[int, int, int]], list[int], int]:
        """Pieces of main text; counted elements around them as (hash, first piece, last piece); hashes of counted elements outside the article that are around no piece; and the hash of the main text."""
        regions = self.regions()
        n = len(self.tags)
        inside = [False] * n
        for r in regions:
            inside[r] = r > 0
        whole_of = set(regions)
        for i in range(1, n):
            inside[i] |= inside[self.parents[i]]
        digest: list[int] = [0] * n
        filled = [False] * n
        counted: dict[int, int] = {}
        for i in range(n - 1, 0, -1):  # children come after their parents
            if i in whole_of:  # what holds an article is known by the rest of its content
                continue
            h = xxhash.xxh3_64(self.tags[i])
            for k in self.kids[i]:
                if isinstance(k, int):
                    h.update(digest[k].to_bytes(8, "little"))
                    filled[i] |= filled[k]
                elif k.strip():
                    h.update("\0" + " ".join(k.split()))
                    filled[i] = True
            digest[i] = h.intdigest()
            if filled[i] and self.tags[i] in COUNTED:
                counted[i] = signed(digest[i])

        pieces: list[str] = []
        nodes: list[tuple[int, int, int]] = []
        now: list[str] = []
        begun: dict[int, int] = {}

        def close() -> None:
            line = " ".join("".join(now).split())
            if line:
                pieces.append(line)
            now.clear()

        for region in regions:
            todo: list = [region]
            while todo:
                k = todo.pop()
                if isinstance(k, str):
                    now.append(k)
                elif k < 0:
                    close()
                    if -k in begun and begun[-k] < len(pieces):
                        nodes.append((counted[-k], begun[-k], len(pieces) - 1))
                elif k == region or not self.dropped(k, region > 0):
                    if self.tags[k] in BLOCKS:
                        close()
                        if k in counted:
                            begun[k] = len(pieces)
                        todo.append(-k)
                    elif self.tags[k] == "br":
                        now.append(" ")
                    todo += reversed(self.kids[k])
            close()
        whole = "\n".join(pieces)
        if not nodes:
            pieces = [whole]
        # inside an article only what stands around its text can matter
        others = {h for i, h in counted.items() if not inside[i]} - {h for h, _, _ in nodes}
        return pieces, nodes, list(others), signed(xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")))


PARSED = "pieces array<string>, nodes array<struct<h: bigint, a: int, b: int>>, others array<bigint>, content bigint"


def parse(pages: DataFrame, kept: list[str], html: str = "html") -> DataFrame:
    """Each page's pieces and elements, in place of its html."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        done = [Page(h or "").parsed() for h in batch[html]]
        return pd.DataFrame({"pieces": [p for p, _, _, _ in done], "nodes": [[{"h": h, "a": a, "b": b} for h, a, b in n] for _, n, _, _ in done], "others": [o for _, _, o, _ in done], "content": [c for _, _, _, c in done]})

    return add_columns(pages, kept, [html], PARSED, run)


def without(pieces: list[str], nodes: list[tuple[int, int, int]], template: set[int]) -> str:
    """The pieces around which no element is template."""
    depth = [0] * (len(pieces) + 1)
    for h, a, b in nodes:
        if h in template:
            depth[a] += 1
            depth[b + 1] -= 1
    return "\n".join(p for p, d in zip(pieces, accumulate(depth), strict=False) if not d)


def extract(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` without its html, plus text and n_chars."""
    own = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    pad = "_" * (1 + max(map(len, own), default=0))
    kept = F.struct(*[ref(c).alias(c) for c in own], F.lit(0).alias(pad)).alias("kept")  # under one name, which clashes with none of ours
    rows = pages.select(kept, ref(html).alias("html"), url_host(ref(url)).alias("host"), F.monotonically_increasing_id().alias("row_id"))
    rows = stored(parse(rows, ["kept", "row_id", "host"]), "parsed")  # written once, so that row_id stays what it is
    site = F.xxhash64("host").alias("site")
    around = F.transform(F.array_distinct(F.transform("nodes", lambda x: x["h"])), lambda h: F.struct(h.alias("hash"), F.lit(True).alias("around")))
    others = F.transform("others", lambda h: F.struct(h.alias("hash"), F.lit(False).alias("around")))
    found = rows.select("row_id", site, "content", F.explode(F.concat(around, others)).alias("e")).select("row_id", "site", "content", "e.hash", "e.around")
    often = stored(found.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("site", "hash"), "often")
    found = stored(found.join(often, ["site", "hash"]), "found")
    on = found.select("site", "hash", "content").distinct().groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages_of = rows.select(site, "content").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    template = stored(on.join(pages_of, "site").where(F.col("n") >= min_share * F.col("of")).select("site", "hash"), "template")
    # pages without elements around their text have no piece that could be template
    parts = F.size("nodes") > 0
    # stored, so that its size is known: the texts are shuffled only if it cannot be broadcast
    mine = stored(found.where("around").join(template, ["site", "hash"]).groupBy("row_id").agg(F.collect_set("hash").alias("template")), "mine")

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        each = zip(batch["pieces"], batch["nodes"], batch["template"], strict=True)
        return pd.DataFrame({"text": [without(list(p), [(x["h"], x["a"], x["b"]) for x in n], set(t.tolist())) for p, n, t in each]})

    met = rows.where(parts).join(mine, "row_id", "left")
    whole = rows.where(~parts).select("kept", "pieces").unionByName(met.where("template is null").select("kept", "pieces")).select("kept", F.array_join("pieces", "\n").alias("text"))
    less = add_columns(met.where("template is not null"), ["kept"], ["pieces", "nodes", "template"], "text string", cut)
    out = whole.unionByName(less)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in own], "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
