"""HTML extraction by equivalence classes of tokens, over the pages of a host.

Pages of one host come from one template.  A page is a sequence of tokens:
start tags of block elements, told apart by the path they stand at, and blocks
of text.

1. Tokens whose occurrence vectors over the host's pages are equal (as often on
   each page) form an equivalence class.  Classes of at least two tokens that
   at least half of the pages hold make the host's template.
2. The template is laid over each page.  A class is valid there if its tokens
   stand in order, once or repeatedly, and if it nests: each of its tuples lies
   in one gap between two tokens of the class around it, always the same gap.
   What tokens of valid classes leave over are the slots.
3. The region of a host's article is the deepest container that holds most of
   the text of all slots.  If a fair part of the slots stands in ``article`` or
   ``main``, these name it.  A page that the region is not found on, or that has
   no template, is judged by its own text in the same way.
4. All blocks of the region are the text, but for what is the template's own:
   inner containers without a slot, and text before the first slot or after the
   last.  Template text between slots stays, as does all text that the markup
   puts into ``article`` or ``main``; and if more than a fifth of a region would
   go, its pages are near copies of each other, and all stays.

Elements that are furniture by their nature (nav, aside, form ...) go, with
those whose class or id consists of nothing but words for furniture.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.scratch import Scratch
from textsieve.session import spread

#: Share of a host's pages that a class occurs on, and its least number of tokens.
SUPPORT, TOKENS = 0.5, 2
#: Share of the slots' text that the region holds, and that ``article`` and ``main`` hold to name it.
REGION_SHARE, NAMED_SHARE = 0.6, 0.2
#: Largest share of a region's text that the template's own text may have.
REPEATED = 0.2
#: Largest template table that is broadcast, in tokens; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOISE_TAGS = frozenset("head nav footer aside form menu dialog script style noscript template iframe object embed applet svg canvas audio video select option datalist button textarea fieldset title xmp noembed noframes map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion promoted sponsor sponsored sponsors "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header footer masthead topbar sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond responses replies reply discussion copyright disclaimer legal".split()
)
NOISE_STARTS = ("advert", "breadcrumb", "newsletter", "navbar", "sidebar", "sidenav", "sponsor", "topnav")
#: Words that may stand beside those: where and in what shape furniture stands.
NEUTRAL = frozenset(
    "site page main global top bottom left right post posts article articles story stories entry entries user users reader readers bar box list lists link links button buttons container wrapper wrap "
    "inner outer block section area panel item items group row column unit slot holder primary secondary mobile desktop sticky fixed js icon icons media policy message form".split()
)
#: Blocks that make up a text; other block elements are containers.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th pre blockquote figure figcaption details summary address".split())
ROOTS = frozenset(("html", "body", "article", "main"))
#: Start tags that end an open element: (what they end, where the search stops).
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
MARKED = re.compile(r"class|id|role|hidden|style", re.I)


def _names_furniture(label: str) -> bool:
    """Whether a class or id consists of words for furniture, with neutral ones at most."""
    words = [w.lower() for w in WORD.findall(label)]
    told = [w in NOISE_WORDS or w.startswith(NOISE_STARTS) for w in words]
    return any(told) and all(t or w in NEUTRAL or len(w) == 1 or w.isdigit() for t, w in zip(told, words, strict=True))


@lru_cache(maxsize=1 << 14)
def _noisy(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is furniture by its markup, and its class and id as part of its path."""
    noise = name in NOISE_TAGS
    if not MARKED.search(attributes):
        return noise, ""
    label = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            label.append(value)
            telling = name not in ROOTS and (key == "class" or name not in PARTS)  # ids of headings are made from their words
            noise = noise or telling and any(map(_names_furniture, value.split()))
        elif key == "role" and value.lower() in NOISE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            noise = True
    return noise, "." + " ".join(label) if label else ""


def hash64(s: str) -> int:
    """Signed 64-bit hash, the same on every worker."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


@dataclass
class Page:
    """Block elements as a tree, parents before children (0 is the page), and tokens in order: (element, None for its start tag or a text)."""

    parent: list[int] = field(default_factory=lambda: [0])
    role: list[int] = field(default_factory=lambda: [0])  #: hash of the path
    depth: list[int] = field(default_factory=lambda: [0])
    noise: list[bool] = field(default_factory=lambda: [False])
    part: list[bool] = field(default_factory=lambda: [False])
    name: list[str] = field(default_factory=lambda: [""])
    tokens: list[tuple[int, str | None]] = field(default_factory=list)

    def keys(self) -> list[int]:
        """A hash of each token, the same on all pages that hold it at the same path."""
        return [self.role[i] if text is None else hash64(f"{self.role[i]}={text}") for i, text in self.tokens]

    def below(self, sizes: list[int]) -> list[int]:
        """Sums of ``sizes`` over each element and what it holds."""
        out = list(sizes)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def inside(self, tops: set[int]) -> list[bool]:
        """Whether each element is one of ``tops`` or stands in one."""
        out = [0 in tops]
        for i in range(1, len(self.parent)):
            out.append(out[self.parent[i]] or i in tops)
        return out


def parse(page: str) -> Page:
    """Tokens of a page; the time grows with its length, whatever is left unclosed or nested."""
    out = Page()
    stack, open_ = [0], Counter()
    children: dict[tuple[int, str], int] = {}
    buffer: list[str] = []
    muted, depth = "", 0  # inline furniture: its name, and how often it is open

    def flush() -> None:
        nonlocal muted
        muted = ""
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.tokens.append((stack[-1], text))

    def pop_to(name_at: int) -> None:
        while len(stack) > name_at:
            open_[out.name[stack.pop()]] -= 1

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if not muted and (page[m.start()] != "<" or at - m.start() == 1):
                buffer.append(m[0])
            continue
        name, attributes = name.lower(), m[3] or m[6] or ""
        closing = (m[1] if m[2] else m[4]) == "/"
        if name in INLINE:
            if muted:
                depth += (name == muted and name not in VOID) * (-1 if closing else 1)
                if not depth:
                    muted = ""
            elif name == "br":
                buffer.append(" ")
            elif not closing and name not in VOID and _noisy(name, attributes)[0]:
                muted, depth = name, 1  # until it ends, or the block does
            continue
        if closing:
            if open_[name] > 0:
                flush()
                k = len(stack) - 1
                while out.name[stack[k]] != name:
                    k -= 1
                pop_to(k)
            continue
        flush()
        if out.name[stack[-1]] == "p":
            pop_to(len(stack) - 1)
        if name in ENDS:
            ends, stops = ENDS[name]
            if any(open_[x] > 0 for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if out.name[stack[k]] in stops:
                        break
                    if out.name[stack[k]] in ends:
                        pop_to(k)
                        break
        noise, label = _noisy(name, attributes)
        up = stack[-1]
        named = open_["article"] > 0
        noise = noise or out.noise[up] or name == "article" and named or name == "header" and not named and not open_["main"]
        part = name in PARTS and not (name == "td" and label)  # a cell with a name may hold a whole column of a layout
        path = f"{out.role[up]}/{name}{label}"
        if not part:  # containers of one name are told apart by their order
            n = children[up, path] = children.get((up, path), 0) + 1
            path = f"{path}[{n}]"
        node = len(out.parent)
        for column, value in ((out.parent, up), (out.role, hash64(path)), (out.depth, out.depth[up] + 1), (out.noise, noise), (out.part, part), (out.name, name)):
            column.append(value)
        out.tokens.append((node, None))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                close = page.find(">", at)
                at = size if close < 0 else close + 1
        elif name not in VOID and not (m[3] or "").rstrip().endswith("/"):
            stack.append(node)
            open_[name] += 1
    flush()
    return out


class Template:
    """Classes of a host, each its tokens in their order, ready to be laid over pages."""

    def __init__(self, classes: list[list[int]]):
        self.size = [len(c) for c in classes]
        self.place = {token: (c, j) for c, tokens in enumerate(classes) for j, token in enumerate(tokens)}

    def lay(self, keys: list[int]) -> set[int]:
        """Classes that are valid on a page with these tokens."""
        hits = [self.place[k] for k in keys if k in self.place]
        due, wrong = [0] * len(self.size), set()
        for c, j in hits:  # tuples are complete and in order
            if j != due[c]:
                wrong.add(c)
            due[c] = (j + 1) % self.size[c]
        wrong |= {c for c, j in enumerate(due) if j}
        gap: dict[int, tuple[int, int]] = {}
        open_: list[list[int]] = [[-1, 0]]  # unfinished tuples, the outermost first: class, tokens so far
        for c, j in hits:
            if c in wrong:
                continue
            if j == 0:
                around = (open_[-1][0], open_[-1][1])
                if gap.setdefault(c, around) != around:
                    wrong.add(c)  # its tuples stand in several gaps
                    continue
                open_.append([c, 0])
            else:
                while open_[-1][0] != c:  # what is unfinished here straddles this class
                    wrong.add(open_.pop()[0])
            open_[-1][1] += 1
            if open_[-1][1] == self.size[c]:
                open_.pop()
        return set(gap) - wrong

    def own(self, page: Page) -> list[bool]:
        """Whether each token of a page is one of the template."""
        keys = page.keys()
        valid = self.lay(keys)
        return [k in self.place and self.place[k][0] in valid for k in keys]


def _slots(page: Page, own: list[bool] | None) -> list[int]:
    """Characters of slots that stand directly in each element, furniture left out."""
    sizes = [0] * len(page.parent)
    for k, (i, text) in enumerate(page.tokens):
        if text is not None and not page.noise[i] and not (own and own[k]):
            sizes[i] += len(text)
    return sizes


def _articles(page: Page, mass: list[int]) -> set[int]:
    """The heaviest article and its siblings, or else the heaviest ``main``; none without text."""
    for name in ("article", "main"):
        if found := [i for i, x in enumerate(page.name) if x == name and not page.noise[i] and mass[i]]:
            top = page.parent[max(found, key=lambda i: (mass[i], -i))]
            return {i for i in found if page.parent[i] == top}
    return set()


def _region(page: Page, mass: list[int]) -> set[int]:
    """Region of a page by its own text."""
    named = _articles(page, mass)
    if sum(mass[i] for i in named) >= NAMED_SHARE * mass[0]:
        return named
    return {max((i for i, part in enumerate(page.part) if not part and mass[i] >= REGION_SHARE * mass[0]), key=lambda i: (page.depth[i], -i))}


def extract(html: str | None, template: Template | None, region: int | None = None) -> str:
    """Main text of a page: its blocks, joined by a line feed.

    region: path of the host's region, 0 if ``article`` or ``main`` name it, None if it is not known.
    """
    page = parse(html or "")
    own = template.own(page) if template else None
    slots, texts = _slots(page, own), _slots(page, None)
    mass, all_mass = page.below(slots), page.below(texts)
    if not all_mass[0]:
        return ""
    if not mass[0]:  # a page of nothing but template text: a copy of others
        own, mass = None, all_mass
    tops = _articles(page, mass) or _articles(page, all_mass) if region == 0 else {i for i, role in enumerate(page.role) if i and role == region and mass[i]}
    tops = tops or _region(page, mass)
    inside = page.inside(tops)
    found = [k for k, (i, text) in enumerate(page.tokens) if text is not None and inside[i] and not page.noise[i]]
    if own and not any(page.name[i] in ("article", "main") for i in tops):
        free = [k for k in found if not own[k]]
        holder = [0] * len(page.parent)  # nearest container
        for i in range(1, len(holder)):
            holder[i] = holder[page.parent[i]] if page.part[i] else i
        kept = [k for k in found if not own[k] or free and free[0] < k < free[-1] and (holder[page.tokens[k][0]] in tops or mass[holder[page.tokens[k][0]]])]
        size = lambda ks: sum(len(page.tokens[k][1]) for k in ks)
        if size(found) - size(kept) <= REPEATED * size(found):
            found = kept
    return "\n".join(page.tokens[k][1] for k in found)


def _rows(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cut = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cut, columns, strict=True)], names=[n for n, _ in columns])


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, total, low, high, place): partial sums over the pages of a batch.

    low, high: sums over the pages of two hashes of (page, occurrences), which
    stand for the occurrence vector.  The token 0 counts the host's pages.
    """
    kinds = [("host", pa.string()), *((c, pa.int64()) for c in ("token", "pages", "total", "low", "high", "place"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not host:
                    continue
                name, first = hash64(page or ""), {0: 0}
                counts = Counter(keys := parse(page or "").keys())
                for place, key in enumerate(keys):
                    first.setdefault(key, place)
                counts[0] = 1
                for token, n in counts.items():
                    x = hash64(f"{name} {n}")
                    own = sums.setdefault((host, token), [0] * 6)
                    for j, value in enumerate((1, n, x & 0x7FFFFFFF, x >> 33 & 0x7FFFFFFF, first[token])):
                        own[j] += value
            yield _rows(kinds, [(*k, *v[:5]) for k, v in sums.items()])

    return pages.select("host", "html").mapInArrow(run, "host string, token long, pages long, total long, low long, high long, place long")


def classes_of(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, classes array<array<long>>): the template of each host with at least two pages.

    Tokens of a class stand in the order of their first places.  Each of them
    is on SUPPORT of the pages, so a host has at most as many as two pages have
    on average.
    """
    sums = token_vectors(pages).groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "place")])
    sums = scratch.save(sums.where("token = 0 or pages >= 2"), "sums")
    hosts = sums.where("token = 0 and pages >= 2").select("host", F.col("pages").alias("n"))
    common = sums.where("token <> 0").join(hosts, "host").where(f"pages >= {SUPPORT} * n")
    grouped = common.groupBy("host", "low", "high", "pages", "total").agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("tokens"))
    return grouped.where(F.size("tokens") >= TOKENS).groupBy("host").agg(F.collect_list(F.transform("tokens", lambda t: t["token"])).alias("classes"))


def _with_templates(pages: DataFrame, templates: DataFrame, small: bool) -> DataFrame:
    return pages.join(F.broadcast(templates) if small else templates, "host", "left")


class _Known:
    """Templates that a task has met; those of the latest hosts are kept."""

    def __init__(self):
        self.held: dict[str, Template] = {}

    def get(self, host: str | None, classes: pa.Scalar) -> Template | None:
        if not classes.is_valid:
            return None
        if host not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            self.held[host] = Template(classes.as_py())
        return self.held[host]


def regions_of(pages: DataFrame) -> DataFrame:
    """(host, region) of rows (host, html, classes): path of the container that holds the slots, 0 where article or main do."""
    kinds = [("host", pa.string()), ("role", pa.int64()), ("depth", pa.int64()), ("chars", pa.int64()), ("named", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for k, (host, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                page = parse(html or "")
                mass = page.below(_slots(page, known.get(host, batch.column(2)[k]).own(page)))
                for i, chars in enumerate(mass):
                    if chars and not page.part[i]:
                        own = sums.setdefault((host, page.role[i], page.depth[i]), [0, 0])
                        own[0] += chars
                        own[1] += sum(mass[j] for j in _articles(page, mass)) if not i else 0
            yield _rows(kinds, [(*k, *v) for k, v in sums.items()])

    mass = pages.where("classes is not null").select("host", "html", "classes").mapInArrow(run, "host string, role long, depth long, chars long, named long")
    mass = mass.groupBy("host", "role", "depth").agg(F.sum("chars").alias("chars"), F.sum("named").alias("named"))
    total = mass.where("depth = 0").select("host", F.col("chars").alias("total"), F.col("named").alias("in_named"))
    held = mass.join(total, "host").where(f"chars >= {REGION_SHARE} * total")
    deepest = F.max(F.struct("depth", "chars", "role"))["role"]
    return held.groupBy("host").agg(F.when(F.max("in_named") >= NAMED_SHARE * F.max("total"), F.lit(0)).otherwise(deepest).cast("long").alias("region"))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages`` (page_id, url, html).

    A null or empty html, or one without main text, gives an empty string.  A
    null url or one without a host has no template: its page is read by itself,
    like the only page of a host.  Repeated rows give repeated results; an
    empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    K.tune(spark)
    s = Scratch(spark, "html")
    pages = spread(pages.select("page_id", "url", "html")).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    templates = s.save(classes_of(pages, s), "classes")
    small = (templates.select(F.sum(F.size(F.flatten("classes")))).first()[0] or 0) <= BROADCAST_ROWS
    regions = regions_of(_with_templates(pages, templates, small))
    found = s.save(templates.join(regions, "host", "left"), "templates")
    s.drop("sums", "classes")
    joined = _with_templates(pages, found, small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            host, html, region = (batch.column(i).to_pylist() for i in (2, 3, 5))
            texts = [extract(html[k], known.get(host[k], batch.column(4)[k]), region[k]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "host", "html", "classes", "region").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole table ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
