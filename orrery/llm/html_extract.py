"""Main text of web pages by equivalence classes of template tokens (after Arasu and Garcia-Molina).

Tokens of a page are its tags (with their class and id) and its text runs, each told apart by the tags above it. A token's
occurrence vector says how often it occurs in every page of its host. Vectors are never gathered: their sums of per-page
hashes are, so the tokens of a host with one vector, its equivalence classes, come out of one aggregation with map-side
combine, however many pages the host has. A host of ``MIN_PAGES`` pages or more has a template: its classes in ``SUPPORT`` of
the pages, and those in ``RECUR`` of them that consist of elements which could matter by their tag or names. A page uses
the classes whose tokens it holds in the class's order; nested into each other by their order they are the page's
template, and what lies between is its slots.

What is kept. Slots are told apart by the template elements around them; an element that is not in the template decides
nothing, whatever it is called. Slots in template elements that are menus, headers, footers, sidebars, notices, adverts, forms
or reader comments go: by tag, or by a whole name of class, id or role. If articles or a main element are in the template, the
slots in them are the text: there only text runs of firm classes (``FIRM_SUPPORT`` of ``FIRM_PAGES`` pages or more,
most of them different pages) count as template, since passages that some pages quote are text. Otherwise all other
slots stay. A page that holds nothing but template keeps its text. Script, style, head and hidden elements are never text.

Pages of hosts without a template (fewer than ``MIN_PAGES`` pages) go by tags and names alone: there a word that is but a
part of an element's names does not count against more than half of the page's text, nor any word against the only articles.

Defined results. A null html counts as empty and gives an empty text; a null url is the host "". Broken markup (unclosed and
stray tags, missing ends) is read as far as it goes. Rows are independent but for the template; repeated rows count as pages
each. Empty tables give empty results; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mapped, slices, stored, table, with_group

#: Least share of a host's pages that a frequent class is in, and least pages of a host with a template.
SUPPORT, MIN_PAGES = 0.5, 3
FIRM_SUPPORT, FIRM_PAGES = 0.9, 10
#: Least share of a host's pages for a class of elements that matter by tag or name: a page has few of them, so their number is bounded.
RECUR = 0.01
#: Templates of all hosts together up to this many tokens (8 bytes each) are sent to all tasks; beyond, they are joined by host.
BROADCAST_TOKENS = 1_000_000
CHUNK_BYTES = 4 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|object|math)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose start ends an open paragraph.
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of the same list.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that hold no main text.
NO_TEXT_TAGS = frozenset("head title nav footer aside form button menu dialog fieldset legend datalist audio video map".split())
#: Words of class, id or role that tell the same.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert notification notifications popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager search toolbar skip copyright legal disclaimer widget form complementary contentinfo".split()
)
#: Those of reader comments: their part of the text does not matter.
READER_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words at the end of a name that say nothing, and at its start words that tell all, or that turn its sense.
_BOX_WORDS = frozenset("area bar block box content container inner item items links list outer section slot text unit widget wrap wrapper".split())
_LEADING = frozenset("ad ads advert sponsored related recommended".split())
_TURNING = frozenset("has is js no non not show hide with without".split())
_DIGITS = re.compile(r"\d+")
_NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
ARTICLE_WORDS = frozenset({"articlebody"})


@dataclass
class Node:
    """An element. ``hidden``: never text; ``hard``: none by its tag; ``named``: none by words, 1 if they are but a part of its names, 2 if they name it; ``noise``: a whole name says so."""

    tag: str
    path: int
    parent: int
    token: int = 0
    hidden: bool = False
    hard: bool = False
    named: int = 0
    noise: bool = False
    opens: bool = False
    is_main: bool = False
    framed: bool = False
    holds: bool = False
    skip: bool = False
    article: int = -1
    main: bool = False
    chars: int = 0
    number: int = 0


@dataclass
class Page:
    """``runs``: (block, text, token, number of the innermost node); ``tokens``: all tokens in order; ``marks``: those of elements that could matter."""

    runs: list = field(default_factory=list)
    tokens: list = field(default_factory=list)
    nodes: list = field(default_factory=list)
    marks: set = field(default_factory=set)


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _is_noise(name: str) -> bool:
    """Whether one whole name stands for no text: by its head word, the last but for words such as box and list, or by its first."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _TURNING:
        return False
    rest = list(words)
    while len(rest) > 1 and (rest[-1] in _BOX_WORDS or rest[-1].isdigit()):
        rest.pop()
    return rest[-1] in NO_TEXT_WORDS or words[0] in _LEADING


def _words(attrs: str) -> tuple[set[str], str, bool, int, bool]:
    """Words of the names, the token's mark, whether the element is hidden, its ``named`` and its ``noise``."""
    words, sign, hidden, whole, noise = set(), "", False, False, False
    for m in _ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            hidden = True
        if name not in _NAMING:
            continue
        value = m[2] or m[3] or m[4] or ""
        words.update(w.lower() for w in _WORD.findall(value))
        if name in ("role", "itemprop"):
            words.add(f"{name}:{value.strip().lower()}")
        if name in ("class", "id"):
            sign += f".{_DIGITS.sub('0', value.strip())}"
        tokens = value.lower().split()
        if name in ("class", "id", "role"):
            noise = noise or any(map(_is_noise, value.split()))
        if name == "class":
            hidden = hidden or "hidden" in tokens
        if name in ("class", "id", "role") and tokens:
            whole = whole or all(t in NO_TEXT_WORDS for t in tokens)
    named = (2 if whole or words & READER_WORDS else 1) if words & NO_TEXT_WORDS else 0
    return words, sign, hidden, named, noise


def parse(html: str) -> Page:
    page, block = Page(), 0
    root = Node("", 0, 0)
    page.nodes.append(root)
    stack = [root]
    #: How many elements of a tag are open.
    n_open: dict[str, int] = {}

    def text(raw: str) -> None:
        value = entities.unescape(raw) if "&" in raw else raw
        top = stack[-1]
        if value.strip():
            token = _hash(f"{top.path}#{' '.join(value.split())}")
            page.tokens.append(token)
            page.runs.append((block, value, token, top.number))
        elif value:
            page.runs.append((block, " ", None, top.number))

    def close(upto: int) -> None:
        for n in stack[upto:]:
            n_open[n.tag] -= 1
        del stack[upto:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if name not in INLINE:
            block += 1
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1) if n_open.get(name) else ():
                if stack[i].tag == name:
                    page.tokens.append(_hash(f"{stack[i].path}/"))
                    close(i)
                    break
                # an inline end tag does not close blocks
                if name in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if name in BREAKS_P and n_open.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        for i in range(len(stack) - 1, 0, -1) if name in SIBLINGS else ():
            if stack[i].tag in SIBLINGS[name]:
                close(i)
                break
            if stack[i].tag in ("ul", "ol", "dl", "table"):
                break
        if name == "body":
            close(next((i for i, n in enumerate(stack) if n.tag == "head"), len(stack)))
        words, sign, hidden, named, noise = _words(m["attrs"] or "")
        above = stack[-1]
        path = _hash(f"{above.path}/{name}")
        token = _hash(f"{path}{sign}")
        page.tokens.append(token)
        if name in VOID or (m["attrs"] or "").endswith("/"):
            continue
        whole = name in ("html", "body", "main")
        node = Node(name, path, above.number, token, name in ("head", "title") or (hidden and not whole), name in NO_TEXT_TAGS, 0 if whole else named, noise and not whole, number=len(page.nodes))
        node.opens = name == "article" or bool(words & ARTICLE_WORDS)
        node.is_main = name == "main" or "role:main" in words
        if node.hard or node.noise or node.opens or node.is_main or name == "header":
            page.marks.add(token)
        page.nodes.append(node)
        stack.append(node)
        n_open[name] = n_open.get(name, 0) + 1
    if at < len(html):
        text(html[at:])
    return page


def settle(page: Page, template: set[int] | None = None) -> None:
    """Sets ``skip``, ``article`` and ``main`` of all nodes, when all of the page is known.

    With the tokens of a ``template`` only elements in it count, and of their names only whole ones.

    Words skip no element that they name only in part and that has more than half of the text, or the only articles; where all
    articles are in elements that words name, those are not skipped either.
    """
    nodes = page.nodes
    for n in nodes[1:]:
        up = nodes[n.parent]
        n.hard = n.hard or (n.tag == "header" and not up.framed)
        if template is not None:
            fixed = n.token in template
            n.hard, n.opens, n.is_main = n.hard and fixed, n.opens and fixed, n.is_main and fixed
            n.named = 2 if n.noise and fixed else 0
        n.hard = up.hard or n.hard or n.hidden
        n.framed = up.framed or n.opens or n.is_main
    for _, value, token, i in page.runs:
        if token is not None and not nodes[i].hard:
            nodes[i].chars += len(value)
    for n in reversed(nodes[1:]):
        nodes[n.parent].chars += n.chars
        if n.holds or ((n.opens or n.is_main) and n.chars and not n.hard and not n.named):
            nodes[n.parent].holds = True

    def marked() -> bool:
        clean = False
        for n in nodes[1:]:
            n.skip = nodes[n.parent].skip or n.hard or n.named > 0
            clean = clean or ((n.opens or n.is_main) and not n.skip and n.chars > 0)
        return clean

    clean = marked()
    for level in (1, 2):
        kept = [n for n in nodes if n.named == level and not n.hard and ((not clean and n.holds) or (level == 1 and n.chars * 2 > nodes[0].chars))]
        for n in kept:
            n.named = 0
        if kept:
            clean = marked()
    for n in nodes[1:]:
        up = nodes[n.parent]
        n.article = n.number if n.opens and not n.skip and up.article < 0 else up.article
        n.main = up.main or n.is_main


def main_text(page: Page, template: list[tuple[bool, list[int]]], pages: int = 1) -> str:
    """The text of the slots that are kept.

    ``template`` has for each class whether it is firm, and its tokens in order; ``pages`` is the number of pages of the host.
    """
    nodes = page.nodes
    fixed = nested(page, [tokens for _, tokens in template])
    settle(page, fixed if pages >= MIN_PAGES else None)
    runs = [r for r in page.runs if not nodes[r[3]].skip]
    inside = [r for r in runs if nodes[r[3]].article >= 0]
    if not any(r[2] is not None for r in inside):
        inside = [r for r in runs if nodes[r[3]].main]
    if any(r[2] is not None for r in inside):
        fixed = nested(page, [tokens for sure, tokens in template if sure])
    else:
        inside = runs
    slots = [r for r in inside if r[2] is None or r[2] not in fixed]
    inside = slots if any(r[2] is not None for r in slots) else inside
    out, last, words = [], None, []
    for number, value, *_ in inside:
        if number != last and words:
            out.append("".join(words))
            words = []
        last = number
        words.append(value)
    out.append("".join(words))
    return " ".join(x for x in (" ".join(b.split()) for b in out) if x)


def nested(page: Page, template: list[list[int]]) -> set[int]:
    """Tokens of the classes that are valid in this page: all of a class's tokens occur, in its order, and classes nest.

    Two classes nest if one lies between two neighbouring tokens of the other, or outside of it. Places ascend, so a class lies in
    one gap if its first and its last token do: two searches a pair.
    """
    if not template:
        return set()
    first: dict[int, int] = {}
    for i, t in enumerate(page.tokens):
        first.setdefault(t, i)
    used: list[list[int]] = []
    fixed: set[int] = set()
    for tokens in sorted(template, key=lambda c: -len(c)):
        places = [first.get(t, -1) for t in tokens]
        if -1 in places or any(a > b for a, b in zip(places, places[1:], strict=False)):
            continue
        if all(one_gap(places, other) or one_gap(other, places) for other in used):
            used.append(places)
            fixed.update(tokens)
    return fixed


def one_gap(inner: list[int], outer: list[int]) -> bool:
    return bisect_left(outer, inner[0]) == bisect_left(outer, inner[-1])


def occurrences(pages: DataFrame) -> DataFrame:
    """From (``host``, ``html``): sums for the tokens of each host, added up over a worker's pages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], CHUNK_BYTES):
                sums: dict[tuple[str, int], list[int]] = {}
                for host, text in zip(hosts[a:b], texts[a:b], strict=True):
                    key = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
                    counts: dict[int, list[int]] = {}
                    page = parse(text or "")
                    for i, t in enumerate(page.tokens):
                        counts.setdefault(t, [0, i])[0] += 1
                    # the page itself, as a token that occurs once in each
                    counts[0] = [1, 0]
                    cells: dict[int, int] = {}
                    for t, (n, i) in counts.items():
                        if n not in cells:
                            cells[n] = xxhash.xxh3_64_intdigest(f"{key},{n}")
                        cell, s = cells[n], sums.setdefault((host, t), [0, 0, 0, 0, 0, 0])
                        s[0] += 1
                        s[1] += n
                        s[2] += cell & 0xFFFFFFFF
                        s[3] += cell >> 32
                        s[4] += i
                        s[5] += t in page.marks
                if sums:
                    columns = list(zip(*sums.values(), strict=True))
                    keys = list(zip(*sums, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["host", "token", "pages", "total", "x", "y", "place", "marks"])

    rows = mapped(pages, run, "host string, token long, pages long, total long, x long, y long, place long, marks long")
    return rows.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "x", "y", "place", "marks")))


def templates(pages: DataFrame) -> DataFrame:
    """(``host``, ``n``, ``classes``): the pages of each host with a template, and its equivalence classes: whether each is firm, its tokens in order of mean place."""
    found = stored(occurrences(pages), "tokens")
    different = pages.groupBy("host").agg(F.approx_count_distinct(F.xxhash64("html")).alias("different"))
    hosts = found.filter(f"token = 0 AND pages >= {MIN_PAGES}").select("host", F.col("pages").alias("n")).join(different, "host")
    share = F.when(F.col("marks") > 0, RECUR).otherwise(SUPPORT)
    frequent = found.filter(f"token <> 0 AND pages >= {MIN_PAGES}").join(hosts, "host").filter(F.col("pages") >= F.col("n") * share)
    # tokens in half of a host's pages are at most twice a page's tokens, elements in one of a hundred a hundred times a page's: the lists are bounded by the size of pages
    firm = (F.col("n") >= FIRM_PAGES) & (F.col("pages") >= F.col("n") * FIRM_SUPPORT) & (F.col("different") * 2 >= F.col("n"))
    one = frequent.groupBy("host", "pages", "total", "x", "y").agg(F.first(firm).alias("firm"), F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("tokens"))
    classes = one.groupBy("host").agg(F.collect_list(F.struct("firm", F.transform("tokens", lambda t: t["token"]).alias("tokens"))).alias("classes"))
    return hosts.select("host", "n").join(classes, "host", "left")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``id_col``, ``url_col``, ``text``, ``n_chars``."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    known = stored(templates(pages.select("host", "html")), "templates")
    tokens = F.aggregate("classes", F.lit(0).cast("long"), lambda n, c: n + F.size(c["tokens"]) + 1)
    size = known.agg(F.sum(F.coalesce(tokens, F.lit(1))).alias("tokens"), F.sum("n").alias("pages")).first()
    if (size["tokens"] or 0) <= BROADCAST_TOKENS:
        joined = pages.join(F.broadcast(known), "host", "left")
    else:
        # pages of hosts with a template, hot hosts by broadcast; the others have none to be joined with
        some = with_group(pages, known, ["host"], "n", size["pages"])
        rest = pages.join(known.select("host").hint("merge"), "host", "left_anti").withColumns({"n": F.lit(None).cast("long"), "classes": F.lit(None).cast(known.schema["classes"].dataType)})
        joined = some.unionByName(rest)
    kinds = dict(df.dtypes)[id_col], dict(df.dtypes)[url_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, classes, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                texts.append(main_text(parse(html.as_py() or ""), [(c["firm"], c["tokens"]) for c in classes.as_py() or []], n or 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return mapped(joined.select("id", "url", "html", "classes", "n"), run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
