"""HTML extraction by consensus host paths.

A page is parsed once into blocks of text, each under a generalised path: the tags of its containers, with
their first class or id, digits masked. Blocks weigh what they hold in running text, links counting
against them; a page's best container is the deepest one that keeps most of the page's weight. As heading,
lead or tail may stand beside it, it widens to the article or main around it, or else as far as what it gains
isn't mostly links. Pages vote for their best containers' paths, votes are counted for each host, and every
page is then extracted again by its host's winning path, or by its own where that encloses it. A page without
that path falls back to its own best container. What is dropped inside is of the excluded kinds.

A page's paths form a tree whose nodes are numbered so that what lies under a node is a range of numbers; a
path is known by a digest of its labels. So depth costs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import hot_join, materialize, ship, slices

#: Kinds of tags, and words that name what isn't the article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript xmp noembed noframes plaintext".split())
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption address caption summary".split())
OUT_TAGS = set("nav aside footer form head svg template select button dialog menu object canvas math audio video".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar side aside rail footer foot masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus widget toolbar pagination pager"
    " skip search hidden header topbar toc".split()
)
#: Of these, what readers or others wrote, and what no page makes its whole.
FIRM_WORDS = set("comment comments commentlist respond reply replies disqus newsletter related recommended recommendations sharing social sponsored advert adverts".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words before "header" that make it the header of the text and not of the page.
OF_TEXT = set("entry post article story content news".split())
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""[>"']""")
#: One attribute after the other, so that nothing in a value is taken for a name.
_ATTR = re.compile(r"""([^\s/>="']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HEADED = re.compile(r"\s*(?:<header\b[^>]{0,300}>\s*)?<h([1-6])\b[^>]{0,300}>(.{0,300}?)</h\1", re.S | re.I)
_TAG = re.compile(r"<[^>]{0,300}>")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
_TOKENS = re.compile(r"[A-Za-z]+")
#: The part of a page's weight that makes a container the article's, and the part beyond which no name speaks against it.
KEEPS, WHOLE = 0.8, 0.75

_BLOCKS = "array<struct<path:int,text:string>>"
_PARSED = f"page_id long, url string, own int, own_path long, own_name string, weight long, paths array<long>, ends array<int>, blocks {_BLOCKS}"


class Tags:
    """Walks over the tags of a page once: every search starts where the last one ended, or isn't repeated."""

    def __init__(self, html: str):
        self.html, self.quoted, self.next_end = html, True, -1

    def _end(self, at: int) -> int:
        """The place of the first > from a place on, -1 if there is none."""
        if self.next_end != len(self.html) and self.next_end < at:
            found = self.html.find(">", at)
            self.next_end = len(self.html) if found < 0 else found
        return -1 if self.next_end == len(self.html) else self.next_end

    def _tag_end(self, at: int) -> int:
        """The > that ends a tag, quoted ones left out; where quotes don't pair, the first one, as for all later tags."""
        first = self._end(at)
        if first < 0 or not self.quoted:
            return first
        while m := _QUOTE_OR_END.search(self.html, at):
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while self.html[before].isspace():
                before -= 1
            at = m.end()
            if self.html[before] == "=":  # elsewhere a quote is a letter like others
                at = self.html.find(m[0], at) + 1
                if not at:
                    break
        self.quoted = False
        return first

    def skip_raw(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element, the page's end if there is none."""
        m = _RAW_END[tag].search(self.html, at)
        end = self._end(m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.html)

    def next(self, at: int) -> tuple[int, int, bool, str, str]:
        """start, end, whether it closes, name ('' for comments and the like) and attributes of the next tag."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, False, "", ""
            after = html[at + 1 : at + 3]
            if after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
                stop = self._end(at)
                if stop < 0:
                    break
                m = _NAME.match(html, at, stop + 1)
                end = self._tag_end(m.end())
                return at, end + 1, after[0] == "/", m[1].lower(), html[m.end() : end]
            if after[:1] in ("!", "?") and (end := self._end(at)) >= 0:
                return at, end + 1, False, "", ""
            at += 1
        return len(html), len(html), False, "", ""


def _attributes(text: str) -> dict[str, str]:
    """Names in small letters, the first of each, and values without quotes; '' for none."""
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" and value[:1] == value[-1:] and len(value) > 1 else value)
    return found


def _name_words(name: str) -> list[str]:
    """Words of a class or id that stand for its whole sense: its first and last one."""
    words = [w.lower() for w in _TOKENS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
    if words[:1] in (["has"], ["no"], ["with"]) or len(words) > 1 and words[-1] == "header" and words[0] in OF_TEXT:
        return []
    return words[:1] + words[-1:]


def _names_itself(name: str, html: str, at: int) -> bool:
    """Whether the element's first heading says what its id says, as anchors of sections do."""
    m = _HEADED.match(html, at)
    plain = lambda x: "".join(_TOKENS.findall(x.lower()))
    return bool(m) and plain(name) != "" and plain(name) in plain(unescape(_TAG.sub("", m[2])))


def _verdict(tag: str, found: dict[str, str], in_article: bool, html: str, at: int) -> str:
    """What a container is by tag, attributes and what comes first in it: 'out', 'firm' or 'soft' by name, or ''."""
    if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in OUT_ROLES:
        return "out"
    classes, anchor = found.get("class", "").split(), found.get("id", "")
    if tag == "header":
        own = in_article or any(not _name_words(c) for c in classes if c.lower().endswith("header"))
        if not own:
            return "out"
    elif tag in OUT_TAGS:
        return "soft" if tag == "form" else "out"
    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return ""
    words = [w for c in classes for w in _name_words(c)]
    if anchor and tag not in LEAF:
        of_id = [w for w in _name_words(anchor) if w in OUT_WORDS]
        if of_id and (set(of_id) & FIRM_WORDS or not _names_itself(anchor, html, at)):
            words += of_id
    words = [w for w in words if w in OUT_WORDS and not (w == "header" and tag == "header")]
    return ("firm" if set(words) & FIRM_WORDS else "soft") if words else ""


def _label(tag: str, found: dict[str, str]) -> str:
    first = (found.get("class", "") or found.get("id", "")).split()
    return tag + (f".{re.sub(r'[0-9]+', '#', first[0].lower()).replace('>', '_')}" if first else "")


@dataclass
class Page:
    """Blocks (node, text, link characters) in page order, and the tree of their paths; node 0 is the page.

    Nodes are numbered so that those under node i are i + 1 to ends[i].
    """

    blocks: list[tuple[int, str, int]]
    parent: list[int]
    labels: list[str]
    digests: list[int]
    ends: list[int]


def _numbered(blocks: list[tuple[int, str, int]], parent: list[int], labels: list[str]) -> Page:
    """Renumbers nodes depth first."""
    below: list[list[int]] = [[] for _ in parent]
    for i in range(len(parent) - 1, 0, -1):
        below[parent[i]].append(i)
    order, todo = [], [0]
    while todo:
        order.append(i := todo.pop())
        todo += below[i]
    place = [0] * len(parent)
    for n, i in enumerate(order):
        place[i] = n
    up = [place[parent[i]] for i in order]
    digests, ends = [0] * len(order), list(range(len(order)))
    for n in range(1, len(order)):
        digests[n] = xxhash.xxh64_intdigest(f"{digests[up[n]]}>{labels[order[n]]}".encode("utf-8", "replace")) - (1 << 63)
    for n in range(len(order) - 1, 0, -1):
        ends[up[n]] = max(ends[up[n]], ends[n])
    return Page([(place[i], t, k) for i, t, k in blocks], up, [labels[i] for i in order], digests, ends)


def parse(html: str) -> Page:
    """The blocks that may be of the article, and their paths."""
    blocks: list[tuple[int, str, int, int]] = []
    parent, labels, node_of = [-1], [""], {}
    suspects: list[tuple[int, bool]] = []  # the suspect around, and whether its name is firm
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # tag, node, out, in an article, suspect
    buffer: list[str] = []
    links = in_link = at = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text and not stack[-1][2]:
                blocks.append((stack[-1][1], text, links, stack[-1][4]))
            buffer.clear()
        links = 0

    tags, opened = Tags(html), {}  # opened: how many of each name are on the stack
    while at < len(html):
        start, end, close, tag, attributes = tags.next(at)
        if start > at:
            buffer.append(html[at:start])
            if in_link:
                links += start - at
        at = end
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if close else 1
        if tag in INLINE and tag not in ("br", "hr"):
            continue
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                at = tags.skip_raw(tag, at)
            continue
        flush()
        if tag in VOID:
            continue
        if close:
            while opened.get(tag):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            opened[stack.pop()[0]] -= 1
        if attributes.endswith("/") and tag not in ("p", "div", "article", "section", "main"):
            continue
        _, node, out, inside, suspect = stack[-1]
        found = _attributes(attributes) if attributes.strip() else {}
        verdict = "" if out else _verdict(tag, found, inside, html, at)
        if verdict in ("soft", "firm"):
            suspects.append((suspect, verdict == "firm"))
            suspect = len(suspects) - 1
        if tag not in LEAF:
            key = (node, _label(tag, found))
            if key not in node_of:
                node_of[key] = len(parent)
                parent.append(node)
                labels.append(key[1])
            node = node_of[key]
        stack.append((tag, node, out or verdict == "out", inside or tag in ("article", "main"), suspect))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return _numbered(_cleared(blocks, suspects), parent, labels)


def _cleared(blocks: list[tuple[int, str, int, int]], suspects: list[tuple[int, bool]]) -> list[tuple[int, str, int]]:
    """Blocks but those of suspects; one without a firm name that holds nearly all of the page's running text is none."""
    weights = [0] * len(suspects)
    total = 0
    firm = [False] * len(suspects)
    for i, (around, is_firm) in enumerate(suspects):
        firm[i] = is_firm or around >= 0 and firm[around]
    for _, text, links, suspect in blocks:
        w = max(len(text) - 2 * links, 0)
        if suspect < 0:
            total += w
        elif not firm[suspect]:
            total += w
            weights[suspect] += w
    kept = [False] * len(suspects)
    for i in range(len(suspects) - 1, -1, -1):
        if suspects[i][0] >= 0:
            weights[suspects[i][0]] += weights[i]
    for i, (around, _) in enumerate(suspects):
        kept[i] = not firm[i] and 0 < WHOLE * total <= weights[i] and (around < 0 or kept[around])
    return [(node, text, links) for node, text, links, suspect in blocks if suspect < 0 or kept[suspect]]


def best_container(page: Page) -> tuple[int, int]:
    """The deepest node under which at least KEEPS of the page's weight lies, widened, and its weight."""
    n = len(page.parent)
    weights, held, linked, depth = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, links in page.blocks:
        weights[node] += max(len(text) - 2 * links, 0)
        held[node] = 1
        linked[node] = int(linked[node] or 2 * links >= len(text))  # mostly links
    for i in range(1, n):
        depth[i] = depth[page.parent[i]] + 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        weights[p], held[p], linked[p] = weights[p] + weights[i], held[p] + held[i], linked[p] + linked[i]
    kept = [(depth[i], weights[i], -i) for i in range(1, n) if 0 < KEEPS * weights[0] <= weights[i]]
    if not kept:
        return 0, weights[0]
    best = widened(page, -max(kept)[2], held, linked)
    return best, weights[best]


def widened(page: Page, node: int, held: list[int], linked: list[int]) -> int:
    """The farthest article or main around a node; without one, the farthest node that gains only blocks of running text."""
    around, farthest = node, -1
    while around > 0:
        if page.labels[around].split(".")[0] in ("article", "main"):
            farthest = around
        around = page.parent[around]
    if farthest >= 0:
        return farthest
    best, up = node, page.parent[node]
    while up > 0:
        if linked[up] > linked[best]:
            break
        if held[up] > held[best]:
            best = up
        up = page.parent[up]
    return best


def path_name(page: Page, node: int) -> str:
    """The path's last labels, for people."""
    names: list[str] = []
    while node > 0 and len(names) < 12:
        names.append(page.labels[node][:80])
        node = page.parent[node]
    return ">".join(reversed(names))


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("path", pa.int32()), ("text", pa.string())]))
    for b in slices(batches, 2):
        rows = []
        for h in b.column(2).to_pylist():
            page = parse(h or "")
            own, weight = best_container(page)
            blocks = [{"path": i, "text": t} for i, t, _ in page.blocks]
            rows.append((own, page.digests[own], path_name(page, own), weight, page.digests, page.ends, blocks))
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), kind)
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "url", "own", "own_path", "own_name", "weight", "paths", "ends", "blocks"])


def host(url: Column) -> Column:
    """Lower-case host of a URL; '' where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit(""))


def winning_paths(parsed: DataFrame) -> DataFrame:
    """host, path, its name, and pages: the container path with most votes of each host, ties by weight, then by path."""
    votes = parsed.groupBy("host", "own_path").agg(F.count("*").alias("pages"), F.count_if(F.col("weight") > 0).alias("votes"), F.sum("weight").alias("weight"), F.min("own_name").alias("name"))
    best = votes.groupBy("host").agg(F.max_by(F.struct("own_path", "name"), F.struct("votes", "weight", "own_path")).alias("best"), F.sum("pages").alias("pages"))
    return best.select("host", F.col("best.own_path").alias("path"), F.col("best.name").alias("name"), "pages")


def under(blocks: Column, ends: Column, node: Column) -> Column:
    """The texts of the blocks under a node, in page order."""
    return F.transform(F.filter(blocks, lambda b: (b["path"] >= node) & (b["path"] <= F.element_at(ends, node + 1))), lambda b: b["text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null or empty html gives an empty text. Rows with a null url share the empty host. Repeated rows each
    give a row (and a vote); an empty table gives none; other columns don't matter, whatever their names.
    Parsing takes time in proportion to a page's length, whatever is left open in it.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = materialize(rows.mapInArrow(_parse_all, _PARSED).withColumn("host", host(F.col("url"))))
    winners = materialize(winning_paths(parsed))
    total = winners.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    found = hot_join(parsed, winners, ["host"], "pages", total)
    # the winner's node on this page, if there is one; the page's own container where it encloses that, or where it holds nothing
    node = F.array_position("paths", F.col("path")).cast("int") - 1
    own = F.col("own")
    found = found.withColumn("node", F.when((node < 0) | ((own > 0) & (node >= own) & (node <= F.element_at("ends", own + 1))), own).otherwise(node))
    found = found.withColumn("found", under(F.col("blocks"), F.col("ends"), F.col("node")))
    text = F.array_join(F.when(F.size("found") > 0, F.col("found")).when(F.col("weight") > 0, under(F.col("blocks"), F.col("ends"), own)).otherwise(F.array().cast("array<string>")), "\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
