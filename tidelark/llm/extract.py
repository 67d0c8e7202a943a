"""Main text of web pages, from container paths that a host's pages agree on.

Each page's blocks of text are listed with the path of elements around them,
where an element is its tag and first class with digits generalised.  Paths are
numbered, each with its parent, so a page's work grows with its length and not
with its nesting.  Containers are scored by the unlinked text under them, each
page votes for its best one, Spark counts votes by host, and pages are read
again with the winning paths.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import keep

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
# fixed sets of HTML's vocabulary
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select option textarea svg canvas object audio video dialog menu title datalist".split())
# class and id words that name what is not the article; a name that has other words too is no more than a hint
_NOISE = frozenset("nav navbar navigation menu menubar sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert banner advert adverts advertisement advertising ad ads adbox sponsor sponsored comment comments commentlist reply replies respond disqus newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination popup modal".split())
# words that may also name a part of an article: the text under them decides
_WEAK = frozenset("promo promotion discussion share sharing social related recommended pager widget overlay toolbar copyright disclaimer search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("article content entry main post story text body".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table tbody thead body html article section div main".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th tr tbody thead table ul ol dl figcaption figure address hgroup summary header".split())


def _words(value: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"\s+", value):
        words = [x.lower() for x in _WORD.findall(part)]
        out += [] if words and words[0] in ("with", "has", "no", "without") else words
    return out


def _element(tag: str, attrs: str, inside_main: bool) -> tuple[str, bool, bool, bool]:
    """Generalised name, whether the element isn't part of an article, whether its text has to tell, and whether its name hints that it isn't."""
    name, noise, weak, hint = tag, tag in _NOISE_TAGS or (tag == "header" and not inside_main), False, False
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class" and value.strip():
                name = f"{tag}.{re.sub(r'[0-9]+', '#', value.split()[0])}"
            if tag in ("html", "body", "article", "main"):
                continue
            if key == "class" or (key == "id" and tag not in _HEADINGS):  # a heading's id is an anchor
                words = set(_words(value))
                named = words & _NOISE or ("header" in words and not inside_main)
                noise = noise or bool(named and words <= _NOISE | {"header"})
                hint = hint or bool(named)
                weak = weak or bool(words & _WEAK)
            elif key == "role":
                noise = noise or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                noise = True
            elif key == "style":
                noise = noise or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return name, noise, weak, hint and not noise


@dataclass
class Page:
    """Blocks in page order without noise, and the numbered container paths that they stand in; a parent's number is lower."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    number: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)  # path, text, linked characters, a heading

    def path(self, parent: int, name: str) -> int:
        at = self.number.setdefault((parent, name), len(self.name))
        if at == len(self.name):
            self.parent.append(parent)
            self.name.append(name)
        return at

    def spelled(self, path: int) -> str:
        out = []
        while path > 0:
            out.append(self.name[path])
            path = self.parent[path]
        return ">".join(reversed(out))

    def found(self, spelled: str) -> int | None:
        at: int | None = 0
        for name in spelled.split(">") if spelled else ():
            at = self.number.get((at, name))
            if at is None:
                break
        return at

    def under(self, path: int) -> list[str]:
        inside = [False] * len(self.name)
        for i in range(path, len(self.name)):
            inside[i] = i == path or (self.parent[i] >= 0 and inside[self.parent[i]])
        return [text for at, text, *_ in self.blocks if inside[at]]


#: Text that isn't linked, in characters, from which on a part with a doubtful name belongs to the article.
LEAST_PART = 200


def read(html: str) -> Page:
    """The page's blocks without what isn't part of its article.

    Tags, roles and names made only of words for other parts (``comments``, ``cookie-notice``) decide by themselves.  A
    name that also has other words (``comment-piece``, ``cookie-recipes``) hides its part unless the page has no
    article without it: under LEAST_PART unlinked characters remain, this part has as many or more, most of its
    text isn't linked, and no other part of the page has its name, as single comments and adverts do.
    """
    page = Page()
    listed: list[tuple[int, str, int, bool, int]] = []  # the last is the innermost doubtful part
    part_parent, part_text, part_linked, part_hint = [-1], [0], [0], [""]
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, noise, inside article or main, path, doubtful part
    opened: Counter[str] = Counter()
    top = ("", False, False, 0, 0)
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        text = " ".join(markup.unescape("".join(parts)).split())
        if text:
            tag, _, _, path, part = stack[-1] if stack else top
            listed.append((path, text, linked, tag in _HEADINGS, part))
            part_text[part] += len(text)
            part_linked[part] += min(linked, len(text))
        parts.clear()
        linked, in_link = 0, False

    def add(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][1]):
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def push(entry: tuple[str, bool, bool, int, int]) -> None:
        stack.append(entry)
        opened[entry[0]] += 1

    def close(i: int) -> None:
        gone = stack[i:]
        if any(x[0] not in _INLINE for x in gone):
            flush()
        for x in gone:
            opened[x[0]] -= 1
        del stack[i:]

    at = 0
    while True:
        m = _TAG.search(html, at)
        if not m:
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = False
            if not opened[tag]:
                if tag == "p":
                    flush()
                elif tag == "br":
                    add(" ")
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in _VOID:
            flush() if tag == "hr" else add(" ")
            continue
        _, noisy, main, path, part = stack[-1] if stack else top
        if tag in _INLINE:
            if tag == "a":
                in_link = True
            found = _element(tag, attrs, main) if attrs and not noisy else ("", False, False, False)
            if found[1] or found[3]:
                push((tag, True, main, path, part))
            elif noisy and stack[-1][0] in _INLINE and tag == stack[-1][0]:
                push((tag, True, main, path, part))
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in _ENDS_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        if tag in _SAME and any(opened[x] for x in _SAME[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SAME[tag]:
                    close(i)
                    break
                if stack[i][0] in _FENCE and not (tag == "tr" and stack[i][0] in ("tbody", "thead")):
                    break
        if tag == "body" and opened["head"]:
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))
        flush()
        _, noisy, main, path, part = stack[-1] if stack else top
        name, noise, weak, hint = _element(tag, attrs, main)
        if (weak or hint) and not noisy and not noise:
            part_parent.append(part)
            part_text.append(0)
            part_linked.append(0)
            part_hint.append(name if hint else "")
            part = len(part_parent) - 1
        push((tag, noisy or noise, main or tag in ("article", "main"), path if tag in _LEAF or noisy or noise else page.path(path, name), part))
    add(html[at:])
    flush()
    for i in range(len(part_parent) - 1, 0, -1):
        if not part_hint[i]:
            part_text[part_parent[i]] += part_text[i]
            part_linked[part_parent[i]] += part_linked[i]
    hinted = [bool(x) for x in part_hint]
    # parts inside a hinted one go with it or are its text; only outermost ones can be the article
    inside = [False] * len(part_parent)
    for i in range(1, len(part_parent)):
        inside[i] = inside[part_parent[i]] or hinted[part_parent[i]]
    unlinked = lambda i: part_text[i] - part_linked[i]
    if any(hinted) and unlinked(0) < LEAST_PART:
        names = Counter(part_hint)
        article = [i for i, x in enumerate(hinted) if x and not inside[i] and names[part_hint[i]] == 1 and unlinked(i) >= LEAST_PART and 2 * part_linked[i] <= part_text[i]]
        if article:
            hinted[max(article, key=lambda i: (unlinked(i), -i))] = False
    gone = [False] * len(part_parent)
    for i in range(1, len(part_parent)):
        gone[i] = gone[part_parent[i]] or hinted[i] or unlinked(i) < LEAST_PART or 2 * part_linked[i] > part_text[i]
    page.blocks = [x[:4] for x in listed if not gone[x[4]]]
    return page


def best_container(page: Page) -> tuple[int, int]:
    """(path, unlinked characters under it) of the page's container; (0, 0) without text.

    The best score has the most unlinked text for its height.  From there it
    goes up to an article or main element around it, else as long as the
    parent's unlinked text beyond it is more than furniture, or there is a heading.
    """
    n = len(page.name)
    score, chars, headings = [0.0] * n, [0] * n, [0] * n
    for path, text, linked, heading in page.blocks:
        own = max(0, len(text) - 2 * linked)
        score[path] += own
        chars[path] += own
        headings[path] += heading
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        score[up] += 0.6 * score[i]
        chars[up] += chars[i]
        headings[up] += headings[i]
    if not chars[0]:
        return 0, 0

    def worth(i: int) -> float:
        tag, _, name = page.name[i].partition(".")
        return score[i] * (3 if tag in ("article", "main") else 1.3 if set(_words(name)) & _MAIN else 1)

    tag = lambda i: page.name[i].partition(".")[0]
    best = max((i for i in range(n) if chars[i]), key=lambda i: (worth(i), -i))
    if tag(best) == "article":
        return best, chars[best]
    up = page.parent[best]
    while up > 0 and tag(up) not in ("article", "main"):
        up = page.parent[up]
    if up > 0:
        return up, chars[up]
    while best and tag(best) != "main":
        up = page.parent[best]
        share = 0.25 if up == 0 or tag(up) in ("body", "html") else 0.08
        if chars[up] - chars[best] < share * chars[best] and (share == 0.25 or headings[up] == headings[best]):
            break
        best = up
    return best, chars[best]


def main_text(html: str, winners: list[str] | None) -> tuple[str, str]:
    """(text, path used): the page's own best container if its host agrees, else the first agreed one that it has.

    A page whose text is all linked gives all its blocks.
    """
    page = read(html)
    own, chars = best_container(page)
    chosen = own
    if chars and winners and page.spelled(own) not in winners:
        for path in winners:
            at = page.found(path)
            if at is not None and (text := page.under(at)) and 2 * sum(map(len, text)) >= chars:
                chosen = at
                break
    return "\n".join(page.under(chosen)), page.spelled(chosen)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame, *, least_share: float = 0.2, broadcast_hosts: int = 50_000) -> DataFrame:
    """page_id, url, text, path for every row of pages(page_id, url, html).

    A host's winning paths have at least ``least_share`` of its pages' votes,
    most votes first (then more text, then by name).  Null or empty html has
    an empty text; a null url is a host of its own name, the empty one.  Rows
    that share a page_id are read each by itself.
    """
    given = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    votes = pa.schema([("host", pa.string()), ("path", pa.string()), ("chars", pa.int64())])

    def vote(batches):
        for b in batches:
            best = []
            for page in map(read, (h or "" for h in b.column("html").to_pylist())):
                path, chars = best_container(page)
                best.append((page.spelled(path), chars))
            yield pa.RecordBatch.from_arrays([b.column("host").cast(pa.string()), pa.array([p for p, _ in best], pa.string()), pa.array([c for _, c in best], pa.int64())], schema=votes)

    cast = given.select("host", "html").mapInArrow(vote, "host string, path string, chars long").where("chars > 0")
    counted = keep(cast.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars")))
    of_host = W.partitionBy("host")
    ranked = counted.withColumn("share", F.col("votes") / F.sum("votes").over(of_host)).where(F.col("share") >= least_share)
    winners = keep(ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("a"), (-F.col("chars")).alias("b"), "path"))).getField("path").alias("winners")))
    how = "broadcast" if winners.count() <= broadcast_hosts else "merge"  # at most 1 / least_share paths each
    joined = given.join(winners.hint(how), "host", "left").select("page_id", "url", "html", "winners")

    def reread(batches):
        for b in batches:
            both = [main_text(h or "", w) for h, w in zip(b.column("html").to_pylist(), b.column("winners").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([t for t, _ in both], pa.string()), pa.array([p for _, p in both], pa.string())], names=["page_id", "url", "text", "path"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return joined.mapInArrow(reread, f"page_id {kind}, url string, text string, path string")
