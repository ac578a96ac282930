"""Main text of web pages, from containers that the pages of a host agree on.

Method: consensus host paths. Containers are elements such as divisions, sections, cells, articles and the body,
all scored alike: by the text that they hold outside links, where text counts nine tenths for each container further
out. So the parent of many equal parts beats each part, and a part with nearly all text beats its parent. A page
votes for the path of its best container: the tags and classes from the root down, digits made alike. Votes are
summed up per host; a host's winning paths are those that a tenth of its pages or more vote for. Each page is
then extracted again: from the winning path whose votes times its score in the page are highest, or from its own best
container if the page has text in none. Of equal ones the greater path is taken.

Left out with all that is in them are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments, known by tag, role, or a class or id all of whose words say so (``cookie-notice``, ``ad_box``). A
header element in an article stays. Names that say so in part (``share-price``, ``entry-header``) leave an element
out only if more than half of its text is in links, or if it has less than half of the page's text and the host's
pages agree that it is no article text: it stands in a tenth of them or more (three different ones at least), mostly
with the same text.

Text is cut into blocks at block elements. Character references are decoded, white space (a line break
element included) becomes one space, blocks are trimmed and joined by one line feed.

A null or empty page has an empty text. Pages without a host in their url vote together. Rows that repeat an
id are pages of their own. Texts of any length are read whole, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.llm.hosts import url_parts
from recspark.llm.words import slices
from recspark.session import materialize

#: Share of a host's pages that must vote for a path, and winning paths kept per host: ten can have that share.
WINNING_SHARE, _WINNERS = 0.1, 10
#: How much text counts for the next container further out, and pages with a named element that can agree on it.
_FURTHER, _AGREE = 0.9, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

# Names of elements, by how browsers and authors use them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_LEFT_OUT = frozenset(
    "nav footer aside form head button select option datalist fieldset svg math canvas object audio video dialog menu".split()
)
_LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead header footer sidebar aside widget widgets ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus respond replies form search pagination pager toolbar skip copyright".split()
)
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words beside which a left-out word still names such a part.
_PLAIN_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content global group holder icon icons inner item items left link links list main outer page post posts primary right row secondary section site top unit wrap wrapper".split()
)
_CONTAINERS = frozenset("body div section td center article main".split())
#: An opening tag of the key ends an open element of the values, up to one of the last values.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_INSIDE_P_STAYS = frozenset(("option", "optgroup", "legend", "body", "html"))


class Block(NamedTuple):
    """Text of a container, its characters within links, and the outermost element around it whose name is unclear."""

    box: str
    text: str
    linked: int
    named: str


class _Open:
    __slots__ = ("tag", "path", "out", "main", "box", "named")

    def __init__(self, tag, path, out, main, box, named):
        self.tag, self.path, self.out, self.main, self.box, self.named = tag, path, out, main, box, named


def _left_out(tag: str, attributes: dict[str, str], in_main: bool) -> bool | None:
    """Whether an element is left out; None if only a part of its name says so."""
    if tag in _LEFT_OUT or (tag == "header" and not in_main):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in _LEFT_OUT_ROLES:
        return True
    if "none" in attributes.get("style", "") and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in attributes.get("class", ""):
        return False
    in_part = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(_WORD.findall(_split_humps(name)))
        if tag == "header":
            words.discard("header")
        if said := words & _LEFT_OUT_WORDS:
            if words <= said | _PLAIN_WORDS:
                return True
            in_part = True
    return None if in_part else False


def _split_humps(names: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower()


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that aren't left out by what its own elements say."""
    root = _Open("", "", False, False, "", "")
    stack, out, buffer = [root], [], []
    linked = links = 0

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                top = stack[-1]
                out.append(Block(top.box, text, min(linked, len(text)), top.named))
            buffer.clear()
        linked = 0

    def close(n: int):
        """Close elements down to ``n`` that stay open."""
        nonlocal links
        for gone in stack[n:]:
            links -= gone.tag == "a"
        if any(x.tag in _BLOCK for x in stack[n:]):
            flush()
        del stack[n:]

    def text(raw: str):
        nonlocal linked
        if raw and not stack[-1].out:
            buffer.append(unescape(raw))
            if links > 0:
                linked += len(raw)

    at = 0
    find = _TOKEN.search
    while (m := find(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ending, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ending:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:
                    break  # a stray inline end tag does not close a block
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _ENDS:
            ends, until = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        if tag in _BLOCK and tag not in _INSIDE_P_STAYS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        top = stack[-1]
        attributes = {}
        if rest.strip(" /"):
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        path = top.path
        if tag in _BLOCK or attributes.get("class"):
            names = sorted(set(_DIGITS.sub("#", unescape(attributes.get("class", ""))).replace("/", "|").split()))
            path = f"{path}/{'.'.join([tag, *names])}"
        said = _left_out(tag, attributes, top.main)
        named = top.named or ("" if said is not None else f"{path}#{_DIGITS.sub('#', attributes.get('id', ''))}")
        main = top.main or tag in ("article", "main") or attributes.get("role") == "main"
        if rest.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        stack.append(_Open(tag, path, top.out or said is True, main, path if tag in _CONTAINERS else top.box, named))
        links += tag == "a"
    text(page[at:])
    flush()
    crowded = {name: 2 * sum(b.linked for b in part) > sum(len(b.text) for b in part) for name, part in named_parts(out).items()}
    return [b for b in out if not crowded.get(b.named)]


def _digest(blocks: list[Block]):
    digest = hashlib.blake2b(digest_size=16)
    for b in blocks:
        digest.update(b.text.encode("utf-8", "replace") + b"\n")
    return digest


def named_parts(blocks: list[Block]) -> dict[str, list[Block]]:
    """The blocks of each element whose name says in part that it is left out."""
    parts: dict[str, list[Block]] = {}
    for b in blocks:
        if b.named:
            parts.setdefault(b.named, []).append(b)
    return parts


def small_parts(blocks: list[Block]) -> dict[str, bytes]:
    """A digest of each of these elements that has less than half of the page's text."""
    whole = sum(len(b.text) for b in blocks)
    return {name: _digest(part).digest() for name, part in named_parts(blocks).items() if 2 * sum(len(b.text) for b in part) < whole}


def scores(blocks: list[Block]) -> dict[str, float]:
    """The score of each container of a page."""
    own: Counter = Counter()
    for b in blocks:
        own[b.box] += max(len(b.text) - b.linked, 0) + 1e-3 * len(b.text)
    score: Counter = Counter()
    for box, value in own.items():
        steps = box.split("/")
        for n in range(len(steps), 0, -1):
            if n == len(steps) or n == 1 or steps[n - 1].partition(".")[0] in _CONTAINERS:
                score["/".join(steps[:n])] += value
                value *= _FURTHER
    return dict(score)


def best_path(blocks: list[Block]) -> str | None:
    """Path of the container with the highest score."""
    score = scores(blocks)
    return max(score, key=lambda p: (score[p], p)) if score else None


def text_at(blocks: list[Block], path: str) -> str:
    """The blocks of a container in page order, with those of containers within it."""
    return "\n".join(b.text for b in blocks if b.box == path or b.box.startswith(path + "/"))


def consensus(pages: DataFrame) -> DataFrame:
    """``host, won, left_out``: winning paths with their votes, and named elements that the host's pages agree to leave out.

    A page has few of either: ten winning paths at most, and elements that stand in a tenth of the pages.
    """

    def vote(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blocks = blocks_of(html) if html else []
                    if blocks:
                        rows.append((host, best_path(blocks), None, None))
                        if parts := small_parts(blocks):
                            whole = _digest(blocks).digest()
                            rows += [(host, name, digest, whole) for name, digest in parts.items()]
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                kinds = pa.string(), pa.string(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "digest", "page"])

    cast = pages.select("host", "html").mapInArrow(vote, "host string, path string, digest binary, page binary")
    counted = cast.groupBy("host", "path", "digest", "page").agg(F.count("*").alias("n"))
    once = F.when(F.col("digest").isNull(), F.col("n")).otherwise(1)  # copies of a page agree with nothing but themselves
    counted = counted.groupBy("host", "path", "digest").agg(F.sum(once).alias("n"))
    counted = counted.groupBy("host", "path", F.col("digest").isNull().alias("voted")).agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    counted = materialize(counted, "path-votes")
    total = materialize(counted.where("voted").groupBy("host").agg(F.sum("n").alias("all")), "host-votes")
    won = counted.join(total, "host").where(F.col("n") >= WINNING_SHARE * F.col("all"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    best = won.where("voted").withColumn("rank", rank).where(F.col("rank") <= _WINNERS)
    agreed = won.where(~F.col("voted") & (F.col("n") >= _AGREE) & (2 * F.col("texts") <= F.col("n")))
    lists = best.groupBy("host").agg(F.collect_list(F.struct("path", "n")).alias("won"))
    lists = lists.join(agreed.groupBy("host").agg(F.collect_list("path").alias("left_out")), "host", "left")
    return materialize(lists, "host-paths")


def chosen_text(page: str | None, won: list[tuple[str, int]] = (), left_out: list[str] = ()) -> str:
    """The main text of a page, given what its host's pages agree on."""
    blocks = blocks_of(page) if page else []
    if left_out:
        gone = small_parts(blocks).keys() & set(left_out)
        blocks = [b for b in blocks if b.named not in gone]
    if not blocks:
        return ""
    score = scores(blocks)
    value = {path: n * score[path] for path, n in won if path in score}
    return text_at(blocks, max(value, key=lambda p: (value[p], p)) if value else best_path(blocks))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of each page (``page_id, url, html``)."""
    host, _ = url_parts(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    agreed = consensus(named)

    def extract(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for html, won, left_out in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    texts.append(chosen_text(html, [(w["path"], w["n"]) for w in won or []], left_out or []))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = named.join(agreed, "host", "left").select("page_id", "url", "html", "won", "left_out")
    return rows.mapInArrow(extract, "page_id long, url string, text string")
