"""Operator 6, HTML main text by inferred wrappers: union-free regular expressions per host.

A page is a stream of tags and texts. From all different pages of a host one expression is inferred that generates them: streams
are aligned tag by tag, and a mismatch is resolved

* between texts: into a text slot,
* between a tag that starts one more item of the kind just closed and something else: into a repeated group,
* between other tags: into an optional group, found by looking ahead in both streams (longest common run of tags).

The expression says where the article is: from the root on, the element that holds ``SHARE`` of the text in slots,
optional and repeated groups (link texts don't count; texts that nearly all pages have at one place are template),
down to the smallest one. Boxes without a class are told apart by what they hold: links, text or blocks. Names are the
tie-break: where no element holds that share, an ``article`` or ``main`` element is taken, and elements named as none
of the article count only if there is nothing else. A page's text is read from that place; template texts at their
place go, and so do menus, headers, footers, sidebars, notices, adverts, forms and comments inside, which only
element, role, or a word of class or id can tell from the article. Pages whose host has no expression, or that do not
have its place, are judged by the same rules on their own stream.

Scale: each page is parsed once for its tree without texts: labels, characters of texts, and 64-bit digests of texts with
their place, which are counted per host. Trees are folded in two steps, of the square root of a host's pages each, in the order of hashes, so
that no task holds a host and the order of rows doesn't matter. An expression grows with the kinds of elements of a host's pages, not
with their number. Of it only the place and the digests of template texts go to the pages: by broadcast as long as all
hosts' have SENT_BYTES together at most, else by a join on the host, where hosts with a large share of all pages leave the shuffle.
Scanning is linear in the page.

Defined cases: null html is empty and gives the empty text; null or odd urls have no host and no expression;
malformed markup is read as far as it goes (an unclosed comment or script runs to the end); repeated rows each
get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_groups, stored, table

SHARE = 0.7
SAMPLE = 8  # for callers of ``infer`` that show it some pages only; the operator shows all
SENT_BYTES = 16_000_000
TEMPLATE = 0.8  # a text is template if this share of the pages has it, and two at least
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OTHERS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "menu", "alert", "form"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "promo", "sponsor", "sponsored", "share", "sharing", "social", "related", "popup", "modal", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "login", "signup", "widget", "pagination"}
COMMENTS = {"comment", "comments", "disqus"}  # readers' prose, which no slot tells from the article
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # fails once a kind of quote at most: then there is none behind
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
DEEPEST = 200  # levels of elements; the content of deeper ones stands beside them
BOXES = {"div", "section", "td", "center"}  # told apart by class or, without one, by what they hold


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, "") and ("text", text, "") of a page, in order."""
    at, n, no_comment_end, no_raw_end = 0, len(page), False, set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = -1 if no_comment_end else page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = _END.match(page, m.end())
        stop = end.end() if end else page.find(">", m.end()) + 1
        if not stop:
            return
        name, attributes = m[0].lower(), page[m.end() : stop - 1]
        at = stop
        if name[0] == "/":
            yield "close", name[1:], ""
        elif name in RAW:
            if not attributes.endswith("/") and name not in no_raw_end:
                close = re.compile(f"</{name}[\\s>/]", re.IGNORECASE).search(page, at)
                if close:
                    end_ = page.find(">", close.start())
                    at = end_ + 1 if end_ >= 0 else n
                else:
                    no_raw_end.add(name)
                    at = n
        else:
            yield "open", name, attributes


def signature(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The element with its classes, whether it is none of the article by itself, and whether a name only says so."""
    words, other, label = set(), name in OTHERS, name
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            other |= value.strip().lower() in ROLES
            continue
        if m[1].lower() == "class":
            label += "." + ".".join(sorted(value.lower().split()))
        for word in value.split():
            words |= {w.lower() for w in _SPLIT.split(word)} if word.islower() else {w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", word)}
    return label, other or bool(words & COMMENTS), bool(words & WORDS)


class Node:
    """An element of a page or of an expression. ``text`` is set for texts: a constant, or None for a slot.

    ``pages`` has a bit for each sampled page that has the constant at this place. ``soft``: named as none of the article.
    """

    __slots__ = ("label", "kids", "text", "optional", "repeated", "other", "soft", "weight", "gone", "pages")

    def __init__(self, label: str, other: bool = False, text: str | None = None, weight: int = 0, pages: int = 0):
        self.label, self.other, self.text, self.weight, self.pages = label, other, text, weight, pages
        self.kids: list[Node] = []
        self.optional = self.repeated = self.gone = self.soft = False


def tree(page: str) -> Node:
    """The elements of a page, with end tags that markup leaves out put in."""
    root = Node("page")
    path: list[tuple[str, Node]] = [("", root)]
    open_: Counter[str] = Counter()

    def leave(k: int) -> None:
        for name, _ in path[k:]:
            open_[name] -= 1
        if len(path) > DEEPEST and path[k][0] not in INLINE:
            path[k - 1][1].kids.append(Node(path[k][0]))  # a block beside its content ends here
        del path[k:]

    for kind, value, attributes in stream(page):
        if kind == "text":
            if value.strip() or path[-1][1].kids:
                path[-1][1].kids.append(Node("#text", text=entities.unescape(value), weight=len(value)))
            continue
        if kind == "open":
            if value not in INLINE:  # a block ends an open paragraph, an item the item in front
                for k in range(len(path) - 1, 0, -1):
                    if path[k][0] == "p" or path[k][0] in CLOSES.get(value, ()):
                        leave(k)
                        break
                    if path[k][0] not in INLINE and path[k][0] not in ("p",):
                        break
            label, other, soft = signature(value, attributes)
            node = Node(label, other)
            node.soft = soft
            path[-1][1].kids.append(node)
            if value not in VOID and not attributes.endswith("/"):
                path.append((value, node if len(path) < DEEPEST else path[-1][1]))
                open_[value] += 1
        elif open_[value]:
            k = len(path) - 1
            while path[k][0] != value:
                k -= 1
            leave(k)
    _name_boxes(root)
    return root


def _name_boxes(node: Node) -> tuple[int, int, bool]:
    """Give boxes without a class the kind of what they hold; text, text in links, and whether there are blocks inside."""
    if node.label == "#text":
        return len((node.text or "").strip()), 0, False
    text = links = 0
    blocks = False
    for kid in node.kids:
        t, a, b = _name_boxes(kid)
        text, links, blocks = text + t, links + a, blocks or b
    if node.label in BOXES:
        node.label += ":links" if 2 * links > text else ":blocks" if blocks else ":text"
    name = node.label.partition(".")[0]
    return text, text if name == "a" else links, blocks or name not in INLINE


def generalised(node: Node, page: int = 0) -> Node:
    """The expression of one page (the bit ``page``): neighbouring items of one kind become a repeated group."""
    out = Node(node.label, node.other, node.text, node.weight, page)
    out.soft = node.soft
    if any(k.label != "#text" for k in node.kids) and (line := _line(node)):
        out.kids.append(Node("#text", text=line[0], weight=line[1], pages=page))
        return out
    for kid in node.kids:
        g = generalised(kid, page)
        if out.kids and g.label != "#text" and out.kids[-1].label == g.label:
            out.kids[-1] = merged(out.kids[-1], g, True)
            out.kids[-1].repeated = True
        elif not (g.label == "#text" and not (g.text or "x").strip()):
            out.kids.append(g)
    return out


def _line(node: Node) -> tuple[str, int] | None:
    """What a block without blocks inside says, and the characters of it that are in no link; None if it holds blocks or another's text."""
    text, weight, todo = [], 0, [(k, False) for k in reversed(node.kids)]
    while todo:
        kid, linked = todo.pop()
        if kid.label == "#text":
            text.append(kid.text or "")
            weight += 0 if linked or not (kid.text or "x").strip() else kid.weight
            continue
        name = kid.label.partition(".")[0]
        if name not in INLINE or kid.other or kid.soft:
            return None
        todo += [(k, linked or name == "a") for k in reversed(kid.kids)]
    return "".join(text), weight


def settle(root: Node, least: int) -> None:
    """Slots before names: an element with a name of none of the article is that, unless it holds SHARE of the text in slots and no
    element is an ``article`` or ``main``, or it holds one."""
    named, total = _holds_named(root), _slots(root, least)

    def walk(node: Node) -> None:
        for kid in node.kids:
            if kid.soft and not kid.other:
                kid.other = not _holds_named(kid) if named else _slots(kid, least) < SHARE * total
            if not kid.other:
                walk(kid)

    walk(root)


def _holds_named(node: Node) -> bool:
    return any(k.label.partition(".")[0] in ("article", "main") or _holds_named(k) for k in node.kids if not k.other)


def _places(kids: list[Node]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, kid in enumerate(kids):
        out.setdefault(kid.label, []).append(i)
    return out


def _next(places: dict[str, list[int]], label: str, at: int) -> int | None:
    """The first place of a label from ``at`` on."""
    found = places.get(label, [])
    k = bisect.bisect_left(found, at)
    return found[k] if k < len(found) else None


def merged(a: Node, b: Node, items: bool = False) -> Node:
    """One expression for what ``a`` and ``b`` generate; both have one label. ``items``: of one page, whose characters add up."""
    weight = a.weight + b.weight if items else max(a.weight, b.weight)
    out = Node(a.label, a.other or b.other, a.text if a.text == b.text else None, weight, a.pages | b.pages)
    out.repeated, out.optional, out.soft = a.repeated or b.repeated, a.optional or b.optional, a.soft or b.soft
    places_a, places_b = _places(a.kids), _places(b.kids)
    i = j = 0
    while i < len(a.kids) or j < len(b.kids):
        if i < len(a.kids) and j < len(b.kids) and a.kids[i].label == b.kids[j].label:
            out.kids.append(merged(a.kids[i], b.kids[j], items))
            i, j = i + 1, j + 1
            continue
        # look ahead in both for the nearest place where they meet again; what is skipped is optional
        ahead_a = _next(places_a, b.kids[j].label, i) if j < len(b.kids) else None
        ahead_b = _next(places_b, a.kids[i].label, j) if i < len(a.kids) else None
        take_a = ahead_a is not None and (ahead_b is None or ahead_a - i <= ahead_b - j)
        if take_a or (ahead_b is None and i < len(a.kids)):
            stop = ahead_a if take_a else i + 1
            skipped, i = a.kids[i:stop], stop
        else:
            stop = ahead_b if ahead_b is not None else j + 1
            skipped, j = b.kids[j:stop], stop
        for kid in skipped:
            kid.optional = True
            out.kids.append(kid)
    joined: list[Node] = []  # optional items beside items of their kind are one repeated group
    for kid in out.kids:
        if joined and kid.label != "#text" and joined[-1].label == kid.label:
            joined[-1] = merged(joined[-1], kid, items)
            joined[-1].repeated = True
        else:
            joined.append(kid)
    out.kids = joined
    return out


def expression(node: Node) -> str:
    """The wrapper as text: slots are #, optional groups (..)?, repeated groups (..)+."""
    if node.label == "#text":
        inner = "#" if node.text is None else json.dumps(node.text.strip())
    else:
        inner = f"<{node.label}>{''.join(expression(k) for k in node.kids)}</>"
    mark = "*" if node.optional and node.repeated else "?" if node.optional else "+" if node.repeated else ""
    return f"({inner}){mark}" if mark else inner


def _template(node: Node, least: int) -> bool:
    """Whether a text is one that ``least`` pages have; 0: there is one page only, and no template is known."""
    return least > 0 and node.text is not None and node.pages.bit_count() >= least


def _slots(node: Node, least: int, others: bool = False) -> int:
    """Characters of article text: all but template and links, and but elements named otherwise unless ``others``."""
    if (node.other and not others) or node.label.partition(".")[0] == "a":
        return 0
    if node.label == "#text":
        return 0 if _template(node, least) else node.weight
    return sum(_slots(k, least, others) for k in node.kids)


def _named(node: Node, path: list[str], least: int) -> tuple[int, list[str]] | None:
    """The ``article`` or ``main`` below with most text."""
    best = None
    for kid in node.kids:
        if kid.other or kid.label == "#text":
            continue
        own = [*path, kid.label]
        found = (max(_slots(kid, least), 1), own) if kid.label.partition(".")[0] in ("article", "main") else _named(kid, own, least)
        if found and (best is None or found[0] > best[0]):
            best = found
    return best


def place(root: Node, least: int) -> list[str]:
    """Labels from the root to the element that holds the article."""
    path, node = [], root
    others = not _slots(root, least)
    total = _slots(root, least, others)
    while True:
        kids = [k for k in node.kids if (others or not k.other) and k.label != "#text" and k.label.partition(".")[0] not in INLINE]
        heavy = [k for k in kids if _slots(k, least, others) >= SHARE * total and not k.repeated] if total else []
        if not heavy:  # several elements share the text: by name, if one has it
            named = _named(node, path, least) if node.label.partition(".")[0] not in ("article", "main") else None
            return named[1] if named else path
        if heavy[0].label.partition(".")[0] in ("p", "ul", "ol", "dl", "table", "blockquote", "pre"):
            return path
        node = heavy[0]
        path.append(node.label)


def digest(path: str, text: str) -> int:
    """A text at its place, in 64 bits."""
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _texts(node: Node, path: str = "") -> Iterator[tuple[Node, str, str]]:
    """Constant texts outside of elements that are none of the article, with their place."""
    for kid in node.kids:
        if kid.label == "#text":
            if kid.text is not None and kid.text.strip():
                yield kid, path, " ".join(kid.text.split())
        elif not kid.other:
            yield from _texts(kid, f"{path}/{kid.label}")


def packed(node: Node) -> list:
    """A tree as lists: [label, flags, kids] of elements, [flags, weight, text] of texts."""
    flags = node.optional + 2 * node.repeated + 4 * node.other + 8 * node.soft
    return [flags, node.weight, node.text] if node.label == "#text" else [node.label, flags, [packed(k) for k in node.kids]]


def unpacked(made: list, template: set[int] | None = None) -> Node:
    """The tree of ``packed``. With ``template`` its texts are digests: those are template and weigh nothing, others are slots."""
    if isinstance(made[0], str):
        node, flags = Node(made[0]), made[1]
        node.kids = [unpacked(k, template) for k in made[2]]
    else:
        flags, weight, text = made
        if template is not None:
            text, weight = (str(text), 0) if text in template else (None, weight)
        node = Node("#text", text=text, weight=weight)
    node.optional, node.repeated, node.other, node.soft = bool(flags & 1), bool(flags & 2), bool(flags & 4), bool(flags & 8)
    return node


def page_tree(page: str) -> tuple[list, dict[int, str]]:
    """The expression of one page, packed, with digests in place of its texts; and these texts."""
    root = generalised(tree(page))
    known = {}
    for node, path, text in [*_texts(root)]:
        node.pages = digest(path, text)
        known[node.pages] = text

    def strip(node: Node) -> None:
        for kid in node.kids:
            if kid.label == "#text":
                kid.text = kid.pages or None
            else:
                strip(kid)

    strip(root)
    return packed(root), known


def _wrapper(root: Node, template: set[int]) -> dict:
    """Expression, place and template (digests) of all pages' tree, which is settled."""
    settle(root, 0)
    where = place(root, 0)
    known = set() if any(x.partition(".")[0] in ("article", "main") for x in where) else template
    return {"expression": expression(root), "place": where, "template": sorted(known)}


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages of one host: expression, place of the article, constant texts outside named elements."""
    trees, known = zip(*map(page_tree, dict.fromkeys(pages)), strict=True)
    least = max(2, math.ceil(TEMPLATE * len(trees)))
    count = Counter(i for k in known for i in k)
    template = {i for i, n in count.items() if n >= least}
    root = reduce(merged, [unpacked(t, template) for t in trees])
    found = _wrapper(root, template)
    names = {str(i): text for k in known for i, text in k.items() if i in template}
    there = sorted({names[node.text] for node, _, _ in _texts(root)}) if found["template"] else []
    return found | {"constant": there}


def _at(root: Node, path: list[str]) -> list[Node]:
    """The elements of a page at a place."""
    found = [root]
    for label in path:
        found = [k for node in found for k in node.kids if k.label == label]
    return found


def main_text(page: str, wrapper: dict | None) -> str:
    """Blocks of the article, one to a line."""
    root = tree(page)
    where = wrapper["place"] if wrapper else []
    places = _at(root, where) if wrapper else []
    if not any(_slots(p, 0, True) for p in places):
        own = generalised(root)
        settle(own, 0)
        where = place(own, 0)
        places = _at(root, where)
    settle(root, 0)
    template = set(wrapper["template"]) if wrapper else set()
    blocks: list[str] = []
    now: list[str] = []
    above: list[str] = []  # labels from the root to the text in hand

    def flush() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text and not (template and digest("".join(f"/{x}" for x in above), text) in template):
            blocks.append(text)

    # without recursion: the stack has elements to enter, and None where one ends
    for start in places:
        above[:] = where
        todo: list[Node | None] = [*reversed([k for k in start.kids if not k.other])]
        path = [start]
        while todo:
            node = todo.pop()
            if node is None:
                left = path.pop()
                if left.label.partition(".")[0] not in INLINE:
                    flush()
                above.pop()
                continue
            if node.label == "#text":
                now.append(node.text or "")
                continue
            name = node.label.partition(".")[0]
            if name not in INLINE:
                flush()
            elif name == "br":
                now.append(" ")
            path.append(node)
            above.append(node.label)
            todo.append(None)
            todo += [k for k in reversed(node.kids) if not k.other]
        flush()
    return "\n".join(blocks)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, size (its pages), expression, wrapper (place and template texts as JSON): one row per host, from all its pages."""
    rows = pages.where("host is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [page_tree(p) for p in b["html"]]
            yield pd.DataFrame({"host": b["host"], "h": b["h"], "tree": [json.dumps(t, separators=(",", ":")) for t, _ in found], "items": [list(k) for _, k in found]})

    trees = rows.select("host", F.xxhash64("html").alias("h"), "html").mapInPandas(parse, "host string, h long, tree string, items array<long>")
    trees = stored(trees.dropDuplicates(["host", "h"]), "wrapper-trees")
    sizes = trees.groupBy("host").agg(F.count("*").alias("pages"))
    counts = trees.select("host", F.explode("items").alias("item")).groupBy("host", "item").agg(F.count("*").alias("n"))
    known = counts.where("n > 1").join(sizes, "host").where(F.col("n") >= F.ceil(F.lit(TEMPLATE) * F.col("pages")))
    known = known.groupBy("host").agg(F.sort_array(F.collect_list("item")).alias("template"))
    hosts = stored(sizes.join(known, "host", "left").select("host", "pages", F.coalesce("template", F.array().cast("array<long>")).alias("template")), "wrapper-templates")
    dealt = trees.select("host", "h", "tree", F.encode("host", "UTF-8").alias("key"))
    groups = hosts.select(F.encode("host", "UTF-8").alias("key"), "pages", "template")
    if (hosts.agg(F.sum(F.size("template") * 8 + F.octet_length("host"))).first()[0] or 0) <= SENT_BYTES:
        dealt = dealt.join(F.broadcast(groups), "key")
    else:
        dealt = left_join_groups(dealt, groups, "key", "pages", trees.count())
    dealt = dealt.withColumn("part", F.pmod("h", F.ceil(F.sqrt("pages")).cast("long"))).drop("key", "pages")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        template = set(group["template"].iloc[0])
        root = reduce(merged, (unpacked(json.loads(t), template) for t in group.sort_values("h")["tree"]))
        return group.iloc[:1][["host", "part", "template"]].assign(tree=json.dumps(packed(root), separators=(",", ":")))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        found = _wrapper(reduce(merged, (unpacked(json.loads(t)) for t in group.sort_values("part")["tree"])), {int(x) for x in group["template"].iloc[0]})
        sent = json.dumps({k: found[k] for k in ("place", "template")})
        return pd.DataFrame({"host": [group["host"].iloc[0]], "expression": [found["expression"]], "wrapper": [sent]})

    parts = dealt.groupBy("host", "part").applyInPandas(fold, "host string, part long, template array<long>, tree string")
    found = parts.groupBy("host").applyInPandas(finish, "host string, expression string, wrapper string")
    return found.join(rows.groupBy("host").agg(F.count("*").alias("size")), "host")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    host = F.lower(F.regexp_extract(F.col("url"), HOST, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.nullif(host, F.lit("")))
    wrappers = stored(host_wrappers(rows), "wrappers")
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= SENT_BYTES:
        joined = rows.join(F.broadcast(wrappers.select("host", "wrapper")), "host", "left").select("page_id", "url", "html", "wrapper")
    else:
        keyed = rows.withColumn("key", F.coalesce(F.encode("host", "UTF-8"), F.encode(F.concat(F.lit("?"), F.uuid()), "UTF-8")))
        groups = wrappers.select(F.encode("host", "UTF-8").alias("key"), "wrapper", "size")
        joined = left_join_groups(keyed, groups, "key", "size", rows.count()).select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for page, w in zip(b["html"], b["wrapper"], strict=True):
                if isinstance(w, str) and w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = json.loads(w)
                texts.append(main_text(page, known[w] if isinstance(w, str) else None))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
