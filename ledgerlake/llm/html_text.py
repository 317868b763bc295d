"""HTML main text by wrappers: union-free expressions inferred from the pages of a host.

A page's tags become a tree. Runs of alike siblings, or of alike groups of siblings,
fold into repeated groups; text becomes slots. Aligning two trees of one host resolves
what differs: a child that only one has is optional, runs of different length are one
repeated group, texts that differ are a slot. Aligning all trees of a host gives its
wrapper: one tree, without alternatives, that all its pages match. Pages with and without
an article (or main) element have a wrapper each.

The wrapper decides which paths hold the main text. Where it has an article (or main)
element, paths below it do, but for parts whose tag, role or class names them menus,
notices, adverts, forms, comments and the like. Where it has none, all other slots do,
unless links make up most of them, or their text is the same on all pages of a host whose
pages differ; what only some pages have stays. Extraction then is one pass over a page with the paths of its host.
Elements under more than ``MAX_DEPTH`` open ones count as part of the last of these, but
for those that are named or tagged as aside.

Pages are first reduced to distinct trees per host (partial counts before the shuffle),
folded in ``DEALT`` groups a host and then once more, so no task ever holds the pages of a
host. Wrappers are broadcast only if all of them together stay under ``MAX_BROADCAST``
bytes, and joined by host otherwise.

Defined results: null or empty html gives an empty text; a page cut off in a tag loses
that tag only; a null url is a host of its own; equal pages give equal texts; an empty
table gives an empty table; columns of the given names are replaced and others kept.
"""

from __future__ import annotations

import html as references
import json
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, on_workers, table

DEALT = 16
MAX_BROADCAST = 32 << 20
MAX_DEPTH = 64

TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", regex.S)
ATTRIBUTE = regex.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", regex.I)
#: Elements whose content is text up to their end tag, or never shown as text.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph or item of the first kind.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: What an implied end does not reach beyond.
SCOPES = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
LANDMARKS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset("head nav footer aside form button select fieldset dialog menu svg object canvas audio video".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe signup login pagination pager toolbar widget skip".split())


def _names(attributes: str) -> tuple[frozenset[str], str]:
    """The words of class and id, and the role."""
    words: list[str] = []
    role = ""
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value.strip()
        else:
            words += regex.split(r"[^a-z0-9]+", value)
    return frozenset(words), role


@lru_cache(20_000)
def element(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Signature of a start tag, whether it is a landmark, whether it names something aside.

    The signature has the tag, up to three words of class and id without digits, and the role.
    """
    words, role = _names(attributes)
    named = sorted(words & ASIDE_WORDS)
    plain = sorted(w for w in words - ASIDE_WORDS if w.isalpha())
    aside = tag in ASIDE_TAGS or role in ASIDE_ROLES or bool(named)
    landmark = not aside and (tag in LANDMARKS or role in LANDMARKS)
    return tag + "".join(f".{w}" for w in [*named[:1], *plain][:3]) + ("@" + role if role else ""), landmark, aside


def events(page: str) -> Iterable[tuple[str, str]]:
    """("open", tag and attributes by a blank), ("close", tag), ("break", "") and ("text", decoded) in page order."""
    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            yield "text", references.unescape(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag or (at == len(page) and page[-1] != ">"):
            continue
        tag = tag.lower()
        if slash:
            yield "close", tag
            continue
        if tag == "br":
            yield "break", ""
        elif tag in RAW:
            end = regex.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", regex.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            yield "open", f"{tag} {attributes}"
            if tag in VOID:
                yield "close", tag
    if at < len(page):
        yield "text", references.unescape(page[at:])


class Walk:
    """The stack of open block elements along a page, with implied ends."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.signs: list[str] = []

    def open(self, tag: str, sign: str) -> int:
        """Opens an element; returns how many implied ends came first."""
        ended = 0
        for kind, enders in ENDS.items():
            if tag in enders:
                scope = SCOPES.get(kind, frozenset())
                for k in range(len(self.tags) - 1, -1, -1):
                    if self.tags[k] == kind:
                        ended += len(self.tags) - k
                        del self.tags[k:], self.signs[k:]
                        break
                    if self.tags[k] in scope or (kind == "p" and self.tags[k] not in ENDS):
                        break
        self.tags.append(tag)
        self.signs.append(sign)
        return ended

    def close(self, tag: str) -> int:
        for k in range(len(self.tags) - 1, -1, -1):
            if self.tags[k] == tag:
                ended = len(self.tags) - k
                del self.tags[k:], self.signs[k:]
                return ended
        return 0


# A node of a tree: [signature, landmark, aside, optional, repeated, text, chars, link chars, children,
# pages, pages with text]; text is None without text of its own, "" for a slot, else a digest of the only text seen so far.
SIGN, LANDMARK, ASIDE, OPTIONAL, REPEATED, TEXT, CHARS, LINKS, KIDS, PAGES, SEEN = range(11)


def tree_of(page: str) -> list:
    """The folded tree of one page."""
    root: list = ["", False, False, False, False, None, 0, 0, [], 1, 0]
    stack, walk, links = [root], Walk(), 0
    for kind, what in events(page):
        if kind == "text":
            plain = " ".join(what.split())
            if plain:
                node = stack[-1]
                node[TEXT] = (node[TEXT] or "") + plain
                node[CHARS] += len(plain)
                node[LINKS] += len(plain) if links else 0
        elif kind == "open":
            tag, _, attributes = what.partition(" ")
            if tag == "a":
                links += 1
            sign, landmark, aside = element(tag, attributes)
            if (tag in INLINE and not aside) or tag in VOID:
                continue
            for _ in range(walk.open(tag, sign)):
                stack.pop()
            node = [sign, landmark, aside, False, False, None, 0, 0, [], 1, 0]
            if len(stack) <= MAX_DEPTH:
                stack[-1][KIDS].append(node)
            elif not aside:
                node = stack[-1]
            stack.append(node)
        elif kind == "close":
            links -= what == "a" and links > 0
            for _ in range(walk.close(what)):
                stack.pop()
    marked = _has_landmark(root)
    _settle(root, marked)
    return root


def _has_landmark(node: list) -> bool:
    return not node[ASIDE] and (node[LANDMARK] or any(map(_has_landmark, node[KIDS])))


def _settle(node: list, marked: bool) -> None:
    """Texts to slots (to digests on pages without landmark), counts to nothing where a landmark decides; folds repeats."""
    import hashlib

    if node[TEXT] is not None:
        node[SEEN] = 1
        node[TEXT] = "" if marked else hashlib.blake2b(node[TEXT].encode(), digest_size=6).hexdigest()
    if marked:
        node[CHARS] = node[LINKS] = 0
    for kid in node[KIDS]:
        _settle(kid, marked)
    node[KIDS] = fold(node[KIDS])


def fold(kids: list) -> list:
    """Runs of alike nodes, or of alike groups of two to four nodes, as one repeated node or group."""
    out: list = []
    for kid in kids:
        if out and out[-1][SIGN] == kid[SIGN]:
            out[-1] = align(out[-1], kid, True)
        else:
            out.append(kid)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            signs = [x[SIGN] for x in out[k : k + width]]
            if [x[SIGN] for x in out[k + width : k + 2 * width]] != signs:
                k += 1
                continue
            for x in range(width):
                out[k + x] = align(out[k + x], out[k + width + x], True)
            del out[k + width : k + 2 * width]
    return out


def align(a: list, b: list, repeated: bool = False) -> list:
    """The least general node that both match."""
    text = b[TEXT] if a[TEXT] is None else a[TEXT] if b[TEXT] is None else a[TEXT] if a[TEXT] == b[TEXT] else ""
    kids = _align_lists(a[KIDS], b[KIDS])
    # nodes repeated in a page are of one page
    pages = [max(a[k], b[k]) if repeated else a[k] + b[k] for k in (PAGES, SEEN)]
    return [a[SIGN], a[LANDMARK], a[ASIDE], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or repeated, text, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], kids, *pages]


def _align_lists(a: list, b: list) -> list:
    """Children in an order both keep: the longest common sequence aligned, all others optional."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][SIGN] == b[j][SIGN] else max(best[i + 1][j], best[i][j + 1])
    optional = lambda x: [*x[:OPTIONAL], True, *x[OPTIONAL + 1 :]]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][SIGN] == b[j][SIGN]:
            out.append(align(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold(out)


def main_paths(wrapper: list, varied: bool) -> list[str]:
    """The paths (signatures by blanks) whose own text belongs to the main text."""
    found: list[str] = []
    marked = _has_landmark(wrapper)

    def visit(node: list, path: str, inside: bool) -> None:
        path = f"{path} {node[SIGN]}" if node[SIGN] else path
        if node[ASIDE] or (node[SIGN] == "header" and not inside and marked):
            return
        inside = inside or node[LANDMARK]
        if node[TEXT] is not None:
            template = node[TEXT] != "" and varied and node[SEEN] == wrapper[PAGES]
            if inside if marked else not (template or 2 * node[LINKS] > node[CHARS] or node[SIGN] == "header"):
                found.append(path)
        for kid in node[KIDS]:
            visit(kid, path, inside)

    visit(wrapper, "", False)
    return found


def has_landmark(page: str) -> bool:
    """Whether the tree of a page has a landmark, without making the tree."""
    walk = Walk()
    for kind, what in events(page):
        if kind == "open":
            tag, _, attributes = what.partition(" ")
            sign, landmark, aside = element(tag, attributes)
            if (tag in INLINE and not aside) or tag in VOID:
                continue
            walk.open(tag, "\0" if aside else sign)
            if landmark and len(walk.signs) <= MAX_DEPTH and "\0" not in walk.signs:
                return True
        elif kind == "close":
            walk.close(what)
    return False


def main_text(page: str | None, paths: frozenset[str]) -> str:
    """The blocks of a page whose path is among ``paths``: white space runs become blanks, blocks lines."""
    if not page:
        return ""
    blocks: list[str] = []
    parts: list[str] = []
    walk, kept = Walk(), "" in paths

    def wanted() -> bool:
        return "".join(f" {s}" for s in walk.signs[:MAX_DEPTH]) in paths and "\0" not in walk.signs[MAX_DEPTH:]

    def flush() -> None:
        if block := " ".join("".join(parts).split()):
            blocks.append(block)
        parts.clear()

    for kind, what in events(page):
        if kind == "text":
            if kept:
                parts.append(what)
        elif kind == "break":
            parts.append(" ")
        elif kind == "open":
            tag, _, attributes = what.partition(" ")
            sign, _, aside = element(tag, attributes)
            if (tag in INLINE and not aside) or tag in VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            walk.open(tag, "\0" if aside else sign)
            kept = wanted()
        elif kind == "close" and (what not in INLINE or what in walk.tags) and what not in VOID:
            flush()
            walk.close(what)
            kept = wanted()
    flush()
    return "\n".join(blocks)


def wrappers(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, paths): for each host the main paths of its wrappers, with and without landmark (or null), as JSON."""
    on_workers(pages.sparkSession)

    @F.arrow_udf("string")
    def trees(found: pa.Array) -> pa.Array:
        made = [tree_of(x.as_py() or "") for x in found]
        return pa.array([str(int(_has_landmark(x))) + json.dumps(x, separators=(",", ":")) for x in made], type=pa.string())

    def folded(group: pa.Table) -> pa.Table:
        first, *rest = (json.loads(x.as_py()) for x in group.column("tree"))
        for other in rest:
            first = align(first, other)
        return pa.table({"host": group.column("host").slice(0, 1), "marked": group.column("marked").slice(0, 1), "tree": pa.array([json.dumps(first, separators=(",", ":"))]), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64())})

    @F.arrow_udf("string")
    def decided(found: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([json.dumps(main_paths(json.loads(x), n > 1), ensure_ascii=False) for x, n in zip(found.to_pylist(), counts.to_pylist(), strict=True)], type=pa.string())

    each = pages.select(F.col(host).alias("host"), trees(F.col(html)).alias("tree"))
    distinct = each.distinct().select("host", F.substring("tree", 1, 1).alias("marked"), F.expr("substr(tree, 2)").alias("tree"), F.lit(1).cast("long").alias("n"))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(DEALT))).groupBy("host", "marked", "part").applyInArrow(folded, "host string, marked string, tree string, n long")
    whole = dealt.groupBy("host", "marked").applyInArrow(folded, "host string, marked string, tree string, n long")
    both = whole.select("host", "marked", decided("tree", "n").alias("paths")).groupBy("host")
    of = lambda k: F.coalesce(F.max(F.when(F.col("marked") == k, F.col("paths"))), F.lit("null"))
    return both.agg(F.concat(F.lit("["), of("1"), F.lit(","), of("0"), F.lit("]")).alias("paths"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each page, by the wrapper of its host."""
    on_workers(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    hosted = pages.withColumn("_host", host)
    known = materialise(wrappers(hosted, "_host", f"`{html}`").withColumnRenamed("host", "_host").withColumnRenamed("paths", "_paths"), "wrappers")
    size = known.agg(F.coalesce(F.sum(F.octet_length("_paths")), F.lit(0))).first()[0]

    @F.arrow_udf("string")
    def run(found: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), _paths_of(x.as_py(), p)) for x, p in zip(found, paths.to_pylist(), strict=True)], type=pa.string())

    joined = hosted.join(F.broadcast(known) if size <= MAX_BROADCAST else known, "_host", "left")
    return joined.withColumn(into, run(F.col(f"`{html}`"), F.col("_paths"))).drop("_host", "_paths")


@lru_cache(10_000)
def _paths(data: str | None) -> tuple[frozenset[str] | None, ...]:
    return tuple(None if x is None else frozenset(x) for x in json.loads(data)) if data else (None, None)


def _paths_of(page: str | None, data: str | None) -> frozenset[str]:
    """The main paths for a page of a host."""
    marked, plain = _paths(data)
    if marked is None or plain is None:
        return marked or plain or frozenset()
    return marked if page and has_landmark(page) else plain


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
