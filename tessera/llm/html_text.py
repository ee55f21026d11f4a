"""Operator 8, HTML extraction: a site style tree of each host, and the main text it leaves.

Every page becomes a tree of elements and text.  A block is the text of one block-level
element, up to the next block-level tag inside it.  The trees of one host are merged by
path (tag, class and id from the root down), article and main included.  In the merged tree

* a block's importance is 1 - log n / log m, where n of the m pages that have its path show its
  text there: 0 for a text that stands on every page, 1 for one that stands on a single page;
* a content node's importance is the mean over the blocks in its branch;
* a presentation node's importance is the entropy of the child sequences its pages show;
  it is weighed against its content's with GAMMA ** (number of styles).

Pages that share their text are one page here: a page stands for the least hash of its longer
blocks, so that copies and near copies of a page don't make its text look repeated.
Branches and blocks below THRESHOLD on paths of at least MIN_PAGES pages are removed from
each page.

Before it comes what HTML itself says, because invented boilerplate needn't repeat: elements
such as nav, footer or script are noise, and so are classes and ids that are names of what varies
from page to page (``ad``, ``comments``; whole names only).  Where a page has article or main,
everything outside goes.  Other names (``legal``, ``related``) are noise outside article and
main; inside, they only halve a branch's importance.  A name never takes a page's article or main.

Defined results
---------------
* null or empty html, or no main text: the empty string and 0 characters;
* null or host-less urls share the host ""; a host of fewer than MIN_PAGES pages loses no branch;
* repeated rows are pages of their own; unclosed tags end with their parent, a cut-off last tag is dropped;
* elements nested deeper than MAX_DEPTH share the style node of their ancestor there; their text stays;
* quotes count only behind ``=``; parsing takes time in proportion to the page, however it nests;
* character references are decoded once; white space (also no-break space) inside a block is one blank;
* an empty table gives no rows; extra columns are not carried along.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written

GAMMA = 0.9
THRESHOLD = 0.2
MIN_PAGES = 5
#: Levels of the style tree, and words of a block that may stand for its page.
MAX_DEPTH = 64
LONG_BLOCK = 20
#: What a noise name leaves of a branch's importance inside article and main.
NAME_WEIGHT = 0.5
#: Removed branches that are broadcast at most; beyond it they are joined by host.
BROADCAST_BRANCHES = 200_000

# Fixed values of HTML: element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe object canvas svg button select textarea input dialog menu search title audio video xmp noembed noframes".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Names of what varies from page to page, so that no tree can tell it.
_VARYING_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising promo sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr newsletter comment comments disqus pagination pager hidden".split()
)
_NOISE_NAMES = _VARYING_NAMES | frozenset(
    "banner promotion header masthead topbar notice notices alert popup modal overlay subscribe subscription signup login "
    "reply replies respond discussion social share sharing related recommended recommendations toolbar widget copyright legal disclaimer".split()
)
_MAIN = frozenset(("article", "main"))
#: An open element of the key is closed by the start of any of the values.
_CLOSED_BY = {
    "p": _BLOCK - {"html", "body", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
_SCOPE = frozenset("table ul ol dl article main section div body html td th select".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[^>=])*+)(>|\Z)|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PARTS = re.compile(r"[a-z]+")
#: Elements whose text no browser shows.
_HIDDEN = _RAW | {"head", "noscript", "template"}


class _Element:
    """An open or closed element, with what its descendants need to know of those above them."""

    __slots__ = ("tag", "parent", "depth", "path", "noise", "main", "named", "weight", "hidden", "owner", "scope", "closable", "children", "gone")

    def __init__(self, tag: str, parent: _Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[str] = []
        self.named, self.gone, self.weight = False, False, 1.0
        if parent is None:
            self.depth, self.path, self.noise, self.main, self.hidden, self.scope = 0, 0, False, False, False, 0
            self.owner, self.closable = self, None
            return
        self.depth = parent.depth + 1
        self.hidden = parent.hidden or tag in _HIDDEN
        #: Depth of the nearest element, this one included, that inline end tags don't cross.
        self.scope = self.depth if tag in _SCOPE else parent.scope
        #: The nearest element, this one included, that a start tag may close.
        self.closable = self if tag in _CLOSED_BY else None if tag in _SCOPE else parent.closable

    def above(self) -> _Element | None:
        """The next element up that a start tag may close, in the same scope."""
        return None if self.tag in _SCOPE or self.parent is None else self.parent.closable


def _hash(value: str) -> int:
    out = xxhash.xxh3_64_intdigest(value)
    return out - (1 << 64) if out >> 63 else out


_PATHS: dict[tuple[int, str], int] = {}


def _path(parent: int, label: str) -> int:
    key = (parent, label)
    if key not in _PATHS:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        _PATHS[key] = _hash(f"{parent}/{label}")
    return _PATHS[key]


def _noise(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Noise by what HTML says itself."""
    if tag in _NOISE_TAGS or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in _NOISE_ROLES


def _named_noise(tag: str, attributes: dict[str, str], in_main: bool) -> float:
    """What the noise names among class and id leave: 0 for varying ones, NAME_WEIGHT inside main for others, else 1."""
    if tag in ("html", "body") or "class" not in attributes and "id" not in attributes:
        return 1.0
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    words = [x for x in map(_NAME_PARTS.findall, names) if x and _NOISE_NAMES.issuperset(x)]
    if not words or in_main and tag == "header" and any("header" in x for x in names):
        return 1.0
    return NAME_WEIGHT if in_main and not any(_VARYING_NAMES.intersection(x) for x in words) else 0.0


def parse(source: str) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """((element, text) of every block in page order, every element)."""
    blocks, elements = _parsed(source, frozenset())
    if any(e.main for e, _ in blocks):
        return blocks, elements
    # Elements whose name alone makes noise of an article or main, where the page has no other.
    place = {id(e): k for k, e in enumerate(elements)}
    wraps, seen = set(), set()
    for e in elements:
        if e.tag in _MAIN and e.noise:
            x = e
            while x is not None and x.noise and id(x) not in seen:
                seen.add(id(x))
                if x.named:
                    wraps.add(place[id(x)])
                x = x.parent
    return _parsed(source, frozenset(wraps)) if wraps else (blocks, elements)


def _parsed(source: str, spared: frozenset[int]) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """What :func:`parse` gives; names of the elements numbered in ``spared`` don't count."""
    root = _Element("#root", None)
    node, blocks, elements = root, [], []
    run: list[str] = []
    opened: dict[str, list[_Element]] = {}

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((node.owner, text))

    def close(x: _Element) -> None:
        """Close ``x`` and all that is open in it."""
        nonlocal node
        after = x.parent
        while node is not after:
            opened[node.tag].pop()
            node = node.parent

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if source[m.start()] != "<" or m.group() == "<":
                run.append(m.group())
            continue
        tag = tag.lower()
        if not m.group(4):  # the page ends inside a tag
            break
        if tag == "br":
            run.append(" ")
            continue
        if m.group(1):
            x = opened[tag][-1] if opened.get(tag) else None
            if x is not None and (tag in _BLOCK or node.scope <= x.depth):  # an inline end tag doesn't close blocks
                if tag in _BLOCK or x.noise or node.tag in _BLOCK:
                    flush()
                close(x)
            elif tag == "p":
                flush()
            continue
        x = node.closable
        while x is not None:
            if tag in _CLOSED_BY[x.tag]:
                flush()
                close(x)
                x = node.closable
            else:
                x = x.above()
        raw = m.group(3)
        attributes = {}
        if raw and not raw.isspace():
            for a in _ATTRIBUTE.finditer(raw):
                attributes.setdefault(a.group(1).lower(), entities.unescape((a.group(2) or "").strip("\"'")))
        left = _named_noise(tag, attributes, node.main) if attributes and len(elements) not in spared else 1.0
        label = tag + "".join(f".{x}" for x in sorted(attributes.get("class", "").split())) + (f"#{attributes['id']}" if attributes.get("id") else "")
        made = _Element(tag, node)
        made.path = _path(node.path, label) if made.depth <= MAX_DEPTH else node.path
        made.named, made.weight = left == 0.0, left or 1.0
        made.noise = node.noise or made.named or _noise(tag, attributes, node.main)
        made.main = node.main or tag in _MAIN and not made.noise
        made.owner = made if tag in _BLOCK or made.noise else node.owner
        if tag in _BLOCK or made.noise and not node.noise:
            flush()
        node.children.append(label)
        elements.append(made)
        if tag in _VOID:
            continue
        if raw and raw.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in _RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close_tag.end() if close_tag else end
            continue
        opened.setdefault(tag, []).append(made)
        node = made
    flush()
    return blocks, elements


def host_of(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


def all_text(source: str) -> str:
    """The text of all blocks that a browser would show, noise of the page's furniture included."""
    return "\n".join(text for element, text in parse(source)[0] if not element.hidden)


def _feature(path: int, text: str) -> int:
    """Stands for a block's text at its path."""
    return _hash(f"{path} {text}")


def main_text(source: str, removed: frozenset[int] = frozenset()) -> str:
    """The main text of a page, without the branches and blocks whose paths and features are in ``removed``."""
    blocks, elements = parse(source)
    if removed:
        for e in elements:  # parents come first
            e.gone = e.parent.gone or e.path in removed
    some_main = any(e.main for e, _ in blocks)
    out = []
    for element, text in blocks:
        if element.noise or some_main and not element.main or element.gone:
            continue
        if removed and _feature(element.path, text) in removed:
            continue
        out.append(text)
    return "\n".join(out)


def page_features(source: str) -> tuple[int, dict[tuple[int, str, int], tuple[float, list[int]]]]:
    """(what the page stands for, its (path, kind, feature) -> (weight, paths of the branch up to the root)).

    kind "c": a block's text; "s": an element's child sequence; "p": the page has the path.
    Only branches that HTML's own noise doesn't settle are listed; weight and paths stand with "p"."""
    blocks, elements = parse(source)
    some_main = any(e.main for e, _ in blocks)
    found: dict[tuple[int, str, int], tuple[float, list[int]]] = {}
    for e in elements:
        if not e.noise and e.tag in _BLOCK and (e.main or not some_main):
            if (e.path, "p", 0) not in found:
                x = e
                while x.depth > MAX_DEPTH:  # at most once a path
                    x = x.parent
                weight, paths = 1.0, []
                while x.parent is not None:
                    weight = min(weight, x.weight)
                    paths.append(x.path)
                    x = x.parent
                found[(e.path, "p", 0)] = (weight, paths)
            found[(e.path, "s", _hash(",".join(e.children)))] = (1.0, [])
    shown = [(e, text) for e, text in blocks if not e.noise and (e.main or not some_main)]
    for e, text in shown:
        found[(e.path, "c", _feature(e.path, text))] = (1.0, [])
    # Equal for copies, and for near copies that differ in few blocks.
    longer = [_hash(text) for _, text in shown if text.count(" ") >= LONG_BLOCK - 1]
    return min(longer) if longer else _hash("\n".join(text for _, text in shown)), found


def _style_rows(pages: DataFrame) -> DataFrame:
    """(host, page, path, kind, feature, weight, above): what the pages of each host (a hash) show."""
    kinds = {"host": pa.int64(), "page": pa.int64(), "path": pa.int64(), "kind": pa.string(), "feature": pa.int64(), "weight": pa.float64(), "above": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source:
                    page, found = page_features(source)
                    out.extend((host, page, path, kind, feature, weight, above) for (path, kind, feature), (weight, above) in found.items())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return pages.select(F.xxhash64("host"), "html").mapInArrow(run, "host long, page long, path long, kind string, feature long, weight double, above array<long>")


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, pages, presentation, content, weight, importance) of the merged trees' nodes, and
    (host, path, feature, n, pages) of the blocks that several pages show.  ``host`` is a hash."""
    key = ["host", "path", "kind", "feature"]
    shown = _style_rows(pages).groupBy(*key, "page").agg(F.min("weight").alias("weight"), F.max("above").alias("above"))
    seen = written(shown.groupBy(*key).agg(F.count("*").alias("n"), F.min("weight").alias("weight"), F.max("above").alias("above")), "style-features")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    nodes = seen.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "p", F.col("n"))).alias("pages"),
        F.min("weight").alias("weight"),
        F.max("above").alias("above"),
        of("s", F.lit(1.0)).alias("styles"),
        of("s", F.col("n").cast("double")).alias("s_n"),
        of("s", F.col("n") * F.log("n")).alias("s_nlog"),
        of("c", F.lit(1.0)).alias("texts"),
        of("c", F.log("n")).alias("c_log"),
    )
    nodes = written(nodes.where("pages is not null"), "style-nodes")
    # Sums over the blocks of a whole branch.
    own = nodes.select("host", F.explode("above").alias("path"), "texts", F.when(F.col("pages") > 1, F.col("texts") - F.col("c_log") / F.log("pages")).otherwise(F.col("texts")).alias("v"))
    branch = own.groupBy("host", "path").agg(F.try_divide(F.sum("v"), F.sum("texts")).alias("content"))
    several = F.col("pages") > 1
    entropy = (F.log("pages") * F.col("s_n") - F.col("s_nlog")) / (F.col("pages") * F.log("pages"))
    out = nodes.join(branch, ["host", "path"], "left").withColumn("presentation", F.when(several, entropy).otherwise(F.lit(1.0)))
    share = F.pow(F.lit(GAMMA), F.greatest("styles", F.lit(1.0)))
    joined = (1 - share) * F.col("presentation") + share * F.coalesce("content", F.lit(1.0))
    out = out.select("host", "path", "pages", "presentation", "content", "weight", joined.alias("importance"))
    again = seen.where("kind = 'c' and n > 1").select("host", "path", "feature", "n").join(nodes.select("host", "path", "pages"), ["host", "path"])
    return out, again


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, path): the branches, and the features of the blocks, that are removed from the host's pages."""
    nodes, blocks = style_tree(pages)
    gone = nodes.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") * F.col("weight") < THRESHOLD)).select("host", "path")
    texts = blocks.where((F.col("pages") >= MIN_PAGES) & (1 - F.log("n") / F.log("pages") < THRESHOLD)).select("host", F.col("feature").alias("path"))
    return gone.unionByName(texts)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    rows = rows.withColumn("host", F.xxhash64("host"))
    gone = written(low_branches(pages.select("html", host_of().alias("host"))), "style-low")
    some = gone.limit(BROADCAST_BRANCHES + 1).collect()
    if len(some) <= BROADCAST_BRANCHES:
        lists: dict[str, set[int]] = {}
        for r in some:
            lists.setdefault(r["host"], set()).add(r["path"])
        shared = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in lists.items()})
        return _texts(rows.withColumn("paths", F.lit(None).cast("array<long>")), shared)
    by_host = gone.groupBy("host").agg(F.collect_set("path").alias("paths"))  # a host's own templates
    return _texts(rows.join(by_host, "host", "left"), None)


def _texts(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value if shared is not None else {}
        for batch in batches:
            texts = []
            for source, paths, host in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                removed = frozenset(paths) if paths else lists.get(host, frozenset())
                texts.append(main_text(source, removed) if source else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "paths", "host").mapInArrow(run, "page_id long, url string, text string, n_chars long")
