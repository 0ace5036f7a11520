"""Main text of web pages by wrapper induction: trees of pages of one host are aligned by simple tree
matching, nodes that stay the same are template, and varying slots are content."""
from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stage, text_of

CONSTANT_SHARE, CONSTANT_PAGES = 0.8, 4    # a node is template if so large a share of at least so many pages has the same text in it
SHAPE_NODES, SHAPE_DEPTH, ALIKE = 300, 48, 6   # bounds of the folded tree that is aligned; never of the text
TEMPLATES = 50_000             # most (host, shape) rows that are broadcast

# Kinds of elements.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
DROPPED = set("head script style noscript template svg math iframe object embed canvas audio video select button textarea form nav footer aside dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | set("p li dt dd blockquote pre td th tr figcaption hr address".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set("""nav navbar navigation menu menubar masthead footer sidebar ad ads advert adverts advertisement adsense banner promo sponsor sponsored cookie cookies
    consent gdpr notice notices popup modal overlay comment comments commentlist disqus reply replies share sharing social related recommended newsletter subscribe signup breadcrumb
    breadcrumbs pagination pager toolbar widget widgets login""".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "label", "children", "parent", "depth", "drop", "header", "path")

    def __init__(self, tag, label, parent, drop, header):
        self.tag, self.label, self.parent, self.drop, self.header = tag, label, parent, drop, header
        self.children, self.path = [], None
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """(class part of the label, whether the element is named as something else than content, whether as a header)."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", named))
    hidden = re.search(r"(?:^|\s)hidden(?:\s|$)", raw) is not None or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return ".".join(sorted(found.get("class", "").split())), bool(words & NAMES) or hidden or found.get("role", "").lower() in ROLES, "header" in words


def parse(page: str):
    """(root, blocks): block elements as a tree, and texts in page order as (node, text, characters in links).
    Inline elements only mark links; a line break is white space."""
    root = Node("#", "#", None, False, False)
    at, here, blocks, held, linked, anchors = 0, root, [], [], 0, 0

    def flush():
        nonlocal linked
        if held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((here, text, min(linked, len(text))))
            held.clear()
        linked = 0

    while True:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            held.append(piece)
            if anchors:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        if closing:
            node = here
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                here = node.parent
            continue
        anchors = 0
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in CLOSES:
            node = here
            while node.parent and node.tag not in BARRIERS[tag]:
                if node.tag in CLOSES[tag]:
                    here = node.parent
                    break
                node = node.parent
        elif here.tag == "p" or here.tag in HEADINGS and tag in HEADINGS:
            here = here.parent                          # a paragraph ends where a block begins
        classes, other, header = _attributes(raw) if raw else ("", False, False)
        node = Node(tag, f"{tag}.{classes}" if classes else tag, here, other or tag in DROPPED, header or tag == "header")
        if tag not in VOID and not raw.endswith("/"):
            here = node
    flush()
    return root, blocks


class Fold:
    """A node of the folded tree: like siblings that hold text are one node, so are sections beyond ALIKE."""
    __slots__ = ("label", "children", "number")

    def __init__(self, label, number):
        self.label, self.number, self.children = label, number, {}


def fold(root: Node):
    """Folded tree and its nodes in order; every node of the page gets the number of its folded node."""
    top = Fold(root.label, 0)
    nodes, stack, root.path = [top], [(root, top)], 0
    while stack:
        node, folded = stack.pop()
        seen: dict[str, int] = {}
        for child in node.children:
            if child.tag == "head":
                child.path = 0
                continue
            seen[child.label] = seen.get(child.label, 0) + 1
            key = child.label if child.tag in TEXTUAL else f"{child.label}[{min(seen[child.label], ALIKE)}]"
            target = folded.children.get(key)
            if target is None:
                if len(nodes) >= SHAPE_NODES or child.depth > SHAPE_DEPTH:
                    target = folded
                else:
                    target = folded.children[key] = Fold(key.split("[")[0], len(nodes))
                    nodes.append(target)
            child.path = target.number
            stack.append((child, target))
    return top, nodes


def spell(folded: Fold) -> str:
    """The folded tree as text: label(children)."""
    return f"{folded.number}:{folded.label.replace('(', '').replace(')', '').replace(' ', '')}({' '.join(spell(c) for c in folded.children.values())})"


def read_shape(text: str) -> Fold:
    top = current = None
    stack: list[Fold] = []
    for number, label, close in re.findall(r"(\d+):([^()\s]*)\(|(\))", text.replace(")", " ) ")):
        if close:
            stack.pop()
            continue
        current = Fold(label, int(number))
        if stack:
            stack[-1].children[len(stack[-1].children)] = current
        else:
            top = current
        stack.append(current)
    return top


def match(a: Fold, b: Fold) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of node pairs with equal labels that keeps parents and the
    order of siblings, and the pairs."""
    if a.label != b.label:
        return 0, []
    left, right = list(a.children.values()), list(b.children.values())
    best = [[match(x, y) for y in right] for x in left]
    score = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + best[i - 1][j - 1][0])
    pairs, i, j = [(a.number, b.number)], len(left), len(right)
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            pairs += best[i - 1][j - 1][1]
            i, j = i - 1, j - 1
    return score[-1][-1] + 1, pairs


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_SHAPES = T.StructType([T.StructField("host", T.StringType()), T.StructField("shape", T.StringType()),
                        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.LongType())])))])


def _shapes(pages: DataFrame) -> DataFrame:
    """Host, folded tree and text hash of each of its nodes, per page."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())]))

    def run(batches):
        for batch in batches:
            hosts, shapes, nodes = [], [], []
            for url, page in zip(batch.column(0), batch.column(1)):
                root, blocks = parse(page.as_py())
                top, _ = fold(root)
                texts: dict[int, list[str]] = {}
                for node, text, _ in blocks:
                    texts.setdefault(node.path or 0, []).append(text)
                hosts.append(host_of(url.as_py()))
                shapes.append(spell(top))
                nodes.append([{"node": n, "text": _hash(t)} for n, t in texts.items()])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(nodes, kind)], names=_SHAPES.names)

    return pages.select("url", "html").mapInArrow(run, _SHAPES)


def _aligned(shapes: DataFrame) -> DataFrame:
    """(host, shape, node, slot): each shape of a host is aligned with its most frequent one; a node without
    partner is a slot of its own shape."""
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("slot", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = []
            for host, shape, main in zip(*(c.to_pylist() for c in batch.columns)):
                tree = read_shape(shape)
                slots = {x: f"{y}" for x, y in match(tree, read_shape(main))[1]}
                own = hashlib.blake2b(shape.encode(), digest_size=6).hexdigest()
                for n in map(int, re.findall(r"(?:^|[( ])(\d+):", shape)):
                    rows.append((host, shape, n, slots.get(n, f"{own}:{n}")))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=schema.names)

    return shapes.select("host", "shape", "main").mapInArrow(run, schema)


def templates(pages: DataFrame) -> DataFrame:
    """Per host and shape the nodes that are template, counted over all pages of the host: those that hold the
    same text on CONSTANT_SHARE of at least CONSTANT_PAGES pages."""
    seen = stage(_shapes(pages), "page-shapes")
    shapes = stage(seen.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")), "host-shapes")
    main = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("main"))
    slots = stage(_aligned(shapes.join(main, "host")), "page-slots")
    counted = seen.select("host", "shape", F.explode("nodes").alias("x")).groupBy("host", "shape", "x.node", "x.text").agg(F.count(F.lit(1)).alias("n"))
    held = counted.join(slots, ["host", "shape", "node"]).groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))
    constant = (held.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("top"))
                .where((F.col("pages") >= CONSTANT_PAGES) & (F.col("top") >= CONSTANT_SHARE * F.col("pages"))))
    return slots.join(constant.select("host", "slot"), ["host", "slot"]).groupBy("host", "shape").agg(F.sort_array(F.collect_set("node")).alias("template"))


def main_text(page: str, template: list[int] | None) -> list[str]:
    """Blocks of the content slots.  An article element, or else a main element, is the slot: what stands in it is
    kept, but for parts that are named as something else and constant sections.  Elsewhere all slots are content
    whose text varies, is not named as something else and is not mostly links."""
    root, blocks = parse(page)
    fold(root)
    constant = set(template or ())

    def above(node):
        while node:
            yield node
            node = node.parent

    chains = {id(n): list(above(n)) for n in {id(b[0]): b[0] for b in blocks}.values()}
    holders: set[int] = set()
    for tag in ("article", "main"):
        plain, named = set(), set()
        for chain in chains.values():
            place = max((i for i, x in enumerate(chain) if x.tag == tag), default=None)
            if place is not None and not any(x.tag in DROPPED for x in chain) and not any(x.drop for x in chain[:place + 1]):
                (named if any(x.drop for x in chain) else plain).add(id(chain[place]))
        holders = plain or named                       # a comment is an article inside something named comments
        if holders:
            break
    around = {id(x) for b in blocks for i, y in enumerate(chains[id(b[0])]) if id(y) in holders for x in chains[id(b[0])][i:]}

    def wanted(node):
        chain = chains[id(node)]
        if any(x.drop and (id(x) not in around or x.tag in DROPPED) for x in chain):
            return False
        if any(x.header and id(x) not in around for x in chain):
            return bool(holders) and any(x.tag in HEADINGS for x in chain) and any(id(x) in holders for x in chain)
        return True

    kept = [b for b in blocks if wanted(b[0])]
    if holders:
        inside = [b for b in kept if any(id(x) in holders for x in chains[id(b[0])])]
        fixed = [b for b in inside if b[0].path in constant and b[0].tag not in TEXTUAL and id(b[0]) not in holders]
        if 2 * sum(len(b[1]) for b in fixed) < sum(len(b[1]) for b in inside):
            gone = {id(b) for b in fixed}
            inside = [b for b in inside if id(b) not in gone]
        return [b[1] for b in inside]
    return [b[1] for b in kept if b[0].path not in constant and 2 * b[2] <= len(b[1])]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text (content blocks joined by line ends; empty if none), n_chars (code points).

    Character references are decoded, white space inside a block becomes one space.  A null html is an empty
    page; pages whose url has no host, or is null, are pages of one host without a name; null or repeated keys are
    carried row by row.  Other columns are not read; an empty table gives no rows.

    Pages of a host are counted by hashes, so a host with a third of all pages is no larger task than
    others.  Templates are broadcast up to TEMPLATES rows; beyond that pages are joined by shuffling."""
    page = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), text_of(html).alias("html"))
    found = small(stage(templates(page), "templates"), TEMPLATES)
    shaped = T.StructType([*page.schema.fields, T.StructField("host", T.StringType()), T.StructField("shape", T.StringType())])

    def shape(batches):
        for batch in batches:
            hosts = [host_of(u.as_py()) for u in batch.column(1)]
            shapes = [spell(fold(parse(p.as_py())[0])[0]) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(shapes, pa.string())], names=shaped.names)

    out = T.StructType([page.schema["k"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = ["\n".join(main_text(p.as_py(), t.as_py())) for p, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=out.names)

    joined = page.mapInArrow(shape, shaped).join(found, ["host", "shape"], "left").select("k", "url", "html", "template")
    return joined.mapInArrow(run, out).withColumnRenamed("k", key)
