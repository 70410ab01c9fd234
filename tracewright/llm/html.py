"""Main-text extraction by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts. Elements that stand side by side under one opening tag are
folded into a repeated group, whose units are aligned with each other. The streams of a host's
pages are then aligned one after another with the wrapper so far: what both have stays, what
only one has becomes an optional group, a text that differs becomes a slot, one that never differs
is template text. Every slot is judged once for the whole host: it is text of its own if it varies
and stands, on the host's pages, in the subtree that the names of elements, classes and ids point
to (on pages without such names: anywhere that none of them rules out). A page is read by aligning
its stream with its host's wrapper, and takes the texts of the slots so judged; pages of one
structure share the alignment. Names decide alone only over parts that the wrapper has never seen
in such a place. Inside an article template text goes only with a box of its own: an element with a
class or id, below the article, that on this page holds nothing but template text. A heading that
every article has stands in the flow of the article, or in a box with text of its own, and stays.

Every page of a host has its say. Pages of one structure are merged slot by slot where they lie, so
what travels are structures with what their slots have seen, a few numbers each, and never texts; a
host's different structures are aligned a few at a time, level by level, in an order that goes by
their hashes. One host may so hold any share of all pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, BROADCAST_BYTES, bounded, by_batch, cut, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
SELF_CLOSING = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}  # the next of its kind ends it
REPEATED = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
FLAT = {"p", "dt", "dd", "option"}  # never inside one another
MOST_DEPTH = 40  # of groups inside groups; deeper elements stay single nodes of their stream
MOST_BITS = 64_000_000  # of an alignment's table held at once; larger ones are halved
AWAY_TAGS = {"nav", "footer", "aside", "form", "button", "select", "head", "dialog", "menu", "object", "map"}
MAIN_TAGS = {"article", "main"}
NO_BOX = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dt", "dd", "option", "thead", "tbody", "tfoot", "caption", "figcaption"}  # parts of what stands around them
AWAY_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr",
    "hidden", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
MAIN_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story", "text"}


#: What stands beside a main word in a name of the same meaning, as in post-body; text-center and post-list have another.
MAIN_BESIDE = {"area", "blog", "body", "column", "container", "inner", "news", "page", "single", "wrap", "wrapper"}


def _listed(sign: list[tuple], name: str, zone: str) -> tuple[bool, bool]:
    """Whether an opening tag's names stand for an away zone, for a main zone. In a main zone an id
    may be the slug of what it heads: it counts only as a whole, and on a heading not at all."""
    if name in ("html", "body"):
        return False, False
    away = main = False
    for kind, a, b, c in sign:
        slug = kind.lower() == "id" and zone == "main"
        for part in (a or b or c).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", part) if w]
            if not slug or len(words) == 1 and not re.fullmatch("h[1-6]", name):
                away = away or not AWAY_WORDS.isdisjoint(words)
            known = [w for w in words if not w.isdigit()]
            main = main or not MAIN_WORDS.isdisjoint(known) and all(w in MAIN_WORDS or w in MAIN_BESIDE for w in known)
    return away, main and name not in ("a", "span")


class Page:
    """A page's tokens: (symbol, text, zone) with zone 'away', 'main' or 'free' for texts; boxes: the
    box that a text's token stands in, if any."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str, str]] = []
        self.boxes: dict[int, int] = {}
        stack: list[tuple[str, str, bool, int]] = []  # name, zone, whether in a link, box or -1
        at, end = 0, len(source)

        def text(piece: str) -> None:
            if piece and not piece.isspace():
                _, zone, linked, box = stack[-1] if stack else ("", "free", False, -1)
                if box >= 0:
                    self.boxes[len(self.tokens)] = box
                self.tokens.append(("#a" if linked else "#", piece, zone))
            elif piece:
                self.tokens.append((" ", piece, ""))

        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                break
            text(source[at : m.start()])
            at = m.end()
            closing, name, rest = m.group(1), m.group(2), m.group(3)
            if name is None:
                if m.group(0) == "<":
                    text("<")
                continue
            name = name.lower()
            if closing:
                if any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
                self.tokens.append((f"/{name}", "", ""))
                continue
            if name in RAW:
                shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = shut.end() if shut else end
                continue
            sign = ATTRIBUTE.findall(rest) if rest and "=" in rest else []
            if name in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, around, linked, box = stack[-1] if stack else ("", "free", False, -1)
            zone = around
            if zone != "away":
                away, main = _listed(sign, name, zone)
                if name in AWAY_TAGS or name == "header" and zone != "main" or away:
                    zone = "away"
                elif name in MAIN_TAGS or main:
                    zone = "main"
            classes = ".".join(sorted((a or b or c).strip() for kind, a, b, c in sign if kind.lower() == "class"))
            self.tokens.append((f"{name}.{classes}" if classes else name, "", ""))
            if name not in VOID and not rest.rstrip().endswith("/"):
                if around == zone == "main" and name not in NO_BOX and name not in MAIN_TAGS and any(kind.lower() != "role" for kind, *_ in sign):
                    box = len(self.tokens)
                stack.append((name, zone, linked or name == "a", box))
        text(source[at:])

    def structure(self) -> list[tuple[str, int]]:
        """The symbols with their token's number, without white space and inline tags."""
        out = []
        for k, (symbol, _, _) in enumerate(self.tokens):
            if symbol == " " or symbol.lstrip("/").split(".")[0] in INLINE:
                continue
            if symbol[0] == "#" and out and out[-1][0][0] == "#":
                continue
            out.append((symbol, k))
        return out


# ---------------------------------------------------------------- wrappers
# A node is [symbol, optional, body, slot]: body is a list of nodes for a repeated group, else None;
# slot is for texts: [the zones seen, the text's hash or VARIES, the smallest digests of pages that have
# it (as many as the verdict asks for), whether linked, the tokens], and once
# judged [the verdict on pages with a main zone, on others, the zones seen, whether it varies].


VARIES = -1
ENOUGH = 3  # different pages that must have a text, always the same, before it is template text


def fold(stream: list[tuple[str, int]], page: Page, of: int, depth: int = 0) -> list[list]:
    """Nodes of a stream; neighbouring elements with one opening tag become a repeated group."""
    out: list[list] = []
    at = 0
    while at < len(stream):
        symbol, k = stream[at]
        if symbol[0] == "#":
            token = page.tokens[k]
            out.append(["#", False, None, [[token[2]], crc32(" ".join(token[1].split()).encode("utf-8", "replace")), [of], symbol == "#a", [k]]])
            at += 1
            continue
        stop = _unit(stream, at) if depth < MOST_DEPTH else None
        units = []
        start = at
        while stop and stop <= len(stream):
            units.append(stream[start:stop])
            if stop < len(stream) and stream[stop][0] == symbol:
                start, stop = stop, _unit(stream, stop)
            else:
                break
        if units and (len(units) > 1 or symbol.split(".")[0] in REPEATED):
            body: list[list] = []
            for unit in units:
                inner = [[unit[0][0], False, None, None], *fold(unit[1:], page, of, depth + 1)]
                body = align(body, inner) if body else inner
            out.append([f"+{symbol}", False, body, None])
            at += sum(map(len, units))
        else:
            out.append([symbol, False, None, None])
            at += 1
    return out


def _unit(stream: list[tuple[str, int]], at: int) -> int | None:
    """Where the element that begins at a token ends: after its closing tag."""
    symbol = stream[at][0]
    name = symbol.split(".")[0]
    if symbol[0] == "/" or name in VOID or name in ("html", "body", "article", "main"):
        return None
    depth = 0
    for k in range(at, len(stream)):
        other = stream[k][0]
        if other == f"/{name}":
            depth -= 1
            if depth <= 0:
                return k + 1
        elif other.split(".")[0] == name:
            depth += 1
            if depth > 1 and name in FLAT:
                return k
    return None


def _rows(x: list[str], y: list[str]) -> list[int]:
    """Row by row of the table of longest common subsequences: bit j is 0 where the j-th symbol of y
    makes the subsequence longer (bit-parallel, after Hyyro 2004)."""
    mask: dict[str, int] = defaultdict(int)
    for j, symbol in enumerate(y):
        mask[symbol] |= 1 << j
    every, out = (1 << len(y)) - 1, []
    row = every
    for symbol in x:
        hit = row & mask.get(symbol, 0)
        row = ((row + hit) | (row - hit)) & every
        out.append(row)
    return out


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """The longest common subsequence of x with each prefix of y."""
    row, out = _rows(x, y)[-1], [0]
    for j in range(len(y)):
        out.append(out[-1] + 1 - (row >> j & 1))
    return out


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The pairs of places that a longest common subsequence matches, whatever the lengths."""
    head = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    out = [(k, k) for k in range(head)]
    x, y = x[head:], y[head:]
    tail = next((k for k, (a, b) in enumerate(zip(x[::-1], y[::-1], strict=False)) if a != b), min(len(x), len(y)))
    ends = [(head + len(x) - k, head + len(y) - k) for k in range(tail, 0, -1)]
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if x and y and len(x) * len(y) > MOST_BITS and len(x) > 1:
        half = len(x) // 2
        ahead, behind = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])[::-1]
        cut_at = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[j])
        out += [(head + i, head + j) for i, j in _matches(x[:half], y[:cut_at])]
        out += [(head + half + i, head + cut_at + j) for i, j in _matches(x[half:], y[cut_at:])]
    elif x and y:
        rows, i, j, found = _rows(x, y), len(x), len(y), []
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                found.append((head + i, head + j))
        out += found[::-1]
    return out + ends


def _steps(wrapper: list[list], other: list[list]) -> list[tuple]:
    """The alignment of two node sequences: (kind, from, to in the wrapper, from, to in the other)."""
    x, y = [n[0] for n in wrapper], [n[0] for n in other]
    out, i, j = [], 0, 0
    for a, b in [*_matches(x, y), (len(x), len(y))]:
        if a > i or b > j:
            out.append(("replace", i, a, j, b))
        if a < len(x) or b < len(y):
            out.append(("equal", a, a + 1, b, b + 1))
        i, j = a + 1, b + 1
    return out


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """The wrapper that reads both: common nodes merge, the rest is optional."""
    out: list[list] = []
    for kind, a, b, c, d in _steps(wrapper, other):
        if kind == "equal":
            for x, y in zip(wrapper[a:b], other[c:d], strict=True):
                out.append(_merge(x, y))
        else:
            out += [[n[0], True, n[2], n[3]] for n in (*wrapper[a:b], *other[c:d])]
    return out


def _merge(x: list, y: list) -> list:
    slot = None
    if x[3] is not None:
        (zones, text, pages, linked, tokens), other = x[3], y[3]
        slot = [sorted({*zones, *other[0]}), text if text == other[1] else VARIES, sorted({*pages, *other[2]})[:ENOUGH], linked and other[3], tokens + other[4]]
    return [x[0], x[1] or y[1], align(x[2], y[2]) if x[2] is not None else None, slot]


def learned(source: str) -> list[list]:
    """The wrapper that reads one page, with what its slots have seen."""
    page = Page(source)
    nodes = fold(page.structure(), page, int.from_bytes(hashlib.blake2b(source.encode("utf-8", "replace"), digest_size=7).digest(), "big"))
    for slot in _slots(nodes):
        slot[4] = []
    return nodes


def grown(parts) -> list[list]:
    """The wrapper that reads all of parts, pairs of a structure's name and a wrapper: those of one
    structure are merged, whatever their order, and the structures aligned in the order of names."""
    known: dict[str, list[list]] = {}
    for name, nodes in parts:
        known[name] = align(known[name], nodes) if name in known else nodes
    wrapper: list[list] = []
    for name in sorted(known):
        wrapper = align(wrapper, known[name]) if wrapper else known[name]
    return wrapper


def judged(wrapper: list[list]) -> list[list]:
    """The wrapper with every slot judged: whether it is text of its own on a page with a main zone
    (template text in boxes of its own set aside), and on one without. A slot is template text if
    three different pages or more have it and all with the same text."""
    for slot in _slots(wrapper):
        zones, text, pages, linked, _ = slot
        varies = len(pages) < ENOUGH or text == VARIES
        slot[:] = ["main" in zones, varies and not linked and zones != ["away"], zones, varies]
    return wrapper


def infer(pages: list[str]) -> list[list]:
    """The judged wrapper of a host from all its pages."""
    return judged(grown((_named(nodes), nodes) for nodes in map(learned, pages)))


def _slots(nodes: list[list]):
    for node in nodes:
        if node[2] is not None:
            yield from _slots(node[2])
        elif node[3] is not None:
            yield node[3]


def _shape(nodes: list[list]) -> str:
    return "(" + " ".join(n[0] + (_shape(n[2]) if n[2] is not None else "") for n in nodes) + ")"


def _named(nodes: list[list]) -> str:
    return hashlib.blake2b(_shape(nodes).encode("utf-8", "replace"), digest_size=16).hexdigest()


def _read(wrapper: list[list], nodes: list[list], verdicts: dict[int, list]) -> None:
    """Verdicts of the page's slots, numbered in the order of _slots, from the aligned wrapper."""
    for kind, a, b, c, _ in _steps(wrapper, nodes):
        if kind != "equal":
            continue
        for x, y in zip(wrapper[a:b], nodes[c:], strict=False):
            if y[2] is not None:
                _read(x[2], y[2], verdicts)
            elif y[3] is not None:
                verdicts[id(y[3])] = x[3]


def main_text(source: str, wrapper: list[list] | None, known: dict | None = None) -> str:
    """The main text of a page: blocks in page order, joined by a line break."""
    page = Page(source)
    nodes = fold(page.structure(), page, 0)
    slots = list(_slots(nodes))
    key = _shape(nodes) if known is not None else ""
    if known is not None and key in known:
        judged = known[key]
    else:
        verdicts: dict[int, list] = {}
        _read(wrapper or [], nodes, verdicts)
        judged = [verdicts.get(id(s)) for s in slots]
        if known is not None and len(known) < 4096:
            known[key] = judged
    has_main = any(zone == "main" for symbol, _, zone in page.tokens if symbol[0] == "#")
    taken: dict[int, list] = {}
    for slot, verdict in zip(slots, judged, strict=True):
        for k in slot[4]:
            taken[k] = verdict
    lively: set[int] = set()  # boxes that hold more than template text
    for k, box in page.boxes.items():
        if k in taken and (taken[k] is None or taken[k][3]):
            lively.add(box)
    blocks, block, verdict = [], [], None
    for k, (symbol, text, zone) in enumerate(page.tokens):
        name = symbol.lstrip("/").split(".")[0]
        if symbol[0] == "#":
            verdict = taken[k] if k in taken else verdict  # the first of a run of texts stands for all
            if verdict is not None and zone in verdict[2]:
                own = verdict[1]
                if has_main:
                    own = verdict[0] and (verdict[3] or page.boxes.get(k) is None or page.boxes[k] in lively)
            else:
                own = zone == ("main" if has_main else "free")
            if own and zone != "away":
                block.append(text)
        elif symbol == " " or name == "br":
            block.append(" ")
        elif name not in INLINE:
            verdict = None
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    cleaned = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


# ---------------------------------------------------------------- distributed


def host(url: str = "url"):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def wrappers(pages: DataFrame, at_once: int = 32, held: int = 50_000) -> DataFrame:
    """pages(host, html) to (host, wrapper): a wrapper as JSON for every host, from all its pages. A
    task merges pages of one structure as it reads them and hands on what it has after ``held`` nodes.
    A group gets about ``at_once`` rows of one structure, or structures of one host, at a time."""
    import pyarrow as pa

    spark, made = pages.sparkSession, "host string, shape string, nodes string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # rows are whole pages

    def text(nodes: list[list]) -> str:
        return json.dumps(nodes, separators=(",", ":"))

    def seen(batches):
        found: dict[tuple[str, str], list[list]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([text(x) for x in found.values()], pa.string())], ["host", "shape", "nodes"])

        for batch in batches:
            for host, source in zip(batch["host"], batch["html"], strict=True):
                nodes = learned(source.as_py())
                key = host.as_py(), _named(nodes)
                if key in found:
                    found[key] = align(found[key], nodes)
                    continue
                found[key] = nodes
                size += 1 + sum(1 for _ in _every(nodes))
                if size > held:
                    yield rows()
                    found.clear()
                    size = 0
        yield rows()

    def together(group: pa.Table) -> pa.Table:
        names = group["shape"].to_pylist()
        nodes = grown((name, json.loads(x.as_py())) for name, x in zip(names, group["nodes"], strict=True))
        return pa.table([pa.array([group["host"][0].as_py()]), pa.array([min(names)]), pa.array([text(nodes)])], ["host", "shape", "nodes"])

    def done(group: pa.Table) -> pa.Table:
        last = together(group)
        return pa.table([last["host"], pa.array([text(judged(json.loads(last["nodes"][0].as_py())))])], ["host", "wrapper"])

    most = lambda df: df.agg(F.max("n")).first()[0] or 0
    rows = cut(pages.select("host", "html").mapInArrow(seen, made))
    while (n := most(rows.groupBy("host", "shape").agg(F.count("*").alias("n")))) > at_once:
        deal = F.pmod(F.monotonically_increasing_id(), F.lit(-(-n // at_once)))
        rows = cut(rows.withColumn("deal", deal).groupBy("host", "shape", "deal").applyInArrow(together, made))
    level = 0
    while most(sizes := rows.groupBy("host").agg(F.count_distinct("shape").alias("n"))) > at_once:
        deal = F.when(F.col("n") > at_once, F.pmod(F.xxhash64("shape", F.lit(level)), F.ceil(F.col("n") * 2 / at_once))).otherwise(0)
        rows = cut(rows.join(sizes, "host").withColumn("deal", deal).groupBy("host", "deal").applyInArrow(together, made))
        level += 1
    return rows.groupBy("host").applyInArrow(done, "host string, wrapper string")


def _every(nodes: list[list]):
    """All nodes, those of groups too."""
    for node in nodes:
        yield node
        yield from _every(node[2] or [])


def extractor():
    """A vectorised function from html and its host's wrapper to main text."""
    import pyarrow as pa

    def of(sources: pa.Array, found: pa.Array) -> pa.Array:
        read: dict = {}
        out = []
        for source, wrapper in zip(sources.to_pylist(), found.to_pylist(), strict=True):
            if wrapper not in read:
                if len(read) >= 256:
                    read.clear()
                read[wrapper] = (json.loads(wrapper) if wrapper else [], {})
            out.append(main_text(source or "", *read[wrapper]))
        return pa.array(out, pa.string())

    of.__annotations__ = {"sources": pa.Array, "found": pa.Array, "return": pa.Array}
    return by_batch(of, "string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A text that stands in the same place of three pages of a host or more, always the same, is template
    text; inside an article it goes with a box of its own only. A very long page is aligned whole, in bounded memory; groups nested
    more than 40 deep are not folded. Equal pages are read alike and count as one in the wrapper.

    A null or empty html has the empty text; a null url, or one without a host, belongs to the host
    with the empty name; equal rows each have their own row; null ids stay null. Extra columns are
    not read. An empty table gives no rows. The wrappers are broadcast if they have at most
    broadcast_bytes, and joined by shuffle beyond that."""
    rows = pages.select("page_id", "url", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = bounded(cut(wrappers(rows)), broadcast_bytes)
    out = rows.join(found, "host", "left").select("page_id", "url", extractor()("html", "wrapper").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
