"""Main text of web pages by wrappers induced from pages of the same host."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import in_batches, rows_of
from barloom.llm.html_tree import BLOCK, Node, blocks, parse, walk
from barloom.session import persist_table

BROADCAST_BYTES = 8 << 20
# Bounds of the trees that are aligned; what lies beyond is compared by path, and extraction reads whole pages.
_DEPTH, _CHILDREN = 8, 150
#: Text inside articles is template if so many articles that are no copies and this percentage of all the host's different ones hold it.
LEAST_ARTICLES, TEMPLATE_PERCENT = 4, 80
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that never hold main text.
_SKIPPED = frozenset(
    "head script style nav header footer aside form noscript template iframe button select textarea input svg canvas "
    "object dialog menu title".split()
)
#: Class, id or role words of boilerplate.
_HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices popup promo promoted related replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split()
)
_WORD = re.compile(r"[-_]+")


def boilerplate(node: Node) -> bool:
    if node.tag in _SKIPPED:
        return True
    if not node.names or node.tag in ("html", "body"):
        return False
    for name in node.names.split():
        words = _WORD.split(name)
        if words[0] not in ("has", "with", "no") and not _HINTS.isdisjoint((words[0], words[-1])):
            return True
    return False


def text_of(node: Node) -> str:
    return "\n".join(blocks(node, boilerplate))


def simple_tree_matching(a: Node, b: Node, depth: int = 0) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the largest order-preserving top-down mapping of two trees, and its pairs.

    Roots must share their label; below, the children's best sequence of
    matches is found by dynamic programming over both child lists.
    """
    if a.label != b.label:
        return 0, []
    if depth >= _DEPTH:
        return 1, [(a, b)]
    left, right = a.elements()[:_CHILDREN], b.elements()[:_CHILDREN]
    below = [[simple_tree_matching(x, y, depth + 1) if x.label == y.label else None for y in right] for x in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left)):
        for j in range(len(right)):
            match = below[i][j]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (match[0] if match else 0))
    pairs = [(a, b)]
    i, j = len(left), len(right)
    while i and j:
        match = below[i - 1][j - 1]
        if match and best[i][j] == best[i - 1][j - 1] + match[0]:
            pairs += match[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one host: where content varies, and which text is template.

    The plain form of what :func:`induce_wrappers` counts over all pages of every host.
    """
    trees = [parse(p) for p in pages]
    if not trees:
        return {"content": None, "template": [], "inside": []}
    n, nodes = len(trees), reference_texts(trees[0])
    same, varied, held = Counter(), Counter(), Counter()
    for tree in trees:
        for k, alike in aligned_texts(trees[0], tree):
            (same if alike else varied)[k] += 1
        held.update({_key(path, own) for path, own in _texts(tree)})
    most = {k: 100 * same[k] >= TEMPLATE_PERCENT * (same[k] + varied[k]) for k in nodes if 2 * (same[k] + varied[k]) > n > 1}
    slots, fixed = ({nodes[k] for k, all_same in most.items() if all_same == kind} for kind in (False, True))
    template = fixed | {key for key, m in held.items() if 2 * m > n > 1} - slots
    weight: Counter = Counter()
    for tree in trees:
        if not _articles(tree)[0]:
            weight.update(varying_mass(tree, template))
    holders = [p for p, w in weight.items() if 10 * w >= 9 * weight[""] > 0]
    articles = {tuple(sorted(own.items())): own for own in map(article_texts, trees) if own}.values()
    met = Counter(key for own in articles for key in own)
    common = {key for key, m in met.items() if m >= LEAST_ARTICLES and 100 * m >= TEMPLATE_PERCENT * len(articles)}
    witnesses: dict[int, set] = {}
    for own in articles:
        rest = {key: size for key, size in own.items() if key not in common}
        if 2 * sum(rest.values()) >= sum(own.values()):
            longest = max(rest, key=lambda key: (rest[key], key))
            for key in common & own.keys():
                witnesses.setdefault(key, set()).add(longest)
    inside = [key for key, tops in witnesses.items() if len(tops) >= LEAST_ARTICLES]
    return {"content": max(holders, key=len, default=None), "template": sorted(template), "inside": sorted(inside)}


def _texts(page: Node) -> Iterator[tuple[str, str]]:
    """(path, own text) of all elements with text of their own."""
    for node, path in walk(page):
        own = _own_text(node)
        if own:
            yield path, own


def reference_texts(page: Node) -> dict[int, int]:
    """The key of each element with text of its own, by the element's place on the page."""
    return {k: _key(path, own) for k, (node, path) in enumerate(walk(page)) if (own := _own_text(node))}


def aligned_texts(reference: Node, page: Node) -> list[tuple[int, bool]]:
    """Places of the reference's elements with text that the page is aligned with, and whether it holds the same text there."""
    pairs = {id(x): y for x, y in simple_tree_matching(reference, page)[1]}
    found = ((k, own, pairs.get(id(node))) for k, (node, _) in enumerate(walk(reference)) if (own := _own_text(node)))
    return [(k, own == _own_text(other)) for k, own, other in found if other is not None]


def varying_mass(page: Node, template: set[int]) -> dict[str, int]:
    """Length of the text that is not template, outside boilerplate, in and below the largest element of each path."""
    weight: dict[str, int] = {}

    def mass(node: Node, path: str, depth: int) -> int:
        if boilerplate(node):
            return 0
        own = _own_text(node)
        total = len(own) if own and _key(path, own) not in template else 0
        if depth < 60:
            total += sum(mass(c, f"{path}/{c.label}", depth + 1) for c in node.elements())
        weight[path] = max(weight.get(path, 0), total)
        return total

    mass(page, "", 0)
    return weight


def article_texts(page: Node) -> dict[int, int]:
    """Keys of the own texts within a page's article elements, outside boilerplate, each with its length."""
    out: dict[int, int] = {}
    for _, nodes in _articles(page)[0]:
        for node, path in nodes:
            own = _own_text(node)
            if own:
                out[_key(path, own)] = len(own)
    return out


def _articles(page: Node) -> tuple[list[tuple[Node, list[tuple[Node, str]]]], list[tuple[Node, str]]]:
    """The outermost article elements, else main elements, with their nodes, and all nodes, without boilerplate."""
    every: list[tuple[Node, str]] = []
    found: dict[str, list[tuple[Node, list[tuple[Node, str]]]]] = {"article": [], "main": []}
    stack: list[tuple[Node, str, dict]] = [(page, "", {})]
    while stack:
        node, path, within = stack.pop()
        if boilerplate(node):
            continue
        if node.tag in found and node.tag not in within:
            nodes: list[tuple[Node, str]] = []
            found[node.tag].append((node, nodes))
            within = {**within, node.tag: nodes}
        for nodes in within.values():
            nodes.append((node, path))
        every.append((node, path))
        stack += [(c, f"{path}/{c.label}", within) for c in reversed(node.elements())]
    return found["article"] or found["main"], every


def _key(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")) >> 1


def _own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


def _left_out(nodes: list[tuple[Node, str]], template: frozenset[int], headings: bool) -> set[int]:
    """Ids of the nodes (in page order) that hold template text and nothing else.

    A node with other text below it stays whole, as does a phrase within a block
    that stays. With ``headings`` a heading stays if anything up to the next one does.
    """
    known = {id(n) for n, path in nodes if template and (own := _own_text(n)) and _key(path, own) in template}
    if not known:
        return known
    kept: set[int] = set()
    gone: set[int] = set()
    for node, _ in reversed(nodes):
        below = node.elements()
        if id(node) not in known and _own_text(node) or any(id(c) in kept for c in below):
            kept.add(id(node))
        elif id(node) in known or any(id(c) in gone for c in below):
            gone.add(id(node))
    out: set[int] = set()
    for node, _ in nodes:
        if id(node) not in kept:
            continue
        below = node.elements()
        loose = node.tag in BLOCK and not _own_text(node) and not any(id(c) in kept and c.tag not in BLOCK for c in below)
        follows = False
        for child in reversed(node.children):
            if isinstance(child, str):
                follows = follows or bool(child.strip())
                continue
            heading = headings and child.tag in _HEADINGS
            if id(child) in gone and (loose or child.tag in BLOCK) and not (heading and follows):
                out.add(id(child))
            follows = not heading and (follows or id(child) in kept)
    return out


def extract(html: str, wrapper: dict) -> str:
    """The blocks of a page's main text, joined by line feeds.

    Article elements, else main elements, are read whole but for boilerplate and for
    blocks that the wrapper knows as template ``inside`` articles. A page
    without one is read at the wrapper's content path, else in its body, and
    there text that the wrapper knows as template is left out as well.
    """
    page = parse(html)
    articles, every = _articles(page)
    if articles:
        inside = frozenset(wrapper.get("inside") or ())
        out = []
        for node, nodes in articles:
            known = _left_out(nodes, inside, True)
            out += blocks(node, lambda n, known=known: boilerplate(n) or id(n) in known)
        return "\n".join(out)
    content = wrapper.get("content") or ""
    roots = [n for n, path in every if path == content] or [page]
    known = _left_out(every, frozenset(wrapper.get("template") or ()), False)
    return "\n".join(b for node in roots if id(node) not in known for b in blocks(node, lambda n: boilerplate(n) or id(n) in known))


@lru_cache(maxsize=256)
def _wrapper(text: str | None) -> dict:
    found = json.loads(text) if text else {}
    return found | {kind: frozenset(found.get(kind) or ()) for kind in ("template", "inside")}


@lru_cache(maxsize=64)
def _reference(html: str) -> Node:
    return parse(html)


def references(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, reference): one page of each host, the first by a hash of id and address, to align the others with.

    The choice is made on hosts and hashes alone; each task passes on one row of a host,
    so a host with most of the pages costs no more than others.
    """
    order = Window.partitionBy("host").orderBy("order", "page_id", "url", "hash")
    chosen = (
        pages.filter("html IS NOT NULL")
        .select("host", "page_id", "url", F.xxhash64("page_id", "url").alias("order"), F.xxhash64("html").alias("hash"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= 1)
        .select(F.col("host").alias("h"), F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("hash").alias("x"))
    )
    chosen = persist_table(chosen, "chosen")
    size = chosen.agg(F.sum(F.octet_length("h") + F.octet_length(F.coalesce("u", F.lit(""))) + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        chosen = F.broadcast(chosen)
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("host") == F.col("h"))
    found = pages.join(chosen, same & (F.xxhash64("html") == F.col("x")))
    return found.select("host", F.col("html").alias("reference")).dropDuplicates(["host"])


def page_facts(pages: DataFrame, table: DataFrame, joined) -> DataFrame:
    """What the wrappers are counted from, one row for each page with markup.

    ``article`` is a digest of the texts within articles (null: none) and ``inside`` their keys and sizes; ``plain`` tells
    pages with text and without an article. ``texts`` are the keys of all texts, ``same`` and ``varied`` the places
    on the host's reference that the page is aligned with.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for host, html, reference in rows_of(batches, "host", "html", "reference"):
                page, first = parse(html), _reference(reference)
                own, texts = article_texts(page), sorted({_key(path, text) for path, text in _texts(page)})
                digest = xxhash.xxh64_intdigest(repr(sorted(own.items()))) >> 1 if own else None
                inside = [{"size": size, "key": key} for key, size in own.items()]
                aligned = aligned_texts(first, page)
                same, varied = ([k for k, alike in aligned if alike == kind] for kind in (True, False))
                yield host, digest, inside, bool(texts) and not own and not _articles(page)[0], texts, same, varied

        return in_batches(rows(), FACTS, 1000)

    found = joined(pages.filter("html IS NOT NULL"), table).select("host", "html", "reference")
    return found.mapInArrow(
        read, "host string, article bigint, inside array<struct<size: bigint, key: bigint>>, plain boolean, texts array<bigint>, same array<int>, varied array<int>"
    )


def template_keys(facts: DataFrame, table: DataFrame) -> DataFrame:
    """(host, template): keys of template text, for hosts with pages that hold no article.

    Text that more than half of a host's pages hold at its path is template, unless it stands at an element of the
    reference that most pages are aligned with and where less than ``TEMPLATE_PERCENT`` of them have that text.
    """
    asked = facts.filter("plain").select("host").distinct()
    facts = facts.join(asked, "host", "left_semi")
    pages = facts.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(((h, k, key) for h, html in rows_of(batches, "host", "reference") for k, key in reference_texts(parse(html)).items()), PLACES)

    met = facts.select("host", F.explode("same").alias("k"), F.lit(1).alias("s")).unionAll(facts.select("host", F.explode("varied"), F.lit(0)))
    met = met.groupBy("host", "k").agg(F.sum("s").alias("s"), F.count("*").alias("m")).join(pages, "host").filter("2 * m > n")
    keys = table.join(asked, "host", "left_semi").mapInArrow(places, "host string, k int, key bigint")
    at = met.join(keys, ["host", "k"]).groupBy("host", "key").agg(F.max(F.expr(f"100 * s >= {TEMPLATE_PERCENT} * m")).alias("fixed"))
    held = facts.select("host", F.explode("texts").alias("key")).groupBy("host", "key").agg(F.count("*").alias("m"))
    most = held.join(pages, "host").filter("2 * m > n").join(at, ["host", "key"], "left").filter("coalesce(fixed, true)").select("host", "key")
    both = most.union(at.filter("fixed").select("host", "key")).distinct()
    return both.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))


def inside_keys(facts: DataFrame, joined) -> DataFrame:
    """(host, inside): keys of text within articles that is template.

    ``TEMPLATE_PERCENT`` of all different articles of the host hold it, and among them ``LEAST_ARTICLES`` that
    are not copies of one another: at least half of their text is not held in common so, and their longest such texts
    differ. Exact copies count once.
    """
    articles = facts.filter("article IS NOT NULL").select("host", "article", "inside").dropDuplicates(["host", "article"])
    whole = articles.groupBy("host").agg(F.count("*").alias("articles")).filter(f"articles >= {LEAST_ARTICLES}")
    met = articles.select("host", F.explode("inside.key").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(f"n >= {LEAST_ARTICLES}")
    common = met.join(whole, "host").filter(f"100 * n >= {TEMPLATE_PERCENT} * articles").groupBy("host").agg(F.collect_list("key").alias("common"))
    size = "aggregate({}, 0L, (total, t) -> total + t.size)"
    told = joined(articles, persist_table(common, "common")).withColumns(
        {"rest": F.expr("filter(inside, t -> NOT array_contains(common, t.key))"), "both": F.array_intersect("inside.key", "common")}
    )
    told = told.filter(F.expr(f"2 * {size.format('rest')} >= {size.format('inside')}")).select("host", F.explode("both").alias("key"), F.array_max("rest").alias("longest"))
    tops = told.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).filter(f"n >= {LEAST_ARTICLES}")
    return tops.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("inside"))


def content_paths(pages: DataFrame, templates: DataFrame, joined) -> DataFrame:
    """(host, content): the deepest path that holds most of the varying text of the host's pages without an article."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for host, html, template in rows_of(batches, "host", "html", "template"):
                page = parse(html)
                if not _articles(page)[0]:
                    for path, mass in varying_mass(page, _wrapper(template)["template"]).items():
                        yield host, path, mass

        return in_batches(rows(), MASS)

    found = joined(pages.filter("html IS NOT NULL"), templates).select("host", "html", "template")
    mass = found.mapInArrow(read, "host string, path string, mass bigint").groupBy("host", "path").agg(F.sum("mass").alias("mass"))
    whole = mass.filter("path = ''").select("host", F.col("mass").alias("whole"))
    deepest = mass.join(whole, "host").filter("10 * mass >= 9 * whole AND whole > 0")
    return deepest.groupBy("host").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("content"))


def induce_wrappers(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, wrapper) from all pages of each host.

    Every page is read once and aligned with the host's reference; which texts are template is counted over all
    pages, and the content path over all of those without an article element.
    """

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        return with_hosts(rows, table, broadcast_bytes)

    table = persist_table(references(pages, broadcast_bytes), "references")
    facts = persist_table(page_facts(pages, table, joined), "page-facts")
    inside = inside_keys(facts, joined)
    plain = facts.filter("plain").select("host").distinct()
    templates = plain.join(template_keys(facts, table), "host", "left").select("host", F.to_json(F.struct("template")).alias("template"))
    templates = persist_table(templates, "templates")
    content = content_paths(pages, templates, joined)
    parts = templates.join(content, "host", "left").join(inside, "host", "full")
    template = F.from_json("template", "template array<bigint>")["template"].alias("template")
    return parts.select("host", F.to_json(F.struct("content", template, "inside")).alias("wrapper"))


def with_hosts(rows: DataFrame, table: DataFrame, broadcast_bytes: int, how: str = "inner") -> DataFrame:
    """Rows with a written table by host: a broadcast if that is small, else a shuffled join that adaptive execution splits."""
    size = table.agg(F.sum(sum((F.octet_length(F.to_json(F.struct(c))) for c in table.columns), F.lit(16)))).first()[0] or 0
    return rows.join(F.broadcast(table) if size <= broadcast_bytes else table, "host", how)


_KEYS = pa.list_(pa.int64())
FACTS = pa.schema(
    [("host", pa.string()), ("article", pa.int64()), ("inside", pa.list_(pa.struct([("size", pa.int64()), ("key", pa.int64())]))),
     ("plain", pa.bool_()), ("texts", _KEYS), ("same", pa.list_(pa.int32())), ("varied", pa.list_(pa.int32()))]
)
PLACES = pa.schema([("host", pa.string()), ("k", pa.int32()), ("key", pa.int64())])
MASS = pa.schema([("host", pa.string()), ("path", pa.string()), ("mass", pa.int64())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from its whole markup.

    Wrappers are induced from all pages of a host, written to the shared folder, and joined to
    all pages by host: as a broadcast when their written size is below
    ``broadcast_bytes``, else as a shuffled join that adaptive execution splits
    for hosts with many pages.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed. Null and empty markup gives an
    empty text; pages without a readable host share one wrapper; equal rows give
    equal rows; an empty table gives no rows; further columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    own = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"), host.alias("host"),
    )
    wrappers = persist_table(induce_wrappers(own, broadcast_bytes), "wrappers")
    joined = with_hosts(own, wrappers, broadcast_bytes, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for page_id, url, html, wrapper in rows_of(batches, "page_id", "url", "html", "wrapper"):
                text = extract(html or "", _wrapper(wrapper))
                yield page_id, url, text, len(text)

        return in_batches(rows(), TEXTS, 1000)

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
