"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree: a node is a path of tags, class names and, for
boxes without names, places among their like. A node's presentation importance is the entropy of the
child sequences that pages show below it; its content importance is one less the mean entropy of its
texts over the pages they are on; both in units of log m, m being the pages that have the node, so
that what looks or reads the same on every page has none, and what is on one page only has all. A
branch (a node with all below it) is worth as much as its most important node. From the second page
of a host on, the tree decides, for every block of text:

* a branch worth less than ``LEAST`` goes, within an ``article`` or ``main`` element only if it is a
  box (``div``, ``section``, a list, a table);
* outside such an element, a branch worth less than ``POOR`` goes unless it holds half of the page's text.

What the tree has not enough pages to tell, or finds important on each page (readers' comments, adverts
that differ), goes by its tag, role or name: menus, headers, footers, sidebars, notices, adverts, forms,
comments. Of what is left, blocks of an ``article`` or ``main`` element are the text if there are any. If
the tree would remove a page's whole text, it removes nothing from that page.

Counts of (host, node, child sequence or text) are added up before they meet, and a host with a third
of all pages is many nodes in many tasks. Pages are read twice. Low nodes are broadcast, or, where
they are too many, joined by host and one of ``SALTS`` shares of its pages.

Defined results: null html is empty and gives an empty text; a null url is a host of its own;
repeated rows stay; an empty table gives no rows.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.data import table
from tidemark.llm.html_dom import Block, read
from tidemark.llm.storage import written

LEAST, POOR = 0.2, 0.75
PAGES = 2
BROADCAST_ROWS = 300_000
SALTS = 32
BOXES = frozenset("div section ul ol dl table details figure header aside nav".split())
PAGE, SHAPE, TEXT, BELOW = range(4)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def observed(page: str) -> set[tuple[int, int, int]]:
    """(node, kind, feature) of a page: that it has the node; the child sequences below it; its
    texts; the nodes above it."""
    out = set()
    for x in read(page):
        if isinstance(x, Block):
            out.add((x.key, TEXT, _digest(x.text)))
            continue
        out.add((x.key, PAGE, 0))
        shape = [t for i, t in enumerate(x.children) if not i or t != x.children[i - 1]]  # repeats of a tag are one
        if shape:
            out.add((x.key, SHAPE, _digest(" ".join(shape))))
        out.add((x.key, BELOW, x.parent))
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            seen: Counter = Counter()
            for site, page in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                if page:
                    seen.update((site, *x) for x in observed(page))
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.int32()), pa.array([k[3] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "node", "kind", "feature", "n"])


def importance(pages: DataFrame) -> DataFrame:
    """``host``, ``node``, ``parent``, ``pages``, ``importance`` of each node of each style tree.
    ``pages`` has ``host`` and ``html``."""
    seen = pages.select("host", "html").mapInArrow(_observe, "host string, node long, kind int, feature long, n long")
    counts = seen.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    n, spread = F.col("n"), F.col("n") * F.log(F.col("n"))
    sums = counts.groupBy("host", "node").agg(of(PAGE, n).alias("pages"), of(SHAPE, n).alias("shapes"), of(SHAPE, spread).alias("shape_log"), of(TEXT, n).alias("texts"), of(TEXT, spread).alias("text_log"), F.max(F.when(F.col("kind") == BELOW, F.col("feature"))).alias("parent"))
    m = F.log(F.col("pages"))
    shape = F.log("shapes") - F.col("shape_log") / F.col("shapes")  # entropy of n/shapes
    text = 1 - F.col("text_log") / F.col("texts") / m
    value = F.when(F.col("pages") <= 1, 1.0).otherwise(F.greatest(F.coalesce(shape / m, F.lit(0.0)), F.coalesce(text, F.lit(0.0))))
    return sums.select("host", "node", "parent", "pages", value.alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """``host``, ``node``, ``poor`` of the branches without importance: a node whose importance and
    that of all nodes below it is less than ``LEAST``, or (``poor``) less than ``POOR``. Important nodes
    save the nodes above them, a level at a time, until no node is saved."""
    nodes = written(importance(pages).filter(F.col("node") != 0), "style-tree", small=True).withColumn("poor", F.explode(F.array(F.lit(False), F.lit(True))))
    key = ["host", "node", "poor"]
    low = nodes.filter((F.col("pages") >= PAGES) & (F.col("importance") < F.when(F.col("poor"), POOR).otherwise(LEAST))).select(*key, "parent")
    low = written(low, "low", small=True)
    above = lambda rows: rows.select("host", F.col("parent").alias("node"), "poor").distinct()
    saving = above(nodes.join(low, key, "left_anti"))
    while True:
        saved = written(low.join(saving, key, "left_semi"), "saved", small=True)
        if saved.isEmpty():
            return low.select(*key)
        low = written(low.join(saved, key, "left_anti"), "low", small=True)
        saving = above(saved)


def judged(page: str | None, low: frozenset = frozenset(), poor: frozenset = frozenset()) -> tuple[str, int, int]:
    """The article of a page, the blocks that its host's style tree removes from it, and the further ones
    that tags, roles and names remove. ``low`` and ``poor`` are the branches of :func:`low_branches`."""
    blocks, boxes = [], set()
    for x in read(page or ""):
        if isinstance(x, Block):
            blocks.append(x)
        elif x.tag in BOXES and x.key in low:
            boxes.add(x.key)
    size: Counter = Counter()
    for b in blocks:
        for key in b.path:
            size[key] += len(b.text)
    half = sum(len(b.text) for b in blocks) / 2
    slight = {key for key in poor if size.get(key, 0) < half}
    by_tree = [bool(boxes.intersection(b.path) if b.article else low.intersection(b.path) or slight.intersection(b.path)) for b in blocks]
    if all(x or b.noise for b, x in zip(blocks, by_tree, strict=True)):
        by_tree = [False] * len(blocks)
    left = [b for b, x in zip(blocks, by_tree, strict=True) if not x and not b.noise]
    chosen = [b for b in left if b.article] or left
    return " ".join(b.text for b in chosen), sum(by_tree), sum(b.noise and not x for b, x in zip(blocks, by_tree, strict=True))


def main_text(page: str | None, low: frozenset = frozenset(), poor: frozenset = frozenset()) -> str:
    return judged(page, low, poor)[0]


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_tree`` and ``n_names`` (blocks removed by the host's tree, and
    by tags, roles and names only), one row a page."""
    kind = pages.schema[page_id].dataType.simpleString()
    base = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.col(html).alias("html"))
    of = lambda poor: F.collect_list(F.when(F.col("poor") == poor, F.col("node")))
    low = written(low_branches(base).groupBy("host").agg(of(False).alias("low"), of(True).alias("poor")), "low-branches", small=True)
    few = low.agg(F.count("*"), F.coalesce(F.sum(F.size("low") + F.size("poor")), F.lit(0))).first()
    if few[0] + few[1] <= BROADCAST_ROWS:
        rows = base.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = base.withColumn("salt", F.pmod(F.xxhash64("page", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    rows = rows.select("page", "url", "html", "low", "poor")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                found = [judged(p, frozenset(x or ()), frozenset(y or ())) for p, x, y in zip(*(some.column(c).to_pylist() for c in ("html", "low", "poor")), strict=True)]
                yield pa.record_batch([some.column("page"), some.column("url"), pa.array([f[0] for f in found], pa.string()), *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]], names=["page", "url", "text", "n_tree", "n_names"])

    return rows.mapInArrow(extract, f"page {kind}, url string, text string, n_tree long, n_names long").select(F.col("page").alias(page_id), F.col("url").alias(url), "text", "n_tree", "n_names")


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
