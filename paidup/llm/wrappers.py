"""Main text of pages by wrapper induction over the pages of a host.

The pages of a host are put apart by layout: the set of their containers with their classes. The trees of the pages
of a layout are aligned with the tree of one of them by simple tree matching; siblings of one kind in a
row are one slot that repeats. Over all pages of the layout it is then counted which text, of any
length, stands in which slot. A text that stands in the same slot of most different pages that have
this slot is template, what varies is content. Where all texts of a slot are constant, three different
pages are enough; a slot that also holds varying texts needs eight, so that a few near copies of an
article don't take each other's paragraphs. Pages without any element are not chosen as the model.
Elements that are never article text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments) go by their names, before and beyond that, so pages of small hosts have a result, too.

Null html is empty and gives an empty text. Pages without a host are aligned with nothing. Rows repeat as given.
Trees may nest to any depth: nothing here is recursive.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.dom import Node, blocks, parse
from paidup.llm.session import prepared
from paidup.workspace import Workspace

#: Share of the different pages with a slot that makes a text of it constant.
SHARE = 0.6
#: So many different pages must have the slot: where all its texts are constant, and where others vary (as the paragraphs of articles do).
PAGES, MIXED = 3, 8
#: Containers, and lists and tables with a class; the different ones of a page are its layout.
CLASSED = (
    r"(?i)<((?:(?:article|aside|body|div|footer|header|main|nav|section)\b|(?:dl|ol|table|ul)(?=\s[^>]*?\bclass))"
    r"(?:\s[^>]*?\bclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)"
)

DROPPED = set(
    "head nav footer aside form script style noscript template iframe object embed svg math canvas audio video map button"
    " select option datalist input textarea label dialog menu title link meta".split()
)
#: Parts of class names and ids of what is no article text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent"
    r"|notices?|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommended|comments?|commentlist"
    r"|disqus|respond|replies|footer|masthead|site-?header|pagination|pager|skip-?link|toolbar|widget)(?=$|[\s_-])"
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def unwanted(node: Node) -> bool:
    """Whether an element is no article text by its name. A header inside an article stays for its headings only."""
    if node.tag in DROPPED or node.tag == "header":
        return True
    names = node.names
    if not names or node.tag in ("article", "main", "body", "html"):
        return False
    if "hidden" in names or names.get("aria-hidden") == "true" or names.get("role") in ROLES:
        return True
    return bool(NOISE.search(names.get("class", "")) or NOISE.search(names.get("id", "")))


def _inside(node: Node) -> bool:
    return unwanted(node) and not (node.tag == "header" and not node.names and _headed(node))


def _headed(node: Node) -> bool:
    todo = [node]
    while todo:
        below = [c for c in todo.pop().children if not isinstance(c, str)]
        if any(c.tag in ("h1", "h2", "hgroup") for c in below):
            return True
        todo += below
    return False


def articles(root: Node) -> list[Node]:
    """The elements that hold the article: outermost article elements, else main, else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "article" or node.tag == "main" or node.names.get("role") == "main" or node.names.get("itemprop") == "articlebody":
            kind = "article" if node.tag == "article" or "itemprop" in node.names else "main"
            if not found[kind]:
                found[kind].append(node)
            elif kind == "article":
                found[kind].append(node)
            if kind == "article":
                continue
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not unwanted(c)]
    return found["article"] or found["main"] or [root]


#: (kinds, children) of the slots of a model, in page order; slot 0 is the root.
Model = tuple[list[str], list[list[int]]]
INLINE = set("script style b i em strong a span br".split())


def runs(node: Node) -> list[list[Node]]:
    """The elements below a node; siblings of one kind in a row are one run."""
    found: list[list[Node]] = []
    for child in node.children:
        if isinstance(child, str) or child.tag in INLINE:
            continue
        if found and found[-1][0].kind == child.kind:
            found[-1].append(child)
        else:
            found.append([child])
    return found


def skeleton(root: Node) -> list[list]:
    """[kind, number of the parent] of every slot in page order; a run is one slot with the elements of its first."""
    slots: list[list] = []
    todo = [(root, -1)]
    while todo:
        node, parent = todo.pop()
        todo += [(run[0], len(slots)) for run in reversed(runs(node))]
        slots.append([node.kind, parent])
    return slots


def model_of(slots: list[list]) -> Model:
    below: list[list[int]] = [[] for _ in slots]
    for number, (_, parent) in enumerate(slots):
        if parent >= 0:
            below[parent].append(number)
    return [kind for kind, _ in slots], below


def matching(node: Node, slot: int, model: Model) -> tuple[int, dict]:
    """Simple tree matching of the tree below a node and below a slot of its kind.

    Returns the size of the largest alignment and, for every pair (id of a node, slot) that could be
    part of it, the aligned (run, slot) below. Pairs are solved from the deepest on, without recursion.
    """
    kinds, below = model
    pairs, own = [(node, slot)], {}
    for one, at in pairs:
        if id(one) not in own:
            own[id(one)] = runs(one)
        for run in own[id(one)]:
            pairs += [(run[0], j) for j in below[at] if kinds[j] == run[0].kind and below[j] and run[0].children]
    sizes: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list] = {}
    for one, at in reversed(pairs):
        left, right = own[id(one)], below[at]
        size = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, run in enumerate(left):
            for j, other in enumerate(right):
                best = max(size[i][j + 1], size[i + 1][j])
                if run[0].kind == kinds[other]:
                    best = max(best, size[i][j] + sizes.get((id(run[0]), other), 1))
                size[i + 1][j + 1] = best
        found, i, j = [], len(left), len(right)
        while i and j:
            run, other = left[i - 1], right[j - 1]
            if run[0].kind == kinds[other] and size[i][j] == size[i - 1][j - 1] + sizes.get((id(run[0]), other), 1):
                found.append((run, other))
                i, j = i - 1, j - 1
            elif size[i][j] == size[i - 1][j]:
                i -= 1
            else:
                j -= 1
        sizes[id(one), at], chosen[id(one), at] = size[-1][-1] + 1, found
    return sizes[id(node), slot], chosen


def align(root: Node, model: Model) -> None:
    """Gives the matched nodes of a page the numbers of their slots."""
    below = model[1]
    todo: list = [([root], 0, None)]
    while todo:
        nodes, slot, known = todo.pop()
        for node in nodes:
            node.slot = slot
            if below[slot] and node.children:
                chosen = known if known is not None and (id(node), slot) in known else matching(node, slot, model)[1]
                todo += [(run, other, chosen) for run, other in chosen[id(node), slot]]


def page_blocks(text: str, model: Model | None) -> list[tuple[int, str]]:
    """(slot, text) of the blocks that are article text by their names; slot -1 if nothing matches."""
    root = parse(text)
    if model is not None:
        align(root, model)
    return [
        (-1 if owner.slot is None else owner.slot, block)
        for article in articles(root)
        for owner, block in blocks(article, _inside)
    ]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [json.dumps(skeleton(parse(text))) for text in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees)], ["host", "model"])


def _model(text: str | None, known: dict) -> Model | None:
    if text is None:
        return None
    if text not in known:
        if len(known) > 1000:
            known.clear()
        known[text] = model_of(json.loads(text))
    return known[text]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        hosts, slots, texts, pages = [], [], [], []
        for host, page, model in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "model"))):
            digest = _hash(page)
            found = [(s, t) for s, t in page_blocks(page, _model(model, known)) if s >= 0]
            seen = {(s, _hash(t)) for s, t in found}
            seen |= {(-1 - s, 0) for s, _ in found}  # the page has the slot
            for slot, text in seen:
                hosts.append(host)
                slots.append(slot)
                texts.append(text)
                pages.append(digest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(slots, pa.int32()), pa.array(texts, pa.int64()), pa.array(pages, pa.int64())],
            ["host", "slot", "text", "page"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        texts = []
        for page, model, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "model", "constant"))):
            template = {(c["slot"], c["text"]) for c in constant or ()}
            found = page_blocks(page, _model(model, known) if template else None) if page else []
            if template:
                found = [(s, t) for s, t in found if (s, _hash(t)) not in template]
            texts.append("\n\n".join(t for _, t in found))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array(np.array([len(t) for t in texts], np.int64)),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


#: A host with at least one of so many parts of all pages is dealt over as many parts as it holds.
PARTS = 500


def _by_host(pages: DataFrame, known: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """Joins pages with what is known of their host; the pages of a hot host are dealt over its parts.

    ``hot`` has at most ``PARTS`` rows and asks for at most ``2 * PARTS`` copies in all, whatever the size.
    """
    hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = pages.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), parts))
    copies = known.join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.drop("parts").join(copies.drop("parts"), ["host", "part"], how).drop("part")


def extract(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE, least_mixed: int = MIXED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = prepared(pages.sparkSession)
    workspace = Workspace(spark)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    layout = F.hex(F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(CLASSED), F.lit(1))))))
    own = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", F.when(host != "", F.concat_ws(" ", host, layout)))
    hosted = own.filter("host is not null")
    # a host (from here on: with a layout) needs as many pages as make a constant text template
    sizes = hosted.groupBy("host").agg(F.count("*").alias("n"), F.min(F.when(F.col("html").rlike("<[A-Za-z]"), F.xxhash64("html"))).alias("least"))
    sizes = workspace.stage(sizes, "hosts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter(F.col("n") * PARTS >= total).select("host", F.ceil(F.col("n") * PARTS / max(total, 1)).cast("long").alias("parts"))
    large = sizes.filter(F.col("n") >= least_pages)
    first = hosted.join(large, "host").filter(F.xxhash64("html") == F.col("least")).groupBy("host").agg(F.min("html").alias("html"))
    models = workspace.stage(first.mapInArrow(_models, "host string, model string"), "models")
    seen = _by_host(hosted, models, hot, "inner").select("host", "html", "model").mapInArrow(
        _slots, "host string, slot int, text long, page long"
    )
    counts = workspace.stage(seen.distinct().groupBy("host", "slot", "text").agg(F.count("*").alias("pages")), "slots")
    slots = counts.groupBy("host", F.when(F.col("slot") < 0, -1 - F.col("slot")).otherwise(F.col("slot")).alias("slot")).agg(
        F.max(F.when(F.col("slot") < 0, F.col("pages"))).alias("all"), F.min(F.when(F.col("slot") >= 0, F.col("pages"))).alias("rarest")
    )
    needed = F.when(F.col("rarest") >= F.col("all") * share, least_pages).otherwise(F.greatest(F.lit(least_pages), F.lit(least_mixed)))
    constant = counts.filter("slot >= 0").join(slots, ["host", "slot"]).filter(
        (F.col("all") >= needed) & (F.col("pages") >= F.col("all") * share)
    )
    wrappers = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("constant")).join(models, "host")
    return _by_host(own, wrappers, hot, "left").select("page_id", "url", "html", "model", "constant").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
