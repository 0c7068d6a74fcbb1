"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's sketch is the k smallest hashes of its shingles. Documents with one set of shingles are a
class, of which one stands for all. Inverted lists of the retained values generate the overlaps:

* Two documents that are to be linked share at least ``SHARED`` of their k values (or, if they have
  fewer than k shingles, a share of all), so they meet in the list of one of the ``k - SHARED + 1``
  values of either that are rarest; only these postings are kept, and never the hottest lists.
* A list does not emit its pairs. Its documents are compared with one pivot, those that link become
  one component, and the next rounds compare only across the components of a list.
* After ``ROUNDS`` pivots the pairs that are left in lists of up to ``SHORT`` documents are tested one by
  one. Of the longer lists, the longest open one of a document is its home. Documents outside the
  largest component of their home are compared with all documents of it, block by block, by exact
  products of incidence matrices, and only a spanning forest of the links is returned. The other
  lists are gone through in the same way by sketches, each pair that no home has compared in the
  smallest list of both; the documents of a block that have a likely partner in it, never the
  pairs, go on and are compared by their full sets in the same way.
* The bottom-k sketch of the union estimates the similarity of a pair and drops the hopeless ones;
  the rest is decided by the exact Jaccard similarity of the full sets.

``SHARED`` of 64 values lies more than six standard deviations below what a pair at 85 percent shares, and 32 below
what one at 80 percent shares.
Shingles are compared by 64-bit hashes.

Null or wordless texts have an empty set and are linked with nothing. Rows with one doc_id are one
node. A row without a doc_id is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paidup.llm.components import components
from paidup.llm.session import prepared
from paidup.llm.text import GRAPHIC, Words, blocks, mixed
from paidup.workspace import Workspace

#: Values of a sketch, and how many two sketches share at least if their documents are to be linked.
K, SHARED = 64, 36
#: Pivots that a list is tried with, and documents of either side that one task compares.
ROUNDS, COMPARED = 3, 512
#: Longest list whose pairs are listed, at most this many for a document.
SHORT = 32

#: An odd factor for each word of a shingle.
_SHINGLE = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SHORT = (np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F))


def shingle_sets(column: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the shingles of ``width`` words; the whole sequence of a shorter text is one shingle."""
    words = Words(column, GRAPHIC)
    h = words.hashes
    n = max(len(h) - width + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams += h[k : k + n] * _SHINGLE[k]
    grams = mixed(grams)
    for begin, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if end - begin >= width:
            yield np.unique(grams[begin : end - width + 1].view(np.int64))
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for k in range(begin, end):
                whole = mixed(whole * _SHORT[1] + h[k : k + 1] + _SHORT[0])
            yield whole.view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _sketches(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sizes, sums, xors, sketches = [], [], [], []
                for own in shingle_sets(batch.column("text"), width):
                    again = mixed(own.view(np.uint64) + _SHORT[0])
                    sizes.append(len(own))
                    sums.append(np.add.reduce(again))
                    xors.append(np.bitwise_xor.reduce(mixed(again + _SHORT[1])))
                    sketches.append(own[:k])
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in sketches])))
                flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.array(sums, np.uint64).view(np.int64)),
                        pa.array(np.array(xors, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                    ],
                    ["doc_id", "n_shingles", "sum", "xor", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity by the bottom-k sketch of the union, from the sorted sketches of both."""
    union = np.union1d(a, b)[:k]
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / max(len(union), 1)


def _hopeful(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("sketch_a", "sketch_b"))
            kept = [estimate(x, y, k) >= least for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of sets shares, by products of their incidence matrices."""
    flat = [np.concatenate(side) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (x, y)]
    common = np.intersect1d(*flat)
    both = np.zeros((len(x), len(y)), np.float32)
    columns = []
    for k in range(2):
        column = np.searchsorted(common, flat[k])
        inside = column < len(common)
        inside[inside] = common[column[inside]] == flat[k][inside]
        order = np.argsort(column[inside], kind="stable")
        columns.append((column[inside][order], owner[k][inside][order]))
    for at in range(0, len(common), 4096):
        parts = []
        for (column, own), side in zip(columns, (x, y)):
            a, b = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(side), min(4096, len(common) - at)), np.float32)
            part[own[a:b], column[a:b] - at] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return np.rint(both).astype(np.int64)


def _compared(percent: int):
    """Exact Jaccard similarities of two blocks of documents; a spanning forest of the links between components."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[~rows["column"]], rows[rows["column"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        met = _shared(*([np.frombuffer(s, np.int64) for s in side["values"]] for side in (x, y)))
        n, m = (side["n"].to_numpy() for side in (x, y))
        hit = 100 * met >= percent * (n[:, None] + m[None, :] - met)
        own, other = x["component"].to_numpy(), y["component"].to_numpy()
        hit &= own[:, None] != other[None, :]
        links, root = [], {}

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for i, j in np.argwhere(hit).tolist():
            a, b = top(own[i]), top(other[j])
            if a != b:
                root[a] = b
                links.append((x["rep"].iat[i], y["rep"].iat[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _within(homes: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each home (row) is one of the lists of each document (column)."""
    own, at = np.unique(homes, return_inverse=True)
    flat = np.concatenate(lists)
    place = np.searchsorted(own, flat)
    inside = place < len(own)
    inside[inside] = own[place[inside]] == flat[inside]
    held = np.zeros((len(own), len(lists)), bool)
    held[place[inside], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[inside]] = True
    return held[at]


def _likely(percent: int, shared: int):
    """The documents of two blocks that have a likely partner in the other: their sketches share enough, no home
    has compared them, and no smaller list holds both."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[~rows["column"]], rows[rows["column"]]
        out = ["value", "i", "j", "rep", "n", "component", "column"]
        if not len(x) or not len(y):
            return rows.iloc[:0][out]
        n, m = (side["n"].to_numpy() for side in (x, y))
        least = np.minimum(np.minimum(-(-n[:, None] * percent // 100), -(-m[None, :] * percent // 100)), shared)
        hit = _shared(*([np.asarray(s, np.int64) for s in side["values"]] for side in (x, y))) >= least
        hit &= (n[:, None] * 100 >= m[None, :] * percent) & (m[None, :] * 100 >= n[:, None] * percent)
        hit &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]
        if hit.any():
            lists = [[np.asarray(v, np.int64) for v in side["lists"]] for side in (x, y)]
            home, asked = ([side[c].to_numpy() for side in (x, y)] for c in ("home", "asked"))
            hit &= ~(asked[0][:, None] & _within(home[0], lists[1]))
            hit &= ~(asked[1][:, None] & _within(home[1], lists[0])).T
            hit &= _shared(*([v[v < key[0]] for v in side] for side in lists)) == 0
        return pd.concat([x[hit.any(axis=1)], y[hit.any(axis=0)]])[out]

    return run


def _with_both(pairs: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """Adds what the table has for either side of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col(key).alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


class NearCopies:
    """The classes, sketches and links of one table of documents, by shingles of up to five words."""

    def __init__(self, docs: DataFrame, percent: int = 85, k: int = K, shared: int = SHARED, width: int = 3):
        self.spark = prepared(docs.sparkSession)
        self.workspace = Workspace(self.spark)
        if not 1 <= width <= len(_SHINGLE):
            raise ValueError(f"shingles have 1 to {len(_SHINGLE)} words, not {width}")
        self.percent, self.k, self.shared, self.width = percent, k, shared, width
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def classes(self) -> None:
        rows = self.docs.mapInArrow(
            _sketches(self.k, self.width), "doc_id long, n_shingles long, sum long, xor long, sketch array<long>"
        )
        self.rows = self.workspace.stage(rows, "sketches")
        own = self.rows.filter("doc_id is not null and n_shingles > 0")
        self.class_key = ["n_shingles", "sum", "xor"]
        firsts = own.groupBy(*self.class_key).agg(F.min("doc_id").alias("rep"))
        kept = own.join(firsts, [*self.class_key]).filter("doc_id = rep")
        self.reps = self.workspace.stage(
            kept.groupBy(*self.class_key, "rep").agg(F.first("sketch").alias("sketch")), "representatives"
        )

    def postings(self) -> DataFrame:
        """(value, rep, n): the lists that a pair to be linked meets in."""
        each = self.reps.select("rep", F.col("n_shingles").alias("n"), F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
        often = each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
        met = each.join(often, "value")
        rare = Window.partitionBy("rep", "n")
        small = self.shared * 100 // self.percent
        least = F.when(F.col("n") < small, F.ceil(F.col("n") * self.percent / 100)).otherwise(self.shared)
        ranked = met.withColumn("rank", F.row_number().over(rare.orderBy("df", "value"))).withColumn(
            "alone", F.col("size") - F.count("*").over(rare)
        )
        return ranked.filter(F.col("rank") + F.col("alone") <= F.col("size") - least + 1).select("value", "rep", "n")

    def verified(self, pairs: DataFrame) -> DataFrame:
        sketches = self.reps.select("rep", "sketch")
        likely = _with_both(pairs.select("a", "b"), sketches, "rep", "sketch").mapInArrow(
            _hopeful(self.k, self.shared / self.k), "a long, b long"
        )
        return _with_both(likely, self.sets, "doc_id", "set").mapInArrow(_linked(self.percent), "a long, b long").distinct()

    def links(self) -> DataFrame:
        """(node, component) of all representatives that are linked with another."""
        workspace = self.workspace
        self.lists = workspace.stage(self.postings(), "postings")
        involved = self.lists.select(F.col("rep").alias("doc_id")).distinct()
        sets = self.docs.join(involved, "doc_id", "left_semi").mapInArrow(_sets(self.width), "doc_id long, set binary")
        self.sets = workspace.stage(sets, "sets")
        self.labels = self.tested = None
        for round_ in range(ROUNDS):
            now = self._open(f"open{round_}")
            order = F.col("rep") if not round_ else F.xxhash64("rep", F.lit(round_))
            pivots = now.groupBy("value").agg(F.min_by(F.struct("rep", "n", "component"), order).alias("pivot"))
            pairs = now.join(pivots, "value").filter("component <> pivot.component")
            self._test(pairs.select("rep", "n", F.col("pivot.rep").alias("other"), F.col("pivot.n").alias("other_n")))
        now = self._of_length(self._open("open-short"), "size <= {}")
        other = now.select("value", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "component")])
        pairs = now.join(other, "value").filter("component <> o_component and rep < o_rep")
        self._test(pairs.select("rep", "n", F.col("o_rep").alias("other"), F.col("o_n").alias("other_n")))
        now = workspace.stage(self._of_length(self._open("open-homes"), "size > {}"), "long")
        homes = workspace.stage(self._homes(now), "homes")
        self._learn(self._blocks(now, homes, _compared(self.percent)))
        now = workspace.stage(self._of_length(self._open("open-rest"), "size > {}"), "long")
        likely = workspace.stage(self._blocks(now, homes, _likely(self.percent, self.shared), rest=True), "likely")
        sets = self.sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("values"))
        self._learn(likely.join(sets, "rep").groupBy("value", "i", "j").applyInPandas(_compared(self.percent), "a long, b long"))
        if self.labels is None:
            return self.lists.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
        return self.labels

    def _open(self, name: str) -> DataFrame:
        """The lists that hold more than one component."""
        if self.labels is None:
            return self.lists.withColumn("component", F.col("rep"))
        names = self.labels.select(F.col("node").alias("rep"), "component")
        now = self.lists.join(names, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        several = now.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        return self.workspace.stage(now.join(several.select("value"), "value", "left_semi"), name)

    @staticmethod
    def _of_length(now: DataFrame, condition: str) -> DataFrame:
        sizes = now.groupBy("value").agg(F.count("*").alias("size")).filter(condition.format(SHORT))
        return now.join(sizes.select("value"), "value", "left_semi")

    def _test(self, pairs: DataFrame) -> None:
        """Verifies the pairs that were not tested before."""
        close = pairs.filter(F.col("n") * 100 >= F.col("other_n") * self.percent)
        close = close.filter(F.col("other_n") * 100 >= F.col("n") * self.percent).filter("rep <> other")
        fresh = close.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if self.tested is not None:
            fresh = fresh.join(self.tested, ["a", "b"], "left_anti")
        fresh = self.workspace.stage(fresh, "pairs")
        self.tested = fresh if self.tested is None else self.tested.unionAll(fresh)
        if not fresh.isEmpty():
            self._learn(self.verified(fresh))

    def _learn(self, links: DataFrame) -> None:
        """Joins the components that the links connect: a known component is as good as the links that made it."""
        if self.labels is not None:
            links = links.select("a", "b").unionAll(self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.labels = components(self.workspace, links)

    def _homes(self, now: DataFrame) -> DataFrame:
        """(rep, home, asked, lists): the longest open list of each document, whether the document is outside
        the largest component of that list, and all its open lists."""
        sizes = now.groupBy("value").agg(F.count("*").alias("size"))
        homes = now.join(sizes, "value").groupBy("rep").agg(
            F.max("component").alias("component"),
            F.max(F.struct("size", "value")).getField("value").alias("home"),
            F.collect_list("value").alias("lists"),
        )
        main = self._main(now).select(F.col("value").alias("home"), "main")
        asked = F.col("component") != F.col("main")
        return homes.join(main, "home").select("rep", "home", asked.alias("asked"), "lists")

    @staticmethod
    def _main(now: DataFrame) -> DataFrame:
        """The largest component of each list, and the sizes of the list and of the rest."""
        sizes = now.groupBy("value", "component").agg(F.count("*").alias("c"))
        return sizes.groupBy("value").agg(
            F.max_by("component", F.struct("c", "component")).alias("main"),
            F.sum("c").alias("all"),
            (F.sum("c") - F.max("c")).alias("few"),
        )

    def _blocks(self, now: DataFrame, homes: DataFrame, compare, rest: bool = False) -> DataFrame:
        """Compares documents outside the largest component of a list with all of the list, block by block.

        First each in its home only, by the full sets; the rest in every open list, by the sketches, to find
        the documents with a likely partner.
        """
        asks = F.col("component") != F.col("main")
        parts = self._main(now)
        if not rest:
            rows = homes.filter("asked").groupBy(F.col("home").alias("value")).agg(F.count("*").alias("few"))
            parts = parts.drop("few").join(rows, "value")
            asks = F.col("asked") & (F.col("home") == F.col("value"))
        parts = parts.filter("few > 0").select(
            "value",
            "main",
            F.ceil(F.col("few") / COMPARED).cast("long").alias("n_rows"),
            F.ceil(F.col("all") / COMPARED).cast("long").alias("n_columns"),
        )
        if rest:
            content = self.reps.select("rep", F.col("sketch").alias("values"))
            kept = ["value", "rep", "n", "component", "values", "home", "asked", "lists"]
            out = "value long, i long, j long, rep long, n long, component long, column boolean"
        else:
            content = self.sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("values"))
            kept = ["value", "rep", "n", "component", "values"]
            out = "a long, b long"
        # What a document brings is put together once for each document, its blocks are listed in one pass.
        own = now.join(parts, "value").join(homes.join(content, "rep"), "rep")
        at, zero = F.xxhash64("rep"), F.lit(0).cast("long")

        def block(column: bool, i, j):
            return F.struct(F.lit(column).alias("column"), i.alias("i"), j.alias("j"))

        across = F.transform(F.sequence(zero, F.col("n_columns") - 1), lambda j: block(False, F.pmod(at, F.col("n_rows")), j))
        down = F.transform(F.sequence(zero, F.col("n_rows") - 1), lambda i: block(True, i, F.pmod(at, F.col("n_columns"))))
        listed = own.select(*kept, F.explode(F.when(asks, F.concat(across, down)).otherwise(down)).alias("block"))
        return listed.select(*kept, "block.*").groupBy("value", "i", "j").applyInPandas(compare, out)

    def result(self) -> DataFrame:
        self.classes()
        labels = self.links()
        named = self.reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            *self.class_key, F.coalesce("component", "rep").alias("component_id")
        )
        named = named.groupBy(*self.class_key).agg(F.min("component_id").alias("component_id"))
        by_row = self.rows.select("doc_id", *self.class_key).join(named, self.class_key, "left")
        alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
        component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
        return by_row.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        )


def op8_near_copies(spark, sf_dir: str) -> DataFrame:
    return NearCopies(spark.read.parquet(f"{sf_dir}/documents.parquet")).result()


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies, by five words and 80 percent, the document with the smallest id stays, once."""
    gone = NearCopies(docs, percent=80, shared=32, width=5).result().filter("not kept").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionAll(docs.filter("doc_id is null"))
