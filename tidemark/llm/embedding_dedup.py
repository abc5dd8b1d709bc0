"""Embedding near-duplicates (operator 11) by spherical-cap filters.

Vectors whose cosine reaches a bound are linked. Filter directions are the words of
random product codes: after a random turn of space a vector is cut to blocks, each
block has a few random directions, and a filter takes one of each block. So a code
of w words in m blocks has w**m filters, which are never listed: a vector's filters
are decoded block by block, dropping beginnings that no ending can lift over the
threshold. There are ``CODES`` independent codes. A vector takes all filters whose
inner product with it exceeds a threshold; where fewer than ``least`` do, its own
threshold is lowered until so many do. Codes grow with the number of vectors, so
that a filter holds about ``IN_FILTER`` of them, and ``least`` is the smallest
number with which random pairs at the bound share a filter in ``RECALL`` of all
cases: both are found on random vectors, no data are sampled. All vectors are
filtered; nothing is capped.

Equal vectors are one class with a count. Classes that share a filter meet in a
task; a filter of more than ``BLOCK`` classes is cut to blocks, and each pair of its
blocks is a task. A task compares all pairs by their cosine in double precision and
counts a link only in the least filter that both vectors have. It passes on each
class's number of links and one edge to a class that it is joined to, never pairs.
So a filter with k near copies, all different, costs k * k products in k / BLOCK
rows of tasks, and k / BLOCK copies of its rows in the shuffle.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and so do vectors of unlike length. A null vec_id comes before all others:
a component that holds one has a null component_id. Rows that repeat a vec_id are
vectors of their own. Extra columns, whatever their names, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import forget, kept, materialize
from tidemark.llm.components import connected

COSINE = 0.95
CODES, SEED = 8, 11
#: Classes that a filter holds on average, and classes in a block of a fuller one.
IN_FILTER, BLOCK = 100, 1000
RECALL, TRIED = 0.999, 2000
#: Filters of a vector on average by the common threshold.
EXCEED = 8
MAX_WORDS = 256
ROWS_AT_ONCE = 1000
NULL_ID = -(1 << 63)


# -- filters ----------------------------------------------------------------------
class Code:
    """A product code: a turn of space, and unit directions of each block, scaled so that every filter is a unit vector."""

    def __init__(self, dim: int, blocks: int, words: int, seed: int):
        rng = np.random.default_rng([SEED, dim, blocks, words, seed])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.words, self.blocks = words, []
        for part in np.array_split(np.arange(dim), blocks):
            c = rng.standard_normal((words, len(part)))
            self.blocks.append((part, c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks)))

    def decode(self, x: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, product) of all filters whose product with a row is at least the row's bound."""
        y = x @ self.turn
        scores = [y[:, part] @ c.T for part, c in self.blocks]
        rest = np.zeros(len(x))
        rests = [rest := rest + s.max(axis=1) for s in scores[::-1]][::-1][1:] + [np.zeros(len(x))]
        row, name, sum_ = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for s, left in zip(scores, rests, strict=True):
            order = np.argsort(-s, axis=1)
            ranked = np.take_along_axis(s, order, axis=1)
            need = above[row] - left[row] - sum_
            n = np.empty(len(row), np.int64)
            step = max(1, 4_000_000 // self.words)
            for i in range(0, len(row), step):
                n[i : i + step] = (ranked[row[i : i + step]] >= need[i : i + step, None]).sum(axis=1)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, name, sum_ = np.repeat(row, n), np.repeat(name, n), np.repeat(sum_, n)
            name, sum_ = name * self.words + order[row, at], sum_ + ranked[row, at]
        return row, name, sum_


class Filters:
    """The codes for vectors of one length in a table of n classes, with their threshold."""

    def __init__(self, dim: int, n: int, cosine: float):
        wanted = max(1.0, n * 2 * EXCEED / IN_FILTER / CODES)
        blocks, room = min(2, dim), 1
        while True:
            # a block takes no more directions than its space has room for
            room = min(MAX_WORDS, 4 * max(1, dim // blocks))
            if room**blocks >= wanted or blocks == dim or (blocks + 1) * math.log2(room) > 56:
                break
            blocks += 1
        self.words = max(2, min(room, math.ceil(wanted ** (1 / blocks))))
        self.codes = [Code(dim, blocks, self.words, k) for k in range(CODES)]
        self.size = self.words**blocks
        self.above, self.least = math.inf, 1
        self._fit(dim, cosine)

    def _fit(self, dim: int, cosine: float) -> None:
        rng = np.random.default_rng([SEED, dim])
        x = unit(rng.standard_normal((TRIED, dim)))
        z = rng.standard_normal((TRIED, dim))
        z = z - (z * x).sum(axis=1, keepdims=True) * x
        y = unit(cosine * x + math.sqrt(1 - cosine**2) * unit(z)) if dim > 1 else x
        most = CODES * self.size
        self.least = min(EXCEED, most)
        self.above = float(np.median([p.min() for _, p in self.lists(x[: TRIED // 4])]))
        self.least = min(2 * EXCEED - 4, most)
        while True:
            met = [len(np.intersect1d(a, b, assume_unique=True)) > 0 for (a, _), (b, _) in zip(self.lists(x), self.lists(y), strict=True)]
            if np.mean(met) >= RECALL or self.least >= most:
                break
            self.least = min(most, self.least + 4)

    def lists(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(filters, products) of each row of unit vectors: those over the threshold, or the row's least number of best ones."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(x), ROWS_AT_ONCE):
            out += self._lists(x[i : i + ROWS_AT_ONCE])
        return out

    def _lists(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [None] * len(x)
        todo, above = np.arange(len(x)), np.full(len(x), min(self.above, 0.9))
        lowest = -1.01
        while len(todo):
            found = [code.decode(x[todo], above[todo]) for code in self.codes]
            row = np.concatenate([r for r, _, _ in found])
            name = np.concatenate([k * self.size + f for k, (_, f, _) in enumerate(found)])
            product = np.concatenate([p for _, _, p in found])
            order = np.lexsort((-product, row))
            row, name, product = row[order], name[order], product[order]
            first = np.searchsorted(row, np.arange(len(todo) + 1))
            short = []
            for j, at in enumerate(todo.tolist()):
                a, b = first[j], first[j + 1]
                if b - a < self.least and above[at] > lowest:
                    short.append(at)
                    continue
                # all over the common threshold, or else as many as the least, with what is as good as the last
                bound = min(self.above, product[min(b, a + self.least) - 1])
                stop = a + int(np.searchsorted(-product[a:b], -bound, "right"))
                out[at] = np.sort(name[a:stop]), product[a:stop]
            todo = np.array(short, np.int64)
            above[todo] = np.maximum(lowest, above[todo] - 0.04)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return unit(np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1))


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of each length of vector."""
    size = np.asarray(pc.list_value_length(column))
    for k in np.unique(size):
        yield np.flatnonzero(size == k)


def _filter(n: int, cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, embedding) with their vectors' filters, ascending."""
    for batch in batches:
        for some in _by_length(batch.column(2)) if batch.num_rows else ():
            for i in range(0, len(some), ROWS_AT_ONCE):
                part = batch.take(pa.array(some[i : i + ROWS_AT_ONCE]))
                x = matrix(part.column(2))
                filters = kept(("caps", n, cosine, x.shape[1]), lambda x=x: Filters(x.shape[1], n, cosine))
                names = [f for f, _ in filters.lists(x)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in names])]).astype(np.int32), pa.array(np.concatenate(names)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "filters"])


# -- tasks --------------------------------------------------------------------------
def shared_before(lists_a: list[np.ndarray], lists_b: list[np.ndarray], filter_: int) -> np.ndarray:
    """Which pairs of rows share a filter less than this one."""
    both = [x[: np.searchsorted(x, filter_)] for x in (*lists_a, *lists_b)]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    known, of, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    out = np.zeros((len(lists_a), len(lists_b)), bool)
    several = np.flatnonzero(n > 1)
    place = np.full(len(known), -1)
    place[several] = np.arange(len(several))
    column = place[of]
    for i in range(0, len(several), 2048):
        here = (column >= i) & (column < i + 2048)
        m = np.zeros((len(both), min(2048, len(several) - i)), np.float32)
        m[row[here], column[here] - i] = 1
        out |= m[: len(lists_a)] @ m[len(lists_a) :].T > 0
    return out


def links_of(x: np.ndarray, y: np.ndarray | None, lists_x: list[np.ndarray], lists_y: list[np.ndarray] | None, filter_: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, matrix of the links between them that this filter counts); y None: of x with itself."""
    hit = x @ (x if y is None else y).T >= cosine
    if y is None:
        np.fill_diagonal(hit, False)
    a, b = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit = hit[np.ix_(a, b)]
    if len(a):
        hit &= ~shared_before([lists_x[i] for i in a], [(lists_x if y is None else lists_y)[i] for i in b], filter_)
    return a, b, hit


def heads(hit: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of n rows reaches by the links hit between rows a and b."""
    label = np.arange(n)
    while True:
        least = label.copy()
        least[a] = np.minimum(least[a], np.where(hit, label[b], n).min(axis=1, initial=n))
        least[b] = np.minimum(least[b], np.where(hit, label[a][:, None], n).min(axis=0, initial=n))
        if (least == label).all():
            return label
        label = least


LINKS = "node long, links long, head long"


def _solve(cosine: float, rows: pa.Table) -> pa.RecordBatch:
    """(node, links, head) of the rows (task, filter, side, node, n, embedding, filters) of one task."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    vectors = rows["embedding"].combine_chunks()
    for some in _by_length(vectors):
        part = rows.take(pa.array(some))
        x = matrix(part["embedding"].combine_chunks())
        lists = [np.array(f, np.int64) for f in part["filters"].to_pylist()]
        node, n, side = (np.asarray(part[c]) for c in ("node", "n", "side"))
        filter_ = part["filter"][0].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if side.any():
            if not len(left) or not len(right):
                continue
            a, b, hit = links_of(x[left], x[right], [lists[i] for i in left], [lists[i] for i in right], filter_, cosine)
            a, b = left[a], right[b]
        else:
            a, b, hit = links_of(x, None, lists, None, filter_, cosine)
        links = np.zeros(len(x), np.int64)
        links[a] += hit @ n[b]
        if side.any():
            links[b] += n[a] @ hit
        some = np.flatnonzero(links)
        if len(some):
            found.append((node[some], links[some], node[heads(hit, a, b, len(x))[some]]))
    columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "links", "head"])


def _tasks(cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINKS of rows in order of task."""
    forget()
    held: list[pa.RecordBatch] = []
    task = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tasks = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tasks[a] != task:
                yield _solve(cosine, pa.Table.from_batches(held))
                held = []
            task = tasks[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _solve(cosine, pa.Table.from_batches(held))


# -- the operator ---------------------------------------------------------------------
def _sound(v: Column) -> Column:
    """Whether a vector can be linked at all."""
    x = v.cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))


def deal(places: DataFrame) -> DataFrame:
    """(task, filter, side, node) of places (filter, node): every pair of a filter's classes meets in one task."""
    sizes = places.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("in_filter"))
    rows = places.join(sizes.where("in_filter > 1").select("filter", "blocks"), "filter")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.xxhash64("filter", low, high).alias("task"), "filter", (F.col("block") > F.col("other")).cast("int").alias("side"), "node")


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    v = F.col("embedding")
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.when(_sound(v), v).alias("embedding"))
    # the constant stands first: behind the vector it would only hash its hash
    key = [F.xxhash64("embedding").alias("k_1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("k_2")]
    rows = rows.select("id", *key, "embedding")
    classes = rows.where("embedding IS NOT NULL").groupBy("k_1", "k_2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "k_1", "k_2", "n", "least", "embedding"))
    n = classes.count()
    kind = classes.schema["embedding"].dataType.simpleString()
    listed = materialize(classes.select("node", "n", "embedding").mapInArrow(lambda b: _filter(n, cosine, b), f"node long, n long, embedding {kind}, filters array<long>"))
    dealt = deal(listed.select("node", F.explode("filters").alias("filter"))).join(listed, "node")
    dealt = dealt.select("task", "filter", "side", "node", "n", "embedding", "filters").repartition("task").sortWithinPartitions("task")
    found = materialize(dealt.mapInArrow(lambda b: _tasks(cosine, b), LINKS))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected(found.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b"))
    named = classes.select("node", "k_1", "k_2", "n", "least").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("k_1", "k_2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # a key that very many rows share is split by adaptive skew joins: labels have one row of it
    alone = rows.where("embedding IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("embedding IS NOT NULL").select("id", "k_1", "k_2").join(labels, ["k_1", "k_2"]).select("id", "n_links", "component_id").unionByName(alone)
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(given("id").alias("vec_id"), "n_links", given("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of rows, and what each reaches by links.
SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95::DOUBLE
), reach AS (
  SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT reach.a AS rid, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY 1
), n AS (
  SELECT a AS rid, count(*) AS n_links FROM links GROUP BY 1
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (rid) LEFT JOIN n USING (rid)
"""
