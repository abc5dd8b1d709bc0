"""Document fingerprints (operator 3): bottom-k sketches of word shingles, DataFrame functions only.

A sketch is the ascending array of the ``k`` least distinct 64-bit hashes of a
text's five-word shingles; a text of fewer words is one shingle as a whole, and
a text without words has an empty sketch. The bottom k of a union is the bottom
k of the two sketches together, so sketches merge across parts of a corpus.

Nulls count as empty texts. Two empty sketches resemble each other fully (their
texts have the same words), an empty and a non-empty one not at all. Rows with
one doc_id are ordered by a hash of their text. Extra columns are ignored by the
query. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, materialize, read_documents, words

SHINGLE = 5
K = 128
#: Rows in an id bucket; the most cells of ids, and the most buckets a cell is cut to on average: both tables that are broadcast have a bounded number of rows.
BUCKET_ROWS, MAX_CELLS, MAX_BUCKETS = 1000, 4096, 65_536


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    def shingles(h: Column) -> Column:
        few = F.array(F.xxhash64(h))
        many = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, few).otherwise(many)

    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of the two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _share(a: Column, b: Column, k: int, of: str) -> Column:
    def ratio(least: Column) -> Column:
        both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
        base = F.size(least) if of == "union" else F.size(F.array_intersect(least, a))
        return F.when(base > 0, both / base).otherwise(F.lit(1.0))

    return let(merge(a, b, k), ratio)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection over union; exact where both sets have at most k shingles together."""
    return _share(a, b, k, "union")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too; 1 for an empty a."""
    return _share(a, b, k, "first")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else from the k-th least hash."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / spread)


def merge_parts(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """Per key the merged sketch of many partial ones: exploded hashes, partially aggregated, never one group's rows in one list."""
    hashes = parts.select(key, F.explode(column).alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    least = hashes.withColumn("at", place).where(F.col("at") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ".")


def id_buckets(docs: DataFrame, bucket_rows: int) -> tuple[DataFrame, Column, Column]:
    """(table of cells, a row's cell, the bucket of a row joined with its cell): buckets ascend with doc_id.

    Cells lie between quantiles of the ids; each is cut to as many equal ranges,
    between its own least and greatest id, as its rows need. So ids far from all
    others, or in clusters, do not put the rest into one bucket.
    """
    n = docs.count()
    count = min(MAX_CELLS, max(1, n // bucket_rows))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 10 * count)).first()[0] or []
    bounds = sorted(set(bounds)) if count > 1 else []
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  one constant in the plan
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    cell = F.lit(0)
    if bounds:
        step = 64
        group = upto(literal(bounds[::step]))
        cell = F.when(group > 0, (group - 1) * step + upto(F.slice(literal(bounds), (F.greatest(group, F.lit(1)) - 1) * step + 1, F.lit(step)))).otherwise(0)
    cell = F.when(F.col("doc_id").isNull(), -1).otherwise(cell)
    parts = F.greatest(F.lit(1), F.expr(f"n div {max(bucket_rows, n // MAX_BUCKETS)}"))
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  differences of ids may pass 64 bits
    cells = docs.groupBy(cell.alias("of")).agg(F.min("doc_id").alias("from"), F.max("doc_id").alias("to"), F.count(F.lit(1)).alias("n"))
    width = F.floor((wide(F.col("to")) - wide(F.col("from"))) / wide(parts)) + 1
    cells = materialize(cells.select("of", "from", width.cast("decimal(20,0)").alias("width")))
    part = F.coalesce(F.floor((wide(F.col("doc_id")) - wide(F.col("from"))) / F.col("width")).cast("long"), F.lit(0))
    return cells, cell, F.col("cell").cast("long") * (1 << 32) + part


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, fingerprint) of each row with next_text, next_fingerprint of the row after it by doc_id; the first follows the last.

    Rows are dealt to buckets of neighbouring ids; within one, a window looks
    ahead. Each bucket also gets a copy of the head of the next one. Only cells and
    heads' ids (bounded numbers) are broadcast, and texts shuffle once.
    """
    cells, cell, bucket = id_buckets(docs, bucket_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("cell", cell)
    rows = rows.join(F.broadcast(cells), F.col("cell") == F.col("of")).select("doc_id", "text", "tie", bucket.alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    ring = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    heads = materialize(heads.select("bucket", "head.*", F.coalesce(F.lag("bucket").over(ring), last).alias("to")))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")) & (F.col("bucket") == F.col("h_bucket"))
    ids = heads.select(F.col("bucket").alias("h_bucket"), F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"), F.col("to").alias("h_to"))
    copies = rows.join(F.broadcast(ids), same).select("doc_id", "text", "tie", F.col("h_to").alias("bucket"), F.lit(1).alias("copy"))
    dealt = rows.select("doc_id", "text", "tie", "bucket", F.lit(0).alias("copy")).unionByName(copies).repartition("bucket")
    dealt = dealt.withColumn("fingerprint", sketch(F.col("text")))
    ahead = F.lead(F.struct("text", "fingerprint")).over(Window.partitionBy("bucket").orderBy("copy", "doc_id", "tie"))
    return dealt.withColumn("next", ahead).where("copy = 0").select("doc_id", "text", "fingerprint", F.col("next.text").alias("next_text"), F.col("next.fingerprint").alias("next_fingerprint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_documents(spark, sf_dir)).withColumnRenamed("fingerprint", "own").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_fingerprint")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("own")).alias("edited_within"),
    )
