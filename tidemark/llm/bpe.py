"""Byte-level BPE encoding and decoding (operator 10).

The most frequent distinct words of the corpus, at most ``FOLDED``, are encoded
by Spark higher-order functions: a fold over the array of a word's byte pieces
joins the adjacent pair of least rank, looked up in a literal rank map, until no
pair has a rank. Their codes are sent to the tasks (bounded by ``FOLDED`` words
of at most ``FOLD_BYTES`` bytes), where an Arrow function puts the documents
together; the rarer and longer words are merged there by the same ranks.
Decoding is DataFrame functions only: ids index a literal array of byte pieces,
which are concatenated.

Bytes appear as hexadecimal text inside the folds. The rank map is literal
arrays hashed by crc32, as Spark's own map lookup scans all keys.

Nulls count as empty: no ids. Texts of any length are encoded whole. Rows with
one doc_id, and repeated rows, are encoded apart. Extra columns are ignored by
the query; ``encode`` carries those of ``keep``, but its own columns replace any
of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import beside, by_place, kept, let, materialize, read_documents
from tidemark.llm.tokens import _ODD_SPACE, _PIECE, _batches

RANKS = "byte_bpe_50k.tiktoken"
#: Words encoded by the folds, and the most bytes of one.
FOLDED, FOLD_BYTES = 150_000, 32
KEEP_CHARS, KEEP_PIECES = 48, 300_000
SLOTS = 1 << 15


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: pieces in hexadecimal by slots of their crc32, where each slot starts, and their ranks."""
    slots: list[list[tuple[str, int]]] = [[] for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        slots[zlib.crc32(h.encode()) % SLOTS].append((h, rank))
    starts, keys, values = [0], [], []
    for s in slots:
        keys += [k for k, _ in s]
        values += [v for _, v in s]
        starts.append(len(keys))
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")  # noqa: E731  folded to one constant when planned
    return F.struct(literal(starts).cast("array<int>").alias("starts"), literal(keys).alias("keys"), literal(values).cast("array<int>").alias("ranks"))


def look_up(table: Column, piece: Column) -> Column:
    """Rank of a piece, null if it has none."""
    slot = (F.crc32(piece) % SLOTS).cast("int")
    first = F.get(table["starts"], slot)
    place = F.array_position(F.slice(table["keys"], first + 1, F.get(table["starts"], slot + 1) - first), piece).cast("int")
    return F.when(place > 0, F.get(table["ranks"], first + place - 1))


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (string): merges folded over its byte pieces. The rank map stands in the plan once."""
    return let(rank_map(ranks), lambda table: _folded(word, lambda piece: look_up(table, piece)))


def _folded(word: Column, rank: Callable[[Column], Column]) -> Column:
    """State of the fold: the pieces p and the ranks r of neighbouring pairs, so that a merge looks up only the two pairs that it changes."""

    def merge(s: Column, j: Column) -> Column:
        p, r = s["p"], s["r"]

        def joined(x: Column) -> Column:
            left = F.when(j > 1, F.array(rank(F.concat(F.get(p, j - 2), x)))).otherwise(F.array().cast("array<int>"))
            right = F.when(j < F.size(r), F.array(rank(F.concat(x, F.get(p, j + 1))))).otherwise(F.array().cast("array<int>"))
            pieces = F.concat(F.slice(p, F.lit(1), j - 1), F.array(x), F.slice(p, j + 2, F.size(p)))
            ranks = F.concat(F.slice(r, F.lit(1), F.greatest(j - 2, F.lit(0))), left, right, F.slice(r, j + 2, F.size(r)))
            return F.struct(pieces.alias("p"), ranks.alias("r"))

        return let(F.concat(F.get(p, j - 1), F.get(p, j)), joined)

    def step(s: Column, _: Column) -> Column:
        least = F.array_position(s["r"], F.array_min(s["r"])).cast("int")
        return F.when(F.size(s["r"]) == 0, s).otherwise(let(F.coalesce(least, F.lit(0)), lambda j: F.when(j == 0, s).otherwise(merge(s, j))))

    def of(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))
        pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(h, i * 2 + 1, F.lit(4))))
        start = F.struct(pieces.alias("p"), F.when(n > 1, pairs).otherwise(F.array().cast("array<int>")).alias("r"))
        folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.transform(s["p"], rank))
        return let(rank(h), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))

    return let(F.hex(F.encode(word, "utf-8")), of)


#: Words of fewer bytes are merged by looking at all pairs, longer ones by a heap.
FEW = 24


def merge_few(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in a task, for short words."""
    parts = [word[i : i + 1] for i in range(len(word))]
    none = 1 << 60
    found = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while found and (r := min(found)) < none:
        i = found.index(r)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in a task: least rank first, leftmost of equals; near-linear in the length of the word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < FEW:
        return merge_few(word, ranks)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair(i: int):
        j = ends[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    heap = [(r, i, ends[ends[i]]) for i in range(n) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            before[end] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[ends[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Codes of texts: ids joined by a space, with a bounded memory of pieces."""

    def __init__(self, path: str, folded: bytes):
        table = pa.ipc.open_stream(folded).read_all()
        self.ranks, self.folded = load_ranks(path), dict(zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, str] = {}

    def piece(self, text: str) -> str:
        return " ".join([self.folded.get(w) or " ".join(map(str, merge_bytes(w.encode(), self.ranks))) for w in self.split(text)])

    def text(self, text: str) -> tuple[int, str]:
        if not text:
            return 0, ""
        pieces = [text] if _ODD_SPACE.search(text) else _PIECE.findall(text)
        codes = list(map(self.known.get, pieces))
        if None in codes:
            if len(self.known) > KEEP_PIECES:
                self.known.clear()
            for i, code in enumerate(codes):
                if code is None:
                    p = pieces[i]
                    codes[i] = code = self.known.get(p) or self.piece(p)
                    if len(p) <= KEEP_CHARS:
                        self.known[p] = code
        ids = " ".join(codes)
        return ids.count(" ") + 1, ids


def _encode(path: str, name: str, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = kept(("bpe", path, name), lambda: Encoder(path, shared.value)).text
    for batch in batches:
        done = [encode(t) for texts in _batches(batch.columns[-1], 4_000_000) for t in texts]
        new = [pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "n_tokens", "ids"])


def frequent_words(docs: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent distinct words of at most FOLD_BYTES bytes.

    Texts are first cut before white space behind other characters, where words
    end, and the distinct pieces counted, so that the words' pattern runs once for
    each of these.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_PIECE.pattern), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    found = pieces.select("n", F.explode(F.regexp_extract_all("piece", F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))).alias("word"))
    counted = found.where(F.octet_length("word") <= FOLD_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.orderBy(F.desc("n"), "word").limit(most).select("word"))


def fold_frequent(docs: DataFrame, path: str, most: int = FOLDED) -> DataFrame:
    """(word, ids) of the most frequent distinct words, ids joined by a space."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = fold_merges(F.col("word"), load_ranks(path))
    return frequent_words(docs, most).repartition(tasks, "word").select("word", F.array_join(ids, " ").alias("ids"))


def encode(docs: DataFrame, ranks_path: str | None = None, most_folded: int = FOLDED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, the columns of keep, n_tokens, ids): each text's ids in decimal, joined by one space."""
    path = ranks_path or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    table = fold_frequent(docs, path, most_folded).toArrow()  # one job over all its partitions, at most most_folded rows
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    # bytes, as Python texts of all words would take many times the memory of the driver
    shared, name = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    del table, sink
    keep = beside(keep, ("doc_id", "n_tokens", "ids"))
    at = {c: f"o_{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    rows = by_place(docs, "doc_id", "text").select("doc_id", *[F.col(at[c]) for c in keep], "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    encoded = rows.mapInArrow(lambda batches: _encode(path, name, shared, batches), f"{schema}, n_tokens long, ids string")
    return encoded.select("doc_id", *[F.col(at[c]).alias(c) for c in keep], "n_tokens", "ids")


def decode(ids: Column, ranks_path: str | None = None) -> Column:
    """Binary text of ids joined by a space: concatenated binary pieces from a literal vocabulary."""
    ranks = load_ranks(ranks_path or public_tokenizers.path(RANKS))
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    vocabulary = F.split(F.lit(",".join(pieces)), ",")
    # a cast between binary and string leaves the bytes as they are, and joining strings concatenates them
    binary = F.transform(F.split(ids, " "), lambda i: F.unhex(F.get(vocabulary, i.cast("int"))).cast("string"))
    return F.when(ids == "", F.lit(b"")).otherwise(F.array_join(binary, "").cast("binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(read_documents(spark, sf_dir))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"))
