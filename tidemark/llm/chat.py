"""Chat formatting (operator 2): roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is numbered lines of text. Each line shows a symbol: the speaker
marker that it begins with, if any, whether it follows a blank line, and how long
it is. Hidden states say which role speaks and whether the line begins a turn.
Viterbi finds the most likely states. Transcripts are decoded in blocks of
``BLOCK`` lines: each block's best scores between states make a small matrix, the
matrices of a transcript are combined, and blocks are then decoded apart with
their end states known. Lines meet by blocks only; of a whole transcript, one
matrix or one number per block meets in one row or window.

The model is counted by Spark over conversations whose roles are known (at most
states x symbols numbers), with one added to each count. The query fits it on the
conversations whose crc32(conv_id) modulo 4 is not 2 and formats all.

Nulls: a null text is an empty line, a null conv_id is a conversation of its own.
A role that is null or none of ``ROLES`` (as ``tool``) gives a turn without a
marker, from which nothing is learned; the turn is rendered under the role that
the lines most likely have. Rows of one conversation and turn are ordered by role
and text; repeated rows are turns of their own. A line of any length is one
symbol. Empty tables give no turns. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.language_id import held_out

ROLES = ("user", "assistant", "system")
#: Markers that name a role at the start of a line, by style.
MARKERS = {
    "user": ("User: ", "Human: ", "Q: ", "<user> "),
    "assistant": ("Assistant: ", "Bot: ", "A: ", "<assistant> "),
    "system": ("System: ", "[system] ", "Instructions: ", "<system> "),
}
BLOCK = 256
#: Characters from which a line counts as middling and as long.
LENGTHS = (120, 400)
STATES, SYMBOLS = 2 * len(ROLES), 4 * 2 * 3


@dataclass
class Model:
    """Log scores: of the first state, from state to state, and of symbols in states."""

    start: np.ndarray
    step: np.ndarray
    show: np.ndarray


def _marker(text: Column) -> tuple[Column, Column]:
    """(number of the role whose marker the line begins with, 0 for none; the line without it)."""
    number, body = F.lit(0), text
    for r, role in enumerate(ROLES):
        for m in MARKERS[role]:
            number = F.when(F.startswith(text, F.lit(m)), r + 1).otherwise(number)
            body = F.when(F.startswith(text, F.lit(m)), F.substring(text, len(m) + 1, 1 << 30)).otherwise(body)
    return number, body


def observe(lines: DataFrame) -> DataFrame:
    """lines (conv_id, line_no, text, perhaps state) plus block, body, symbol, and before: the state of the line before."""
    state = F.col("state") if "state" in lines.columns else F.lit(None).cast("int")
    rows = lines.select("conv_id", "line_no", "text", state.alias("state"), F.floor(F.col("line_no") / BLOCK).cast("int").alias("block"), F.lit(False).alias("copy"))
    # each block begins with a copy of the line before it
    ends = rows.where(F.col("line_no") % BLOCK == BLOCK - 1).withColumn("block", F.col("block") + 1).withColumn("copy", F.lit(True))
    by_line = Window.partitionBy("conv_id", "block").orderBy("line_no")
    marker, body = _marker(F.col("text"))
    n = F.length("text")
    long = F.when(n >= LENGTHS[1], 2).when(n >= LENGTHS[0], 1).otherwise(0)
    gap = (F.coalesce(F.trim(F.lag("text").over(by_line)), F.lit("")) == "").cast("int")
    seen = rows.unionByName(ends).withColumn("symbol", (marker * 6 + gap * 3 + long).cast("int")).withColumn("before", F.lag("state").over(by_line))
    return seen.where("NOT copy").withColumn("body", body).drop("copy")


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Lines (conv_id, line_no, text, state) of conversations: turns with markers in a style of the conversation's, a blank line between them, and every eighth marker left out; state is the truth, null where the role is none of ROLES."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    named = F.lit("")
    for role in ROLES:
        named = F.when(F.col("role") == role, F.element_at(F.array(*[F.lit(m) for m in MARKERS[role]]), style + 1)).otherwise(named)
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0) & (F.col("turn") > 0)
    said = F.concat(F.when(bare, "").otherwise(named), F.coalesce("text", F.lit("")), F.lit("\n"))
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    rows = conversations.select("conv_id", "turn", F.when(number >= 0, number).alias("r"), F.coalesce("text", F.lit("")).alias("tie"), F.posexplode(F.split(said, "\n")).alias("i", "line"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "r", "tie", "i")) - 1
    return rows.select("conv_id", place.alias("line_no"), F.col("line").alias("text"), (F.col("r") * 2 + (F.col("i") > 0).cast("int")).alias("state"))


def fit(lines: DataFrame) -> Model:
    """Model of lines whose state is known."""
    seen = observe(lines).where("state IS NOT NULL").persist()
    start, step, show = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))
    for r in seen.groupBy("state", "symbol").agg(F.count(F.lit(1)).alias("n")).collect():
        show[r.state, r.symbol] += r.n
    for r in seen.where("before IS NOT NULL").groupBy("before", "state").agg(F.count(F.lit(1)).alias("n")).collect():
        step[r.before, r.state] += r.n
    for r in seen.where("line_no = 0").groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect():
        start[r.state] += r.n
    seen.unpersist()
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(log(start), log(step), log(show))


def block_scores(model: Model, symbols: np.ndarray) -> np.ndarray:
    """Best score from each state before the block (last row: the start) to each state at its end."""
    at = np.vstack([model.step, model.start]) + model.show[:, symbols[0]]
    for s in symbols[1:]:
        at = (at[:, :, None] + model.step[None]).max(axis=1) + model.show[:, s]
    return at


def end_states(blocks: list[np.ndarray]) -> list[int]:
    """State at the end of each block on the best path through all."""
    score, back = blocks[0][STATES], []
    for m in blocks[1:]:
        both = score[:, None] + m[:STATES]
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def decode_block(model: Model, symbols: np.ndarray, before: int, end: int) -> list[int]:
    """Best states of a block's lines between known states (before < 0: the start)."""
    score = (model.start if before < 0 else model.step[before]) + model.show[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        both = score[:, None] + model.step
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + model.show[:, s]
    out = [end]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def format_turns(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn_no, role, n_lines, rendered) of transcripts (conv_id, line_no from 0, text)."""

    @F.pandas_udf("array<double>")
    def scores(symbols: pd.Series) -> pd.Series:
        return symbols.map(lambda s: block_scores(model, np.asarray(s)).ravel())

    @F.pandas_udf("array<int>")
    def ends(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda bs: end_states([np.asarray(b).reshape(STATES + 1, STATES) for b in bs]))

    @F.pandas_udf("array<int>")
    def states(symbols: pd.Series, before: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([decode_block(model, np.asarray(s), int(b), int(e)) for s, b, e in zip(symbols, before, end, strict=True)])

    seen = observe(lines.select("conv_id", "line_no", F.coalesce("text", F.lit("")).alias("text")))
    blocks = materialize(seen.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "symbol", "body"))).alias("lines")))
    symbols = F.transform("lines", lambda x: x["symbol"])
    scored = blocks.select("conv_id", "block", scores(symbols).alias("m"))
    path = scored.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("bs"))
    found = path.select(F.col("conv_id").alias("p_id"), ends(F.transform("bs", lambda b: b["m"])).alias("ends")).select("p_id", F.posexplode("ends").alias("p_block", "end"), "ends")
    known = found.select("p_id", "p_block", "end", F.coalesce(F.get("ends", F.col("p_block") - 1), F.lit(-1)).alias("before"))
    joined = blocks.join(known, F.col("conv_id").eqNullSafe(F.col("p_id")) & (F.col("block") == F.col("p_block")))
    decoded = joined.select("conv_id", "block", "lines", states(symbols, "before", "end").alias("states"))
    begins = F.size(F.filter("states", lambda s: s % 2 == 0))
    earlier = F.coalesce(F.sum(begins).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = decoded.withColumn("earlier", earlier).select("conv_id", "earlier", "states", F.posexplode("lines").alias("i", "line"))
    upto = F.size(F.filter(F.slice("states", F.lit(1), F.col("i") + 1), lambda s: s % 2 == 0))
    rows = rows.select("conv_id", (F.col("earlier") + upto).cast("int").alias("turn_no"), F.get("states", F.col("i")).alias("state"), F.struct("line.line_no", "line.body").alias("line"))
    turns = rows.groupBy("conv_id", "turn_no").agg(F.min_by("state", "line.line_no").alias("state"), F.count(F.lit(1)).cast("int").alias("n_lines"), F.sort_array(F.collect_list("line")).alias("lines"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    text = F.rtrim(F.array_join(F.transform("lines", lambda x: x["body"]), "\n"), F.lit("\n"))
    return turns.select("conv_id", "turn_no", role.alias("role"), "n_lines", F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return format_turns(lines.drop("state"), fit(lines.where(~held_out(F.col("conv_id")))))
