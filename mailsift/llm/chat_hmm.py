"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is a sequence of lines without roles: some lines begin with a
speaker marker, many do not, and a marker may be missing where a turn begins.
The hidden states are (role, begins a turn or not); a line shows its marker and
a few features (length, question mark, blank). Start, transition and emission
probabilities are counted over labelled conversations with Spark aggregates (a
few hundred counts reach the driver). Viterbi decoding recovers the roles;
turns are the runs from one beginning to the next and are rendered as

    <|role|>
    text
    <|end|>

Conversations of at most CHUNK lines (and CHARS characters) are decoded whole, many
of them in one Arrow batch that holds the lines' symbols only. Longer ones are decoded
in parallel: Viterbi is a product of max-plus matrices, so each chunk of CHUNK
lines is first reduced to one matrix (best score from any state before it to any
state at its end), groups of FAN matrices are reduced again until few are left,
the best path through them fixes the states at every chunk's borders from the top
down, and each chunk is decoded between its fixed borders. The result is that of one
long Viterbi pass. Chunks are cut by the line's place in its conversation, counted
over ranges of a sort, so neither a conversation nor a turn of any length is one task's
work; no task holds more than a chunk or FAN matrices of it.

Defined results: null or empty text is one blank line; rows with a null
conversation id, or a null turn, are conversations of one row each, named by a
hash and, from the second of equal rows on, a number; exact repeats of a row
that has both count once; different texts of one turn follow each
other in the order of their hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.tables import drop_handoff, handoff

CHUNK = 256
CHARS = 1 << 22
FAN = 64
ROLES = ("user", "assistant", "system")
#: Speaker markers (fixed values) by the role they name.
MARKERS = {"user": ("user", "human", "q", "customer", "instruction"), "assistant": ("assistant", "ai", "a", "bot", "agent", "response"), "system": ("system", "context", "admin")}
_NAMES = {name: role for role, names in MARKERS.items() for name in names}
MARKER = r"^(?:#{1,4}\s*|<\|?|\*\*|\[)?([A-Za-z]{1,11})(?:\|?>|\*\*:?|\]:?|:|>)(?: |$)"
#: Symbols: marker (none or a role) x length (blank, short, middle, long) x question.
N_SYMBOLS = 4 * 4 * 2
N_STATES = 2 * len(ROLES)


def symbol(line: F.Column) -> F.Column:
    """The feature number of a line."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    role = F.lit(0)
    for k, r in enumerate(ROLES):
        role = F.when(name.isin(*MARKERS[r]), k + 1).otherwise(role)
    size = F.char_length(F.trim(line))
    length = F.when(size == 0, 0).when(size < 60, 1).when(size < 200, 2).otherwise(3)
    return (role * 8 + length * 2 + F.trim(line).endswith("?").cast("int")).cast("int")


def messages(transcripts: DataFrame) -> DataFrame:
    """(conv, turn, tie, text, + other columns) of rows (conv_id, turn, text, ...)."""
    name = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    equal = transcripts.groupBy(*transcripts.columns).agg(F.count("*").alias("copies"))
    # Equal rows without both are told apart by a number, dealt in blocks so that no array holds all of them.
    many = equal.withColumn("copies", F.when(name.isNull(), F.col("copies")).otherwise(1))
    blocks = many.withColumn("block", F.explode(F.expr("sequence(0L, (copies - 1) div 1024)")))
    rows = blocks.withColumn("copy", F.explode(F.expr("sequence(block * 1024, least(copies, (block + 1) * 1024) - 1)"))).drop("copies", "block")
    rows = rows.withColumn("tie", F.xxhash64("text", "turn", "conv_id"))
    number = F.when(F.col("copy") > 0, F.concat(F.lit("_"), F.col("copy").cast("string"))).otherwise("")
    rows = rows.withColumn("conv", F.coalesce(name, F.concat(F.lit("row"), F.col("tie").cast("string"), number))).drop("copy")
    return rows.withColumn("turn", F.coalesce("turn", F.lit(0)).cast("long")).withColumn("text", F.coalesce("text", F.lit("")))


def lines(said: DataFrame) -> DataFrame:
    """(line_no, line, symbol, + other columns) of ``messages``."""
    out = said.select("*", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).drop("text")
    return out.withColumn("symbol", symbol(F.col("line")))


def _ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` written in the order (conv, *order), with the range (part) that holds
    each: a conversation of any size is a few ranges, in the order of ``part``."""
    return handoff(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), name)


class Model:
    """Log probabilities: start (S), step (S x S), show (S x N_SYMBOLS)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, show: np.ndarray):
        normal = lambda x: np.log((x + 0.5) / (x + 0.5).sum(-1, keepdims=True))
        self.start, self.step, self.show = normal(start), normal(step), normal(show)
        inside = np.arange(N_STATES) % 2 == 1
        self.start[inside] = -np.inf  # a conversation begins with a turn
        other = np.arange(N_STATES)[:, None] // 2 != np.arange(N_STATES)[None] // 2
        self.step[other & inside[None]] = -np.inf  # a turn keeps its role


def fit(labelled: DataFrame) -> Model:
    """Counts over rows (conv_id, turn, role, text); unknown roles are left out.
    State 2 r: first line of a turn of role r; 2 r + 1: a further line."""
    role = F.expr("CASE " + " ".join(f"WHEN role = '{r}' THEN {k}" for k, r in enumerate(ROLES)) + " END")
    said = messages(labelled.select("conv_id", "turn", "role", "text"))
    rows = lines(said).withColumn("state", role * 2 + (F.col("line_no") > 0).cast("int")).where("state IS NOT NULL")
    rows = handoff(rows.select("conv", "turn", "tie", "state", "symbol"), "states")
    shown = rows.groupBy("state", "symbol").agg(F.count("*").alias("n"))
    # Within a turn the steps follow from its number of lines; between turns from the neighbours,
    # of which the first of a range is in the range before.
    turns = rows.groupBy("conv", "turn", "tie").agg(F.struct(F.min("state").alias("first"), F.count("*").alias("size")).alias("t"))
    turns = _ranges(turns, ["turn", "tie"], "turns")
    last = turns.groupBy("conv", "part").agg(F.max_by("t", F.struct("turn", "tie")).alias("last"))
    last = last.select("conv", "part", F.lag("last").over(Window.partitionBy("conv").orderBy("part")).alias("last"))
    near = F.lag("t").over(Window.partitionBy("conv", "part").orderBy("turn", "tie"))
    linked = turns.withColumn("near", near).join(last, ["conv", "part"]).withColumn("b", F.coalesce("near", "last"))
    steps = (linked.groupBy(F.col("t.first").alias("first"), F.col("b.first").alias("before"), F.expr("b.size > 1").alias("before_long"))
             .agg(F.count("*").alias("n"), F.sum(F.expr("IF(t.size > 1, 1, 0)")).alias("enter"), F.sum(F.expr("greatest(t.size - 2, 0)")).alias("stay")))
    start, step, show = np.zeros(N_STATES), np.zeros((N_STATES, N_STATES)), np.zeros((N_STATES, N_SYMBOLS))
    for r in shown.collect():  # at most N_STATES * N_SYMBOLS rows
        show[r["state"], r["symbol"]] += r["n"]
    for r in steps.collect():
        first = r["first"]
        step[first, first + 1] += r["enter"]
        step[first + 1, first + 1] += r["stay"]
        if r["before"] is None:
            start[first] += r["n"]
        else:
            step[r["before"] + int(bool(r["before_long"])), first] += r["n"]
    drop_handoff(rows)
    drop_handoff(turns)
    return Model(start, step, show)


def _whole_paths(symbols: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """States of the conversations ``symbols[offsets[i]:offsets[i + 1]]``, each
    decoded whole; 256 at a time advance together, the longest first."""
    moves = model.step[None] + model.show.T[:, None, :]
    sizes, out = np.diff(offsets), np.zeros(len(symbols), np.int32)
    order = np.argsort(-sizes, kind="stable")
    for low in range(0, len(order), 256):
        n, at = sizes[order[low:low + 256]], offsets[order[low:low + 256]]
        score, back = model.start + model.show.T[symbols[at]], []
        for t in range(1, n[0]):
            k = np.searchsorted(-n, -t)  # those with a line t
            total = score[:k, :, None] + moves[symbols[at[:k] + t]]
            back.append(total.argmax(1).astype(np.int8))
            score[:k] = total.max(1)
        state = score.argmax(1)
        out[at + n - 1] = state
        for t in range(n[0] - 1, 0, -1):
            k = len(back[t - 1])
            state[:k] = back[t - 1][np.arange(k), state[:k]]
            out[at[:k] + t - 1] = state[:k]
    return out


def _whole_turns(model: Model) -> Callable:
    """Arrow function: the turns (begin, n_lines, role) of whole conversations."""
    kind = pa.struct([("begin", pa.int32()), ("n_lines", pa.int32()), ("role", pa.int32())])

    @F.arrow_udf("array<struct<begin int, n_lines int, role int>>")
    def turns(shown: pa.Array) -> pa.Array:
        offsets = shown.offsets.to_numpy().astype(np.int64)
        symbols = shown.values.to_numpy()[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        states = _whole_paths(symbols, offsets, model)
        begins = np.flatnonzero(states % 2 == 0)
        sizes = np.diff(np.append(begins, len(states)))
        first = np.searchsorted(begins, offsets)
        begin = begins - np.repeat(offsets[:-1], np.diff(first))
        found = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (begin, sizes, states[begins] // 2)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)

    return turns


def _product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(1)
    return out


def _path(matrices: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """States after each matrix on the best path from ``enter``."""
    score, back = matrices[0][enter], []
    for m in matrices[1:]:
        total = score[:, None] + m
        back.append(total.argmax(0))
        score = total.max(0)
    state = int(score.argmax()) if leave is None else leave
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1]


def _line_matrices(symbols: np.ndarray, model: Model, first: bool) -> list[np.ndarray]:
    """One matrix per line. Row 0 stands for the start of a conversation as well: there it holds the start scores."""
    out = [model.step + model.show[:, s][None] for s in symbols]
    if first:
        out[0] = np.tile((model.start + model.show[:, symbols[0]])[None], (N_STATES, 1))
    return out


def _reduce_chunk(model: Model) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        m = _product(_line_matrices(table.column("symbol").to_numpy(), model, table.column("chunk")[0].as_py() == 0))
        return pa.table({"conv": table.column("conv").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})
    return run


def _matrices(table: pa.Table) -> list[np.ndarray]:
    return [np.array(m).reshape(N_STATES, N_STATES) for m in table.column("m").to_pylist()]


def _reduce_group(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    return pa.table({"conv": table.column("conv").slice(0, 1), "chunk": table.column("group").slice(0, 1), "m": pa.array([_product(_matrices(table)).ravel().tolist()], pa.list_(pa.float64()))})


def _borders(table: pa.Table) -> pa.Table:
    """States at the borders of a group's matrices; the group's own borders
    come as enter and leave (null: free)."""
    table = table.sort_by("chunk")
    enter, leave = table.column("enter")[0].as_py() or 0, table.column("leave")[0].as_py()
    states = _path(_matrices(table), enter, leave)
    return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "enter": pa.array([enter, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32())})


def _decode_chunk(model: Model) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = _line_matrices(table.column("symbol").to_numpy(), model, table.column("chunk")[0].as_py() == 0)
        states = _path(found, table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
        begins = np.cumsum(np.array(states) % 2 == 0)
        out = table.select(["conv", "conv_id", "chunk", "line"])
        return out.append_column("at", pa.array(np.arange(len(states)), pa.int32())).append_column("role", pa.array([ROLES[s // 2] for s in states])).append_column("begun", pa.array(begins, pa.int64()))
    return run


def _unmarked(line: F.Column) -> F.Column:
    return F.when(F.lower(F.regexp_extract(line, MARKER, 1)).isin(*_NAMES), F.regexp_replace(line, MARKER, "")).otherwise(line)


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """Turns recovered from rows (conv_id, turn, text): conv, conv_id, turn (from
    0), role, n_lines, text (markers removed) and rendered."""
    said = handoff(messages(transcripts.select("conv_id", "turn", "text")), "messages")
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    long = said.groupBy("conv").agg(F.sum(n_lines).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    long = handoff(long.where(f"n > {CHUNK} OR chars > {CHARS}").select("conv"), "long")
    turns = _short(said.join(long, "conv", "left_anti"), model).unionByName(_long(lines(said.join(long, "conv", "left_semi")), model))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def _short(said: DataFrame, model: Model) -> DataFrame:
    """Conversations of at most CHUNK lines: one row each, whose symbols alone go
    through Arrow."""
    whole = said.groupBy("conv", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "text"))).alias("said"))
    whole = whole.select("conv", "conv_id", F.flatten(F.transform("said", lambda m: F.split(m["text"], "\n", -1))).alias("line"))
    whole = whole.withColumn("found", _whole_turns(model)(F.transform("line", symbol)))

    def turn(t: F.Column, i: F.Column) -> F.Column:
        own = F.slice("line", t["begin"] + 1, t["n_lines"])
        role = F.get(F.array(*(F.lit(r) for r in ROLES)), t["role"])
        return F.struct(i.cast("long").alias("turn"), role.alias("role"), t["n_lines"].cast("long").alias("n_lines"), F.array_join(F.transform(own, _unmarked), "\n").alias("text"))

    return whole.select("conv", "conv_id", F.inline(F.transform("found", turn)))


def _long(shown: DataFrame, model: Model) -> DataFrame:
    """Longer conversations, from their lines: in chunks of CHUNK lines."""
    kind = shown.schema["conv_id"].dataType.simpleString()
    ranged = _ranges(shown, ["turn", "tie", "line_no"], "ranges")
    before = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = before.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "tie", "line_no"))
    placed = ranged.withColumn("within", within).join(before, ["conv", "part"]).withColumn("place", F.col("before") + F.col("within") - 1)
    all_lines = handoff(placed.select("conv", "conv_id", "place", F.expr(f"place div {CHUNK}").alias("chunk"), "line", "symbol"), "lines")
    drop_handoff(ranged)
    levels = [handoff(all_lines.select("conv", "chunk", "place", "symbol").groupBy("conv", "chunk").applyInArrow(_reduce_chunk(model), "conv string, chunk long, m array<double>"), "matrices")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) >= FAN:
        levels.append(handoff(levels[-1].withColumn("group", F.expr(f"chunk div {FAN}")).groupBy("conv", "group").applyInArrow(_reduce_group, "conv string, chunk long, m array<double>"), "matrices"))
    border_type = "conv string, chunk long, enter int, leave int"
    top = levels[-1].withColumn("enter", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int"))
    borders = [handoff(top.groupBy("conv").applyInArrow(_borders, border_type), "borders")]
    for level in reversed(levels[:-1]):
        above = borders[-1].withColumnRenamed("chunk", "group")
        borders.append(handoff(level.withColumn("group", F.expr(f"chunk div {FAN}")).join(above, ["conv", "group"]).groupBy("conv", "group").applyInArrow(_borders, border_type), "borders"))
    decoded = handoff(all_lines.join(borders[-1], ["conv", "chunk"]).groupBy("conv", "chunk").applyInArrow(_decode_chunk(model), f"conv string, conv_id {kind}, chunk long, line string, at int, role string, begun long"), "decoded")
    for done in (all_lines, *levels, *borders):
        drop_handoff(done)
    counts = decoded.groupBy("conv", "chunk").agg(F.max("begun").alias("turns"))
    offset = counts.select("conv", "chunk", (F.sum("turns").over(Window.partitionBy("conv").orderBy("chunk")) - F.col("turns")).alias("before"))
    turns = (decoded.join(offset, ["conv", "chunk"]).withColumn("turn", F.col("before") + F.col("begun") - 1)
             .groupBy("conv", "conv_id", "turn").agg(F.min("role").alias("role"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("chunk", "at", _unmarked(F.col("line")).alias("line")))).alias("all")))
    return turns.select("conv", "conv_id", "turn", "role", "n_lines", F.array_join(F.col("all.line"), "\n").alias("text"))


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the text as a line of a raw
    transcript: one of three marker styles for each conversation, no marker on
    about a fifth of the turns after the first."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    names = [("user", "assistant", "system"), ("human", "ai", "context"), ("instruction", "response", "system")]
    made = F.lit(None).cast("string")
    for k, by_role in enumerate(names):
        for role, name in zip(ROLES, by_role):
            mark = {0: f"{name.capitalize()}: ", 1: f"**{name}** ", 2: f"### {name.capitalize()}: "}[k]
            made = F.when((style == k) & (F.col("role") == role), mark).otherwise(made)
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0) & (F.col("turn") > 0)
    return conversations.withColumn("text", F.concat(F.when(bare, "").otherwise(F.coalesce(made, F.lit(""))), F.coalesce("text", F.lit(""))))
