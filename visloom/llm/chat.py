"""Transcript parsing: a hidden Markov model recovers the speakers, then turns are rendered canonically.

A transcript is plain text whose turns may carry a speaker marker ("User:", "### Assistant", "[bot]",
"Q:") on their own line or before their text, or none.  Hidden states are (role, first line of a turn with
text, first line without text, or later line); each line emits a marker (the word that stands in marker position, if any) and a shape class
(blank, question, length).  What markers mean is learned: the NAMES most frequent words in marker position
on first lines are classes of their own, all other words are one class.  Transition and emission counts come
from lines whose roles are known, smoothed by half a count; Viterbi decoding takes whole transcripts, many at
a time, with one back-pointer byte a state and line.

Defined results: a null or empty transcript has no turns and renders as ""; a line is never lost, blank lines
inside a turn stay; a marker is cut from a turn's first line only if its word has a class; equal transcripts
get equal results; of paths of equal likelihood the one with the lower state at the end, then at each line
before, is taken; an empty training table leaves a uniform model without markers; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

ROLES = ["system", "user", "assistant"]
FIRST, LATER, ALONE = range(3)  # state = 3 * role + one of these
STATES = 3 * len(ROLES)
MARKER = r"^\s*(?:#+\s*|\*\*|\[|<\|?)?\s*(?P<name>[A-Za-z]+)\s*(?:\*\*)?\s*(?:\|?>|\]|:)\s*(?:\*\*)?\s*|^\s*#+\s*(?P<head>[A-Za-z]+)\s*$"
NAMES, SHAPES = 64, 6
NEVER = -1e9


@dataclass(frozen=True)
class Model:
    """Marker words that have a class, and log probabilities of start, transitions, markers and shapes.

    Marker classes are: none, each word, any other word.
    """

    names: list[str]
    start: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    shape: np.ndarray


def line_features(lines: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(word in marker position or null, shape class, line without its marker) of each line."""
    found = pc.extract_regex(lines, MARKER)
    name = pc.if_else(pc.equal(pc.struct_field(found, "name"), ""), pc.struct_field(found, "head"), pc.struct_field(found, "name"))
    rest = pc.replace_substring_regex(lines, MARKER, "", max_replacements=1)
    words = pc.count_substring_regex(rest, r"\S+").to_numpy(zero_copy_only=False)
    asks = pc.match_substring_regex(rest, r"\?\s*$").to_numpy(zero_copy_only=False)
    shape = np.where(words == 0, 0, np.where(asks, 1, 2 + (words > 4) + (words > 12) + (words > 40)))
    return pc.utf8_lower(name), shape, rest


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all lines, number of lines of each text); an empty or null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, "\n")
    many, some = np.diff(lists.offsets.to_numpy()), pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    return lists.flatten().filter(pa.array(np.repeat(some, many))), many * some


def viterbi(model: Model, marks: np.ndarray, shapes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Most likely states of all lines; ``many`` has the number of lines of each transcript."""
    emit = model.mark[:, marks].T + model.shape[:, shapes].T
    back, out = np.zeros((len(emit), STATES), np.int8), np.zeros(len(emit), np.int8)
    order = np.argsort(-many, kind="stable")
    order = order[many[order] > 0]
    first, size = (np.cumsum(many) - many)[order], many[order]
    if not len(order):
        return out
    best = model.start + emit[first]
    for t in range(1, int(size[0])):  # the longest transcripts come first, so the live ones are a prefix
        live = int(np.searchsorted(-size, -t, "left"))
        via = best[:live, :, None] + model.move
        back[first[:live] + t] = via.argmax(1)
        best[:live] = via.max(1) + emit[first[:live] + t]
    state = best.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        at = first[:live] + t
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def fit(labelled: DataFrame) -> Model:
    """Model from rows with lines array<struct<role, first, line>>; tasks count, the driver gets sums.

    The driver gets the NAMES marker words that most first lines have, and a number a state for each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat = lists.flatten()
            if not len(flat):
                continue
            own = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            role = pc.index_in(flat.field("role"), pa.array(ROLES))
            known = np.flatnonzero(pc.is_valid(role).to_numpy(zero_copy_only=False))
            flat, own = flat.take(pa.array(known)), own[known]
            name, shape, _ = line_features(flat.field("line"))
            first = flat.field("first").to_numpy(zero_copy_only=False)
            state = role.take(pa.array(known)).to_numpy() * 3 + np.where(first, np.where(shape == 0, ALONE, FIRST), LATER)
            after = np.flatnonzero(own[1:] == own[:-1]) + 1
            begins = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])[: len(own)]
            parts = [("start", state[begins], None), ("move", state[after - 1] * STATES + state[after], None), ("shape", state * SHAPES + shape, None), ("mark", state, name)]
            rows = [pa.table({"kind": [kind] * len(at), "at": pa.array(at, pa.int64()), "name": pa.nulls(len(at), pa.string()) if x is None else x}) for kind, at, x in parts]
            yield from pa.concat_tables(rows).group_by(["kind", "at", "name"]).aggregate([([], "count_all")]).rename_columns(["kind", "at", "name", "n"]).to_batches()

    counts = labelled.select("lines").mapInArrow(count, "kind string, at long, name string, n long").groupBy("kind", "at", "name").agg(F.sum("n").alias("n"))
    first = F.sum(F.when(F.col("at") % 3 != LATER, F.col("n")).otherwise(0))
    top = counts.where("kind = 'mark' AND name IS NOT NULL").groupBy("name").agg(first.alias("first")).where("first > 0")
    names = sorted(r["name"] for r in top.orderBy(F.desc("first"), "name").limit(NAMES).collect())
    known = F.when(F.col("name").isNull() | F.col("name").isin(names), F.col("name")).otherwise(F.lit(""))
    start, move, mark, shape = (np.zeros((STATES, *n)) for n in ((), (STATES,), (len(names) + 2,), (SHAPES,)))
    place = {None: 0, "": len(names) + 1} | {x: i + 1 for i, x in enumerate(names)}
    for r in counts.groupBy("kind", "at", known.alias("name")).agg(F.sum("n").alias("n")).collect():
        if r["kind"] == "mark":
            mark[r["at"], place[r["name"]]] += r["n"]
        else:
            {"start": start, "move": move.reshape(-1), "shape": shape.reshape(-1)}[r["kind"]][r["at"]] += r["n"]
    return smoothed(names, start, move, mark, shape)


def smoothed(names: list[str], start: np.ndarray, move: np.ndarray, mark: np.ndarray, shape: np.ndarray) -> Model:
    """Log probabilities of counts plus a half.

    A transcript starts with the first line of a turn, and a turn's later line follows a line of the same turn.
    """
    log = lambda x: np.log((x + 0.5) / (x + 0.5).sum(-1, keepdims=True))
    begin, go = log(start), log(move)
    begin[LATER::3] = NEVER
    for i in range(STATES):
        for j in range(LATER, STATES, 3):
            if i // 3 != j // 3:
                go[i, j] = NEVER
    return Model(names, begin, go, log(mark), log(shape))


def parse(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(turns of each text, role of each turn, text of each turn) of a column of transcripts."""
    lines, many = split_lines(texts)
    name, shape, rest = line_features(lines)
    at = pc.index_in(name, pa.array(model.names, pa.string()))
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    marks = np.where(known, pc.fill_null(at, 0).to_numpy() + 1, np.where(pc.is_valid(name).to_numpy(zero_copy_only=False), len(model.names) + 1, 0))
    state = viterbi(model, marks, shape, many)
    begins = state % 3 != LATER
    said = pc.if_else(pa.array(begins & known), rest, lines)
    turn = np.flatnonzero(begins)
    lists = pa.ListArray.from_arrays(pa.array(np.append(turn, len(lines)).astype(np.int32)), said)
    own = np.repeat(np.arange(len(texts)), many)[turn]
    return np.bincount(own, minlength=len(texts)), state[turn] // 3, pc.utf8_trim(pc.binary_join(lists, "\n"), "\n")


def render(turns: np.ndarray, roles: pa.Array, said: pa.Array) -> pa.Array:
    """Canonical form: <|role|>, newline, text, <|end|>, newline for each turn."""
    parts = pc.binary_join_element_wise("<|", roles, "|>\n", said, "\n<|end|>\n", "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(turns)).astype(np.int32)), parts), "")


def formatted(transcripts: DataFrame, model: Model, key: str = "key", text_col: str = "transcript") -> DataFrame:
    """key, n_turns, roles (array), turns (array of text), rendered."""
    rows = transcripts.select(F.col(key).alias("key"), F.col(text_col).alias("transcript"))
    schema = rows.selectExpr("key", "0 as n_turns", "array('') as roles", "array('') as turns", "'' as rendered").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, role, said = parse(model, b.column(1))
            roles = pa.array(ROLES).take(pa.array(role))
            at = pa.array(np.append(0, np.cumsum(turns)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, x) for x in (roles, said)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(turns.astype(np.int32)), *lists, render(turns, roles, said)], ["key", "n_turns", "roles", "turns", "rendered"])

    return rows.mapInArrow(run, schema)


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """Raw transcripts derived from turn rows, one a conversation: conv_id, lines (with true roles), true_roles, transcript.

    Repeated rows count once.  A row holds one whole conversation, as a document's row holds its text.  Five marker styles are dealt out by a hash of the conversation; one turn in eight (by
    hash of conversation and turn) has its marker left out.
    """
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    style, bare = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)), F.pmod(F.crc32(F.concat_ws("-", "conv_id", "turn").cast("binary")), F.lit(8)) == 0

    def names(user: str, bot: str, system: str) -> Column:
        return F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", bot).otherwise(system)

    mark = (
        F.when(bare, "")
        .when(style == 0, names("User: ", "Assistant: ", "System: "))
        .when(style == 1, names("### Human\n", "### Assistant\n", "### System\n"))
        .when(style == 2, names("Q: ", "A: ", "Instructions: "))
        .when(style == 3, names("[user] ", "[bot] ", "[system] "))
        .otherwise(names("**Human:** ", "**AI:** ", "**System:** "))
    )
    said = F.split(F.concat(mark, "text"), "\n")
    lines = F.transform(said, lambda x, i: F.struct(F.col("role").alias("role"), (i == 0).alias("first"), x.alias("line")))
    rows = rows.withColumn("lines", lines)
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "lines"))).alias("t"))
        .select("conv_id", F.flatten(F.transform("t", lambda x: x["lines"])).alias("lines"), F.transform("t", lambda x: x["role"]).alias("true_roles"))
        .withColumn("transcript", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    )
