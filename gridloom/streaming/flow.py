"""Append-only growth of documents: one invalidation record for each append.

The state of a document is small: what the normaliser has pending, the open source (the part that may
still change its segments, sealed at a line feed or space once it is long enough) and the last
stretch of source, in which a window's start is moved back to a cluster boundary.  Batch replay and
the streaming query share ``append``; the order of appends is given by a sequence column.  Offsets
are UTF-16 code units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.width import clusters
from gridloom.operators.kernel import Options
from gridloom.sources.text import check_mode

WINDOW = 2048
#: An open source longer than MOST is sealed, and at least LEAST of it stays open.
LEAST, MOST = 128, 512
_SLACK = 256
_BLANK = frozenset(" \t\n\r\f")


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


@dataclass
class FlowState:
    generation: int = -1
    length: int = 0
    pending: bool = False  # white space (normal) or a CR (pre-wrap) at the end of the last append
    open_source: str = ""
    open_start: int = 0
    recent: str = ""

    def values(self) -> tuple:
        return self.generation, self.length, self.pending, self.open_source, self.open_start, self.recent


STATE = "generation int, length int, pending boolean, open_source string, open_start int, recent string"
RECORD = (
    "generation int, previous_generation int, appended int, stable_prefix int, first_invalid int, invalidated int,"
    " reprepared int, strategy string, source_delta string"
)


def normalise_append(state: FlowState, text: str, white_space: str) -> tuple[str, bool]:
    """(what the append adds to the source, pending flag after it)."""
    check_mode(white_space)
    if white_space == "pre-wrap":
        body = text[1:] if state.pending and text.startswith("\n") else text
        added = body.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n")
        return added, text.endswith("\r") if text else state.pending
    out, pending, any_yet = [], state.pending, state.length > 0
    for c in text:
        if c in _BLANK:
            pending = True
            continue
        if pending and any_yet:
            out.append(" ")
        pending, any_yet = False, True
        out.append(c)
    return "".join(out), pending


def seal(source: str, white_space: str) -> int:
    """Code points of an open source that are closed now."""
    if units(source) <= MOST:
        return 0
    cut = len(source)
    open_units = 0
    while cut and open_units < LEAST:
        cut -= 1
        open_units += 2 if source[cut] > "\uffff" else 1
    return source.rfind("\n" if white_space == "pre-wrap" else " ", 0, cut + 1) + 1


def _snap(recent: str, length: int, offset: int) -> int:
    """The last cluster boundary at or before an offset."""
    at = length - units(recent)
    best = min(at, offset) if offset < at else at
    for c in clusters(recent):
        if at > offset:
            break
        best = at
        at += units(c)
    return min(at, offset) if at <= offset else best


def append(state: FlowState, text: str, white_space: str = "normal", window: int = WINDOW) -> tuple:
    """Changes the state and gives its record; the first text of a document is generation 0."""
    if window <= 0:
        raise ValueError("a window is positive")
    before = state.length
    added, state.pending = normalise_append(state, text, white_space)
    reparse = state.open_start
    reprepared = units(state.open_source) + units(added)
    start = _snap(state.recent, before, max(0, before - window))
    first_invalid = min(before, start, reparse)
    state.length = before + units(added)
    source = state.open_source + added
    closed = seal(source, white_space)
    state.open_source, state.open_start = source[closed:], state.open_start + units(source[:closed])
    state.recent = (state.recent + added)[-(window + _SLACK) :]
    state.generation += 1
    first = state.generation == 0
    strategy = "initial" if first else "chunked-append-" + ("bounded" if reparse >= start else "normalized") + "-invalidation"
    return (
        state.generation, None if first else state.generation - 1, units(text), before, first_invalid, max(0, state.length - first_invalid),
        reprepared, strategy, added,
    )


def replay(appends: DataFrame, options: Options = Options(), window: int = WINDOW) -> DataFrame:
    """Records of appends (doc_id, seq, text), in the order of seq (ties by text).

    A task reads its documents' appends in order and holds one document's state.
    """
    names = ["generation", "previous_generation", "appended", "stable_prefix", "first_invalid", "invalidated", "reprepared", "strategy", "source_delta"]
    key, seq = appends.schema["doc_id"].dataType.simpleString(), appends.schema["seq"].dataType.simpleString()
    rows = appends.select("doc_id", "seq", "text").fillna({"text": ""}).repartition("doc_id").sortWithinPartitions("doc_id", "seq", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state = object(), FlowState()
        for batch in batches:
            out = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if d != doc:
                    doc, state = d, FlowState()
                out.append(append(state, text, options.white_space, window))
            if out:
                told = [pa.array(c, type=pa.string() if n in ("strategy", "source_delta") else pa.int32()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names=["doc_id", "seq", *names])

    return rows.mapInArrow(run, f"doc_id {key}, seq {seq}, {RECORD}")


def sources(records: DataFrame, generation: int | None = None) -> DataFrame:
    """doc_id, generation and the whole source of each document after its last append, or after the one of a
    generation (documents that have not come so far are as they are)."""
    held = records if generation is None else records.filter(F.col("generation") <= generation)
    parts = F.sort_array(F.collect_list(F.struct("generation", "source_delta")))
    text = F.array_join(F.transform("parts", lambda p: p["source_delta"]), "").alias("text")
    return held.groupBy("doc_id").agg(parts.alias("parts"), F.max("generation").alias("generation")).select("doc_id", "generation", text)


def stream(appends: DataFrame, white_space: str = "normal", window: int = WINDOW) -> DataFrame:
    """The same for a streaming DataFrame; appends of one micro-batch are ordered by seq."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = FlowState(*held.get) if held.exists else FlowState()
        rows = pd.concat(list(frames)).sort_values(["seq", "text"], kind="stable")
        out = [(key[0], s, *append(state, t or "", white_space, window)) for s, t in zip(rows["seq"], rows["text"], strict=True)]
        held.update(state.values())
        names = ["doc_id", "seq", "generation", "previous_generation", "appended", "stable_prefix", "first_invalid", "invalidated", "reprepared", "strategy", "source_delta"]
        frame = pd.DataFrame(out, columns=names)
        frame["previous_generation"] = frame["previous_generation"].astype("Int32")
        yield frame

    key, seq = appends.schema["doc_id"].dataType.simpleString(), appends.schema["seq"].dataType.simpleString()
    return appends.select("doc_id", "seq", "text").groupBy("doc_id").applyInPandasWithState(
        step, f"doc_id {key}, seq {seq}, {RECORD}", STATE, "append", GroupStateTimeout.NoTimeout
    )
