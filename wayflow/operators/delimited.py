"""Rows that fail to parse: a quote-aware finite-state tokenizer over raw records.

The records of an Arrow batch form one byte string. It is cut into equal chunks and every chunk is run from *all* states at once,
position by position across the chunks; the resulting maps "state before -> state after" are composed with a logarithmic scan, which
gives each chunk its true start state, and a second pass labels every byte. A chunk may begin anywhere, inside quotes or not, so
the work per byte is the same however the records lie.

Defined results: a null, blank, ``#`` or repeated-header line is no data and gives no row; a file without a first line has no header,
so each of its data lines is rejected as ``column_count`` unless its quoting is broken; a header that lacks a checked column makes that
column invalid in every row of the file, and of several columns of one name the first counts; of several first lines of a file the one with the lowest line_id counts; a null file name is a file of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflow.session import cut, measured

START, PLAIN, QUOTED, CLOSING, BROKEN = range(5)
OTHER, QUOTE, COMMA, END = range(4)
#: NEXT[class, state] is the state after a byte of that class.
NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [QUOTED, BROKEN, CLOSING, QUOTED, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
CLASS = np.zeros(256, np.uint8)
CLASS[ord('"')], CLASS[ord(",")] = QUOTE, COMMA

CHECKED = ("dataset", "iteration", "total_after")
VALID = {
    "dataset": r"\A(?:Hop[0-9]+Rep|BJRealRep|MHRealRep)[0-9]+-[0-9]+\z",
    "iteration": r"\A0*[0-9]{1,3}\z",
    "total_after": r"\A0*[0-9]{1,19}\z",
}
#: The columns of an ablation fact row in order, with the type each is given (fixed values).
ABLATION = (
    "run_id string, dataset string, hop int, rep int, seed int, query_count bigint, iteration int, selection_method string, removal_mode string, "
    "selection_fraction int, gamma int, candidate_theta int, reroute_method string, impact_weight int, random_seed bigint, selected_count bigint, "
    "selected_fraction double, candidate_filter string, candidate_count bigint, candidate_fraction double, candidate_sec double, batch_count bigint, "
    "total_before bigint, total_after bigint, reduction bigint, initial_routes_sec double, evaluate_before_sec double, tdg_prepare_sec double, "
    "important_nodes_sec double, select_sec double, normalize_sec double, batch_sec double, reroute_sec double, evaluate_after_sec double, "
    "method_total_sec double, cumulative_sec double, mean_selected_impact_score double, mean_all_query_impact_score double, tdg_node_count bigint, "
    "tdg_edge_timeline_count bigint, anchor_score_max_sec double, reroute_critical_sec double"
)
ABLATION_COLUMNS = [tuple(x.split()) for x in ABLATION.split(", ")]


def label(classes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The state before each byte, by composing the chunks' transition maps."""
    n = len(classes)
    k = max(1, -(-n // chunk))
    padded = np.full(k * chunk, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(k, chunk).T)
    maps = np.tile(np.arange(5, dtype=np.uint8), (k, 1))
    for row in steps:
        maps = NEXT[row[:, None], maps]
    step = 1  # inclusive scan: maps[i] becomes the composition of chunks 0..i
    while step < k:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.zeros(k, np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty((chunk, k), np.uint8)
    for i, row in enumerate(steps):
        out[i] = state
        state = NEXT[row, state]
    return out.T.reshape(-1)[:n]


def sliced(buffer: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The stretches lo..hi of a buffer as an Arrow array of strings."""
    size = np.maximum(hi - lo, 0)
    offsets = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[at])])


class Tokenized:
    """Field boundaries of a batch of records, and where each record's quoting breaks."""

    def __init__(self, records: pa.Array, chunk: int = 512):
        lines = pc.binary_join_element_wise(records.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        n = len(lines)
        offsets = np.frombuffer(lines.buffers()[1], np.int64, n + 1 + lines.offset)[lines.offset :] if n else np.zeros(1, np.int64)
        whole = np.frombuffer(lines.buffers()[2], np.uint8) if n and lines.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.buffer = whole[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.starts, self.ends = offsets[:-1], offsets[1:] - 1
        classes = CLASS[self.buffer]
        classes[self.ends] = END
        before = label(classes, chunk)
        after = NEXT[classes, before]
        broken = (after == BROKEN) & (before != BROKEN)
        broken[self.ends] = before[self.ends] == QUOTED
        at = np.flatnonzero(broken)
        first = np.searchsorted(at, self.starts)
        self.offset = np.full(n, -1, np.int64)  # byte offset in the record of the first break
        hit = first < len(at)
        hit[hit] = at[first[hit]] <= self.ends[hit]
        self.offset[hit] = at[first[hit]] - self.starts[hit]
        self.stops = np.flatnonzero(((classes == COMMA) & (before != QUOTED) & (before != BROKEN)) | (classes == END))
        self.first = np.searchsorted(self.stops, self.starts)
        self.last = np.searchsorted(self.stops, self.ends)
        self.fields = self.last - self.first + 1

    def bounds(self, records: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where field k[i] of record records[i] lies in the buffer."""
        at = self.first[records] + k
        return np.where(k == 0, self.starts[records], self.stops[np.maximum(at - 1, 0)] + 1), self.stops[at]

    def field(self, records: np.ndarray, k: np.ndarray) -> pa.Array:
        """Fields as ``bounds`` places them, unquoted and without blanks at either end."""
        lo, hi = self.bounds(records, k)
        quoted = (hi > lo) & (self.buffer[np.minimum(lo, max(len(self.buffer) - 1, 0))] == ord('"')) if len(self.buffer) else np.zeros(len(lo), bool)
        out = sliced(self.buffer, lo + quoted, hi - quoted)
        if quoted.any():
            out = pc.if_else(pa.array(quoted), pc.replace_substring(out, '""', '"'), out)
        return pc.utf8_trim_whitespace(out)


def plain(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = Tokenized(batch.column(1))
        names = [t.field(np.full(n, i), np.arange(n)).to_pylist() for i, n in enumerate(t.fields)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.string()))], names=["file", "header", "names"])


def _valid(name: str, values: pa.Array) -> np.ndarray:
    ok = pc.match_substring_regex(values, VALID[name])
    if name == "total_after":
        digits = pc.utf8_ltrim(values, "0")
        size = pc.utf8_length(digits)
        ok = pc.and_(ok, pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, str(2**63 - 1)))))
    return ok.to_numpy(zero_copy_only=False)


def _lines(wanted: list[str], only_bad: bool):
    """Fields are found, cut out and tested as arrays; single records are touched only for the offset of a fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line_id, line, names = batch.columns
            n = batch.num_rows
            t = Tokenized(line)
            coded = pc.dictionary_encode(pc.binary_join(names, "\x00"))  # files share their headers
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = [str(x).split("\x00") for x in coded.dictionary.to_pylist()]
            size = np.array([*map(len, heads), -1])
            why = np.where(t.offset >= 0, 1, np.where(t.fields != size[code], 2, 0))
            bad = np.where(why > 0, 0, -1)
            offset = np.where(why == 1, t.offset, 0)
            place = lambda c: np.array([*(h.index(c) if c in h else -1 for h in heads), -1])[code]  # noqa: E731, B023
            for k, c in enumerate(CHECKED, 1):
                left = np.flatnonzero(why == 0)
                at = place(c)[left]
                known = at >= 0
                fine = np.zeros(len(left), bool)
                fine[known] = _valid(c, t.field(left[known], at[known]))
                out = left[~fine]
                why[out], bad[out] = 3, k
                offset[out] = np.where(at[~fine] >= 0, t.bounds(out, np.maximum(at[~fine], 0))[0] - t.starts[out], 0)
            rows = np.flatnonzero(why > 0) if only_bad else np.arange(n)
            chars = [None if not why[r] else len(t.buffer[t.starts[r] : t.starts[r] + offset[r]].tobytes().decode("utf-8", "ignore")) if offset[r] else 0 for r in rows]
            reasons, fields = pa.array([None, "quoting", "column_count", "invalid_value"]), pa.array(["line", *CHECKED])
            columns = []
            good = np.flatnonzero(why == 0)
            for c in wanted:
                at = place(c)[good]
                known = at >= 0
                value = t.field(good[known], at[known])
                index = np.full(n, -1)
                index[good[known]] = np.arange(len(value))
                columns.append(value.take(pa.array(index[rows], mask=index[rows] < 0)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [line_id.take(pa.array(rows)), reasons.take(pa.array(why[rows])), fields.take(pa.array(bad[rows], mask=bad[rows] < 0)), pa.array(chars, pa.int64()), *columns],
                names=["line_id", "reason", "bad_field", "error_offset", *wanted],
            )

    return run


def parse_result_lines(lines: DataFrame, columns: list[str] | None = None, only_bad: bool = False) -> DataFrame:
    """Every data line of the result files (line_id, file_name, line_no, line): reason, bad_field and the character offset of the fault,
    or, where these are null, the fields named in ``columns`` as text. only_bad: good lines are left out.

    The headers, one row per file, are worked out first. If they are small as measured they are broadcast, so that the lines stay where they were read;
    else both sides are joined by file name, and a hot file is split by the adaptive planner.
    """
    wanted = list(columns or [])
    file = F.coalesce(F.col("file_name"), F.lit("\x00")).alias("file")
    heads = (
        lines.where((F.col("line_no") == 1) & F.col("line").isNotNull())
        .groupBy(file)
        .agg(F.min_by("line", "line_id").alias("line"))
        .select("file", plain(F.regexp_replace("line", "^\ufeff", "")).alias("header"))
        .mapInArrow(_headers, "file string, header string, names array<string>")
    )
    heads = measured(cut(heads))
    body = lines.where(((F.col("line_no") > 1) | F.col("line_no").isNull()) & F.col("line").isNotNull()).select("line_id", file, plain(F.col("line")).alias("line"))
    body = body.where(~F.col("line").startswith("#") & ~F.col("line").rlike(r"(?U)\A\s*\z"))
    joined = body.join(heads, "file", "left").where(~F.col("line").eqNullSafe(F.col("header"))).select("line_id", "line", "names")
    schema = ", ".join(["line_id bigint, reason string, bad_field string, error_offset bigint", *(f"{c} string" for c in wanted)])
    return joined.mapInArrow(_lines(wanted, only_bad), schema)


def rejected(lines: DataFrame) -> DataFrame:
    return parse_result_lines(lines, only_bad=True).select("line_id", "reason", "bad_field")


def typed(lines: DataFrame) -> DataFrame:
    """The good lines as typed ablation rows; an unchecked field that does not convert, or is absent, is null."""
    parsed = parse_result_lines(lines, [c for c, _ in ABLATION_COLUMNS]).where("reason is null")
    return parsed.select("line_id", *(F.expr(c if t == "string" else f"try_cast({c} as {t})").alias(c) for c, t in ABLATION_COLUMNS))
