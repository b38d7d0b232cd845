"""Run a user's model over a table: one build per task, batches, isolated failures, fallbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.sources.listing import read_file

Predictor = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Attempt:
    """One rung of the retry ladder.

    ``prepare`` changes the input before the call (for instance cuts it shorter); ``make`` builds
    another predictor than the stage's own (for instance on a second device).
    """

    name: str
    prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    make: Callable[[], Predictor] | None = None


FULL = Attempt("full")

# A batch that fails is divided into so many parts.
PARTS = 8
# About so many rows are handed back at once, in whole batches of the largest size.
HANDED_ON = 256
# Fewer where they name files of more bytes.
LOT_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Call:
    """One model of a group: what it is built by, what it gets and returns, how it is tried (see ``infer_stage``)."""

    name: str
    make: Callable[[], Predictor]
    inputs: Sequence[str]
    out_schema: str | T.StructType
    batch_size: int = 64
    attempts: Sequence[Attempt] = (FULL,)
    default: dict | None = None
    on_error: str = "record"
    min_interval_s: float = 0.0
    only: str | None = None



def _parsed(call: Call) -> Call:
    """The call with its schema as a type, which workers can't make of text."""
    return replace(call, out_schema=T.StructType.fromDDL(call.out_schema)) if isinstance(call.out_schema, str) else call


def _handed_on(frame: pd.DataFrame, calls: Sequence[Call]) -> Iterator[pd.DataFrame]:
    """The frame in lots of whole batches: results of a lot, which may be larger than its inputs, leave before the next."""
    largest = max(call.batch_size for call in calls)
    size = largest * max(1, -(-HANDED_ON // largest))
    for at in range(0, max(len(frame), 1), size):
        yield frame.iloc[at : at + size]


def _opened(frame: pd.DataFrame, calls: Sequence[Call], files: Mapping[str, str]) -> Iterator[pd.DataFrame]:
    """Lots of whole batches with the bytes of the files they name, which are read a few MB at a time."""
    largest, known, begun, held = max(call.batch_size for call in calls), {}, 0, 0
    bodies: dict[str, list[bytes]] = {content: [] for content in files}
    for at in range(0, len(frame), largest):
        end = min(at + largest, len(frame))
        for content, path in files.items():
            bodies[content] += [read_file(p, known) for p in frame[path].iloc[at:end]]
            held += sum(map(len, bodies[content][at - begun :]))
        if held >= LOT_BYTES or end - begun >= HANDED_ON or end == len(frame):
            yield frame.iloc[begun:end].assign(**bodies)
            begun, held, bodies = end, 0, {content: [] for content in files}


def _solver(call: Call) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Builds each rung's predictor once; gives the outputs, ``attempt``, ``status`` and ``error`` of a frame's rows."""
    out_names = call.out_schema.fieldNames()
    added = [*out_names, "attempt", "status", "error"]
    ladder, fallback, built = list(call.attempts), dict(call.default or {}), {}

    def ask(rung: int, batch: pd.DataFrame) -> pd.DataFrame:
        attempt = ladder[rung]
        if rung not in built:
            built[rung] = (attempt.make or call.make)()
        given = batch.reset_index(drop=True)
        try:
            made = built[rung](attempt.prepare(given) if attempt.prepare else given)
        finally:
            if call.min_interval_s:
                time.sleep(call.min_interval_s)
        if len(made) != len(batch):
            raise ValueError(f"{len(made)} results for {len(batch)} inputs")
        wanted = [*out_names, *(["error"] if "error" in made.columns and "error" not in out_names else [])]
        # models are asked for a few rows at a time, so what is done per call is kept short
        return (made if list(made.columns) == wanted else made[wanted]).set_axis(batch.index)

    def noted(made: pd.DataFrame, rung: int) -> pd.DataFrame:
        return made.assign(attempt=ladder[rung].name, status="retried" if rung else "ok", error=None)

    def isolate(rung: int, batch: pd.DataFrame, done: list[tuple[pd.DataFrame, int]], errors: dict[int, str]) -> None:
        """Results of the rows this attempt can do; a batch that raises is divided down to its culprits."""
        try:
            made = ask(rung, batch)
        except Exception as problem:
            if len(batch) == 1:
                errors[batch.index[0]] = f"{type(problem).__name__}: {problem}"
                return
            size = -(-len(batch) // PARTS)
            for at in range(0, len(batch), size):
                isolate(rung, batch.iloc[at : at + size], done, errors)
            return
        if "error" in made.columns and "error" not in out_names:
            # rows the model itself reports are not asked about again
            failed = made["error"].notna()
            errors.update(made.loc[failed, "error"].astype(str).to_dict())
            made = made.loc[~failed, out_names]
        if len(made):
            done.append((made, rung))

    def solve(batch: pd.DataFrame) -> tuple[pd.DataFrame, int | None]:
        """The outputs of a batch and the rung that gave them all; without such a rung, with their notes."""
        done: list[tuple[pd.DataFrame, int]] = []
        left, errors = batch, {}
        for rung in range(len(ladder)):
            errors = {}
            isolate(rung, left, done, errors)
            if not errors:
                break
            left = left.loc[list(errors)]
        if errors and call.on_error == "raise":
            raise RuntimeError(next(iter(errors.values())))
        if not errors and len(done) == 1:
            return done[0]
        # columns of several origins: values stay as they are, none becomes another type
        blank = [(*[fallback.get(n) for n in out_names], None, "default", e) for e in errors.values()]
        rest = [pd.DataFrame(blank, columns=added, index=list(errors), dtype=object)] if errors else []
        return pd.concat([noted(*d).astype(object) for d in done] + rest).loc[batch.index], None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple[pd.DataFrame, int | None]] = []
        for at in range(0, len(frame), call.batch_size):
            part = frame.iloc[at : at + call.batch_size].reset_index(drop=True)
            chosen = part.index if call.only is None else part.index[part[call.only].fillna(False).astype(bool)]
            if len(chosen) == len(part):
                parts.append(solve(part[list(call.inputs)]))
                continue
            made = pd.DataFrame(columns=added)
            if len(chosen):
                made, rung = solve(part.loc[chosen, list(call.inputs)])
                made = made if rung is None else noted(made, rung)
            made = made.astype(object).reindex(part.index)
            made = made.where(made.notna(), None)
            made.loc[part.index.difference(chosen), "status"] = "skipped"
            parts.append((made.loc[part.index, added], None))
        if not parts:
            return pd.DataFrame(columns=added)
        rungs = {rung for _, rung in parts}
        alike = len(rungs) == 1 and None not in rungs
        frames = [made if alike or rung is None else noted(made, rung) for made, rung in parts]
        if len({tuple(f.dtypes) for f in frames}) > 1:
            frames = [f.astype(object) for f in frames]
        whole = pd.concat(frames, ignore_index=True)
        return noted(whole, rungs.pop()) if alike else whole

    return run


NOTES = ("attempt", "status", "error")


def infer_stage(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    input_cols: Sequence[str],
    out_schema: str | T.StructType,
    batch_size: int = 64,
    attempts: Sequence[Attempt] = (FULL,),
    default: dict | None = None,
    on_error: str = "record",
    min_interval_s: float = 0.0,
    only: str | None = None,
    lanes: int | None = None,
) -> DataFrame:
    """Adds the predictor's columns, ``attempt``, ``status`` and ``error`` to every row.

    The predictor gets a frame of ``input_cols`` and returns one of ``out_schema`` with as many
    rows; it may report rows it can't do in a column ``error`` of its own. A batch that raises is divided until the rows
    that make it fail stand alone; failed rows go on to the next attempt together. Rows that no attempt could do get
    ``default`` (or nulls) and the last error, or fail the task with ``on_error="raise"``. ``status`` is ``ok``,
    ``retried`` or ``default``. With ``min_interval_s`` a task waits that long after each call. ``lanes`` deals the rows to so many
    tasks, whatever the size of the cluster: there are never more callers at once, nor more than ``lanes`` calls an
    interval. ``only`` names a boolean column; rows without it are ``skipped`` and get nulls.
    """
    if on_error not in ("record", "raise"):
        raise ValueError(f"on_error is {on_error!r}: record or raise")
    inputs = list(input_cols)
    mark = "_only" if only else None
    call = _parsed(Call("", make_predictor, inputs, out_schema, batch_size, attempts, default, on_error, min_interval_s, mark))
    outputs = call.out_schema
    taken = set(df.columns) & {*outputs.fieldNames(), *NOTES}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    result = T.StructType([*outputs.fields, *[T.StructField(n, T.StringType()) for n in NOTES]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solve = _solver(call)
        for frame in frames:
            for lot in _handed_on(frame, [call]):
                yield solve(lot)

    # only the inputs go to Python and only the results come back; the mark keeps the optimizer from
    # running the model once per use of a result
    model = F.pandas_udf(run, result).asNondeterministic()
    given = [F.col(c) for c in inputs] + ([F.col(only).alias("_only")] if only else [])
    dealt = df.repartition(lanes) if lanes else df
    return dealt.withColumn("_made", model(F.struct(*given))).select(*df.columns, "_made.*")


def infer_group(df: DataFrame, calls: Sequence[Call], files: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the outputs of several models and ``<name>_error`` of each; the columns they share go to Python once.

    All models of a group are built in one worker per task and run one after the other on each batch; none may need what
    another one returns. An input that ``files`` names is no column: the worker reads it from the file whose path is in the column
    named there, so its bytes never pass through Spark.
    """
    calls = [_parsed(call) for call in calls]
    inputs = list(dict.fromkeys(c for call in calls for c in [*call.inputs, *([call.only] if call.only else [])]))
    read = {content: path for content, path in (files or {}).items() if content in inputs}
    inputs = list(dict.fromkeys(read.get(c, c) for c in inputs))
    fields = [f for call in calls for f in [*call.out_schema.fields, T.StructField(f"{call.name}_error", T.StringType())]]
    taken = set(df.columns) & {f.name for f in fields}
    if taken or len({f.name for f in fields}) < len(fields):
        raise ValueError(f"columns {sorted(taken) or sorted(f.name for f in fields)} are there already")
    names = [(call.out_schema.fieldNames(), f"{call.name}_error") for call in calls]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solvers = [_solver(call) for call in calls]
        for frame in frames:
            for lot in _opened(frame, calls, read) if read and len(frame) else _handed_on(frame, calls):
                made = [solve(lot).rename(columns={"error": error})[[*outs, error]] for solve, (outs, error) in zip(solvers, names)]
                yield pd.concat(made, axis=1)

    model = F.pandas_udf(run, T.StructType(fields)).asNondeterministic()
    return df.withColumn("_made", model(F.struct(*inputs))).select(*df.columns, "_made.*")
