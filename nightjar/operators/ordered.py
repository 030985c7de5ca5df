"""Ordered work per key that survives a hot key.

A window or a collected list per key puts a whole key on one task. Instead rows are range-partitioned on
``(key, order)``: equal-sized blocks, where a hot key simply spans many of them. At most one key crosses each
block border, so everything one block must know about earlier blocks is a table with no more rows than there
are blocks. That table is what gets broadcast (or reaches the driver), never the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nightjar.session import materialize, shuffle_width

BLOCK = "block"


def order_blocks(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """Globally sorted range partitions, each tagged with its number, written to the checkpoint folder.

    The sort column list must identify a row, so that a dense key can be split anywhere.
    """
    width = blocks or shuffle_width(df.sparkSession)
    laid = (
        df.repartitionByRange(width, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(BLOCK, F.spark_partition_id())
    )
    return materialize(laid)


def block_window(keys: list[str], order: list[str]) -> Any:
    return Window.partitionBy(BLOCK, *keys).orderBy(*order)


def with_carry(laid: DataFrame, keys: list[str], partials: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Add, for every row, what the earlier blocks of its key hold.

    ``partials`` maps an output name to (aggregate over one block of a key, how to fold those aggregates). The
    carried table holds only the continuation blocks of keys that cross a border: fewer rows than blocks.
    """
    per_block = laid.groupBy(BLOCK, *keys).agg(*[agg.alias(name) for name, (agg, _) in partials.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    nth = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = (
        per_block.select(
            BLOCK, *keys, F.row_number().over(nth).alias("block_rank"),
            *[fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in partials.items()],
        )
        .where("block_rank > 1")
        .drop("block_rank")
    )
    return laid.join(F.broadcast(carried), [BLOCK, *keys], "left")


def with_row_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """0-based position of each row inside its key, without one task per key."""
    laid = order_blocks(df, keys, order)
    counted = with_carry(laid, keys, {"rows_before": (F.count(F.lit(1)), F.sum)})
    local = F.row_number().over(block_window(keys, order)) - 1
    return counted.withColumn("row_index", local.cast("long") + F.coalesce(F.col("rows_before"), F.lit(0))).drop("rows_before", BLOCK)


def with_history_chunks(indexed: DataFrame, history: int, size: int) -> DataFrame:
    """Cut every key into chunks of ``size`` rows, each also holding the ``history`` rows before it.

    Adds ``chunk`` and ``is_history``; a row-frame of up to ``history`` preceding rows is then exact inside
    (key, chunk), and no chunk exceeds ``size + history`` rows however hot the key is.
    """
    if size < history:
        raise ValueError("a chunk must be at least as long as the history it carries")
    home = F.floor(F.col("row_index") / size)
    as_history = F.col("row_index") >= (home + 1) * size - history
    copies = F.array_compact(F.array(
        F.struct(home.alias("chunk"), F.lit(False).alias("is_history")),
        F.when(as_history, F.struct((home + 1).alias("chunk"), F.lit(True).alias("is_history"))),
    ))
    return indexed.select("*", F.inline(copies))


# ---------------------------------------------------------------------------------------- ordered folds
class Fold:
    """A sequential reduction over the time-ordered rows of a key.

    ``start`` gives the state of an unseen key; ``step`` updates it in place and returns the records it emits.
    """

    columns: list[str] = []
    schema: T.StructType

    def start(self, key: str) -> Any:
        raise NotImplementedError

    def step(self, key: str, state: Any, row: tuple) -> Iterable[dict]:
        raise NotImplementedError

    def memory(self, key: str) -> int | None:
        """A pause of more than so many microseconds (``ts_us``, the first column) leaves nothing of the state; None if no pause does."""
        return None

    def horizon(self, key: str, state: Any) -> int | None:
        """Last time (microseconds) at which a row could still see this state; None if it always can."""
        return None


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


def _final_states(fold: Fold, incoming: dict[int, bytes]) -> Callable:
    """The state that each block leaves, and whether it is settled: a quiet gap inside makes it independent of the blocks before."""
    names = [BLOCK, "fold_key", *fold.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Any] = {}
        last: dict[int, int] = {}
        settled: dict[int, bool] = {}
        for block, key, *row in _rows(batches, names):
            if block not in states:
                states[block] = pickle.loads(incoming[block][1]) if block in incoming and incoming[block][0] == key else fold.start(key)
                settled[block], pause = False, fold.memory(key)
            elif pause is not None and row[0] - last[block] > pause:
                states[block], settled[block] = fold.start(key), True
            last[block] = row[0]
            for _ in fold.step(key, states[block], row):
                pass
        if states:
            yield pa.RecordBatch.from_pydict({
                BLOCK: pa.array(list(states), pa.int32()),
                "state": pa.array([pickle.dumps(s) for s in states.values()], pa.binary()), "settled": pa.array([settled[b] for b in states]),
            })

    return run


def _emit(fold: Fold, incoming: dict[int, tuple[str, bytes]]) -> Callable:
    names = [BLOCK, "fold_key", *fold.columns]
    arrow = to_arrow_schema(fold.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, pending = None, None, []
        for block, key, *row in _rows(batches, names):
            if (block, key) != current:
                current = (block, key)
                state = pickle.loads(incoming[block][1]) if block in incoming and incoming[block][0] == key else fold.start(key)
            pending.extend(fold.step(key, state, row))
            if len(pending) >= 4096:
                yield pa.RecordBatch.from_pylist(pending, schema=arrow)
                pending = []
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=arrow)

    return run


def fold_ordered(df: DataFrame, fold: Fold, order: list[str], blocks: int | None = None) -> DataFrame:
    """Run ``fold`` over each ``fold_key`` of ``df`` in ``order``, exactly, also when one key fills many blocks.

    Blocks fold in parallel from a guessed incoming state. The state left at a border is handed to the next
    block of the same key and only blocks whose incoming state changed fold again, until nothing changes; the
    last pass emits. A block with a pause longer than the fold's memory leaves a settled state, so rounds are needed only
    along unbroken runs of blocks. Only border states (one per block at most) reach the driver.
    """
    laid = order_blocks(df.select("fold_key", *fold.columns), ["fold_key"], order, blocks)
    spark = df.sparkSession
    spans = sorted(
        (r[BLOCK], r["lo"], r["hi"])
        for r in laid.groupBy(BLOCK).agg(F.min("fold_key").alias("lo"), F.max("fold_key").alias("hi")).collect()
    )
    following = {a[0]: b[0] for a, b in zip(spans, spans[1:]) if a[2] == b[1]}
    shared = {block: hi for block, _, hi in spans if block in following}
    whole = {block for block, lo, hi in spans if lo == hi}
    incoming: dict[int, tuple[str, bytes]] = {}
    settled: set[int] = set()
    targets = shared
    while targets:
        picks = spark.createDataFrame(list(targets.items()), f"{BLOCK} int, fold_key string")
        part = laid.join(F.broadcast(picks), [BLOCK, "fold_key"], "left_semi")
        ends = part.mapInArrow(_final_states(fold, incoming), f"{BLOCK} int, state binary, settled boolean").collect()
        changed = set()
        settled |= {end[BLOCK] for end in ends if end["settled"]}
        for end in ends:
            target, arriving = following[end[BLOCK]], (shared[end[BLOCK]], bytes(end["state"]))
            if incoming.get(target) != arriving:
                incoming[target] = arriving
                changed.add(target)
        targets = {b: k for b, k in shared.items() if b in changed and b in whole and b not in settled}
    return laid.mapInArrow(_emit(fold, incoming), fold.schema)


# ---------------------------------------------------------------------------------------- greedy spacing
LOWEST = -(1 << 62)  # a limit that every row reaches


def _next_rows(at: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Of each row the next one to be kept, if it is kept."""
    return np.maximum(np.searchsorted(at, then), np.arange(1, len(at) + 1))


def _pieces(at: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How a block turns the limit it is given into the one it leaves, as a step function (bounds, values).

    A limit up to a bound, and above the one before, becomes that bound's value; one above all bounds stays. The last row
    kept on the way from each row is found by doubling pointers.
    """
    n = len(at)
    hop, last = np.append(_next_rows(at, then), n), np.arange(n + 1)
    while (inside := np.flatnonzero(hop[:n] < n)).size:
        to = hop[inside]
        last[inside], hop[inside] = last[to], hop[to]
    out = then[last[:n]]
    ends = np.append(out[1:] != out[:-1], True)
    return at[ends], out[ends]


def _through(bounds: np.ndarray, values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    place = np.searchsorted(bounds, limits)
    return np.where(place < len(bounds), np.append(values, 0)[place], limits)


def _block_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    for batch in batches:
        place = np.asarray(batch.column("place"))
        for p in np.unique(place):
            own = batch.filter(pa.array(place == p))
            held.setdefault((own.column("fold_key")[0].as_py(), int(p)), []).append([np.asarray(own.column(c)) for c in ("at", "then")])
    for (key, place), parts in held.items():
        bounds, values = _pieces(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        yield pa.RecordBatch.from_pydict({"fold_key": pa.array([key] * len(bounds)), "place": pa.array([place] * len(bounds), pa.int32()), "bound": bounds, "value": values})


def _compose(later: pa.Table, earlier: pa.Table) -> pa.Table:
    """The step function of a block after that of the blocks before it."""
    if not earlier.num_rows or not later.num_rows:
        return later
    (b, v), (eb, ev) = ([np.asarray(t.sort_by("bound")[c]) for c in ("bound", "value")] for t in (later, earlier))
    beyond = b > eb[-1]
    bounds, values = np.concatenate([eb, b[beyond]]), np.concatenate([_through(b, v, ev), v[beyond]])
    ends = np.append(values[1:] != values[:-1], True)
    n = int(ends.sum())
    return pa.table({"fold_key": pa.array([later["fold_key"][0].as_py()] * n), "place": pa.array([later["place"][0].as_py()] * n, pa.int32()), "bound": bounds[ends], "value": values[ends]})


def _keep(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, limit = None, LOWEST
        for batch in batches:
            at, then, kept = np.asarray(batch.column("at")), np.asarray(batch.column("then")), []
            marks, keys, given = np.asarray(batch.column(BLOCK)), batch.column("fold_key"), batch.column("limit")
            ends = np.asarray(pc.run_end_encode(keys).run_ends)
            cuts = np.unique(np.concatenate([[0], ends, np.flatnonzero(np.diff(marks)) + 1])) if len(marks) else np.array([0])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (name := (int(marks[a]), keys[int(a)].as_py())) != current:
                    current, limit = name, given[int(a)].as_py()
                    limit = LOWEST if limit is None else limit
                if b - a == 1:
                    rows = [0] if at[a] >= limit else []
                else:
                    following, rows, i = _next_rows(at[a:b], then[a:b]), [], int(np.searchsorted(at[a:b], limit))
                    while i < b - a:
                        rows.append(i)
                        i = int(following[i])
                if rows:
                    kept += [int(a) + r for r in rows]
                    limit = int(then[a + rows[-1]])
            if kept:
                yield batch.take(pa.array(kept)).select(columns)

    return run


def keep_spaced(df: DataFrame, order: list[str], blocks: int | None = None) -> DataFrame:
    """Rows of each ``fold_key`` that a greedy walk keeps: a row with ``at`` of at least the limit, which then is its ``then``.

    ``at`` and ``then`` must not fall in ``order`` inside a key. A block of a key is a step function from limit to limit;
    the functions of all its blocks are composed by doubling, so a key over many blocks takes as many rounds as its number
    of blocks has binary digits. Functions and limits stay in tables; the driver learns the longest run of blocks.
    """
    columns = [c for c in df.columns if c not in ("at", "then")]
    laid = order_blocks(df, ["fold_key"], order, blocks)
    along = Window.orderBy(BLOCK)  # one row per block
    spans = laid.groupBy(BLOCK).agg(F.min("fold_key").alias("lo"), F.max("fold_key").alias("hi"))
    crossing = spans.select(BLOCK, F.col("hi").alias("fold_key"), F.lead("lo").over(along).alias("next_key"), F.lead(BLOCK).over(along).alias("into")).where("fold_key = next_key")
    crossing = materialize(crossing.select(BLOCK, "fold_key", "into", (F.row_number().over(Window.partitionBy("fold_key").orderBy(BLOCK)) - 1).alias("place")))
    longest = crossing.agg(F.max("place").alias("n")).first()["n"]
    if longest is None:
        limited = laid.withColumn("limit", F.lit(None).cast("long"))
    else:
        shape = "fold_key string, place int, bound long, value long"
        pieces = materialize(laid.join(F.broadcast(crossing), [BLOCK, "fold_key"]).select("fold_key", "place", "at", "then").mapInArrow(_block_pieces, shape))
        step = 1
        while step <= longest:
            before = pieces.where(F.col("place") + step <= longest).withColumn("place", F.col("place") + step)
            by = ["fold_key", "place"]
            pieces = materialize(pieces.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(_compose, shape))
            step *= 2
        first = pieces.groupBy("fold_key", "place").agg(F.min_by("value", "bound").alias("limit"))  # what the lowest limit becomes
        limits = crossing.join(first, ["fold_key", "place"]).select(F.col("into").alias(BLOCK), "fold_key", "limit")
        limited = laid.join(F.broadcast(limits), [BLOCK, "fold_key"], "left")
    return limited.mapInArrow(_keep(columns), df.select(*columns).schema)


def cooldown(df: DataFrame, keys: list[str], gap_us: int, keep: list[str], blocks: int | None = None) -> DataFrame:
    """Greedy suppression: rows at least ``gap_us`` after the last kept row of their key. Needs ``ts_us`` and ``seq``; returns ``keep``."""
    if gap_us <= 0:
        return df.select(*keep)
    columns = list(dict.fromkeys([*keep, "ts_us", "seq"]))
    key = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]))
    rows = df.select(key.alias("fold_key"), *columns, F.col("ts_us").alias("at"), (F.col("ts_us") + gap_us).alias("then"))
    return keep_spaced(rows, ["ts_us", "seq"], blocks).select(*keep)
