"""Joins of wide rows that cross their shuffles as compressed parcels.

A slot is what one task joins in memory.  Rows are dealt to slots by the hash of a key;
the task that has them packs the rows of a slot column by column and compresses them as
a whole, so ids, codes and times take a fraction of a row's bytes.  A join's task opens
the parcels of its slot and packs what it finds for the next one.  Keys with too many
rows for a slot share several, and every one of these gets the key's rows of the lookup.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.shipping import by_value

by_value(__name__)

# the slot of this join and of the next; lookups come before the rows that look them up
SLOT, NEXT = "_slot", "_next"
LOOKUP, ROWS = 0, 1
PARCELS = f"{SLOT} int, _kind int, _size int, _parcel binary"
# rows of a slot; ranges of hashes, which is the most slots there can be; rows looked at for hot keys
PER_SLOT, RANGES, LOOKED_AT = 600_000, 65_536, 2_000_000
# bytes a task gathers before it packs, rows of a parcel, bytes of parcels in a batch, rows joined at once
HELD, LONGEST, SENT, AT_ONCE = 64 << 20, 16_384, 8 << 20, 1 << 17
PADDING, LEVEL = 64, 3


def _steps(values: np.ndarray) -> tuple[int, int, str, bytes]:
    """Whole numbers as counts of their largest common step above the least."""
    least = int(values.min())
    above = values - least if int(values.max()) - least < 2**63 else values.view(np.uint64) - np.uint64(least % 2**64)
    step = max(1, int(np.gcd.reduce(above)))
    above = above // step
    kind = np.min_scalar_type(above.max())
    return least, step, kind.str, above.astype(kind).tobytes()


def _unstepped(least: int, step: int, kind: str, above: bytes) -> np.ndarray:
    return _padded((np.frombuffer(above, kind).astype(np.uint64) * np.uint64(step) + np.uint64(least % 2**64)).view(np.int64))


def _padded(values: np.ndarray) -> np.ndarray:
    """A copy with room behind it: Arrow's joins read whole words, also past the end of a buffer."""
    room = np.zeros(values.nbytes + PADDING, np.uint8)
    room[:values.nbytes] = values.view(np.uint8)
    return room[:values.nbytes].view(values.dtype)


def _repeats(column: pa.Array) -> bool:
    start = column.slice(0, 64)
    return len(column) < 64 or len(start.dictionary_encode().dictionary) < 48


def _closed(rows: pa.Table) -> tuple[int, bytes]:
    """Size and bytes of a parcel: whole numbers and times as steps, texts as lengths and letters, few values as codes."""
    packed, plain = {}, {}
    for name, column in zip(rows.column_names, rows.columns):
        column = column.combine_chunks()
        kind = column.type
        if (pa.types.is_string(kind) or pa.types.is_floating(kind) or pa.types.is_timestamp(kind)) and _repeats(column):
            coded = column.dictionary_encode()
            if len(coded.dictionary) * 4 <= len(column):
                short = pa.int8() if len(coded.dictionary) <= 127 else pa.int16()
                plain[name] = pa.DictionaryArray.from_arrays(coded.indices.cast(short), coded.dictionary)
                continue
        if column.null_count or not (pa.types.is_string(kind) or pa.types.is_timestamp(kind) or pa.types.is_int64(kind)):
            plain[name] = column
        elif pa.types.is_string(kind):
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
            packed[name] = kind, _steps(np.diff(ends).astype(np.int64)), column.buffers()[2][ends[0]:ends[-1]].to_pybytes() if ends[-1] > ends[0] else b""
        else:
            packed[name] = kind, _steps(np.asarray(column.cast(pa.int64()))), None
    sink = pa.BufferOutputStream()
    if plain:
        batch = pa.record_batch(list(plain.values()), names=list(plain))
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
    raw = pickle.dumps((rows.column_names, packed, sink.getvalue().to_pybytes()), pickle.HIGHEST_PROTOCOL)
    return len(raw), pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _opened(size: int, parcel: bytes) -> pa.Table:
    names, packed, plain = pickle.loads(pa.decompress(parcel, size, codec="zstd", asbytes=True))
    columns = {}
    if plain:
        columns = dict(zip((rest := pa.ipc.open_stream(plain).read_all()).column_names, rest.columns))
    for name, column in columns.items():
        if pa.types.is_dictionary(column.type):
            columns[name] = column.cast(column.type.value_type)
    for name, (kind, steps, letters) in packed.items():
        values = _unstepped(*steps)
        if letters is None:
            columns[name] = pa.array(values).cast(kind)
        else:
            ends = _padded(np.concatenate([[0], np.cumsum(values)]).astype(np.int32))
            columns[name] = pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(ends), pa.py_buffer(_padded(np.frombuffer(letters, np.uint8)))])
    return pa.table([columns[n] for n in names], names=names)


def _table(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[SLOT, "_kind", "_size", "_parcel"])


def _packed(parts: Iterator[pa.Table], kind: int, by: str) -> Iterator[pa.RecordBatch]:
    """Rows as parcels of one slot each, which is in the column ``by``."""

    def sent(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        slot = rows.column(by).to_numpy()
        order = np.argsort(slot, kind="stable")
        rows, slot = rows.drop_columns([by]).take(pa.array(order)).combine_chunks(), slot[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
        found, size = [], 0
        for at in (at for lo, hi in zip(starts, [*starts[1:], len(slot)]) for at in range(lo, hi, LONGEST)):
            end = min(at + LONGEST, int(np.searchsorted(slot, slot[at], "right")))
            found.append((int(slot[at]), kind, *_closed(rows.slice(at, end - at))))
            size += len(found[-1][-1])
            if size >= SENT:
                yield _table(found)
                found, size = [], 0
        if found:
            yield _table(found)

    held, size = [], 0
    for part in (p for p in parts if p.num_rows):
        held.append(part)
        size += part.nbytes
        if size >= HELD:
            yield from sent(held)
            held, size = [], 0
    if held:
        yield from sent(held)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, pa.Table]]:
    """Rows of a slot, some at a time, beside all of its lookup."""
    parcels = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for _, group in itertools.groupby(parcels, key=lambda row: row[0]):
        lookup = None
        for kind, of_kind in itertools.groupby(group, key=lambda row: row[1]):
            opened = (_opened(size, parcel) for _, _, size, parcel in of_kind)
            if kind == LOOKUP:
                lookup = pa.concat_tables(opened).combine_chunks()
                continue
            some, n = [], 0
            for rows in opened:
                some.append(rows)
                n += rows.num_rows
                if n >= AT_ONCE:
                    yield lookup, pa.concat_tables(some).combine_chunks()
                    some, n = [], 0
            if some:
                yield lookup, pa.concat_tables(some).combine_chunks()


def matched(rows: pa.Table, lookup: pa.Table | None, key: str, absent: dict[str, pa.DataType] | None = None) -> pa.Table:
    """``rows`` joined with ``lookup`` on ``key``; with ``absent``, the types of its columns, rows without a match stay."""
    if lookup is None and absent is None:
        return rows.slice(0, 0)
    if lookup is None:
        for name, kind in absent.items():
            rows = rows.append_column(name, pa.nulls(rows.num_rows, kind))
        return rows
    left = pa.table({"k": rows.column(key), "i": np.arange(rows.num_rows)})
    right = pa.table({"k": lookup.column(key), "j": np.arange(lookup.num_rows)})
    pairs = left.join(right, "k", join_type="inner" if absent is None else "left outer", use_threads=False)
    found = rows.take(pairs.column("i"))
    for name in lookup.column_names:
        if name != key:
            found = found.append_column(name, lookup.column(name).take(pairs.column("j")))
    return found


def packed(rows: DataFrame, kind: int) -> DataFrame:
    """Parcels of ``rows``, which have their slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed((pa.Table.from_batches([b]) for b in batches), kind, SLOT)

    return rows.mapInArrow(run, PARCELS)


def _met(parcels: DataFrame, slots: int, run: Callable, schema: T.StructType | str) -> DataFrame:
    return parcels.repartitionById(slots, F.col(SLOT)).sortWithinPartitions(SLOT, "_kind").mapInArrow(run, schema)


def met(rows: DataFrame, lookup: DataFrame, slots: int, key: str, absent: dict[str, pa.DataType] | None, kind: int) -> DataFrame:
    """Parcels of ``rows`` and of their ``lookup`` joined and packed for the next join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed((matched(some, found, key, absent) for found, some in _slots(batches)), kind, NEXT)

    return _met(rows.unionByName(lookup), slots, run, PARCELS)


def met_rows(rows: DataFrame, lookup: DataFrame, slots: int, key: str, schema: T.StructType) -> DataFrame:
    """Parcels of ``rows`` and of their ``lookup`` joined, as rows near others with a like key."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, some in _slots(batches):
            if found is not None:
                yield from matched(some, found, key).select(names).sort_by(key).combine_chunks().to_batches(10_000)

    return _met(rows.unionByName(lookup), slots, run, schema)


@dataclass
class Slots:
    """How many slots there are, the slot of a row, and the slots of a row of the lookup as an array."""

    n: int
    one: Column
    every: Column


def slots_by(rows: DataFrame, n: int, key: str, tie: str, others: int = 0, per_slot: int | None = None) -> Slots:
    """Slots for the ``n`` rows of a key; rows without a key and those of a hot one are dealt out by ``tie``.

    Which keys are hot is estimated from some two million rows; where a row goes changes no result.
    """
    per_slot, share = per_slot or PER_SLOT, min(1.0, LOOKED_AT / max(n, 1))
    hashed = F.pmod(F.xxhash64(key), F.lit(RANGES)).cast("int")
    seen = rows if share == 1 else rows.sample(share, 1)
    loads = seen.where(F.col(key).isNotNull()).groupBy(hashed.alias("at")).count().toArrow()
    at, load = loads.column("at").to_numpy(), loads.column("count").to_numpy() / share
    slots = int(min(RANGES, max(1, -(-max(n, others) // per_slot))))
    shares = (np.bincount(at % slots, load, slots) // per_slot).astype(int) if len(at) else np.zeros(slots, int)
    slot, spread = hashed % slots, F.xxhash64(tie)
    every, most = F.array(slot), slots
    if hot := [int(h) for h in np.flatnonzero(shares > 2)] if slots > 1 else []:
        shared = []
        for h in hot:
            shared += [F.lit(h), F.array(*[F.lit(x) for x in (h, *range(most, most + int(shares[h]) - 1))])]
            most += int(shares[h]) - 1
        every = F.coalesce(F.element_at(F.create_map(*shared), slot), every)
        slot = F.element_at(every, (F.pmod(spread, F.size(every)) + 1).cast("int"))
    one = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(slots)).cast("int")).otherwise(slot)
    return Slots(most, one, every)
