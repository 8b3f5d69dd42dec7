"""Submissions, state and log of ``stream_unlocks`` as Arrow tables of whole user buckets.

A state access is a round trip between Python and the JVM, and each row of a keyed stream is a Python object there. So a
bucket of users is one key, its rows travel as a few cells of bytes, and its state is one value; all work on them is done
by Arrow and numpy kernels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAMES = ("user_id", "module_id", "instrument_key")
CHUNK_ROWS = 500_000  # of a task's rows, combined before they are dealt out
PACKED_DDL = "bucket int, cell binary"
STATE_DDL = "users binary, pairs binary"
TOLD_DDL = "completions binary, modules binary"
LOG = pa.schema([
    ("kind", pa.string()), ("user_id", pa.string()), ("module_id", pa.string()), ("instrument_key", pa.string()), ("completed_us", pa.int64()),
    ("position", pa.int32()), ("complete", pa.bool_()), ("unlocked", pa.bool_()), ("version", pa.int64()),
])


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(cell)).read_all()


def _coded(column: pa.Array | pa.ChunkedArray) -> pa.DictionaryArray:
    """With the values it has, in order of appearance; NULL is a value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    return column.dictionary_encode(null_encoding="encode")


def _codes(column: pa.DictionaryArray) -> np.ndarray:
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _strings(column: pa.ChunkedArray) -> pa.Array:
    return pa.chunked_array([c.cast(pa.string()) for c in column.chunks], pa.string()).combine_chunks()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, user_id, module_id, instrument_key, completed_us) to a cell per bucket, repeats combined to the earliest."""

    def cells(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys = ["bucket", *NAMES]
        table = table.group_by(keys).aggregate([("completed_us", "min")]).rename_columns({"completed_us_min": "completed_us"})
        table = table.select([*keys, "completed_us"]).take(pc.sort_indices(table["bucket"])).combine_chunks()
        bucket = table["bucket"].to_numpy()
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            part = table.slice(a, b - a)
            out.append(to_bytes(pa.table({
                "user_id": part["user_id"], "module_id": _coded(part["module_id"]), "instrument_key": _coded(part["instrument_key"]), "completed_us": part["completed_us"],
            })))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "cell"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield cells(held)
            held, rows = [], 0
    if held:
        yield cells(held)


class Bucket:
    """What is known of a bucket's users: a version each, and the earliest submission per (user, module, instrument)."""

    def __init__(self, state: tuple[bytes, bytes] | None):
        if state is None:
            self.users, self.version = pa.array([], pa.string()), np.empty(0, np.int64)
            self.user, self.us = np.empty(0, np.int64), np.empty(0, np.int64)
            self.module = self.instrument = _coded(pa.array([], pa.string()))
            return
        users, pairs = from_bytes(state[0]), from_bytes(state[1])
        self.users, self.version = users["user_id"].combine_chunks(), users["version"].to_numpy().copy()
        self.user, self.us = pairs["user"].to_numpy().astype(np.int64), pairs["us"].to_numpy().copy()
        self.module, self.instrument = _coded(pairs["module_id"]), _coded(pairs["instrument_key"])

    def state(self) -> tuple[bytes, bytes]:
        pairs = pa.table({"user": self.user.astype(np.int32), "module_id": _coded(self.module), "instrument_key": _coded(self.instrument), "us": self.us})
        return to_bytes(pa.table({"user_id": self.users, "version": self.version})), to_bytes(pairs)

    def add(self, cells: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
        """Takes submissions in; the users they name, and the (user, module, instrument, time) that are new or earlier than known."""
        tables = [from_bytes(cell) for cell in cells]
        joined = lambda name: pa.concat_arrays([_strings(t[name]) for t in tables])
        us = pa.concat_arrays([t["completed_us"].combine_chunks() for t in tables])
        users = _coded(pa.concat_arrays([self.users, joined("user_id")]))  # the known ones keep their numbers
        came = _codes(users)[len(self.users) :]
        self.users = users.dictionary
        self.version = np.r_[self.version, np.zeros(len(self.users) - len(self.version), np.int64)]
        modules, instruments = joined("module_id"), joined("instrument_key")
        whole = pc.and_(pc.and_(modules.is_valid(), instruments.is_valid()), us.is_valid()).to_numpy(zero_copy_only=False)
        both = lambda known, came: _coded(pa.concat_arrays([known.cast(pa.string()), came]))
        module, instrument = both(self.module, modules), both(self.instrument, instruments)
        pair = _codes(module) * len(instrument.dictionary) + _codes(instrument)
        n_pairs, known = max(1, len(module.dictionary) * len(instrument.dictionary)), len(self.user)
        key, time = came[whole] * n_pairs + pair[known:][whole], us.filter(pa.array(whole)).to_numpy()
        order = np.lexsort((time, key))
        first = order[np.r_[True, key[order][1:] != key[order][:-1]]] if len(order) else order
        key, time, at = key[first], time[first], np.flatnonzero(whole)[first]
        old = self.user * n_pairs + pair[:known]
        by = np.argsort(old)
        place = np.searchsorted(old[by], key)
        met = by[np.minimum(place, known - 1)] if known else np.zeros(len(key), np.int64)
        is_old = old[met] == key if known else np.zeros(len(key), bool)
        new = ~is_old
        new[is_old] = time[is_old] < self.us[met[is_old]]
        self.us[met[is_old & new]] = time[is_old & new]
        more = at[~is_old]
        kept = pa.array(np.r_[np.arange(known), known + more])
        self.user, self.us, self.module, self.instrument = np.r_[self.user, came[more]], np.r_[self.us, time[~is_old]], module.take(kept), instrument.take(kept)
        told = pa.array(at[new])
        return np.unique(came), (came[at[new]], modules.take(told), instruments.take(told), time[new])

    def has(self, users: np.ndarray, module: str, instrument: str) -> np.ndarray:
        """Which of the users have submitted it."""
        number = lambda column, name: pc.index(column.dictionary, name).as_py()  # -1 if it is not there
        found = (_codes(self.module) == number(self.module, module)) & (_codes(self.instrument) == number(self.instrument, instrument))
        done = np.zeros(len(self.users), bool)
        done[self.user[found]] = True
        return done[users]


def merge(state: tuple[bytes, bytes] | None, cells: list[bytes], required: Sequence[tuple[str, Sequence[str]]]) -> tuple[tuple[bytes, bytes], bytes, bytes] | None:
    """(state, completions, modules) after a batch's submissions of a bucket; None when they change nothing.

    Users of whom something is new, and those not told of yet, get the next version, their new completions and all modules.
    """
    bucket = Bucket(state)
    named, (user, module, instrument, us) = bucket.add(cells)
    changed = np.union1d(named[bucket.version[named] == 0], user)
    if not len(changed):
        return None
    bucket.version[changed] += 1
    completions = pa.table({
        "user_id": bucket.users.take(pa.array(user)), "module_id": _coded(module), "instrument_key": _coded(instrument), "completed_us": us, "version": bucket.version[user],
    })
    complete = [np.logical_and.reduce([bucket.has(changed, name, w) for w in wanted]) if len(wanted) else np.zeros(len(changed), bool) for name, wanted in required]
    modules = pa.table({"user_id": bucket.users.take(pa.array(changed)), "version": bucket.version[changed], **{f"complete_{i}": c for i, c in enumerate(complete)}})
    return bucket.state(), to_bytes(completions), to_bytes(modules)


def start(state: tuple[bytes, bytes] | None, cell: bytes) -> tuple[bytes, bytes]:
    """State with earlier submissions taken in, of which nothing is told."""
    bucket = Bucket(state)
    bucket.add([cell])
    return bucket.state()


def unpack(modules: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``LOG`` out of what ``merge`` tells."""

    def rows(n: int, **columns) -> Iterator[pa.RecordBatch]:
        if n:
            table = pa.table({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in LOG})
            yield from table.cast(LOG).combine_chunks().to_batches()

    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for completions, states in zip(batch["completions"], batch["modules"], strict=True):
                t = from_bytes(completions.as_py())
                yield from rows(len(t), kind=pa.repeat("completion", len(t)), **{c: t[c] for c in t.column_names})
                t = from_bytes(states.as_py())
                unlocked = pa.repeat(True, len(t))
                for i, name in enumerate(modules):
                    place = {"module_id": pa.repeat(name, len(t)), "position": pa.repeat(pa.scalar(i + 1, pa.int32()), len(t))}
                    yield from rows(len(t), kind=pa.repeat("module", len(t)), user_id=t["user_id"], complete=t[f"complete_{i}"], unlocked=unlocked, version=t["version"], **place)
                    unlocked = t[f"complete_{i}"]

    return of_cells
