"""Best-fit decreasing packing of tokenised documents, the open windows found in a segment tree over their rooms.

Encoding is one pass. Plain text is split here and a worker asks the tokenizer's model only for pieces it does not remember. Other
text falls apart before every white space that follows another character, where no token of a byte-level vocabulary with this
split reaches across; its parts that are not plain go through the whole tokenizer.
Overlong documents are cut into full windows at once: these are final rows. What is left of a document, always shorter than a
window, goes on with its ids (two bytes each where the vocabulary allows).

The rests are dealt into cells of some ``CELL_PIECES`` by a hash, so a cell's memory is bounded by pieces times window. In a
cell they are taken by falling length, each into the open window with the least room that still takes it; a segment tree
indexed by room answers that in log(window) steps. Then the cell is closed: while two windows would be padded, the emptiest
gives its shortest pieces to the fullest, the last of them cut to fit, and the one window left is parted at powers of two,
which need no padding. ``close=False`` leaves all rests whole.

Defined results: NULL text is empty and holds the end id alone; repeated rows are packed one by one; equal lengths are taken in
order of id (NULL last) and ids; strings of special tokens in a text are special tokens, as the library's plain call has it; a
text of any length is encoded whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_rows, materialize
from .packing import _byte_letters

CAPACITY = 2048
CELL_PIECES = 8192
MEMO_ENTRIES = 800_000
MEMO_CHARACTERS = 48
END_ID = 1
ROWS_PER_BATCH = 512

# The characters with Unicode's White_Space property; letters and the split of byte-level vocabularies for text of
# printable ASCII, the usual white space and Latin-1 letters.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"

_PARTS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall
_PIECES = re.compile(SPLIT).findall
_PLAIN = re.compile(r"[\t\n\r -~\xc0-\xff]*").fullmatch

OUTPUT_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("ids", pa.binary()), ("salt", pa.int64()),
])
_ENCODED_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, ids binary, salt bigint"
_PACKED = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class PieceIds(dict):
    """Piece of plain text (one match of ``SPLIT``) -> its ids as little-endian 32-bit bytes; bounded, dropping it changes only speed."""

    def __init__(self, tokenizer) -> None:
        self.model, self.letters = tokenizer.model, dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        name = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = array("I", [t.id for t in self.model.tokenize(name.translate(self.letters))]).tobytes()
        if len(piece) <= MEMO_CHARACTERS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class PartIds(dict):
    """Part of any text (white space, then other characters) -> its ids, for texts that are not plain."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.pieces = PieceIds(self.tokenizer)
        steps = json.loads(definition)
        before, added = steps.get("pre_tokenizer") or {}, steps.get("added_tokens", [])
        odd = [t for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{WHITE_SPACE}]", t["content"])]
        self.separable = not steps.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not odd
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)).search if added else lambda _: None
        self.small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16

    def encode(self, text: str) -> bytes:
        if not self.separable:
            return self[text]
        if _PLAIN(text) and not self.special(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES(text)))
        return b"".join(map(self.__getitem__, _PARTS(text)))

    def __missing__(self, part: str) -> bytes:
        if self.separable and _PLAIN(part) and not self.special(part):
            return b"".join(map(self.pieces.__getitem__, _PIECES(part)))
        ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(part) <= MEMO_CHARACTERS:
            if len(self) >= MEMO_ENTRIES // 4:
                self.clear()
            self[part] = ids
        return ids


_PART_IDS: dict[int, PartIds] = {}


def _ids_of(definition: str) -> PartIds:
    name = zlib.crc32(definition.encode())
    if name not in _PART_IDS:
        _PART_IDS.clear()
        _PART_IDS[name] = PartIds(definition)
    return _PART_IDS[name]


def encode_rests(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per full window, with its sequence, and one per rest, with its ids in place of a sequence."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scorewell.llm import tight_packing

        parts = tight_packing._ids_of(shared.value)
        width = "<u2" if parts.small and end_id < 1 << 16 else "<u4"
        end, task, rows = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[list] = [[] for _ in _ENCODED]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = parts.encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece, length = ids[4 * start : 4 * (start + capacity)], min(capacity, n - start)
                    if length == capacity:  # a window of its own, numbered below zero by task and row
                        row = (doc_id, start, length, zlib.crc32(piece), n, -1 - (task << 38) - rows, None, rows)
                    else:
                        row = (doc_id, start, length, None, n, None, np.frombuffer(piece, "<u4").astype(width).tobytes(), rows)
                    rows += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ENCODED.types, strict=True)], schema=_ENCODED)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, _ENCODED_DDL)


class Rooms:
    """Segment tree over the rooms 0 .. capacity: how many open windows have a room in a node's range."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room of at least ``size``; it is no longer open."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up, until something lies to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down to its leftmost leaf in use
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers; ``lengths`` fall, each item goes into the tightest open window."""
    windows: list[list[int]] = []
    rooms = Rooms(capacity)
    for item, size in enumerate(lengths):
        found = rooms.take(size)
        if found is None:
            found = capacity, len(windows)
            windows.append([])
        room, window = found
        windows[window].append(item)
        if room > size:
            rooms.add(room - size, window)
    return windows


def _unpadded(length: int, capacity: int) -> bool:
    return length == capacity or length & (length - 1) == 0


def close_windows(windows: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The same spans (item, from, to) in windows without padding: some are cut, at most one for each window filled up."""
    windows = [list(w) for w in windows]
    fill = [sum(b - a for _, a, b in w) for w in windows]
    loose = sorted((k for k in range(len(windows)) if not _unpadded(fill[k], capacity)), key=lambda k: (fill[k], k))
    low, high = 0, len(loose) - 1
    while low < high:
        giver, taker = loose[low], loose[high]
        item, a, b = windows[giver].pop()
        moved = min(capacity - fill[taker], b - a)
        windows[taker].append((item, a, a + moved))
        if moved < b - a:
            windows[giver].append((item, a + moved, b))
        fill[giver] -= moved
        fill[taker] += moved
        low += not fill[giver]
        high -= fill[taker] == capacity
    if low == high and not _unpadded(left := fill[loose[low]], capacity):
        spans, windows[loose[low]] = windows[loose[low]][::-1], []
        for bit in reversed(range(left.bit_length())):
            room = left & 1 << bit
            window: list[tuple[int, int, int]] = []
            while room:
                item, a, b = spans.pop()
                taken = min(room, b - a)
                window.append((item, a, a + taken))
                if taken < b - a:
                    spans.append((item, a + taken, b))
                room -= taken
            windows.append(window)
    return [w for w in windows if w]


def _pack_cell(capacity: int, close: bool):
    def pack(cell: pa.Table) -> pa.Table:
        doc_id, start, length, tokens = (cell[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens"))
        blobs = cell["ids"].to_pylist()
        order = sorted(range(cell.num_rows), key=lambda i: (-length[i], doc_id[i] is None, doc_id[i] or 0, start[i], blobs[i]))
        ids = [np.frombuffer(blobs[i], f"<u{len(blobs[i]) // length[i]}") for i in order]
        spans = [[(i, 0, length[order[i]]) for i in w] for w in best_fit_decreasing([length[i] for i in order], capacity)]
        first = cell["cell"][0].as_py() << 32
        out: list[list] = [[] for _ in _PACKED]
        for number, window in enumerate(close_windows(spans, capacity) if close else spans):
            at = 0
            for i, a, b in window:
                row, crc = order[i], zlib.crc32(ids[i][a:b].astype("<u4").tobytes())
                for column, value in zip(out, (doc_id[row], start[row] + a, b - a, crc, tokens[row], first + number, at), strict=True):
                    column.append(value)
                at += b - a
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=_PACKED)

    return pack


def pack_rests(rests: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES, close: bool = True) -> DataFrame:
    """Places of the rests; the number of cells follows the number of rests."""
    cells = max(1, -(-rests.count() // cell_pieces))
    dealt = rests.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "length", "salt"), F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(_pack_cell(capacity, close), OUTPUT_DDL)


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID, close: bool = True, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces of all documents."""
    with arrow_rows(docs.sparkSession, ROWS_PER_BATCH):
        encoded = materialize(encode_rests(docs, definition, capacity, end_id), "rests")
    whole = encoded.where(F.col("ids").isNull()).select(*[F.lit(0).cast("bigint").alias("offset") if c == "offset" else c for c in _PACKED.names])
    return whole.unionByName(pack_rests(encoded.where(F.col("ids").isNotNull()), capacity, cell_pieces, close))
