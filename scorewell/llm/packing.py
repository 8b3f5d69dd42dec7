"""Best-fit packing of tokenised documents into sequences of a fixed length, improved by swaps.

Encoding is one pass: words repeat, so a worker asks the tokenizer only for words it does not remember, and a document's ids
are the joined bytes of its words' ids. Only documents longer than a sequence are cut, into full pieces and a rest.

Packing works on lengths alone. Pieces are dealt into cells of some ``CELL_PIECES`` by a hash, each cell is packed by
best fit on falling lengths, and then a local search runs over the underfull bins: documents move, or are exchanged one for
one or two for one, whenever that raises the sum of squared fills, until no step of any bin helps or the total allows no
fewer bins. The number of steps has no limit; a cell's size bounds the memory.

Defined results: NULL text is empty and holds the end id alone; repeated rows are packed one by one; equal lengths are
taken in order of id and place; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

CAPACITY = 2048
CELL_PIECES = 16_384
MEMO_ENTRIES = 800_000
END_ID = 0
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_letters() -> list[str]:
    """Byte -> letter of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _split_pattern(definition: str) -> str | None:
    """The split pattern of a definition whose other steps are known: NFC, white space, lower case; split, bytes."""
    steps = json.loads(definition)
    normal = [x["type"] for x in (steps.get("normalizer") or {}).get("normalizers", [])]
    before = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in before] != ["Split", "ByteLevel"] or before[1]["add_prefix_space"]:
        return None
    return before[0]["pattern"].get("Regex") if before[0]["invert"] and before[0]["behavior"] == "Removed" else None


class WordIds(dict):
    """Lower-cased word (bytes) -> its ids as little-endian 32-bit bytes.

    Words of printable ASCII and Latin-1 letters, on which the normalizer only lowers letters, are split here and their parts
    go straight to the tokenizer's model; all other words go through the whole tokenizer. A text that holds the string of a
    special token goes through the library as it is.
    """

    def __init__(self, definition: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        names = [re.escape(t["content"]) for t in json.loads(definition).get("added_tokens", [])]
        self.special = re.compile("|".join(names)).search if names else lambda _: None
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # a word only becomes a special token's string by lower-casing: it is none
        self.model = self.tokenizer.model
        pattern = _split_pattern(definition)
        self.parts_of = regex.compile(pattern).findall if pattern else None
        self.plain = regex.compile("[!-~\u00C0-\u00FF]+").fullmatch
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.special(text):
            found = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()))

    def __missing__(self, word: bytes) -> bytes:
        name = word.decode("utf-8", "replace")
        if self.parts_of is not None and self.plain(name):
            known = self.parts
            ids = b"".join([known.get(x) or self._part(x) for x in self.parts_of(name.lower())])
        else:
            found = self.tokenizer.encode(name, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        name = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        found = [t.id for t in self.model.tokenize(name)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(part) <= 64:
            if len(self.parts) >= MEMO_ENTRIES // 2:
                self.parts.clear()
            self.parts[part] = ids
        return ids


_WORD_IDS: dict[int, WordIds] = {}


def encode_pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, the end id included, cut at ``capacity``."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    name = zlib.crc32(definition.encode())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scorewell.llm import packing

        if name not in packing._WORD_IDS:
            packing._WORD_IDS.clear()
            packing._WORD_IDS[name] = packing.WordIds(shared.value)
        words = packing._WORD_IDS[name]
        end, done = np.array([END_ID], dtype="<u4").tobytes(), 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            salts = pa.array(np.arange(done, done + len(out[0]), dtype=np.int64))  # deals repeated rows apart; stored, so it stays as it is
            done += len(out[0])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, PIECE_SCHEMA.types, strict=True)], salts], names=[*PIECE_SCHEMA.names, "salt"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, PIECE_DDL + ", salt bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items by falling length, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[item]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if left := room - size:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Places:
    """Underfull bins by the lengths they hold and their fill; length 0 stands for "nothing" and is in every one of them.

    ``below[row, x]`` is the largest fill up to ``x`` of a bin that holds the row's length, or -1.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int) -> None:
        self.bins, self.fill, self.lengths, self.capacity = bins, fill, lengths, capacity
        self.sizes = np.array(sorted({0, *lengths}), dtype=np.int64)
        self.row = {n: r for r, n in enumerate(self.sizes.tolist())}
        self.rows = np.arange(len(self.sizes))
        self.below = np.full((len(self.sizes), capacity + 1), -1, np.int32)
        self.holders: dict[tuple[int, int], dict[int, None]] = {}
        for k in range(len(bins)):
            self.add(k)

    def _entries(self, k: int) -> list[tuple[int, int]]:
        level = self.fill[k]
        return [(self.row[n], level) for n in {0, *[self.lengths[i] for i in self.bins[k]]}] if 0 < level < self.capacity else []

    def add(self, k: int) -> None:
        for entry in self._entries(k):
            if entry not in self.holders:
                self.holders[entry] = {}
                tail = self.below[entry[0], entry[1] :]
                np.maximum(tail, entry[1], out=tail)
            self.holders[entry][k] = None

    def remove(self, k: int) -> None:
        for entry in self._entries(k):
            del self.holders[entry][k]
            if not self.holders[entry]:
                del self.holders[entry]
                r, level = entry
                end = level + int(np.searchsorted(self.below[r, level:], level, side="right"))
                self.below[r, level:end] = self.below[r, level - 1]

    def best_step(self, source: int) -> tuple | None:
        """(target, documents out, document back or None) of the step from ``source``, itself removed, with the largest gain."""
        lengths = self.lengths
        mine = sorted(self.bins[source], key=lambda i: (-lengths[i], i))
        groups = {lengths[i]: (i,) for i in reversed(mine)}
        for x in range(len(mine)):
            for y in range(x + 1, len(mine)):
                groups.setdefault(lengths[mine[x]] + lengths[mine[y]], (mine[x], mine[y]))
        total = np.array(list(groups), dtype=np.int64)
        moved = total[:, None] - self.sizes
        allowed = (moved > 0) & (moved < self.capacity)
        level = self.below[self.rows, np.where(allowed, self.capacity - moved, 0)]
        gain = np.where(allowed & (level >= 0), moved * (level - self.fill[source] + moved), 0)
        g, r = divmod(int(gain.argmax()), len(self.sizes))
        if gain[g, r] <= 0:
            return None
        target = next(iter(self.holders[r, int(level[g, r])]))
        back = next((i for i in self.bins[target] if lengths[i] == self.sizes[r]), None) if r else None
        return target, groups[int(total[g])], back


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: moves, 1:1 and 2:1 exchanges between underfull bins that raise the sum of squared fills.

    Each underfull bin, the emptiest first, gives documents by its best step until it has none; rounds over all bins go on
    until one makes no step. The sum grows with every step, so the search ends; it stops early when the total allows no
    fewer bins.
    """
    bins = [list(b) for b in bins if b]
    least = -(-sum(lengths) // capacity)
    alive = len(bins)
    if alive <= least:
        return bins
    fill = [sum(lengths[i] for i in b) for b in bins]
    places = _Places(bins, fill, lengths, capacity)
    moving = True
    while moving and alive > least:
        moving = False
        for source in sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k)):
            if not 0 < fill[source] < capacity:
                continue
            places.remove(source)
            while bins[source] and (step := places.best_step(source)):
                target, out, back = step
                moving = True
                places.remove(target)
                change = [(source, target, i) for i in out] + ([(target, source, back)] if back is not None else [])
                for giver, taker, i in change:
                    bins[giver].remove(i)
                    bins[taker].append(i)
                    fill[giver] -= lengths[i]
                    fill[taker] += lengths[i]
                places.add(target)
            places.add(source)
            alive -= not bins[source]
            if alive <= least:
                break
    return [b for b in bins if b]


def _pack_cell(capacity: int):
    def pack(cell: pa.Table) -> pa.Table:
        columns = [cell[c].to_pylist() for c in PIECE_SCHEMA.names]
        order = sorted(range(cell.num_rows), key=lambda i: (-columns[3][i], columns[0][i] is None, columns[0][i] or 0, columns[1][i], columns[4][i]))
        lengths = [columns[3][i] for i in order]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = cell["cell"][0].as_py() << 32
        for number, items in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in items:
                sequence[order[i]], offset[order[i]] = first + number, at
                at += lengths[i]
        return cell.select(PIECE_SCHEMA.names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the number of cells follows the number of pieces."""
    cells = max(1, -(-pieces.count() // cell_pieces))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(_pack_cell(capacity), PIECE_DDL + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """Encode, store the pieces (five numbers each), pack."""
    return pack_pieces(materialize(encode_pieces(docs, definition, capacity), "pieces"), capacity)
