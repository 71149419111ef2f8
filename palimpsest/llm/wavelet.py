"""Token ids in wavelet-matrix shards.

Documents are encoded in ascending order of doc_id, each followed by an end id. A shard
holds whole documents, about ``shard_tokens`` ids, as a wavelet matrix: one bit plane per
bit of the largest id, most significant first, each plane the bits of the sequence after
it has been stably parted by the bits before. Rank counts in front of every 512th bit make
access, counting and occurrence lookup a few steps per plane, from one compressed file.

File format: each shard is a row of a Parquet table, so any store that Spark writes to
serves, with its commit protocol against lost executors. Its payload is

    magic "WMX2" | uint32 header length | header (JSON: ids, bits, documents, lengths of
    the parts) | zstd(doc ids int64, token counts int64) | zstd(rank directory: set bits of
    every 512, uint16, plane by plane) | the planes in pieces of 32 KiB, each a zstd frame

so access, count and select inflate the directory and the pieces that they touch. Shards
carry their order, their first and last doc id and their number of ids, so that a shard is
found without reading others.

Defined results: a null or empty text has the end id alone; rows that repeat a doc_id
follow one another, by the first 64 characters of the text and then by its hash; rows
without id come first; an empty table gives no shard; other columns, whatever their names,
are not read. A text of any length is encoded whole; its pieces take some 60 bytes each
while it is.

Scale: one shuffle of the texts, by ranges of doc_id, the beginning and hash of the text and
the row's place in its file, so that rows that repeat or lack an id are spread as well, into
``partitions`` (the session's shuffle partitions unless given), each written shard by shard;
no text is cut. ``start``
comes from two-level prefix sums over the shards' counts, and is joined by broadcast only
while the shards are fewer than ``MANY_SHARDS``, else by shuffle.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, pick, prefix_sums, stash, trim

MANY_SHARDS = 500_000
BATCH_BYTES = 4_000_000
#: Bytes of a plane that are compressed together.
PIECE = 32_768
SHARDS = "part long, seq long, first_id long, last_id long, n_docs long, n_ids long, payload binary"


# --- the succinct sequence ---------------------------------------------------------------
class WaveletMatrix:
    """Planes of a sequence of non-negative integers, with rank and select."""

    STEP = 512  # bits between two counts of the rank directory

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray] | None = None) -> None:
        """planes: the packed bits, most significant plane first; ones: set bits of each STEP of a plane."""
        self.n, self.planes, self.bits = n, planes, len(planes)
        ones = [count_ones(p) for p in planes] if ones is None else ones
        self.counts = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in ones]
        self.zeros = [n - int(c[-1]) for c in self.counts]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        return cls(len(ids), part_planes(ids, bits))

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        """Bytes of a plane; all reading goes through here."""
        return self.planes[level][lo:hi]

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // self.STEP
        own = self._bytes(level, block * self.STEP // 8, i // 8 + 1)
        whole = (i - block * self.STEP) // 8
        total = int(self.counts[level][block]) + int(np.bitwise_count(own[:whole]).sum())
        return total + ((int(own[whole]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self._bytes(level, i // 8, i // 8 + 1)[0] >> (i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out * 2 + bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, stop)
            if value >> (self.bits - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands in [start, stop)."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def ranks(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often an id stands before each of many positions."""
        at = np.append(0, at)
        if value >> self.bits:
            return np.zeros(len(at) - 1, np.int64)
        words = self.STEP // 64
        for level in range(self.bits):
            plane = self._bytes(level, 0, (self.n + 7) // 8)
            plane = np.append(plane, np.zeros(-len(plane) % 64 + 64, np.uint8)).view("<u8").reshape(-1, words)
            block = at // self.STEP
            within = at % self.STEP
            kept = np.clip(within[:, None] - 64 * np.arange(words), 0, 64)  # bits of each word before the position
            mask = np.where(kept == 64, ~np.uint64(0), (np.uint64(1) << (kept % 64).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][block] + np.bitwise_count(plane[block] & mask).sum(axis=1, dtype=np.int64)
            at = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else at - ones
        return at[1:] - at[0]

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit of a plane."""
        counts = self.counts[level]
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * self.STEP, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        lo = block * self.STEP // 8
        own = np.unpackbits(self._bytes(level, lo, lo + self.STEP // 8), bitorder="little")
        return block * self.STEP + int(np.flatnonzero(own == bit)[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        """All positions of an id."""
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        return join_planes([self._bytes(k, 0, (self.n + 7) // 8) for k in range(self.bits)], self.n)


def count_ones(plane: np.ndarray) -> np.ndarray:
    """The set bits of each STEP of a plane: its rank directory."""
    width = WaveletMatrix.STEP // 8
    return np.bitwise_count(np.pad(plane, (0, -len(plane) % width))).reshape(-1, width).sum(axis=1, dtype=np.uint16)


def _mask(plane: np.ndarray, n: int) -> pa.BooleanArray:
    """A plane as the bit mask that it is."""
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(plane)])


def part_planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Packed bit planes, most significant first, each after stable parting by those before.

    A byte's lowest bit comes first, as in Arrow's masks, which do the parting.
    """
    kind = np.uint16 if bits <= 16 else np.uint32
    seq = pa.array(ids.astype(kind))
    planes = []
    for level in range(bits - 1, -1, -1):
        plane = np.packbits((seq.to_numpy() & kind(1 << level)) != 0, bitorder="little")
        planes.append(plane)
        if level and len(seq):
            seq = pa.concat_arrays([seq.filter(_mask(~plane, len(seq))), seq.filter(_mask(plane, len(seq)))])
    return planes


def join_planes(planes: list[np.ndarray], n: int) -> np.ndarray:
    """The sequence whose planes these are, from the last plane up."""
    kind = np.uint16 if len(planes) <= 16 else np.uint32
    seq = np.zeros(n, dtype=kind)
    for level, plane in enumerate(reversed(planes)):
        bit = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        ones, none = np.flatnonzero(bit), np.flatnonzero(~bit)
        seq[len(none) :] |= kind(1 << level)
        above = np.empty(n, dtype=kind)
        above[none], above[ones] = seq[: len(none)], seq[len(none) :]
        seq = above
    return seq


# --- the file ------------------------------------------------------------------------------
def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The payload of one shard."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = part_planes(ids, bits)
    index = squeeze(np.concatenate([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
    ranks = squeeze(np.concatenate([count_ones(p) for p in planes]).astype("<u2").tobytes())
    pieces = [[squeeze(p[at : at + PIECE].tobytes()) for at in range(0, len(p), PIECE)] for p in planes]
    head = json.dumps({"ids": len(ids), "bits": bits, "docs": len(lengths), "index": len(index), "ranks": len(ranks), "pieces": [[len(x) for x in row] for row in pieces]}).encode()
    return b"".join([b"WMX2", struct.pack("<I", len(head)), head, index, ranks, *[x for row in pieces for x in row]])


class Shard(WaveletMatrix):
    """The sequence of a payload. A piece of a plane is inflated when it is first read."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != b"WMX2":
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", payload[4:8])
        head, at = json.loads(payload[8 : 8 + size]), 8 + size
        self._inflate = zstandard.ZstdDecompressor().decompress
        index = np.frombuffer(self._inflate(payload[at : at + head["index"]]), "<i8")
        self.doc_ids, self.lengths = index[: head["docs"]], index[head["docs"] :]
        at += head["index"]
        ranks = np.frombuffer(self._inflate(payload[at : at + head["ranks"]]), "<u2").reshape(head["bits"], -1)
        self._payload, self._places, at = payload, [], at + head["ranks"]
        for row in head["pieces"]:
            stops = at + np.cumsum([0, *row])
            self._places.append(stops.tolist())
            at = int(stops[-1])
        self._open: dict[tuple[int, int], np.ndarray] = {}
        super().__init__(head["ids"], [None] * head["bits"], list(ranks))

    def _piece(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            start, stop = self._places[level][k : k + 2]
            self._open[level, k] = np.frombuffer(self._inflate(self._payload[start:stop]), np.uint8)
        return self._open[level, k]

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        last = min(hi, (self.n + 7) // 8)
        parts = [self._piece(level, k)[max(0, lo - k * PIECE) : last - k * PIECE] for k in range(lo // PIECE, -(-last // PIECE))]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.uint8)])


def load(payload: bytes) -> Shard:
    """The sequence of a shard, for access, count and select."""
    return Shard(payload)


# --- encoding ------------------------------------------------------------------------------
@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A run of letters of the first 256 code points, then signs other than the apostrophe.
_LETTERS_SIGNS = r"^(?P<run>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<sign>[\x00-&(-/:-@\[-`{-\x7f]*)$"
#: The bytes of a word that belong to a text of so many.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _keys(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes and their number in two words; beyond 15 bytes, 120 bits of its digest."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start, size = ends[:-1] - ends[0], np.diff(ends)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    low = words[start] & _FIRST_BYTES[np.minimum(size, 8)]
    high = words[start + 8] & _FIRST_BYTES[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 15)
    if len(long):
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts.take(pa.array(long)).to_pylist())), "<u8").reshape(-1, 2)
        low[long], high[long] = digests[:, 0], digests[:, 1] | np.uint64(255 << 56)
    return low, high


def _roomy(a: np.ndarray, used: int, n: int) -> np.ndarray:
    """The array, or a longer one that starts with what of it is used, with room for ``n``."""
    return a if n <= len(a) else np.concatenate([a[:used], np.empty(max(n, 2 * len(a)) - used, a.dtype)])


class _Known:
    """Id sequences of texts, in a hash table of arrays: some 45 bytes an entry. The empty text has no ids.

    Beyond ``most`` entries, or ``most_bytes`` of ids, the memory is emptied. ``learn`` makes
    a list of bytes of a list of texts; with ``columns``, an Arrow array of one.
    """

    def __init__(self, learn: Callable, most: int, most_bytes: int = 64_000_000, columns: bool = False) -> None:
        self.learn, self.most, self.most_bytes, self.columns = learn, most, most_bytes, columns
        self.clear()

    def clear(self) -> None:
        self.size, self.slots = 0, np.full(4096, -1, np.int32)
        self.low, self.high = np.empty(1024, np.uint64), np.empty(1024, np.uint64)
        self.stops, self.raw = np.zeros(1025, np.int64), np.empty(8192, np.uint8)
        self._add(np.zeros(1, np.uint64), np.zeros(1, np.uint64), pa.array([b""], pa.large_binary()))

    def __len__(self) -> int:
        return self.size

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ mix64(high)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        out, left, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._home(low, high)
        while len(left):
            entry = self.slots[slot]
            same = (entry >= 0) & (self.low[entry] == low[left]) & (self.high[entry] == high[left])
            out[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, found: pa.Array) -> np.ndarray:
        """The entries of new keys."""
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
        old, n, used = self.size, self.size + len(low), int(self.stops[self.size])
        self.low, self.high, self.stops = _roomy(self.low, old, n), _roomy(self.high, old, n), _roomy(self.stops, old + 1, n + 1)
        self.low[old:n], self.high[old:n] = low, high
        self.stops[old + 1 : n + 1] = used + ends[1:] - ends[0]
        self.raw = _roomy(self.raw, used, int(self.stops[n]))
        self.raw[used : self.stops[n]] = np.frombuffer(found.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.size, left = n, np.arange(old, n)
        if 2 * n > len(self.slots):
            self.slots, left = np.full(1 << (4 * n).bit_length() - 1, -1, np.int32), np.arange(n)
        slot = self._home(self.low[left], self.high[left])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of those that meet in a slot one stays
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + 1) & (len(self.slots) - 1)
        return np.arange(old, n)

    def of(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of distinct texts, as bytes; those not met before are learnt."""
        if self.size > self.most or self.stops[self.size] > self.most_bytes:
            self.clear()
        low, high = _keys(texts)
        at = self._find(low, high)
        new = np.flatnonzero(at < 0)
        if len(new):
            some = texts.take(pa.array(new))
            found = self.learn(some) if self.columns else pa.array(self.learn(some.to_pylist()), pa.large_binary())
            at[new] = self._add(low[new], high[new], found)
        known = [None, pa.py_buffer(self.stops[: self.size + 1]), pa.py_buffer(self.raw[: self.stops[self.size]])]
        return pa.Array.from_buffers(pa.large_binary(), self.size, known).take(pa.array(at))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The same, of and as a list."""
        return self.of(pa.array(texts, pa.string())).to_pylist()


class Encoder:
    """Encodes whole texts piece by piece, remembering the ids of pieces.

    Three facts about this kind of tokenizer (lower-casing, white space dropped, a suffix at
    the end of each word) make a text's ids those of its pieces in turn: no word crosses a
    space or a line feed; none crosses from a letter to a sign but for the apostrophe; and
    letters of the first 256 code points have one-letter lower-case forms that normalise to
    themselves. New letter runs are encoded together, between spaces, and told apart by
    the word-end ids; signs and every other piece are encoded by themselves. About ``most``
    pieces and as many letter runs are remembered.
    """

    def __init__(self, path: str, end_id: int, most: int = 1_500_000) -> None:
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(max(vocabulary.values()), end_id).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.word_end = np.zeros(1 << self.bits, bool)
        self.word_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.end = pa.array([self._bytes([end_id])], pa.large_binary())
        self.pieces, self.runs, self.signs = _Known(self._pieces, most, columns=True), _Known(self._runs, most), _Known(self._alone, most // 10)

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(found.ids) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(runs), 1000):
            some = runs[at : at + 1000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some):  # no word-end ids: one by one
                out += self._alone(some)
                continue
            raw, stops = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        split = pc.extract_regex(pieces, _LETTERS_SIGNS)
        run = pc.utf8_lower(pc.fill_null(pc.struct_field(split, "run"), "")).dictionary_encode()
        sign = pc.coalesce(pc.struct_field(split, "sign"), pieces).dictionary_encode()
        ids = [known.of(part.dictionary).take(part.indices) for known, part in ((self.runs, run), (self.signs, sign))]
        return pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id after it, and how many each has."""
        # Arrow splits and numbers the pieces; only distinct ones are looked up here
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        found = pa.concat_arrays([self.pieces.of(coded.dictionary), self.end])
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        which = np.insert(coded.indices.to_numpy(), ends, len(found) - 1)  # the end id after each text
        flat = found.take(pa.array(which))
        ids = np.frombuffer(flat.buffers()[2], self.kind) if len(which) else np.empty(0, self.kind)
        upto = np.frombuffer(flat.buffers()[1], np.int64)[1 : len(which) + 1] // self.kind.itemsize
        text_ends = upto[ends + np.arange(len(ends))] if len(ends) else ends
        return ids, np.diff(text_ends, prepend=0)


_encoders: dict[tuple, Encoder] = {}


def encode_shards(
    documents: DataFrame,
    tokenizer_path: str,
    doc_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    shard_tokens: int = 2_000_000,
    partitions: int | None = None,
) -> DataFrame:
    """Shards of all documents in ascending doc_id; ``part`` and ``seq`` give their order."""
    docs = pick(documents, [(doc_col, "doc_id"), (text_col, "text")])
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "lead", "hash", "place"]
    docs = docs.select("doc_id", "text", F.substring("text", 1, 64).alias("lead"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    docs = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_path, end_id) not in _encoders:
            _encoders[tokenizer_path, end_id] = Encoder(tokenizer_path, end_id)
        encoder = _encoders[tokenizer_path, end_id]
        trim()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seq = part = 0

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            who, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held, seq = [], seq + 1
            row = [[part], [seq - 1], [int(who[0])], [int(who[-1])], [len(who)], [len(ids)], [write_shard(who, lengths, ids, encoder.bits)]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row[:6]] + [pa.array(row[6], pa.binary())], names=[f.split()[0] for f in SHARDS.split(", ")])

        for b in batches:
            # the more text at once, the fewer distinct pieces are met again
            step = max(1, int(b.num_rows * BATCH_BYTES / max(b.nbytes, BATCH_BYTES)))
            for at in range(0, b.num_rows, step):
                some = b.slice(at, step)
                part = some.column(2)[0].as_py()
                ids, lengths = encoder.encode(some.column(1))
                # a null id is written as the least integer: such rows come first
                who = some.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                first = 0
                ends = np.cumsum(lengths)
                room = shard_tokens - sum(len(x[2]) for x in held)
                for k in range(len(who)):
                    start = int(ends[first] - lengths[first])
                    if int(ends[k]) - start > room and (k > first or held):
                        if k > first:
                            held.append((who[first:k], lengths[first:k], ids[start : int(ends[k - 1])]))
                        yield close()
                        first, room = k, shard_tokens
                start = int(ends[first] - lengths[first])
                held.append((who[first:], lengths[first:], ids[start:]))
        if held:
            yield close()
        trim()

    return docs.mapInArrow(run, SHARDS)


def write_shards(shards: DataFrame, path: str) -> None:
    """The shards as files of one folder."""
    shards.write.option("compression", "uncompressed").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq and ``start``: the ids in all shards before."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = prefix_sums(parts, "part", "n", "base").select(F.col("part").alias("p"), "base")
    own = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("before"))
    return rows.join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("base") + F.col("before")).alias("start"))


def decode_shards(shards: DataFrame, end_id: int = 1) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32, and how often the end id is in it."""
    starts = shard_starts(shards.select("part", "seq", "n_ids"))
    if shards.select("part").count() < MANY_SHARDS:  # then payloads stay where they are
        starts = F.broadcast(starts)
    rows = shards.select("part", "seq", "payload").join(starts, ["part", "seq"]).select("start", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                who, lengths = shard.doc_ids, shard.lengths
                ids = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                null = who == np.iinfo(np.int64).min
                n_end = np.diff(shard.ranks(end_id, ends), prepend=0)  # from the planes and the rank directory
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.int64(), mask=null), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(n_end, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "n_end"],
                )
        trim()

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end long")


def token_table(documents: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, **more) -> DataFrame:
    """Write the documents' shards, read the files back and return a row per document."""
    shards = encode_shards(documents, tokenizer_path, end_id=end_id, **more)
    if path is None:
        shards = stash(shards, "tokens")
    else:
        write_shards(shards, path)
        shards = documents.sparkSession.read.schema(SHARDS).parquet(path)
    return decode_shards(shards, end_id)
