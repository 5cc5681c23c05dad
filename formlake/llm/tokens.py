"""Token ids of whole texts, written as one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit planes, most significant first;
each plane is sorted stably by the planes above it. Samples of each plane's ones make
rank, and so access, counting and occurrence lookup, short walks over the planes. A
shard is one self-contained file image, its sections compressed with zstd; shards are
written as binary rows by Spark's Parquet writer, so they reach any file system it can.

Documents stand in ascending doc_id order, nulls first; rows that repeat a doc_id follow
the hash of their text. Null and empty texts have the end id alone. A document is never
split over shards; an empty table gives no shards.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formlake.session import scratch

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 20
SAMPLE = 1024
MAGIC = b"WVM1"
KEPT_PIECES = 400_000
SHARD_SCHEMA = "part long, seq long, n_ids long, n_docs long, payload binary"
ROW_SCHEMA = "part long, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"

#: Fixed: how the byte-level vocabulary cuts text of the first 256 characters before merging.
PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
    "|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)


# ---- text to ids --------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """Fixed: the letter that stands for a byte in the vocabulary, where it isn't the byte's own character."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by the tokenizers library; a piece of text that was just encoded is not encoded anew.

    No token spans a blank that stands alone between two other characters, so a text all
    of whose blanks do is the sequence of its blank-led pieces. All other texts, and
    pieces beyond the first 256 characters, go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters, self.merge = _byte_letters(), self.library.model.tokenize
        self.blank = self.letters[32]
        self.recent: dict[str, bytes] = {}  # pieces without their blank
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            spelled = word.replace(" ", self.blank)
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= KEPT_PIECES:
                self.words.clear()
            found = self.words[word] = self._merged(word)
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of text within the first 256 characters."""
        return b"".join([self._word(w) for w in PIECES.findall(text)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a blank and the piece after it; empty if the blank doesn't stand alone."""
        found = self.recent.get(piece) or self.older.get(piece)
        if found is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return b""
            if piece.isascii():
                if piece.isalpha():
                    found = self._merged(" " + piece)
                elif piece[-1] in ".," and piece[:-1].isalpha():
                    found = self._piece(piece[:-1]) + self._word(piece[-1])
                else:
                    found = self._plain(" " + piece)
            else:
                found = self._plain(" " + piece) if max(piece) < "\u0100" else self._whole(" " + piece)
        if len(self.recent) >= KEPT_PIECES:
            self.older, self.recent = self.recent, {}
        self.recent[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and not any(s in text for s in self.special):
            out = list(map(self.recent.get, rest))
            if None in out:
                piece = self._piece
                out = [x or piece(r) for x, r in zip(out, rest)]
            if all(out):
                return (self._plain(first) if max(first) < "\u0100" else self._whole(first)) + b"".join(out)
        return self._whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- wavelet matrix -----------------------------------------------------------------


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """File image of one shard: ids in order, with the documents' ids and lengths."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    sections, zeros = [], []
    for b in range(bits - 1, -1, -1):
        one = (now & (1 << b)) != 0
        plane = np.packbits(one, bitorder="little")
        ones = np.bitwise_count(np.concatenate([plane, np.zeros(-len(plane) % (SAMPLE // 8), np.uint8)])).reshape(-1, SAMPLE // 8)
        samples = np.cumsum(ones.sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        sections += [plane.tobytes(), samples.tobytes()]
        zeros.append(len(now) - (int(samples[-1]) if len(samples) else 0))
        after = np.empty_like(now)
        after[: zeros[-1]], after[zeros[-1] :] = now[~one], now[one]
        now = after
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    sections += [docs.tobytes(), known.tobytes(), np.array(lengths, np.int64).tobytes()]
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(s) for s in sections]
    head = struct.pack("<4sBqq", MAGIC, bits, len(ids), len(doc_ids)) + np.array(zeros, np.int64).tobytes()
    return head + np.array([len(s) for s in packed], np.int64).tobytes() + b"".join(packed)


class Shard:
    """Reads a shard: all ids at once, one id, counts and occurrences, from the planes."""

    def __init__(self, image: bytes):
        magic, bits, self.n_ids, n_docs = struct.unpack_from("<4sBqq", image)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize("<4sBqq")
        self.zeros = np.frombuffer(image, np.int64, bits, at)
        at += 8 * bits
        sizes = np.frombuffer(image, np.int64, 2 * bits + 3, at)
        at += 8 * len(sizes)
        opened, sections = zstandard.ZstdDecompressor(), []
        for n in sizes:
            sections.append(opened.decompress(image[at : at + n]))
            at += int(n)
        self.planes = [np.frombuffer(s, np.uint8) for s in sections[0 : 2 * bits : 2]]
        self.samples = [np.frombuffer(s, np.uint32) for s in sections[1 : 2 * bits : 2]]
        known = np.frombuffer(sections[-2], np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(sections[-3], np.int64), known)]
        self.lengths = np.frombuffer(sections[-1], np.int64)

    def ids(self) -> np.ndarray:
        """All ids: the planes are merged from the last to the first."""
        now = np.zeros(self.n_ids, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n_ids, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[~one] = now[: self.zeros[k]]
            before[one] = now[self.zeros[k] :] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = before
        return now.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, low = i // SAMPLE, i // SAMPLE * SAMPLE
        bits = np.unpackbits(self.planes[k][low // 8 : (i + 7) // 8], count=i - low, bitorder="little")
        return int(bits.sum()) + (int(self.samples[k][block - 1]) if block else 0)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(len(self.planes)):
            one = self._bit(k, i)
            value = value << 1 | one
            i = int(self.zeros[k]) + self._ones(k, i) if one else i - self._ones(k, i)
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            one = token >> (len(self.planes) - 1 - k) & 1
            a, z = self._ones(k, low), self._ones(k, high)
            low, high = (int(self.zeros[k]) + a, int(self.zeros[k]) + z) if one else (low - a, high - z)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id between two positions."""
        a, z = self._range(token, low, self.n_ids if high is None else high)
        return z - a

    def occurrence(self, token: int, nth: int) -> int:
        """Position of the nth occurrence (from 0) of an id: select on the planes, last to first."""
        a, z = self._range(token, 0, self.n_ids)
        if not 0 <= nth < z - a:
            raise IndexError(nth)
        i = a + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            wanted = i - int(self.zeros[k]) if one else i
            i = self._select(k, one, wanted)
        return i

    def _select(self, k: int, one: int, nth: int) -> int:
        ends = self.samples[k] if one else np.minimum(np.arange(1, len(self.samples[k]) + 1) * SAMPLE, self.n_ids) - self.samples[k]
        block = int(np.searchsorted(ends, nth, side="right"))
        low = block * SAMPLE
        bits = np.unpackbits(self.planes[k][low // 8 : (low + SAMPLE) // 8], bitorder="little")[: self.n_ids - low]
        return low + int(np.flatnonzero(bits == one)[nth - (int(ends[block - 1]) if block else 0)])


# ---- jobs ---------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode (doc_id long, text string) and write the shards under `path`. A partition's shards follow
    each other, and partitions follow the order of doc_id."""
    place = public_tokenizers.path(tokenizer)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(place).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32).tobytes()
        held: list[bytes] = []
        doc_ids: list = []

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            image = pack_shard(ids, doc_ids, [len(h) // 4 for h in held])
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_ids": [len(ids)], "n_docs": [len(held)], "payload": [image]},
                pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())]),
            )

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append(encode(text.as_py() or "") + end)
                doc_ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= shard_ids:
                    yield shard()
                    held, doc_ids, size, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload")):
                shard = Shard(image.as_py())
                ids, ends = shard.ids(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(ends), pa.int64()),
                    "seq": pa.array([seq] * len(ends), pa.int64()),
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "start": pa.array(starts),
                    "n_tokens": pa.array(shard.lengths),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(starts, ends)], pa.int64()),
                })

    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("first"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before("part").orderBy("seq")), F.lit(0)).alias("own"))
    offsets = inside.join(firsts, "part").select("part", "seq", (F.col("first") + F.col("own")).alias("first"))
    decoded = files.select("part", "seq", "payload").mapInArrow(rows, ROW_SCHEMA)
    return decoded.join(offsets, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def encoded_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the shards of all documents to the shared folder and return the rows read back from them."""
    path = scratch(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(docs.sparkSession, path)
