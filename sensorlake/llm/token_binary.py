"""Token ids in binary segments with Elias-Fano document boundaries.

The file format: Parquet files with one row per segment, so that any store
Spark writes to can hold them. A segment is a run of documents in ascending
order of their key: the ids of all of them one after another in one array of
16-bit (32-bit for larger vocabularies) integers, and the places where documents
begin, Elias-Fano coded: about two bits and the low bits of a place for each
document, with a sample of the set bits as select structure, in place of a table
of 64-bit offsets.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorlake.llm import scratch, words

END_ID = 2
SEGMENT_BYTES = 8 << 20
#: Distinct pieces of words whose ids a task keeps; beyond it starts anew.
KEPT_PIECES = 500_000
#: Set bits between two entries of the select structure.
SAMPLED = 64


class EliasFano:
    """An ascending sequence of non-negative integers, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros((top >> low_bits) + n + 1, dtype=bool)
        high[places] = True
        return cls(n, low_bits, np.packbits(bits.astype(bool).ravel()), np.packbits(high), places[::SAMPLED].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = (int(x) for x in np.frombuffer(data, dtype="<u4", count=4))
        body = np.frombuffer(data, dtype=np.uint8, offset=16)
        return cls(n, low_bits, body[:low], body[low : low + high], np.frombuffer(data, dtype="<u4", offset=16 + low + high))

    def select(self, k: int) -> int:
        """The place of set bit k of the high bits, from the sample before it."""
        at = int(self.samples[k // SAMPLED])
        left = k % SAMPLED
        byte = at // 8
        skipped = at % 8
        while True:
            part = np.unpackbits(self.high[byte : byte + 64])
            part[:skipped] = 0
            ones = np.flatnonzero(part)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left, byte, skipped = left - len(ones), byte + 64, 0

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        first = k * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8])[first % 8 :][: self.low_bits]
        return ((self.select(k) - k) << self.low_bits) | int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        bits = np.unpackbits(self.low, count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.int64)
        low = (bits << np.arange(self.low_bits)).sum(axis=1)
        return ((places - np.arange(self.n)) << self.low_bits) | low


# Words of these characters only are cut and spelled here as the tokenizer file says:
# composed already, each with one small letter, and neither a marker nor a space inside.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^ a-z0-9ß-öø-ÿ]+")


def _spelling() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


def _runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)]


class Encoder:
    """Ids of texts under a tokenizer file, word by word.

    Where the file drops white space before it cuts, as the word files do, the
    ids of a text are those of its words. Each distinct word of a call is cut
    once, and the ids of its pieces are kept for later calls. Any other file
    encodes whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        shape = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        self.by_word = 'pattern=Regex("\\s+"), content=" "' in shape[0] and "behavior=Removed, invert=True" in shape[1]
        self.letters = _spelling()
        self.pieces: dict[str, bytes] = {}

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encodings = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        found = [np.array(e.ids, dtype=self.kind) for e in encodings]
        return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(f) for f in found], dtype=np.int64)

    def _learn(self, distinct: list[str]) -> list[bytes]:
        if len(self.pieces) + len(distinct) > KEPT_PIECES:
            self.pieces.clear()
        for piece in distinct:
            if piece not in self.pieces:
                spelled = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
                ids = [] if piece == " " else [t.id for t in self.tokenizer.model.tokenize(spelled)]
                self.pieces[piece] = array(self.kind().dtype.char, ids).tobytes()
        return [self.pieces[piece] for piece in distinct]

    def _plain(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that match _PLAIN one after another, and how many each has."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(" ", distinct.type))[0].as_py()
        pieces = pa.array(_PIECES.findall(joined.lower()), pa.string()).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._learn(names)
        sizes = np.array([len(k) for k in known], dtype=np.int64) // self.kind().itemsize
        codes = pieces.indices.to_numpy()
        ids = _runs(np.frombuffer(b"".join(known), dtype=self.kind), (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        word_of = np.cumsum(codes == names.index(" ")) if " " in names else np.zeros(len(codes), dtype=np.int64)
        return ids, np.bincount(word_of, weights=sizes[codes], minlength=len(distinct)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and how many each has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            return self._batch(texts)
        cut = pc.ascii_split_whitespace(texts)
        flat, text_of = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        plain = pc.and_not(pc.match_substring_regex(distinct, _PLAIN), pc.match_substring(distinct, "<|"))
        plain = pc.and_(plain, pc.greater(pc.binary_length(distinct), 0))
        ids, sizes = np.zeros(0, self.kind), np.zeros(len(distinct), dtype=np.int64)
        starts = np.zeros(len(distinct), dtype=np.int64)
        for own, ids_of in ((plain, self._plain), (pc.invert(plain), self._batch)):
            part, of_own = ids_of(distinct.filter(own))
            at = np.flatnonzero(own.to_numpy(zero_copy_only=False))
            sizes[at], starts[at] = of_own, len(ids) + np.cumsum(of_own) - of_own
            ids = np.concatenate([ids, part])
        codes = coded.indices.to_numpy()
        counts = np.bincount(text_of, weights=sizes[codes], minlength=len(texts)).astype(np.int64)
        return _runs(ids, starts[codes], sizes[codes]), counts


def write(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all rows in ascending order of key; returns the segments as read back.

    tokenizer: the path of a tokenizer file, present on every machine. A null or
    empty text has the end id alone. A null key comes first; rows of one key
    follow in an order that depends on their texts alone. Other columns are not
    written. An empty table gives no segment.
    """
    held = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    held = held.withColumn("tie", F.xxhash64("text"))
    ranged = held.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, places = words.utf8(batch.column("text"))
            for low, high in words.chunks(places, SEGMENT_BYTES):
                own = batch.slice(low, high - low)
                ids, counts = encoder.encode(own.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, encoder.kind(end_id))
                starts = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([segment], pa.int32()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([ids.itemsize], pa.int32()),
                        pa.array([ids.astype(ids.dtype.newbyteorder("<")).tobytes()], pa.binary()),
                        pa.array([EliasFano.of(starts).to_bytes()], pa.binary()),
                        pa.array([own.column("id").to_pylist()], pa.list_(pa.int64())),
                    ],
                    names=["part", "segment", "n_ids", "width", "ids", "bounds", "keys"],
                )
                segment += 1

    return scratch.save(ranged.mapInArrow(run, "part int, segment int, n_ids long, width int, ids binary, bounds binary, keys array<long>"), path)


def read(segments: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (long).

    start: ids of all documents before it. Totals are summed by part first, so
    the windows run over one row per part, and over the segments of one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("part", "segment", "width", "ids", "bounds", "keys")}
                ids = np.frombuffer(row["ids"].as_py(), dtype=f"<u{row['width'].as_py()}").astype("<u4")
                bounds = EliasFano.from_bytes(row["bounds"].as_py()).all()
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"].as_py()] * n, pa.int32()),
                        pa.array([row["segment"].as_py()] * n, pa.int32()),
                        row["keys"].values,
                        pa.array(bounds[:-1], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    documents = segments.mapInArrow(run, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "segment", (F.col("base") + F.col("inner")).alias("base"))
    whole = documents.join(bases, ["part", "segment"])
    return whole.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
