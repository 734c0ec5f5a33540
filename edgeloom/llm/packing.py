"""Harmonic packing of tokenised documents into training sequences.

Each worker packs the documents of its own partition, with no shuffle. A document's ids (with the end id) are cut into full
sequences and a rest. The rest falls into the reciprocal class k with capacity/(k+1) < length <= capacity/k, whose bins
take exactly k pieces. Where k pieces would leave a class's bin too empty, the piece is cut to capacity/(k+1), which fills
the next class exactly, and what is left is classed again. Pieces below capacity/CLASSES share the last class, whose bins
are filled to the brim by cutting at the boundary. At a worker's end the open bins' pieces go through that last class, and
the very last bin is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on their own; doc_id may be null;
an empty table gives no pieces. A text of any length is tokenised in segments, cut only where no token can span the cut.
Pieces of equal length keep their order. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CAPACITY = 2048
CLASSES = 16
FILL = 0.985  # a class's bins must be at least so full, or the piece is cut
END_ID = 1
SEGMENT = 1 << 20  # code points tokenised at once
CACHED_WORDS = 400_000
CACHED_CHARS = 40

#: A blank before another white space or the end: there a cut could part a run of white space.
_RUN = re.compile(r" (?:\s|\Z)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    No token of this byte-level vocabulary reaches across a blank that follows a non-blank, so a text is the sequence of
    its blank-led words, and most words come from a bounded cache. ``tokenizer`` names the vocabulary's JSON file; the
    words that the cache lacks are encoded with the same vocabulary in rank form where it lies beside it, else by the
    JSON file's own library.
    """

    def __init__(self, tokenizer: str):
        import os

        ranks = os.path.splitext(tokenizer)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self._ids = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokenizer)
            own.encode_special_tokens = True
            self._ids = lambda text: own.encode(text, add_special_tokens=False).ids
        self._words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self._ids(text)])

    def _segment(self, text: str) -> bytes:
        if _RUN.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        words = self._words
        found = list(map(words.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = rest[i]
                    x = words.get(word)
                    if x is None:
                        x = self._encode(" " + word)
                        if len(word) <= CACHED_CHARS:
                            if len(words) >= CACHED_WORDS:
                                words.clear()
                            words[word] = x
                    found[i] = x
        return self._encode(first) + b"".join(found)

    def __call__(self, text: str) -> bytes:
        if len(text) <= SEGMENT:
            return self._segment(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + SEGMENT)
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()):
                end += 1
            out.append(self._segment(text[at:end]))
            at = end
        return b"".join(out)


def encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


class Packer:
    """Bins of one worker. A piece is (document number, start, length); a closed sequence is a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, fill: float = FILL):
        self.capacity, self.classes, self.fill = capacity, classes, fill
        self.open: dict[int, list] = {}
        self.stream: list = []
        self.room = capacity

    def add(self, doc, length: int):
        start = 0
        while length - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        while start < length:
            size = length - start
            k = self.capacity // size
            if k >= self.classes:
                yield from self._last(doc, start, size)
                return
            if k * size < self.fill * self.capacity:
                k += 1
                size = self.capacity // k
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, size))
            if len(bin_) == k:
                yield self.open.pop(k)
            start += size

    def _last(self, doc, start: int, size: int):
        while size:
            take = min(size, self.room)
            self.stream.append((doc, start, take))
            self.room -= take
            start, size = start + take, size - take
            if not self.room:
                yield self.stream
                self.stream, self.room = [], self.capacity

    def finish(self):
        for k in sorted(self.open):
            for piece in self.open[k]:
                yield from self._last(*piece)
        self.open = {}
        rest, total = self.stream, self.capacity - self.room
        self.stream, self.room = [], self.capacity
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            out = []
            while size:
                doc, start, length = rest.pop(0)
                take = min(size, length)
                out.append((doc, start, take))
                size -= take
                if take < length:
                    rest.insert(0, (doc, start + take, length - take))
            yield out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(tokenizer: str, capacity: int, with_ids: bool):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names)

    def run(batches):
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer), Packer(capacity)
        end = END_ID.to_bytes(4, "little")
        number, made = TaskContext.get().partitionId() << 40, 0
        bodies: dict = {}  # document number: its id, ids and pieces that are still in open bins
        rows: list = []
        blobs: list = []

        def emit(sequences):
            nonlocal made
            for pieces in sequences:
                at = 0
                for doc, start, length in pieces:
                    entry = bodies[doc]
                    part = entry[1][4 * start : 4 * (start + length)]
                    rows.append((entry[0], start, length, zlib.crc32(part), len(entry[1]) // 4, number + made, at))
                    if with_ids:
                        blobs.append(part)
                    at += length
                    entry[2] -= length
                    if not entry[2]:
                        del bodies[doc]
                made += 1

        def flush():
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
            rows.clear()
            batch = pa.RecordBatch.from_arrays(columns, [*names, *["ids"] * with_ids])
            blobs.clear()
            return batch

        doc = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                bodies[doc] = [doc_id, ids, len(ids) // 4]
                emit(packer.add(doc, len(ids) // 4))
                doc += 1
                if len(rows) >= 50_000:
                    yield flush()
        emit(packer.finish())
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids' bytes if asked.

    sequence_id is unique over all workers (the task's number in the upper bits). A retried task packs the same way again.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(tokenizer, capacity, with_ids), _SCHEMA + ", ids binary" * with_ids)
