"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words stream through the automaton, which gives the longest suffix of what was read that occurs in any item. Once
that length reaches the window (13 words, or a whole shorter item) the words of the window are hit. Spans are cut from the
text; documents with too large a share of hit words go.

The automaton's size is checked: items are dealt into automata of at most ITEM_BYTES of text each, and documents pass
every automaton in turn, their hits being merged. One automaton is the usual case.

Defined results: null and empty texts have no words, so nothing is hit; an item without words has no window; repeated items
and rows count each on their own; an empty benchmark leaves every document clean. Rows keep their own texts whatever their
ids, null ones included. Very long texts and items take time in proportion. Extra columns go through as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, ship

WINDOW = 13
SHARE = 20  # contaminated when SHARE * hit words >= words
ITEM_BYTES = 4 << 20  # of one automaton: some 40 bytes of memory each, a few times that while it is built on the driver

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, cut at every other ASCII character that is no digit or letter."""
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.bases = array("i")
        numbered = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                numbered.append((item, ids))
        self.shortest = min([window, *(len(ids) for _, ids in numbered)])
        for _, ids in numbered:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._mark(numbered)
        self._pack()

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return state

    def _mark(self, numbered: list) -> None:
        """holders: of the states that stand for whole windows, the items with that window; whole: short items that end a state's strings."""
        self.holders: dict[int, set] = {}
        self.whole: dict[int, list] = {}
        for item, ids in numbered:
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= self.window:
                    self.holders.setdefault(self.base(state), set()).add(item)
            if len(ids) < self.window:
                self.whole.setdefault(state, []).append((item, len(ids)))
        self.chain = array("i", [-1]) * len(self.next)  # the nearest suffix, itself included, with short items
        for state in self._by_length():
            self.chain[state] = state if state in self.whole else self.chain[self.link[state]] if state else -1

    def _by_length(self) -> list[int]:
        return sorted(range(len(self.next)), key=self.length.__getitem__)

    def base(self, state: int) -> int:
        """The suffix state that holds the last window of a state's strings; found once for every state."""
        if not self.bases:
            self.bases = array("i", range(len(self.next)))
            for s in self._by_length():
                if self.length[self.link[s]] >= self.window and s:
                    self.bases[s] = self.bases[self.link[s]]
        return self.bases[state]

    def _pack(self) -> None:
        """Nearly all states have one arc: its word and its end go to arrays, the others stay in dictionaries."""
        self.base(0)
        self.word, self.to = (array("i", [-1]) * len(self.next) for _ in range(2))
        self.more: dict[int, dict[int, int]] = {}
        for state, arcs in enumerate(self.next):
            if len(arcs) == 1:
                ((self.word[state], self.to[state]),) = arcs.items()
            elif arcs:
                self.more[state] = arcs
        self.next = []
        self.link, self.length = array("i", self.link), array("i", self.length)

    def match(self, ids: list[int], at: int, hit: np.ndarray, items: set) -> None:
        """Stream the known words from position at on; note hit words and items."""
        state, length, none = 0, 0, {}
        word, to, more, link = self.word, self.to, self.more, self.link
        for i, c in enumerate(ids, at):
            while True:
                then = to[state] if word[state] == c else more.get(state, none).get(c, -1)
                if then >= 0 or not state:
                    break
                state = link[state]
                length = self.length[state]
            if then >= 0:
                state, length = then, length + 1
            if length >= self.window:
                hit[i - self.window + 1 : i + 1] = True
                items |= self.holders.get(self.bases[state], set())
            short = self.chain[state]
            while short > 0:
                for item, n in self.whole[short]:
                    if n <= length:
                        hit[i - n + 1 : i + 1] = True
                        items.add(item)
                short = self.chain[link[short]]

    def scan(self, found: list[bytes], hit: np.ndarray, items: set) -> None:
        ids = np.fromiter(map(self.vocabulary.get, found, itertools.repeat(-1)), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self.match(ids[begin:end].tolist(), begin, hit, items)


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    if not gone:
        return text
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for begin, end in gone:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_MARKS = "doc_id long, xh long, words_ long, begins array<int>, ends array<int>, items array<long>"


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _verdict(n: int, hits: int, share: int) -> bool:
    return hits > 0 and share * hits >= n


def _single(automaton, share: int, rewrite: list[str] | None):
    """Rows of results, or, with rewrite, the table's own rows with spans cut and contaminated rows left out."""

    def run(batches):
        sam = automaton.value
        for batch in batches:
            rows, keep, texts = [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True)):
                text = text.as_py()
                found = words(text)
                hit, items = np.zeros(len(found), bool), set()
                sam.scan(found, hit, items)
                hits = int(hit.sum())
                bad = _verdict(len(found), hits, share)
                if rewrite is None:
                    rows.append((doc, len(found), hits, len(items), _digest(items), bad))
                elif not bad:
                    keep.append(i)
                    texts.append(cut(text, spans(hit)) if hits else text)
            if rewrite is None:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])
            else:
                new = pa.array(texts, pa.binary()).cast(pa.string())
                kept = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([new.cast(f.type) if f.name == "text" else kept.column(f.name) for f in batch.schema], schema=batch.schema)

    return run


def _marks(automaton):
    def run(batches):
        sam = automaton.value
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc, xh, text in zip(batch.column("doc_id").to_pylist(), batch.column("xh").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = words(text.as_py())
                hit, items = np.zeros(len(found), bool), set()
                sam.scan(found, hit, items)
                if items:
                    at = spans(hit)
                    rows.append((doc, xh, len(found), [a for a, _ in at], [b for _, b in at], sorted(items)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _MARKS.split(", ")])

    return run


def _merge(share: int):
    """Rows of docs with the marks that several automata left on them; a column named row goes through as it is."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, begins, ends, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "begins", "ends", "items")), strict=True):
                found = len(words(text.encode() if text is not None else None))
                hit, items = np.zeros(found, bool), {x for part in items or [] for x in part}
                for a, b in zip(itertools.chain(*(begins or [])), itertools.chain(*(ends or [])), strict=True):
                    hit[a:b] = True
                gone = spans(hit)
                hits = int(hit.sum())
                rows.append((doc, found, hits, len(items), _digest(items), _verdict(found, hits, share), cut(text.encode(), gone).decode() if gone else text))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays, names = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*(x.split()[0] for x in _SCHEMA.split(", ")), "text"]
            if "row" in batch.schema.names:
                arrays, names = [*arrays, batch.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def automata(benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES):
    """Broadcast automata, one after the other, each over at most item_bytes of item text (one item at least)."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    part, size = [], 0
    for row in items.toLocalIterator():
        if part and size + len(row["text"]) > item_bytes:
            yield sc.broadcast(Automaton(part, window))
            part, size = [], 0
        part.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    yield sc.broadcast(Automaton(part, window))


def _merged(docs: DataFrame, parts: list, share: int, rest: list[str] | None = None) -> DataFrame:
    """One verdict per row of docs, with its cut text, and with these columns of its own as a struct named row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xh"))
    marks = None
    for part in parts:
        made = rows.mapInArrow(_marks(part), _MARKS)
        marks = made if marks is None else marks.unionByName(made)
    marks = materialize(marks.dropDuplicates(), "marks").groupBy(F.col("doc_id").alias("d"), F.col("xh").alias("x")).agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends"), F.collect_list("items").alias("items"))
    schema, own = StructType.fromDDL(_SCHEMA + ", text string"), []
    if rest is not None:
        schema, own = schema.add("row", StructType([docs.schema[c] for c in rest])), ["row"]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xh"), F.struct(*rest).alias("row"))
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left")
    return joined.select("doc_id", "text", "begins", "ends", "items", *own).mapInArrow(_merge(share), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    ship(docs.sparkSession)
    parts = list(automata(benchmark, window, item_bytes))
    if len(parts) > 1:
        return _merged(docs, parts, share).drop("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_single(parts[0], share, None), _SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs without contaminated rows, and without the hit spans of the others; all columns stay, n_chars follows the text."""
    ship(docs.sparkSession)
    parts = list(automata(benchmark, window, item_bytes))
    if len(parts) > 1:
        rest = [c for c in docs.columns if c != "text"]
        out = _merged(docs, parts, share, rest).where("not contaminated").select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    else:
        out = docs.mapInArrow(_single(parts[0], share, docs.columns), docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
