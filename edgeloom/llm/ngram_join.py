"""Near duplicates by a grouped prefix join on word shingles (Jaccard similarity 0.8 or more).

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes). Documents with one set form a class; only
   classes go on, so copies never make pairs. The same pass counts shingles in a table of fixed size.
2. Shingles are ordered from rare to frequent by those counts, then by hash. Any fixed order is exact; this one keeps
   passages that many documents share out of the prefixes. Classes with identical prefixes and size form one group, and
   only groups enter the index: (shingle, group, size, position).
3. Short lists give all their pairs of groups with the number of shared prefix shingles. Two sets of the wanted overlap
   share a certain number of them (``_needed``); pairs below it go, the others are expanded to members and verified.
4. Longer lists, and groups of many members as lists of their own, meet in rounds: each list is dealt into blocks anew,
   each class is verified against the three classes of other components that look closest by 1024 parity bits, and
   components are joined. Rounds end when the open pairs are few for the rows left, or a round joined next to nothing.
5. What is left of those lists gives every pair of different components that passes the filters (size, position, parity bits).
   Only rows outside a list's largest component meet the list, so a component of many near copies does not make the
   square of its size. All those pairs are verified.
6. Components of all verified pairs, labelled by the smallest doc_id.

Every pair of different sets with similarity >= 0.8 is either verified or already connected, so components are exact.

Defined results: no words (null, empty, blank text): n_shingles 0, linked with nothing, component_id is doc_id. Fewer than
five words: the whole sequence is one shingle. Rows that share a doc_id and text are repeated rows with equal results. A
null doc_id has the component of its class, null if that class has no id. An empty table gives an empty result. Very long
texts are hashed in segments. Extra columns are ignored whatever their names, and go through ``keep_one`` as they are.
Sets that meet in one 64-bit hash are told apart by a second one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, discard, fresh, materialize, ship, without_redundant, written
from .components import components, stars

WORDS = 5
#: similarity >= 4/5
NUM, DEN = 4, 5
COUNT_BITS = 20  # counters of the frequency table: 8 MiB, whatever the input
SEGMENT = 1 << 18
AT_ONCE = 500  # sets that a task holds before it passes them on
SALTS = 16
SHORT = 16  # groups in a list that gives all its pairs at once
DEALT = 1 << 16  # excess of a counter over the table's noise at which its shingles skip the sorted lists
MOST_PAIRS = 1 << 21  # of one task before they are summed up
NEAREST = 3  # partners that each class is verified against in a round
BLOCK = 256  # rows that meet in a round
SIDE = 4096  # rows outside the largest component that meet one copy of their list
PAIRS_PER_ROW = 4  # open pairs a row that need no further round
PROGRESS = 0.9  # share of the open pairs that a round must get below to be followed by another
BITS = 1024  # parity bits of a set

_U = np.uint64
_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 17)
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, r, np.uint64)))) for r in (_U(_ROOT), _U(_INVERSE))]
    return _tables[0], _tables[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _word_hashes(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they begin."""
    data = np.frombuffer(low, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate(([_U(0)], np.cumsum(_LETTER[data] * up[: len(data)])))
    return _mix((sums[end] - sums[begin]) * down[begin]), begin


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    total = words[: len(words) - width + 1] * _PLACE[0]
    for k in range(1, width):
        total = total + words[k : len(words) - width + 1 + k] * _PLACE[k]
    return _mix(total + _U(width))


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    new = h[1:] != h[:-1]
    return h if new.all() else h[np.concatenate(([True], new))]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8, hashed in segments."""
    low, parts, at = (text or b"").lower(), [np.empty(0, np.uint64)], 0
    with np.errstate(over="ignore"):
        while at < len(low):
            end = min(len(low), at + SEGMENT)
            while end < len(low) and not _BLANK[low[end]]:
                end += 1
            parts.append(_word_hashes(low[at:end])[0])
            at = end
        words = np.concatenate(parts)
        return _distinct(_windows(words, min(len(words), WORDS))) if len(words) else words


def shingle_sets(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """``shingles`` of each text; texts are hashed together up to a segment."""

    def several(lows: list[bytes]) -> Iterator[np.ndarray]:
        if len(lows) == 1:
            yield shingles(lows[0])
            return
        words, begin = _word_hashes(b"\n".join(lows))
        places = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lows])))
        edges = np.searchsorted(begin, places).tolist()
        every = _windows(words, WORDS) if len(words) >= WORDS else words
        for a, b in itertools.pairwise(edges):
            if b - a >= WORDS:
                yield _distinct(every[a : b - WORDS + 1])
            else:
                yield _windows(words[a:b], b - a) if b > a else words[:0]

    waiting, size = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            low = (text or b"").lower()
            if waiting and size + len(low) > SEGMENT:
                yield from several(waiting)
                waiting, size = [], 0
            waiting.append(low)
            size += len(low) + 1
        if waiting:
            yield from several(waiting)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _long(h: bytes) -> int:
    return int.from_bytes(h, "little", signed=True)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return _long(h[:8]), _long(h[8:])


def class_of(s: np.ndarray, clashes: frozenset) -> int:
    """The class of a set: its first hash, or its second where the first stands for several sets."""
    first, second = set_hash(s)
    return second if first in clashes else first


def _batch(rows: list, kinds: list, names: list):
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_L, _I, _B = pa.int64(), pa.int32(), pa.binary()
SLICE = 1 << 14


def parity_bits(s: np.ndarray) -> bytes:
    """How many shingles fall into each of BITS places, modulo 2. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _texts(batch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column("text").cast(_B))


def _classes(batches):
    """A row per document; at the end this task's counters, in slices."""
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    names, kinds = ["doc_id", "xh", "n", "g", "check", "slice", "counts"], [_L, _L, _L, _L, _L, _I, _B]
    for batch in batches:
        rows, found = [], []
        for doc, xh, s in zip(batch.column("doc_id").to_pylist(), batch.column("xh").to_pylist(), shingle_sets(_texts(batch)), strict=True):
            if len(s):
                found.append((s >> _U(64 - COUNT_BITS)).astype(np.uint32))
                rows.append((doc, xh, len(s), *set_hash(s), None, None))
            else:
                rows.append((doc, xh, 0, None, None, None, None))
            if len(found) >= AT_ONCE:
                np.add.at(counts, np.concatenate(found), np.uint32(1))
                found.clear()
        if found:
            np.add.at(counts, np.concatenate(found), np.uint32(1))
        yield _batch(rows, kinds, names)
    yield _batch([(None, None, None, None, None, i, counts[at : at + SLICE].tobytes()) for i, at in enumerate(range(0, len(counts), SLICE)) if counts[at : at + SLICE].any()], kinds, names)


def _sum_counts(batches):
    """Sums of the counters, slice by slice (sorted by slice)."""
    now, total = None, None
    for batch in batches:
        for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(part, np.uint32)
            if i != now:
                if now is not None:
                    yield _batch([(now, total.tobytes())], [_I, _B], ["slice", "counts"])
                now, total = i, np.zeros(len(part), np.uint64)
            total = total + part
    if now is not None:
        yield _batch([(now, total.tobytes())], [_I, _B], ["slice", "counts"])


def prefix(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the order of shingles, and its counters."""
    p, rank = prefix_length(len(s)), counts[(s >> _U(64 - COUNT_BITS)).astype(np.int64)]
    if p < len(s):
        at = np.flatnonzero(rank <= np.partition(rank, p - 1)[p - 1])
        s, rank = s[at], rank[at]
    order = np.argsort(rank, kind="stable")[:p]  # s is sorted
    return s[order], rank[order]


def dealt_from(counts: np.ndarray) -> int:
    """The counter from which on a shingle may stand in more than DEALT sets, beyond what unrelated shingles add."""
    mean = float(counts.mean())
    return int(mean + 6 * mean**0.5) + DEALT


_INDEX = "key long, gp long, place long, extra binary"
_FOUND = "kind int, x long, y long, v long, bits binary"
ENTRY, PAIR, GROUP = 0, 1, 2


def _postings(table, clashes):
    """Index rows of each new group: key is the shingle, place holds size and position. Rows with extra go through the lists
    as they are: the group's members with their parity bits, and entries of shingles in very many sets. A task passes over
    classes it has seen."""

    def run(batches):
        counts, seen, groups = table.value, set(), set()
        limit, names = dealt_from(counts), [x.split()[0] for x in _INDEX.split(", ")]
        for batch in batches:
            single, tokens, owners, places = [], [], [], []
            for s in shingle_sets(_texts(batch)):
                if not len(s) or (g := class_of(s, clashes)) in seen:
                    continue
                seen.add(g)
                n = len(s)
                first, rank = prefix(s, counts)
                gp = set_hash(np.concatenate((first, [_U(n)])))[0]
                single.append((gp, gp, n, g.to_bytes(8, "little", signed=True) + parity_bits(s)))
                if gp in groups:
                    continue
                groups.add(gp)
                place = (n << 32) + np.arange(len(first), dtype=np.int64)
                if rank[-1] >= limit:
                    far = rank >= limit
                    single += [(gp, gp, p, t.tobytes()) for t, p in zip(first[far], place[far].tolist(), strict=True)]
                    first, place = first[~far], place[~far]
                tokens.append(first.view(np.int64))
                owners.append((gp, len(first)))
                places.append(place)
            if tokens:
                repeated = np.repeat(np.array([x[0] for x in owners], np.int64), [x[1] for x in owners])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(repeated), pa.array(np.concatenate(places)), pa.nulls(len(repeated), _B)], names)
            yield _batch(single, [_L, _L, _L, _B], names)

    return run


def _summed(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, v = a[order], b[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(v, first)


def _found(kind: int, x, y, v, bits=None):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x, _L), pa.array(y, _L), pa.array(v, _L), pa.nulls(len(x), _B) if bits is None else pa.array(bits, _B)], [c.split()[0] for c in _FOUND.split(", ")])


def _lists(batches):
    """Index rows sorted by key and group. Lists of two groups or more: the entries of long ones (ENTRY: shingle, group, place),
    all pairs of short ones (PAIR: two groups, the number of shared shingles, and in the upper half how many of them pass
    the filter by position). GROUP: group, class, size, parity bits."""
    carried = [np.empty(0, np.int64)] * 3
    long_key, pairs, waiting = None, [], 0
    for batch, last in _with_last(batches):
        if batch is not None:
            extra = batch.column("extra")
            whole = extra.is_null()
            if (apart := batch.filter(extra.is_valid())).num_rows:
                body = apart.column("extra").to_pylist()
                key, place = apart.column("gp").to_pylist(), apart.column("place").to_pylist()
                hot = [i for i, e in enumerate(body) if len(e) == 8]
                if hot:
                    yield _found(ENTRY, [_long(body[i]) for i in hot], [key[i] for i in hot], [place[i] for i in hot])
                rest = [i for i, e in enumerate(body) if len(e) > 8]
                yield _found(GROUP, [key[i] for i in rest], [_long(body[i][:8]) for i in rest], [place[i] for i in rest], [body[i][8:] for i in rest])
            batch = batch.filter(whole)
            carried = [np.concatenate((c, batch.column(n).to_numpy())) for c, n in zip(carried, ("key", "gp", "place"), strict=True)]
        key, gp, place = carried
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (gp[1:] != gp[:-1])))
            key, gp, place = key[new], gp[new], place[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        done = len(key)
        if not last and len(starts):
            done = starts[-1]
            if key[-1] == long_key or len(key) - done > SHORT:  # the last list is long already; only its last row is kept, to tell repeats
                long_key, done = key[-1], len(key) - 1
        carried = [c[done:] for c in (key, gp, place)]
        key, gp, place = key[:done], gp[:done], place[:done]
        if not len(key):
            if last and pairs:
                yield _found(PAIR, *_summed(*(np.concatenate(c) for c in zip(*pairs, strict=True))))
            continue
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        k = np.repeat(sizes, sizes)
        is_long = (k > SHORT) | (key == long_key if long_key is not None else False)
        if is_long.any():
            yield _found(ENTRY, key[is_long], gp[is_long], place[is_long])
        short = (k > 1) & ~is_long
        key, gp, n, pos = key[short], gp[short], place[short] >> 32, place[short] & 0xFFFFFFFF
        for d in range(1, SHORT):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            n1, n2 = n[i], n[i + d]
            close = DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)
            i, n1, n2 = i[close], n1[close], n2[close]
            fits = (DEN + NUM) * np.minimum(n1 - pos[i], n2 - pos[i + d]) >= NUM * (n1 + n2)
            pairs.append((np.minimum(gp[i], gp[i + d]), np.maximum(gp[i], gp[i + d]), 1 + (fits.astype(np.int64) << 32)))
            waiting += len(i)
        if pairs and (last or waiting > MOST_PAIRS):
            total = _summed(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
            if last or len(total[0]) > MOST_PAIRS // 2:
                yield _found(PAIR, *total)
                pairs, waiting = [], 0
            else:
                pairs, waiting = [total], len(total[0])


def _with_last(batches):
    """Every batch with False, then (None, True)."""
    for batch in batches:
        yield batch, False
    yield None, True


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    union = np.concatenate((left, right))
    union.sort(kind="stable")
    both = int(np.count_nonzero(union[1:] == union[:-1]))
    return 100 * both >= 80 * (len(union) - both)


def _verify(batches):
    for batch in batches:
        keep = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column("left"), batch.column("right"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(clashes):
    def run(batches):
        for batch in batches:
            sets = ((class_of(s, clashes), s.tobytes()) for s in shingle_sets(_texts(batch)) if len(s))
            while some := list(itertools.islice(sets, AT_ONCE)):
                yield _batch(some, [_L, _B], ["g", "body"])

    return run


class _Join:
    """What the steps share: the rows (doc_id, xh, text; so many), the classes with a representative row each, clashing hashes."""

    def __init__(self, rows: DataFrame, many: int, classes: DataFrame, clashes: frozenset):
        self.rows, self.many, self.classes, self.clashes, self.tried, self.n_tried = rows, many, classes, clashes, None, 0

    def verified(self, pairs: DataFrame, most: int) -> DataFrame:
        """Those of the pairs (a, b) of classes, at most so many, that are similar; pairs that were verified before are left out.

        Only texts of representatives that a pair names leave the scan (``among``), and only they are shuffled."""
        spark = pairs.sparkSession
        pairs = materialize(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "candidates", most + self.n_tried)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if not (n := pairs.count()):
            return pairs
        self.n_tried += n
        chosen, sets = fresh(spark, "representatives"), fresh(spark, "sets")
        wanted = pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g"))).distinct()
        named = written(wanted.join(self.classes, "g").select(F.col("rep").alias("doc_id"), F.col("rep_xh").alias("xh")), chosen, 2 * n + self.many)
        found = among(self.rows, named, "wanted").where("wanted").select("text").mapInArrow(_sets(self.clashes), "g long, body binary")
        bodies = written(found.join(wanted, "g", "left_semi").dropDuplicates(["g"]), sets, 2 * n + self.many // 16, AT_ONCE)
        right = pairs.join(bodies.select(F.col("g").alias("b"), F.col("body").alias("right")), "b")
        both = right.join(bodies.select(F.col("g").alias("a"), F.col("body").alias("left")), "a")
        found = materialize(both.select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long"), "similar", n, AT_ONCE)
        for path in (chosen, sets):  # what came of them is written
            discard(spark, path)
        return found


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _needed(n1, n2):
    """Shingles that the prefixes of two similar sets share at least. What they share beyond lies outside the prefix of the
    set whose prefix ends first, so it is at most that set's rest."""
    rest = F.greatest(F.ceil(F.lit(NUM) * n1 / DEN), F.ceil(F.lit(NUM) * n2 / DEN)) - 1
    return F.ceil(F.lit(NUM) * (n1 + n2) / (NUM + DEN)) - rest


def _short_pairs(found: DataFrame, entries: DataFrame, groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups (x, y) of short lists that can be similar, with the groups' numbers of members (mx, my); and these numbers.
    There are at most so many groups."""
    inlong = entries.groupBy("gp").agg(F.count(F.lit(1)).alias("l"))
    info = groups.groupBy("gp").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).join(inlong, "gp", "left").select("gp", "m", "n", F.coalesce("l", F.lit(0)).alias("l"))
    info = materialize(info, "group-sizes", most)
    met = found.where(F.col("kind") == PAIR).groupBy("x", "y").agg(F.sum("v").alias("v")).where(F.col("v") >= 1 << 32)
    met = met.join(info.selectExpr("gp x", "m mx", "n nx", "l lx"), "x").join(info.selectExpr("gp y", "m my", "n ny", "l ly"), "y")
    shared = F.col("v").bitwiseAND(F.lit((1 << 32) - 1)) + F.least("lx", "ly")
    return met.where(shared >= _needed(F.col("nx"), F.col("ny"))).select("x", "y", "mx", "my"), info


def _open_lists(entries: DataFrame, comp: DataFrame, most: int) -> tuple[DataFrame, dict]:
    """The entries (token, g, n, pos; at most so many) of lists that hold two components or more, with the component c, whether it is the
    list's largest, and the list's rows k and how many of them are not in the largest (odd). And the sums over all lists."""
    placed = entries.select("token", "g", "n", "pos").join(comp.select(F.col("node").alias("g"), "root"), "g", "left").select("token", "g", "n", "pos", F.coalesce("root", "g").alias("c"))
    sizes = placed.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k")).where("k > top.k").selectExpr("token", "top.c as top", "k", "k - top.k as odd")
    # a list has more than SHORT rows, nearly always; its verdict is copied so that a hot list is not one task
    largest = largest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int"))
    left = materialize(placed.join(largest, ["token", "salt"]).withColumn("in_top", F.col("c") == F.col("top")).drop("top", "salt"), "open-lists", most)
    sums = left.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(~F.col("in_top"), F.col("k"))).alias("pairs")).first()
    return left, {"rows": sums["rows"], "pairs": sums["pairs"] or 0}


_ROW = ["g", "n", "pos", "c"]


def _columns(batch) -> dict:
    found = {c: batch.column(c).to_numpy() for c in _ROW}
    found["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    return found


def _passing(x: dict, y: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of x and j of y, of one list and different components, that pass the filters by size, position and parity bits,
    and by how many bits they differ. All filters hold for every pair that is similar enough."""
    n1, n2 = x["n"][:, None].astype(np.int64), y["n"][None, :].astype(np.int64)
    ok = (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (x["c"][:, None] != y["c"][None, :])
    ok &= (DEN + NUM) * np.minimum(n1 - x["pos"][:, None], n2 - y["pos"][None, :]) >= NUM * (n1 + n2)
    i, j = np.nonzero(ok)
    size = x["n"][i].astype(np.int64) + y["n"][j]
    most = size - 2 * -(-NUM * size // (DEN + NUM))  # shingles that are in one set only
    apart = np.zeros(len(i), np.int64)
    for w in range(BITS // 64):
        apart += np.bitwise_count(x["bits"][i, w] ^ y["bits"][j, w])
    near = apart <= most
    return i[near], j[near], apart[near]


def _blocks(batches, keys: list[str]):
    """Runs of rows with equal keys, whole, as columns; the rows arrive sorted by them."""
    kept, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
        for a, b in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
            this = tuple(int(c[a]) for c in key)
            if this != now and kept:
                yield {c: np.concatenate([p[c] for p in kept]) for c in kept[0]}
                kept = []
            now = this
            kept.append(_columns(batch.slice(a, b - a)))
    if kept:
        yield {c: np.concatenate([p[c] for p in kept]) for c in kept[0]}


def _nearest(batches):
    """For each row of a block, the NEAREST partners that pass the filters and differ in the fewest bits."""
    names, kinds = ["g", "apart", "partner"], [_L, _L, _L]
    for rows in _blocks(batches, ["token", "part"]):
        out = []
        for at in range(0, len(rows["g"]), BLOCK):
            x = {c: v[at : at + BLOCK] for c, v in rows.items()}
            i, j, apart = _passing(x, rows)
            order = np.lexsort((j, apart, i))
            i, j, apart = i[order], j[order], apart[order]
            first = np.searchsorted(i, i)  # where this row's partners begin
            best = np.arange(len(i)) - first < NEAREST
            out.append((x["g"][i[best]], apart[best], rows["g"][j[best]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _neighbours(lists: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """For each class up to NEAREST pairs with classes of other components. Lists are dealt into blocks by a hash drawn for this turn."""
    part = F.pmod(F.xxhash64("g", F.lit(turn)), F.ceil(F.col("k") / BLOCK)).alias("part")
    rows = lists.select("token", part, *_ROW).join(groups.select("g", "bits"), "g")
    met = rows.repartition("token", "part").sortWithinPartitions("token", "part", "g").mapInArrow(_nearest, "g long, apart long, partner long")
    best = met.distinct().groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("apart", "partner"))), 1, NEAREST).alias("best"))
    return best.select("g", F.explode("best.partner").alias("partner")).select(*_pair(F.col("g"), F.col("partner"))).distinct()


def _meet(batches):
    """Rows sorted by list, side and copy: some rows outside the largest component, then the whole list, in a stream."""
    now, x, found = None, None, []
    names = ["a", "b"]

    def pairs():
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b, _ = _summed(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, _L), pa.array(b, _L)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        token, side, whole = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "side", "whole"))
        change = np.flatnonzero((token[1:] != token[:-1]) | (side[1:] != side[:-1]) | (whole[1:] != whole[:-1])) + 1
        for a, b in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
            rows = _columns(batch.slice(a, b - a))
            if not whole[a]:
                x = rows if now != (token[a], side[a]) else {c: np.concatenate((x[c], rows[c])) for c in rows}
                now = (token[a], side[a])
            elif now == (token[a], side[a]):
                for at, y in itertools.product(range(0, len(x["g"]), BLOCK), range(0, b - a, BLOCK * 4)):
                    some, part = ({c: v[t : t + n] for c, v in r.items()} for r, t, n in ((x, at, BLOCK), (rows, y, BLOCK * 4)))
                    i, j, _ = _passing(some, part)
                    if len(i):
                        found.append((some["g"][i], part["g"][j]))
        if sum(len(f[0]) for f in found) > MOST_PAIRS:
            yield pairs()
    if found:
        yield pairs()


def _cross_pairs(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """All pairs of different components that share a list and pass the filters. A list is copied once for every SIDE rows
    outside its largest component, so a task holds about that many rows, whatever the list's length."""
    sides = F.ceil(F.col("odd") / SIDE).cast("int")
    rows = lists.join(groups.select("g", "bits"), "g").withColumn("sides", sides)
    some = rows.where("not in_top").select("token", F.pmod(F.xxhash64("g", F.lit("side")), F.col("sides")).cast("int").alias("side"), F.lit(False).alias("whole"), *_ROW, "bits")
    every = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.lit(True).alias("whole"), *_ROW, "bits")
    dealt = some.unionByName(every).repartition("token", "side").sortWithinPartitions("token", "side", "whole", "g")
    return dealt.mapInArrow(_meet, "a long, b long").distinct()


def _edges(comp: DataFrame) -> DataFrame:
    return comp.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, xh, n_shingles, component_id for every row of docs (doc_id, text), whether it is alone with its set and without
    links, and whether it is the row of its component that stays: that of the smallest doc_id, then the smallest xh."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xh"))
    first = materialize(rows.mapInArrow(_classes, "doc_id long, xh long, n long, g long, check long, slice int, counts binary"), "classes")
    many = first.count()  # this and the sums below only bound the number of files of what follows
    members = first.where("n is not null").select("doc_id", "xh", "n", "g", "check")
    met = members.where("n > 0").groupBy("g").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    clashes = frozenset(r["g"] for r in met.select("g").collect())  # two sets of one 64-bit hash: none up to some 10^9 sets, a few dozen at 10^11
    if clashes:
        members = members.withColumn("g", F.when(F.col("g").isin(list(clashes)), F.col("check")).otherwise(F.col("g")))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xh")).alias("r")
    classes = materialize(members.where("n > 0").groupBy("g").agg(head, F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).selectExpr("g", "r.doc_id rep", "r.xh rep_xh", "least", "c"), "class-sizes", many)

    counted = first.where("slice is not null").select("slice", "counts").repartition("slice").sortWithinPartitions("slice")
    counts = np.zeros(1 << COUNT_BITS, np.uint64)
    for r in counted.mapInArrow(_sum_counts, "slice int, counts binary").collect():  # 8 MiB at most
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint64)
    table = spark.sparkContext.broadcast(counts)

    index = rows.select("text").mapInArrow(_postings(table, clashes), _INDEX).repartition("key").sortWithinPartitions("key", "gp")
    found = materialize(index.mapInArrow(_lists, _FOUND), "lists")
    many_of = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # three kinds
    groups = materialize(found.where(F.col("kind") == GROUP).select(F.col("x").alias("gp"), F.col("y").alias("g"), F.col("v").alias("n"), "bits").dropDuplicates(["g"]), "groups", many_of.get(GROUP, 0))
    place = [F.shiftright("v", 32).cast("int").alias("n"), F.col("v").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")]
    entries = materialize(found.where(F.col("kind") == ENTRY).select(F.col("x").alias("token"), F.col("y").alias("gp"), *place).distinct(), "entries", many_of.get(ENTRY, 0))

    join = _Join(rows, many, classes, clashes)
    pairs, sizes = _short_pairs(found, entries, groups, many_of.get(GROUP, 0))
    pairs = materialize(pairs, "group-pairs", many_of.get(PAIR, 0) + many_of.get(GROUP, 0))
    both = F.col("mx") * F.col("my")
    few, names = both <= SHORT * SHORT, groups.select("gp", "g")
    expanded = pairs.where(few).join(names.selectExpr("gp x", "g u"), "x").join(names.selectExpr("gp y", "g w"), "y").select(*_pair(F.col("u"), F.col("w")))
    crowds = groups.join(sizes.where("m > 1").select("gp", "m"), "gp").select("gp", "m", "g", "n")
    small = crowds.where(F.col("m") <= SHORT)
    inner = small.selectExpr("gp", "g u").join(small.selectExpr("gp", "g w"), "gp").where("u < w").select(F.col("u").alias("a"), F.col("w").alias("b"))
    m = F.col("m")
    of_groups = sizes.agg(F.sum(F.when((m > 1) & (m <= SHORT), m * m)).alias("inner"), F.sum(m * F.col("l") + F.when(m > SHORT, m).otherwise(0)).alias("listed")).first()
    of_pairs = pairs.agg(F.sum(F.when(few, both)).alias("expanded"), F.sum(F.when(~few, F.col("mx") + F.col("my"))).alias("listed")).first()
    comp = stars(join.verified(expanded.unionByName(inner).distinct(), (of_pairs["expanded"] or 0) + (of_groups["inner"] or 0)))

    # large groups, and pairs of groups with many members, are lists of their own
    lists = entries.join(names, "gp").select("token", "g", "n", "pos")
    alone = crowds.where(F.col("m") > SHORT).select(F.col("gp").alias("token"), "g", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    ends = pairs.where(~few).select(F.xxhash64("x", "y").alias("token"), F.explode(F.array("x", "y")).alias("gp"))
    crossed = ends.join(groups.select("gp", "g", "n"), "gp").select("token", "g", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"))
    listed, before = (of_groups["listed"] or 0) + (of_pairs["listed"] or 0), None
    left = materialize(lists.unionByName(alone).unionByName(crossed), "long-lists", listed + many_of.get(GROUP, 0))
    for turn in range(1 << 10):
        left, size = _open_lists(left, comp, listed)
        if size["pairs"] <= PAIRS_PER_ROW * size["rows"] or (before is not None and size["pairs"] > PROGRESS * before):
            break
        before = size["pairs"]
        comp = stars(_edges(comp).unionByName(join.verified(_neighbours(left, groups, turn), NEAREST * size["rows"])))
    comp = components(_edges(comp).unionByName(join.verified(_cross_pairs(left, groups), size["pairs"])))

    roots = comp.select(F.col("node").alias("g"), "root")
    joined = classes.join(roots, "g", "left").where("c > 1 or root is not null").select("g", F.coalesce("root", "g").alias("root"), F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_xh").alias("r"), "least")
    joined = materialize(joined, "joined", many)
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min("r").alias("head")), "root")
    named = named.select("g", "component_id", "head.rep", "head.rep_xh", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "xh"), F.lit(SALTS)).cast("int"))
    out, single = salted.join(named, ["g", "salt"], "left"), F.col("rep_xh").isNull()
    stays = single | (F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("xh") == F.col("rep_xh")))
    return out.select("doc_id", "xh", F.col("n").alias("n_shingles"), F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), single.alias("alone"), stays.alias("stays"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with its smallest doc_id (null last), then xh. Texts without words
    all stay; repeated rows of a component count once. Only rows of components leave the scan for a shuffle."""
    return without_redundant(docs, near_duplicates(docs).where("not alone").select("doc_id", "xh", "stays"))
