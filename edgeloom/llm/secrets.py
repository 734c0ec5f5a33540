"""Secret scan with a character convolutional network in numpy.

Regular expressions propose candidates: the base rules' spans, and any long run of key-like characters. Every candidate goes
with its surrounding context through a small character network (embedding, one convolution, maximum over positions, logistic
output). It is trained here, on labelled findings made by a seeded generator (keys and tokens of many shapes in assignments
and prose; words, identifiers, numbers, paths, slugs, UUIDs and rulers as negatives), and its threshold is calibrated on
held-out findings: the highest that keeps the demanded recall there with some room for chance. A calibration that cannot keep
it stops. Base spans stay whatever their score; n_doubtful counts those that score below the threshold. Runs that reach beyond
a base span are told beside it; runs within one are told by it.

Defined results: null and empty texts have no spans; repeated rows get equal results; doc_id may be null; an empty table gives
no rows. Extra columns are ignored whatever their names. A run longer than LONGEST characters is read whole, by overlapping
windows and by its parts between slashes and equals signs, each in the run's context; its score is the highest of them.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex")
RECALL = 0.9
UNCALIBRATED = 0.9  # the threshold of a network that saw no held-out secrets
WIDTH, LONGEST, BEFORE, AFTER = 96, 56, 32, 8
STEP = 16  # between the windows of a long run: a key of up to LONGEST - STEP characters stands whole in one of them
CHUNK = 4096  # windows that are scored at once, so that a text of any length takes bounded memory
FINDINGS = 12_000  # labelled findings the network is trained and calibrated on: a bound, not a share of the input
AMID = 0.15  # share of findings that are slices of a longer run
HELD_OUT = 3  # every so many findings go to the calibration

#: The base rules.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Any key-like run; what is shorter is no candidate.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: The parts of a long run that are candidates of their own.
PART = re.compile(r"[A-Za-z0-9+_-]{20,}")

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \"'=:_-+/.,;(){}[]<>@#\n"
_CODE = np.full(65536, len(_ALPHABET) + 1, np.uint8)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 1
_CODE[0] = 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a long run has 24 characters of one class; finding those first spares the short ones
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]{24,}", text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> str:
    """Context before, the candidate (its ends, if long), context after, at fixed places."""
    body = text[start:end]
    if len(body) > LONGEST:
        body = body[: LONGEST // 2] + body[-(LONGEST // 2) :]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + body.ljust(LONGEST, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def windows_of(text: str, start: int, end: int):
    """All windows of a candidate: one, or, if it is long, its ends, its overlapping slices and its parts, each in its context."""
    yield window(text, start, end)
    if end - start > LONGEST:
        before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
        for at in (*range(start, end - LONGEST, STEP), end - LONGEST):
            yield before + text[at : at + LONGEST] + after
        for m in PART.finditer(text, start, end):
            if m.end() - m.start() <= LONGEST:
                yield before + m[0].ljust(LONGEST, "\0") + after


def encode(windows: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    return _CODE[np.minimum(raw, 65535)].astype(np.int64)


class Network:
    """Embedding -> convolution (REACH characters) -> relu -> maximum -> logistic."""

    REACH, DIM, FILTERS = 5, 8, 32

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (len(_ALPHABET) + 2, self.DIM)).astype(np.float32),
            "w": rng.normal(0, 0.2, (self.REACH * self.DIM, self.FILTERS)).astype(np.float32),
            "b": np.zeros(self.FILTERS, np.float32),
            "v": rng.normal(0, 0.2, 3 * self.FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.threshold = UNCALIBRATED

    #: The maximum is taken apart over the context before, the candidate and the context after.
    PARTS = ((0, BEFORE - 4), (BEFORE - 4, BEFORE + LONGEST - 4), (BEFORE + LONGEST - 4, WIDTH - 4))

    def _forward(self, codes):
        x = self.p["e"][codes]
        wide = np.concatenate([x[:, i : WIDTH - self.REACH + 1 + i] for i in range(self.REACH)], axis=2)
        h = np.maximum(wide @ self.p["w"] + self.p["b"], 0)
        at = [h[:, a:b].argmax(axis=1) + a for a, b in self.PARTS]
        top = np.concatenate([np.take_along_axis(h, i[:, None], 1)[:, 0] for i in at], axis=1)
        return wide, at, top, 1 / (1 + np.exp(-np.clip(top @ self.p["v"] + self.p["c"], -30, 30)))

    def predict(self, codes) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)]) if len(codes) else np.empty(0)

    def fit(self, codes, labels, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(codes)), max(1, len(codes) // batch)):
                step += 1
                c, y = codes[rows], labels[rows]
                wide, at, top, p = self._forward(c)
                d = ((p - y) / len(rows)).astype(np.float32)
                grads = {"v": top.T @ d, "c": d.sum(keepdims=True), "w": np.zeros_like(self.p["w"]), "b": np.zeros_like(self.p["b"]), "e": np.zeros_like(self.p["e"])}
                for part, place in enumerate(at):
                    f = slice(part * self.FILTERS, (part + 1) * self.FILTERS)
                    dh = d[:, None] * self.p["v"][f] * (top[:, f] > 0)
                    picked = np.take_along_axis(wide, place[:, :, None], 1)  # rows, filters, reach * dim
                    grads["w"] += np.einsum("nf,nfk->kf", dh, picked)
                    grads["b"] += dh.sum(0)
                    back = (dh[:, :, None] * self.p["w"].T[None]).reshape(len(rows), self.FILTERS, self.REACH, self.DIM)
                    letters = np.take_along_axis(c[:, :, None], (place[:, :, None] + np.arange(self.REACH)).reshape(len(rows), -1, 1), 1)
                    np.add.at(grads["e"], letters.reshape(-1), back.reshape(-1, self.DIM))
                for k, g in grads.items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes, labels, recall: float = RECALL) -> float:
        """The highest threshold that keeps the demanded recall on these findings, two standard errors of the recall included."""
        own = np.sort(self.predict(codes)[labels > 0])
        if not len(own):
            self.threshold = UNCALIBRATED
            return self.threshold
        missed = (1 - recall) * len(own) - 2 * (recall * (1 - recall) * len(own)) ** 0.5
        self.threshold = float(own[max(0, int(missed))])
        if (own >= self.threshold).mean() < recall:
            raise RuntimeError(f"no threshold keeps a recall of {recall}")
        return self.threshold


def findings(n: int = FINDINGS, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Labelled windows, half of them secrets."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "er the ing tion en re es ver ung heit que la ció ment ou un de le st an th in on at".replace("ó", "o").split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))

    name = lambda: rng.choice(["token", "secret", "password", "api_key", "key", "auth", "id", "value", "name"])
    quote = chr(34)

    def lead(likely: float):
        if rng.random() < likely:
            return rng.choice([f"{name()}{rng.choice([' = ', ': ', '='])}{rng.choice(['', quote])}", "Authorization: Bearer "])
        return prose(3) + " "

    def secret():
        kind = rng.randrange(9)
        body = ("AKIA" + pick(up + num, 16), pick(low + up + num + "+/", 40), "ghp_" + pick(low + up + num, 36), pick("0123456789abcdef", rng.choice([32, 40, 64])), "sk_live_" + pick(low + up + num, 24), pick(low + up + num + "-_", rng.randint(24, 60)), "eyJ" + pick(low + up + num + "-_", rng.randint(30, 50)), pick("0123456789ABCDEF", rng.choice([32, 40])), pick(low + up + num + "+/", rng.choice([42, 43])) + "=")[kind]
        return lead(0.6), body

    camel = lambda k: "".join(word().capitalize() for _ in range(k))
    hexa = "0123456789abcdef"

    def plain():
        kind = rng.randrange(15)
        body = (
            "".join(word() for _ in range(8)),
            "-" * rng.randint(20, 60),
            "=" * rng.randint(20, 60),
            pick(num, rng.randint(20, 40)),
            "/".join(word() for _ in range(6)),
            "_".join(word() for _ in range(5)),
            "-".join(word() for _ in range(5)),
            camel(5) + rng.choice(["", pick(num, rng.randint(1, 3))]),
            word() + camel(4),
            "/" + "/".join(rng.choice([word(), word() + pick(num, 2), pick(num, 4)]) for _ in range(6)),
            "-".join(rng.choice([word(), word(), pick(num, rng.randint(1, 4))]) for _ in range(7)),
            "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
            "_".join(word().upper() for _ in range(4)) + f"_{rng.randrange(100)}",
            f"{rng.randrange(1990, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{pick(num, 6)}-{pick(num, 6)}",
            (rng.choice(low + up + num) * rng.randint(1, 3) + rng.choice(["", word()])) * 20,
        )[kind]
        body = body if len(body) >= 20 else body.ljust(20, rng.choice("ners"))
        return lead(0.25), body[:60].upper() if rng.random() < 0.1 else body[:60]

    def amid(body: str) -> str:
        """A slice of a longer run of rulers around what stands in it."""
        ruler, room = rng.choice("--==_+"), max(0, LONGEST - len(body))
        at = rng.randint(0, room)
        return (ruler * at + body + ruler * (room - at))[:LONGEST]

    windows, labels = [], []
    for i in range(n):
        front, body = secret() if i % 2 else plain()
        if rng.random() < AMID:
            body = amid(body[:44] if i % 2 else rng.choice([body[:30], "".join(word() for _ in range(rng.randint(0, 4)))[:40]]))
        front = f"{prose(4)} {front}"
        text, start = front + body + rng.choice(['"', " ", ". ", "\n"]) + prose(2), len(front)
        windows.append(window(text, start, start + len(body)))
        labels.append(i % 2)
    return windows, np.array(labels, np.float32)


def train(seed: int = 7) -> Network:
    windows, labels = findings()
    codes = encode(windows)
    held = np.arange(len(codes)) // 2 % HELD_OUT == 0  # labels alternate
    net = Network(seed)
    net.fit(codes[~held], labels[~held])
    net.calibrate(codes[held], labels[held])
    return net


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def added_kind(body: str) -> int:
    return 1 if body.isupper() and body.isalnum() else 2 if re.fullmatch("[0-9a-fA-F]+", body) else 0


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_doubtful long"


def _highest(net: Network, windows) -> list[float]:
    """The highest score of each candidate, from (candidate, window) pairs in the order of candidates."""
    best: list[float] = []
    while part := list(itertools.islice(windows, CHUNK)):
        for (k, _), p in zip(part, net.predict(encode([w for _, w in part])).tolist(), strict=True):
            if k == len(best):
                best.append(p)
            best[k] = max(best[k], p)
    return best


def _scan(network):
    def run(batches):
        net = network.value
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        for batch in batches:
            rows, texts, open_ = [], [], []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                text = text.as_py() or ""
                base = base_spans(text)
                rows.append((doc, base))
                texts.append(text)
                open_ += [(i, a, b, k, True) for a, k, b in base]
                far, at, reach = sorted((a, b) for a, _, b in base), 0, 0
                for m in TOKEN.finditer(text):
                    while at < len(far) and far[at][0] <= m.start():
                        reach, at = max(reach, far[at][1]), at + 1
                    if reach < m.end():  # no base span, scored above, holds the whole run
                        open_.append((i, m.start(), m.end(), added_kind(m[0]), False))
            scores = _highest(net, ((k, w) for k, (i, a, b, *_) in enumerate(open_) for w in windows_of(texts[i], a, b)))
            extra: dict[int, list] = {}
            doubtful = [0] * len(rows)
            for (i, a, b, kind, known), p in zip(open_, scores, strict=True):
                if known:
                    doubtful[i] += p < net.threshold
                elif p >= net.threshold:
                    extra.setdefault(i, []).append((a, kind, b))
            out = []
            for i, (doc, base) in enumerate(rows):
                count = [sum(k == j for _, k, _ in base) for j in range(3)]
                more = extra.get(i, [])
                out.append((doc, *count, hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted(base + more)), len(more), doubtful[i]))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_doubtful for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or train())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), _SCHEMA)
