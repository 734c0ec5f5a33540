"""Toxicity by a weighted grammar of finite-state transducers.

A text is cut into clauses, and a lexicon rewrites each word to the set of tags it may carry: insult, threat, target,
negation, report. Five transducers read the tags of a clause. Those of insults and threats emit a head; those of targets,
negations and reports keep in their state how far their last cue lies back, and mark a head that stands in its scope, or, for
targets and reports, one that they follow closely. ``compose`` builds their product, one machine over all reachable states. A
clause's path through it gives each head a reading (bare, aimed, negated, reported) and the head's arc a weight: how much more
often its entry occurs in toxic text. So clauses are scored, never isolated words: a document's score is the logistic of the
weights that its clauses' paths gather, reading by reading, and of its length, for chance brings entries into long texts.

The lexicon is partly fixed (a short list in four languages) and partly learned from labels: stems (prefixes of words, for
inflected insults) and words that mark toxic rows become insults. Arc weights are log ratios of rates; reading weights are
fitted by logistic regression on the same rows. All fits use the labelled rows given, at most MOST_LABELLED of them (by the
smallest hash of doc_id); scoring covers every row and whole texts.

Defined results: null, empty and wordless texts have no clause and get the score of the intercept. Labels that are null or
whose doc_id is unknown are not used; of a doc_id's labels the largest counts. Without usable labels the fixed lexicon and
weights hold. Repeated rows get equal scores and count once in the fits. An empty table gives no rows. Texts of any length
take time in proportion. Columns beside doc_id and text are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

MOST_LABELLED = 60_000
MOST_STEMS = 4_000
REJECT = 0.7
STEM = (3, 8)  # lengths of learned prefixes; whole words count too
MOST_EACH = 4  # occurrences of one word or entry in one row that count in the fits
MOST_HELD = 200_000  # words of one label that a task holds before it passes them on
MOST_WORDS = 100_000  # looked-up words that a task remembers
RATIO = 6  # how much more frequent a learned entry is in toxic text, at least
TASKS = 64  # of the fits, whose rows are bounded

#: Fixed lexicon, by tag: words of English, German, French and Spanish.
LEXICON = {
    "insult": "idiot idiots moron morons loser losers scum trash worthless pathetic disgusting stupid clown dumb imbecile fool dumm blöd dummkopf idioten versager abschaum nutzlos widerlich erbärmlich connard imbécile crétin débile minable ordure idiota estúpido imbécil basura inútil asqueroso patético perdedor",
    "threat": "kill destroy hurt beat punch shoot murder stab attack töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    "target": "you your u yourself they he she him her them du dich dir euch ihr sie tu te toi vous tú usted ustedes ellos",
    "negation": "not never no isn't don't nicht nie kein keine niemals pas jamais nunca jamás",
    "report": "said says wrote writes claimed quoted according reported sagte schrieb behauptete laut dit écrit selon affirmé dijo escribió según afirmó",
}
TAGS = ("insult", "threat", "target", "negation", "report")
#: Words over which a cue reaches: targets on both sides, negations ahead, reports ahead and, after a head, back.
NEAR, NEGATES, REPORTS, TOLD = 5, 4, 12, 4
#: Readings of a head, and their weights before any fit; then that of every hundred words, and the intercept.
READINGS = ("insult_bare", "insult_aimed", "insult_negated", "insult_reported", "threat_aimed", "threat_other")
PRIOR = (1.0, 1.1, 0.7, 0.7, 0.3, 0.0)
LENGTH = 0.0
BASE = -3.0
ARC = 4.0  # weight of a fixed entry's arc before any fit
ARCS = (0.5, 6.0)  # bounds of fitted arc weights

_CLAUSE = re.compile(r"[.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def clauses(low: str):
    for part in _CLAUSE.split(low):
        words = _WORD.findall(part)
        if words:
            yield words


@dataclass
class Trie:
    """Deterministic acceptor of whole words and stems, reading character by character. Entries carry tags (bits) and a number."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: dict[int, tuple[int, int]] = field(default_factory=dict)
    stem: dict[int, tuple[int, int]] = field(default_factory=dict)

    def add(self, entry: str, tags: int, number: int, stem: bool = False) -> None:
        state = 0
        for c in entry:
            if c not in self.next[state]:
                self.next.append({})
                self.next[state][c] = len(self.next) - 1
            state = self.next[state][c]
        known = self.stem if stem else self.word
        known[state] = (known.get(state, (0, 0))[0] | tags, number)

    def look(self, word: str) -> tuple[int, int]:
        """Tags and number of the whole word, else of its longest stem; (0, -1) without either."""
        state, found = 0, (0, -1)
        for c in word:
            state = self.next[state].get(c, -1)
            if state < 0:
                return found
            found = self.stem.get(state, found)
        return self.word.get(state, found)


_BIT = {tag: 1 << i for i, tag in enumerate(TAGS)}
INSULT, THREAT, TARGET, NEGATION, REPORT = (_BIT[t] for t in TAGS)
HEAD = INSULT | THREAT
#: What a path may say of the head it reads, and, by the second half, of the head before.
AIMED, NEGATED, REPORTED, AIMED_BACK, REPORTED_BACK = 4, 8, 16, 32, 64


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: arcs[state][tags] = (next state, output bits); state 0 begins a clause."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]


def _built(step, start) -> Transducer:
    """The transducer of a step function (state, tags) -> (state, output) over all states that the start reaches."""
    numbers, order, arcs = {start: 0}, [start], []
    for state in order:
        row = []
        for tags in range(1 << len(TAGS)):
            then, out = step(state, tags)
            if then not in numbers:
                numbers[then] = len(order)
                order.append(then)
            row.append((numbers[then], out))
        arcs.append(tuple(row))
    return Transducer(tuple(arcs))


def _heads(tag: int, out: int) -> Transducer:
    return _built(lambda state, tags: (state, out if tags & tag else 0), ())


def _cues(tag: int, ahead: int, back: int, out: int, out_back: int) -> Transducer:
    """Marks heads up to `ahead` words after a cue, and the last head up to `back` words before one. State: words left of both."""

    def step(state, tags):
        cue, head = state
        said = (out if tags & HEAD and cue else 0) | (out_back if tags & tag and head else 0)
        return (ahead if tags & tag else max(0, cue - 1), back if tags & HEAD else 0 if tags & tag else max(0, head - 1)), said

    return _built(step, (0, 0))


def compose(left: Transducer, right: Transducer) -> Transducer:
    """Both transducers on one input, their outputs joined."""

    def step(state, tags):
        (a, x), (b, y) = left.arcs[state[0]][tags], right.arcs[state[1]][tags]
        return (a, b), x | y

    return _built(step, (0, 0))


def grammar_machine() -> Transducer:
    machine = _heads(INSULT, INSULT)
    parts = (_heads(THREAT, THREAT), _cues(TARGET, NEAR, NEAR, AIMED, AIMED_BACK), _cues(NEGATION, NEGATES, 0, NEGATED, 0), _cues(REPORT, REPORTS, TOLD, REPORTED, REPORTED_BACK))
    for part in parts:
        machine = compose(machine, part)
    return machine


_REST = max(NEAR, NEGATES, REPORTS, TOLD)  # so many words without tags lead back to a state that has forgotten its cues
_machines: list = []


def machine() -> tuple[tuple, list[list[int]]]:
    """The composed machine's arcs, and the states after 0, 1, .. _REST words without tags."""
    if not _machines:
        arcs = grammar_machine().arcs
        rest = [[s] for s in range(len(arcs))]
        for row in rest:
            for _ in range(_REST):
                row.append(arcs[row[-1]][0][0])
        _machines.append((arcs, rest))
    return _machines[0]


def reading(said: int) -> int:
    """The number of the reading of a head with these marks."""
    if said & INSULT:
        return 3 if said & REPORTED else 2 if said & NEGATED else 1 if said & AIMED else 0
    return 4 if said & AIMED and not said & (NEGATED | REPORTED) else 5


class _Looks(dict):
    """Words looked up in a trie, remembered up to MOST_WORDS: (tags, entry), or None without tags."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str):
        if len(self) >= MOST_WORDS:
            self.clear()
        tags, entry = self.trie.look(word)
        found = self[word] = (tags, entry) if tags else None
        return found


@dataclass
class Grammar:
    stems: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    arcs: tuple[float, ...] = ()  # weights by entry number: the fixed lexicon's in order, then words, then stems
    weights: tuple[float, ...] = PRIOR
    length: float = LENGTH
    base: float = BASE
    _looks: _Looks | None = None

    def __getstate__(self):
        return self.__dict__ | {"_looks": None}

    def looks(self) -> _Looks:
        if self._looks is None:
            trie, number = Trie(), 0
            for tag, entries in LEXICON.items():
                for x in entries.split():
                    trie.add(x, _BIT[tag], number)
                    number += 1
            for entries, stem in ((self.words, False), (self.stems, True)):
                for x in entries:
                    trie.add(x, INSULT, number, stem)
                    number += 1
            self._looks = _Looks(trie)
        return self._looks

    def paths(self, low: str):
        """The heads of every clause of a text in lower case that has any: [marks, entry], in order."""
        arcs, rest = machine()
        looks = self.looks()
        for words in clauses(low):
            tagged = [(i, *r) for i, w in enumerate(words) if (r := looks[w])]
            if not any(tags & HEAD for _, tags, _ in tagged):
                continue
            state, at, read = 0, 0, []
            for i, tags, entry in tagged:
                state = rest[state][min(i - at, _REST)]
                state, out = arcs[state][tags]
                at = i + 1
                if read and out & (AIMED_BACK | REPORTED_BACK):
                    read[-1][0] |= (AIMED if out & AIMED_BACK else 0) | (REPORTED if out & REPORTED_BACK else 0)
                if tags & HEAD:
                    read.append([out, entry])
            yield read

    def heads(self, text: str) -> tuple[Counter, int]:
        """How often each (reading, entry) occurs, and the number of words. Only texts with a head are cut into clauses."""
        low, looks = text.lower(), self.looks()
        words = _WORD.findall(low)
        found: Counter = Counter()
        if any((r := looks[w]) and r[0] & HEAD for w in set(words)):
            for read in self.paths(low):
                found.update((reading(said), entry) for said, entry in read)
        return found, len(words)

    def gathered(self, found: Counter) -> list[float]:
        """The arc weights of all paths, by reading."""
        sums = [0.0] * len(READINGS)
        for (r, entry), n in found.items():
            sums[r] += n * (self.arcs[entry] if self.arcs else ARC)
        return sums

    def readings(self, text: str) -> list[int]:
        """How many clauses have each reading: that of the clause's last insult, else of its last threat."""
        counts = [0] * len(READINGS)
        for read in self.paths(text.lower()):
            counts[reading(max(enumerate(read), key=lambda x: (x[1][0] & INSULT, x[0]))[1][0])] += 1
        return counts

    def score(self, text: str) -> float:
        found, words = self.heads(text)
        z = self.base + self.length * words / 100 + sum(w * x for w, x in zip(self.weights, self.gathered(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count_words(batches):
    """Per task: occurrences of each word in toxic and clean rows, at most MOST_EACH a row, and (word '') the words of both."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]

    def part():
        for label, count in enumerate(counts):
            names, n = list(count), list(count.values())
            count.clear()
            for at in range(0, len(names), 100_000):
                k, zero = n[at : at + 100_000], [0] * len(n[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000], pa.string()), pa.array(k if label else zero, pa.int64()), pa.array(zero if label else k, pa.int64())], ["word", "toxic", "clean"])

    for batch in batches:
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            words = _WORD.findall((text.as_py() or "").lower())
            totals[label] += len(words)
            counts[label].update({w: min(n, MOST_EACH) for w, n in Counter(words).items()})
            if len(counts[label]) > MOST_HELD:
                yield from part()
    yield from part()
    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([totals[1]], pa.int64()), pa.array([totals[0]], pa.int64())], ["word", "toxic", "clean"])


def _features(words: DataFrame) -> DataFrame:
    """feature, t, c: words, and their prefixes of the lengths STEM with an asterisk."""
    n = F.col("n")
    stems = words.where(F.length("feature") >= STEM[0]).withColumn("n", F.explode(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("feature")))))
    stems = stems.select(F.concat(F.left("feature", n), F.lit("*")).alias("feature"), "t", "c").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return words.unionByName(stems)


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Stems and words that mark toxic text, from occurrences (feature, toxic, clean) and the words of toxic and clean rows.

    Each must be at least RATIO times as frequent in toxic text, and beyond chance even among all the features tried (the
    likelihood ratio against independence exceeds their number by e^3). Of prefixes of each other the most telling stays.
    """
    if not toxic or not clean:
        return [], []
    rate, chance = toxic / (toxic + clean), math.log(max(200_000, 40 * len(rows))) + 3

    def gain(t: int, c: int) -> float:
        q = t / (t + c)
        return t * math.log(q / rate) + (c * math.log((1 - q) / (1 - rate)) if c else 0) if q > rate else 0.0

    known = {f: g for f, t, c in rows if t / toxic >= RATIO * (c + 0.5) / clean and (g := gain(t, c)) >= chance}
    stems: list[str] = []
    words: list[str] = []
    for f, _ in sorted(known.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        name = f.removesuffix("*")
        if f != name and not any(name.startswith(s) or s.startswith(name) for s in stems):
            stems.append(name)
        elif f == name and not any(name.startswith(s) for s in stems):
            words.append(name)
    return sorted(stems), sorted(w for w in words if not any(w.startswith(s) for s in stems))


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> tuple[tuple[float, ...], float, float]:
    """Logistic regression by Newton steps on gathered weights and hundreds of words, pulled towards the prior weights; both
    labels weigh alike."""
    prior = np.array([*PRIOR, LENGTH, BASE])
    if not len(y) or y.min() == y.max():
        return PRIOR, LENGTH, BASE
    z = np.column_stack([x, np.ones(len(x))])
    w = prior.copy()
    own = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (own * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve((z * (own * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(np.maximum(w[:-2], 0.0).tolist()), float(min(0.0, w[-2])), float(w[-1])


def fit_arcs(seen: list[tuple[int, int, list[tuple[int, int, int]]]], entries: int) -> tuple[float, ...]:
    """Arc weights from rows (toxic, words, [(reading, entry, count)]): log ratios of an entry's rates in toxic and clean text."""
    own, words = np.zeros((2, entries)), [1, 1]
    for toxic, n, found in seen:
        words[toxic] += n
        for _, entry, k in found:
            own[toxic, entry] += min(k, MOST_EACH)
    ratio = (own[1] + 0.5) / words[1] / ((own[0] + 0.5) / words[0])
    return tuple(np.where(own.sum(0) > 0, np.clip(np.log(ratio), *ARCS), ARC).tolist())


def _count_heads(grammar):
    def run(batches):
        g = grammar.value
        for batch in batches:
            heads = [g.heads(t or "") for t in batch.column("text").to_pylist()]
            flat = [[x for (r, e), n in sorted(found.items()) for x in (r, e, n)] for found, _ in heads]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for _, n in heads], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["toxic", "words", "found"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Grammar:
    """A grammar from docs (doc_id, text) and labels (doc_id, toxic 0/1)."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # `most` pairs of numbers at most
    rows = texts.select("toxic", "text", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"]).repartition(TASKS, "h").select("toxic", "text")
    rows = materialize(rows, "labelled")
    found = rows.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy(F.col("word").alias("feature")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = materialize(_features(found).where("feature = '' or t >= 3"), "features")
    total = found.where("feature = ''").first()
    if total is None or not total["t"] or not total["c"]:
        return Grammar()
    some = found.where("feature <> ''").where(F.col("t") * total["c"] >= RATIO * F.col("c") * total["t"])
    best = some.orderBy(F.col("t").desc(), "c", "feature").limit(MOST_STEMS * 4).collect()
    stems, words = choose([(r["feature"], r["t"], r["c"]) for r in best], total["t"], total["c"])
    grammar = Grammar(tuple(stems[:MOST_STEMS]), tuple(words[:MOST_STEMS]))
    seen = rows.mapInArrow(_count_heads(spark.sparkContext.broadcast(grammar)), "toxic int, words long, found array<long>").collect()  # `most` rows at most
    seen = [(r["toxic"], r["words"], list(zip(*[iter(r["found"])] * 3, strict=True))) for r in seen]
    fixed = sum(len(x.split()) for x in LEXICON.values())
    grammar.arcs = fit_arcs(seen, fixed + len(grammar.words) + len(grammar.stems))
    x = [[*grammar.gathered(Counter({(r, e): n for r, e, n in found})), words / 100] for _, words, found in seen]
    grammar.weights, grammar.length, grammar.base = fit_weights(np.array(x, float).reshape(len(seen), -1), np.array([t for t, _, _ in seen], float))
    return grammar


def _scores(grammar):
    def run(batches):
        g = grammar.value
        for batch in batches:
            scores = [g.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score for every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(shared), "doc_id long, score double")


def _calm(grammar, most: float):
    def run(batches):
        g = grammar.value
        for batch in batches:
            yield batch.filter(pa.array([g.score(t.as_py() or "") < most for t in batch.column("text")], pa.bool_()))

    return run


def reject_toxic(docs: DataFrame, grammar: Grammar, most: float = REJECT) -> DataFrame:
    """docs without the rows that score `most` or more; all columns stay."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    return docs.mapInArrow(_calm(shared, most), docs.schema)
