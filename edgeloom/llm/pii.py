"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans; regex, gazetteer and context labelers vote on each. The votes' joint counts, together with
a few bits about each span's shape (at most 4096 rows, whatever the input), go to the driver, where expectation-maximisation
estimates each labeler's reliability from the votes, and a logistic span classifier of votes, kind and shape is fitted to the
resulting posteriors. The classifier's weights return as a column expression that decides about proposals outside the base
rules; base spans always stay.

Positions are code points. A list of matches becomes positions by running sums over blocks, and contexts come from the gaps
between matches, so a text with very many matches takes time in proportion to its length. Patterns are possessive where that
changes nothing, so that long runs neither recurse nor rescan.

Defined results: null and empty texts have no spans; repeated rows get equal results; doc_id may be null; an empty table gives
no rows. Very long texts are read whole. Extra columns are ignored whatever their names. Of spans that begin at one place the
order is that of the kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
BLOCK = 256

#: The base rules' patterns (possessive, and bound to the start of a run, where that finds the same matches).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # numbers with a plus are the base rule's; others of ten digits in three groups are proposals only
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Gazetteers, as patterns over the span.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|23|24|25)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    # country calling codes, or a North American area code
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|50[0-9]|59[0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])|\(?[2-9][0-9]{2}[^0-9])",
}
#: Context words that stand shortly before a span.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|reach)",
    "ip": r"(?i)(?:\bip\b|address|adresse|server|host|client|login)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|amex|account|konto)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|handy|number|nummer|contact)",
}
LABELERS = ("regex", "gazetteer", "context", "isolated", "grouped")


#: Bits about a span's shape, for the classifier: blanks, points or hyphens, brackets, many digits, a sign or letter before it.
SHAPES = (r"\x20", r"[0-9][.-][0-9]", r"[()]", r"(?:[0-9][^0-9]*){11}", None)
NEAR = 30  # characters of context


def located(text, pattern: str):
    """array<struct<gap, before, after, m>> of a pattern's matches: the length of the gap before each, its last characters and
    the first one of the gap that follows. Text and gaps are walked once, not once for every match."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    heads = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(NEAR)).alias("before"), F.left(g, F.lit(1)).alias("head")))
    # one gap more than matches
    pairs = F.zip_with(matches, heads, lambda m, g: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), g["head"].alias("head"), m.alias("m")))
    return F.zip_with(F.filter(pairs, lambda x: x["m"].isNotNull()), F.filter(F.transform(pairs, lambda x, i: F.when(i > 0, x["head"])), lambda h: h.isNotNull()), lambda x, h: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), h.alias("after"), x["m"].alias("m")))


def _placed(pairs):
    """Running sums in blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["m"])))
    empty = F.array().cast("array<struct<start:int,before:string,after:string,m:string>>")
    ahead = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def within(block, at):
        step = lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["before"].alias("before"), x["after"].alias("after"), x["m"].alias("m")))).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    return F.when(F.size(pairs) > 0, F.flatten(F.zip_with(blocks, ahead, within))).otherwise(empty)


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _base(kind: str, m):
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return m.startswith("+") & n.between(9, 15)


def _votes(kind: str, x, base):
    """The labelers' votes as bits 0 to 4, and the shape as the bits above."""
    m, around = x["m"], F.concat(F.right(x["before"], F.lit(1)), F.lit(" "), x["after"])
    bits = [base, m.rlike(GAZETTEER[kind]), x["before"].rlike(CONTEXT[kind]), ~around.rlike("[0-9A-Za-z_]"), m.rlike("[0-9]{3,4}[ .-][0-9]{3,4}") if kind in ("card", "phone") else m.rlike("[a-z]")]
    bits += [m.rlike(p) if p else x["before"].rlike(r"[=:#/_@A-Za-z]$") for p in SHAPES]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, found array<struct<start, kind, end, base, votes>> for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<struct<gap:int,before:string,after:string,m:string>>")
    needs = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": F.col("text").contains("+") | F.col("text").rlike(r"[0-9]{3}[ .-][0-9]{4}")}
    for name, pattern in PATTERNS.items():
        rows = rows.withColumn(name, F.when(needs[name], located(F.col("text"), pattern)).otherwise(none))
    for name in PATTERNS:
        rows = rows.withColumn(name, _placed(F.col(name)))
    rows = rows.withColumn("card", F.filter("card", lambda x: F.length(_digits(x["m"])).between(12, 19)))

    def spans(kind: str):
        def one(x):
            base = _base(kind, x["m"])
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), base.alias("base"), _votes(kind, x, base).cast("int").alias("votes"))

        return F.transform(kind, one)

    return rows.select("doc_id", F.array_sort(F.concat(*map(spans, KINDS))).alias("found"))


def estimate(counts: dict[tuple[int, int], int], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over labelers of unknown reliability.

    All votes are held independent given the truth; each kind has its own prior. Starts from moderately reliable labelers.
    """
    k = len(LABELERS)
    hit, miss = [0.8] * k, [0.2] * k
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for kind, votes in counts:
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for i in range(k):
                on = votes >> i & 1
                a += math.log(hit[i] if on else 1 - hit[i])
                b += math.log(miss[i] if on else 1 - miss[i])
            post[kind, votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
        for i in range(k):
            yes = sum(n * post[x] for x, n in counts.items())
            no = sum(n * (1 - post[x]) for x, n in counts.items())
            hit[i] = (sum(n * post[x] for x, n in counts.items() if x[1] >> i & 1) + 2) / (yes + 3)
            miss[i] = (sum(n * (1 - post[x]) for x, n in counts.items() if x[1] >> i & 1) + 1) / (no + 3)
        for kind in prior:
            total = sum(n for x, n in counts.items() if x[0] == kind)
            prior[kind] = (sum(n * post[x] for x, n in counts.items() if x[0] == kind) + 1) / (total + 2)
    return post


def train(counts: dict[tuple[int, int], int], rounds: int = 300) -> list[float]:
    """Weights of the span classifier: votes, shape, kinds; logistic regression on the posteriors that the votes alone give.

    counts: how often each (kind, bits of votes and shape) occurs."""
    k, voted = len(LABELERS), {}
    for (kind, bits), n in counts.items():
        key = kind, bits & (1 << k) - 1
        voted[key] = voted.get(key, 0) + n
    post = estimate(voted)
    seen = k + len(SHAPES)
    w, total = [0.0] * (seen + len(KINDS)), max(1, sum(counts.values()))
    features = {x: [i for i in range(seen) if x[1] >> i & 1] + [seen + x[0]] for x in counts}
    for _ in range(rounds):
        grad = [1e-3 * v for v in w]
        for x, n in counts.items():
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[i] for i in features[x])))))
            for i in features[x]:
                grad[i] += n / total * (p - post[x[0], x[1] & (1 << k) - 1])
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _joined(found):
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs (doc_id, text)."""
    found = materialize(proposals(docs), "proposals")
    votes = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    weights = train({(r["kind"], r["votes"]): r["n"] for r in votes.collect()})  # 4 kinds, 1024 patterns of bits at most
    bits = len(LABELERS) + len(SHAPES)

    def chosen(x):
        z = sum((F.when(x["votes"].bitwiseAND(F.lit(1 << i)) > 0, F.lit(w)).otherwise(F.lit(0.0)) for i, w in enumerate(weights[:bits])), F.lit(0.0))
        z = z + sum((F.when(x["kind"] == j, F.lit(w)).otherwise(F.lit(0.0)) for j, w in enumerate(weights[bits:])), F.lit(0.0))
        return x["base"] | (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) >= accept)

    base = F.filter("found", lambda x: x["base"])
    out = found.withColumn("base_spans", base).withColumn("all_spans", F.filter("found", chosen))
    of = lambda j: F.size(F.filter("base_spans", lambda x: x["kind"] == j)).cast("long")
    counts = [of(j).alias(f"n_{name}") for j, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))
