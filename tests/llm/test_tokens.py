"""Packing and decontamination against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, packing
from edgeloom.llm.queries import byte_bpe


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


TEXTS = ["", None, "a", " a", "a ", "a  b", "a \n b", "x\n\n y", "tab\t z", "don't <|endoftext|> é 12 ab  ", " x 　y", "日本 語 テ", "a\u0085 b", "a \x1c b", "..., 'll we're", "word " * 3000]


def check(pieces, docs):
    """docs: id -> ids. The pieces are whole, gapless and within bounds; returns the share of padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == docs.keys()
    for doc, ids in docs.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p["length"]])
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    padded = total = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total += at
        padded += at if at & (at - 1) == 0 else 2048
    return 1 - total / max(padded, 1)


def test_encoder_equals_the_library():
    encode = packing.encoder(byte_bpe())
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab .\n\t'é7 -") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, want in zip(texts, library_ids(texts), strict=True):
        raw = encode(text)
        assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == want[:-1], repr(text)


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 7)
    test_encoder_equals_the_library()


def test_packing_cases(spark):
    rows = list(enumerate(TEXTS))
    pieces = [r.asDict() for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", __import__("pyspark.sql.functions").sql.functions.lit(1)), byte_bpe()).collect()]
    assert check(pieces, dict(zip(range(len(TEXTS)), library_ids(TEXTS), strict=True))) < 0.01
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).count() == 0


def test_packing_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pieces = [r.asDict() for r in packing.pack(docs, byte_bpe(), with_ids=True).collect()]
    assert check(pieces, dict(zip([r[0] for r in rows], library_ids([r[1] for r in rows]), strict=True))) < 0.01
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)


def brute(docs, items, k=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for item, t in items:
        w = word(t)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, t in docs:
        w = word(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c D é".split()) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 12, 13, 14, 20, 30]))) for i in range(12)] + [(90, ""), (91, None), (92, "..."), (93, "zz")]
    items += [(50, items[4][1].upper())]
    docs = [(i, text(rng.randrange(1, 60))) for i in range(60)]
    docs += [(100 + i, text(5) + " x " + (t or "") + "! y " + text(40)) for i, (_, t) in enumerate(items)] + [(300, None), (301, ""), (302, "ZZ"), (None, items[0][1])]
    return docs, items


def test_contamination_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        for limit in (1 << 20, 40):
            df = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), item_bytes=limit)
            assert sorted((tuple(r) for r in df.collect()), key=str) == brute(docs, items)


def test_decontaminate_cuts_and_drops(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, item), (2, "word " * 400 + item.upper() + ". the end"), (3, "clean text"), (4, None)]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, n_chars long, items string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert out.keys() == {2, 3, 4}
    assert out[2]["text"] == "word " * 400 + ". the end" and out[2]["n_chars"] == len(out[2]["text"])
    assert out[3]["text"] == "clean text" and out[4]["text"] is None and out[3]["items"] == "x"
    none = decontaminate.contamination(df, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == 4


def test_decontaminate_by_several_automata_keeps_each_row(spark):
    """Rows with null or repeated ids each keep their own text and verdict, whatever the number of automata."""
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = "word " * 400
    docs = [(None, item, 1), (None, "clean a", 2), (None, "clean b", 3), (7, item, 4), (7, "clean c", 5), (7, long + item + ". end", 6), (8, "same", 7), (8, "same", 8), (None, None, 9), (None, long + item, 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row long").withColumn("items", F.col("row"))
    bench = spark.createDataFrame([(i, f"{item} {i}" if i else item) for i in range(4)], "item_id long, text string")
    assert len(list(decontaminate.automata(bench, item_bytes=40))) > 1
    want = {2: (None, "clean a"), 3: (None, "clean b"), 5: (7, "clean c"), 6: (7, long + ". end"), 7: (8, "same"), 8: (8, "same"), 9: (None, None), 10: (None, long)}
    for limit in (1 << 20, 40):
        out = decontaminate.decontaminate(df, bench, item_bytes=limit)
        assert out.columns == df.columns
        rows = out.collect()
        assert len(rows) == len(want) and {r["row"]: (r["doc_id"], r["text"]) for r in rows} == want and all(r["items"] == r["row"] for r in rows)


def test_automaton_is_whole():
    sam = decontaminate.Automaton([(1, b"a b c a b c a b c a b c a b c"), (2, b"b c a")], 13)
    hit, items = __import__("numpy").zeros(3, bool), set()
    sam.scan([b"b", b"c", b"a"], hit, items)
    assert items == {2} and hit.all()


def test_automaton_of_repeated_words_is_linear():
    """One word 40,000 times: every state's window is found once."""
    import time

    began = time.time()
    sam = decontaminate.Automaton([(1, b"a " * 40_000)])
    hit, items = __import__("numpy").zeros(20_000, bool), set()
    sam.scan([b"a"] * 20_000, hit, items)
    assert items == {1} and hit.all() and time.time() - began < 10
