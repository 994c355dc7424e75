"""Packing: every id in one piece, gapless sequences, little padding, the library's ids."""

import zlib

import numpy as np
import pytest

from sentrella.llm import packing as P

T = pytest.importorskip("public_tokenizers")
TABLE = "doc_id long, text string, lang string, start long, part int"


def padded(lengths):
    return sum(P.cost(n) - n for n in lengths)


def check(pieces, texts):
    """texts: (doc_id, text); pieces as a pandas table. The share of padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(T.path("word_bpe_49k.json"))
    ids = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for d, t in texts]
    by = {}
    for r in pieces.itertuples():
        by.setdefault((None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens), []).append(r)
    want = {}
    for d, x in ids:
        want.setdefault((d, len(x)), []).append(x)
    assert by.keys() == want.keys()
    for key, rows in by.items():
        # Pieces of equal documents are told apart by their checksums.
        starts = {}
        for r in rows:
            starts.setdefault((r.start, r.length), []).append(r.ids_crc32)
        assert sum(r.length for r in rows) == key[1] * len(want[key])
        if len(want[key]) == 1:
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.ids_crc32 == zlib.crc32(want[key][0][at : at + r.length].tobytes())
                at += r.length
            assert at == key[1]
        else:
            for (a, n), crcs in starts.items():
                assert set(crcs) <= {zlib.crc32(x[a : a + n].tobytes()) for x in want[key]}
    lengths = []
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(rows.length)
        assert list(rows.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= 2048
        lengths.append(int(ends.iloc[-1]))
    return padded(lengths) / sum(len(x) for _, x in ids)


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "an odd one"), (None, "an odd one"), (3, "same text."), (3, "same text."), (4, "same text."), (5, "Word, " * 9000), (6, "x" * 30000), (7, "tab\tand\x0bfeed\x00 ünï 漢字 <|endoftext|> a  b\n\n c ΣΑΣ it's İ ’s"), (8, "a " * 2047), (9, "a " * 1023), (10, "a " * 4095), (2**62, "é ́x"), (-5, "neg")]
    docs = spark.createDataFrame([(*r, "en", 3, 4) for r in rows], TABLE).repartition(3)
    got = P.pack(docs, T.path("word_bpe_49k.json"))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    spark_rows = got.collect()
    import pandas as pd

    pieces = pd.DataFrame([r.asDict() for r in spark_rows]).astype({"doc_id": object})
    check(pieces, rows)
    assert P.pack(docs.limit(0), T.path("word_bpe_49k.json")).count() == 0


def test_registered_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(P.op13_packing(spark, sf).toPandas(), docs) < 0.01


@pytest.mark.parametrize("kind", ["exponential", "large", "uniform", "few", "one", "powers", "none"])
@pytest.mark.parametrize("n", [3, 500, 50_000])
def test_plan_places_every_item_once(kind, n):
    rng = np.random.default_rng(n)
    sizes = {
        "exponential": np.clip(rng.exponential(300, n).astype(int), 1, 2047), "large": rng.integers(1025, 2048, n), "uniform": rng.integers(1, 2048, n), "few": rng.choice([1500, 700, 300], n),
        "one": np.full(n, 1), "powers": rng.choice([512, 1024], n), "none": np.zeros(0, dtype=int),
    }[kind]
    counts = np.bincount(sizes, minlength=2048)
    places = P.Places(counts, 100)
    held = {}
    for size in np.flatnonzero(counts):
        for rank in range(counts[size]):
            pieces = places.of(int(size), rank)
            assert sum(p[1] for p in pieces) == size and [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]]
            for _, length, sequence, offset in pieces:
                held.setdefault(sequence, []).append((offset, length))
    assert sorted(held) == list(range(100, places.sequences)) if len(sizes) else not held
    lengths = []
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= 2048
        lengths.append(int(ends[-1]))
    assert padded(lengths) == places.padding <= 0.02 * max(1, sizes.sum())
    if kind in ("exponential", "uniform") and n >= 50_000:
        assert places.padding <= 0.002 * sizes.sum() and places.taken != [0] * 2048


def test_linear_program_improves_on_the_greedy_plan():
    """The greedy plan sets 520 beside 1028 and pads 500; 1028 + 516 + 504 and 2 (520 + 504) pad nothing."""
    counts = np.zeros(2048, dtype=np.int64)
    counts[[1028, 520, 516, 504]] = 600, 600, 600, 1200
    price = lambda plan: sum(P.cost(P.filled(p)) * x for p, x in plan)
    tokens = int((counts * np.arange(2048)).sum())
    assert price(P.greedy(counts)) > 1.1 * tokens
    found = P.linear_program(counts)
    assert price(found) <= tokens * (1 + P.ENOUGH)
    for s in (1028, 520, 516, 504):
        assert sum(x * p.get(s, 0) for p, x in found) == pytest.approx(counts[s])
    whole, rest = P.plan(counts)
    assert price(whole) == tokens and not rest.any()


def test_knapsack_finds_the_most_valuable_filling():
    sizes, value = np.array([3, 5, 7]), np.array([3.1, 5.4, 6.9])
    best = P.fillings(sizes, value * 2, 12, 3)[0]
    assert best in ({5: 1, 7: 1}, {3: 4}, {5: 2}) and sum(value[list(sizes).index(s)] * n for s, n in best.items()) == pytest.approx(max(12.4, 12.3, 10.8))
