import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from packetsieve.llm import collocations as co
from packetsieve.llm.bloom import bloom_of

LETTERS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, longest=3, least=10, percent=50, top=2000):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, ws), a in candidates.items():
        cuts = [(1000000 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        inside = lambda long: any(long[i : i + len(ws)] == ws for i in range(len(long) - len(ws) + 1))
        if any(g == lang and len(long) > len(ws) and inside(long) and 100 * f >= percent * a for (g, long), f in candidates.items()):
            continue
        out.append((lang, -score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    rank, result = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, l, r, words[lang], -score))
    return result


@pytest.fixture
def odd_rows(prose):
    rows = [(i, prose(300, i % 7), ["en", "fr", None, "und", ""][i % 5]) for i in range(40)]
    rows += [(50, None, "en"), (51, "", None), (52, "New York. New\tYork, NEW  york!\x0bÉcole école New\x0cYork " * 6, "en")]
    rows += [(53, "x" * 70000 + " y " + "x" * 70000 + " y", "en")] * 10 + [(None, "a b c a b c, a b", None)] * 6
    return rows + [(60, prose(20000, 99), "de"), (61, "...,,,   \t\n", "de")]


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_on_odd_rows(spark, docs_of, odd_rows):
    assert result(co.collocations(docs_of(odd_rows))) == sorted(brute(odd_rows))
    assert co.collocations(docs_of([])).count() == 0


def test_other_lengths_and_small_buffers(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(co, "HELD_KEYS", 500)
    monkeypatch.setattr(co, "HELD_PHRASES", 50)
    monkeypatch.setattr(co, "SLICE_BYTES", 3000)
    rows = odd_rows[:30] + odd_rows[42:43]
    got = co.collocations(docs_of(rows, odd=False), longest=4, least=4, percent=70, top=30)
    assert result(got) == sorted(brute(rows, 4, 4, 70, 30))


def test_colliding_fingerprints_change_nothing(odd_rows, monkeypatch):
    """Fingerprints of 6 bits: nearly all phrases collide, and the counts stay those of the texts."""
    few = co.mix
    monkeypatch.setattr(co, "mix", lambda keys: few(few(keys) & np.uint64(63)))
    phrases = {}
    lowered = [(t or "").translate(LETTERS) for _, t, _ in odd_rows[:20]]
    langs = ["und" if g is None else g for _, _, g in odd_rows[:20]]
    data = np.frombuffer("".join(lowered).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in lowered])])
    held = co.Words(data, offsets)

    class Everything:
        def has(self, keys):
            return np.ones(len(keys), dtype=bool)

    batch = co._phrases(held, 2, co._salts(langs), Everything(), pa.array(langs), pa.array(range(20), pa.int64()))
    for lang, phrase, a in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
        phrases[lang, phrase] = phrases.get((lang, phrase), 0) + a
    want = Counter()
    for text, lang in zip(lowered, langs):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = piece.split()
            want.update((lang, f"{x} {y}") for x, y in zip(ws, ws[1:]))
    assert phrases == want and len(want) > 64


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 1, "x", big), ("en", 1, "y", big + 7), ("en", 2, "x y", big - 5)]
    phrases = spark.createDataFrame(rows, "lang string, n int, phrase string, a long")
    got = co.scored_phrases(phrases).first()
    assert got["score"] == 1000000 * (big - 5) ** 2 // (big * (big + 7))


def test_bloom_filter_holds_all_keys(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 300_000).astype(np.uint64)
    rows = [(part.tobytes(),) for part in np.array_split(keys, 7)] + [(b"",)]
    held = bloom_of(spark.createDataFrame(rows, "keys binary"))
    assert held.has(keys).all()
    assert held.has(keys + np.uint64(1)).mean() < 0.01


def test_same_bytes_compares_whole_runs():
    data = np.frombuffer(b"abcdefghijkl abcdefghijkX abcdefghijkl", dtype=np.uint8)
    a, b = np.array([0, 0, 0, 5]), np.array([13, 26, 13, 31])
    assert co.same_bytes(data, a, b, np.array([12, 12, 11, 7])).tolist() == [False, True, True, True]


def test_phrases_are_added_up_within_a_task(monkeypatch):
    monkeypatch.setattr(co, "HELD_PHRASES", 50)
    rows = [(["en", "fr"][i % 2], 1 + i % 3, f"p{i * i % 97}" if i % 5 else None, i, None if i % 7 == 0 else i) for i in range(3000)]
    batches = [co._row_batch(*(pa.array(c, t) for c, t in zip(zip(*rows[i : i + 40]), [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]))) for i in range(0, 3000, 40)]
    got, want = Counter(), Counter()
    for batch in co._summed(iter(batches)):
        for lang, n, phrase, a in zip(*(batch.column(i).to_pylist() for i in range(4))):
            got[lang, n, phrase] += a
    for lang, n, phrase, a, _ in rows:
        want[lang, n, phrase] += a
    assert got == want
