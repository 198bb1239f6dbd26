import hashlib
import random
import re

import numpy as np
import pytest

from packetsieve.llm import repeats
from packetsieve.llm.suffix_array import permuted_common_prefixes, suffix_array


@pytest.mark.parametrize("symbols", [1, 2, 5, 300, 5000])
def test_suffix_array_and_prefixes_equal_brute_force(symbols):
    for seed in range(40):
        r = random.Random(seed)
        text = [r.randint(1, symbols) for _ in range(r.randint(0, 60))] + [0]
        order = suffix_array(np.array(text), symbols + 1)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = permuted_common_prefixes(np.array(text), order, 1 << 20)
        for a, b in zip(order[:-1], order[1:]):
            m = 0
            while max(a, b) + m < len(text) and text[a + m] == text[b + m]:
                m += 1
            assert shared[b] == m


def brute_force(rows, size):
    raws = [(t or "").encode() for _, t in rows]
    times = {}
    for b in raws:
        for j in range(len(b) - size + 1):
            times[b[j : j + size]] = times.get(b[j : j + size], 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, raws):
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if times[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), len(b) - len(kept), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def odd_documents(prose):
    shared = prose(60, 99)
    rows = [(i, prose(40, i) + " " + shared[: 60 + 10 * i] + prose(30, 50 + i)) for i in range(8)]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (21, rows[0][1]), (None, rows[1][1][5:]), (22, None), (23, ""), (24, "ab" * 300)]
    return rows + [(25, "z" * 500), (26, prose(20000, 7) + shared), (27, "é" * 19), (28, shared[::-1] * 2)]


@pytest.mark.parametrize("group", [4096, 1])
def test_removal_equals_brute_force(spark, docs_of, prose, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = odd_documents(prose)
    got = [tuple(r) for r in repeats.removal_digests(docs_of(rows), size=40, k=12).collect()]
    assert sorted(got, key=str) == brute_force(rows, 40)


def test_texts_keep_whole_code_points_and_other_columns(spark, docs_of):
    passage = "ééééé" * 20
    docs = docs_of([(1, "a" + passage + "bc"), (2, "x" + passage), (3, None), (4, "clean and short")])
    out = repeats.without_repeats(docs, size=41, k=12)
    assert out.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["row_key"]) for r in out.collect()} == {
        1: ("abc", 3, "x"), 2: ("x", 1, "x"), 3: (None, None, "x"), 4: ("clean and short", 15, "x")
    }


def test_no_documents(spark, docs_of):
    assert repeats.removal_digests(docs_of([])).count() == 0
