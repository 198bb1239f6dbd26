import re

import numpy as np
import pytest

from packetsieve.llm import setsketch
from packetsieve.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_force(rows, k, percent):
    sets = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for group in members.values():
        name = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), name, rows[i][0] == name) for i in group]
    return sorted(out, key=str)


def odd_documents(prose):
    rows = [(i, prose(60, i)) for i in range(6)]
    for i in range(6, 40):  # chains: each differs a little from the one before
        words = rows[i - 6][1].split(" ")
        words[(7 * i) % len(words)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(50, rows[3][1].upper()), (50, rows[3][1]), (51, None), (52, ""), (53, " \n"), (54, "one two"), (55, "ONE two"), (None, rows[0][1])]
    return rows + [(56, prose(30000, 3)), (57, prose(30000, 3) + " end")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs_of, prose, k, percent):
    rows = odd_documents(prose)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs_of(rows), k, percent).collect()]
    assert sorted(got, key=str) == brute_force(rows, k, percent)


def test_what_pivots_leave_is_compared_in_blocks(spark, docs_of, prose, monkeypatch):
    """With pivots that link nothing, all links come from the blocks of the buckets."""
    monkeypatch.setattr(setsketch, "PIVOTS", 0)
    monkeypatch.setattr(setsketch, "_verified", lambda pairs, found, percent: pairs.limit(0))
    seen = []
    left_over = setsketch._left_over
    monkeypatch.setattr(setsketch, "_left_over", lambda members, percent: seen.append(members.count()) or left_over(members, percent))
    rows = [(i, prose(120, i)) for i in range(3)]
    for i in range(3, 150):
        words = rows[i - 3][1].split(" ")
        words[(11 * i) % len(words)] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs_of(rows), 3, 85).collect()]
    assert sorted(got, key=str) == brute_force(rows, 3, 85)
    assert seen and seen[0] > 0


def test_buckets_of_unlinked_pairs_are_compared_once(spark, docs_of, prose, monkeypatch):
    """Texts that share bands without a link are verified once, and never come to the blocks."""
    pairs, crowds = [], []
    verified, left_over = setsketch._verified, setsketch._left_over
    monkeypatch.setattr(setsketch, "_verified", lambda p, found, percent: pairs.extend(map(tuple, p.collect())) or verified(p, found, percent))
    monkeypatch.setattr(setsketch, "_left_over", lambda members, percent: crowds.append(members.count()) or left_over(members, percent))
    rows = []
    for i in range(20):
        words = prose(120, i).split(" ")
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"new{i}" if j in (20, 50, 80, 110) else w for j, w in enumerate(words)))]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs_of(rows), 3, 85).collect()]
    assert sorted(got, key=str) == brute_force(rows, 3, 85)
    assert pairs and len(pairs) == len(set(pairs)) and not crowds
    assert all(r[0] == r[2] for r in got)


def test_one_of_each_keeps_columns(spark, docs_of, prose):
    docs = docs_of([(3, prose(50, 1)), (2, prose(50, 1)), (2, prose(50, 1)), (4, prose(50, 2)), (5, None)])
    out = setsketch.one_of_each(docs)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4, 5]


def test_one_of_each_keeps_unlike_texts_with_null_and_repeated_ids(spark, docs_of, prose):
    texts = [prose(50, i) for i in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0])] + [(7, t) for t in texts[6:9]] + [(7, texts[6])]
    rows += [(8, texts[9]), (None, texts[9]), (9, texts[10]), (None, None), (None, ""), (10, " "), (10, None)]
    out = setsketch.one_of_each(docs_of(rows))
    expected = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:9]] + [(8, texts[9]), (9, texts[10])]
    expected += [(None, None), (None, ""), (10, " "), (10, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(expected, key=str)


def test_no_documents(spark, docs_of):
    assert setsketch.near_duplicates(docs_of([])).count() == 0


def test_estimate_follows_similarity_and_registers_merge():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (0, 500, 900):
        a, b = pool[:1000], pool[1000 - shared : 2000 - shared]
        at = np.array([0, 1000])
        x, y = setsketch.registers(np.sort(a), at), setsketch.registers(np.sort(b), at)
        size = np.array([1000.0])
        assert abs(setsketch.estimate(x, y, size, size)[0] - shared / (2000 - shared)) < 0.15
        union = np.unique(np.concatenate([a, b]))
        assert (setsketch.registers(union, np.array([0, len(union)])) == np.maximum(x, y)).all()


def test_bands_catch_pairs_at_the_threshold():
    assert [setsketch.band_width(p) for p in (80, 85)] == [4, 5]
    assert all(setsketch.missed(p, setsketch.band_width(p)) < 1e-6 for p in (50, 80, 85, 95))
    assert setsketch.missed(80, 5) > 1e-5
    # measured agreement of sets at 0.80, one inside the other
    values = np.random.default_rng(3).integers(1, 1 << 62, 400).astype(np.uint64)
    shares = []
    for i in range(60):
        own = np.sort(values * np.uint64(2 * i + 1))
        sketch = setsketch.registers(np.concatenate([own, own[:320]]), np.array([0, 400, 720]))
        shares.append((sketch[0] == sketch[1]).mean())
    assert abs(np.mean(shares) - 0.804) < 0.02


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)}
