import hashlib
import random
import re

import pytest

from packetsieve.llm import fingerprints, mixing
from packetsieve.llm.queries import MIX


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("size", [1 << 24, 3000])
def test_edited_neighbours(spark, docs_of, prose, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    rows = [(i, prose(200, i)) for i in range(0, 40, 2)] + [(1, None), (3, ""), (5, "two words"), (7, prose(200, 4)), (9, prose(20000, 1))]
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.edited_neighbours(docs_of(rows)).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(text, edited), abs=0.15)
        assert r["near_next"] == pytest.approx(jaccard(text, following), abs=0.15)
    assert got[7]["fingerprint"] == got[4]["fingerprint"] and got[1]["fingerprint"] == got[3]["fingerprint"] == ""
    plain = dict(fingerprints.fingerprints(docs_of(rows)).collect())
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_one_document_and_none_and_repeated_ids(spark, docs_of, prose):
    alone = fingerprints.edited_neighbours(docs_of([(4, prose(50, 1))])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.edited_neighbours(docs_of([])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x"), (None, "n"), (None, None)]
    assert fingerprints.edited_neighbours(docs_of(rows)).count() == 5


def labelled(spark, docs_of, prose):
    rows = [(i, prose(60, i) + (" vile slur" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300, None), (301, ""), (302, prose(20000, 3)), (None, prose(50, 5)), (303, prose(30, 6)), (303, prose(30, 7))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, 120)] + [(None, 1, 1), (5000, 1, 0), (7, 1, None)]
    return docs_of(rows), mixing.label_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_rates_meet_the_targets(spark, docs_of, prose):
    docs, labels = labelled(spark, docs_of, prose)
    rows = mixing.mixing_rates(docs, labels, MIX).collect()
    assert len(rows) == 205
    total = sum(r["n_tokens"] for r in rows)
    for domain, share in MIX.items():
        assert sum(r["rate"] * r["n_tokens"] * r["posteriors"][domain] for r in rows) == pytest.approx(share * total, abs=1e-3 * total)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(r["rate"] >= 0 and abs(sum(r["posteriors"].values()) - 1) < 1e-9 for r in rows)
    assert all((by_id[i]["posteriors"]["toxic"] > 0.5) == (i % 4 == 0) for i in range(120, 200))
    assert all(by_id[i]["copies"] >= 1 for i in range(120, 200) if i % 4)
    out = mixing.mixed(docs, labels, MIX)
    assert out.schema == docs.schema
    times = {}
    for r in out.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(times.get(i, 0) == r["copies"] for i, r in by_id.items() if i != 303)


def test_long_clean_texts_stay(spark, docs_of):
    r = random.Random(5)
    insults = [f"slur{i}" for i in range(40)]
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(300):
        own = [word() for _ in range(60)]
        if i % 3 == 0:
            own[10:18] = r.sample(insults, 8)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(word() for _ in range(40_000))) for i in range(4)]  # clean, and two of them labelled
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(1000, 0), (1001, 0)], "doc_id long, toxic int")
    by_id = {x["doc_id"]: x for x in mixing.mixing_rates(docs_of(rows), mixing.label_domains(labels), MIX).collect()}
    for i in range(1000, 1004):
        assert by_id[i]["posteriors"]["toxic"] < 0.01 and by_id[i]["rate"] >= 1 and by_id[i]["copies"] >= 1
    assert all((by_id[i]["posteriors"]["toxic"] > 0.5) == (i % 3 == 0) for i in range(300))


def test_no_labels_and_no_documents(spark, docs_of, prose):
    docs, labels = labelled(spark, docs_of, prose)
    rows = mixing.mixing_rates(docs, labels.limit(0), MIX).collect()
    assert {(r["rate"], r["copies"]) for r in rows} == {(1.0, 1)}
    assert mixing.mixing_rates(docs.limit(0), labels, MIX).count() == 0


def brute_posteriors(rows, labels, most=None):
    """Naive Bayes on the presence of words that tell more about the domain than chance."""
    import math
    import re

    domain = {}
    for doc_id, d in labels:
        if doc_id is not None and d is not None:
            domain[doc_id] = min(domain.get(doc_id, d), d)
    words_of = {}
    tokens = {}
    for doc_id, text in rows:
        key = doc_id if doc_id is not None else ("no id", text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words_of.setdefault(key, set()).update(w.lower() for w in ws)
        tokens[key] = tokens.get(key, 0) + len(ws)
    known = {k: domain[k] for k in words_of if k in domain}
    domains = sorted(set(known.values()))
    n = {d: sum(v == d for v in known.values()) for d in domains}
    total = sum(n.values())
    vocabulary = {w for k in known for w in words_of[k]}
    model = {}
    for w in vocabulary:
        has = {d: sum(w in words_of[k] for k, v in known.items() if v == d) for d in domains}
        found = sum(has.values())
        told = 0.0
        for d in domains:
            for cell, row in ((has[d], found), (n[d] - has[d], total - found)):
                told += cell * math.log(cell * total / (row * n[d])) if cell else 0.0
        if told >= math.log(len(vocabulary)):
            model[w] = [(has[d] + 0.5) / (n[d] + 1.0) for d in domains]
    out = {}
    for key, own in words_of.items():
        score = [math.log(n[d] / total) + sum(math.log(p[i] if w in own else 1 - p[i]) for w, p in model.items()) for i, d in enumerate(domains)]
        top = max(score)
        e = [math.exp(s - top) for s in score]
        out[key] = (tokens[key], {d: x / sum(e) for d, x in zip(domains, e)})
    return out


def test_posteriors_equal_brute_force(spark, docs_of, prose):
    rows = [(i, prose(40, i) + (" Vile SLUR\tvile" if i % 4 == 0 else " \n kind")) for i in range(160)]
    rows += [(300, None), (301, ""), (302, "  slur  "), (None, "vile slur none"), (None, "vile slur none"), (None, "other"), (303, "slur a"), (303, "SLUR kind b")]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 120)] + [(None, 1), (5000, 0), (7, None), (303, 1)]
    docs, table = docs_of(rows), mixing.label_domains(spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = brute_posteriors(rows, [(i, {0: "clean", 1: "toxic"}.get(t)) for i, t in labels])
    got = mixing.mixing_rates(docs, table, MIX).collect()
    assert len(got) == len(want)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for key, (n_tokens, posterior) in want.items():
        if isinstance(key, int):
            assert by_id[key]["n_tokens"] == n_tokens
            assert by_id[key]["posteriors"] == pytest.approx(posterior, abs=1e-9)
    none = sorted((r["n_tokens"], round(r["posteriors"]["toxic"], 9)) for r in got if r["doc_id"] is None)
    assert none == sorted((t, round(p["toxic"], 9)) for k, (t, p) in want.items() if not isinstance(k, int))
    out = mixing.mixed(docs, table, MIX)
    copies = {(r["doc_id"], r["n_tokens"]): r["copies"] for r in got}
    assert out.where("doc_id IS NULL AND text = 'other'").count() == copies[None, 1]
    assert out.where("doc_id IS NULL AND text LIKE 'vile%'").count() == 2 * copies[None, 6]


def test_the_classifier_learns_from_a_bounded_sample(spark, docs_of, prose):
    docs, labels = labelled(spark, docs_of, prose)
    few = mixing.learned_from(docs, labels, 50)
    assert few.select("doc_id").distinct().count() == 50
    assert {r["doc_id"] for r in few.collect()} <= {r["doc_id"] for r in mixing.learned_from(docs, labels, 100).collect()}


def test_least_squares_reaches_the_best_rates(spark):
    """Against projected gradients with small steps in numpy, also for targets out of reach."""
    import numpy as np

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 40)
    tokens = rng.integers(1, 50, 40)
    members = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "n_tokens long, posterior array<double>")
    a = (p * tokens[:, None]).T
    for target in ([300.0, 300.0, 300.0], [5000.0, 10.0, 10.0], [900.0, 0.0, 0.0]):
        steps, _, reached = mixing.fit_rates(members, target)
        rates = np.array([r[0] for r in members.select(mixing.rate(steps)).collect()])
        assert np.allclose(a @ rates, reached) and (rates >= 0).all()
        best = np.ones(40)
        for _ in range(20_000):
            best = np.maximum(0, best - a.T @ (a @ best - target) / np.linalg.norm(a, 2) ** 2)
        least = np.square(a @ best - target).sum()
        assert np.square(reached - np.array(target)).sum() <= least + 0.02 * np.square(a @ np.ones(40) - target).sum()
