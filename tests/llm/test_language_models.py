import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetsieve.llm import ctw, quality
from packetsieve.llm import kneser_ney as kneser_ney_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, order):
    b = b"\xff" * (order - 1) + (text or "").translate(LOWER).encode() + b"\xff"
    return [b[i : i + order] for i in range(len(b) - order + 1)]


def odd_documents(prose):
    rows = [(i, prose(60, i), "ab"[i % 2]) for i in range(20)]
    rows += [(30, "word " * 40), (31, None), (32, ""), (33, prose(19, 1)), (34, prose(60, 2) + " ###" * 60, "a"), (None, prose(50, 9), None)]
    rows += [(35, "same line here\n" * 3 + prose(30, 4)), (35, "same line here\n" * 3 + prose(30, 4)), (36, prose(40, 5) + "\x00 <b> &amp;")]
    return rows + [(37, prose(30000, 6)), (38, "\n\n a \n\nb\n a \n")]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_counts_and_verdicts(spark, docs_of, prose):
    rows = odd_documents(prose)
    got = quality.quality(docs_of(rows)).collect()
    assert len(got) == len(rows)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    seen = sorted(((r["doc_id"], *(r[f] for f in fields), r["base_failed"]) for r in got), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        n = base(text)
        expected.append((doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert seen == sorted(expected, key=str)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i in (30, 31, 32, 33, 34)) and all(kept[i] for i in range(20))


def test_kept_documents_keep_their_columns(spark, docs_of, prose):
    docs = docs_of(odd_documents(prose))
    out = quality.kept_documents(docs)
    assert out.schema == docs.schema
    assert {r["doc_id"] for r in out.collect()} >= set(range(20))
    assert quality.kept_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("copies", [7, 33])
def test_copies_count_once(spark, docs_of, prose, copies):
    clean = [(i, prose(60, i)) for i in range(60)]
    once = {r["doc_id"]: r for r in quality.quality(docs_of(clean)).collect()}
    many = quality.quality(docs_of(clean + [(200 + i, clean[3][1]) for i in range(copies)])).collect()
    assert len(many) == len(clean) + copies
    for r in many:
        expected = once[r["doc_id"] if r["doc_id"] < 200 else 3]
        assert [r[c] for c in ("lower", "upper", "log10_ppl")] == pytest.approx([expected[c] for c in ("lower", "upper", "log10_ppl")])
        assert r["kept"] == expected["kept"]


def test_junk_beside_clean_texts_is_rejected(spark, docs_of):
    r = random.Random(4)
    kinds = {"en": ["the", "of", "and", "ing", "ra", "mo", "te", "lin"], "de": ["ch", "sch", "ung", "ei", "ber", "zu", "ö", "pf"]}
    follow = {}
    for lang, parts in kinds.items():  # every word has two that may follow it
        known = ["".join(r.choice(parts) for _ in range(r.randint(1, 2))) for _ in range(40)]
        follow[lang] = {w: (r.choice(known), r.choice(known), r.choice(known)) for w in known}

    def text(lang):
        out = [r.choice(list(follow[lang]))]
        while len(out) < 120:
            out.append(r.choice(follow[lang][out[-1]]))
        return " ".join(out)

    lines = lambda x: "\n".join(x[i : i + 12] for i in range(0, 480, 12))
    clean = [(i, text(lang), lang) for i, lang in enumerate(["en"] * 150 + ["de"] * 80)]
    clean = [c for c in clean if base(c[1])[4] * 100 <= 30 * 120]
    junk = []
    for _ in range(2):
        junk.append(lines(base64.b64encode(r.randbytes(480)).decode()))
        junk.append(lines(r.randbytes(480).hex()))
        junk.append(" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(120)))
        junk.append(" ".join(r.sample(text("en").split(" "), 120)))
        junk.append(text("de"))
    rows = quality.quality(docs_of(clean + [(1000 + i, x) for i, x in enumerate(junk)])).collect()
    assert not any(x["base_failed"] for x in rows)
    kept = {x["doc_id"] for x in rows if x["kept"]}
    assert not kept & set(range(1000, 1010))
    assert len(kept) >= 0.97 * len(clean)


def kneser_ney(texts, order):
    types = {order: Counter(g for t in texts for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        types[k] = Counter(g[1:] for g in types[k + 1])
    cut, total, gamma = {}, {}, {}
    for k, t in types.items():
        n = [sum(c == i for c in t.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
        cut[k] = [min(i - 0.01, max(0.1, d)) for i, d in enumerate(raw, 1)]
        total[k], gamma[k] = Counter(), defaultdict(float)
        for g, c in t.items():
            total[k][g[:-1]] += c
            gamma[k][g[:-1]] += cut[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 257
        below = p(g[1:])
        if g[:-1] not in total[k]:
            return below
        c = types[k].get(g, 0)
        own = (c - cut[k][min(c, 3) - 1]) if c else 0.0
        return (own + gamma[k][g[:-1]] * below) / total[k][g[:-1]]

    return p


@pytest.mark.parametrize("bound", [kneser_ney_model.MODEL_ROWS, 300])
def test_perplexity_equals_brute_force_also_on_new_texts(spark, docs_of, prose, monkeypatch, bound):
    monkeypatch.setattr(quality, "MODEL_ROWS", bound)
    train = [(i, prose(40, i)) for i in range(10)]
    new = [(50, prose(30, 77) + " Zyx\x00q"), (51, None), (51, None)]
    model = quality.fit_kneser_ney(docs_of(train), 4)
    p = kneser_ney([t for _, t in train], 4)
    got = quality.perplexity(docs_of(train + new), model).collect()
    assert len(got) == 13
    expected = {i: sum(math.log10(p(g)) for g in grams(t, 4)) for i, t in train + new}
    for r in got:
        assert r["log10_prob"] == pytest.approx(expected[r["doc_id"]], rel=1e-5)


EDGES = {0xFF, 0xFE, 0x20, *range(0x09, 0x0E)}


SYMBOLS = [0xC0, 0xC1, *range(0xF5, 0xFD)]


def in_context(text, lang, depth):
    """Each symbol after the start, with the bytes before it back to the last white space (or the start), and the language."""
    s = [0xFF, *(text or "").translate(LOWER).encode(), 0xFE]
    for i in range(1, len(s)):
        first = i - 1
        while s[first] not in EDGES:
            first -= 1
        yield bytes([SYMBOLS[zlib.crc32((lang or "").encode()) % 10], *s[first:i]])[-depth:], s[i]


def context_tree(texts, depth):
    counts = defaultdict(lambda: [0, 0])
    for t, lang in texts:
        for context, byte in in_context(t, lang, depth):
            for j in range(8):
                node = (1 << j) | (byte >> (8 - j))
                for d in range(len(context) + 1):
                    counts[context[len(context) - d :], node][byte >> (7 - j) & 1] += 1
    below = defaultdict(list)
    for context, node in counts:
        if context:
            below[context[1:], node].append((context, node))
    weighted, stop, kt = {}, {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        a, b = counts[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        kt[key] = (b + 0.5) / (a + b + 1)
        if len(key[0]) == depth or key[0] and key[0][0] in SYMBOLS:
            weighted[key], stop[key] = own, 1.0
        else:
            rest = sum(weighted[k] for k in below[key])
            top = max(own, rest)
            weighted[key] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(rest - top))
            stop[key] = 0.5 * math.exp(own - weighted[key])

    def log10(text, lang):
        total = 0.0
        for context, byte in in_context(text, lang, depth):
            for j in range(8):
                node, one, left, last = (1 << j) | (byte >> (8 - j)), 0.0, 1.0, 0.5
                for d in range(len(context) + 1):
                    key = context[len(context) - d :], node
                    if key not in kt:
                        break
                    last = kt[key]
                    one += left * stop[key] * last
                    left *= 1 - stop[key]
                one += left * last
                total += math.log10(one if byte >> (7 - j) & 1 else 1 - one)
        return total

    return log10


@pytest.mark.parametrize(("depth", "head", "bound"), [(7, ctw.HEAD_WORDS, ctw.MODEL_ROWS), (7, 40, 2000), (3, 40, 500), (5, 0, 10**6)])
def test_scores_equal_brute_force(spark, docs_of, prose, monkeypatch, depth, head, bound):
    monkeypatch.setattr(ctw.unit_scores, "__defaults__", (bound,))
    monkeypatch.setattr(ctw, "BUCKET_BYTES", 1 << 10)
    rows = odd_documents(prose)[:-2] + [(60, "Zq\x00 ÿ new"), (60, "Zq\x00 ÿ new"), (61, " \n\t a\x0b\x0c  b " + "long" * 20 + "\r")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    out = ctw.lm_scores(docs_of(rows), F.crc32(F.col("doc_id").cast("string")) % 3 == 1, depth, head, head).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    train = Counter(x for i, t, *_ in rows if not held(i) for x in tokens(t))
    n, v = sum(train.values()), len(train)
    rows = [(*r, "en")[:3] for r in rows]
    log10 = context_tree([(t, g) for i, t, g in rows if not held(i)], depth)
    expected = {}
    for i, t, g in rows:
        x = tokens(t)
        expected[i, len(x)] = (held(i), sum(train[w] > 0 for w in x), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), log10(t, g))
    for r in out:
        e = expected[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == e[:3]
        assert r["base_score"] == pytest.approx(e[3], abs=1e-6)
        assert r["score"] == pytest.approx(e[4], rel=1e-9)


def test_nothing_to_learn_from(spark, docs_of):
    out = ctw.lm_scores(docs_of([(1, "ab"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["score"], 6)) for r in out) == [
        (1, 0, 0, round(-8 * math.log10(2), 6)), (2, 0, 0, round(-24 * math.log10(2), 6))
    ]
    assert ctw.lm_scores(docs_of([]), F.lit(False)).count() == 0


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.5, 40.5, 1e6 + 0.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ctw.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-9)


def test_both_sides_of_the_band_reject(spark, docs_of, prose):
    r = random.Random(8)
    clean = [(i, prose(80, i)) for i in range(240)]
    licence = prose(90, 4711).split(" ")
    boilerplate = []
    for i in range(20):  # one text with three other words in each copy
        own = list(licence)
        for at in r.sample(range(90), 3):
            own[at] = r.choice(licence)
        boilerplate.append((1000 + i, " ".join(own)))
    junk = [(2000 + i, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80))) for i in range(5)]
    got = {x["doc_id"]: x for x in quality.quality(docs_of(clean + boilerplate + junk)).collect()}
    assert all(got[i]["lower"] > 0 for i in got)
    assert all(got[i]["log10_ppl"] < got[i]["lower"] and not got[i]["kept"] for i, _ in boilerplate)
    assert all(got[i]["log10_ppl"] > got[i]["upper"] and not got[i]["kept"] for i, _ in junk)
    assert sum(got[i]["kept"] for i, _ in clean) >= 0.98 * len(clean)
