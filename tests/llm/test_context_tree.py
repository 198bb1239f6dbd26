import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetsieve.llm import context_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYMBOLS = [0xC0, 0xC1, *range(0xF5, 0xFD)]
SPACE = {0x20, *range(0x09, 0x0E)}


def in_context(text, lang, depth):
    """Each byte and the end with the symbols before it; the language stands before the start and all white space."""
    symbol = SYMBOLS[zlib.crc32((lang or "").encode()) % 10]
    seen = [symbol, 0xFF]
    for byte in [*(text or "").translate(LOWER).encode(), 0xFE]:
        yield bytes(seen[-depth:]), byte
        seen += [symbol, byte] if byte in SPACE else [byte]


def context_tree_of(texts, depth):
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
        context = key[0]
        if len(context) == depth or len(context) > 1 and context[0] in SYMBOLS and context[1] == 0xFF:
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


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


@pytest.mark.parametrize(("depth", "head", "bound"), [(7, 1 << 19, 4_000_000), (7, 4, 2000), (3, 0, 300)])
def test_scores_equal_brute_force(spark, docs_of, prose, monkeypatch, depth, head, bound):
    monkeypatch.setattr(context_tree, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(context_tree, "HELD_KEYS", 1 << 10)
    rows = [(i, prose(60, i), "ab"[i % 2]) for i in range(16)]
    rows += [(30, "word " * 40), (31, None), (32, ""), (33, " "), (None, prose(50, 9), None), (34, "\x00" * 12 + " \x00"), (38, "\n\n a \n\nb\n a \n")]
    rows += [(35, "same line here\n" * 3 + prose(30, 4))] * 2
    rows += [(60, "Zq\x00 ÿ new"), (60, "Zq\x00 ÿ new"), (61, " \n\t a\x0b\x0c  b " + "long" * 20 + "\r")]
    out = context_tree.tree_scores(docs_of(rows), held_out(), depth, head, bound).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    train = Counter(x for i, t, *_ in rows if not held(i) for x in tokens(t))
    n, v = sum(train.values()), len(train)
    rows = [(*r, "en")[:3] for r in rows]
    log10 = context_tree_of([(t, g) for i, t, g in rows if not held(i)], depth)
    expected = {}
    for i, t, g in rows:
        x = tokens(t)
        expected[i] = (held(i), len(x), sum(train[w] > 0 for w in x), n, len((t or "").encode()) + 1), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), log10(t, g)
    for r in out:
        plain, base, score = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"]) == plain
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_texts_are_read_once_however_large_the_model(spark, docs_of, prose, monkeypatch):
    """Keys beyond the bound are joined by group; they bring no more passes over the texts."""
    monkeypatch.setattr(context_tree, "HELD_KEYS", 1 << 10)
    labels = []
    written = context_tree.written
    monkeypatch.setattr(context_tree, "written", lambda df, label: labels.append(label) or written(df, label))
    docs = docs_of([(i, prose(40, i)) for i in range(12)] + [(None, None), (90, ""), (3, "copy"), (3, "copy")])
    runs = []
    for bound in (1 << 20, 500, 0):
        labels.clear()
        rows = context_tree.tree_scores(docs, held_out(), bound=bound).select("doc_id", "n_bytes", "score").collect()
        runs.append((sorted(map(tuple, rows), key=str), list(labels)))
    whole, some, none = runs
    assert whole[1] == some[1] == none[1]
    for other in (some, none):
        assert [r[:2] for r in other[0]] == [r[:2] for r in whole[0]]
        assert [r[2] for r in other[0]] == pytest.approx([r[2] for r in whole[0]], rel=1e-9)


def test_words_are_predicted_from_the_word_before(spark, docs_of):
    """Contexts that end at white space cannot tell these texts apart."""
    train = [(i, "ab cd ab cd ef gh ef gh " * 5) for i in range(40) if not held(i)]
    texts = {i: t for i, t in zip((i for i in range(100, 200) if held(i)), ("ab cd ef gh", "ab gh ef cd"))}
    out = {r["doc_id"]: r["score"] for r in context_tree.tree_scores(docs_of(train + list(texts.items())), held_out()).collect()}
    usual, unusual = (out[i] for i in texts)
    assert usual > unusual + 2


def test_nothing_to_learn_from(spark, docs_of):
    out = context_tree.tree_scores(docs_of([(1, "ab"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["score"], 6)) for r in out) == [
        (1, 0, 0, round(-8 * math.log10(2), 6)), (2, 0, 0, round(-24 * math.log10(2), 6))
    ]
    assert context_tree.tree_scores(docs_of([]), F.lit(False)).count() == 0
