import hashlib
import zlib

from pyspark.sql import functions as F

from packetsieve.llm import merkle

LETTERS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    path = []
    for level in levels[:-1]:
        first = at - at % 8
        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 8])))
        at //= 8
    return path


def brute(rows):
    """Sorted results of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = levels_of([leaf_of(*r) for r in groups[lang]])
    top = levels_of([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, row in enumerate(groups[lang]):
            path = siblings(trees[lang], i) + siblings(top, k)
            node = leaf_of(*row)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            if changed and row[1] is not None:
                node = leaf_of(row[0], row[1].translate(LETTERS), *row[2:])
            copies = [node]
            for left, right in path:
                copies.append(H(left + copies[-1] + right))
            proof = H("".join(a + b for a, b in path))
            root = top[-1][0]
            out.append((row[0], leaf_of(*row), trees[lang][-1][0], root, proof, tuple(copies) if changed else None, copies[-1], copies[-1] == root))
    return sorted(out, key=repr)


def result(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "copied", "folded_root", "verified"]
    return sorted(((*(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)),) for r in df.collect()), key=repr)


def given(rows):
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]


def test_equals_brute_force_on_odd_rows(spark, docs_of, prose):
    rows = [(i * 3 % 1000, prose(5, i).upper(), ["en", "en", "en", "fr", "", None, "é"][i % 7]) for i in range(1000)]
    rows += [(5, None, "en"), (6, "", "en"), (None, "no id A", "en"), (None, "no id B", "en"), (7, "SAME", "en"), (7, "SAME", "en")]
    rows += [(8, prose(30000, 1), "one"), (9, "lone", "zz")]
    got = result(merkle.versions(docs_of(rows), merkle.changed_third()))
    assert got == brute(given(rows))
    assert not all(r[7] for r in got) and any(r[7] for r in got)
    assert merkle.versions(docs_of([]), merkle.changed_third()).count() == 0


def test_blocks_of_many_rounds(spark, docs_of, monkeypatch):
    """Blocks of 8 leaves: three rounds of blocks, and more languages than a block holds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    for n in (1, 8, 9, 65, 130):
        rows = [(i, f"Text {i}", "en") for i in range(n)] + [(1000 + i, "A", f"l{i:03d}") for i in range(20)]
        assert result(merkle.versions(docs_of(rows, odd=False), merkle.changed_third())) == brute(given(rows))


def test_untouched_trees_verify(spark, docs_of):
    rows = [(i, f"Text {i}", "en") for i in range(20)]
    got = merkle.versions(docs_of(rows)).collect()
    assert all(r["verified"] and r["copied"] is None for r in got)
    one = merkle.versions(docs_of(rows), F.col("doc_id") == 11).where("NOT verified").collect()
    assert [r["doc_id"] for r in one] == [11] and len(one[0]["copied"]) == 3


def test_versions_share_all_nodes_off_the_path():
    leaves = [H(str(i)).encode() for i in range(100)]
    tree = merkle.Tree(leaves, True)
    before = [list(level) for level in tree.levels]
    version = tree.version(42, H("new").encode())
    assert sorted(version) == [(0, 42), (1, 5), (2, 0), (3, 0)]
    changed = list(leaves)
    changed[42] = H("new").encode()
    whole = merkle.Tree(changed, True)
    for k, level in enumerate(whole.levels):
        assert [tree.node(version, k, i) for i in range(len(level))] == level
    assert tree.levels == before
