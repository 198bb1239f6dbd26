import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from packetsieve.llm import rans, token_counts, unigram
from packetsieve.llm.queries import vocabulary
from packetsieve.llm.unit_tokens import UnitTokenizer, encoded_units

TEXTS = ["Don't stop—it's 3,000.5% of a1b2c3!", "<|endoftext|> x<|ENDOFTEXT|>y a|b", "naïve café école   tab\there", "日本語 🎉🎉 ΣΊΣΥΦΟΣ", "a▁b ▁  c", "\x00\n\r\n"]


def odd_documents(prose):
    rows = [(i, prose(50, i)) for i in (9, 3, 7)] + [(20 + i, t) for i, t in enumerate(TEXTS)]
    return rows + [(40, None), (41, ""), (42, prose(30000, 5)), (43, "x" * 5000), (3, prose(10, 3)), (None, "no id")]


def test_token_files_hold_what_the_tokenizer_gives(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(rans, "FILE_TOKENS", 3000)
    path = vocabulary("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = odd_documents(prose)
    got = rans.token_file_digests(docs_of(rows), path, 2).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    expected, start = {}, 0
    for doc_id, text in rows:
        e = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.setdefault(doc_id, []).append((len(e), zlib.crc32(e.tobytes())))
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        expected[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(expected.values())
    assert rans.token_file_digests(docs_of([]), path, 2).count() == 0


def test_rare_units_are_encoded_in_tasks(spark, docs_of, prose):
    path = vocabulary("word_bpe_49k.json")
    texts = [t for _, t in odd_documents(prose) if t]
    tokens = UnitTokenizer(path, spark, encoded_units(docs_of(list(enumerate(texts))), path), head_units=20)
    model = Tokenizer.from_file(path)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    for _ in range(2):
        ids, at = tokens.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_round_trip_and_damage_is_found():
    rng = np.random.default_rng(1)
    for n in (1, 31, 8192, 8193, 3 * rans.BLOCK + 5):
        ids = np.minimum(rng.geometric(0.01, n), 5000)
        table = rans.Frequencies(*np.unique(np.append(ids, 2), return_counts=True))
        content = rans.pack_file([1, None], np.array([n - 1, 1]), ids, table)
        names, lengths, back = rans.unpack_file(content, table)
        assert names == [1, None] and lengths.tolist() == [n - 1, 1] and (back == ids).all()
        for at in (3, 20, len(content) - 1):
            broken = bytearray(content)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                rans.unpack_file(bytes(broken), table)
        with pytest.raises(ValueError):
            rans.unpack_file(content[:-4], table)


@pytest.fixture(scope="module")
def pieces():
    return unigram.from_model(vocabulary("piece_bpe_32k.model"))


def viterbi(v, text):
    scores = {t: v.scores[i] for i, t in enumerate(v.texts) if t and not v.is_byte[i]}
    chars = [c.encode() for c in " " + text]
    best = [0.0] + [float("-inf")] * len(chars)
    for i in range(len(chars)):
        if chars[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + v.unknown)
        for j in range(i + 1, min(len(chars), i + 17) + 1):
            s = scores.get(b"".join(chars[i:j]))
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_unigram_paths_are_best_and_decode(spark, docs_of, prose, pieces):
    rows = odd_documents(prose)
    encoded = unigram.encode(docs_of(rows), pieces).collect()
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()): t for i, t in rows}
    trips = unigram.round_trip(docs_of(rows), pieces).collect()
    assert {(r["doc_id"], r["decoded_sha256"]) for r in trips} == set(texts) and len(trips) == len(rows)
    by_id = {}
    for r in encoded:
        by_id.setdefault(r["doc_id"], []).append(r["ids"])
    for doc_id, text in rows:
        if not text:
            assert by_id[doc_id] == [[]]
        elif len(text) < 3000 and len(by_id[doc_id]) == 1:
            ids = by_id[doc_id][0]
            starts = sum(bool(pieces.is_byte[i]) and pieces.texts[i][0] & 0xC0 != 0x80 for i in ids)
            score = sum(pieces.scores[i] for i in ids if not pieces.is_byte[i]) + pieces.unknown * starts
            assert score == pytest.approx(viterbi(pieces, text))
    back = unigram.decode(unigram.encode(docs_of(rows), pieces), pieces).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert unigram.round_trip(docs_of([]), pieces).count() == 0


def test_pieces_with_inner_spaces_take_whole_texts_as_units():
    byte_ids = {b: 10 + b for b in range(256)}
    v = unigram.Vocabulary([(0, "▁a", -1.0), (1, "▁a▁b", -1.5), (2, "▁b", -1.0)], byte_ids)
    assert not v.splits
    text = np.frombuffer(b" a b", dtype=np.uint8)
    starts, ends, _ = v.units(text, np.array([0, 4]))
    assert v.encode_new(text, starts, ends)[1].tolist() == [1]


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    files = {"a": [5, 5, 2, 2, 7, 2], "b": [2], "c": [1] * 100 + [2] + [3] * 50, "d": [9], "e": [4, 4, 2, 6]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    (tmp_path / "empty").write_bytes(b"")
    got = token_counts.count_tokens(spark, str(tmp_path), 2, block=block).collect()
    expected = {"a": [2, 0, 1], "b": [0], "c": [100, 50], "d": [1], "e": [2, 1]}
    assert sorted((r["name"], r["document"], r["n_tokens"]) for r in got) == [(f, i, n) for f in expected for i, n in enumerate(expected[f])]


def test_counts_of_documents(spark, docs_of, prose, pieces):
    rows = odd_documents(prose)
    got = token_counts.document_token_counts(docs_of(rows), pieces, 2).collect()
    trips = unigram.round_trip(docs_of(rows), pieces).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(((r["doc_id"], r["n_ids"]) for r in trips), key=key)
    assert token_counts.document_token_counts(docs_of([]), pieces, 2).count() == 0


def test_blocks_and_files_have_tasks_of_their_own(spark, tmp_path):

    from packetsieve.llm.storage import dealt

    ids = np.arange(36 * 512, dtype="<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    seen = tmp_path / "tasks"
    seen.mkdir()

    def scan(batches):
        from pyspark import TaskContext

        for batch in batches:
            (seen / str(TaskContext.get().partitionId())).touch()
            yield batch

    blocks = spark.createDataFrame([("a.bin", i) for i in range(36)], "name string, block long")
    assert dealt(blocks, "name", "block").mapInArrow(scan, "name string, block long").count() == 36
    assert len(list(seen.iterdir())) > 12
    got = token_counts.count_tokens(spark, str(tmp_path), 511, block=1024).agg({"n_tokens": "sum", "document": "count"}).first()
    assert got["sum(n_tokens)"] == len(ids) - 1 and got["count(document)"] == 2


def test_ties_go_to_the_longest_last_piece():
    pieces = [(0, "▁", -1.0), (1, "a", -1.0), (2, "b", -1.0), (3, "ab", -2.0), (4, "▁a", -2.0), (5, "bab", -3.0)]
    v = unigram.Vocabulary(pieces, {b: 10 + b for b in range(256)})
    size = {i: len(p) for i, p, _ in pieces}
    for text in ("a", "ab", "abab", "ba bab", "aabb abab b"):
        data = np.frombuffer((" " + text).encode(), dtype=np.uint8)
        starts, ends, _ = v.units(data, np.array([0, len(data)]))
        sizes, ids = v.encode_new(data, starts, ends)
        # from the end: of the pieces on a best path, the longest one
        chars = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e9] * len(chars)
        last = [None] * (len(chars) + 1)
        for j in range(1, len(chars) + 1):
            for i, p, s in pieces:
                at = j - len(p)
                if at >= 0 and chars[at:j] == p and (best[at] + s, size[i]) > (best[j], size.get(last[j], 0)):
                    best[j], last[j] = best[at] + s, i
        want, j = [], len(chars)
        while j:
            want.append(last[j])
            j -= size[last[j]]
        assert ids.tolist() == want[::-1] and sizes.sum() == len(want)
