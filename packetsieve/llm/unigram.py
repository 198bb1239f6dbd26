"""Unigram encoding and decoding: Viterbi over a double-array trie of scored pieces.

A text gets a leading space (the dummy prefix) and is cut into the pieces with
the largest sum of log scores. The trie is over UTF-8 bytes, with the white
space marker of the vocabulary stored as a space, so a marker that is literally
in a text matches nothing and survives. A code point that no piece covers costs
the smallest score less 10 and becomes one byte piece per byte.

The trie is walked from all starts at once, and the best path is found for all
units of a slice side by side. A unit is a run of spaces with what follows up
to the next space; ASCII characters that no piece has are units of their own.
No piece crosses these cuts (checked when the trie is built; otherwise a whole
text is one unit). Workers keep the units that they have encoded.

Log scores follow the vocabulary's order (Zipf's law), unless they are given.
Ties go to the longest last piece. Decoding joins the pieces' bytes and drops
the leading space; it returns every text exactly.

Defined cases: null and empty texts have no ids and decode to the empty text;
equal rows have equal ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LEADS, slices, text_bytes
from .unit_tokens import UnitCache, worker_cache

MARKER = "▁"
PENALTY = 10.0


class Vocabulary:
    """Pieces with log scores, and the double array over their bytes."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int]):
        """``pieces``: (id, piece, score); ``byte_ids``: the id of each of the 256 byte pieces."""
        raw = [(i, p.replace(MARKER, " ").encode(), s) for i, p, s in pieces if p]
        self.splits = not any(" " in p.lstrip(MARKER).replace(MARKER, " ") for _, p, _ in pieces)
        size = max([i for i, _, _ in raw] + list(byte_ids.values())) + 1
        self.scores = np.zeros(size)
        self.texts: list[bytes] = [b""] * size
        for i, b, s in raw:
            self.scores[i], self.texts[i] = s, b
        for b, i in byte_ids.items():
            self.texts[i] = bytes([b])
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], dtype=np.int32)
        self.is_byte = np.zeros(size, dtype=bool)
        self.is_byte[self.byte_ids] = True
        self.unknown = min((s for _, _, s in raw), default=0.0) - PENALTY
        used = np.zeros(256, dtype=bool)
        for _, b, _ in raw:
            used[list(b)] = True
        #: Cut before a space that follows none, and around ASCII that no piece has.
        self.alone = ~used & (np.arange(256) < 0x80)
        self._build({b: i for i, b, _ in raw})
        ends = np.cumsum([len(t) for t in self.texts])
        self.flat = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.text_ends, self.text_sizes = ends, np.array([len(t) for t in self.texts])

    def _build(self, pieces: dict[bytes, int]) -> None:
        """Lay the trie out breadth first: the child of ``node`` by byte c is ``base[node] + c + 1``."""
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][c]
            ids[node] = i
        # the first places stay empty, so that every later one can be reached by every byte
        base, check, value = [0] * 257, [-2] * 257, [-1] * 257
        slot, free, front, queue = {0: 0}, 257, 257, [0]
        for node in queue:
            below = sorted(children[node].items())
            if not below:
                continue
            while free < len(check) and check[free] != -1:
                free += 1
            at, tries = max(0, (free if len(below) == 1 else front) - below[0][0] - 1), 0
            while True:
                need = at + below[-1][0] + 2 - len(check)
                if need > 0:
                    base += [0] * need
                    check += [-1] * need
                    value += [-1] * need
                if all(check[at + c + 1] == -1 for c, _ in below):
                    break
                tries += 1
                at += 1
                if tries % 16 == 0:  # dense up to here: this and later nodes go further on
                    at += 64 * tries
                    front = max(front, at)
            base[slot[node]] = at
            for c, child in below:
                place = at + c + 1
                check[place], value[place] = slot[node], ids[child]
                slot[child] = place
                queue.append(child)
        pad = 257
        self.base = np.array(base + [0] * pad, dtype=np.int32)
        self.check = np.array(check + [-1] * pad, dtype=np.int32)
        self.value = np.array(value + [-1] * pad, dtype=np.int32)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, and the first of each text (n + 1)."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if self.splits and len(data):
            space, alone = data == 0x20, self.alone[data]
            cut[1:-1] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        edges = np.flatnonzero(cut)
        starts = edges[:-1]
        return starts, edges[1:], np.searchsorted(starts, offsets)

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the given units, and all their ids: the Viterbi paths."""
        size = ends - starts
        own_end = np.cumsum(size)
        own = own_end - size
        text = data[np.arange(own_end[-1]) + np.repeat(starts - own, size)]
        unit = np.repeat(np.arange(len(size)), size)
        first, last, piece = self._matches(text, unit, own_end)
        score = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown)
        # by end in the unit, then by end, then the longest first
        relative = last - own[unit[first]]
        order = np.lexsort((first, last, relative))
        first, last, piece, score, relative = (x[order] for x in (first, last, piece, score, relative))
        # a path's value at a place: node 0 of each unit has an entry of its own, so places are shifted by the unit
        best = np.full(len(text) + len(size), -np.inf)
        best[own + np.arange(len(size))] = 0.0
        via = np.zeros(len(text) + len(size), dtype=np.int64)
        shift = unit[first]
        begin, end = first + shift, last + shift
        groups = np.flatnonzero(np.append(True, relative[1:] != relative[:-1]))
        for a, b in zip(groups.tolist(), np.append(groups[1:], len(relative)).tolist()):
            value = best[begin[a:b]] + score[a:b]
            stop = end[a:b]
            runs = np.flatnonzero(np.append(True, stop[1:] != stop[:-1]))
            most = np.maximum.reduceat(value, runs)
            winner = np.flatnonzero(value == np.repeat(most, np.diff(np.append(runs, b - a))))
            winner = winner[np.append(True, stop[winner][1:] != stop[winner][:-1])]
            best[stop[winner]] = value[winner]
            via[stop[winner]] = winner + a
        # back from the ends
        place, live = own_end + np.arange(len(size)), np.arange(len(size))
        units, edges = [], []
        while len(live):
            edge = via[place]
            units.append(live)
            edges.append(edge)
            place = begin[edge]
            on = place > own[live] + live
            live, place = live[on], place[on]
        units, edges = np.concatenate(units), np.concatenate(edges)
        order = np.lexsort((first[edges], units))
        units, edges = units[order], edges[order]
        ids = piece[edges]
        bytes_of = np.where(ids >= 0, 1, last[edges] - first[edges])
        flat = np.repeat(ids, bytes_of)
        unknown = np.flatnonzero(flat < 0)
        if len(unknown):
            ends_of = np.cumsum(bytes_of)
            at = np.arange(len(flat)) + np.repeat(first[edges] - (ends_of - bytes_of), bytes_of)
            flat[unknown] = self.byte_ids[text[at[unknown]]]
        return np.bincount(units, weights=bytes_of, minlength=len(size)).astype(np.int64), flat.astype(np.int32)

    def _matches(self, text: np.ndarray, unit: np.ndarray, own_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (start, end, piece) in the units; -1 for a code point that no single piece covers."""
        lead = np.flatnonzero(LEADS[text])
        stop = own_end[unit]
        following = np.append(lead[1:], len(text))
        single_end = np.minimum(following, stop[lead])
        firsts, lasts, pieces = [], [], []
        at, node, place = lead, np.zeros(len(lead), dtype=np.int32), lead.copy()
        covered = np.zeros(len(text), dtype=bool)
        whole = np.zeros(len(text), dtype=np.int64)
        whole[lead] = single_end
        while len(at):
            child = self.base[node] + text[place] + 1
            on = self.check[child] == node
            at, node, place = at[on], child[on], place[on] + 1
            hit = self.value[node] >= 0
            firsts.append(at[hit])
            lasts.append(place[hit])
            pieces.append(self.value[node[hit]])
            covered[at[hit][place[hit] == whole[at[hit]]]] = True
            on = place < stop[at]
            at, node, place = at[on], node[on], place[on]
        alone = lead[~covered[lead]]
        firsts.append(alone)
        lasts.append(whole[alone])
        pieces.append(np.full(len(alone), -1, dtype=np.int32))
        return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(pieces).astype(np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with ids ``ids[at[i]:at[i + 1]]``, and their n + 1 offsets."""
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.arange(total) + np.repeat(self.text_ends[ids] - ends, sizes)]
        bounds = np.concatenate([[0], ends])[at]
        keep = np.ones(total, dtype=bool)
        some = at[1:] > at[:-1]
        keep[bounds[:-1][some]] = False  # the dummy prefix
        return data[keep], bounds - np.concatenate([[0], np.cumsum(some)])


def from_model(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model file, with scores by rank: ln of 1 / ((rank + 1) H)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    norm = np.log(np.sum(1.0 / np.arange(1, len(plain) + 1)))
    return Vocabulary([(i, model.id_to_piece(i), float(-np.log(r + 1) - norm)) for r, i in enumerate(plain)], byte_ids)


class UnigramEncoder:
    """Encodes slices of texts inside tasks."""

    def __init__(self, docs: DataFrame, vocabulary: Vocabulary):
        self.key = uuid.uuid4().hex
        self.sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @property
    def vocabulary(self) -> Vocabulary:
        return self.sent.value

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and their n + 1 offsets."""
        v = self.vocabulary
        some = np.diff(offsets) > 0
        bounds = offsets + np.concatenate([[0], np.cumsum(some)])
        spaced = np.full(bounds[-1], 0x20, dtype=np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.cumsum(some), np.diff(offsets))] = data
        return worker_cache(self.key, lambda: UnitCache(v.units, v.encode_new)).encode(spaced, bounds)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int) of every row."""
    encoder = UnigramEncoder(docs, vocabulary)
    slim = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(len(keep)))):
                ids, at = encoder.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(keep))], lists], [*keep, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``text`` from ``ids``; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    slim = encoded.select(*keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, offsets = sent.value.decode(lists.flatten().to_numpy(zero_copy_only=False), at)
            texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts.cast(pa.string())], [*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of every row: ``n_ids``, ``n_byte_ids``, ``ids_crc32`` (little-endian 32-bit ids), ``log_score``,
    and ``decoded_sha256`` of the text decoded from the ids."""
    encoder = UnigramEncoder(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(*text_bytes(batch.column(1))):
                v = encoder.vocabulary
                ids, at = encoder.encode(data, offsets)
                text, bounds = v.decode(ids, at)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(np.ascontiguousarray(text))
                edges, places = at.tolist(), bounds.tolist()
                total = np.concatenate([[0.0], np.cumsum(np.where(v.is_byte[ids], 0.0, v.scores[ids]))])
                n_bytes = np.concatenate([[0], np.cumsum(v.is_byte[ids])])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(at)),
                    pa.array(n_bytes[at[1:]] - n_bytes[at[:-1]]),
                    pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges, edges[1:])], pa.int64()),
                    pa.array(total[at[1:]] - total[at[:-1]]),
                    pa.array([hashlib.sha256(text[x:y]).hexdigest() for x, y in zip(places, places[1:])], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "log_score", "decoded_sha256"])

    schema = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, log_score double, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
