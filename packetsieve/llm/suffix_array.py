"""Suffix arrays by induced sorting, and common prefixes in text order, for the text of one shard.

Suffixes are classified as smaller (S) or larger (L) than their successor. The
leftmost smaller (LMS) substrings are sorted by inducing, named, and sorted
recursively where names repeat; the order of the LMS suffixes then induces that
of all others. Both scans go bucket by bucket: what a bucket induces is spread
to the later buckets with one stable sort, so numpy does the work. Names of the
recursion have too many buckets for that and are induced in a plain loop. Common
prefixes are compared only where the text in front of two neighbours differs, and
follow from those everywhere else.
"""

from __future__ import annotations

import numpy as np

from .textbytes import U64, mix, powers

#: Up to so many symbols, a bucket is large enough to be worth numpy calls.
WIDE = 512


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last, a unique smallest symbol, is."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    smaller = np.append(text[:-1] < text[1:], True)
    where = np.where(differs, np.arange(n), n)
    return smaller[np.minimum.accumulate(where[::-1])[::-1]]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes in order. ``text`` ends with its only 0; all others are 1 to symbols - 1."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_wide if symbols <= WIDE else _induce_narrow
    if len(lms) > 1:
        order = induce(text, small, lms, symbols)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        sorted_lms = order[is_lms[order]]
        names, kinds = _names(text, lms, sorted_lms)
        if kinds < len(lms):
            lms = lms[suffix_array(names, kinds)]
        else:
            lms = sorted_lms
    return induce(text, small, lms, symbols)


def _names(text: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each LMS substring, in text order; equal substrings have equal numbers."""
    n = len(text)
    ahead = np.append(lms[1:] + 1, n)  # a substring includes the start of the next one
    end = np.zeros(n, dtype=np.int64)
    end[lms] = ahead
    base, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix(text.astype(U64) + U64(1)) * base[:n], out=sums[1:])
    stop = end[sorted_lms]
    hashes = (sums[stop] - sums[sorted_lms]) * inverse[sorted_lms]
    length = stop - sorted_lms
    new = np.append(False, (hashes[1:] != hashes[:-1]) | (length[1:] != length[:-1]))
    name = np.zeros(n, dtype=np.int64)
    name[sorted_lms] = np.cumsum(new)
    names = name[lms]
    return names, int(names.max()) + 1


def _bounds(text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(text, minlength=symbols)
    ends = np.cumsum(counts)
    return ends - counts, ends


def _place_lms(text: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes at the ends of their buckets, in the given order; and where these begin."""
    out = np.full(len(text), -1, dtype=np.int64)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    counts = np.bincount(text[lms], minlength=len(ends))
    tail = ends - counts
    out[np.repeat(tail, counts) + np.arange(len(lms)) - np.repeat(np.cumsum(counts) - counts, counts)] = by_symbol
    return out, tail


def _spread(out: np.ndarray, values: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put values into their buckets from ``at`` on (upwards or downwards), in their order."""
    order = np.argsort(symbols.astype(np.int16), kind="stable")  # up to WIDE symbols
    values, symbols = values[order], symbols[order]
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    sizes = np.diff(np.append(first, len(symbols)))
    within = np.arange(len(symbols)) - np.repeat(first, sizes)
    out[at[symbols] + step * within] = values
    at[symbols[first]] += step * sizes


def _induce_wide(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    starts, ends = _bounds(text, symbols)
    out, lms_from = _place_lms(text, lms, starts, ends)
    head = starts.copy()
    for c in range(symbols):
        if starts[c] == ends[c]:
            continue
        away, done = [], starts[c]
        while done < head[c]:  # what this bucket puts into itself is taken up in turn
            here = out[done : head[c]]
            done = head[c]
            before = here[here > 0] - 1
            before = before[~small[before]]
            own = text[before] == c
            away.append(before[~own])
            before = before[own]
            out[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        before = out[lms_from[c] : ends[c]]
        before = before[before > 0] - 1
        away.append(before[~small[before]])
        away = np.concatenate(away)
        if len(away):
            _spread(out, away, text[away], head, 1)
    tail = ends - 1
    for c in range(symbols - 1, -1, -1):
        if starts[c] == ends[c]:
            continue
        away, done = [], ends[c] - 1
        while done > tail[c]:
            here = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = here[here > 0] - 1
            before = before[small[before]]
            own = text[before] == c
            away.append(before[~own])
            before = before[own]
            out[tail[c] - len(before) + 1 : tail[c] + 1] = before[::-1]
            tail[c] -= len(before)
        before = out[starts[c] : head[c]][::-1]
        before = before[before > 0] - 1
        away.append(before[small[before]])
        away = np.concatenate(away)
        if len(away):
            _spread(out, away, text[away], tail, -1)
    out[0] = len(text) - 1
    return out


def _induce_narrow(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    starts, ends = _bounds(text, symbols)
    out = _place_lms(text, lms, starts, ends)[0].tolist()
    # The bucket that a suffix's predecessor is induced into, -1 for none; an empty place is -1 and reads the last entry.
    before = np.full(len(text) + 1, -1, dtype=np.int64)
    before[1:-1] = np.where(small[:-1], -1, text[:-1])
    to_head, head = before.tolist(), starts.tolist()
    for j in out:  # the list grows ahead of the loop
        c = to_head[j]
        if c >= 0:
            at = head[c]
            out[at] = j - 1
            head[c] = at + 1
    before[1:-1] = np.where(small[:-1], text[:-1], -1)
    to_tail, tail = before.tolist(), ends.tolist()
    for j in reversed(out):
        c = to_tail[j]
        if c >= 0:
            at = tail[c] - 1
            out[at] = j - 1
            tail[c] = at
    out[0] = len(text) - 1
    return np.array(out, dtype=np.int64)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """For each suffix in text order, how many symbols it shares with the one before it in ``order``.

    Lengths above ``longest`` count as ``longest``. Where a suffix and the one before
    it in order have the same symbol in front of them, the length is one less than
    that of the suffix one place ahead in the text. Only the others are compared;
    their lengths sum to n log n at most. All symbols are below 2^16.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = text[at[follows] - 1] == text[before[follows] - 1]
    own = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, dtype=np.int64)
    length[own] = _shared(text, own, before[own])  # whole, as the next lengths follow from them
    source = np.maximum.accumulate(np.where(follows, 0, at))
    length = np.where(follows, length[source] - (at - source), length)
    return np.minimum(length, longest)


#: Steps of four symbols after which the rest of a common prefix is found by halving.
STEPS = 64


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share; the last symbol of the text occurs once.

    Four symbols are compared a step. What is equal for long goes on with prefix
    hashes, in halving steps.
    """
    n = len(text)
    padded = np.zeros(n + 4, dtype="<u2")
    padded[:n] = text
    window = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(2,))
    out, todo = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for at in range(0, 4 * STEPS, 4):
        differ = window[a] ^ window[b]
        equal = differ == 0
        ended = differ[~equal]
        # The first of four symbols that differs: its bits are the lowest.
        first = (ended & U64(0xFFFF) == 0).astype(np.int64)
        first += ended & U64(0xFFFFFFFF) == 0
        first += ended & U64(0xFFFFFFFFFFFF) == 0
        out[todo[~equal]] = at + first
        todo, a, b = todo[equal], a[equal] + 4, b[equal] + 4
        if not len(todo):
            return out
    base, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix(text.astype(U64) + U64(1)) * base[:n], out=sums[1:])
    known, step = np.zeros(len(todo), dtype=np.int64), 1 << n.bit_length()
    while step:
        more = known + step
        fits = np.maximum(a, b) + more <= n
        end_a, end_b = np.where(fits, a + more, a), np.where(fits, b + more, b)
        same = (sums[end_a] - sums[a]) * inverse[a] == (sums[end_b] - sums[b]) * inverse[b]
        known = np.where(fits & same, more, known)
        step >>= 1
    out[todo] = 4 * STEPS + known
    return out


def repeated_starts(text: np.ndarray, order: np.ndarray, size: int, longest: int) -> np.ndarray:
    """Which positions start a substring of ``size`` symbols that starts at another position too."""
    shared = permuted_common_prefixes(text, order, longest)
    after = np.zeros(len(text), dtype=np.int64)
    after[order[:-1]] = shared[order[1:]]
    return np.maximum(shared, after) >= size
