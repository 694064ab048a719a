"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard in numpy.

Induced sorting (Nong, Zhang, Chan 2009): suffixes are larger or smaller than their right neighbour; a smaller one behind a larger one is leftmost. The substrings between leftmost
ones are sorted by inducing, named, and their names sorted by recursion; from the sorted leftmost suffixes all others follow in two linear passes. Over bytes a pass takes a bucket of
equal first letters at a time; names are many and their buckets small, so deeper levels go suffix by suffix.

A permuted common prefix (Kärkkäinen, Manzini, Puglisi 2009) is that of a suffix with the one before it in order, kept by position in the text. Where the letters before both agree it is one less
than its left neighbour's, so only the others are compared.
"""

from __future__ import annotations

import numpy as np

#: Suffixes to a bucket on average from which a pass takes whole buckets.
WHOLE_BUCKETS = 64


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; the last letter is the least and stands alone."""
    change = np.flatnonzero(s[1:] != s[:-1])
    return np.append(np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1)), True)


def _pushed(batch: np.ndarray, s: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left neighbours of a batch with greater letters, or with lesser ones; by letter and else in order; their letters, and their places among equal letters.

    A greater letter makes a suffix larger than its right neighbour, a lesser one smaller.
    """
    batch = batch[batch > 0]
    wanted = s[batch - 1] > s[batch] if up else s[batch - 1] < s[batch]
    left = batch[wanted] - 1
    letters = s[left]
    order = np.argsort(letters, kind="stable")
    left, letters = left[order], letters[order]
    first = np.flatnonzero(np.diff(letters, prepend=-1))
    return left, letters, np.arange(len(left)) - np.repeat(first, np.diff(first, append=len(left)))


def _with_runs(batch: np.ndarray, run: np.ndarray) -> np.ndarray:
    """A batch of one letter, then what it induces within its bucket: neighbours of the same letter to the left, nearer ones first."""
    more = run[batch]
    if not more.any():
        return batch
    step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.concatenate([batch, (np.repeat(batch, more) - step)[np.argsort(step, kind="stable")]])


def _induce_buckets(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray, tails: np.ndarray) -> None:
    """From leftmost suffixes at the ``tails`` of their buckets, the larger ones from left to right, then the smaller from right to left."""
    present, head, tail = np.flatnonzero(ends > starts), starts.copy(), ends.copy()
    at = np.arange(len(s))
    run = at - np.maximum.accumulate(np.where(np.diff(s, prepend=-1) != 0, at, 0))  # equal letters to the left

    for c in present:
        batch = _with_runs(sa[starts[c] : head[c]], run)
        head[c] = starts[c] + len(batch)
        sa[starts[c] : head[c]] = batch
        left, letters, place = _pushed(np.concatenate([batch, sa[tails[c] : ends[c]]]), s, True)
        sa[head[letters] + place] = left
        head += np.bincount(letters, minlength=len(head))
    tail[0] = 0  # the last letter, which nothing induces
    for c in present[::-1]:
        batch = _with_runs(sa[tail[c] : ends[c]][::-1], run)
        tail[c] = ends[c] - len(batch)
        sa[tail[c] : ends[c]] = batch[::-1]
        left, letters, place = _pushed(np.concatenate([batch, sa[starts[c] : head[c]][::-1]]), s, False)
        sa[tail[letters] - 1 - place] = left
        tail -= np.bincount(letters, minlength=len(tail))


def _induce_suffixes(s: np.ndarray, smaller: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """The same passes, a suffix at a time."""
    letters, small, out, head, tail = s.tolist(), smaller.tolist(), sa.tolist(), starts.tolist(), ends.tolist()
    for i in range(len(out)):
        j = out[i] - 1
        if j >= 0 and not small[j]:
            c = letters[j]
            out[head[c]] = j
            head[c] += 1
    tail[0] = 0
    for i in range(len(out) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and small[j]:
            c = letters[j]
            tail[c] -= 1
            out[tail[c]] = j
    sa[:] = out


def _induced(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost ones in an order; sorted as far as that order is."""
    ends = np.cumsum(counts)
    starts, sa = ends - counts, np.full(len(s), -1, np.int64)
    own = np.bincount(s[leftmost], minlength=len(counts))
    tails = ends - own
    order = np.argsort(s[leftmost], kind="stable")
    placed = leftmost[order]
    first = np.cumsum(own) - own
    sa[tails[s[placed]] + np.arange(len(placed)) - first[s[placed]]] = placed
    if len(s) >= WHOLE_BUCKETS * np.count_nonzero(counts):
        _induce_buckets(s, sa, starts, ends, tails)
    else:
        _induce_suffixes(s, smaller, sa, starts, ends)
    return sa


def _names(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Of the leftmost substrings in the order of the text, their ranks; equal ones share one."""
    length = np.zeros(len(s), np.int64)
    length[leftmost] = np.diff(leftmost, append=len(s) - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    a, b = a[same], b[same]
    sizes = length[a]
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    differ = s[np.repeat(a, sizes) + offset] != s[np.repeat(b, sizes) + offset]
    equal = np.zeros(len(same), bool)
    if len(a):
        equal[same] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
    rank = np.zeros(len(s), np.int64)
    rank[ordered] = np.concatenate([[0], np.cumsum(~equal)])
    return rank[leftmost]


def _sorted_suffixes(s: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffixes of ``s``, whose last letter is 0 and stands nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    smaller, counts = _smaller(s), np.bincount(s, minlength=alphabet)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    sa = _induced(s, smaller, leftmost, counts)
    ordered = sa[is_leftmost[sa]]
    names = _names(s, leftmost, ordered)
    if names.max() + 1 < len(names):
        ordered = leftmost[_sorted_suffixes(names, int(names.max()) + 1)]
    return _induced(s, smaller, ordered, counts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of an array of bytes in their order; of two, one the beginning of the other, the shorter comes first."""
    return _sorted_suffixes(np.append(text.astype(np.int64) + 1, 0), 257)[1:]


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each position, the letters that its suffix shares with the suffix before it in order; 0 for the first one."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(n)
    follows = (before > 0) & (at > 0)
    follows[follows] = text[at[follows] - 1] == text[before[follows] - 1]
    free = np.flatnonzero(~follows)
    prefix = np.zeros(n, np.int64)
    a = free[before[free] >= 0]
    b, longest = before[a], n - np.maximum(a, before[a])
    active, shared = np.arange(len(a)), np.zeros(len(a), np.int64)
    while len(active):
        differ = words[a[active] + shared[active]] ^ words[b[active] + shared[active]]
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        shared[active] += np.where(differ == 0, 8, lowest)
        active = active[(differ == 0) & (shared[active] < longest[active])]
    prefix[a] = np.minimum(shared, longest)
    nearest = np.maximum.accumulate(np.where(follows, 0, at))
    return prefix[nearest] - (at - nearest)


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each of its places the number of a group: suffixes of one group begin with the same ``length`` letters.

    A suffix shorter than that is a group of its own.
    """
    sa = suffix_array(text)
    shared = permuted_common_prefixes(text, sa)[sa]
    return sa, np.cumsum(shared < length)
