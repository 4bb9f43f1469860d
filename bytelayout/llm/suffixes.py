"""Sorting the suffixes of one text by two-stage sorting, with adjacent common prefixes.

A suffix that is smaller than its successor (the suffix one byte later) is sorted
directly. The others are induced: read in order, every suffix whose predecessor is not
smaller than itself puts that predecessor at the next free place of its first byte's
bucket. Within a bucket the induced suffixes come before the directly sorted ones.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes from every position as one big-endian number; zeros beyond the end."""
    wide = np.concatenate((text, np.zeros(pad + 8, np.uint8))).astype(np.uint64)
    two = (wide[:-1] << np.uint64(8)) | wide[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix; within a run of one byte the first other byte decides, and the end counts as smallest."""
    ends = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True])))
    after = np.concatenate((text[ends[:-1] + 1], [0]))
    decided = after > text[ends]
    decided[-1] = False
    return np.repeat(decided, np.diff(np.concatenate(([-1], ends))))


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes: 8 bytes first, then 5 more at a time where still equal."""
    if not len(places):
        return places
    key = words[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    done = 8
    new = np.concatenate(([True], key[1:] != key[:-1]))
    open_at = np.arange(len(places))
    while done < depth:
        # Keep what stands in a group of two or more.
        last = np.concatenate((new[1:], [True]))
        tied = ~(new & last)
        open_at = open_at[tied]
        if not len(open_at):
            break
        group = np.cumsum(new)[tied].astype(np.uint64)
        sub = places[open_at]
        key = (group << np.uint64(40)) | (words[sub + done] >> np.uint64(24))
        order = np.argsort(key)
        places[open_at], key = sub[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        done += 5
    return places


def sorted_suffixes(text: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Start of every suffix, in order of at least the first `depth` bytes of each."""
    size = len(text)
    if not size:
        return np.zeros(0, np.int64)
    direct = sort_directly(np.flatnonzero(smaller_than_successor(text)), words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([size - 1]))  # its successor is the empty suffix
    found = []
    for byte in np.unique(text).tolist():
        parts = induced[byte]
        newest = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts = [newest]
        while len(newest):  # runs of the byte itself
            before = newest[newest > 0] - 1
            newest = before[text[before] == byte]
            parts.append(newest)
        bucket = np.concatenate((*parts, direct[bounds[byte] : bounds[byte + 1]]))
        found.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for piece in np.split(before, cuts):
                induced[text[piece[0]]].append(piece)
        induced[byte] = []
    return np.concatenate(found)


def common_prefixes(suffixes: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, `depth` at most; 0 for the first."""
    shared = np.zeros(len(suffixes), np.int64)
    live = np.arange(1, len(suffixes))
    for at in range(0, depth, 8):
        differ = words[suffixes[live] + at] ^ words[suffixes[live - 1] + at]
        same = differ == 0
        if not same.all():
            parted = differ[~same]
            equal = np.zeros(len(parted), np.int64)
            for byte in range(1, 8):
                equal += parted >> np.uint64(64 - 8 * byte) == 0
            shared[live[~same]] = np.minimum(at + equal, depth)
        live = live[same]
    shared[live] = depth
    return shared
