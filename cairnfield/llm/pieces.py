"""A double-array trie of vocabulary pieces, and all pieces found in a batch of words at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import sentencepiece

MARK = "▁"  # the piece files write a space as this character
MARK_BYTES = MARK.encode()


@dataclass
class Vocabulary:
    pieces: list[str]  # by id
    normal: np.ndarray  # ids of ordinary pieces
    byte_ids: np.ndarray  # id of the piece of each byte, -1 where there is none
    file_scores: np.ndarray


def read_vocabulary(model: bytes) -> Vocabulary:
    """Pieces of a SentencePiece file; control, unknown, unused and byte pieces aren't ordinary ones."""
    reader = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = reader.vocab_size()
    byte_ids = np.full(256, -1, np.int64)
    for i in range(size):
        if reader.is_byte(i):
            byte_ids[int(reader.id_to_piece(i)[1:-1], 16)] = i
    plain = [i for i in range(size) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
    scores = np.array([reader.get_score(i) for i in range(size)])
    return Vocabulary([reader.id_to_piece(i) for i in range(size)], np.array(plain), byte_ids, scores)


@dataclass
class Trie:
    """State s goes by byte b to t = base[s] + b if check[t] = s; value[t] is the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int


def build_trie(pieces: Sequence[bytes], values: Sequence[int]) -> Trie:
    """Double array by first fit: states with most children first, those with one child fill what is left."""
    children: dict[bytes, set[int]] = defaultdict(set)
    for p in pieces:
        for i in range(len(p)):
            children[p[:i]].add(p[i])
    ends = dict(zip(pieces, values, strict=True))
    free = np.ones(2 * sum(map(len, children.values())) + 1024, bool)
    free[:256] = False  # so that no offset is negative
    offset: dict[bytes, int] = {}
    low = 256
    for prefix in sorted((p for p in children if len(children[p]) > 1), key=lambda p: (-len(children[p]), p)):
        codes = np.array(sorted(children[prefix]))
        low += int(free[low:].argmax())
        slot, window = low, 256
        while True:
            if slot + window + 512 > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            heads = slot + np.flatnonzero(free[slot : slot + window])
            fits = heads
            for c in codes[1:] - codes[0]:
                fits = fits[free[fits + c]]
            if len(fits):
                break
            slot, window = slot + window, 4 * window
        offset[prefix] = int(fits[0] - codes[0])
        free[offset[prefix] + codes] = False
    single = sorted(p for p in children if len(children[p]) == 1)
    for prefix, slot in zip(single, np.flatnonzero(free)[: len(single)].tolist(), strict=True):
        (code,) = children[prefix]
        offset[prefix] = slot - code
    size = max(offset.values(), default=0) + 512
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    state = {b"": 0}
    for prefix in sorted(children, key=len):
        here = state[prefix]
        base[here] = offset[prefix]
        for c in children[prefix]:
            word, there = prefix + bytes([c]), offset[prefix] + c
            check[there] = here
            state[word] = there
            value[there] = ends.get(word, -1)
    return Trie(base, check, value, max(map(len, pieces), default=0))


@dataclass
class Lattice:
    """Edges of all words: from node ``start`` to node ``end`` by ``piece`` (-1: a character no piece has by itself).

    Word w has the nodes ``nodes[w] .. nodes[w] + bytes``. Edges are ordered by distance of their end from the start
    of the word, then by end and start; ``cuts`` parts the distances.
    """

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    nodes: np.ndarray
    lengths: np.ndarray
    cuts: np.ndarray
    text: np.ndarray  # bytes of all words; word w begins at nodes[w] - w


def lattice(trie: Trie, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
    """All pieces in the words ``data[start:end]``, found from every character of every word in step."""
    lengths = ends - starts
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place in the word
    text = data[np.repeat(starts, lengths) + inner]
    rest = lengths[word] - inner
    nodes = np.cumsum(lengths + 1) - (lengths + 1)
    opening = (text & 0xC0) != 0x80  # first byte of a character
    opening |= inner == 0
    at = np.flatnonzero(opening)
    char = np.diff(np.append(at, total))  # bytes of each character
    state = np.zeros(len(at), np.int32)
    alone = np.zeros(len(at), bool)
    live = np.arange(len(at))
    found_at, found_len, found_piece = [], [], []
    for depth in range(trie.depth):
        live_at = at[live]
        inside = rest[live_at] > depth
        live, live_at = live[inside], live_at[inside]
        if not len(live):
            break
        state = state[inside]
        following = trie.base[state] + text[live_at + depth]
        good = trie.check[following] == state
        live, live_at, state = live[good], live_at[good], following[good]
        piece = trie.value[state]
        hit = piece >= 0
        if hit.any():
            found_at.append(live_at[hit])
            found_len.append(np.full(int(hit.sum()), depth + 1))
            found_piece.append(piece[hit])
            alone[live[hit]] |= char[live[hit]] == depth + 1
    lone = np.flatnonzero(~alone)
    found_at.append(at[lone])
    found_len.append(char[lone])
    found_piece.append(np.full(len(lone), -1, np.int32))
    f_at, f_len, f_piece = np.concatenate(found_at), np.concatenate(found_len), np.concatenate(found_piece)
    start = nodes[word[f_at]] + inner[f_at]
    end = start + f_len
    reach = inner[f_at] + f_len
    order = np.lexsort((start, end, reach))
    reach = reach[order]
    longest = int(lengths.max(initial=0))
    cuts = np.searchsorted(reach, np.arange(1, longest + 2))
    return Lattice(start[order], end[order], f_piece[order], nodes, lengths, cuts, text)


def _groups(end: np.ndarray) -> np.ndarray:
    new = np.ones(len(end), bool)
    new[1:] = end[1:] != end[:-1]
    return np.flatnonzero(new)


def best_paths(lat: Lattice, scores: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Highest-scoring segmentation of each word: its edges one after the other, and their offsets.

    Of equal scores the path whose last piece is longer wins.
    """
    best = np.zeros(int((lat.lengths + 1).sum()))
    via = np.full(len(best), -1, np.int64)
    gain = np.append(scores, unknown)[lat.piece]
    for a, b in zip(lat.cuts[:-1], lat.cuts[1:], strict=True):
        if a == b:
            continue
        heads = _groups(lat.end[a:b])
        value = best[lat.start[a:b]] + gain[a:b]
        top = np.maximum.reduceat(value, heads)
        sizes = np.diff(np.append(heads, b - a))
        first = np.where(value == np.repeat(top, sizes), np.arange(a, b), np.iinfo(np.int64).max)
        target = lat.end[a:b][heads]
        best[target] = top
        via[target] = np.minimum.reduceat(first, heads)
    node = lat.nodes + lat.lengths
    walking = np.flatnonzero(lat.lengths > 0)
    owner, taken = [], []
    while len(walking):
        edge = via[node[walking]]
        owner.append(walking)
        taken.append(edge)
        node[walking] = lat.start[edge]
        walking = walking[node[walking] > lat.nodes[walking]]
    if not owner:
        return np.zeros(0, np.int64), np.zeros(len(lat.nodes) + 1, np.int64)
    own, edge = np.concatenate(owner), np.concatenate(taken)
    order = np.lexsort((lat.start[edge], own))
    return edge[order], np.searchsorted(own[order], np.arange(len(lat.nodes) + 1))


def total_scores(lat: Lattice, log_probs: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word (rows) in each language (columns)."""
    alpha = np.zeros((int((lat.lengths + 1).sum()), log_probs.shape[1]))
    table = np.vstack([log_probs, unknown])
    for a, b in zip(lat.cuts[:-1], lat.cuts[1:], strict=True):
        if a == b:
            continue
        heads = _groups(lat.end[a:b])
        value = alpha[lat.start[a:b]] + table[lat.piece[a:b]]
        top = np.maximum.reduceat(value, heads, axis=0)
        sizes = np.diff(np.append(heads, b - a))
        summed = np.add.reduceat(np.exp(value - np.repeat(top, sizes, axis=0)), heads, axis=0)
        alpha[lat.end[a:b][heads]] = top + np.log(summed)
    return alpha[lat.nodes + lat.lengths]
