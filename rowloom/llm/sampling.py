"""SentencePiece segmentations sampled without replacement, and decoding.

A text's segmentations are the paths of a lattice of pieces, and a path's probability is the product of its pieces'
weights over the sum of all paths. The k paths of largest log-probability plus Gumbel noise are a sample without
replacement. They are found by a perturbed A* search: the queue holds disjoint regions of the lattice - a path's
prefix followed by any other edge - each with the exact maximum of the perturbed scores inside it, which is a
Gumbel variable truncated at the score of the path it was split from. Popping the best region gives the next sample,
and splits it again. All noise is a hash of the row's key and the place in the lattice, so a row gives the same
samples wherever it is processed.

No piece holds two characters that stand side by side in no piece, so there a text's lattice falls into a chain of
units, mostly words and marks. A unit's lattice (conditional probability of each edge at each node, from the sums over
all paths to the unit's end) is built once for each distinct unit that a worker meets. Units are known by a hash of
their characters and compared with the text they were built from. Lattices of a block's new units are built together,
and steps of the search run over arrays of all units of a block of texts.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import text_chunks

SPACE = "▁"
#: Slots of the table of neighbouring characters; a shared slot only makes units longer.
PAIRS = 1 << 21
#: Edges of unit lattices that a worker keeps (about 50 bytes each with their nodes); beyond it the memory starts anew.
KEPT_EDGES = 9_000_000
#: Units up to this length, and not less likely than this logarithm, are summed in plain numbers, others in logarithms.
PLAIN, LEAST = 40, -600.0
#: Code points whose units are looked up at once.
BLOCK = 1 << 20
#: Weight of the piece of rank r: 1 / (r + RANK_SHIFT), as in Zipf's law; of a byte piece: BYTE_WEIGHT.
RANK_SHIFT, BYTE_WEIGHT = 2.7, 1e-5


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def pair_slots(points: np.ndarray) -> np.ndarray:
    """The slot of each pair of neighbouring code points."""
    return ((points[:-1] * np.uint32(0x9E3779B1)) ^ (points[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - (PAIRS - 1).bit_length())


class _Numbers:
    """Numbers from 0 for distinct 64-bit keys, in the order they came, found by an open hash table."""

    def __init__(self):
        self.keys, self.bits = array("Q"), 16
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where there is none."""
        if not self.keys:
            return np.full(len(keys), -1, dtype=np.int64)
        held, last = np.frombuffer(self.keys, dtype=np.uint64), len(self.slots) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at].astype(np.int64)
        other = np.flatnonzero((held[found] != keys) & (found >= 0))
        while len(other):
            at[other] = step = (at[other] + 1) & last
            found[other] = here = self.slots[step].astype(np.int64)
            other = other[(held[here] != keys[other]) & (here >= 0)]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Takes distinct keys that have no number."""
        number = len(self.keys)
        self.keys.frombytes(keys.tobytes())
        if 2 * len(self.keys) > len(self.slots):
            self.bits, number = (2 * len(self.keys)).bit_length(), 0
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        numbers, last = np.arange(number, len(self.keys), dtype=np.int32), len(self.slots) - 1
        at = (np.frombuffer(self.keys, dtype=np.uint64)[number:] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = numbers[free]  # of several for one slot one stays
            left = np.flatnonzero(self.slots[at] != numbers)
            numbers, at = numbers[left], (at[left] + 1) & last


class Pieces:
    """A vocabulary as a unigram model: weights follow the pieces' ranks, since a BPE model has ranks for scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, self.byte = [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((-model.get_score(i), i, piece))
        weights = [1 / (rank + RANK_SHIFT) for rank in range(len(plain))]
        total = sum(weights) + BYTE_WEIGHT * len(self.byte)
        self.weight = {piece: (w / total, i) for w, (_, i, piece) in zip(weights, sorted(plain), strict=True)}
        self.byte_weight = BYTE_WEIGHT / total
        self.longest = max(len(p) for p in self.weight)
        self.pairs = np.zeros(PAIRS, dtype=bool)
        for p in self.weight:
            points = np.frombuffer(p.encode("utf-32-le"), dtype="<u4")
            self.pairs[pair_slots(points)] = True
        steps: dict[int, int] = {}  # states of the trie by state and character; 0 is its root
        ends: dict[int, tuple[float, int]] = {}
        for p, found in self.weight.items():
            state = 0
            for c in p:
                state = steps.setdefault(state << 21 | ord(c), len(steps) + 1)
            ends[state] = found
        keys = np.fromiter(steps, dtype=np.uint64, count=len(steps))
        self.steps = _Numbers()
        self.steps.add(keys * _SPREAD)  # an odd factor: different keys stay different
        #: by state: weight and id of the piece that ends there (0 and -1: none), and whether pieces go on from it
        self.ends_weight, self.ends_piece = np.zeros(len(steps) + 1), np.full(len(steps) + 1, -1, dtype=np.int32)
        self.goes_on = np.zeros(len(steps) + 1, dtype=bool)
        self.goes_on[(keys >> np.uint64(21)).astype(np.int64)] = True
        for state, (weight, number) in ends.items():
            self.ends_weight[state], self.ends_piece[state] = weight, number
        self.bytes_of: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.weight.items()} | {i: bytes([b]) for b, i in self.byte.items()}

        self.sizes = np.zeros(model.get_piece_size(), dtype=np.int64)
        for i, raw in self.bytes_of.items():
            self.sizes[i] = len(raw)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.sizes))), dtype=np.uint8)

    def step(self, states: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The trie's state after each state and code point; 0 where no piece goes on so."""
        return self.steps.find((states.astype(np.uint64) << np.uint64(21) | points) * _SPREAD) + 1

    def alone(self, points: np.ndarray) -> np.ndarray:
        """The logarithm of the weight of each code point's own piece, or of its bytes' pieces."""
        weight = self.ends_weight[self.step(np.zeros(len(points), dtype=np.int64), points)]
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        return np.where(weight > 0, np.log(np.where(weight > 0, weight, 1.0)), sizes * math.log(self.byte_weight))

    def spelled(self, ids: np.ndarray, ends: list[int], owner: list[int], texts: list[str]) -> list[bool]:
        """Whether each sample decodes to its text, byte for byte; sample n has ids[ends[n]:ends[n + 1]] of text owner[n]."""
        sizes = self.sizes[ids]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        kind = np.int32 if upto[-1] < 2**31 else np.int64
        at = np.repeat((self.offsets[ids] - upto[:-1]).astype(kind), sizes)
        at += np.arange(len(at), dtype=kind)
        decoded = self.letters[at].tobytes()
        raws = [(" " + t if t else "").encode("utf-8", "surrogatepass") for t in texts]
        bounds = upto[ends].tolist()
        return [decoded[a:b] == raws[n] for a, b, n in zip(bounds[:-1], bounds[1:], owner, strict=True)]

    def units(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, list[int]]:
        """All texts in one string, its code points, the bounds of its units, and the number of each text's first unit; a
        text gets one space before it, as the library does."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not whole:
            return whole, points, np.zeros(1, dtype=np.int64), [0] * (len(texts) + 1)
        cut = np.concatenate(([True], ~self.pairs[pair_slots(points)], [True]))
        ends = np.cumsum([0] + [len(m) for m in marked])
        cut[ends] = True
        places = np.flatnonzero(cut)
        return whole, points, places, np.searchsorted(places, ends).tolist()

    def decode(self, ids) -> str:
        """The text of a list of ids; the space put before a text is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Lattices:
    """Unit lattices in flat arrays. A node is what is left of a unit, so units with a common end share its nodes; node n
    has edges first[n] .. first[n + 1] with their probabilities there, the longest piece first (mostly the likeliest)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.node = _Numbers()  # of the hashes of what is left of units; by its number:
        self.begin, self.length = array("q"), array("i")  # where it stands in text
        self.after, self.at = array("q"), array("q")  # the number without its first character, or -1, and its node
        self.text = array("I")  # the code points of units as they were met
        self.odd: dict[str, int] = {}  # nodes of units that are not found by hash
        self.beta = array("d")  # by node: the summed weight of all ways to the end; its logarithm in long units
        self.first = array("q", [0])
        self.share, self.target, self.piece = array("d"), array("q"), array("i")

    def starts(self, whole: str, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first node of the lattice of each unit between two places."""
        out, begin = np.empty(len(places) - 1, dtype=np.int64), 0
        while begin < len(out):
            end = max(begin + 1, int(np.searchsorted(places, places[begin] + BLOCK, side="right")) - 1)
            a, b = int(places[begin]), int(places[end])
            nodes, odd = self._find(points[a:b], places[begin : end + 1] - a)
            for k in odd.tolist():
                nodes[k] = self._odd(whole[places[begin + k] : places[begin + k + 1]])
            out[begin:end] = nodes
            begin = end
        return out

    def nodes_of(self, units: list[str]) -> np.ndarray:
        """The first node of each unit's lattice."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self.starts("".join(units), points, np.cumsum([0, *map(len, units)]))

    def _add(self, units: list[str]) -> None:
        """Lattices of units that may be known."""
        self.nodes_of(units)

    def _find(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first node of the lattice of each unit at[k] .. at[k + 1], and the units that have to be found in other ways."""
        sizes, place = np.diff(at), np.arange(len(points))
        names = np.add.reduceat(_terms(points, np.repeat(at[1:], sizes) - place), at[:-1])
        number = self.node.find(names)
        missing = np.flatnonzero((number < 0) & (sizes <= PLAIN))
        if len(missing):
            new = _taken(points, at, missing[np.sort(np.unique(names[missing], return_index=True)[1])])
            likely = np.add.reduceat(self.pieces.alone(new[0]), new[1][:-1]) > LEAST
            self._build(*(new if likely.all() else _taken(*new, np.flatnonzero(likely))))
            number[missing] = self.node.find(names[missing])
        if not len(self.node):
            return number, np.arange(len(number))
        # a unit is known if its text is
        known = (number >= 0) & (np.frombuffer(self.length, dtype=np.int32)[number] == sizes)
        begin = np.where(known, np.frombuffer(self.begin, dtype=np.int64)[number], 0)
        unlike = np.flatnonzero(np.frombuffer(self.text, dtype=np.uint32).take(np.repeat(begin - at[:-1], sizes) + place, mode="clip") != points)
        known[np.searchsorted(at, unlike, side="right") - 1] = False
        return np.frombuffer(self.at, dtype=np.int64)[number], np.flatnonzero(~known)

    def _odd(self, unit: str) -> int:
        """The first node of a unit that is long or very unlikely, or whose hash another text has."""
        if unit not in self.odd:
            self.odd[unit] = self._add_long(unit)
        return self.odd[unit]

    def _new(self, beta: float, shares: list[float], targets: list[int], pieces: list[int]) -> int:
        self.share.extend(shares)
        self.target.extend(targets)
        self.piece.extend(pieces)
        self.first.append(len(self.share))
        self.beta.append(beta)
        return len(self.beta) - 1

    def _spell(self, raw: bytes, after: int) -> int:
        """Nodes for the second and later bytes of a character; the node to go to from its first byte."""
        for b in reversed(raw[1:]):
            after = self._new(0.0, [1.0], [after], [self.pieces.byte[b]])
        return after

    def _build(self, points: np.ndarray, at: np.ndarray) -> None:
        """Lattices of distinct units at[k] .. at[k + 1]; none if two texts have one hash."""
        if not len(points):
            return
        sizes, place = np.diff(at), np.arange(len(points))
        mirror = np.repeat(at[:-1] + at[1:] - 1, sizes) - place
        back = points[mirror]  # each unit from its end; what is left at a place goes on to lower places
        floor = np.repeat(at[:-1], sizes)
        left = place - floor + 1
        terms = _terms(back, left)
        upto = np.cumsum(terms)
        names = upto - np.repeat((upto - terms)[at[:-1]], sizes)
        count, number = len(self.node), self.node.find(names)
        new, old = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        _, first, which = np.unique(names[new], return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        own = new[first[order]]  # the place of each new one
        fresh = rank[which]
        number[new] = count + fresh
        after = np.where(left > 1, np.concatenate(([-1], number[:-1])), -1)
        # equal ones have equal first characters and go on to equal ones
        if (back[own][fresh] != back[new]).any() or (after[own][fresh] != after[new]).any():
            return
        if len(old):
            begin = np.frombuffer(self.begin, dtype=np.int64)[number[old]]
            if (np.frombuffer(self.text, dtype=np.uint32)[begin] != back[old]).any() or (np.frombuffer(self.after, dtype=np.int64)[number[old]] != after[old]).any():
                return

        # every piece that begins at a new one, the shortest first
        pieces, m = self.pieces, len(own)
        owners, places, states = [], [], []
        owner, to, state = np.arange(m), own, np.zeros(m, dtype=np.int64)
        while len(owner):
            state = pieces.step(state, back[to])
            on = np.flatnonzero(state)
            owner, to, state = owner[on], to[on] - 1, state[on]
            ends = np.flatnonzero(pieces.ends_piece[state] >= 0)
            owners.append(owner[ends])
            places.append(to[ends])
            states.append(state[ends])
            on = np.flatnonzero(pieces.goes_on[state] & (to >= floor[own[owner]]))
            owner, to, state = owner[on], to[on], state[on]
        spelt = np.ones(m, dtype=bool)  # characters that are no pieces: their bytes are
        spelt[owners[0]] = False
        spelt = np.flatnonzero(spelt)
        raws = [chr(c).encode("utf-8", "surrogatepass") for c in back[own[spelt]].tolist()]
        extra = np.zeros(m, dtype=np.int64)  # nodes before its own for the second and later bytes
        extra[spelt] = [len(r) - 1 for r in raws]
        base = len(self.beta)
        node = base - 1 + np.cumsum(1 + extra)

        owner = np.concatenate([spelt, *owners])
        order = np.argsort(-np.arange(len(owner)) + len(owner) * owner)  # by owner, the longest piece first
        owner = owner[order]
        to = np.concatenate([own[spelt] - 1, *places])[order]
        states = np.concatenate(states)
        weight = np.concatenate(([pieces.byte_weight ** len(r) for r in raws], pieces.ends_weight[states]))[order]
        piece = np.concatenate((np.array([pieces.byte[r[0]] for r in raws], dtype=np.int32), pieces.ends_piece[states]))[order]
        goal = np.where(to >= floor[own[owner]], number[to], -1)
        old, fresh = np.flatnonzero((goal >= 0) & (goal < count)), goal >= count
        target, ahead = np.full(len(owner), -1), np.ones(len(owner))
        if len(old):
            target[old] = np.frombuffer(self.at, dtype=np.int64)[goal[old]]
            ahead[old] = np.frombuffer(self.beta, dtype=np.float64)[target[old]]
        target[fresh] = node[goal[fresh] - count]

        # sums of all ways to the end, by the length of what is left
        sums = np.concatenate((np.zeros(m), ahead))
        index = np.where(fresh, goal - count, m + np.arange(len(owner)))
        length = left[own]
        by = np.argsort(length[owner], kind="stable")
        for x, y in pairwise(np.searchsorted(length[owner[by]], np.arange(1, sizes.max() + 2)).tolist()):
            if x < y:
                some = by[x:y]
                begin = np.flatnonzero(np.diff(owner[some], prepend=-1))
                sums[owner[some[begin]]] = np.add.reduceat(weight[some] * sums[index[some]], begin)
        share = weight * sums[index] / sums[owner]
        source = node[owner]
        if len(spelt):
            last = np.searchsorted(owner, spelt, side="right") - 1  # the bytes' edge is its owner's last one
            more = [
                (n - k, 1.0, n - k - 1 if k < len(raw) - 1 else goes, pieces.byte[raw[k]])
                for n, raw, goes in zip(node[spelt].tolist(), raws, target[last].tolist(), strict=True)
                for k in range(1, len(raw))
            ]
            target[last] = np.where(extra[spelt] > 0, node[spelt] - 1, target[last])
            if more:
                source, share, target, piece = (np.concatenate((a, np.array(b, dtype=a.dtype))) for a, b in zip((source, share, target, piece), zip(*more, strict=True), strict=True))
                order = np.argsort(source, kind="stable")
                source, share, target, piece = source[order], share[order], target[order], piece[order]
        beta = np.zeros(int(node[-1]) + 1 - base)
        beta[node - base] = sums[:m]
        first = len(self.share) + np.cumsum(np.bincount(source - base, minlength=len(beta)))
        self.node.add(names[own])
        for kept, rows in (
            (self.begin, len(self.text) + mirror[own]), (self.length, length.astype(np.int32)), (self.after, after[own]), (self.at, node),
            (self.text, points.astype(np.uint32)), (self.beta, beta), (self.first, first), (self.share, share), (self.target, target), (self.piece, piece),
        ):
            kept.frombytes(rows.tobytes())

    def _add_long(self, unit: str) -> int:
        """The same in logarithms, without sharing."""
        weight, longest = self.pieces.weight, self.pieces.longest
        n = len(unit)
        at, logs = [-1] * (n + 1), [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            row = []
            for j in range(min(n, i + longest), i, -1):
                found = weight.get(unit[i:j])
                if found is not None:
                    row.append((math.log(found[0]) + logs[j], at[j], found[1]))
            if unit[i] not in self.pieces.weight:
                raw = unit[i].encode("utf-8", "surrogatepass")
                row.append((len(raw) * math.log(self.pieces.byte_weight) + logs[i + 1], self._spell(raw, at[i + 1]), self.pieces.byte[raw[0]]))
            top = max(row)[0]
            logs[i] = top + math.log(math.fsum(math.exp(w - top) for w, _, _ in row))
            at[i] = self._new(logs[i], [math.exp(w - logs[i]) for w, _, _ in row], [t for _, t, _ in row], [x for _, _, x in row])
        return at[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _terms(points: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What each code point, with so many left of its unit, adds to the hash of what is left there."""
    x = (left.astype(np.uint64) << np.uint64(21) | points) * _SPREAD
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _taken(points: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points and bounds of some units."""
    sizes = np.diff(at)[which]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return points[np.repeat(at[which] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


_ALL = (1 << 64) - 1
#: Sets the steps of one unit apart from those of all others.
_UNIT = np.uint64(0xD6E8FEB86659FD93)


def _mix_one(x: int) -> int:
    """_mix for a single number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _base(seed: int, draw: int) -> int:
    """What names the noise of one draw of one text."""
    return _mix_one((_mix_one((seed + 0x9E3779B97F4A7C15) & _ALL) + draw + 1) & _ALL)


def _uniform(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each place of a draw."""
    x = _mix(base ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _alone(base: int, place: int) -> float:
    """_uniform for a single place."""
    return ((_mix_one(base ^ ((place * 0x9E3779B97F4A7C15) & _ALL)) >> 11) + 0.5) * 2.0**-53


class _Arrays:
    """Views of the lattices' arrays as they are now."""

    def __init__(self, lat: Lattices):
        self.first, self.target = np.frombuffer(lat.first, dtype=np.int64), np.frombuffer(lat.target, dtype=np.int64)
        self.share, self.piece = np.frombuffer(lat.share, dtype=np.float64), np.frombuffer(lat.piece, dtype=np.int32)

    def walk(self, start: np.ndarray, unit: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in start, edge) of one path from each node to its unit's end, in order; edges are drawn by their
        probability with noise named by the draw and the unit's number in its text."""
        taken, counts = [], np.zeros(len(start), dtype=np.int64)
        places = unit.astype(np.uint64) * _UNIT  # no two places of units of any length are alike
        at, node = np.arange(len(start)), start
        while len(at):
            edge = self.first[node]
            last = self.first[node + 1] - 1
            choose = np.flatnonzero(edge < last)
            if len(choose):
                who, here, last = at[choose], edge[choose], last[choose]
                u = _uniform(base[who], places[who] + np.uint64(len(taken)))
                while True:  # likely edges come first: most stop at once
                    u = u - self.share[here]
                    on = np.flatnonzero((u > 0) & (here < last))
                    if not len(on):
                        break
                    choose, u, here, last = choose[on], u[on], here[on] + 1, last[on]
                    edge[choose] = here
            taken.append((at, edge))
            counts[at] = len(taken)
            node = self.target[edge]
            more = np.flatnonzero(node >= 0)
            at, node = at[more], node[more]
        upto = np.cumsum(counts)
        out, begin = np.empty(int(counts.sum()), dtype=np.int64), upto - counts
        for step, (at, edge) in enumerate(taken):
            out[begin[at] + step] = edge
        return np.repeat(np.arange(len(start)), counts), out

    def node_of(self, edge: int) -> int:
        return int(np.searchsorted(self.first, edge, side="right")) - 1


class _Path:
    """One sampled path and the open regions beside it.

    free[i] is the untruncated perturbed maximum of the region that leaves the path at position i; truncation at the
    path's own score keeps their order, so only the best one is truncated.
    """

    __slots__ = ("units", "edges", "logs", "score", "free", "excluded")

    def __init__(self, units: np.ndarray, edges: np.ndarray, logs: np.ndarray, score: float, begin: int, beside: np.ndarray, banned: list[int]):
        """beside[i] is the perturbed logarithm of what the other edges have at position begin + i, given its node."""
        self.units, self.edges, self.logs, self.score = units, edges, logs, score
        self.excluded = {begin: banned} if banned else {}
        self.free = np.cumsum(logs) - logs
        self.free[:begin] = -np.inf
        self.free[begin:] += beside

    def best(self) -> tuple[float, int]:
        """The score of the best open region and its position."""
        at = int(self.free.argmax())
        top = float(self.free[at])
        if top == -math.inf:
            return top, at
        low, high = sorted((-self.score, -top))
        return -(high + math.log1p(math.exp(low - high))), at


def _beside(a: _Arrays, edges: np.ndarray, base: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each edge's probability, and the perturbed logarithm of its neighbours' at the node."""
    share = a.share[edges]
    with np.errstate(divide="ignore"):  # an edge without neighbours leaves minus infinity
        return np.log(share), np.log1p(-share) - np.log(-np.log(_uniform(base, place + (1 << 41))))


class _Search:
    """The queue of one text: its samples so far, each with its open regions."""

    def __init__(self, seed: int, starts: np.ndarray, units: np.ndarray, edges: np.ndarray, logs: np.ndarray, beside: np.ndarray):
        self.seed, self.starts = seed, starts
        score = -math.log(-math.log(_alone(_base(seed, 0), 1 << 42)))
        self.found = [_Path(units, edges, logs, score, 0, beside, [])] if len(starts) else []

    def top(self) -> tuple[float, int, _Path | None]:
        """Score, position and path of the best open region."""
        return max(((*p.best(), p) for p in self.found), key=lambda x: x[0], default=(-math.inf, 0, None))

    def pop(self, a: _Arrays) -> bool:
        """Takes the best region and draws its first edge; self.nodes and self.places are the units that are left to draw."""
        score, at, origin = self.top()
        if score == -math.inf:
            return False
        origin.free[at] = -np.inf
        banned = [*origin.excluded.get(at, ()), int(origin.edges[at])]
        self.base = _base(self.seed, len(self.found))
        node = a.node_of(int(origin.edges[at]))
        # another edge at the same node, by the probabilities that remain
        others = [e for e in range(a.first[node], a.first[node + 1]) if e not in banned]
        shares = [float(a.share[e]) for e in others]
        mark = _alone(self.base, (1 << 43) + at) * math.fsum(shares)
        edge = others[-1]
        for e, share in zip(others, shares, strict=True):
            mark -= share
            if mark <= 0:
                edge = e
                break
        unit = int(origin.units[at])
        ended = a.target[edge] < 0
        self.nodes = self.starts[unit + 1 :] if ended else np.concatenate(([a.target[edge]], self.starts[unit + 1 :]))
        self.places = np.arange(unit + 1 if ended else unit, len(self.starts))
        self.taken = (score, at, origin, banned, edge, unit)
        return True

    def push(self, a: _Arrays, where: np.ndarray, edges: np.ndarray, logs: np.ndarray, beside: np.ndarray) -> None:
        """Completes the popped region's path by the drawn edges."""
        score, at, origin, banned, edge, unit = self.taken
        units = np.concatenate((origin.units[:at], [unit], self.places[where]))
        edges = np.concatenate((origin.edges[:at], [edge], edges))
        node = a.node_of(edge)
        left = math.fsum(float(a.share[e]) for e in range(a.first[node], a.first[node + 1]) if e != edge and e not in banned)
        here = math.log(left) - math.log(-math.log(_alone(self.base, at + (1 << 41)))) if left > 0 else -math.inf
        logs = np.concatenate((origin.logs[:at], [math.log(a.share[edge])], logs))
        self.found.append(_Path(units, edges, logs, score, at, np.concatenate(([here], beside)), banned))


_workers: dict[str, Lattices] = {}


def sample_block(lat: Lattices, texts: list[str], seeds: list[int], k: int) -> Iterator[tuple[list[np.ndarray], list[float], list[float], list[float]]]:
    """For each text: ids, log-probabilities, perturbed scores and inclusion scores of its samples, best first."""
    if len(lat.share) > KEPT_EDGES:
        lat.clear()
    whole, points, places, bounds = lat.pieces.units(texts)
    start = lat.starts(whole, points, places)
    a = _Arrays(lat)
    sizes = np.diff(bounds)
    # the first sample of every text in one go; units are numbered inside their text for the noise
    base = np.repeat(np.array([_base(s, 0) for s in seeds], dtype=np.uint64), sizes)
    inside = np.arange(len(start)) - np.repeat(np.array(bounds[:-1], dtype=np.int64), sizes)
    owner, edge = a.walk(start, inside, base)
    cuts = np.searchsorted(owner, bounds)
    logs, beside = _beside(a, edge, base[owner], np.arange(len(owner)) - np.repeat(cuts[:-1], np.diff(cuts)))
    searches = [
        _Search(seed, start[b:e], inside[owner[x:y]], edge[x:y], logs[x:y], beside[x:y])
        for seed, b, e, x, y in zip(seeds, bounds[:-1], bounds[1:], cuts[:-1], cuts[1:], strict=True)
    ]
    for _ in range(1, k):  # every text's next sample, drawn in one go
        going = [s for s in searches if s.pop(a)]
        if not going:
            break
        sizes = np.array([len(s.nodes) for s in going])
        bases = np.repeat(np.array([s.base for s in going], dtype=np.uint64), sizes)
        owner, edge = a.walk(np.concatenate([s.nodes for s in going]), np.concatenate([s.places for s in going]), bases)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = np.searchsorted(owner, ends)
        begins = np.array([s.taken[1] + 1 for s in going])
        logs, beside = _beside(a, edge, bases[owner], np.arange(len(owner)) + np.repeat(begins - cuts[:-1], np.diff(cuts)))
        for s, b, x, y in zip(going, ends[:-1], cuts[:-1], cuts[1:], strict=True):
            s.push(a, owner[x:y] - b, edge[x:y], logs[x:y], beside[x:y])
    for s in searches:
        if not s.found:
            yield [np.zeros(0, np.int32)], [0.0], [0.0], [1.0]
            continue
        left = s.top()[0]
        logs = [float(p.logs.sum()) for p in s.found]
        inclusion = [1.0 if left == -math.inf else -math.expm1(-math.exp(min(700.0, x - left))) for x in logs]
        yield [a.piece[p.edges] for p in s.found], logs, [p.score for p in s.found], inclusion


def sample(docs: DataFrame, model: str, k: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, sample, n_pieces, log_prob, score, inclusion, ids_crc32, round_trip and, if asked for, ids: up to k rows for
    each row of docs, fewer where the text has fewer segmentations.

    model: path of a sentencepiece file, present on every executor. sample counts from 1 by falling perturbed score;
    inclusion is the chance that a segmentation of this probability scores above the best one left out. round_trip
    tells whether decoding gives the text again (it does not where a text holds U+2581, which stands for a space).
    Null or empty text: one sample without pieces. Null or repeated keys: rows with equal keys and texts give equal
    samples. Other columns are ignored. An empty table gives an empty table. Whole texts are sampled; a very long one
    is searched like any other and is in one task's memory.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("seed"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _workers.get(model) or _workers.setdefault(model, Lattices(Pieces(model)))
        for batch, texts in text_chunks(batches):
            seeds = [s & (2**64 - 1) for s in batch.column(1).to_pylist()]
            owner, number, logs, scores, inclusion, found = [], [], [], [], [], []
            for n, (ids, *figures) in enumerate(sample_block(lat, texts, seeds, k)):
                owner.extend([n] * len(ids))
                number.extend(range(1, len(ids) + 1))
                for column, more in zip((logs, scores, inclusion), figures, strict=True):
                    column.extend(more)
                found.extend(ids)
            flat = np.concatenate(found).astype("<i4", copy=False)
            ends = np.cumsum([0, *map(len, found)])
            bounds, raw = ends.tolist(), memoryview(flat).cast("B")
            checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            cols = (number, np.diff(ends), logs, scores, inclusion, checks, lat.pieces.spelled(flat, bounds, owner, texts))
            keys = batch.column(0).take(pa.array(owner, pa.int32()))
            types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            if with_ids:
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([keys, *made], names=["key", *names])

    names = ["sample", "n_pieces", "log_prob", "score", "inclusion", "ids_crc32", "round_trip"] + (["ids"] if with_ids else [])
    types = f"key {kind}, sample int, n_pieces long, log_prob double, score double, inclusion double, ids_crc32 long, round_trip boolean"
    out = narrow.mapInArrow(run, types + (", ids array<int>" if with_ids else ""))
    return out.select(F.col("key").alias(key), *names)


def decode(samples: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text of each row's ids; null ids give null, no ids the empty text.

    Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    kind = samples.schema[key].dataType.simpleString()
    narrow = samples.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _workers.get(model) or _workers.setdefault(model, Lattices(Pieces(model)))
        for batch in batches:
            texts = [None if i is None else lat.pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return narrow.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
