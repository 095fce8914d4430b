"""Elias-Fano sequences and an n-gram trie of them, as arrays that can be memory-mapped from one file."""

from __future__ import annotations

import json

import numpy as np

_U = np.arange(256, dtype=np.uint64)
#: A word of eight equal bytes.
_EACH = _U * np.uint64(0x0101010101010101)
#: Elements that one step of a search takes, so that what it makes stays in the processor's cache.
PART = 1 << 14
#: Place of the k-th one in a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


class EliasFano:
    """A rising sequence (equal elements allowed) below ``universe``: low bits packed, high bits in unary."""

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(low)).astype(np.int64)
        unary = np.zeros(((n + (max(universe, 1) >> low) + 1) // 64 + 2) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        bits = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            lows = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.int64) * low
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(bits, word, lows << shift)
            over = np.flatnonzero(shift + np.uint64(low) > 64)
            np.bitwise_or.at(bits, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
        return {"high": words, "low": bits, "shape": np.array([n, low], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.high, self.lows = parts["high"], parts["low"]
        self.n, self.low = (int(x) for x in parts["shape"])
        self.zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))])
        self.ones = 64 * np.arange(len(self.zeros)) - self.zeros

    def _select(self, before: np.ndarray, flip: bool, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of the high bits (of the k-th zero, if flipped)."""
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.uint8)
        bits = ~self.high[word] if flip else self.high[word]
        # The ones up to each byte of a word, in that byte; then in how many bytes these are no more than are left.
        sums = bits - ((bits >> _U[1]) & _EACH[0x55])
        sums = (sums & _EACH[0x33]) + ((sums >> _U[2]) & _EACH[0x33])
        sums = ((sums + (sums >> _U[4])) & _EACH[0x0F]) * _EACH[0x01]
        left = (k - before[word]).astype(np.uint64)
        byte = np.bitwise_count((((left * _EACH[0x01]) | _EACH[0x80]) - sums) & _EACH[0x80]).astype(np.uint64) << _U[3]
        left -= ((sums << _U[8]) >> byte) & _U[255]
        octet = (bits >> byte) & _U[255]
        return word * 64 + byte.astype(np.int64) + _SELECT.ravel()[(octet << _U[3] | left).astype(np.int64)]

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.lows[word] >> shift
        over = shift + np.uint64(self.low) > 64
        second = np.where(over, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low) - 1)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the first element not below each value within the bucket of its high part, the bucket's end, low bits."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        at = np.zeros(len(values), np.int64)  # of the bucket's first bit, behind the zero that ends the one before
        on = high > 0
        at[on] = self._select(self.zeros, True, high[on] - 1) + 1
        lo = at - high
        # The bucket is as long as the run of ones from there.
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = self.high[word] >> shift
        bits |= np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        zero = ~bits
        run = np.bitwise_count((zero & (~zero + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # 64, if there is no zero
        end = lo + run
        more = np.flatnonzero(run == 64)
        if len(more):
            end[more] = self._select(self.zeros, True, high[more]) - high[more]
        low, hi = values & np.uint64((1 << self.low) - 1), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # halves
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low_at(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end, low

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element not below each value (the length if there is none)."""
        return self._search(values)[0]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The elements at these places."""
        out = np.empty(len(i), np.uint64)
        for k in range(0, len(i), PART):
            some = i[k : k + PART]
            place = self._select(self.ones, False, some)
            out[k : k + PART] = ((place - some).astype(np.uint64) << np.uint64(self.low)) | self._low_at(some)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value; -1 where it is not an element."""
        out = np.empty(len(values), np.int64)
        for k in range(0, len(values), PART):
            at, end, low = self._search(values[k : k + PART])
            hit = at < end
            hit[hit] = self._low_at(at[hit]) == low[hit]
            out[k : k + PART] = np.where(hit, at, -1)
        return out


class Level:
    """The children of a level's nodes: a monotone pointer for each node to where its children begin, and their ids.

    Both are Elias-Fano sequences. Ids rise within a node; each node's are raised by the last value of the node before
    it, so that the whole level rises, as its pointers do."""

    @staticmethod
    def build(owner: np.ndarray, child: np.ndarray, owners: int, span: int) -> dict[str, np.ndarray]:
        """owner: sorted nodes below ``owners``; child: rising ids below ``span`` within each."""
        pointers = np.searchsorted(owner, np.arange(owners + 1))
        last = pointers[1:] - 1
        most = np.where(pointers[1:] > pointers[:-1], child[np.maximum(last, 0)] + 1 if len(child) else 0, 0).astype(np.int64)
        ends = np.cumsum(most)
        values = (ends - most)[owner] + child + 1
        out = {f"ids.{k}": x for k, x in EliasFano.build(values, int(ends[-1] if owners else 0) + span + 2).items()}
        return out | {f"pointers.{k}": x for k, x in EliasFano.build(pointers, len(owner) + 1).items()}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.ids, self.pointers = (EliasFano({k: parts[f"{x}.{k}"] for k in ("high", "low", "shape")}) for x in ("ids", "pointers"))

    def ranges(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the children of these nodes begin and end, and by what their ids are raised."""
        begin, end = (self.pointers.access(node + k).astype(np.int64) for k in (0, 1))
        raised = np.zeros(len(node), np.int64)
        on = begin > 0
        raised[on] = self.ids.access(begin[on] - 1).astype(np.int64)
        return begin, end, raised

    def find(self, node: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each child in the level (-1: there is none), and where its node's children begin; fastest for runs of a node."""
        if not len(node):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        run = np.cumsum(new) - 1
        begin, end, raised = (x[run] for x in self.ranges(node[new]))
        at = self.ids.find(raised + child + 1)
        return np.where((at >= begin) & (at < end), at, -1), begin


#: Codes 1..65534 are even steps of log10 from LEAST to 0; 0 means none.
LEAST, STEPS = -12.0, 65533


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.rint((np.maximum(np.log10(p), LEAST) - LEAST) / -LEAST * STEPS), 0).astype(np.uint16)


_VALUE = np.concatenate([[0.0], 10.0 ** (LEAST + np.arange(STEPS + 1) / STEPS * -LEAST)])


def value(codes: np.ndarray) -> np.ndarray:
    return _VALUE[codes]


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + bytes(-(8 + len(text)) % 64))
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays, mapped from the file: pages come into memory as they are read."""
    whole = np.asarray(np.memmap(path, np.uint8, "r"))  # the same pages, without the subclass's checks
    n = int(whole[:8].view("<u8")[0])
    head, base = json.loads(whole[8 : 8 + n].tobytes()), -(-(8 + n) // 64) * 64
    return {name: whole[base + at : base + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, size, at) in head.items()}


#: A hot word's counts are stored as this share of a count.
COUNT = 1e-10


class Trie:
    """Counts of trigrams, with their contexts' last word first, smoothed by Witten and Bell's interpolation.

    ``words``: the hashes of all words, an Elias-Fano sequence; a word's rank is its place. Level ``two``: the words after
    a word. Level ``pairs``: the words before a word, so that its nodes are pairs. Level ``three``: the words after a
    pair, by their place among the words after its last word, which is a smaller number than a rank. A context's
    probability mass is shared with the shorter context: p(w | context) is A + R * p(w | shorter context), and the trie
    holds A for each word after a context and R for each context, quantised. Of hot words the trie has only a part of the
    words after them: it holds the counts of these, and how many they are (``kinds``)."""

    @staticmethod
    def build(words: np.ndarray, hot: np.ndarray, tri: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        """words: sorted hashes; hot: which are; tri: ranks of last, before, word, and counts; two: last, word, counts of the
        hot words' successors. Rows may be in any order and repeat."""
        n = max(len(words), 1)
        last, before, word, counts = (x.astype(np.int64) for x in tri)
        out = {f"words.{k}": x for k, x in EliasFano.build(words, 1 << 64).items()}
        key, at = np.unique(np.concatenate([last * n + word, two[0].astype(np.int64) * n + two[1]]), return_inverse=True)
        own = np.concatenate([np.where(hot[last], 0, counts), two[2]]).astype(float)
        count, context = np.bincount(at, own, len(key)), key // n
        total, kinds = np.bincount(context, count, len(words)), np.bincount(context, count > 0, len(words))
        with np.errstate(invalid="ignore"):
            rest = np.where(total > 0, kinds / (total + kinds), 1.0)
            share = np.where(hot[context], count * COUNT, count / (total + kinds)[context])
        out |= {f"two.{k}": x for k, x in Level.build(context, key % n, len(words), n).items()}
        out |= {"two.a": quantise(share), "words.r": quantise(rest), "hot": np.flatnonzero(hot), "kinds": kinds[hot].astype(np.int64)}
        place = at[: len(last)] - np.searchsorted(context, last)
        pairs, pair = np.unique(last * n + before, return_inverse=True)
        span = int(place.max(initial=0)) + 1
        key, at = np.unique(pair * span + place, return_inverse=True)
        count, owner = np.bincount(at, counts, len(key)), key // span
        total, kinds = np.bincount(owner, count, len(pairs)), np.bincount(owner, minlength=len(pairs))
        out |= {f"pairs.{k}": x for k, x in Level.build(pairs // n, pairs % n, len(words), n).items()}
        out |= {f"three.{k}": x for k, x in Level.build(owner, key % span, len(pairs), len(words) + 1).items()}
        return out | {"three.a": quantise(count / (total + kinds)[owner]), "pairs.r": quantise(kinds / (total + kinds))}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.words = EliasFano({k: arrays[f"words.{k}"] for k in ("high", "low", "shape")})
        self.two, self.pairs, self.three = (Level({k[len(x) + 1 :]: a for k, a in arrays.items() if k.startswith(f"{x}.")}) for x in ("two", "pairs", "three"))
        self.n = self.words.n

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        return self.words.find(hashes)

    def shares(self, place: np.ndarray) -> np.ndarray:
        """Codes of A at places of level two (of a hot word: of the count); 0 for the place -1."""
        if not len(self.a["two.a"]):
            return np.zeros(len(place), np.uint16)
        return np.where(place >= 0, self.a["two.a"][np.maximum(place, 0)], 0).astype(np.uint16)

    def after_pair(self, pair: np.ndarray, last: np.ndarray, before: np.ndarray, which: np.ndarray, place: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of A for words after pairs, and of R for the pairs (last, before). pair: each row's pair; which: its entry in
        place and begin, where its two words are in level two and where the first one's successors begin."""
        node, _ = self.pairs.find(last, before)
        known = node >= 0
        rest = np.full(len(node), quantise(np.ones(1))[0], np.uint16)
        rest[known] = self.a["pairs.r"][node[known]]
        out = np.zeros(len(pair), np.uint16)
        some = np.flatnonzero(known[pair] & (place >= 0)[which])
        at, _ = self.three.find(node[pair[some]], (place - begin)[which[some]])
        out[some[at >= 0]] = self.a["three.a"][at[at >= 0]]
        return out, rest
