"""Language-model scoring by online logistic context mixing.

Symbols: the words and the end of a text, lower-cased; the most frequent tokens that training texts have at least LEAST times, at most VOCABULARY, are symbols, any other word is an escape, its bytes and a terminator. Two
Huffman trees, over the vocabulary and over bytes, turn a symbol into binary decisions. Three predictors know each decision's node in hashed contexts: none, the last symbol, and the last two symbols (not behind a rare word; where a byte is coded, the last two and the last three).
What they count are zeros and ones over all training texts. A prediction's strength is the logarithm of its odds; strengths are added with weights that a gate selects (how often the node was
seen in both contexts, and whether a word, a byte, or a word without a long context is coded) and become a probability. All texts start with the weights that were fitted to the decisions of all training texts, each with the counts of all other occurrences (see learned, fitted), and refine them as they go: after each ROUND of decisions
they take a gradient step. A text's score is the sum of log10 probabilities of its decisions, so it depends on the text, the counts and the starting weights alone; bits per byte follow from it.

Counts grow with the input and are never gathered. A unit of texts sends the different pairs of context and symbol that it has, with how often its training texts have them, to ranges of hashed contexts. Leaves of a tree
are numbered from left to right, so the symbols below a node are neighbours: a range merges its pairs, adds them up below each node on each symbol's way, and sends the strengths and counts' classes along each way back to the units
that asked, a byte to a decision. Contexts' hashes have HASH_BITS bits more than the count of training tokens. Contexts of a single symbol that makes up 1 / HOT of all (at most HOT of them) are split by the first SPLIT decisions, so no range
gets them whole; pairs are counted in the unit before they are sent, so a longer context that holds a third of all rows sends a unit's different followers only. A range keeps the compressed messages of its units while it merges them.
The units with their answers are read twice from the one shuffle, first for the starting weights, then for the scores: what a decision knows falls into CELLS, only their counts come to the driver, and sums of whole numbers don't depend on how texts lie in units.

Base: unigrams with add-one smoothing over all tokens, not only the vocabulary's. Words outside the vocabulary ask for their counts in the same way, by a 64-bit hash.

Training texts are those with crc32(doc_id as text) mod 7 other than HELD_OUT; a null doc_id counts as the empty text. Null text is empty: only the end. A very long text is scored whole, as a unit of its own if need be. Repeated rows are
scored one by one; other columns of any name are ignored. Without training texts all counts are zero and every decision costs one bit. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from vellum.llm.common import slices, table, texts
from vellum.session import written

FOLDS, HELD_OUT = 7, 2
VOCABULARY, LEAST, SHARES = (1 << 18) - 1024, 2, 1024
#: Bytes of text in a unit; symbols whose decisions are worked on at once; pairs of a range that are added up at once.
UNIT_BYTES, CHUNK, MERGED = 4 << 20, 1 << 16, 1 << 15
#: Decisions between two refinements in a text's first rounds and later.
ROUND, EARLY, LATER = 256, 16, 2048
#: A node's class in a context: how often it was seen, at least. The step of refinement, and what counts have in advance.
CLASSES, STEP, PRIOR = (1, 4, 32), 0.06, 0.2
#: Gates: class in the short context, class in the long one, and word, byte, or word without a long context.
GATES = 48
#: Training tokens to a range, and to a task that merges ranges.
RANGE, PART = 1 << 21, 1 << 21
#: Bits of a pair's key for the symbol, and of a context's hash above the bits of the count of training tokens.
SYMBOL_BITS, HASH_BITS = 18, 10
#: A hot context's share of symbols is at least 1 / HOT; it is split by so many decisions.
HOT, SPLIT = 256, 8
#: The last two words are a context of their own where the last one makes up at least 1 / FREQUENT of all symbols; behind a rarer word its own context says as much.
FREQUENT = 1 << 10
#: Steps of strength to a unit: with a class of two bits a byte holds it.
GRAIN = 1.5
#: Starting weights are fitted to the decisions of all training texts, counted by what is known of each: strengths without a context in PLAIN_STEPS steps to a unit, the others as 6 bits say. FIT_PRIOR holds weights of rare gates where they began.
PLAIN_STEPS, FIT_PRIOR, FIT_ROUNDS = 4, 16.0, 30
#: What keeps the parts of hot contexts apart from other contexts.
_GROUP, _TOP = 0xA0761D6478BD642F, 0x5851F42D4C957F2D
_TABLE = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokenised(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different tokens of texts (b"" is the end), each text's tokens as places in them, and where each text's begin."""
    # Each text ends with a blank, so every token does, and blanks alone are left out.
    data = np.frombuffer(b"".join([b.translate(_TABLE) + b" " for b in bodies]), np.uint8)
    kept = data != 32
    blanks = np.flatnonzero(~kept)
    ends = blanks - np.arange(len(blanks))
    real = np.diff(ends, prepend=0) > 0
    stops = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1) - 1
    counts = np.concatenate([[0], np.cumsum(real)[np.searchsorted(blanks, stops)]])
    # The end stands behind all tokens.
    coded = _binary(np.concatenate([[0], ends[real], ends[-1:]]), data[kept]).dictionary_encode()
    of = coded.indices.to_numpy()
    return coded.dictionary, np.insert(of[:-1], counts[1:], of[-1]), counts + np.arange(len(counts))


def _binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other, from where each begins."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _joined(values: pa.Array) -> np.ndarray:
    """The bytes of binary values, one behind the other."""
    _, ends, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8)
    at = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _hashes(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of binary values, from where each begins."""
    raw, cuts = data.tobytes(), at.tolist()
    return np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(cuts, cuts[1:])), np.uint64, len(cuts) - 1)


def _training(part: pa.RecordBatch) -> tuple[list[bytes], list[bool]]:
    bodies, held = texts(part.column(1)), [held_out(i) for i in part.column(0).to_pylist()]
    return bodies, held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, UNIT_BYTES):
        bodies, held = _training(part)
        bodies = [b for b, h in zip(bodies, held) if not h]
        if bodies:
            tokens, of, _ = tokenised(bodies)
            n = np.bincount(of, minlength=len(tokens))
            some = n > 0
            yield pa.RecordBatch.from_arrays([tokens.filter(pa.array(some)), pa.array(n[some])], ["token", "n"])


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """How long each symbol's way from the root is, its bits from bit 51 down, the nodes of all ways one behind the other, and how many nodes there are. Equal weights are taken in order. Weights are raised to a 2 ** 32nd
    of their sum, which bounds the ways' lengths."""
    n, least = len(weights), max(1, int(weights.sum()) >> 32)
    heap = [(w, i) for i, w in enumerate(np.maximum(weights, least).tolist())]
    heapq.heapify(heap)
    children = np.empty((n - 1, 2), np.int64)
    for k in range(n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n + k))
        children[k] = a[1], b[1]
    parent, size, code = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint64)
    parent[children] = np.arange(n - 1)[:, None]
    level = np.array([n - 2] if n > 1 else [], np.int64)
    while len(level):
        below, depth = children[level], size[n + level[0]]
        size[below] = depth + 1
        code[below] = code[n + level][:, None] | np.array([0, 1], np.uint64) << np.uint64(51 - depth)
        level = below[below >= n] - n
    starts = np.cumsum(size[:n]) - size[:n]
    nodes, at, leaf = np.empty(int(size[:n].sum()), np.int64), np.arange(n), np.arange(n)
    while len(at := at[(up := parent[at]) >= 0]):
        leaf = leaf[up >= 0]
        nodes[starts[leaf] + size[at] - 1] = parent[at]
        at = n + parent[at]
    return size[:n].astype(np.int32), code[:n], nodes, n - 1


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _ranks(first: np.ndarray, n: int) -> np.ndarray:
    """For each of n values the number of its run, from where the runs begin."""
    ranks = np.zeros(n, np.int32)
    ranks[first[1:]] = 1
    return np.cumsum(ranks, out=ranks)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x += np.uint64(0x9E3779B97F4A7C15)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _strength(n: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Of n decisions so many took the way that is asked for."""
    return np.log((taken + PRIOR) / (n - taken + PRIOR))


class Codes:
    """The vocabulary and the ways of all symbols. Symbols are numbered by their place among the leaves: first the words and the escape, then the bytes and the terminator."""

    def __init__(self, words: pa.Array, counts: np.ndarray, spelled: np.ndarray, tokens: int) -> None:
        """spelled: how often the escape, each byte and the terminator occur in words outside the vocabulary; tokens: all training tokens."""
        self.words, k = words, len(words)
        self.logs = np.append(np.log10(counts + 1.0), 0.0)
        self.tokens, self.hash_bits = tokens, min(64 - SYMBOL_BITS - 1, max(32, tokens.bit_length() + HASH_BITS))
        weights = np.append(counts, spelled[0]).astype(np.int64), spelled[1:].astype(np.int64)
        (n1, c1, nodes, inner), (n2, c2, more_nodes, more) = (huffman(w) for w in weights)
        sizes, code, nodes = np.concatenate([n1, n2]), np.concatenate([c1, c2]), np.concatenate([nodes, more_nodes + inner])
        starts = np.cumsum(sizes) - sizes
        # From places in the vocabulary, escape, bytes and terminator to leaves.
        order = np.concatenate([np.argsort(code[: k + 1]), k + 1 + np.argsort(code[k + 1 :])])
        leaf = np.empty(len(order), np.int32)
        leaf[order] = np.arange(len(order), dtype=np.int32)
        self.n, self.n_words = len(order), k + 1
        self.leaf, self.rank = leaf, np.where(order < k, order, -1)
        self.escape, self.bytes_at, self.stop = int(leaf[k]), leaf[k + 1 : k + 257], int(leaf[k + 257])
        self.byte_of = np.zeros(self.n, np.uint8)
        self.byte_of[self.bytes_at] = np.arange(256)
        self.sizes, self.code = sizes[order], code[order]
        self.ways_at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.starts = self.ways_at[:-1].astype(np.int32)
        step = np.arange(len(nodes)) - np.repeat(self.starts, self.sizes)
        nodes = nodes[np.repeat(starts[order], self.sizes) + step]
        bit = (np.repeat(self.code, self.sizes) >> (51 - step).astype(np.uint64) & np.uint64(1)).astype(bool)
        freq = np.concatenate(weights)[order]
        per = np.repeat(freq, self.sizes)
        total, ones = (np.bincount(nodes, w, minlength=inner + more) for w in (per, per * bit))
        seen, taken = total[nodes], np.where(bit, ones[nodes], (total - ones)[nodes])
        #: For each decision of each way, the strength of its node without a context, towards the way.
        self.plain = _strength(seen, taken).astype(np.float32)
        #: The same in 5 bits, without one of those that took the way.
        self.plain_less = (np.rint(np.clip(_strength(np.maximum(seen - 1, 0), np.maximum(taken - 1, 0)) * PLAIN_STEPS, -16, 15)) + 16).astype(np.uint8)
        self.hot, self.frequent = (np.append(freq * k >= max(1, int(freq.sum())), k == FREQUENT) for k in (HOT, FREQUENT))
        group = self.code >> np.uint64(52 - SPLIT)
        first = _runs(group + (np.arange(self.n) >= self.n_words).astype(np.uint64) * np.uint64(1 << 60))
        #: The mixed numbers of all symbols, and of none.
        self.mixed = _mixed(np.arange(self.n + 1, dtype=np.uint64))
        #: The first leaf below the same node at depth SPLIT.
        self.first = np.repeat(first, np.diff(np.append(first, self.n))).astype(np.int32)

    @cached_property
    def ways(self) -> tuple[pa.Array, pa.Array]:
        """plain and plain_less by symbol."""
        return _ragged(self.plain, self.ways_at), _ragged(self.plain_less, self.ways_at)

    def symbols(self, tokens: pa.Array, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts, and where each text's begin."""
        rank = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy()
        lost = rank < 0
        size = np.where(lost, pc.binary_length(tokens).to_numpy() + 2, 1).astype(np.int64)
        ends = np.cumsum(size)
        values, plain = np.empty(ends[-1] if len(ends) else 0, np.int32), np.ones(ends[-1] if len(ends) else 0, bool)
        starts = ends - size
        values[starts] = np.where(lost, self.escape, self.leaf[rank])
        values[ends[lost] - 1] = self.stop
        plain[starts] = plain[ends[lost] - 1] = False
        values[plain] = self.bytes_at[_joined(tokens.filter(pa.array(lost)))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
        taken = lists.take(pa.array(of))
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[at]

    def key(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = context >> np.uint64(64 - self.hash_bits)
        key <<= np.uint64(SYMBOL_BITS)
        key |= symbol.astype(np.uint64)
        return key

    def keys(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all symbols in the short context, of some in the long one, and of the first decisions of some; which have a long context, and which words stand behind a hot symbol."""
        first = at[:-1][np.diff(at) > 0]

        def shifted(x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[first] = self.n
            return out

        last = shifted(symbols)
        second = shifted(last)
        third = shifted(second)
        spells = symbols >= self.n_words
        hot = self.hot.take(last) & ~spells
        deep = spells | self.frequent.take(last)
        one = self.mixed.take(last)
        behind = np.flatnonzero(deep)
        two = _mixed(one.take(behind) ^ second.take(behind).astype(np.uint64))
        among = np.flatnonzero(spells.take(behind))
        bytes_at, hot_at = behind.take(among), np.flatnonzero(hot)
        group, single = self.first.take(symbols.take(hot_at)), one.take(hot_at)
        one[bytes_at] = two.take(among)
        one[hot_at] = _mixed(single + group.astype(np.uint64), _GROUP)
        two[among] = _mixed(two.take(among) ^ third.take(bytes_at).astype(np.uint64))
        return np.concatenate([self.key(one, symbols), self.key(two, symbols.take(behind)), self.key(_mixed(single, _TOP), group)]), deep, hot

    def spelled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words outside the vocabulary begin, and their hashes."""
        at, ends = np.flatnonzero(symbols == self.escape), np.flatnonzero(symbols == self.stop)
        inside = symbols >= self.n_words
        inside[ends] = False
        sizes = ends - at - 1
        return at, _hashes(np.concatenate([[0], np.cumsum(sizes)]), self.byte_of.take(symbols[inside]))


def _packed(sizes: tuple[int, ...], *arrays: np.ndarray) -> bytes:
    """Arrays in one: numbers of so many bytes, byte planes apart, which compress better."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, n).T).tobytes() for n, a in zip(sizes, arrays))


def _unpacked(raw: np.ndarray, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of (type, length) and what is left."""
    at, out = 0, []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [*out, raw[at:]]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, their sums, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys.take(order)
    first = _runs(ordered)
    place = np.empty(len(keys), np.int64)
    place[order] = _ranks(first, len(keys))
    return ordered[first], np.add.reduceat(times[order], first) if len(first) else times[:0], place


def asked(codes: Codes, symbols: np.ndarray, at: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of a unit with their counts in training texts, and the different hashes of words outside the vocabulary with theirs, each in order."""
    learns = np.repeat(~held, np.diff(at))
    keys, deep, hot = codes.keys(symbols, at)
    keys <<= np.uint64(1)
    keys |= np.concatenate([learns, learns[deep], learns[hot]])
    keys.sort()
    learned = (keys & np.uint64(1)).astype(np.uint32)
    keys >>= np.uint64(1)
    first = _runs(keys)
    place, words = codes.spelled(symbols)
    words, n, _ = _summed(words, learns[place].astype(np.int64))
    return keys[first], np.add.reduceat(learned, first).astype(np.int64) if len(first) else np.zeros(0, np.int64), words, n


def ways(codes: Codes, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A byte for each decision on the way of each key's symbol: strength towards the way and class of the node's count in the context. keys are in order and whole contexts."""
    symbol = (keys & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)
    size, context = codes.sizes[symbol].astype(np.int64), keys >> np.uint64(SYMBOL_BITS)
    code = codes.code[symbol]
    # How many decisions a key's way shares with the one before it; -1 in another context.
    shared = np.full(len(keys), -1)
    if len(keys) > 1:
        same = context[1:] == context[:-1]
        shared[1:][same] = 52 - np.frexp((code[1:] ^ code[:-1])[same].astype(np.float64))[1]
    at = np.cumsum(size + 1) - size - 1
    n = np.repeat(times, size + 1)
    # A key alone below a node has the node's count all the way down, so only those in company go on.
    active, near, own, depth = np.arange(len(keys)), shared, times, 0
    while len(active):
        first = np.flatnonzero(near < depth)
        many = np.diff(np.append(first, len(active)))
        keep = np.repeat(many > 1, many)
        total = np.repeat(np.add.reduceat(own, first)[many > 1], many[many > 1])
        active, near, own = active[keep], near[keep], own[keep]
        n[at.take(active) + depth] = total
        depth += 1
    if not len(n):
        return np.zeros(0, np.uint8)
    inner = np.ones(len(n) - 1, bool)
    inner[(at + size)[:-1]] = False
    few = np.minimum(n, 63).astype(np.uint16)
    pair = few[:-1] << np.uint16(6)
    pair |= few[1:]
    out = _SMALL.take(pair)
    large = np.flatnonzero((pair >= 63 << 6) & inner)
    out[large] = _third(n.take(large), n.take(large + 1))
    return out[inner]


def _rounded(n: np.ndarray, taken: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(_strength(n, taken) * GRAIN, -32, 31)).astype(np.int16)


def _steps(n: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The byte of a node that was met n times and left so many times on the way that is asked for. It says strength and class (see _SAYS, _CLASS), and of small counts so much that one can be taken out again (see _LESS): both counts of the
    first class; of the second n where all took the way, else a strength and whether n is above 10; of the third a strength, with bytes of their own where one or two took the way."""
    strength, kind = _rounded(n, taken), np.searchsorted(CLASSES, n, side="right")
    first = n * (n + 1) // 2 - 1 + taken
    second = np.where(taken == n, n - 4, 28 + (strength + 8) * 2 + (n > 10))
    return np.select([kind == 1, kind == 2, kind == 3], [first << 2 | 1, second << 2 | 2, _third(n, taken)], 0).astype(np.uint8)


def _third(n: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The same of counts of the third class."""
    strength = _rounded(n, taken)
    out = (strength << 2 | 3).astype(np.uint8)
    few = np.flatnonzero((taken == 1) | (taken == 2))
    out[few] = (1 + (taken[few] - 1) * 29 - 5 - strength[few]) << 2
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte says: the strength, the class, and both in 6 bits for the counts without one that took the way."""
    says, kinds, less = np.zeros(256, np.float32), np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    # Counts that a byte of the second class stands for lie close together: those in the middle stand for all.
    small = [(n, t) for n in range(1, CLASSES[2]) for t in range(n + 1)]
    # One of many makes no difference to a strength of the third class, but where one or two took the way.
    large = [(t - PRIOR + (t + PRIOR) * math.exp(-s / GRAIN), t) for t in (1, 2) for s in range(t - 6, -33, -1)]
    n, taken = np.array(small + [(max(CLASSES[2] + 1, round(n)), t) for n, t in large]).T
    byte, strength, kind = _steps(n, taken), _rounded(n, taken), np.searchsorted(CLASSES, n, side="right")
    left = _six(_rounded(n - 1, np.maximum(taken - 1, 0)), np.searchsorted(CLASSES, n - 1, side="right"))
    for b in np.unique(byte):
        some = np.flatnonzero(byte == b)
        k = some[len(some) // 2]
        says[b], kinds[b], less[b] = strength[k] / GRAIN, kind[k], left[k]
    s = np.arange(-32, 32)
    third = (s << 2 | 3) & 255
    says[third], kinds[third], less[third] = s / GRAIN, 3, _six(s, np.full(64, 3))
    return says, kinds, less


def _six(strength: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Class and strength in 6 bits: 1, 9, 17 and 32 of them to a class."""
    return np.choose(kind, [0 * strength, 5 + strength, 18 + strength, 43 + np.clip(strength, -16, 15)])


_SMALL = np.concatenate([_steps(np.full(64, n), np.minimum(np.arange(64), n)) for n in range(64)])
_SAYS, _CLASS, _LESS = _tables()
#: Their parts of a gate and of a cell.
_SHORT_CLASS, _SHORT_LESS, _LONG_LESS = _CLASS * np.uint8(4), _LESS.astype(np.int64) << 5, _LESS.astype(np.int64) << 11


def answers(codes: Codes, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ways' bytes of different keys in order, worked out some contexts at a time, and where each key's begin."""
    context = _runs(keys >> np.uint64(SYMBOL_BITS))
    cuts = [0]
    for c in context[np.searchsorted(context, np.arange(MERGED, len(keys) + MERGED, MERGED), side="left").clip(max=len(context) - 1)] if len(context) else ():
        if c > cuts[-1]:
            cuts.append(int(c))
    out = [ways(codes, keys[a:b], times[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
    return np.concatenate(out) if out else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(codes.sizes[(keys & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)])])


def _ragged(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A ragged array as Arrow's, from where each row begins."""
    n = values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64) * n), pa.py_buffer(np.ascontiguousarray(values))])


def _taken(rows: pa.Array, which: np.ndarray, kind: type) -> np.ndarray:
    """Rows of a ragged array, one behind the other; read only. Arrow copies each as bytes, which is faster than place by place. Places aren't checked."""
    _, ends, data = pc.take(rows, pa.array(which), boundscheck=False).buffers()
    size = int(np.frombuffer(ends, np.int64)[len(which)]) if len(which) else 0
    return np.frombuffer(data, np.uint8)[:size].view(kind) if size else np.zeros(0, kind)


def mixed(plain: np.ndarray, seen: list[np.ndarray], gate: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text and its last weights, from its decisions' strengths without a context, what was seen in contexts, and their gates. sizes: how many decisions each text has; weights: predictors by gates."""
    d = len(sizes)
    now = [np.repeat(w[None, :], d, axis=0).astype(np.float32).ravel() for w in weights]
    total, starts = np.zeros(d), np.cumsum(sizes) - sizes
    # Each text's rounds are pieces; they are put behind each other round by round.
    early = ROUND * EARLY
    many = -(-np.minimum(sizes, early) // ROUND) + -(-np.maximum(sizes - early, 0) // LATER)
    text = np.repeat(np.arange(d), many)
    rounds = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    cuts = np.append(starts[text] + np.minimum(rounds, EARLY) * ROUND + np.maximum(rounds - EARLY, 0) * LATER, len(plain))
    order = np.argsort(rounds, kind="stable")
    plain, gate, *seen = (_taken(_ragged(x, cuts), order, x.dtype) for x in (plain, gate, *seen))
    text, size = text[order], np.diff(cuts)[order]
    firsts = _runs(rounds[order])
    hi = 0
    for a, b in zip(firsts, [*firsts[1:], len(order)]):
        active, n = text[a:b], size[a:b]
        ends = np.cumsum(n)
        begins, lo = ends - n, hi
        hi = lo + int(ends[-1])
        cell = np.repeat(active * GATES, n)
        cell += gate[lo:hi]
        xs = [plain[lo:hi].copy(), *(_SAYS.take(x[lo:hi]) for x in seen)]
        # Clipping does nothing to places within bounds, and is faster than checking them.
        odds = now[0].take(cell, mode="clip")
        odds *= xs[0]
        for w, a in zip(now[1:], xs[1:]):
            part = w.take(cell, mode="clip")
            part *= a
            odds += part
        np.clip(odds, -12, 12, out=odds)
        miss = np.exp(np.negative(odds, out=odds), out=odds)
        loss = miss + np.float32(1)
        miss /= loss
        total[active] += np.add.reduceat(np.log(loss, out=loss), begins, dtype=np.float64)
        step = STEP / np.sqrt(np.maximum(1, np.bincount(cell, minlength=GATES * d)))
        for w, a in zip(now, xs):
            a *= miss
            w += (step * np.bincount(cell, a, minlength=GATES * d)).astype(np.float32)
    return -total / math.log(10), np.stack([w.reshape(d, GATES) for w in now], axis=1)


def starting_weights() -> np.ndarray:
    """Before they are fitted, for each predictor the weights by gate: a context seen more often gets more, what it lacks goes to the next shorter one."""
    long = np.tile([0.0, 0.2, 0.4, 0.6], GATES // 4)
    short = (1 - long) * np.tile(np.repeat([0.0, 0.4, 0.7, 0.9], 4), GATES // 16)
    long[32:] = 0
    return np.stack([1 - short - long, short, long])


class Unit:
    """A unit's symbols with the answers for each: ready to score."""

    def __init__(self, codes: Codes, symbols: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """values: the bytes of the ways of the unit's different keys, in the keys' order."""
        self.codes, self.symbols, self.at = codes, symbols, at
        every, deep, hot = codes.keys(symbols, at)
        order = np.argsort(every)
        ordered = every.take(order)
        first = _runs(ordered)
        sizes = codes.sizes[(ordered[first] & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)]
        if int(sizes.sum()) != len(values):
            raise RuntimeError("answers of another unit")
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.empty(len(every), np.int32)
        place[order] = _ranks(first, len(every))
        n = len(symbols)
        self.order, self.first, self.deep = order, first, deep
        #: The places of each symbol's keys; where there is no long context, that of the short one again.
        self.short = place[:n]
        self.long, top = self.short.copy(), np.zeros(n, np.int32)
        self.long[deep], top[hot] = np.split(place[n:], [np.count_nonzero(deep)])
        #: What is coded: 0 a word, 1 a byte, 2 a word without a long context.
        self.kind = (symbols >= codes.n_words).view(np.uint8) + np.uint8(2) * ~deep
        # The first decisions behind hot words are known from keys of their own; they are put in place once for each key.
        one = order[first]
        one = one[one < n]
        one = one[hot[one]]
        size = np.minimum(codes.sizes[symbols[one]], SPLIT)
        for k in range(SPLIT):
            at = one[size > k]
            values[offsets[self.short[at]] + k] = values[offsets[top[at]] + k]
        self.values = _ragged(values, offsets)

    def scored(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and last weights of each text; whole texts, about CHUNK symbols, at once: those of about a length, so that rounds have many texts."""
        n = np.diff(self.at)
        order = np.argsort(n, kind="stable")
        group = np.cumsum(n[order]) // CHUNK
        scores, last = np.zeros(len(n)), np.zeros((len(n), *weights.shape), np.float32)
        for some in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(n) else ():
            scores[some], last[some] = self._scored(some, weights)
        return scores, last

    def _scored(self, some: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(self.at)[some]
        stops = np.cumsum(n)
        plain, short, long, kind, size = self._known(np.repeat(self.at[some] - (stops - n), n) + np.arange(stops[-1]), False)
        kind <<= np.uint8(4)
        kind += _SHORT_CLASS.take(short)
        kind += _CLASS.take(long)
        ends = np.cumsum(size, dtype=np.int64)
        return mixed(plain, [short, long], kind, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], stops])]), weights)

    def _known(self, s: np.ndarray, less: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the decisions of the symbols at some places, what is known without a context and in each, what is coded, and how many each symbol has. less: without a context as in plain_less."""
        symbols = self.symbols.take(s)
        size = self.codes.sizes.take(symbols)
        kind = np.repeat(self.kind.take(s), size)
        short, long = (_taken(self.values, x.take(s), np.uint8) for x in (self.short, self.long))
        return _taken(self.codes.ways[less], symbols, np.uint8 if less else np.float32), short, long * (kind != 2), kind, size

    def learned(self, held: np.ndarray) -> np.ndarray:
        """How many decisions of the texts not held out there are of each cell: what is known from all occurrences but the decision's own. Equal symbols in equal contexts are looked at once, where they have a long context in that, else in the short one."""
        n, places = len(self.symbols), np.flatnonzero(self.deep)
        learns = np.repeat(~held, np.diff(self.at))
        every = np.concatenate([learns & ~self.deep, learns[places], np.zeros(len(self.order) - n - len(places), bool)])
        times = np.add.reduceat(every.take(self.order), self.first, dtype=np.int64) if n else np.zeros(0, np.int64)
        which = np.flatnonzero(times)
        one, times = self.order.take(self.first.take(which)), times.take(which)
        long = one >= n
        one[long] = places.take(one[long] - n)
        out = np.zeros(CELLS, np.int64)
        for at in range(0, len(one), CHUNK):
            plain, short, long, kind, size = self._known(one[at : at + CHUNK], True)
            cell = _SHORT_LESS.take(short)
            cell |= _LONG_LESS.take(long)
            cell |= plain
            cell |= kind.astype(np.int64) << 17
            np.add.at(out, cell, np.repeat(times[at : at + CHUNK], size))
        return out


#: What is coded, and what is known in the long context, in the short one and without one, in 2, 6, 6 and 5 bits.
CELLS = 3 << 17


def fitted(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Starting weights that give the decisions of all training texts the highest probability, by Newton's method, each gate for itself. cells with n decisions each, in order."""
    strength = np.concatenate([[0], np.arange(-4, 5), np.arange(-8, 9), np.arange(-16, 16), np.zeros(5)]) / GRAIN
    kinds = np.repeat([0, 1, 2, 3, 0], [1, 9, 17, 32, 5])
    short, long = cells >> 5 & 63, cells >> 11 & 63
    gate = kinds[short] * 4 + kinds[long] + 16 * (cells >> 17)
    x = np.stack([((cells & 31) - 16) / PLAIN_STEPS, strength[short], strength[long]], axis=1)
    weights = starting_weights()
    for g in np.unique(gate):
        some = gate == g
        a, m, start = x[some], n[some].astype(np.float64), weights[:, g].copy()

        def loss(w: np.ndarray) -> float:
            return float(m @ np.logaddexp(0, -(a @ w)) + FIT_PRIOR / 2 * ((w - start) @ (w - start)))

        w, now = start, loss(start)
        for _ in range(FIT_ROUNDS):
            miss = 1 / (1 + np.exp(np.clip(a @ w, -50, 50)))
            slope = FIT_PRIOR * (w - start) - a.T @ (m * miss)
            step = np.linalg.solve((a * (m * miss * (1 - miss))[:, None]).T @ a + FIT_PRIOR * np.eye(3), slope)
            far = 1.0
            while far > 1e-6 and not (after := loss(w - far * step)) < now:
                far /= 2
            if far <= 1e-6:
                break
            done = now - after < 1e-9 * now
            w, now = w - far * step, after
            if done:
                break
        weights[:, g] = w
    return weights


class Model:
    def __init__(self, codes: Codes, weights: np.ndarray) -> None:
        self.codes, self.weights = codes, weights


def _units(codes: Codes, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A unit's number, its batch and bodies, which texts are held out, its symbols, and where each text's begin."""
    g = TaskContext.get().partitionId() << 33
    for part in slices(batches, UNIT_BYTES):
        bodies, held = _training(part)
        yield g, part, bodies, np.array(held, bool), *codes.symbols(*tokenised(bodies))
        g += 1


_ROWS = "p int, g long, data binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["p", "g", "data"])


def _asks(shared, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each unit tells and asks each of 2 ** ranges ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        edges = np.arange((1 << ranges) + 1, dtype=object)
        key_edges, word_edges = ([min(int(e) << bits - ranges, (1 << 64) - 1) for e in edges] for bits in (codes.hash_bits + SYMBOL_BITS, 64))
        zipped = zstandard.ZstdCompressor(level=1)
        for g, _, _, held, symbols, at in _units(codes, batches):
            keys, times, words, n = asked(codes, symbols, at, held)
            a, b = np.searchsorted(keys, np.array(key_edges, np.uint64)), np.searchsorted(words, np.array(word_edges, np.uint64))
            b[-1] = len(words)
            rows = []
            for p in range(1 << ranges):
                k, w = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                if k.stop > k.start or w.stop > w.start:
                    head = np.array([k.stop - k.start], "<i8").tobytes()
                    rows.append((p, g, zipped.compress(head + _packed((8, 4, 8, 4), np.diff(keys[k], prepend=np.uint64(0)), times[k].astype("<u4"), np.diff(words[w], prepend=np.uint64(0)), n[w].astype("<u4")))))
            yield _batch(rows)

    return run


def _message(raw: np.ndarray) -> list[np.ndarray]:
    k = int(raw[:8].view("<i8")[0])
    keys, times, rest = _unpacked(raw[8:], ("<u8", k), ("<u4", k))
    w = len(rest) // 12
    words, n, _ = _unpacked(rest, ("<u8", w), ("<u4", w))
    return [np.cumsum(keys, dtype=np.uint64), times.astype(np.int64), np.cumsum(words, dtype=np.uint64), n.astype(np.int64)]


def _answer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges a range's messages and answers each. Rows come by range; one range's messages are held."""

    def answered(codes: Codes, p: int, messages: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        unzip, zipped = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        parts = [_message(np.frombuffer(unzip.decompress(data), np.uint8)) for _, data in messages]
        keys, times, words, n = (np.concatenate(x) for x in zip(*parts))
        ends, word_ends = np.cumsum([len(x[0]) for x in parts]), np.cumsum([len(x[2]) for x in parts])
        del parts
        keys, times, place = _summed(keys, times)
        words, n, word_place = _summed(words, n)
        values, at = answers(codes, keys, times)
        rows = _ragged(values, at)
        told = ((p, g, zipped.compress(np.array([d - c], "<i8").tobytes() + _packed((8,), n[word_place[c:d]].astype("<i8")) + _taken(rows, place[a:b], np.uint8).tobytes())) for (g, _), a, b, c, d in zip(messages, [0, *ends], ends, [0, *word_ends], word_ends))
        while some := list(islice(told, 64)):
            yield _batch(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for p, g, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != now:
                    if held:
                        yield from answered(shared.value, now, held)
                    now, held = p, []
                held.append((g, data))
        if held:
            yield from answered(shared.value, now, held)

    return run


def _pieces(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The units themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, bodies, held, symbols, at in _units(shared.value, batches):
            docs = pa.RecordBatch.from_arrays([part.column(0), pa.array(held), pa.array([len(b) for b in bodies], pa.int64()), pa.array(np.diff(at), pa.int64())], ["doc_id", "held_out", "n_bytes", "n_symbols"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as w:
                w.write_batch(docs)
            head = sink.getvalue().to_pybytes()
            yield _batch([(-1, g, zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(8, "little") + head + _packed((4,), symbols.astype("<i4"))))])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def _delivered(codes: Codes, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Unit, np.ndarray]]:
    """Units of texts: the documents, the unit, and its words' counts. Each unit's own row is followed by its answers, by range."""
    unzip = zstandard.ZstdDecompressor()

    def made(piece: bytes, found: list[bytes]) -> tuple[pa.RecordBatch, Unit, np.ndarray]:
        raw = unzip.decompress(piece)
        head = int.from_bytes(raw[:8], "little")
        docs = pa.ipc.open_stream(raw[8 : 8 + head]).read_next_batch()
        n = (len(raw) - 8 - head) // 4
        symbols = _unpacked(np.frombuffer(raw, np.uint8)[8 + head :], ("<i4", n))[0]
        at = np.concatenate([[0], np.cumsum(docs.column(3).to_numpy())])
        counts, values = [], []
        for data in found:
            x = np.frombuffer(unzip.decompress(data), np.uint8)
            k, rest = _unpacked(x[8:], ("<i8", int(x[:8].view("<i8")[0])))
            counts.append(k)
            values.append(rest)
        return docs, Unit(codes, symbols, at, np.concatenate(values)), np.concatenate(counts)

    piece, found = None, []
    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if p < 0:
                if piece:
                    yield made(piece, found)
                piece, found = data, []
            else:
                found.append(data)
    if piece:
        yield made(piece, found)


def _learned(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells of the training texts' decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CELLS, np.int64)
        for docs, unit, _ in _delivered(shared.value, batches):
            out += unit.learned(docs.column(1).to_numpy(zero_copy_only=False))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["cell", "n"])

    return run


def _scores(shared, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        for docs, unit, counts in _delivered(codes, batches):
            scores, _ = unit.scored(weights)
            symbols, at = unit.symbols, unit.at
            word = symbols < codes.n_words
            doc = np.repeat(np.arange(docs.num_rows), np.diff(at))
            base, rank = codes.logs[codes.rank[symbols[word]]], codes.rank[symbols[word]]
            known, (place, hashes) = (rank >= 0).astype(np.int64), codes.spelled(symbols)
            # The place of each word's first symbol among those of words.
            c = counts[np.unique(hashes, return_inverse=True)[1]]
            lost = (np.cumsum(word) - 1)[place]
            base[lost], known[lost] = np.log10(c + 1.0), c > 0
            of, d = doc[word], docs.num_rows
            yield pa.RecordBatch.from_arrays(
                [docs.column(0), docs.column(1), pa.array(np.bincount(of, minlength=d)), pa.array(np.bincount(of, known, minlength=d).astype(np.int64)), pa.array(np.bincount(of, base, minlength=d)), pa.array(scores), docs.column(2)],
                [x.split()[0] for x in _SCORED.split(", ")],
            )

    return run


def _spelled(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often the escape, each byte and the terminator occur in the words outside the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(258, np.int64), shared.value

        def add(some: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(some).combine_chunks()
            tokens = rows.column(0).cast(pa.binary()).combine_chunks()
            lost = pc.is_null(pc.index_in(tokens, value_set=known))
            words, n = tokens.filter(lost), rows.column(1).combine_chunks().filter(lost).to_numpy()
            sums[[0, 257]] += n.sum()
            np.add.at(sums, _joined(words).astype(np.int64) + 1, np.repeat(n, pc.binary_length(words).to_numpy()))

        # The words are put in a table of hashes for each look-up, so many batches share one.
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= UNIT_BYTES:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(258)), pa.array(sums)], ["s", "n"])

    return run


def _vocabulary(counts: DataFrame) -> pa.Table:
    """The most frequent tokens of at least LEAST, with their counts, at most VOCABULARY. Counts fall into classes, 16 to a doubling; of the class that has no room as a whole a share is taken by the tokens' hashes. Only the
    classes' sizes and the taken rows come to the driver."""
    counts = counts.filter(F.col("n") >= LEAST)
    kind, room, most, share = F.floor(F.log2(F.col("n")) * 16).cast("int"), VOCABULARY, None, 0
    for r in sorted(counts.groupBy(kind.alias("kind")).count().collect(), reverse=True):
        most = r["kind"]
        share = SHARES if r["count"] <= room else int(0.97 * SHARES * room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    taken = counts.filter((kind > F.lit(most)) | ((kind == F.lit(most)) & (F.pmod(F.xxhash64("token"), F.lit(SHARES)) < share)))
    return taken.toArrow().sort_by([("n", "descending"), ("token", "ascending")]).slice(0, VOCABULARY).combine_chunks()


def _kept(df: DataFrame) -> DataFrame:
    """The same rows for several uses: their shuffle is run once and read by each, with no copy on disk."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def _prepared(source: DataFrame) -> tuple[Model, int, int, Broadcast, DataFrame]:
    """The model, how many training tokens there are and how many different ones, the codes for the executors, and all units with their answers. source: doc_id, text (binary)."""
    spark = source.sparkSession
    counts = written(source.mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top, n = _vocabulary(counts), total["n"] or 0
    spelled = np.zeros(258, np.int64)
    words = top.column("token").cast(pa.binary()).combine_chunks()
    for r in counts.mapInArrow(_spelled(spark.sparkContext.broadcast(words)), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        spelled[r["s"]] = r["n"]
    codes = Codes(words, top.column("n").to_numpy(), spelled, n)
    shared = spark.sparkContext.broadcast(codes)
    ranges, parts = max(1, n // RANGE).bit_length(), max(1, n // PART)
    told = source.mapInArrow(_asks(shared, ranges), _ROWS).repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_answer(shared), _ROWS)
    units = _kept(source.mapInArrow(_pieces(shared), _ROWS).union(told).repartition(parts, "g").sortWithinPartitions("g", "p"))
    cells = units.mapInArrow(_learned(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    return Model(codes, fitted(cells.column("cell").to_numpy(), cells.column("n").to_numpy())), n, total["v"], shared, units


def trained(source: DataFrame) -> tuple[Model, int, int]:
    """Codes and starting weights, how many training tokens there are and how many different ones. source: doc_id, text (binary)."""
    return _prepared(source)[:3]


def scored(docs: DataFrame, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of documents (doc_id, text). Texts are read three times and must come in the same order, so they are written first
    unless docs is stable: a table read from files."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if not stable:
        source = written(source, "texts")
    model, n, v, shared, units = _prepared(source)
    rows = units.mapInArrow(_scores(shared, model.weights), _SCORED)
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), stable=True)
