"""SentencePiece encoding and decoding with sampled segmentations, drawn without replacement by Gumbel top-k.

All ways to spell a text with the vocabulary's pieces form a lattice; a piece's weight depends on its rank in the
vocabulary. Sums over the rest of a word's lattice turn weights into conditional probabilities of steps, so a path can be
drawn from any place on. The search keeps sub-lattices by their perturbed log-probability, the largest of all their
segmentations'. The best one is opened: a path is drawn in it, which is its maximum, and what remains is split by the
first step that differs from the path. The parts' maxima are drawn under that of the whole. Taking the best part
again and again yields segmentations in falling order of perturbed log-probability: a sample without replacement.

Lattices of words are kept as flat arrays, so paths are drawn, and lattices are split, for all words of a batch of texts at
once. Draws are hashes of the row's seed and the step's place, so a row gets the same sample wherever and however often its
task runs, and whatever shares its batch.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from tabulon.llm.common import table
from tabulon.llm.tokens import tokenizer_path

SPACE = "▁"
SAMPLES, SEED = 4, 17
#: Pieces weigh as words of a text do by rank: 1 / (rank + SHIFT).
SHIFT = 2.7
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Steps of lattices that are remembered; beyond, all are forgotten and built anew as they come.
_REMEMBER = 2_000_000
#: Words that are remembered so, and the length up to which words that end alike share nodes.
_KNOWN, _ALIKE = 400_000, 32
#: Characters of the texts that are sampled together, and what a short text counts for.
_TOGETHER, _SHORT = 400_000, 128
#: Words that are encoded together.
_ENCODED = 128
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The largest draw below 1, and more than the most that it adds to a log-probability.
_TOP, _MOST = 1 - 2.0**-53, 37.0
#: Steps of a path that are drawn for first, a power of 2.
_HEAD = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash, element by element."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def _uniform(x: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) from hashes."""
    x = _mixed(x)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def _log_rest(share: np.ndarray) -> np.ndarray:
    """Logarithms of the probability of a node's other arcs."""
    with np.errstate(divide="ignore"):
        return np.log1p(-np.minimum(share, 1.0))


def _gumbel(x: np.ndarray) -> np.ndarray:
    """What draws from hashes add to log-probabilities."""
    return -np.log(-np.log(np.minimum(_uniform(x), _TOP)))


_ALL = (1 << 64) - 1


def _hashed(*parts: int) -> int:
    """The same hash of a few numbers."""
    x = 0
    for p in parts:
        x = (x * 0x9E3779B97F4A7C15 + p) & _ALL
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
        x ^= x >> 31
    return x


def _draw(x: int) -> float:
    return ((x >> 11) + 0.5) * 2.0**-53


class Lattices:
    """Nodes are places in words, arcs are steps of one id; a node's arcs lie together, the likeliest first.

    What follows a place depends on the rest of its word alone, so words that end alike share the nodes of that end.
    """

    #: For nodes: the first arc; and together, as they are read together, its probability, itself, the number of arcs and where it leads;
    #: its letter and the node behind it in one number, -1 for nodes that aren't shared, and the sum over what follows. For arcs: the
    #: node they lead to, -1 at the end of a word, their id and the conditional probability. For words: their first node.
    NODES = {"first": np.int32, "node": np.dtype([("share", np.float64), ("first", np.int32), ("count", np.int32), ("target", np.int32)], align=True), "key": np.int64, "rest": np.float64}
    ARCS = {"target": np.int32, "ids": np.int32, "share": np.float64}
    WORDS = {"root": np.int32}

    def __init__(self, pieces: dict[str, tuple[int, float]], spell: list[int], byte_weight: float) -> None:
        self.spell, self.byte_weight = np.array(spell, dtype=np.int32), math.log(byte_weight)
        #: Beginnings of pieces, numbered; the empty one is 0, and no piece.
        known = {"": 0}
        for p in pieces:
            for n in range(1, len(p) + 1):
                known.setdefault(p[:n], len(known))
        letters = {c: i for i, c in enumerate(sorted({k[-1] for k in known if k}), 1)}
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        self.piece, self.weight = np.full(len(known), -1, dtype=np.int32), np.zeros(len(known))
        for p, (i, w) in pieces.items():
            self.piece[known[p]], self.weight[known[p]] = i, math.log(w)
        # which beginning another one and a letter make: an open hash table of both numbers in one
        keys, made = np.array([known[k[:-1]] * self.letters + letters[k[-1]] for k in known if k], dtype=np.int64), np.arange(1, len(known), dtype=np.int32)
        self.bits = max(4, (4 * len(known)).bit_length())
        self.keys, self.nexts = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.nexts[slot] = made
        self.held = {c: np.empty(0, dtype=kind) for c, kind in (self.NODES | self.ARCS | self.WORDS).items()}
        #: Shared nodes by the hash of their keys.
        self.shared = np.empty(1 << 16, dtype=np.int32)
        self.forget()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _longer(self, begun: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Beginnings with one letter more, 0 where no piece begins so."""
        keys = begun.astype(np.int64) * self.letters + letter
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.nexts[slot], 0)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.nexts[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.sizes = dict.fromkeys(self.held, 0)
        self.shared.fill(-1)

    @property
    def arcs(self) -> int:
        return self.sizes["ids"]

    def view(self, column: str) -> np.ndarray:
        return self.held[column][: self.sizes[column]]

    def _reserve(self, column: str, more: int) -> np.ndarray:
        size, held = self.sizes[column], self.held[column]
        if size + more > len(held):
            self.held[column] = np.empty(max(2 * len(held), size + more), dtype=held.dtype)
            self.held[column][:size] = held[:size]
        return self.held[column]

    def _append(self, made: dict[str, np.ndarray]) -> None:
        for c, x in made.items():
            size = self.sizes[c]
            self._reserve(c, len(x))[size : size + len(x)] = x
            self.sizes[c] += len(x)

    def _share(self, keys: np.ndarray, known: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of ``keys``, new ones numbered from ``nodes`` on, and which of the keys are the new nodes'. ``known``: the keys of nodes."""
        last = len(self.shared) - 1
        slot = ((keys.astype(np.uint64) * _GOLD) >> np.uint64(65 - len(self.shared).bit_length())).astype(np.int64)
        out, left = np.empty(len(keys), dtype=np.int32), np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = slot[left]
            free = self.shared[at] == -1
            self.shared[at[free]] = -2 - left[free]  # of several, one stays and stands for those of its key
            there = self.shared[at]
            own = there < -1
            hit = np.where(own, keys[np.where(own, -2 - there, 0)], known[np.where(own, 0, there)]) == keys[left]
            out[left[hit]] = there[hit]
            left = left[~hit]
            slot[left] = (slot[left] + 1) & last
        new = np.flatnonzero(out == -2 - np.arange(len(keys)))
        number = np.zeros(len(keys), dtype=np.int32)
        number[new] = np.arange(nodes, nodes + len(new))
        self.shared[slot[new]] = number[new]
        own = out < -1
        out[own] = number[-2 - out[own]]
        return out, new

    def _places(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of all places, and places of the new nodes, in their order: by how much of their word is left."""
        n, nodes = len(codes), self.sizes["first"]
        key = self._reserve("key", n)
        if 2 * (nodes + n) > len(self.shared):
            self.shared = np.full(1 << (2 * (nodes + n)).bit_length(), -1, dtype=np.int32)
            old = np.flatnonzero(key[:nodes] >= 0)
            slot, on = ((key[old].astype(np.uint64) * _GOLD) >> np.uint64(65 - len(self.shared).bit_length())).astype(np.int64), np.arange(len(old))
            while len(on):
                free = on[self.shared[slot[on]] < 0]
                self.shared[slot[free]] = old[free]
                on = on[self.shared[slot[on]] != old[on]]
                slot[on] = (slot[on] + 1) & (len(self.shared) - 1)
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        node, places = np.full(n + 1, -1, dtype=np.int32), []
        levels = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=_ALIKE + 1)[1 : _ALIKE + 1]))).tolist()
        for length, (a, b) in enumerate(zip(levels, levels[1:], strict=False), 1):
            if a == b:
                break
            here = order[a:b]
            keys = codes[here].astype(np.int64)
            if length > 1:
                keys += (node[here + 1] + np.int64(1)) << 21
            node[here], new = self._share(keys, key, nodes)
            key[nodes : nodes + len(new)] = keys[new]
            nodes += len(new)
            places.append(here[new])
        alone = order[levels[-1] :]
        node[alone] = np.arange(nodes, nodes + len(alone))
        key[nodes : nodes + len(alone)] = -1
        return node, np.concatenate([*places, alone])

    def add(self, words: list[str], codes: np.ndarray, sizes: np.ndarray) -> None:
        """Builds the lattices of new words: a node for each character, and for each further byte of those spelt in bytes.

        Nodes are numbered by how much of their word is left, so sums over the rest of words go from node to node.
        """
        ends, nodes = np.cumsum(sizes), self.sizes["first"]
        left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters up to the end of the word
        node_at, place = self._places(codes, left)
        n, left = len(place), left[place]
        # pieces that begin at a place, by length
        letter = self.letter[codes]
        at, begun, found, length = np.arange(n), self._longer(np.zeros(n, dtype=np.int32), letter[place]), [], 1
        spelt = np.flatnonzero(self.piece[begun] < 0)
        while len(at):
            whole = np.flatnonzero(self.piece[begun] >= 0)
            found.append((at[whole], begun[whole], length))
            if length == 1:
                found.append((spelt, np.zeros(len(spelt), dtype=np.int32), 1))  # a character without a piece of its own is spelt in bytes, one step each
            on = np.flatnonzero((begun > 0) & (left[at] > length))
            at, begun = at[on], begun[on]
            begun = self._longer(begun, letter[place[at] + length])
            length += 1
        count = np.zeros(n, dtype=np.int32)
        for mine, *_ in found:
            count[mine] += 1
        first = np.cumsum(count, dtype=np.int32) - count
        arcs, filled = int(count.sum()), first + count
        target, piece, weight = np.empty(arcs, dtype=np.int32), np.empty(arcs, dtype=np.int32), np.empty(arcs)
        letters = codes[place[spelt]]
        bytes_of = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
        for mine, known, length in found:
            slot = filled[mine] - 1  # longer pieces come first, as they are likelier for the most part
            filled[mine] = slot
            target[slot] = np.where(left[mine] == length, -1, node_at[place[mine] + length])
            piece[slot], weight[slot] = self.piece[known], self.weight[known]
        weight[piece < 0] = bytes_of * self.byte_weight
        # sums over the rest of the word from its end on, all words at a time
        rest, share = self._reserve("rest", n), np.empty(arcs)
        levels = np.cumsum(np.bincount(left)) if n else []
        for a, b in zip(levels, levels[1:], strict=False):
            if a == b:
                continue
            low, high = first[a], first[b - 1] + count[b - 1]
            to, starts, each = target[low:high], first[a:b] - low, count[a:b]
            sums = weight[low:high] + np.where(to < 0, 0.0, rest[to])
            top = np.maximum.reduceat(sums, starts)
            sums -= np.repeat(top, each)
            part = np.exp(sums)
            total = np.add.reduceat(part, starts)
            rest[nodes + a : nodes + b] = top + np.log(total)
            share[low:high] = part / np.repeat(total, each)
        # the likeliest first
        for c in np.flatnonzero(np.bincount(count)).tolist():
            if c > 1:
                to = first[count == c][:, None] + np.arange(c)
                some = share[to]
                wrong = np.flatnonzero((some[:, 1:] > some[:, :-1]).any(axis=1))
                to, some = to[wrong], some[wrong]
                back = to[:, ::-1] if c == 2 else to[:, :1] + np.argsort(-some, axis=1, kind="stable")
                for x in (target, piece, share):
                    x[to] = x[back]
        # the further bytes of spelt characters
        more: list[tuple[int, int]] = []
        for arc, c in zip(np.flatnonzero(piece < 0).tolist(), letters.tolist(), strict=True) if len(spelt) else ():
            b = chr(c).encode("utf-8", "surrogatepass")
            piece[arc], after = self.spell[b[0]], int(target[arc])
            for i in range(1, len(b)):
                more.append((after if i == len(b) - 1 else nodes + n + len(more) + 1, int(self.spell[b[i]])))
            if len(b) > 1:
                target[arc] = nodes + n + len(more) - len(b) + 1
        chained = np.array(more, dtype=np.int32).reshape(-1, 2)
        self.words |= dict(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        node = np.empty(n + len(more), dtype=self.NODES["node"])
        node["first"], node["count"] = np.concatenate((first, arcs + np.arange(len(more)))) + self.arcs, np.concatenate((count, np.ones(len(more), dtype=np.int32)))
        node["share"], node["target"] = np.concatenate((share[first], np.ones(len(more)))), np.concatenate((target[first], chained[:, 0]))
        self.sizes["key"] = self.sizes["rest"] = nodes + n
        self._append({"root": node_at[ends - sizes], "first": node["first"], "node": node, "key": np.full(len(more), -1), "rest": np.zeros(len(more))})
        self._append({"target": target, "ids": piece, "share": share})
        self._append({"target": chained[:, 0], "ids": chained[:, 1], "share": np.ones(len(more))})

    def walk(self, nodes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths from ``nodes`` to the ends of their words: where each begins, the end last, and the arcs of all steps and their probabilities."""
        node, target, share = map(self.view, ("node", "target", "share"))
        steps, taken = np.zeros(len(nodes), dtype=np.int64), []
        at = np.flatnonzero(nodes >= 0)
        now, seed = nodes[at], draws[at]
        while len(at):
            seed += _GOLD
            read = node.take(now)
            arc, now, part, some = read["first"].copy(), read["target"].copy(), read["share"].copy(), read["count"]
            several = np.flatnonzero(some > 1)
            u = _uniform(seed[several])
            u -= part[several]
            left = np.flatnonzero(u >= 0)
            if len(left):  # the likeliest arcs come first, so few go on
                u, several = u[left], several[left]
                here, on = arc[several] + 1, np.arange(len(left))
                last = here + some[several] - 2
                while len(on := on[here[on] < last[on]]):
                    u[on] -= share[here[on]]
                    on = on[u[on] >= 0]
                    here[on] += 1
                arc[several], now[several], part[several] = here, target[here], share[here]
            taken.append((at, arc, part))
            steps[at] += 1
            on = np.flatnonzero(now >= 0)
            at, now, seed = at[on], now[on], seed[on]
        starts = np.zeros(len(nodes) + 1, dtype=np.int64)
        np.cumsum(steps, out=starts[1:])
        arcs, parts = np.empty(starts[-1], dtype=np.int32), np.empty(starts[-1])
        for i, (at, arc, part) in enumerate(taken):
            to = starts[at] + i
            arcs[to], parts[to] = arc, part
        return starts, arcs, parts


class _Path:
    """A drawn segmentation: its arcs, log-probabilities before each and in all, perturbed value."""

    __slots__ = ("arcs", "before", "total", "value")

    def __init__(self, arcs: np.ndarray, before: np.ndarray, total: float, value: float) -> None:
        self.arcs, self.before, self.total, self.value = arcs, before, total, value


class Sampler:
    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = sentencepiece.SentencePieceNormalizer(model_file=path).Normalize
        n, kind = self.model.vocab_size(), self.model
        ordinary = [i for i in range(n) if not (kind.is_control(i) or kind.is_unknown(i) or kind.is_unused(i) or kind.is_byte(i))]
        total = sum(1 / (r + SHIFT) for r in range(len(ordinary)))
        pieces = {kind.id_to_piece(i): (i, 1 / (r + SHIFT) / total) for r, i in enumerate(ordinary)}
        #: What each id decodes to, in bytes.
        surface = [b"" if kind.is_control(i) or kind.is_unused(i) else bytes([int(kind.id_to_piece(i)[3:5], 16)]) if kind.is_byte(i) else " \u2047 ".encode() if kind.is_unknown(i) else kind.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.surface, self.widths = pa.array(surface, pa.large_binary()), np.array([len(x) for x in surface])
        #: No piece goes on behind the end of a word, so a text's plain encoding is that of its words.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lattices = Lattices(pieces, [kind.piece_to_id(f"<0x{b:02X}>") for b in range(256)], 1 / (len(ordinary) + SHIFT) / total)
        #: Plain encodings of the words of the lattices, by number, and where they begin, the end last. -1 stands for a word without one.
        self.plain, self.starts = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]

    def raw(self, ids: Sequence[np.ndarray]) -> list[bytes]:
        """What sequences of ids decode to, in bytes, without the space in front."""
        taken = self.surface.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a + (data[a : a + 1] == b" ") : b]) if a < b else b"" for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """As the model decodes: the pieces without the space in front; bytes that are no text become replacement characters."""
        return self.raw([ids])[0].decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        text = self.normalise(text) if text else ""
        if "\0" in text or text[:1] != SPACE or text[-1:] == SPACE or 2 * SPACE in text:
            return _WORDS.findall(text)
        return text.replace(SPACE, "\0" + SPACE).split("\0")[1:]  # the same, in less time

    def learn(self, words: list[str]) -> None:
        """Lattices and plain encodings of new words."""
        if not self.lattices.words:
            self.plain, self.starts = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
        # spaces alone would join the next word; texts that end in them are encoded whole
        blank = [w for w in words if w[-1] == SPACE]
        words = [*blank, *(w for w in words if w[-1] != SPACE)] if blank else words
        codes, sizes = self.lattices.codes(words), np.fromiter(map(len, words), np.int64, len(words))
        self.lattices.add(words, codes, sizes)
        bytes_of = np.where(codes == ord(SPACE), 1, 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
        ends, made = np.cumsum(np.add.reduceat(bytes_of, np.cumsum(sizes) - sizes)), []
        low, base, by_word = 0, 0, self.by_word and bool((codes[np.cumsum(sizes) - sizes] == ord(SPACE)).all())
        while low < len(words):
            some = words[low : len(blank) if low < len(blank) else low + _ENCODED]
            joined, high = "".join(some), low + len(some)
            text = joined[1:].replace(SPACE, " ")
            # words that the model does not take apart as they are have no encoding here, so their texts are encoded whole
            ids = np.array(self.model.encode(text) if by_word and self.normalise(text) == joined else [], dtype=np.int32)
            own, found = ends[low:high] - base, np.cumsum(self.widths[ids])
            cut = np.searchsorted(found, own) + 1
            if len(ids) and cut[-1] == len(ids) and (found[cut - 1] == own).all():
                made.append((ids, cut))
            else:
                made.append((np.full(len(some), -1, dtype=np.int32), np.arange(1, len(some) + 1)))
            low, base = high, ends[high - 1]
        for ids, cut in made:
            self.plain.append(ids)
            self.starts.append(cut + self.starts[-1][-1])

    def numbers(self, texts: Sequence[list[str]]) -> np.ndarray:
        """The numbers of all words of texts, in order; new ones are learned."""
        if self.lattices.arcs > _REMEMBER or len(self.lattices.words) > _KNOWN:
            self.lattices.forget()
        flat = list(chain.from_iterable(texts))
        out = np.fromiter(map(self.lattices.words.get, flat, repeat(-1)), np.int64, len(flat))
        if len(unknown := np.flatnonzero(out < 0)):
            new = [flat[i] for i in unknown.tolist()]
            self.learn(list(dict.fromkeys(new)))
            out[unknown] = np.fromiter(map(self.lattices.words.__getitem__, new), np.int64, len(new))
        return out

    def encode_all(self, raw: Sequence[str], texts: Sequence[list[str]], numbers: np.ndarray) -> list[np.ndarray]:
        """The model's own encodings of texts, given beside by their words and those words' numbers."""
        self.plain, self.starts = [np.concatenate(self.plain)], [np.concatenate(self.starts)]
        first, sizes = self.starts[0][numbers], np.diff(self.starts[0])[numbers]
        ends = np.cumsum(sizes)
        ids = self.plain[0][np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, texts)])].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [np.array(self.model.encode(t), dtype=np.int32) if t and (not len(x) or x.min() < 0) else x for t, x in zip(raw, out, strict=True)]

    def sample(self, text: str, samples: int, seed: int) -> list[tuple[list[int], float, float, float]]:
        return [(ids.tolist(), *scores) for ids, *scores in self.sample_all([self.words(text)], samples, [seed])[0]]

    def sample_all(self, texts: Sequence[list[str]], samples: int, seeds: Sequence[int], known: np.ndarray | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Up to ``samples`` distinct segmentations a text, given by its words (and their numbers): ids, log-probability, perturbed log-probability, log-inclusion.

        Inclusion is the probability that the threshold, the best perturbed value left out, lets a segmentation in;
        log-probability minus its logarithm weighs the sample without bias. The logarithm is 0 where nothing is left
        out; in long texts the inclusion itself is too small for a double.
        """
        lat = self.lattices
        known = self.numbers(texts) if known is None else known
        whole = lat.view("root")[known]
        bounds = np.cumsum([0, *map(len, texts)]).tolist()
        numbers = np.arange(max(map(len, texts), default=0), dtype=np.uint64) * _GOLD
        target, first, node, share, ids = map(lat.view, ("target", "first", "node", "share", "ids"))
        found: list[list[_Path]] = [[] for _ in texts]
        # parts of lattices by falling value: (-value, number, path, step, arcs left out at it, its word); the whole has no path
        open_: list[list[tuple]] = [[(math.log(-math.log(_draw(_hashed(s, 0)))), 0, -1, 0, (), 0)] for s in seeds]
        made = [1] * len(texts)
        for turn in range(1, samples + 1):
            starts, draws, jobs = [], [], []
            for i, frontier in enumerate(open_):
                if not frontier:
                    continue
                negative, _, parent, step, left_out, word = heapq.heappop(frontier)
                seed, arc, rest = np.uint64(_hashed(seeds[i], turn)), -1, -math.inf
                if parent >= 0:
                    here = int(first.searchsorted(np.int32(left_out[0]), side="right")) - 1
                    choices = [a for a in range(int(first[here]), int(first[here] + node["count"][here])) if a not in left_out]
                    shares = [float(share[a]) for a in choices]
                    u, k = _draw(_hashed(seeds[i], turn, 1)) * sum(shares), 0
                    while k < len(choices) - 1 and u >= shares[k]:
                        u, k = u - shares[k], k + 1
                    arc, others = choices[k], sum(shares[:k] + shares[k + 1 :])
                    rest = math.log(others) if others > 0 else -math.inf
                starts.append(whole[bounds[i] + word : bounds[i + 1]])
                draws.append(numbers[word : bounds[i + 1] - bounds[i]] + seed)
                jobs.append((i, -negative, parent, step, left_out, arc, word, rest))
            if not jobs:
                break
            ends, nodes = np.cumsum([0, *map(len, starts)]).tolist(), np.concatenate(starts)
            for at, job in zip(ends, jobs, strict=False):
                if job[2] >= 0:
                    nodes[at] = target[job[5]]
            begins, arcs, parts = lat.walk(nodes, _mixed(np.concatenate(draws)))
            logs, cuts = np.log(parts), begins[ends].tolist()
            # what is left of each part: the same step once more, and every later one; those too unlikely for any draw are not drawn
            need, marks = samples + 1 - turn, [_hashed(seeds[job[0]], turn, 2) for job in jobs]
            wide = min(_HEAD, 1 + int(np.diff(cuts).max()))  # of a part, the step that it is drawn again at comes first
            heads, masses = np.zeros((len(jobs), wide), dtype=np.int32), np.full((len(jobs), wide), -np.inf)
            for n, ((i, value, parent, step, _, arc, _, _), a, b) in enumerate(zip(jobs, cuts, cuts[1:], strict=False)):
                own, sums = arcs[a:b], logs[a:b]
                if parent >= 0:
                    old = found[i][parent]
                    sums = np.concatenate((old.before[step : step + 1], np.log(share[arc : arc + 1]), sums)).cumsum()
                    path = _Path(np.concatenate((old.arcs[:step], [arc], own)), np.concatenate((old.before[:step], sums[:-1])), float(sums[-1]), value)
                else:
                    sums = np.concatenate(([0.0], sums)).cumsum()
                    path = _Path(own, sums[:-1], float(sums[-1]), value)
                found[i].append(path)
                size = min(wide, len(path.arcs) - step)
                heads[n, :size], masses[n, :size] = path.arcs[step : step + size], path.before[step : step + size]
            again = [job[2] >= 0 for job in jobs]
            once_more = masses[again, 0] + [job[7] for job in jobs if job[2] >= 0]
            masses += _log_rest(share[heads] if len(share) else np.ones(heads.shape))  # without any step where all texts so far are empty
            masses[again, 0] = once_more
            drawn = masses + _gumbel(np.array(marks, dtype=np.uint64)[:, None] + np.arange(wide, dtype=np.uint64) * _GOLD)
            chosen = np.argpartition(-drawn, need - 1, axis=1)[:, :need] if need < wide else np.tile(np.arange(wide), (len(jobs), 1))
            best = np.take_along_axis(drawn, chosen, axis=1)
            for n, ((i, value, parent, step, left_out, arc, word, rest), least, a, low, high) in enumerate(zip(jobs, (best.min(axis=1) if need <= wide else np.full(len(jobs), -np.inf)).tolist(), cuts, ends, ends[1:], strict=False)):
                path, some, values, looked = found[i][-1], chosen[n], best[n], wide
                mine, before = path.arcs[step:], path.before[step:]
                while looked < len(mine) and before[looked] + _MOST >= least:
                    looked *= 4
                    all_ = before[:looked] + _log_rest(share[mine[:looked]])
                    if parent >= 0:
                        all_[0] = before[0] + rest
                    all_ += _gumbel(np.arange(len(all_), dtype=np.uint64) * _GOLD + np.uint64(marks[n]))
                    some = np.argpartition(-all_, need - 1)[:need] if need < len(all_) else np.arange(len(all_))
                    values = all_[some]
                    least = float(values.min()) if need <= len(all_) else -math.inf
                for t, v, maximum in zip(some.tolist(), values.tolist(), (-np.logaddexp(-value, -values)).tolist(), strict=True):
                    if v > -math.inf:
                        place = t - (parent >= 0)
                        at = word if place < 0 else word + int(begins[low:high].searchsorted(a + place, side="right")) - 1
                        heapq.heappush(open_[i], (-maximum, made[i], turn - 1, step + t, (*left_out, arc) if parent >= 0 and t == 0 else (int(mine[t]),), at))
                        made[i] += 1
        out = []
        for paths, frontier in zip(found, open_, strict=True):
            bar = -frontier[0][0] if frontier else -math.inf
            rows = []
            for x in paths:
                over = x.total - bar
                included = over if over < -30 else math.log(-math.expm1(-math.exp(over))) if over < 700 else 0.0
                rows.append((ids[x.arcs], x.total, x.value, included))
            out.append(rows)
        return out


@cache
def sampler(path: str) -> Sampler:
    return Sampler(path)


def row_seed(seed: int, key: Sequence) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "little")


FIELDS = [
    T.StructField("sample", T.IntegerType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
    T.StructField("log_prob", T.DoubleType()),
    T.StructField("perturbed", T.DoubleType()),
    T.StructField("inclusion", T.DoubleType()),
    T.StructField("log_inclusion", T.DoubleType()),
]


def encode_samples(rows: DataFrame, key: Sequence[str], path: str, text: str = "text", samples: int = SAMPLES, seed: int = SEED, decoded: bool = True) -> DataFrame:
    """Columns ``key``, then ``FIELDS``: for every row its plain encoding as sample 0 and sampled ones from 1 on.

    ``decoded`` is the text that the ids decode to; without it, a column ``decodes`` says whether that is the normalised
    text. Sample 0 has null scores. Texts with fewer segmentations than ``samples`` give them all; null and empty texts
    give one without ids. Rows that repeat a key and a text repeat the sample; ties cannot show, as draws are of 53 bits
    and the first part found wins. Other columns are left out; a key column with one of the names above is an error.
    """
    made = [f if f.name != "decoded" or decoded else T.StructField("decodes", T.BooleanType()) for f in FIELDS]
    if clash := set(key) & {f.name for f in made}:
        raise ValueError(f"key columns have names of results: {sorted(clash)}")
    schema = T.StructType([*(rows.schema[c] for c in key), *made])
    arrow = to_arrow_schema(schema)

    def encoded(s: Sampler, keys: list[tuple], texts: list[str]) -> pa.RecordBatch:
        words = [s.words(t) for t in texts]
        out: list[list] = [[] for _ in schema]
        numbers = s.numbers(words)
        drawn = s.sample_all(words, samples, [row_seed(seed, k) for k in keys], numbers)
        each = [[(plain, None, None, None), *some] for plain, some in zip(s.encode_all(texts, words, numbers), drawn, strict=True)]
        raws = iter(s.raw([ids for some in each for ids, *_ in some]))
        for k, w, some in zip(keys, words, each, strict=True):
            whole = "".join(w).replace(SPACE, " ")
            whole = whole[whole[:1] == " " :]
            whole_raw = whole.encode("utf-8", "surrogatepass")
            for n, ((ids, p, g, included), raw) in enumerate(zip(some, raws, strict=False)):
                back = raw.decode("utf-8", "replace") if decoded else raw == whole_raw or raw.decode("utf-8", "replace") == whole
                row = [*k, n, ids, back, p, g, None if included is None else math.exp(included), included]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        at = len(key) + 1
        ends = np.cumsum([0, *map(len, out[at])], dtype=np.int32)
        arrays = [pa.array(c, f.type) if i != at else None for i, (c, f) in enumerate(zip(out, arrow, strict=True))]
        arrays[at] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out[at]])), type=arrow.field(at).type)
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path)
        for batch in batches:
            texts, held = [], 0
            for i, t in enumerate(batch.column(len(key)), 1):
                texts.append(t.as_py() or "")
                held += max(len(texts[-1]), _SHORT)
                if held >= _TOGETHER or i == batch.num_rows:
                    mine = batch.slice(i - len(texts), len(texts))
                    yield encoded(s, list(zip(*(mine.column(c).to_pylist() for c in range(len(key))), strict=True)), texts)
                    texts, held = [], 0

    return rows.select(*key, text).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of an array of ids; null for null."""
    schema = T.StructType([f for f in rows.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    kept = rows.drop("decoded")
    at, names = kept.columns.index(ids), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler(path).model
        for batch in batches:
            texts = [None if x is None else model.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return kept.mapInArrow(run, schema)


def op4_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer_path("piece_bpe_32k.model"), decoded=False)
