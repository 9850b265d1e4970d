"""LM scoring: a gated recurrent network over words, trained in numpy, with a class-factored output.

Words are counted over all training documents. The most frequent ones are the network's own vocabulary, in classes of
CLASS_WORDS by rank; every other word belongs to a class by its last bytes, within which it has its add-one share of
the training count. Training goes in rounds over shares of the documents chosen by hash, which together are all of
them: each partition runs truncated backpropagation over windows of its documents from the round's parameters, and the
results are averaged by a tree of sums, weighted by tokens. Training and scoring pack whole documents into lanes and
carry the state from window to window; only the gradient stops at a window's begin.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, run_hashes, slices, small_batches, stored, table, text_or_empty

END = b" "  # no word: words hold no space
HEAD, CLASS_WORDS, TAIL_CLASSES, HIDDEN = 2048, 64, 64, 24
ROUNDS = 3
SHARE = ROUNDS  # each round takes one in SHARE training documents, another share each time: together they take all
#: A window has WINDOW tokens, or as many as LONGEST steps give: at most LANES documents side by side, fewer where
#: that leaves UPDATES windows a slice, or where the longest document would go on alone.
WINDOW, LANES, STEPS, LONGEST, UPDATES = 8192, 512, 16, 256, 64
SCORED = 4  # times as long are windows where nothing is learnt
SLICE_BYTES = 12_000_000  # of text that a worker packs into lanes at a time
MIDDLE_BYTES = SLICE_BYTES // 1024  # longer texts wait for a partition's last slices: a slice has as many steps as its longest text
LONG_BYTES = SLICE_BYTES // 128  # longer texts are packed with each other, so that few lanes don't go on alone
RATE = 0.01
BLOCK = 416  # tokens whose probabilities are worked out at once: products of this size need no packing by OpenBLAS
CACHED = 16_384  # parameters that are stepped at once
FREQUENT = 16  # inputs found as often in a window are summed one by one
HASHED = 4096  # words that are hashed at once, in a core's cache
HELD_WORDS = 1_000_000  # that a worker counts before it hands them on
KNOWN_WORDS = 1_000_000  # counts sent to all executors at most, 12 bytes each; the rest are joined
SHARES = 1 << 20  # parts of the words of one count, by hash
SEED = 11


def tail_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:], 3) % TAIL_CLASSES


class Vocabulary(NamedTuple):
    """What scoring knows of the counts: head words by rank, their counts, and counts and words of each tail class."""

    head: list[bytes]
    head_counts: np.ndarray
    tail_counts: np.ndarray
    tail_words: np.ndarray

    @property
    def head_classes(self) -> int:
        return -(-len(self.head) // CLASS_WORDS)


@lru_cache
def _tail_classes() -> np.ndarray:
    """tail_class() by the last two bytes of a word, and behind those by the one byte of a word that has no more."""
    return np.array([tail_class(bytes([k >> 8, k & 255])) for k in range(1 << 16)] + [tail_class(bytes([k])) for k in range(256)], np.int32)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the words' bytes one after the other, where each begins and the last one ends)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def _hashes(words: pa.Array) -> np.ndarray:
    data, edges = _bytes(words)
    found = np.empty(len(words), np.uint64)
    for a in range(0, len(words), HASHED):
        own = edges[a : a + HASHED + 1]
        found[a : a + HASHED] = run_hashes(data[own[0] : own[-1]], own[:-1] - own[0], np.diff(own))
    return found.view(np.int64)


def _tails(words: pa.Array) -> np.ndarray:
    """tail_class() of words; none is empty."""
    data, edges = _bytes(words)
    last, before = data[edges[1:] - 1].astype(np.int64), data[np.maximum(edges[1:] - 2, 0)].astype(np.int64)
    return _tail_classes()[np.where(np.diff(edges) > 1, before << 8 | last, (1 << 16) + last)]


def _numbered(words: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """Input numbers of words: head words by rank, others by their class after those; one more, for the end, comes last."""
    head = len(vocabulary.head)
    place = pc.fill_null(pc.index_in(words, value_set=pa.array(vocabulary.head, pa.binary())), -1).to_numpy()
    return np.append(np.where(place >= 0, place, head + _tails(words)), 0).astype(np.int32)


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters that say what the counts alone say."""
    r = np.random.default_rng(SEED)
    head, classes, h = len(vocabulary.head), vocabulary.head_classes, HIDDEN
    words = np.full(classes * CLASS_WORDS, -1e9, np.float32)
    words[:head] = np.log(vocabulary.head_counts + 1.0)
    mass = np.add.reduceat(vocabulary.head_counts + 1.0, np.arange(0, head, CLASS_WORDS))
    drawn = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "x": drawn(head + TAIL_CLASSES, 3 * h),
        "u": drawn(h, 3 * h) * 2,
        "c": np.zeros((h, classes + TAIL_CLASSES), np.float32),
        "cb": np.log(np.concatenate([mass, vocabulary.tail_counts + 1.0])).astype(np.float32),
        "w": np.zeros((classes * CLASS_WORDS, h), np.float32),
        "wb": words,
    }


def _packed(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def _unpacked(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, "<f4", like[k].size, at).reshape(like[k].shape).copy()
        at += like[k].nbytes
    return out


def _lanes(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first; each lane's documents in turn."""
    heap = [(0, k) for k in range(min(lanes, max(1, len(lengths))))]
    own: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        n, k = heapq.heappop(heap)
        own[k].append(d)
        total[k] = n + lengths[d]
        heapq.heappush(heap, (total[k], k))
    return [own[k] for k in sorted(range(len(own)), key=lambda k: -total[k])]


def _grid(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, inputs, go on, document) by step and lane, and the active lanes by step; each document ends with END's number 0."""
    own = _lanes([len(d) for d in docs], lanes)
    steps = max((sum(len(docs[d]) for d in lane) for lane in own), default=0)
    target, doc = np.zeros((steps, len(own)), np.int32), np.zeros((steps, len(own)), np.int32)
    active = np.zeros(steps + 1, np.int64)
    for k, lane in enumerate(own):
        if lane:
            line = np.concatenate([docs[d] for d in lane])
            target[: len(line), k] = line
            doc[: len(line), k] = np.repeat(lane, [len(docs[d]) for d in lane])
            active[0] += 1
            active[len(line)] -= 1
    inputs = np.zeros_like(target)  # a document begins as if after END
    inputs[1:] = target[:-1]
    inputs[1:][doc[1:] != doc[:-1]] = 0
    return target, inputs, (inputs != 0).astype(np.float32), doc, np.cumsum(active)[:-1]


def _windows(docs: list[np.ndarray], lanes: int, times: int = 1):
    """The windows of documents packed into lanes: (inputs, go on, targets that count, which those are, their document, lanes)."""
    target, inputs, go_on, doc, active = _grid(docs, lanes)
    t = 0
    while t < len(target):
        n = int(active[t])
        steps = times * min(LONGEST, max(STEPS, WINDOW // n))
        at = slice(t, t + steps), slice(0, n)
        live = (np.arange(n)[None, :] < active[t : t + steps, None]).ravel()
        yield inputs[at], go_on[at], target[at].ravel()[live], live, doc[at].ravel()[live], n
        t += steps


@lru_cache(4 * BLOCK)
def _places(rows: int, width: int) -> np.ndarray:
    """Where each row begins."""
    return np.arange(rows) * width


class _Outputs(NamedTuple):
    """One group of outputs over states in [-1, 1]: weights by output, and the biases' exponentials, which stand outside
    those of the states where the weights keep these in range; else the biases go in, and each row's largest is taken off."""

    weights: np.ndarray  # by state and output
    scaled: np.ndarray  # by output and state, times the factors
    biases: np.ndarray
    factors: np.ndarray
    narrow: bool

    def __call__(self, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probabilities of the targets, exponentials, their sums with the factors)."""
        e = states @ self.weights
        if not self.narrow:
            e += self.biases
            e -= e.max(axis=1, keepdims=True)
        picked = e.take(_places(*e.shape) + target)
        if self.narrow:
            picked += self.biases.take(target)
        np.exp(e, out=e)
        total = e @ self.factors
        return picked - np.log(total), e, total

    def logs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets, by blocks whose exponentials stay in a core's cache."""
        n, width = len(states), len(self.biases)
        picked = np.empty(n, states.dtype)
        if not self.narrow:
            for a in range(0, n, BLOCK):
                picked[a : a + BLOCK] = self(states[a : a + BLOCK], target[a : a + BLOCK])[0]
            return picked
        e, total = np.empty((min(n, BLOCK), width), states.dtype), np.empty(n, states.dtype)
        for a in range(0, n, BLOCK):
            s = states[a : a + BLOCK]
            if len(s) < len(e):
                e = e[: len(s)]
            np.matmul(s, self.weights, out=e)
            e.take(_places(*e.shape) + target[a : a + BLOCK], out=picked[a : a + BLOCK], mode="clip")
            np.exp(e, out=e)
            np.matmul(e, self.factors, out=total[a : a + BLOCK])
        picked += self.biases.take(target)
        picked -= np.log(total, out=total)
        return picked

    def back(self, states: np.ndarray, target: np.ndarray, e: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slopes at the weights, the biases and the states; e is used up. Rows are scaled on the states' side, which is narrower."""
        share = 1 / total
        e.reshape(-1)[_places(*e.shape) + target] -= total / self.factors.take(target)
        slope = e @ self.scaled
        slope *= share[:, None]
        return (e.T @ (states * share[:, None])) * self.factors[:, None], (share @ e) * self.factors, slope


def _groups(weights: np.ndarray, biases: np.ndarray) -> list[_Outputs]:
    """Groups of outputs from weights by group, output and state, and biases by group and output."""
    biases = biases - biases.max(axis=1, keepdims=True)
    narrow = np.abs(weights).sum(axis=2).max(axis=1) < 30
    factors = np.where(narrow[:, None], np.exp(biases), np.ones_like(biases))
    across, scaled = np.ascontiguousarray(weights.swapaxes(1, 2)), weights * factors[:, :, None]
    return [_Outputs(*x) for x in zip(across, scaled, biases, factors, narrow.tolist(), strict=True)]


def _sums(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers, sums of their rows along the middle axis): frequent ones each by a product, the others' first rows
    at once, then their second ones, and so on."""
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    ordered = numbers[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(first, append=len(order))
    by = np.argsort(-times, kind="stable")
    first, times = first[by], times[by]
    frequent = int(np.searchsorted(-times, -FREQUENT, side="right"))
    sums, ones = rows.take(order[first], axis=1), np.ones(times[0], rows.dtype)
    for k, (a, n) in enumerate(zip(first[:frequent].tolist(), times[:frequent].tolist(), strict=True)):
        np.matmul(ones[:n], rows.take(order[a : a + n], axis=1), out=sums[:, k])
    for j in range(1, int(times[frequent]) if frequent < len(times) else 0):
        end = int(np.searchsorted(-times, -j, side="left"))  # those that occur more than j times
        sums[:, frequent:end] += rows.take(order[first[frequent:end] + j], axis=1)
    return ordered[first], sums


class Network:
    def __init__(self, parameters: dict[str, np.ndarray], head: int):
        self.p, self.head = parameters, head
        self.classes = len(parameters["w"]) // CLASS_WORDS

    def class_of(self, target: np.ndarray) -> np.ndarray:
        return np.where(target < self.head, target // CLASS_WORDS, target - self.head + self.classes)

    def states(self, inputs: np.ndarray, go_on: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states at each step of a window from h, and the last; keep gets what going back needs."""
        n, u = HIDDEN, self.p["u"]
        by_gate = lambda x: np.ascontiguousarray(x[:, : 2 * n].reshape(-1, 2, n).swapaxes(0, 1)) * 0.5  # noqa: E731, the sigmoid by way of tanh
        u_gates, x_gates = by_gate(u), by_gate(self.p["x"])
        u_new, x_new = u[:, 2 * n :].copy(), self.p["x"][:, 2 * n :].copy()
        steps, lanes = inputs.shape
        out = np.empty((steps, lanes, n), u.dtype)
        kept = np.empty((5, steps if keep is not None else 1, lanes, n), u.dtype)
        work, half = np.empty((2, lanes, n), u.dtype), np.array(0.5, u.dtype)
        inputs, begins = inputs.astype(np.intp), go_on == 0
        for t, begun in enumerate(begins.any(axis=1).tolist()):
            own = kept[:, t if keep is not None else 0]
            before, z, r, reset, new = own
            before[:] = h
            if begun:
                before[begins[t]] = 0
            np.matmul(before, u_gates, out=work)
            work += x_gates.take(inputs[t], axis=1)
            np.tanh(work, out=work)
            work *= half
            np.add(work, half, out=own[1:3])
            np.multiply(r, before, out=reset)
            np.matmul(reset, u_new, out=new)
            new += x_new.take(inputs[t], axis=0)
            np.tanh(new, out=new)
            h = np.subtract(before, new, out=out[t])
            h *= z
            h += new
        if keep is not None:
            keep.extend(kept)
        return out, h

    def outputs(self) -> tuple[_Outputs, list[_Outputs]]:
        """The outputs for classes, and for the words of each head class, as the parameters are now."""
        p = self.p
        return _groups(p["c"].T[None], p["cb"][None])[0], _groups(p["w"].reshape(self.classes, CLASS_WORDS, -1), p["wb"].reshape(self.classes, CLASS_WORDS))

    def losses(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None, outputs: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target (of its class alone, for the tail), and the slope at the states."""
        # by class from here on: a class's rows follow each other
        order = np.argsort(self.class_of(target).astype(np.uint16), kind="stable")
        states, target = states.take(order, axis=0), target[order]
        c = self.class_of(target)
        slope = None
        classes, words = outputs or self.outputs()

        def learnt(group: _Outputs, at: slice, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Adds a group's scores and slopes at the states; returns the slopes at its weights and biases."""
            for a in range(0, len(own), BLOCK):  # what a block needs stays in a core's cache
                b = slice(at.start + a, min(at.stop, at.start + a + BLOCK))
                found, e, total = group(states[b], own[a : a + BLOCK])
                weight, bias, state = group.back(states[b], own[a : a + BLOCK], e, total)
                score[b] += found
                slope[b] += state
                by_weight, by_bias = (by_weight + weight, by_bias + bias) if a else (weight, bias)
            return by_weight, by_bias

        if grads is None:
            score = classes.logs(states, c)
        else:
            score, slope = np.zeros(len(order), states.dtype), np.zeros_like(states)
            if len(order):
                by_weight, by_bias = learnt(classes, slice(0, len(order)), c)
                grads["c"] += by_weight.T
                grads["cb"] += by_bias
        edges = np.searchsorted(c, np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(int(edges[k]), int(edges[k + 1]))
            own = target[at] - k * CLASS_WORDS
            if grads is None:
                score[at] += words[k].logs(states[at], own)
            else:
                rows = slice(k * CLASS_WORDS, (k + 1) * CLASS_WORDS)
                by_weight, by_bias = learnt(words[k], at, own)
                grads["w"][rows] += by_weight
                grads["wb"][rows] += by_bias
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return score[place], None if slope is None else slope.take(place, axis=0)

    def back(self, inputs: np.ndarray, go_on: np.ndarray, kept: list, slope: np.ndarray, grads: dict) -> None:
        """Backpropagation through one window; nothing flows back past its begin."""
        n, u = HIDDEN, self.p["u"]
        gates_back, new_back = np.stack([u[:, :n].T, u[:, n : 2 * n].T]), u[:, 2 * n :].T.copy()
        h, z, r, reset, new = kept
        steps, lanes = inputs.shape
        dx = np.empty((3, steps, lanes, n), slope.dtype)  # by z, r and new
        begins = go_on == 0
        begun = begins.any(axis=1).tolist()
        dh = np.zeros_like(slope[0])
        drh, work = np.empty_like(dh), np.empty((2, *dh.shape), dh.dtype)
        chunk = max(1, CACHED // dh.size)
        for end in range(steps, 0, -chunk):
            # what does not depend on later steps, for some steps at once
            begin = max(0, end - chunk)
            at = slice(begin, end)
            by_new, by_r, by_z = 1 - z[at], 1 - r[at], h[at] - new[at]
            by_r *= reset[at]
            by_z *= z[at]
            by_z *= by_new
            by_new -= by_new * new[at] * new[at]
            for t in range(end - 1, begin - 1, -1):
                dz, dr, dnew = dx[:, t]
                dh += slope[t]
                np.multiply(dh, by_z[t - begin], out=dz)
                np.multiply(dh, by_new[t - begin], out=dnew)
                np.matmul(dnew, new_back, out=drh)
                np.multiply(drh, by_r[t - begin], out=dr)
                dh *= z[t]
                drh *= r[t]
                dh += drh
                np.matmul(dx[:2, t], gates_back, out=work)
                dh += work[0]
                dh += work[1]
                if begun[t]:
                    dh[begins[t]] = 0
        flat, d = inputs.ravel(), dx.reshape(3, -1, n)
        by_u = grads["u"].reshape(n, 3, n)
        for k, x in enumerate((h, h, reset)):
            by_u[:, k] += x.reshape(-1, n).T @ d[k]
        found, sums = _sums(flat, d)
        grads["x"].reshape(-1, 3, n)[found] += sums.swapaxes(0, 1)


class Adam:
    """Its moments are kept as sums without the factors 0.1 and 0.001, which the step makes up for."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.m, self.v, self.t = p, {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, grads: dict[str, np.ndarray], tokens: int) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))) / tokens
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / tokens
        rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * 0.1 / np.sqrt(0.001)
        for k in grads:
            flat = [x[k].reshape(-1) for x in (grads, self.m, self.v, self.p)]
            for a in range(0, flat[0].size, CACHED):
                g, m, v, p = (x[a : a + CACHED] for x in flat)
                g *= scale
                m *= 0.9
                m += g
                g *= g
                v *= 0.999
                v += g
                np.sqrt(v, out=g)
                g += 1e-8 / 0.001**0.5
                np.divide(m, g, out=g)
                g *= float(rate)
                p -= g


def train(network: Network, adam: Adam, docs: list[np.ndarray]) -> int:
    """Truncated backpropagation over all tokens, whole documents in lanes; returns the tokens seen."""
    total, longest = sum(map(len, docs)), max(map(len, docs), default=1)
    h = np.zeros((LANES, HIDDEN), np.float32)
    for inputs, go_on, target, live, _, n in _windows(docs, max(1, min(LANES, total // (STEPS * UPDATES) + 1, -(-total // longest)))):
        kept: list = []
        grads = {k: np.zeros_like(x) for k, x in network.p.items()}
        states, h = network.states(inputs, go_on, h[:n], kept)
        flat = states.reshape(-1, HIDDEN)
        if len(target) == len(flat):
            slope = network.losses(flat, target, grads)[1]
        else:
            slope = np.zeros_like(flat)
            slope[live] = network.losses(flat[live], target, grads)[1]
        network.back(inputs, go_on, kept, slope.reshape(states.shape), grads)
        adam.step(grads, len(target))
    return total


def score(network: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document, of the class alone for tail words; states go on from window to window."""
    out = np.zeros(len(docs))
    h = np.zeros((LANES, HIDDEN), np.float32)
    longest, outputs = max(map(len, docs), default=1), network.outputs()
    for inputs, go_on, target, live, doc, n in _windows(docs, max(1, min(LANES, -(-sum(map(len, docs)) // longest))), SCORED):
        states, h = network.states(inputs, go_on, h[:n])
        flat = states.reshape(-1, HIDDEN)
        found = network.losses(flat if len(target) == len(flat) else flat[live], target, outputs=outputs)[0]
        out += np.bincount(doc, found.astype(np.float64), len(docs))
    return out / np.log(10)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts as (number of each word, distinct words, edges of the texts); the number behind the last word's is for the end that each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy()
    edges = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    numbers = np.insert(coded.indices.to_numpy().astype(np.int64), edges[1:], len(words))
    return numbers, words, edges + np.arange(len(edges))


def _by_length(batches, middle: int | None = None):
    """Slices of texts of like length: full ones as they come, in the end those of over `middle` bytes with what is left of the
    short ones, and the long ones."""
    middle = MIDDLE_BYTES if middle is None else middle
    held: list[list[pa.RecordBatch]] = [[], [], []]
    size = [0, 0, 0]

    def sliced(*kinds: int):
        parts = [batch for kind in kinds for batch in held[kind]]
        for kind in kinds:
            held[kind], size[kind] = [], 0
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
        del parts
        yield from slices(whole, "text", SLICE_BYTES)

    for batch in batches:
        n = pc.binary_length(batch.column("text")).to_numpy()
        kinds = (n > middle).astype(np.int8) + (n > LONG_BYTES)
        for kind in np.unique(kinds).tolist():
            own = kinds == kind
            held[kind].append(batch if own.all() else batch.filter(pa.array(own)))
            size[kind] += int(n[own].sum(dtype=np.int64))
            if size[kind] > SLICE_BYTES:
                rest = None
                for part in sliced(kind):
                    if rest is not None:
                        yield rest
                    rest = part
                size[kind] = pc.sum(pc.binary_length(rest.column("text"))).as_py()
                if size[kind] > SLICE_BYTES:
                    size[kind] = 0
                    yield rest
                else:  # what does not fill a slice goes on with the next batches
                    held[kind] = [rest]
                del rest
    yield from sliced(1, 0)
    yield from sliced(2)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def _counts(texts: DataFrame) -> DataFrame:
    """word, c over texts(text), the ends included; counted within each task before the shuffle."""

    def run(batches):
        held: list[pa.Table] = []

        def summed():
            table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            return pa.table([table.column("word"), table.column("c_sum")], ["word", "c"])

        for batch in _by_length(batches):
            numbers, words, _ = _tokens(batch.column("text"))
            held.append(pa.table([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.array(np.bincount(numbers, minlength=len(words) + 1))], ["word", "c"]))
            if sum(map(len, held)) > HELD_WORDS:
                held = [summed()]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return texts.mapInArrow(freeing(run), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def _vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(HEAD - 1).collect()
    head = [END, *(bytes(r["word"]) for r in top)]
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    def by_class(batches):
        known = pa.array(head, pa.binary())
        sums, words = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
        for batch in batches:
            rare = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=known)))
            k = _tails(rare.column("word"))
            np.add.at(sums, k, rare.column("c").to_numpy())
            words += np.bincount(k, minlength=TAIL_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(TAIL_CLASSES), pa.int32()), pa.array(sums), pa.array(words)], ["k", "n", "v"])

    tail = counts.mapInArrow(by_class, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    sums, words = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for r in tail:
        sums[r["k"]], words[r["k"]] = r["n"], r["v"]
    return Vocabulary(head, np.array([ends, *(r["c"] for r in top)], np.int64), sums, words)


def _known(n_words: dict[int, int]) -> Column:
    """Whether a word's count is sent to all executors, from the number of words by count: the most frequent words are, and
    of the least count among them a share by hash, which needs no order of all words."""
    above = 0
    for c in sorted(n_words, reverse=True):
        if above + n_words[c] > KNOWN_WORDS:
            share = (KNOWN_WORDS - above) * SHARES // n_words[c] * 99 // 100  # drawn by hash, it is not met exactly
            return (F.col("c") > c) | ((F.col("c") == c) & (F.pmod(F.xxhash64("word"), F.lit(SHARES)) < share))
        above += n_words[c]
    return F.lit(True)


def _in_round(k: int) -> Column:
    """Whether round k trains on a document."""
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(SHARE)) == k


def _trained(texts: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    sc = texts.sparkSession.sparkContext
    parameters = initial(vocabulary)
    for k in range(ROUNDS):
        sent = sc.broadcast((vocabulary, parameters))

        def run(batches, sent=sent):
            vocabulary, parameters = sent.value
            parameters = {k: x.copy() for k, x in parameters.items()}
            network, seen = Network(parameters, len(vocabulary.head)), 0
            adam = Adam(parameters)
            for batch in _by_length(batches, LONG_BYTES):  # fewer, longer texts to a window: gradients flow over more steps
                flat, words, edges = _tokens(batch.column("text"))
                if batch.num_rows:
                    seen += train(network, adam, np.split(_numbered(words, vocabulary)[flat], edges[1:-1]))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([_packed(parameters)], pa.binary())], ["n", "parameters"])

        own = texts.where(_in_round(k)).select("text")
        sums = own.mapInArrow(freeing(run), "n bigint, parameters binary").rdd.map(lambda r: (r["n"], np.frombuffer(bytes(r["parameters"]), "<f4") * np.float64(r["n"])))
        n, total = sums.treeAggregate((0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2)
        if n:
            parameters = _unpacked((total / n).astype("<f4").tobytes(), parameters)
    return parameters


def scored(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: it has the end alone. Null doc_ids count as the empty text for the split. Texts of any length
    are scored whole. Repeated rows count each time and score alike. An empty table gives no rows; without training
    documents all words are unknown. All but score depends on the rows alone; score depends on how they are partitioned
    as well, as each partition trains a copy of the network.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
    learnt = rows.where(~F.col("held_out"))
    with small_batches(docs.sparkSession):
        counts = stored(_counts(learnt.select("text")), "lm-counts")
    by_count = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all, n_words = sum(c * n for c, n in by_count.items()), sum(by_count.values())
    vocabulary = _vocabulary(counts)
    with small_batches(docs.sparkSession):
        parameters = _trained(learnt, vocabulary)
    sent_words = _known(by_count)
    known = counts.where(sent_words).select("word", "c").toArrow().combine_chunks()
    words = known.column("word").combine_chunks() if known.num_rows else pa.array([], pa.binary())
    hashes = _hashes(words)
    order = np.argsort(hashes, kind="stable")
    hashes, sizes = hashes[order], known.column("c").to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, parameters, hashes, sizes.astype(np.int32) if not len(sizes) or sizes.max() < 2**31 else sizes))

    def run(batches):
        vocabulary, parameters, hashes, sizes = sent.value
        network, head = Network(parameters, len(vocabulary.head)), len(vocabulary.head)
        share = np.log10(vocabulary.tail_counts + vocabulary.tail_words + 1.0)
        for batch in _by_length(batches):
            if not batch.num_rows:
                continue
            flat, words, edges = _tokens(batch.column("text"))
            lengths = np.diff(edges)
            number = _numbered(words, vocabulary)
            own = pa.concat_arrays([words, pa.array([END], pa.binary())])
            h = _hashes(own)
            at, order = np.empty(len(h), np.int64), np.argsort(h)  # neighbours are found in a core's cache
            at[order] = np.minimum(np.searchsorted(hashes, h[order]), max(0, len(hashes) - 1))
            found = (hashes[at] == h) if len(hashes) else np.zeros(len(own), bool)
            logs = np.log10(np.where(found, sizes[at] if len(hashes) else 0, 0) + 1.0)
            tail = number >= head
            # what the network leaves to the counts: a tail word's share of its class
            within = np.where(tail, logs - share[np.where(tail, number - head, 0)], 0.0)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            per_doc = lambda x: np.bincount(doc, x[flat], len(lengths))
            network_score = score(network, np.split(number[flat], edges[1:-1]))
            rare = np.flatnonzero(~found[flat])
            rare_edges = np.searchsorted(rare, edges)
            rare_words = own.take(pa.array(flat[rare]))
            columns = {
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(per_doc(found).astype(np.int64)),
                "logs": pa.array(per_doc(logs)),
                "model": pa.array(network_score + per_doc(within)),
                "rare": pa.ListArray.from_arrays(pa.array(rare_edges, pa.int32()), rare_words),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text_key"), *columns.values()], ["doc_id", "held_out", "text_key", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(freeing(run), f"doc_id {kind}, held_out boolean, text_key bigint, n_tokens bigint, n_known bigint, logs double, model double, rare array<binary>")
    if n_words > KNOWN_WORDS:
        with small_batches(docs.sparkSession):
            found = stored(found, "lm-scored")
        # no word here is frequent, so that none is a hot key
        more = found.select("doc_id", "text_key", F.explode("rare").alias("word")).join(counts.where(~sent_words), "word").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        more = more.agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
        # rows that are repeated were exploded each: their sums are shared out again
        times = found.groupBy(F.col("doc_id").alias("__i"), F.col("text_key").alias("__k")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        found = found.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
        found = found.join(times, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("text_key") == F.col("__k")), "left")
        found = found.withColumn("times", F.coalesce("times", F.lit(1)))
        found = found.withColumn("more_known", F.coalesce((F.col("more_known") / F.col("times")).cast("long"), F.lit(0))).withColumn("more_logs", F.coalesce(F.col("more_logs") / F.col("times"), F.lit(0.0)))
    else:
        found = found.withColumn("more_known", F.lit(0)).withColumn("more_logs", F.lit(0.0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * float(np.log10(n_all + n_words + 1))).alias("base_score"),
        (F.col("model") + F.col("more_logs")).alias("score"),
    )


def op1_language_model(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
