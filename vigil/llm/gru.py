"""Operator 11: log-likelihoods of whole documents by a gated recurrent language model in numpy.

Words are counted over all training documents.  The ``words`` most frequent ones are the network's words, in classes of
equal size by frequency; all others make up one more class, within which a word has its smoothed share of that
class's counts, so every word, known or not, has a probability and they add up to one.  The network gives the class
and, within the classes of its own words, the word: a softmax of classes and one of a class's words, never one of
all words.

Documents run in lanes: a lane is a row of documents, its state starts anew at each of them and is carried from window
to window within one, so a document's log-likelihood is that of its whole text.  Learning cuts the gradient, not
the state, at the windows' borders (truncated backpropagation), with steps of RMSProp on the windows of all lanes.

Learning runs on Spark in ``ROUNDS`` rounds over disjoint parts of the training documents, all of which take part:
each task goes on from the round's start over its own rows and returns its weights, and Spark averages them by
their tokens.  A task's result depends on its rows and the start alone, so a lost one is done again alike.

Corpus-wide counts come back by chunk: a chunk's documents name its distinct words by number, and only these (by 96
bits of hashes) meet the counts in a join.  A chunk's documents and words then meet in one group, whose size the
chunk's bytes bound.

Defined cases: a null or empty text is its end alone; a null id is not held out, but teaches nothing; repeated rows
count and score each; without training documents all probabilities are one (0.0); no rows give no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import chunks, fold, sweep, written

#: Bytes of text of a chunk, whose words are numbered together.
CHUNK = 16 << 20
#: Tokens that run in lanes together.
TOKENS = 4 << 20
#: Words of the network; the bound of what is collected and sent to the tasks.
WORDS = 2048
PER_CLASS = 64
STATE, INPUT = 32, 24
LANES, WINDOW = 256, 16
#: Places from which on a word's rows of a window are summed by a product.
OFTEN = 24
ROUNDS = 4
RATE = 0.01
END = b""


# ------------------------------------------------------------------ network

class Network:
    """A gated recurrent network over word numbers 0..words-1 and ``words`` (any other); the start is ``words`` + 1."""

    def __init__(self, words: int, weights: dict[str, np.ndarray] | None = None, shares: np.ndarray | None = None):
        self.words = words
        self.classes = -(-words // PER_CLASS)
        if weights is None:
            rng = np.random.default_rng(11)
            draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape).astype("f4")
            weights = {"embed": rng.normal(0, 0.3, (words + 2, INPUT)).astype("f4"), "into": draw(INPUT, 3 * STATE), "into_bias": np.zeros(3 * STATE, "f4"),
                       "state": draw(STATE, 3 * STATE), "state_bias": np.zeros(3 * STATE, "f4"),
                       "kind": np.zeros((STATE, self.classes + 1), "f4"), "kind_bias": np.zeros(self.classes + 1, "f4"),
                       "word": np.zeros((self.classes, STATE, PER_CLASS), "f4"), "word_bias": np.full((self.classes, PER_CLASS), -1e4, "f4")}
            if shares is not None:  # start from the words' shares: ``shares`` of the network's words, then the rest's
                logs = np.log(np.maximum(shares, 1e-12)).astype("f4")
                for c in range(self.classes):
                    own = logs[c * PER_CLASS:min((c + 1) * PER_CLASS, words)]
                    weights["word_bias"][c, :len(own)] = own
                    weights["kind_bias"][c] = np.logaddexp.reduce(own)
                weights["kind_bias"][self.classes] = logs[words]
        self.w = weights

    def sums(self, numbers=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """What the given words add to half the gates' sums and to the new state's sum."""
        w = self.w
        given = w["embed"][numbers]
        bias = 0.5 * (w["into_bias"] + w["state_bias"])[:2 * STATE]
        return given @ (0.5 * w["into"][:, :2 * STATE]) + bias, given @ w["into"][:, 2 * STATE:] + w["into_bias"][2 * STATE:]

    def run(self, start: np.ndarray, given: np.ndarray, keep: np.ndarray, back: bool = True, sums: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """States after each step (steps, lanes, STATE) and, with ``back``, what the backward pass needs.  ``keep`` is 0
        where a document starts, else 1; ``sums`` are those of all words, where they are at hand."""
        w, h, out, kept = self.w, start, np.empty((*given.shape, STATE), "f4"), []
        if sums is None:  # of the window's words only
            here = np.zeros(len(w["embed"]), bool)
            here[given] = True
            sums, given = self.sums(np.flatnonzero(here)), (np.cumsum(here) - 1)[given]
        # a gate is 0.5 + 0.5 tanh of half its sum
        x_gates, x_new = (x.take(given, axis=0) for x in sums)
        by_gates, by_new = 0.5 * w["state"][:, :2 * STATE], np.ascontiguousarray(w["state"][:, 2 * STATE:])
        new_bias = w["state_bias"][2 * STATE:]
        anew = keep.min(1) < 1
        for t in range(len(given)):
            if anew[t]:
                h = h * keep[t][:, None]
            gates = h @ by_gates
            gates += x_gates[t]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = np.ascontiguousarray(gates[:, :STATE]), np.ascontiguousarray(gates[:, STATE:])
            s = h @ by_new
            s += new_bias
            new = r * s
            new += x_new[t]
            np.tanh(new, out=new)
            if back:
                kept.append((h, z, r, new, s))
            h = np.subtract(h, new, out=out[t])
            h *= z
            h += new
        return out, kept

    def _groups(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Each target's class; the rows of the network's own words, class by class; each such class with its part of these rows."""
        kind = np.minimum(target // PER_CLASS, self.classes).astype("u2")
        kind[target >= self.words] = self.classes
        bounds = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=self.classes + 1))]).tolist()
        own = np.argsort(kind, kind="stable")[:bounds[self.classes]]
        return kind, own, [(c, a, b) for c, (a, b) in enumerate(zip(bounds[:-2], bounds[1:-1])) if b > a]

    def _word_logits(self, h: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits within their class for rows that stand class by class, all in one array."""
        word, bias = self.w["word"], self.w["word_bias"]
        out = np.empty((len(h), PER_CLASS), np.result_type(h, word))
        for c, a, b in spans:
            part = np.matmul(h[a:b], word[c], out=out[a:b])
            part += bias[c]
        return out

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's class and, within the network's classes, of the word."""
        kind, own, spans = self._groups(target)
        out = _log_softmax(_plus(states @ self.w["kind"], self.w["kind_bias"]), kind)
        if len(own):
            out[own] += _log_softmax(self._word_logits(states.take(own, axis=0), spans), target[own] % PER_CLASS)
        return out

    def gradients(self, states: np.ndarray, kept: list, given: np.ndarray, target: np.ndarray, keep: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the valid targets' mean log loss over one window."""
        w, (steps, lanes) = self.w, given.shape
        flat, wanted, rows = states.reshape(-1, STATE), target.reshape(-1), None
        if not valid.all():
            rows = np.flatnonzero(valid)
            flat, wanted = flat[rows], wanted[rows]
        n = max(len(wanted), 1)
        kind, own, spans = self._groups(wanted)
        d = _softmax_gradient(_plus(flat @ w["kind"], w["kind_bias"]), kind, n)
        one = np.ones(steps * lanes, d.dtype)
        g = {"kind": flat.T @ d, "kind_bias": one[:len(d)] @ d, "word": np.zeros_like(w["word"]), "word_bias": np.zeros_like(w["word_bias"])}
        back = d @ w["kind"].T
        if len(own):
            h = flat.take(own, axis=0)
            d = _softmax_gradient(self._word_logits(h, spans), wanted[own] % PER_CLASS, n)
            through = np.empty((len(own), STATE), d.dtype)
            for c, a, b in spans:
                part = d[a:b]
                np.matmul(h[a:b].T, part, out=g["word"][c])
                np.matmul(one[:b - a], part, out=g["word_bias"][c])
                np.matmul(part, w["word"][c].T, out=through[a:b])
            through += back.take(own, axis=0)
            back[own] = through
        if rows is not None:
            whole = np.zeros((steps * lanes, STATE), back.dtype)
            whole[rows] = back
            back = whole
        back = back.reshape(steps, lanes, STATE)
        # by the sums of the new state (state's part), the gates and the new state (input's part): the state's are the
        # first 3 * STATE columns, the input's the last
        every = np.empty((steps, lanes, 4 * STATE), back.dtype)
        dh = np.zeros((lanes, STATE), back.dtype)
        turned = np.ascontiguousarray(np.roll(w["state"], STATE, axis=1).T)
        anew = keep.min(1) < 1
        for t in reversed(range(steps)):
            h, z, r, new, s = kept[t]
            d_state, d_z, d_r, d_new = (every[t, :, k:k + STATE] for k in range(0, 4 * STATE, STATE))
            dh += back[t]
            left = dh * z  # what goes to the state before by itself
            dnew = dh - left
            dz = h - new
            dz *= left
            z = 1 - z
            np.multiply(dz, z, out=d_z)
            np.multiply(new, new, out=z)
            z *= dnew
            dnew -= z
            d_new[:] = dnew
            dnew *= r
            d_state[:] = dnew
            dnew *= s
            np.multiply(dnew, 1 - r, out=d_r)
            dh = every[t, :, :3 * STATE] @ turned
            dh += left
            if anew[t]:
                dh *= keep[t][:, None]
        every = every.reshape(-1, 4 * STATE)
        g["state"] = np.roll(np.concatenate([k[0] for k in kept]).T @ every[:, :3 * STATE], -STATE, axis=1)
        numbers, by_word = _word_sums(every, given.reshape(-1).astype("u2"), one)
        by_word = by_word[:, STATE:]
        g["into"], g["into_bias"] = w["embed"][numbers].T @ by_word, by_word.sum(0)
        g["state_bias"] = np.concatenate([g["into_bias"][:2 * STATE], one @ every[:, :STATE]])
        g["embed"] = np.zeros_like(w["embed"])
        g["embed"][numbers] = by_word @ w["into"].T
        return g


def _word_sums(rows: np.ndarray, at: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a window, the most frequent first, each with the sum of the rows at its places: of a frequent word by a
    product with ``one``, of the others by their first places, their second ones and so on."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(first, append=len(at))
    by = np.argsort(-sizes, kind="stable")
    first, sizes = first[by], sizes[by]
    often = int(np.count_nonzero(sizes >= OFTEN))
    out = rows.take(order[first], axis=0)
    for k in range(often):
        np.matmul(one[:sizes[k]], rows.take(order[first[k]:first[k] + sizes[k]], axis=0), out=out[k])
    places = np.arange(1, sizes[often] if often < len(sizes) else 1)
    for n, with_more in zip(places.tolist(), np.searchsorted(-sizes, -places, side="left").tolist()):
        out[often:with_more] += rows.take(order[first[often:with_more] + n], axis=0)
    return ordered[first], out


def _plus(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits += bias
    return logits


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(logits - top), its row sums and ``top``: one for all rows or, where a row would vanish, each row's own."""
    top = logits.max()
    e = logits - top
    np.exp(e, out=e)
    sums = e @ np.ones(e.shape[1], e.dtype)
    if sums.min() < 1e-30:
        top = logits.max(1, keepdims=True)
        e = np.exp(logits - top)
        sums, top = e.sum(1), top[:, 0]
    return e, sums, top


def _places(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of each row's ``at``-th value in the flat array."""
    return np.arange(0, array.size, array.shape[1]) + at


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, sums, top = _exponents(logits)
    return logits.reshape(-1).take(_places(logits, at)) - top - np.log(sums)


def _softmax_gradient(logits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Gradient of the ``n``-th part of the rows' log losses by their logits."""
    e, sums, _ = _exponents(logits)
    e *= (1 / (n * sums))[:, None]
    e.reshape(-1)[_places(e, at)] -= 1 / n
    return e


# ------------------------------------------------------------------ lanes

def windows(lengths: np.ndarray, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of the given lengths, laid one after the other in lanes, in windows of at most ``steps``.

    Yields (place, document, first, valid), each (steps, active lanes): the token's place in all documents one after the other, its
    document, whether it is a document's first token, and whether there is one.  Lanes are in descending order of
    length, so those that are still busy are always the leading ones."""
    order = np.argsort(-lengths, kind="stable")
    lanes = max(1, min(lanes, len(lengths)))
    rows: list[list[int]] = [[] for _ in range(lanes)]
    if len(lengths) == 0:
        return
    heap = [(0, k) for k in range(lanes)]
    for d in order:
        n, k = heap[0]
        rows[k].append(int(d))
        heapq.heapreplace(heap, (n + int(lengths[d]), k))
    rows.sort(key=lambda r: -int(lengths[r].sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    total = np.array([lengths[r].sum() for r in rows])
    place = [np.concatenate([np.arange(starts[d], starts[d + 1], dtype="i4") for d in r]) for r in rows]
    of = [np.repeat(np.array(r, "i4"), lengths[r]) for r in rows]
    base = np.concatenate([[0], np.cumsum(total)])[:-1]
    place, of = np.concatenate(place), np.concatenate(of)
    t, longest = 0, int(total[0])
    while t < longest:
        active = int(np.searchsorted(-total, -t, side="left"))
        at = t + np.arange(min(steps, longest - t))[:, None]
        valid = at < total[None, :active]
        index = np.minimum(at, total[None, :active] - 1) + base[None, :active]
        p, d = place[index], of[index]
        yield p, d, p == starts[d], valid
        t += steps


def _inputs(network: Network, ids: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.where(first, network.words + 1, ids[np.maximum(p - 1, 0)])


def score(network: Network, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each document's natural log-likelihood (words outside the network: that of their class)."""
    out, state = np.zeros(len(lengths)), np.zeros((min(LANES, len(lengths)), STATE), "f4")
    sums = network.sums()
    for p, d, first, valid in windows(lengths, LANES, 4 * WINDOW):
        states, _ = network.run(state[:p.shape[1]], _inputs(network, ids, p, first), (~first).astype("f4"), back=False, sums=sums)
        state = states[-1]
        logs = network.log_probs(states.reshape(-1, STATE), ids[p.reshape(-1)])
        out += np.bincount(d.reshape(-1), np.where(valid.reshape(-1), logs, 0), len(lengths))
    return out


def learn(network: Network, ids: np.ndarray, lengths: np.ndarray, memory: dict[str, np.ndarray], rate: float) -> None:
    """One pass of steps over the documents, with the gradient cut at each window's start and the state carried over."""
    state = np.zeros((min(LANES, len(lengths)), STATE), "f4")
    for p, _, first, valid in windows(lengths, LANES, WINDOW):
        given, keep = _inputs(network, ids, p, first), (~first).astype("f4")
        states, kept = network.run(state[:p.shape[1]], given, keep)
        state = states[-1]
        found = network.gradients(states, kept, given, ids[p], keep, valid.reshape(-1))
        weight = rate * math.sqrt(valid.sum() / (LANES * WINDOW))
        for k, g in found.items():
            m, square = memory[k], g * g
            square *= 0.01
            m *= 0.99
            m += square
            np.sqrt(m, out=square)
            square += 1e-5
            g *= weight
            g /= square
            network.w[k] -= g


# ------------------------------------------------------------------ corpus

_DOC = "held_out boolean, n_tokens long, numbers binary"
_WORD = "at int, h1 long, h2 int, taught long"


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each word: they stand for it everywhere but in its chunk."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.dtype([("h1", "<i8"), ("h2", "<i4"), ("", "<i4")]))
    return raw["h1"].copy(), raw["h2"].copy()


def _width(n: int) -> int:
    """Bytes of a number below ``n``."""
    return 2 if n <= 1 << 16 else 3 if n <= 1 << 24 else 4


def _packed(numbers: np.ndarray, n: int) -> bytes:
    """Numbers below ``n`` in as few bytes as each takes."""
    return np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4)[:, :_width(n)]).tobytes()


def _unpacked(raw, n: int) -> np.ndarray:
    narrow = np.frombuffer(raw, "u1").reshape(-1, _width(n))
    wide = np.zeros((len(narrow), 4), "u1")
    wide[:, :narrow.shape[1]] = narrow
    return wide.view("<u4").ravel()


def _numbered(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All texts' words and ends, one after the other, as numbers of the distinct ones; each text's tokens; the distinct ones."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))  # only A-Z change, only \x20 and \x09-\x0D split
    found = parts.flatten().cast(pa.binary()).dictionary_encode()
    words, numbers = found.dictionary.to_pylist(), found.indices.to_numpy()
    of = np.repeat(np.arange(len(parts), dtype="i4"), pc.list_value_length(parts).to_numpy())
    if END not in words:
        words.append(END)
    end = words.index(END)
    inside = numbers != end  # there are empty strings beside white space at a text's start and end
    lengths = np.bincount(of[inside], minlength=len(parts)) + 1
    out, last = np.full(int(lengths.sum()), end, "i4"), np.zeros(int(lengths.sum()), bool)
    last[np.cumsum(lengths) - 1] = True
    out[~last] = numbers[inside]
    return out, lengths, words


def _chunk_rows(batches):
    """A chunk's documents as numbers of its distinct words, then these words, as rows of one table."""
    task, number = TaskContext.get().partitionId(), 0
    names = ["chunk", "doc_id", *[f.split()[0] for f in f"{_DOC}, {_WORD}".split(", ")]]

    def rows(docs):
        nonlocal number
        key = task << 32 | number
        number += 1
        doc_id, held_out, text = (pa.concat_arrays([b.column(c) for b in docs]) for c in ("doc_id", "held_out", "text"))
        numbers, lengths, words = _numbered(text)
        k, n = len(lengths), len(words)
        teaches = np.repeat(pc.fill_null(pc.invert(held_out), False).to_numpy(zero_copy_only=False), lengths)
        taught = np.bincount(numbers[teaches], minlength=n)
        ends = np.concatenate([[0], np.cumsum(lengths)]) * _width(n)
        raw = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(ends.astype("i8")), pa.py_buffer(_packed(numbers, n))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, key)), doc_id, held_out, pa.array(lengths, pa.int64()), raw,
             *[pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64())]], names)
        h1, h2 = _hashes(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, key)), pa.nulls(n, doc_id.type), *[pa.nulls(n, t) for t in (pa.bool_(), pa.int64(), pa.binary())],
             pa.array(np.arange(n, dtype="i4")), pa.array(h1), pa.array(h2), pa.array(taught)], names)

    docs, size = [], 0
    for b in chunks(batches, "text", CHUNK):
        own = b.column("text").nbytes
        if docs and size + own >= 2 * CHUNK:  # one long text is a chunk of its own
            yield from rows(docs)
            docs, size = [], 0
        docs.append(b)
        size += own
        if size >= CHUNK:
            yield from rows(docs)
            docs, size = [], 0
    if docs:
        yield from rows(docs)


def _placed(total: int, distinct: int, rest: float, network_words: int):
    """A chunk's documents with their base score, the share of the other words, and their words as network numbers."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at = words["at"].to_numpy()
        count, number = np.zeros(len(at), "i8"), np.full(len(at), network_words, "<u2")
        count[at] = words["taught"].to_numpy()
        number[at] = words["number"].to_numpy()
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        other = np.where(number == network_words, np.log10((count + 0.5) / rest), 0.0)
        known, base_score, other_score, ids = [], [], [], []
        for raw in docs["numbers"]:
            seq = _unpacked(raw.as_buffer(), len(at))
            known.append(int(np.count_nonzero(count[seq])))
            base_score.append(float(base[seq].sum()))
            other_score.append(float(other[seq].sum()))
            ids.append(number[seq].tobytes())
        return pa.table({"chunk": docs["chunk"], "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": pa.array(known, pa.int64()),
                         "base_score": pa.array(base_score, pa.float64()), "other_score": pa.array(other_score, pa.float64()), "ids": pa.array(ids, pa.binary())})

    return run


def _gathered(batches, column: str = "ids"):
    """Batches of documents taken together up to ``TOKENS`` tokens."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes // 2
        if size >= TOKENS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _streams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.as_buffer() for x in table["ids"]]
    return np.frombuffer(b"".join(raw), "<u2").astype("i4"), np.array([r.size // 2 for r in raw], "i8")


def _tasks(partitions: int, cores: int) -> int:
    """Tasks of a round, which takes a part of each partition's rows: with several partitions to a task, while there is a
    task for each core, fewer of its windows are those in which only the longest documents' lanes still run."""
    return max(1, -(-partitions // ROUNDS), min(partitions, cores))


def train(rows: DataFrame, network: Network) -> Network:
    """The network after ``ROUNDS`` rounds over ``rows`` (chunk, doc_id, ids), each round over another part of them."""
    shapes = {k: v.shape for k, v in network.w.items()}
    tasks = _tasks(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    for n in range(ROUNDS):
        start = {k: v.copy() for k, v in network.w.items()}
        rate = RATE * (1 - n / ROUNDS)

        def step(batches):
            own = Network(network.words, {k: v.copy() for k, v in start.items()})
            memory, tokens = {k: np.full(s, 1e-6, "f4") for k, s in shapes.items()}, 0
            for t in _gathered(batches):
                ids, lengths = _streams(t)
                learn(own, ids, lengths, memory, rate)
                tokens += len(ids)
            if tokens:
                flat = np.concatenate([own.w[k].reshape(-1) for k in shapes])
                parts = range(0, len(flat), 4096)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([float(tokens)] * len(parts)),
                                                  pa.array([flat[p:p + 4096] for p in parts], pa.list_(pa.float32()))], ["part", "tokens", "weights"])

        part = rows.where(F.pmod(F.xxhash64("chunk", "doc_id", "n_tokens"), F.lit(ROUNDS)) == n).select("ids").coalesce(tasks)
        ends = part.mapInArrow(step, "part int, tokens double, weights array<float>")
        sums = ends.select("part", "tokens", F.posexplode("weights").alias("at", "weight")) \
            .groupBy("part", "at").agg((F.sum(F.col("weight") * F.col("tokens")) / F.sum("tokens")).alias("weight")).toPandas()
        if len(sums):  # as many rows as the network has weights
            flat = np.empty(len(sums), "f4")
            flat[(sums["part"] + sums["at"]).to_numpy()] = sums["weight"].to_numpy()
            cuts = np.cumsum([math.prod(s) for s in shapes.values()])[:-1]
            network.w = {k: v.reshape(s) for (k, s), v in zip(shapes.items(), np.split(flat, cuts))}
    return network


def likelihood(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score (smoothed shares of single words) and score."""
    if not 0 < words < 1 << 15:
        raise ValueError("the network's words are numbered in 16 bits")
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold(F.col(id_col), 5) == 1).alias("held_out"))
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = written(read.mapInArrow(_chunk_rows, f"chunk long, doc_id {kind}, {_DOC}, {_WORD}"))
    here = rows.where("at is not null").select("chunk", "at", "h1", "h2", "taught")
    counts = here.where("taught > 0").groupBy("h1", "h2").agg(F.sum("taught").alias("taught"))
    counts = written(counts)
    total, distinct = counts.agg(F.coalesce(F.sum("taught"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("taught"), "h1", "h2").limit(words).collect()  # at most ``words`` rows
    own = sum(r.taught for r in top)
    rest = total - own + 0.5 * (distinct - len(top)) + 0.5
    numbers = docs.sparkSession.createDataFrame([(r.h1, r.h2, i) for i, r in enumerate(top)], "h1 long, h2 int, number int")
    known = counts.join(F.broadcast(numbers), ["h1", "h2"], "left")  # as many rows as the network has words
    placed = here.drop("taught").join(known, ["h1", "h2"], "left").select(
        F.col("chunk").alias("of"), "at", F.coalesce("taught", F.lit(0).cast("long")).alias("taught"), F.coalesce("number", F.lit(len(top))).alias("number"))
    schema = f"chunk long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, other_score double, ids binary"
    figures = written(rows.where("at is null").select("chunk", "doc_id", "held_out", "n_tokens", "numbers")
                      .groupBy("chunk").cogroup(placed.groupBy("of")).applyInArrow(_placed(total, distinct, rest, len(top)), schema))
    sweep(docs.sparkSession)
    everything = total + 0.5 * (distinct + 1)
    shares = np.array([*[(r.taught + 0.5) / everything for r in top], rest / everything])
    network = train(figures.where("not held_out").select("chunk", "doc_id", "n_tokens", "ids"), Network(len(top), shares=shares))

    def scored(batches):
        for t in _gathered(batches):
            logs = score(network, *_streams(t)) / math.log(10)
            out = t.select(["doc_id", "held_out", "n_tokens", "n_known"]).append_column("train_tokens", pa.array(np.full(t.num_rows, total, "i8")))
            out = out.append_column("base_score", t["base_score"]).append_column("score", pa.array(logs + t["other_score"].to_numpy()))
            yield from out.to_batches()

    out = figures.mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("held_out", F.coalesce("held_out", F.lit(False))).withColumnRenamed("doc_id", id_col)
