"""Language-model scoring with a gated recurrent network in numpy.

The network reads the frequent words (the rest are one symbol) and predicts the next through a softmax factored into classes: first the class,
then the word in it; frequent words lie in small classes. It is trained by truncated backpropagation; when scoring, windows of steps follow each
other with the state carried over, so that a document of any length gets its whole log-likelihood. Every training document is learned from: in each
of a fixed number of rounds every partition goes on from the shared weights over its own share, and the weights are averaged, by tokens learned.
A rare word costs the symbol's probability times its smoothed share of all rare words, which takes word counts of the whole training corpus; so
does the unigram base score. Counts of the most frequent words travel with the tasks; those of all others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shipped, slices, text_buffers

VOCABULARY, HIDDEN, LANES, WINDOW = 1500, 24, 1024, 16  # VOCABULARY at least; it grows with the cube root of the training tokens
FREQUENT = 1 << 18  # words whose counts are sent to every task (16 bytes each); the counts of all other words are joined
ROUNDS = 4  # of averaging; each training document is learned from in one of them, or in more where there are few tokens
FEW, SHARE = 2_000_000, 100_000  # tokens up to which documents take part in several rounds; tokens of a partition at least
PARTS, BRANCH = 4096, 32  # partitions that learn at most; partial averages that one task takes up
WEIGHTS = 1 << 16  # weights of one row of the average
END = -1  # word hash of the end of a text
PIECE, ROWS, BYTES = 1 << 20, 8192, 1 << 25  # bytes hashed at once; documents and bytes scored at once
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base, size = 0x9E3779B97F4A7C15 | 5, max(n, 1 << 20)
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x % (1 << 64), np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        table = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        _POWERS[:] = [*made, table]
    return tuple(_POWERS)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words per text); words are runs of bytes other than ASCII white space, A-Z as a-z."""
    hashes, counts, n, i = [], [np.zeros(0, np.int64)], len(offsets) - 1, 0
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1, i + 1)
        part = data[offsets[i] : offsets[j]]
        ends_of = offsets[i + 1 : j + 1] - offsets[i]
        inside = np.concatenate([[False], ~_SPACE[part], [False]])
        cut = ends_of[(ends_of > 0) & (ends_of < len(part))]
        starts = inside[1:-1] & ~inside[:-2]
        starts[cut] = inside[1:-1][cut]
        stops = inside[1:-1] & ~inside[2:]
        stops[cut - 1] = inside[1:-1][cut - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        power, inverse, table = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[_LOWER[part]] * power[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h = h.view(np.int64)
        h[h == END] = END - 1
        hashes.append(h)
        at = np.searchsorted(s, np.concatenate([[0], ends_of]))
        counts.append(np.diff(at))
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.int64), np.concatenate(counts)


def with_ends(words: np.ndarray, counts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Words with an end after each text, and the texts' lengths with it."""
    out = np.empty(len(words) + len(counts), words.dtype)
    places = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[places] = False
    out[keep], out[places] = words, end
    return out, counts + 1


def class_bounds(mass: np.ndarray) -> np.ndarray:
    """First symbol of each class, and the number of symbols: about sqrt(n) classes of like sums of sqrt(mass)."""
    n = len(mass)
    part = np.cumsum(np.sqrt(mass + 1.0))
    wanted = int(np.ceil(np.sqrt(n)))
    cut = np.searchsorted(part, part[-1] * np.arange(1, wanted) / wanted, "right")
    return np.unique(np.concatenate([[0], cut, [n]]))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


class GatedLM:
    """Symbols 0..n-1: 0 is the end of a text (also what a text starts from), 1 any rare word, then words in order of frequency.

    States are columns: one per lane.
    """

    def __init__(self, mass: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        r, self.n, self.hidden = np.random.default_rng(seed), len(mass), hidden
        self.bounds = class_bounds(np.asarray(mass, np.float64))
        self.kind = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)).astype(np.int16)
        init = lambda *s: (r.normal(size=s) * 0.1).astype(np.float32)
        zero = lambda n: np.zeros((n, 1), np.float32)
        self.p = {"x": init(self.n, 3 * hidden), "u": init(3 * hidden, hidden), "c": init(len(self.bounds) - 1, hidden), "cb": zero(len(self.bounds) - 1), "w": init(self.n, hidden), "wb": zero(self.n)}
        self.sums = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def step(self, h: np.ndarray, symbol: np.ndarray):
        """(state, update gate z, reset gate r, candidate c) from the state before and the symbol read."""
        k, u, x = self.hidden, self.p["u"], self.p["x"].take(symbol, axis=0).T
        gates = u[: 2 * k] @ h
        gates += x[: 2 * k]
        gates *= 0.5  # the logistic function by tanh
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:k], gates[k:]
        c = u[2 * k :] @ (r * h)
        c += x[2 * k :]
        np.tanh(c, out=c)
        after = c - h
        after *= z
        after += h
        return after, z, r, c

    def train(self, texts: list[np.ndarray], lanes: int = 64, window: int = WINDOW, epochs: int = 2, rate: float = 0.08) -> None:
        """Truncated backpropagation: the texts follow each other in ``lanes`` streams; a state starts anew with each text."""
        stream = np.concatenate([np.zeros(1, np.int64), *texts]) if texts else np.zeros(1, np.int64)
        steps = (len(stream) - 1) // lanes
        if steps < 1:
            lanes, steps = 1, len(stream) - 1
        if not steps:
            return
        source, target = stream[: lanes * steps].reshape(lanes, steps).T, stream[1 : lanes * steps + 1].reshape(lanes, steps).T
        for _ in range(epochs):
            h = np.zeros((self.hidden, lanes), np.float32)
            for t in range(0, steps, window):
                h, _, g, rows = self.gradient(np.ascontiguousarray(source[t : t + window]), np.ascontiguousarray(target[t : t + window]), h)
                self._descend(g, rows, rate, source[t : t + window].size)
            rest = stream[lanes * steps :]
            if len(rest) > 1:  # what does not fill the lanes follows on the last of them, as one window
                _, _, g, rows = self.gradient(rest[:-1, None], rest[1:, None], np.ascontiguousarray(h[:, -1:]))
                self._descend(g, rows, rate, len(rest) - 1)

    def gradient(self, source: np.ndarray, target: np.ndarray, h: np.ndarray):
        """(state after, loss, gradients, rows that those of x, w and wb belong to) of a window of symbols, a row per step."""
        k, p, kept, lanes = self.hidden, self.p, [], h.shape[1]
        for symbol in source:
            h0 = h * (symbol != 0) if not symbol.all() else h
            h, z, r, c = self.step(h0, symbol)
            kept.append((h0, z, r, c, h))
        states, out = np.ascontiguousarray(np.concatenate([x[4] for x in kept], axis=1).T), target.ravel()
        kind, at = self.kind[out], np.arange(len(out))
        dc = _softmax(p["c"] @ states.T + p["cb"])
        loss = -np.log(dc[kind, at]).sum()
        dc[kind, at] -= 1
        g = {"c": dc @ states, "cb": dc.sum(axis=1, keepdims=True), "u": np.zeros_like(p["u"])}
        dh, order = dc.T @ p["c"], np.argsort(kind, kind="stable")
        ordered, word, ends = states[order], out[order], np.searchsorted(kind[order], np.arange(len(self.bounds)))
        rows, dw, db, back = [], [], [], np.zeros_like(ordered)
        for i in np.flatnonzero(np.diff(ends)):
            a, b, s, e = self.bounds[i], self.bounds[i + 1], ends[i], ends[i + 1]
            if b - a > 1:
                y = _softmax(p["w"][a:b] @ ordered[s:e].T + p["wb"][a:b])
                own = word[s:e] - a, np.arange(e - s)
                loss -= np.log(y[own]).sum()
                y[own] -= 1
                rows.append(np.arange(a, b))
                dw.append(y @ ordered[s:e])
                db.append(y.sum(axis=1, keepdims=True))
                np.matmul(y.T, p["w"][a:b], out=back[s:e])
        dh[order] += back
        found = {"w": np.concatenate(rows) if rows else np.zeros(0, np.int64)}
        g["w"], g["wb"], found["wb"] = (np.concatenate(dw), np.concatenate(db), found["w"]) if rows else (np.zeros((0, k), np.float32), np.zeros((0, 1), np.float32), found["w"])
        inputs, carried, u = np.empty((len(out), 3 * k), h.dtype), 0, p["u"]
        for t in range(len(kept) - 1, -1, -1):
            h0, z, r, c, _ = kept[t]
            d = dh[t * lanes : (t + 1) * lanes].T + carried
            both = np.empty((3 * k, lanes), h.dtype)
            da = np.multiply(d * z, 1 - c * c, out=both[2 * k :])
            back = u[2 * k :].T @ da
            np.multiply(d * (c - h0), z * (1 - z), out=both[:k])
            np.multiply(back * h0, r * (1 - r), out=both[k : 2 * k])
            g["u"][2 * k :] += da @ (r * h0).T
            g["u"][: 2 * k] += both[: 2 * k] @ h0.T
            inputs[t * lanes : (t + 1) * lanes] = both.T
            carried = d * (1 - z) + back * r + u[: 2 * k].T @ both[: 2 * k]
            if not source[t].all():
                carried *= source[t] != 0
        read = source.ravel()
        order = np.argsort(read, kind="stable")
        found["x"], begins = np.unique(read[order], return_index=True)
        g["x"] = np.add.reduceat(inputs[order], begins)
        return h, loss, g, found

    def _descend(self, g: dict, rows: dict, rate: float, count: int) -> None:
        """AdaGrad on the mean gradient, its norm held to 5; x, w and wb change in the rows they have a gradient for."""
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values())) / count
        scale = min(1.0, 5.0 / max(norm, 1e-9)) / count
        for name, v in g.items():
            at = rows.get(name, slice(None))
            v *= np.float32(scale)
            sums = self.sums[name][at] + v * v
            self.sums[name][at] = sums
            v /= np.sqrt(sums)
            v *= np.float32(rate)
            self.p[name][at] -= v

    def state(self) -> np.ndarray:
        """Weights and AdaGrad sums in one row of numbers."""
        return np.concatenate([part[k].ravel() for part in (self.p, self.sums) for k in sorted(part)])

    def set_state(self, values: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.sums):
            for k in sorted(part):
                part[k] = values[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size

    def log10s(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of log10 probabilities of each text's symbols, the end included, with the state carried over all windows."""
        begins, score = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
        order = np.argsort(-lengths, kind="stable")
        for first in range(0, len(order), LANES):
            rows = order[first : first + LANES]
            size, at, h = lengths[rows], begins[rows], np.zeros((self.hidden, len(rows)), np.float32)
            last, most = np.zeros(len(rows), np.int64), int(size[0]) if len(size) else 0
            active = len(rows) - np.searchsorted(size[::-1], np.arange(most), "right")  # lanes that have a symbol at each step
            for t in range(0, most, WINDOW):
                states, wanted = [], []
                for s in range(t, min(t + WINDOW, most)):
                    n = active[s]
                    if n < h.shape[1]:
                        h, last, at = np.ascontiguousarray(h[:, :n]), last[:n], at[:n]
                    h = self.step(h, last)[0]
                    last = symbols[at + s]
                    states.append(h)
                    wanted.append(last)
                got = self._output(np.concatenate(states, axis=1), np.concatenate(wanted))
                owner = np.concatenate([np.arange(len(x)) for x in wanted])
                score[rows[: len(wanted[0])]] += np.bincount(owner, got, len(wanted[0]))
        return score / np.log(10)

    def _output(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Log probability of a symbol in each column of states."""
        kind, p = self.kind[symbol], self.p
        x = p["c"] @ h
        x += p["cb"]
        out = x[kind, np.arange(len(kind))] - np.log(np.exp(x, out=x).sum(axis=0)) if x.max() < 80 else self._careful(x, kind)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(len(self.bounds)))
        ordered, word, more = h.T[order], symbol[order], np.zeros(len(order), np.float32)
        for i in np.flatnonzero(np.diff(ends)):
            a, b, s, e = self.bounds[i], self.bounds[i + 1], ends[i], ends[i + 1]
            if b - a > 1:
                more[s:e] = self._careful(p["w"][a:b] @ ordered[s:e].T + p["wb"][a:b], word[s:e] - a)
        out[order] += more
        return out

    @staticmethod
    def _careful(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        x -= x.max(axis=0)
        return x[k, np.arange(len(k))] - np.log(np.exp(x).sum(axis=0))


def _symbols(words: np.ndarray, vocabulary: np.ndarray, order: np.ndarray) -> np.ndarray:
    """0 for the end, 1 for a rare word, else 2 + its place in the vocabulary; ``vocabulary`` is sorted, ``order`` its places."""
    unique, at = np.unique(words, return_inverse=True)
    out = np.ones(len(unique), np.int64)
    if len(vocabulary):
        k = np.minimum(np.searchsorted(vocabulary, unique), len(vocabulary) - 1)
        found = vocabulary[k] == unique
        out[found] = 2 + order[k[found]]
    out[unique == END] = 0
    return out[at]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 7 == 2


def fit(train: DataFrame, tokens: int, known: np.ndarray, places: np.ndarray, mass: np.ndarray, rounds: int = ROUNDS) -> tuple[GatedLM, list[int]]:
    """The network learned from every row of ``train(doc_id, text)``, and the number of tokens learned from in each round.

    ``tokens`` is the number of tokens, ends included, ``mass`` that of each symbol. A partition reads its rows as a stream; only averaged weights
    reach the driver.
    """
    model, sizes = GatedLM(mass), []
    passes = max(1, min(rounds, FEW // max(tokens, 1)))
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds))
    for r in range(rounds):
        sent = shipped(train.sparkSession, model)

        def learn(batches, sent=sent):
            from pyspark import TaskContext

            own, seen, part = sent(), 0, TaskContext.get().partitionId()
            for b in slices(batches, 0, ROWS, BYTES):
                words, _ = with_ends(*word_hashes(*text_buffers(b.column(0))))
                own.train([_symbols(words, known, places)], lanes=min(512, max(16, len(words) // 1024)), epochs=1)
                seen += len(words)
            if seen:
                values = own.state()
                rows = [values[k : k + WEIGHTS] for k in range(0, len(values), WEIGHTS)]
                for i, row in enumerate(rows):
                    yield pa.record_batch([pa.array([i]), pa.array([part]), pa.array([seen]), pa.array([row.astype("<f4").tobytes()])], names=["piece", "part", "n", "value"])

        def average(key, table):
            n = table.column("n").to_numpy()
            total = sum(np.frombuffer(v.as_py(), "<f4").astype(np.float64) * k for v, k in zip(table.column("value"), n, strict=True))
            return pa.table({"piece": [key[0].as_py()], "part": [key[1].as_py()], "n": [int(n.sum())], "value": [(total / n.sum()).astype("<f4").tobytes()]})

        kind, parts = "piece long, part long, n long, value binary", max(1, min(PARTS, tokens * passes // rounds // SHARE))
        learned = train.where(F.pmod(part - r, F.lit(rounds)) < passes).select("text").coalesce(parts).mapInArrow(learn, kind)
        while parts > 1:  # averages of averages, so that no task takes up those of all partitions
            parts = -(-parts // BRANCH)
            learned = learned.withColumn("part", F.expr(f"part div {BRANCH}")).groupBy("piece", "part").applyInArrow(average, kind)
        found = sorted(learned.collect())
        if found:
            model.set_state(np.concatenate([np.frombuffer(x.value, "<f4") for x in found]))
        sizes.append(found[0].n if found else 0)
    return model, sizes


class Scorer:
    """What a task needs to score texts: the network, the counts of frequent words, and totals of the training corpus."""

    def __init__(self, model: GatedLM, frequent: np.ndarray, counts: np.ndarray, known: np.ndarray, places: np.ndarray, total: int, distinct: int, rare: int):
        self.model, self.frequent, self.counts, self.known, self.places = model, frequent, counts, known, places
        self.total, self.distinct, self.rare = total, distinct, rare

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """Per text (tokens, known, base, score) without what the words that are not frequent add, and those words: (owner, word, times)."""
        words, n = with_ends(*word_hashes(data, offsets))
        unique, at = np.unique(words, return_inverse=True)
        k = np.minimum(np.searchsorted(self.frequent, unique), max(len(self.frequent) - 1, 0))
        found = self.frequent[k] == unique if len(self.frequent) else np.zeros(len(unique), bool)
        count = np.where(found, self.counts[k], 0) if len(self.frequent) else np.zeros(len(unique), np.int64)
        symbols = _symbols(unique, self.known, self.places)[at]
        logs, begins = np.log10(count + 1.0)[at], np.cumsum(n) - n
        base = np.add.reduceat(logs, begins) - n * np.log10(self.total + self.distinct + 1.0)
        rare = np.add.reduceat(np.where(symbols == 1, logs - np.log10(self.rare + 1.0), 0), begins)
        sure = np.add.reduceat((count > 0).astype(np.int64)[at], begins)
        score = self.model.log10s(symbols, n) + rare
        other = np.flatnonzero(~found[at])
        owner, place = np.repeat(np.arange(len(n)), n)[other], at[other]
        pair, times = np.unique(owner * len(unique) + place, return_counts=True)
        return n, sure, base, score, (pair // len(unique), unique[pair % len(unique)], times)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, times array<int>"


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``.

    Null or blank text is one end token. Repeated rows are scored alike and count as often as they occur. Without training tokens every
    word has count zero. Words are told apart by 64-bit hashes. Very long texts are scored whole. Null doc_id is a training row. An empty table
    gives an empty result; other columns are ignored. ``frequent`` only says which counts travel with the tasks; no score depends on it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "gru")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))

    def count(batches):
        for b in slices(batches, 0, ROWS, BYTES):
            words, made = np.unique(with_ends(*word_hashes(*text_buffers(b.column(0))))[0], return_counts=True)
            yield pa.record_batch([pa.array(words), pa.array(made.astype(np.int64))], names=["word", "n"])

    train = docs.where("not held_out")
    counts = scratch.save(train.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocabulary = max(vocabulary, int(4 * int(total) ** (1 / 3)))
    top = counts.orderBy(F.desc("c"), "word").limit(max(frequent, vocabulary + 1)).toArrow()
    word, c = top.column("word").to_numpy(), top.column("c").to_numpy()
    ends = int(c[word == END].sum())
    known, mass = word[word != END][:vocabulary], c[word != END][:vocabulary]
    rare = total - ends - int(mass.sum())
    rare_distinct = max(distinct - len(known) - (ends > 0), 0)
    places = np.argsort(known, kind="stable")
    known = known[places]
    model, _ = fit(train, int(total), known, places, np.concatenate([[ends, rare], mass]))
    model.sums = {}
    order = np.argsort(word, kind="stable")
    sent = shipped(spark, Scorer(model, word[order], c[order], known, places, int(total), int(distinct), int(rare + rare_distinct)))

    def score(batches):
        from pyspark import TaskContext

        scorer, rid = sent(), TaskContext.get().partitionId() << 40
        for b in slices(batches, 1, ROWS, BYTES):
            n, sure, base, whole, (owner, words, times) = scorer.score(*text_buffers(b.column(1)))
            ends = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words, times.astype(np.int32)))
            yield pa.record_batch([pa.array(rid + np.arange(len(n))), b.column(0), b.column(2), pa.array(n), pa.array(sure), pa.array(base), pa.array(whole), *lists], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"])
            rid += len(n)

    scored = scratch.save(docs.mapInArrow(score, SCORED), "scored")
    others = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", "w.words", "w.times")
    others = others.join(counts.select("word", "c"), F.col("words") == F.col("word"))
    more = others.groupBy("rid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    out = scored.drop("words", "times").join(more, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
