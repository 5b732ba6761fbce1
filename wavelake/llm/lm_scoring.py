"""Language-model scoring by a causal self-attention model trained in numpy.

Texts are lower-cased (A-Z) words with one end. The model reads their byte-level subword ids:
masked self-attention over all ids before an id in its window and a feed-forward layer say, for
each id, which classes of ids are likelier there than they are everywhere. An id's probability is

    P(class | the two ids before it in its word, ids before) * P(unit | class, id before) * P(id | unit)

where the first factor is the softmax of the network's output plus a fixed bias, the log share
of the class after those two ids in training texts. The CONTEXTS most frequent pairs of ids have
a row of biases of their own, other ids one for each unit. The end of a word leads to the
classes of ids that begin a word, by one share for all contexts, so that what follows a word is
for the attention to say. Units are the UNITS most frequent ids and two for all the rest. All shares are
smoothed over everything that can be there, so the probabilities of all texts add up to at most
1; an id that no training text has can be scored too.

Scoring cuts a text into windows of LENGTH ids that overlap by LENGTH - STEP; a window scores
the ids that none before it has scored, so each id counts once. All windows of a batch go
through at once, those of like size together.

Training is data-parallel: in each round every task starts from the common weights, makes
Adam steps on its share of the round's training texts (those of a residue of a hash by the
number of rounds, so that the rounds together read each id of each training text once), and the
weights are averaged by Spark, a row for each weight. Shares come from the counts of all words
of all training texts. What is gathered grows with the input in tables only; the driver gets as
many numbers as the model has weights and shares.

The base score is a smoothed unigram model of words. Word counts cover all training texts and
stay in a table, by the words themselves; the head (words of the highest counts, HEAD at most)
is broadcast, and the other words of each document are joined to the table.

A null text is empty: its one token is the end. Rows without doc_id are held out. Repeated rows
are scored each. Only doc_id and text are read. An empty table gives an empty one; without any
training text the base score is 0 for each token and the model is the untrained one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE_WORDS, Block, dictionary, ranges, text_batches
from .bpe import Vocabulary, _given, binary, built
from .common import id_and_text, small_batches, written
from .pretokens import per_text, pieces, spread

#: Ids in a place of a window (one, so that attention sees each id before), places in a window, and new places of each window after the first.
PATCH, LENGTH, STEP = 1, 32, 24
WIDTH, HIDDEN = 16, 32
UNITS, CONTEXTS = 2048, 1 << 14
#: Classes of ids that begin a word and of others: an own one for the most frequent, bins for the rest. The end of a text is the last class.
BEGIN, WITHIN, BINS = 39, 40, 10
CLASSES = BEGIN + WITHIN + 1
ROUNDS, BATCH, RATE = 2, 128, 0.015
#: Weight of the coarser share in a finer one.
SMOOTH = 5.0
#: Words whose counts are broadcast at most.
HEAD = 200_000
NO_ROW = -1
#: Bytes of text that a task works on at once: the more, the fewer distinct words a byte.
BYTES = 2_000_000
#: Ids of texts whose places are made at once.
PART = 1 << 18

#: Windows that are scored at once.
AT_ONCE = 64
#: Logits are cut off at this, so that nothing is too large for its type.
MOST = 40.0

#: Rows of "e" that are no unit: before a text, and a place without an id, which is 0.
BEFORE, NONE = UNITS, UNITS + 1

SHAPES = {"e": (UNITS + 2, WIDTH), "pos": (LENGTH, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
MASK = np.tril(np.ones((LENGTH, LENGTH), np.float32))


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as views of one vector."""
    out, at = {}, 0
    for k, shape in SHAPES.items():
        out[k] = flat[at : at + SIZES[k]].reshape(shape)
        at += SIZES[k]
    return out


def first_weights(seed: int = 7) -> np.ndarray:
    """Small ones: the untrained model is nearly that of the shares alone."""
    rnd = np.random.default_rng(seed)
    flat = np.zeros(sum(SIZES.values()), np.float32)
    for k, x in unpack(flat).items():
        if x.ndim == 2:
            x[:] = rnd.normal(0, {"e": 0.1, "pos": 0.1, "out": 0.01}.get(k, WIDTH**-0.5 * 0.5), x.shape)
        if k == "e":
            x[NONE] = 0
    return flat


def times(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """a @ w for a matrix w, as one product over all rows of a instead of one for each of its first axis."""
    return (a.reshape(-1, a.shape[-1]) @ w).reshape(*a.shape[:-1], w.shape[1])


def rows_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], quickly. Places are in bounds."""
    return table.take(at, 0, mode="clip")


def reach(a: np.ndarray) -> float:
    """The greatest length of a row of a."""
    return float(np.einsum("...i,...i->...", a, a).max(initial=0)) ** 0.5


def weights(z: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """exp(z) of logits from -MOST to MOST, in place. bound: no logit is larger, or less than -bound."""
    if bound > MOST:
        np.clip(z, -MOST, MOST, out=z)
    return np.exp(z, out=z)


def output(w: dict, f: np.ndarray) -> np.ndarray:
    """The weight of each class, for rows of hidden()."""
    z = f @ w["out"]
    z += w["bias"]
    return weights(z, reach(f) * reach(w["out"].T) + float(np.abs(w["bias"]).max()))


def folded(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The products of weights that attention needs: of queries and keys, of values and what they are turned into."""
    return (w["q"] @ w["k"].T) * np.asarray(WIDTH**-0.5, w["q"].dtype), w["v"] @ w["o"]


def hidden(w: dict, x: np.ndarray, old: int = 0):
    """(what goes into the output layer, and what backward() needs) for rows of places (window, place, WIDTH). Only places from old on are asked for; they see those before, too."""
    n = x.shape[1]
    x = x + w["pos"][:n]
    qv = times(x, np.concatenate(folded(w), 1))
    q, v = qv[:, old:, :WIDTH], qv[:, :, WIDTH:]
    s = weights(q @ x.transpose(0, 2, 1), reach(q) * reach(x))
    s *= MASK[old:n, :n]
    s /= (s @ np.ones(n, s.dtype))[:, :, None]
    c = s @ v
    h = c + x[:, old:]
    r = times(h, w["w1"])
    r += w["b1"]
    np.clip(r, 0, np.inf, out=r)
    f = times(r, w["w2"])
    f += h
    return f, (x, q, v, s, c, h, r)


def backward(w: dict, g: dict, f: np.ndarray, kept: tuple, dz: np.ndarray) -> np.ndarray:
    """Adds the gradients of all weights but "e" to g, for the gradient dz of the output at all places; returns that of x."""
    x, q, v, s, c, h, r = kept
    two = lambda a: a.reshape(-1, a.shape[-1])
    ones = np.ones(len(two(x)), x.dtype)
    g["out"] += two(f).T @ two(dz)
    g["bias"] += ones @ two(dz)
    df = times(dz, w["out"].T)
    g["w2"] += two(r).T @ two(df)
    dr = times(df, w["w2"].T)
    dr *= r > 0
    g["w1"] += two(h).T @ two(dr)
    g["b1"] += ones @ two(dr)
    df += times(dr, w["w1"].T)
    ds = df @ v.transpose(0, 2, 1)
    ds -= np.einsum("...i,...i->...", df, c)[:, :, None]
    ds *= s
    back = ds.transpose(0, 2, 1) @ q
    d = np.empty((*x.shape[:2], 2 * WIDTH), x.dtype)
    np.matmul(ds, x, out=d[:, :, :WIDTH])
    np.matmul(s.transpose(0, 2, 1), df, out=d[:, :, WIDTH:])
    qk, vo = folded(w)
    both = two(x).T @ two(d)
    gq, gv = both[:, :WIDTH] * np.asarray(WIDTH**-0.5, x.dtype), both[:, WIDTH:]
    g["q"] += gq @ w["k"]
    g["k"] += gq.T @ w["q"]
    g["v"] += gv @ w["o"].T
    g["o"] += w["v"].T @ gv
    df += back
    df += times(d, np.concatenate([qk, vo], 1).T)
    g["pos"][: x.shape[1]] += df.sum(0)
    return df


class Units:
    """From the counts of ids (the end's last) and the vocabulary: unit of each id, class of each unit, and shares."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        v = len(counts)
        end, top = v - 1, UNITS - 3
        order = np.lexsort((np.arange(end), -counts[:-1]))
        self.unit = np.where(begins, UNITS - 2, UNITS - 3).astype(np.int32)  # the rest, and those of it that begin a word
        self.unit[order[:top]] = np.arange(len(order[:top]))
        self.unit[end] = UNITS - 1
        self.n = np.bincount(self.unit, counts, UNITS)
        self.share = np.log10((counts + 0.5) / np.bincount(self.unit, counts + 0.5, UNITS)[self.unit]).astype(np.float32)
        #: whether a unit begins a word, as the end does too
        self.begins = np.zeros(UNITS, bool)
        self.begins[self.unit] = begins
        self.begins[-1] = True
        self.kind = np.zeros(UNITS, np.int64)
        for first, classes, own in ((0, BEGIN, self.begins[:-1]), (BEGIN, WITHIN, ~self.begins[:-1])):
            at = np.flatnonzero(own)
            at = at[np.argsort(-self.n[at], kind="stable")]
            single = classes - BINS
            self.kind[at[:single]] = first + np.arange(len(at[:single]))
            weight = np.cumsum(np.sqrt(self.n[at[single:]] + 0.5))
            if len(weight):
                self.kind[at[single:]] = first + single + np.minimum((weight / weight[-1] * BINS).astype(np.int64), BINS - 1)
        self.kind[-1] = CLASSES - 1


class Shares:
    """after[row]: the share of each class of ids within a word after a context, then that of the word's end. starts: the share of each class after the end of a word. rows: row of a pair of units, NO_ROW without one of its own. inner[unit before, unit]: log10 share of a unit in its class."""

    def __init__(self, units: Units, pair_keys: np.ndarray, pair_n: np.ndarray, chosen: np.ndarray, triple_keys: np.ndarray, triple_n: np.ndarray):
        """pair_keys: unit before * (UNITS + 1) + unit, UNITS for the end of the word; chosen: the contexts' pairs, in order of their rows; triple_keys: row * (CLASSES + 1) + class, CLASSES for the end of the word."""
        kind, total = units.kind, np.bincount(units.kind, units.n + 0.5, CLASSES)
        starts = np.where(np.append(np.arange(CLASSES - 1) < BEGIN, True), total, 0)
        starts /= starts.sum()
        within = np.where(np.arange(CLASSES) >= BEGIN, total, 0)
        within[-1] = 0
        pairs = np.zeros((UNITS, UNITS + 1), np.float32)
        pairs[pair_keys // (UNITS + 1), pair_keys % (UNITS + 1)] = pair_n
        classes = np.zeros((UNITS, CLASSES + 1))
        for c in range(BEGIN, CLASSES - 1):
            classes[:, c] = pairs[:, :-1][:, kind == c].sum(1)
        classes[:, -1] = pairs[:, -1]
        prior = np.append(within, starts.sum() * max(1.0, pair_n[pair_keys % (UNITS + 1) == UNITS].sum()))
        prior /= prior.sum()
        one = (classes + SMOOTH * prior) / (classes.sum(1, keepdims=True) + SMOOTH)
        two = np.zeros((len(chosen), CLASSES + 1))
        two[triple_keys // (CLASSES + 1), triple_keys % (CLASSES + 1)] = triple_n
        two = (two + SMOOTH * one[chosen % UNITS]) / (two.sum(1, keepdims=True) + SMOOTH)
        # rows: the contexts, then one for each unit, then that of the beginning of a text
        rows = np.concatenate([two, one, np.append(np.zeros(CLASSES), 1.0)[None, :]])
        self.after = np.ascontiguousarray(np.concatenate([rows[:, BEGIN : BEGIN + WITHIN], rows[:, -1:]], 1).astype(np.float32))
        self.starts = starts.astype(np.float32)
        # a class's place in a row of after, and what its share there is to be multiplied by
        self.column = np.where(starts > 0, WITHIN, np.arange(CLASSES) - BEGIN)
        self.column[-1] = WITHIN
        self.factor = np.where(self.column == WITHIN, starts, 1).astype(np.float32)
        self.rows = np.full(UNITS * UNITS, NO_ROW, np.int32)
        self.rows[chosen] = np.arange(len(chosen))
        self.first = len(chosen)
        of_class = ((units.n + 0.5) / total[kind]).astype(np.float32)
        inner = (pairs[:, :-1] + SMOOTH * of_class) / (classes[:, :-1][:, kind].astype(np.float32) + np.float32(SMOOTH))
        inner[:, units.begins] = of_class[units.begins]
        self.inner = np.concatenate([np.log10(inner), np.log10(of_class)[None, :]]).astype(np.float32)


def totals(e: np.ndarray, row: np.ndarray, kind: np.ndarray, shares: Shares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of each place's class times its weight in e, the sum of that over all classes, rows of after). The classes after a word's end have one share in all rows."""
    after = rows_of(shares.after, row)
    nth = np.arange(len(e))
    hit = rows_of(after.ravel(), nth * (WITHIN + 1) + rows_of(shares.column, kind))
    hit *= rows_of(shares.factor, kind)
    hit *= rows_of(e.ravel(), nth * CLASSES + kind)
    total = e @ shares.starts
    total *= after[:, WITHIN]
    total += np.einsum("ij,ij->i", e[:, BEGIN : BEGIN + WITHIN], after[:, :WITHIN])
    return hit, total, after


class Model:
    def __init__(self, units: Units, shares: Shares, flat: np.ndarray):
        self.units, self.shares, self.flat = units, shares, flat


class Patches:
    """The places of a batch of texts (ids with an end after each): one for each id, PATCH."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, units: Units, shares: Shares):
        self.many = counts + 1
        ends = np.cumsum(self.many)
        self.first = ends - self.many  # of each text
        self.want = np.insert(ids.astype(np.int64), np.cumsum(counts), len(units.unit) - 1)
        self.size = np.full(len(self.want), PATCH, np.int8)
        self.unit = rows_of(units.unit, self.want)
        self.kind = rows_of(units.kind, self.unit)
        first = np.zeros(len(self.want), bool)
        first[self.first] = True
        #: the unit before each place
        self.before = np.empty(len(self.want), np.int64)
        self.before[1:] = self.unit[:-1]
        self.before[first] = BEFORE
        self.row = shares.first + self.before
        # both ids before are of the word if the first of them is and the second doesn't begin one
        pair = np.flatnonzero((self.before < UNITS) & ~units.begins[np.minimum(self.before, UNITS - 1)])
        pair = pair[~first[pair - 1]]
        own = rows_of(shares.rows, self.before[pair - 1] * UNITS + self.before[pair])
        self.row[pair] = np.where(own != NO_ROW, own, self.row[pair])

    def windows(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, number of places, number of those that aren't new) of each window."""
        many = 1 + np.maximum(0, -(-(self.many - LENGTH) // step))
        nth = ranges(np.zeros_like(many), many)
        start = np.repeat(self.first, many) + step * nth
        return start, np.minimum(LENGTH, np.repeat(self.first + self.many, many) - start), np.where(nth > 0, LENGTH - step, 0)

    def inputs(self, w: dict, start: np.ndarray, size: np.ndarray):
        """(x: the embedding of the unit before each place of windows, places, which are in their window, units of x)."""
        n = int(size.max())
        place = np.minimum(start[:, None] + np.arange(n), len(self.want) - 1)
        inside = np.arange(n) < size[:, None]
        units = np.where(inside, rows_of(self.before, place), NONE)
        return rows_of(w["e"], units), place, inside, units


def embed_gradient(g: np.ndarray, dx: np.ndarray, units: np.ndarray) -> None:
    by, at = np.ascontiguousarray(dx.reshape(-1, WIDTH).T), units.ravel()
    for i in range(WIDTH):
        g[:, i] += np.bincount(at, by[i], UNITS + 2).astype(g.dtype)
    g[NONE] = 0


def gradient(flat: np.ndarray, p: Patches, shares: Shares, start: np.ndarray, size: np.ndarray, tell: bool = True) -> tuple[float, np.ndarray]:
    """(mean loss if tell, gradient) of the classes of all ids in windows."""
    w, out = unpack(flat), np.zeros_like(flat)
    g, total, n = unpack(out), 0.0, int(size.sum())
    for i in range(0, len(start), AT_ONCE):
        x, place, inside, units = p.inputs(w, start[i : i + AT_ONCE], size[i : i + AT_ONCE])
        f, rest = hidden(w, x)
        e = output(w, f.reshape(-1, WIDTH))
        place = place.ravel()
        kind = rows_of(p.kind, place)
        hit, every, after = totals(e, rows_of(p.row, place), kind, shares)
        if tell:
            total -= float((np.log(hit / every) * inside.ravel()).sum())
        # places outside of their window have no loss
        one = (inside.ravel() / np.asarray(n, e.dtype)).astype(e.dtype)
        after *= (one / every)[:, None]
        dz = np.multiply.outer(after[:, WITHIN], shares.starts)
        dz[:, BEGIN : BEGIN + WITHIN] += after[:, :WITHIN]
        dz *= e
        dz.ravel()[np.arange(len(dz)) * CLASSES + kind] -= one
        embed_gradient(g["e"], backward(w, g, f, rest, dz.reshape(*inside.shape, CLASSES)), units)
    return total / n, out


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.m, self.v, self.t = flat.copy(), rate, np.zeros_like(flat), np.zeros_like(flat), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.flat -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def scored(model: Model, p: Patches) -> np.ndarray:
    """log10 probability of each id of a batch, ends included. Attention is over all ids before it in the window that scores it."""
    w, shares, units = unpack(model.flat), model.shares, model.units
    hits, every = np.ones(len(p.want)), np.ones(len(p.want))
    start, size, old = p.windows(STEP)
    for seen in np.unique(old).tolist():
        order = np.flatnonzero(old == seen)
        order = order[np.argsort(size[order], kind="stable")]
        for i in range(0, len(order), AT_ONCE):
            own = order[i : i + AT_ONCE]
            x, place, inside, _ = p.inputs(w, start[own], size[own])
            f, _ = hidden(w, x, seen)
            new = inside[:, seen:]
            f, place = (f.reshape(-1, WIDTH), place[:, seen:].ravel()) if new.all() else (f[new], place[:, seen:][new])
            hits[place], every[place], _ = totals(output(w, f), rows_of(p.row, place), rows_of(p.kind, place), shares)
    out = np.log10(hits / every)
    out += rows_of(shares.inner.ravel(), p.before * UNITS + p.unit)
    return out + rows_of(units.share, p.want)


def parts(ids: np.ndarray, counts: np.ndarray):
    """ids and counts of texts in turn, of about PART ids at most; a text is never cut."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(counts):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PART, "right")) - 1)
        yield ids[upto[a] : upto[z]], counts[a:z]
        a = z


def after_blanks(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Words that lie end to end, each with a blank before it."""
    to = off + np.arange(len(off))
    out = np.full(to[-1], 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(off)), np.diff(off))] = data
    return binary(out, to[1:])


class Reader:
    """Words and ids of batches of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, texts: pa.Array):
        """(words of each text, number of each word among the distinct ones, these, ids of all words, number of ids of each text)."""
        spans = Block(texts).words(SPACE_WORDS)
        if not len(spans):
            none = np.zeros(0, np.int64)
            return spans.counts, none, [], none, spans.counts
        codes, data, off = dictionary(spans, True)
        ids, counts = spread(codes, *self.vocabulary.encode(after_blanks(data, off)))
        return spans.counts, codes, pieces(data, off), ids, per_text(spans, counts)


_readers: dict = {}


def reader(vocabulary: str, raw) -> Reader:
    """Made once in each Python worker."""
    if vocabulary not in _readers:
        _readers[vocabulary] = Reader(built(vocabulary, raw))
    return _readers[vocabulary]


def counted_words(learned: DataFrame) -> DataFrame:
    """word, n: how often training texts (text) have each word, lower-cased."""

    def run(batches):
        for b in text_batches(batches, BYTES):
            spans = Block(b.column(0)).words(SPACE_WORDS)
            if len(spans):
                codes, data, off = dictionary(spans, True)
                yield pa.RecordBatch.from_arrays([pa.array(pieces(data, off), pa.binary()), pa.array(np.bincount(codes, minlength=len(off) - 1))], ["word", "n"])

    return learned.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def coded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """ids (u32, end to end), sizes (u32), n (of each word) of blocks of words: each distinct word is encoded once."""
    raw = _given(words, vocabulary)

    def run(batches):
        v = built(vocabulary, raw)
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                own = b.slice(at, 20_000)
                ids, counts = v.encode(pa.array([b" " + w for w in own.column(0).to_pylist()], pa.large_binary()))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<u4"), counts.astype("<u4"), own.column(1).to_numpy().astype("<i8"))], ["ids", "sizes", "n"])

    return written(words.select("word", "n").mapInArrow(run, "ids binary, sizes binary, n binary"), "coded")


def _of_words(coded: DataFrame, count) -> DataFrame:
    """key, n: sums of what count(ids, number of ids of each word, n of each word) -> (keys, n) gives over all words."""

    def run(batches):
        rows = []
        for b in batches:
            for ids, sizes, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(count(np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(n, "<i8")))
                if len(rows) >= 50:
                    rows = [_summed(rows)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(rows)], ["key", "n"])

    return coded.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = counts.toArrow()
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(key)
    return key[order].astype(np.int64), n[order].astype(np.int64)


def gathered(words: DataFrame, vocabulary: str, ends: int) -> tuple[Units, Shares]:
    """Units and shares from the counts of all words, in three passes over the distinct words. What is collected is bounded by the vocabulary, by pairs of units, and by contexts times classes."""
    v = built(vocabulary, _given(words, vocabulary))
    size = len(v.ends) - 1
    counts = np.zeros(size + 1, np.int64)
    coded = coded_words(words, vocabulary)
    key, n = _collected(_of_words(coded, lambda ids, k, n: (ids, np.repeat(n, k))))
    counts[key], counts[size] = n, ends
    begins = np.zeros(size + 1, bool)
    some = np.flatnonzero(np.diff(v.ends) > 0)
    begins[some] = v.bytes[v.ends[some]] == 0x20
    begins[size] = True
    units = Units(counts, begins)
    given = words.sparkSession.sparkContext.broadcast(units)

    def pairs(ids, k, n):
        unit, last = given.value.unit[ids].astype(np.int64), np.cumsum(k) - 1
        after = np.append(unit[1:], 0)
        after[last] = UNITS
        return unit * (UNITS + 1) + after, np.repeat(n, k)

    pair_keys, pair_n = _collected(_of_words(coded, pairs))
    inner = np.flatnonzero(pair_keys % (UNITS + 1) < UNITS)
    best = inner[np.lexsort((pair_keys[inner], -pair_n[inner]))][:CONTEXTS]
    chosen = np.sort(pair_keys[best] // (UNITS + 1) * UNITS + pair_keys[best] % (UNITS + 1))
    sent = words.sparkSession.sparkContext.broadcast(chosen)

    def triples(ids, k, n):
        unit, last = given.value.unit[ids].astype(np.int64), np.cumsum(k) - 1
        chosen = sent.value
        after = np.append(given.value.kind[unit[1:]], 0)
        after[last] = CLASSES
        at = np.setdiff1d(np.arange(len(unit)), last - k + 1)  # ids with another of their word before them
        pair = unit[at - 1] * UNITS + unit[at]
        row = np.minimum(np.searchsorted(chosen, pair), max(0, len(chosen) - 1))
        own = chosen[row] == pair if len(chosen) else np.zeros(len(at), bool)
        return row[own] * (CLASSES + 1) + after[at[own]], np.repeat(n, k)[at[own]]

    return units, Shares(units, pair_keys, pair_n, chosen, *_collected(_of_words(coded, triples)))


def of_round(learned: DataFrame, round_: int, rounds: int) -> DataFrame:
    """The training texts of a round: each text is in exactly one of the rounds."""
    return learned.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == round_).select("text")


def trained(learned: DataFrame, vocabulary: str, model: Model, round_: int, rounds: int, rate: float) -> np.ndarray:
    """The mean of the weights that tasks reach from the model's on their texts of this round, by the windows that each has seen."""
    spark = learned.sparkSession
    raw = _given(learned, vocabulary)
    given = spark.sparkContext.broadcast(model)

    def run(batches):
        read, model = reader(vocabulary, raw), given.value
        adam, seen, rnd = Adam(model.flat, rate), 0, np.random.default_rng(round_)
        for b in text_batches(batches, BYTES):
            *_, ids, counts = read(b.column(0))
            for own_ids, own_counts in parts(ids, counts):
                p = Patches(own_ids, own_counts, model.units, model.shares)
                start, size, _ = p.windows(LENGTH)
                # windows of like size in one step, steps in any order
                order = np.argsort(size, kind="stable")
                for i in rnd.permutation(-(-len(order) // BATCH)).tolist():
                    own = order[i * BATCH : (i + 1) * BATCH]
                    adam.step(gradient(adam.flat, p, model.shares, start[own], size[own], False)[1])
                seen += len(order)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(adam.flat))), pa.array(adam.flat.astype(float) * seen), pa.array(np.full(len(adam.flat), seen))], ["at", "value", "n"])

    rows = of_round(learned, round_, rounds).mapInArrow(run, "at long, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toPandas()
    out = model.flat.copy()
    out[rows["at"].to_numpy(int)] = rows["value"].to_numpy(float)
    return out


def fit(learned: DataFrame, vocabulary: str, words: DataFrame, ends: int, rounds: int = ROUNDS) -> Model:
    """The model of training texts (text), from their word counts and the number of texts."""
    model = Model(*gathered(words, vocabulary, ends), first_weights())
    for i in range(rounds):
        model = Model(model.units, model.shares, trained(learned, vocabulary, model, i, rounds, RATE / 3**i))
    return model


def log_probabilities(docs: DataFrame, vocabulary: str, held_out, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. held_out: a column of doc_id; the other rows are learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs).withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    learned = rows.where(~F.col("held_out"))
    words = written(counted_words(learned), "words")
    raw = _given(docs, vocabulary)
    total = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = learned.count()
    v, n = total["v"] + (ends > 0), (total["n"] or 0) + ends
    # the head: whole classes of counts from the highest down, while they fit
    level = F.floor(4 * F.log2("n")).cast("int")
    fits, least = 0, 1 << 30
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        if (fits := fits + r["n"]) > HEAD:
            break
        least = r["level"]
    head = words.where(level >= least).toArrow()
    model = fit(learned, vocabulary, words, ends, rounds)
    sent = spark.sparkContext.broadcast((model, dict(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True))))
    per = n + 0.5 * (v + 1)
    end_score = np.log10((ends + 0.5) / per)

    def run(batches):
        read = reader(vocabulary, raw)
        model, seen = sent.value
        for b in text_batches(batches, BYTES):
            n_words, codes, words, ids, counts = read(b.column(1))
            lp = np.concatenate([scored(model, Patches(*part, model.units, model.shares)) for part in parts(ids, counts)])
            score = np.add.reduceat(lp, np.cumsum(counts + 1) - counts - 1)
            of_word = np.fromiter((seen.get(w, 0) for w in words), np.float64, len(words))
            doc, times = np.repeat(np.arange(b.num_rows), n_words), of_word[codes]
            known = times > 0
            base = np.bincount(doc[known], np.log10((times[known] + 0.5) / per), b.num_rows) + end_score
            n_known = np.bincount(doc[known], minlength=b.num_rows)
            off = np.concatenate([[0], np.cumsum(n_words - n_known)]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(off), pa.array(words, pa.binary()).take(pa.array(codes[~known])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_words + 1), pa.array(n_known + (ends > 0)), pa.array(base), pa.array(score), rest], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>")
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words beyond the head, with how often each row has them
    rest = out.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rest = rest.join(words.where(level < least), "word", "left")
    share = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(float(per)))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * share).alias("rest_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    out = out.drop("rest").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "rest_known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), plus("base", "rest_base").alias("base_score"), "score")
