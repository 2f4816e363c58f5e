"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word (a run of letters, digits and non-ASCII bytes, ASCII folded to lower case) has two hashes into one table of 2 ** BITS rows; its
embedding is the sum of both rows, so two words share an embedding only if both hashes meet. Filters of widths 1, 2 and 3 run over the
words of a text, a rectifier and a maximum over all positions follow, then a logistic unit. Everything starts at random and is trained on
mini-batches by Adagrad with dropout of words and of pooled features; only the positions that won a maximum get gradients. Words in fewer
than LEAST_DOCS training texts are left out of training (counted over all training texts, then kept as SEEN_BITS bits, where two words may meet),
and their embeddings stay near zero. A fifth of the rows, by a hash, is held back: the weights of least loss there are kept, a logistic curve fitted there makes the score a
probability, and there each language gets a threshold: that of its best F0.5, drawn towards the common one by PRIOR toxic rows. Curve and
thresholds rest on counts of all held-back rows by logit, rounded to 1 / FINE.

Every labelled row teaches. Rows are dealt by a hash to packs of some PACK_ROWS rows (fewer where their words fill PACK_WORDS), which are
written once. In each of ROUNDS rounds every pack goes on from the common weights by steps of its own, at least one over each of its rows,
and the changes are averaged, each weight's over the packs that moved it; sums are of fixed-point integers, so that the order of tasks does not
show. The first ALONE rounds take one pack: filters that start at random find different senses in different packs. The driver holds the weights, whose size is fixed, and sums.

Every text is scored whole. A null text counts as empty; a text without words gets the share of toxic rows among the labelled. A doc_id with
several labels takes the largest; a repeated row teaches once
and is scored row by row; null labels and null doc_ids teach nothing; without rows of both classes all scores are 0; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.llm.kernel import NO_DOCS, Spans, mix, slices, text_buffers
from pricelattice.llm.store import give_back, written

BITS, DIM, FILTERS, WIDTHS = 18, 8, 16, (1, 2, 3)
CUT, PRIOR = 0.7, 15
PACK_ROWS, PACK_WORDS, ROUNDS, ALONE, SEEN_BITS, FINE, FIXED = 5120, 1 << 23, 6, 1, 26, 1024, 1 << 32
STEPS, BATCH, RATE, LEAST_DOCS, WORD_DROPOUT, DROPOUT, DECAY = 3600, 8, 0.05, 3, 0.2, 0.3, 2e-3
#: Bytes of text scored at once: a word has some 600 bytes of responses.
SLICE = 1 << 17
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NOT_WORD = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NOT_WORD[_a:_b] = False


def word_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, second row of each word, word offsets by document)."""
    s = Spans(_FOLD[data], bounds, _NOT_WORD)
    h = s.hashes()
    shift = np.uint64(64 - BITS)
    return (h >> shift).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), s.doc


class Net:
    def __init__(self, table, conv, out, out_bias, curve=(1.0, 0.0), thresholds=None, common=CUT, empty=0.0):
        self.table, self.conv, self.out, self.out_bias = table, conv, out, out_bias
        self.curve, self.thresholds, self.common, self.empty = curve, thresholds or {}, common, empty

    def responses(self, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Filter responses before the maximum: one row per word, widths side by side; words past a text's end count as zero."""
        x = self.table[a] + self.table[b]
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(a))
        y = x @ self.conv
        out = np.empty((len(a), FILTERS * len(WIDTHS)), np.float32)
        at = 0
        for k, width in enumerate(WIDTHS):
            r = y[:, at : at + FILTERS].copy()
            for j in range(1, width):
                r[: len(r) - j] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * (left[: len(r) - j] > j)[:, None]
            out[:, k * FILTERS : (k + 1) * FILTERS] = r
            at += width * FILTERS
        return out

    def logit(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(np.maximum(self.responses(a, b, np.array([0, len(a)])).max(0), 0) @ self.out + self.out_bias)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a, b, offsets = word_rows(data, bounds)
        out = np.full(len(bounds) - 1, self.empty)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            pooled = np.maximum(np.maximum.reduceat(self.responses(a, b, offsets), offsets[some], axis=0), 0)
            out[some] = sigmoid(self.curve[0] * (pooled @ self.out + self.out_bias).astype(np.float64) + self.curve[1])
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Pack:
    """Some labelled rows: the different words of all (a, b), each text's words as numbers of these (word, with offsets), toxic, held (held
    back) and language."""

    def __init__(self, number: int, a: np.ndarray, b: np.ndarray, word: np.ndarray, off: np.ndarray, y: np.ndarray, held: np.ndarray, langs: list):
        self.number, self.a, self.b, self.word, self.off, self.y, self.held, self.langs = number, a, b, word, off, y, held, langs

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of training texts with it)."""
        docs = np.zeros(len(self.a), np.int64)
        for k in np.flatnonzero(~self.held):
            docs[np.unique(self.word[self.off[k] : self.off[k + 1]])] += 1
        some = np.flatnonzero(docs)
        return _keys(self.a[some], self.b[some]), docs[some]

    def training(self, seen: np.ndarray) -> tuple[list, np.ndarray]:
        """(words of each training text without the rare ones, toxic)."""
        keep = often(seen, _keys(self.a, self.b))
        rows = []
        for k in np.flatnonzero(~self.held):
            own = self.word[self.off[k] : self.off[k + 1]]
            own = own[keep[own]]
            rows.append((self.a[own], self.b[own]))
        return rows, self.y[~self.held]

    def moved(self, flat: np.ndarray, squares: np.ndarray, seen: np.ndarray, heavy: float, k: int, steps: int, seed: int):
        """Weights and squares after round k here, and which rows of them moved."""
        w, q = flat.copy(), squares.copy()
        rows, y = self.training(seen)
        one = max(steps // ROUNDS, -(-len(rows) // BATCH))
        _learn(w, q, rows, y, heavy, one, k, np.random.Generator(np.random.PCG64([seed, k, self.number])))
        return np.flatnonzero((q != squares).any(1)), w, q

    def judged(self, net: Net) -> dict:
        """Number of held-back rows by (language, toxic, rounded logit)."""
        out: dict = {}
        some = np.flatnonzero(self.held)
        z = np.full(len(some), net.out_bias, np.float64)
        for at, k in enumerate(some):
            own = self.word[self.off[k] : self.off[k + 1]]
            if len(own):
                z[at] = net.logit(self.a[own], self.b[own])
        z = np.rint(np.clip(z, -40, 40) * FINE).astype(int)
        for at, k in enumerate(some):
            key = self.langs[k], int(self.y[k]), int(z[at])
            out[key] = out.get(key, 0) + 1
        return out


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << BITS | b


def told(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b of the different words of some texts, frequent ones first; number of each word among these; word offsets by text), in slices."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for lo, hi in slices(off):
        a, b, o = word_rows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        own, of = np.unique(_keys(a, b), return_inverse=True)
        parts.append((own, of.astype(np.int32)))
        sizes.append(np.diff(o))
    every = np.unique(np.concatenate([own for own, _ in parts] + [NO_DOCS]))
    many, at = np.zeros(len(every), np.int64), []
    for own, of in parts:
        at.append(np.searchsorted(every, own))
        many[at[-1]] += np.bincount(of, minlength=len(own))
    order = np.argsort(-many, kind="stable")
    rank = np.empty(len(every), np.int32)
    rank[order] = np.arange(len(every), dtype=np.int32)
    word = np.empty(int(many.sum()), np.int32)
    x = 0
    for (_, of), to in zip(parts, at, strict=True):
        word[x : x + len(of)] = rank[to][of]
        x += len(of)
    every = every[order]
    return (every >> BITS).astype(np.int32), (every & ((1 << BITS) - 1)).astype(np.int32), word, np.cumsum(np.concatenate(sizes))


def _fixed(into: np.ndarray, hit: np.ndarray, new: np.ndarray, old: np.ndarray) -> None:
    """Adds the change of the rows hit in fixed point, a column at a time."""
    for i in range(DIM):
        into[hit, i] += np.rint((new[hit, i].astype(np.float64) - old[hit, i]) * FIXED).astype(np.int64)


def _bits(words: np.ndarray) -> np.ndarray:
    return (mix(words.astype(np.uint64)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def often(seen: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = _bits(words)
    return (seen[at >> 6] >> (at & 63)) & 1 == 1


def _flat(net: Net) -> np.ndarray:
    """All weights as rows of DIM: table, filters, output, bias."""
    last = np.zeros((1, DIM), np.float32)
    last[0, 0] = net.out_bias
    return np.concatenate([net.table, net.conv.T, net.out.reshape(-1, DIM), last]).astype(np.float32)


def _net(flat: np.ndarray) -> Net:
    """The net of such rows; its arrays are views of them, but for the bias."""
    t, c = 1 << BITS, FILTERS * sum(WIDTHS)
    return Net(flat[:t], flat[t : t + c].T, flat[t + c : -1].reshape(-1), flat[-1, 0])


def _start(rng) -> np.ndarray:
    span = sum(WIDTHS)
    return _flat(Net(rng.normal(0, 0.01, (1 << BITS, DIM)), rng.normal(0, 0.3, (DIM, FILTERS * span)), rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0))


def fit(texts: list[str] | pa.ChunkedArray, y: np.ndarray, langs: list, seed: int = 3, steps: int = STEPS) -> Net | None:
    """The net of rows in memory, as one pack."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    data, off = text_buffers(texts if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string()))
    a, b, word, at = told(data, off)
    del data, off
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 5]] = True
    pack = Pack(0, a, b, word, at, np.asarray(y), held, langs)
    word, docs = pack.words()
    seen = np.zeros(1 << (SEEN_BITS - 6), np.int64)
    at = _bits(word[docs >= LEAST_DOCS])
    np.bitwise_or.at(seen, at >> 6, np.int64(1) << (at & 63))

    def changes(flat, squares, heavy, k):
        hit, w, q = pack.moved(flat, squares, seen, heavy, k, steps, seed)
        sums = np.zeros(flat.shape, np.int64), np.zeros(flat.shape, np.int64)
        _fixed(sums[0], hit, w, flat)
        _fixed(sums[1], hit, q, squares)
        return hit, *([(x[hit, i] / float(FIXED)).astype(np.float32) for i in range(DIM)] for x in sums)

    train = pack.y[~held]
    return _rounds(changes, lambda flat: pack.judged(_net(flat)), ROUNDS if steps else 0, float(np.mean(y)), int(train.sum()), len(train), seed)


def _rounds(changes, judge, rounds: int, empty: float, toxic: int, rows: int, seed: int) -> Net:
    """changes(flat, squares, heavy, k): rows moved in round k and the mean changes of both, column by column. judge(flat): counts of held-back
    rows. toxic, rows: numbers of training rows."""
    flat = _start(np.random.Generator(np.random.PCG64(seed)))
    squares = np.full(flat.shape, 1e-2, np.float32)
    heavy = float(np.sqrt((rows - toxic) / max(1, toxic)))
    best = (np.inf, flat, {})
    for k in range(rounds):
        hit, w, q = changes(flat, squares, heavy, k)
        flat = flat.copy()
        for into, x in ((flat, w), (squares, q)):
            for i in range(DIM):
                into[hit, i] += x[i]
        del hit, w, q
        counts = judge(flat)
        loss = _loss(counts, heavy)
        if loss < best[0] or not counts:
            best = (loss, flat, counts)
    counts = best[2] if rounds else judge(flat)
    net = _net(best[1])
    net.empty = empty
    keys = _ordered(counts)
    y, z, n = (np.array(x, float) for x in ([k[1] for k in keys], [k[2] / FINE for k in keys], [counts[k] for k in keys]))
    net.curve = _curve(z, y, n)
    s = sigmoid(net.curve[0] * z + net.curve[1])
    own = np.array([k[0] for k in keys], object)
    net.common = _best_cut(s, y, n)
    for lang in {x for x in own if x is not None}:
        here = own == lang
        m = int((y * n)[here].sum())
        net.thresholds[lang] = (m * _best_cut(s[here], y[here], n[here]) + PRIOR * net.common) / (m + PRIOR)
    return net


def _ordered(counts: dict) -> list:
    return sorted(counts, key=lambda k: (k[0] is None, k[0] or "", k[1], k[2]))


def _loss(counts: dict, heavy: float) -> float:
    total = rows = 0.0
    for key in _ordered(counts):
        _, y, z, n = *key, counts[key]
        p = min(max(float(sigmoid(z / FINE)), 1e-6), 1 - 1e-6)
        total -= n * (heavy * np.log(p) if y else np.log(1 - p))
        rows += n
    return total / rows if rows else np.inf


def _learn(flat: np.ndarray, squares: np.ndarray, rows: list, y: np.ndarray, heavy: float, steps: int, k: int, rng) -> None:
    """Steps of round k by Adagrad on mini-batches, in place; the toxic class counts by `heavy`, the root of the classes' ratio."""
    use = np.flatnonzero([len(a) > 0 for a, _ in rows])
    if not len(use):
        return
    net, sums = _net(flat), _net(squares)
    starts, filters = np.cumsum([0, *WIDTHS]) * FILTERS, np.arange(FILTERS * len(WIDTHS))
    queue = np.zeros(0, np.int64)
    for step in range(steps):
        rate = np.float32(RATE * (1 - (k + step / steps) / ROUNDS))
        if len(queue) < BATCH:
            queue = np.concatenate([queue, rng.permutation(use)])
        now, queue = queue[:BATCH], queue[BATCH:]
        off = np.append(0, np.cumsum([len(rows[i][0]) for i in now]))
        a, b = (np.concatenate([rows[i][c] for i in now]) for c in (0, 1))
        r = net.responses(a, b, off)
        r[rng.random(len(r)) < WORD_DROPOUT] = -1e3
        win = np.stack([r[s:e].argmax(0) + s for s, e in zip(off[:-1], off[1:], strict=True)])
        pooled = np.maximum(r[win, filters], 0)
        stay = (rng.random(pooled.shape) >= DROPOUT) / np.float32(1 - DROPOUT)
        pooled = (pooled * stay).astype(np.float32)
        weight = np.where(y[now] == 1, heavy, 1.0)
        g = (weight * (sigmoid(pooled @ net.out + flat[-1, 0]) - y[now]) / len(now)).astype(np.float32)
        back = (g[:, None] * net.out * (pooled > 0) * stay).astype(np.float32)
        conv, at, grads = np.zeros_like(net.conv), [], []
        for w, width in enumerate(WIDTHS):
            own = slice(w * FILTERS, (w + 1) * FILTERS)
            for j in range(width):
                cols = starts[w] + j * FILTERS + np.arange(FILTERS)
                pos = win[:, own] + j
                bk = back[:, own] * (pos < off[1:, None])
                pos = np.minimum(pos, len(a) - 1)
                conv[:, cols] += np.einsum("df,dfe->ef", bk, net.table[a[pos]] + net.table[b[pos]])
                some = bk != 0
                e = (bk[..., None] * net.conv[:, cols].T[None])[some]
                at += [a[pos][some], b[pos][some]]
                grads += [e, e]
        hit, of = np.unique(np.concatenate(at), return_inverse=True)
        table = np.zeros((len(hit), DIM), np.float32)
        np.add.at(table, of, np.concatenate(grads))
        table += np.float32(DECAY) * net.table[hit]
        sums.table[hit] += table * table
        net.table[hit] -= rate * table / np.sqrt(sums.table[hit])
        for part, square, grad in ((net.conv, sums.conv, conv), (net.out, sums.out, (g[:, None] * pooled).sum(0))):
            square += grad * grad
            part -= rate * grad / np.sqrt(square)
        squares[-1, 0] += g.sum() ** 2
        flat[-1, 0] -= rate * g.sum() / np.sqrt(squares[-1, 0])


def _curve(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of best likelihood over n rows each, by Newton steps from (1, 0)."""
    a, b = 1.0, 0.0
    if not len(z) or y.min() == y.max():
        return a, b
    for _ in range(30):
        p = sigmoid(a * z + b)
        w = n * (p * (1 - p) + 1e-6)
        grad = np.array([(n * (p - y) * z).sum() + 1e-3 * (a - 1), (n * (p - y)).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _best_cut(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The cut of best F0.5, for which a clean document lost weighs more than a toxic one kept; among equals the middle one."""
    if not (y * n).sum():
        return CUT
    cuts = np.arange(0.05, 0.96, 0.01)
    f = np.array([1.25 * (y * n)[s >= c].sum() / max(1, n[s >= c].sum() + 0.25 * (y * n).sum()) for c in cuts])
    return float(np.median(cuts[f >= f.max() - 1e-9]))


def packs(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """A written row a pack of the labelled rows for which `usable` holds."""
    y = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y"))
    own = docs.filter(usable & F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    # Labels go to the hashes of rows, so texts are shuffled once.
    named = written(own.select("doc_id", "h", F.octet_length("text").alias("size")).join(y, "doc_id").select("h", "y", "size"), "taught")
    n, size = named.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    many = max(1, round(n / PACK_ROWS), -(-size // (6 * PACK_WORDS)))
    pack = F.pmod(F.xxhash64("h", F.lit(5)), F.lit(many)).cast("int").alias("pack")

    def together(t: pa.Table, labelled: pa.Table) -> pa.Table:
        h, mine = t.column("h").to_numpy(), labelled.column("h").to_numpy()
        order = pc.sort_indices(t.select(["h", "lang"]), [("h", "ascending"), ("lang", "ascending")]).to_numpy().astype(np.int64)
        order = order[np.append(True, h[order][1:] != h[order][:-1])[: len(order)]]
        order = order[np.isin(h[order], mine)]
        if not len(order):
            return _PACK.empty_table()
        h, by = h[order], np.argsort(mine)
        toxic = labelled.column("y").to_numpy()[by][np.searchsorted(mine[by], h)].astype(np.int64)
        a, b, word, off = told(*text_buffers(t.column("text").take(pa.array(order))))
        held = (mix(h.view(np.uint64)) >> np.uint64(32)) % np.uint64(5) == 0
        one = [labelled.column("pack")[0].as_py(), *(x.tobytes() for x in (a, b, word, off, toxic, held)), t.column("lang").take(pa.array(order)).to_pylist()]
        one += [len(toxic), int(toxic.sum()), int((~held).sum()), int(toxic[~held].sum())]
        return pa.Table.from_pydict(dict(zip(_PACK.names, ([v] for v in one), strict=True)), schema=_PACK)

    labelled = _bitmap(y.select(_bit("doc_id").alias("bit")), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(labelled)

    def known(batches):
        for b in batches:
            at = b.column("bit").to_numpy()
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)).drop_columns(["bit"])

    rows = own.select("h", "lang", "text", _bit("doc_id").alias("bit"))
    rows = rows.mapInArrow(known, rows.drop("bit").schema).withColumn("pack", pack)
    marks = named.groupBy("h").agg(F.max("y").alias("y")).withColumn("pack", pack)
    schema = "pack int, a binary, b binary, word binary, off binary, y binary, held binary, lang array<string>, n bigint, n_toxic bigint, n_train bigint, n_train_toxic bigint"
    out = written(rows.groupBy("pack").cogroup(marks.groupBy("pack")).applyInArrow(together, schema), "packs")
    shared.destroy()
    return out


def _bit(name: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(name), 64 - SEEN_BITS)


def _bitmap(bits: DataFrame, name: str) -> np.ndarray:
    """2 ** SEEN_BITS bits, of which those in column `bit` are set. Texts of unlabelled ids are mostly left out by it before they are shuffled;
    the join decides."""
    got = written(bits.groupBy(F.shiftright("bit", 6).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")), name).toArrow()
    out = np.zeros(1 << (SEEN_BITS - 6), np.int64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy()
    return out


_PACK = pa.schema([("pack", pa.int32()), *[(c, pa.binary()) for c in ("a", "b", "word", "off", "y", "held")], ("lang", pa.list_(pa.string())), *[(c, pa.int64()) for c in ("n", "n_toxic", "n_train", "n_train_toxic")]])


def _each(table: DataFrame, f, schema: pa.Schema) -> DataFrame:
    """What f makes of the packs of a task, taken one after the other, as rows."""

    def one_by_one(batches):
        for b in batches:
            for r in range(b.num_rows):
                kinds = {"a": np.int32, "b": np.int32, "word": np.int32, "off": np.int64, "y": np.int64, "held": bool}
                parts = (np.frombuffer(b.column(c)[r].as_buffer(), kind) for c, kind in kinds.items())
                yield Pack(b.column("pack")[r].as_py(), *parts, b.column("lang")[r].as_py())

    def run(batches):
        for columns in f(one_by_one(batches)):
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=1 << 16)

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    return table.select(*_PACK.names[:8]).mapInArrow(run, ", ".join(f"{x.name} {kinds[x.type]}" for x in schema))


def _gathered(df: DataFrame, name: str) -> pa.Table:
    """df by way of a written table, one pack in memory of a task at a time."""
    return written(df, name, 1).toArrow()


def train(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 3) -> Net | None:
    """Fits on all labelled rows for which `usable` holds."""
    table = packs(docs, labels, usable)
    n, toxic, rows, taught, first = table.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_toxic", "n_train", "n_train_toxic")], F.min("pack")).first()
    if toxic in (0, n):
        return None
    sc, longs = docs.sparkSession.sparkContext, lambda *names: pa.schema([(c, pa.int64()) for c in names])

    def words(own):
        for p in own:
            word, many = p.words()
            yield [pa.array(word), pa.array(many)]

    def bits(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(b.column("word").to_numpy()))], names=["bit"])

    counted = written(_each(table, words, longs("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS).select("word"), "counted", 1)
    seen = _bitmap(counted.mapInArrow(bits, "bit bigint"), "frequent")
    shared_seen = sc.broadcast(seen)
    ws, qs = [f"w{i}" for i in range(DIM)], [f"q{i}" for i in range(DIM)]

    def changes(flat, squares, heavy, k):
        shared = sc.broadcast((flat, squares))

        def f(own):
            size = shared.value[0].shape
            n, ws_, qs_ = np.zeros(size[0], np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for p in own:
                hit, w, q = p.moved(*shared.value, shared_seen.value, heavy, k, STEPS, seed)
                n[hit] += 1
                _fixed(ws_, hit, w, shared.value[0])
                _fixed(qs_, hit, q, shared.value[1])
                del p, w, q
            hit = np.flatnonzero(n)
            yield [pa.array(hit), pa.array(n[hit]), *(pa.array(x[hit, i]) for x in (ws_, qs_) for i in range(DIM))]

        own = table.filter(F.col("pack") == first) if k < ALONE else table
        mean = lambda c: (F.sum(c) / (F.sum("n") * F.lit(float(FIXED)))).cast("float").alias(c)
        # The driver gets the means in single precision, which is all that it adds.
        means = _each(own, f, longs("id", "n", *ws, *qs)).groupBy("id").agg(*[mean(c) for c in [*ws, *qs]]).withColumn("id", F.col("id").cast("int"))
        t = _gathered(means, "changes")
        shared.destroy()
        return t.column("id").to_numpy(), *([t.column(c).to_numpy() for c in names] for names in (ws, qs))

    def judge(flat):
        shared = sc.broadcast(flat)

        def f(own):
            c: dict = {}
            for p in own:
                for key, n in p.judged(_net(shared.value)).items():
                    c[key] = c.get(key, 0) + n
            yield [pa.array([x[0] for x in c], pa.string()), *(pa.array([x[i] for x in c], pa.int64()) for i in (1, 2)), pa.array(list(c.values()), pa.int64())]

        counts = _each(table, f, pa.schema([("lang", pa.string()), *longs("y", "z", "n")])).groupBy("lang", "y", "z").agg(F.sum("n").alias("n"))
        t = _gathered(counts, "held_back")
        shared.destroy()
        return {(r["lang"], r["y"], r["z"]): r["n"] for r in t.to_pylist()}

    del seen
    net = _rounds(changes, judge, ROUNDS, toxic / n, taught, rows, seed)
    shared_seen.destroy()
    give_back()
    return net


def score(docs: DataFrame, net: Net | None, keep: list[str], name: str = "score") -> DataFrame:
    """`keep` columns of docs and the score under `name`. Language is no input of it."""
    schema = docs.select(*keep).schema.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a table of fixed size

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for lo, hi in slices(off, SLICE):
                s = shared.value.scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) if shared.value else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in keep), pa.array(s, pa.float64())], names=schema.names)

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def threshold(net: Net | None, lang: Column) -> Column:
    """Calibrated threshold of a row's language."""
    if net is None:
        return F.lit(1.1)
    if not net.thresholds:
        return F.lit(net.common)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in net.thresholds.items() for x in kv])[lang], F.lit(net.common))
