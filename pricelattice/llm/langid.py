"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams (ASCII letters folded to lower case, white space to one blank
kind), hashed into BUCKETS rows; a softmax over languages follows. Embeddings and softmax are fitted together, text by text. A part of
the sample is held back: there a temperature is fitted, and the least score at which accepted predictions are right often enough is the
rejection threshold (`accepted`).

Fitted on a bounded sample: at most PER_LANG texts of each language (fewer where there are over MOST / PER_LANG languages, so that about
MOST rows teach in all, LEAST of each language at least), by the least hashes of (doc_id, text), whole texts. Where they have more
than the language's part of SAMPLE_BYTES in all, the longest of them are left out, never the last one and never any other. Every text and every byte of it is scored. Null text and text without a letter
give 'und' with score 0, as does everything if no row has a language. A repeated row teaches once; repeated rows and null or repeated
doc_id are scored row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.llm.kernel import BLANK, _BYTE, mix, powers, slices, text_buffers
from pricelattice.llm.store import give_back, written

BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
PER_LANG, MOST, LEAST, SAMPLE_BYTES, EPOCHS, RIGHT = 500, 8000, 4, 1 << 26, 4, 0.99
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[BLANK] = 32


def grams(data: np.ndarray, bounds: np.ndarray):
    """(bucket, document) of every n-gram, order by order; none crosses a document's end."""
    v, n = _BYTE[_FOLD[data]], len(data)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    p = powers(8)
    h = v.copy()
    for order in range(2, max(ORDERS) + 1):
        m = n - order + 1
        if m <= 0:
            return
        h = h[:m] + v[order - 1 :] * p[order - 1]
        if order in ORDERS:
            ok = doc[:m] == doc[order - 1 :]
            yield (mix(h[ok] + np.uint64(order)) >> np.uint64(64 - BITS)).astype(np.int64), doc[:m][ok]


def sample(docs: DataFrame, with_class, keep: list[str], quota: Column, most: int, most_bytes: int, seed: int) -> pa.Table:
    """text, __pl_class and `keep` columns of at most `quota` (`most` at the most) distinct rows of each class, those of the least hashes
    of (doc_id, text), less the longest of them where they have more than most_bytes in all.

    with_class(keys) adds __pl_class (dropping rows without one) to narrow rows: doc_id, `keep` and a hash of the text. Only they are
    shuffled, each task sending no more than a class's quota; the rows chosen are few and counted before they are broadcast to the texts.
    """
    h = F.xxhash64("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    keys = docs.select("doc_id", *keep, size.alias("__pl_size"), h.alias("__pl_h")).withColumn("__pl_u", F.xxhash64("__pl_h", F.lit(seed)))
    keys = with_class(keys).groupBy("__pl_class", "__pl_u", "__pl_h").agg(F.max("__pl_size").alias("__pl_size"))
    of = Window.partitionBy("__pl_class").orderBy("__pl_u", "__pl_h")
    few = written(keys.withColumn("__pl_rank", F.row_number().over(of)).filter(F.col("__pl_rank") <= most), "sample_keys").filter(F.col("__pl_rank") <= quota)
    # Memory: where a class's texts have more than most_bytes in all, its longest ones go, however they rank; the shortest always stays.
    short = Window.partitionBy("__pl_class").orderBy("__pl_size", "__pl_u", "__pl_h")
    total = F.sum("__pl_size").over(short.rowsBetween(Window.unboundedPreceding, 0))
    fits = few.withColumn("__pl_total", total).withColumn("__pl_nth", F.row_number().over(short)).filter((F.col("__pl_total") <= most_bytes) | (F.col("__pl_nth") == 1))
    chosen = written(fits.select("__pl_class", "__pl_h"), "sample")
    small = chosen.count() <= 4 * MOST
    hit = docs.select("text", *keep, h.alias("__pl_h")).join(F.broadcast(chosen) if small else chosen, "__pl_h")
    return hit.groupBy("__pl_h", "__pl_class").agg(F.min(F.struct("text", *keep)).alias("r")).orderBy("__pl_h").select("r.text", "__pl_class", *[f"r.{c}" for c in keep]).toArrow()


class Model:
    def __init__(self, names: list[str], table: np.ndarray, soft: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.names, self.bias, self.temperature, self.least = names, bias, temperature, least
        # Few languages: the softmax goes into the table, and means of logits replace means of embeddings.
        self.folded = len(names) <= DIM
        self.table = np.ascontiguousarray((table @ soft if self.folded else table).astype(np.float32))
        self.soft = soft

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        docs = len(bounds) - 1
        total, count = np.zeros((docs, self.table.shape[1])), np.zeros(docs)
        for bucket, doc in grams(data, bounds):
            n = np.bincount(doc, minlength=docs)
            some = np.flatnonzero(n)
            first = np.searchsorted(doc, some)
            rows = self.table[bucket]
            total[some] += np.add.reduceat(rows, first, axis=0)
            count += n
        mean = total / np.maximum(count, 1)[:, None]
        return softmax(((mean if self.folded else mean @ self.soft) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Model | None:
    if not texts:
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    data, off = text_buffers(pa.array(texts, pa.string()))
    parts: list[list] = [[] for _ in texts]
    for a, b in slices(off):
        for bucket, doc in grams(data[off[a] : off[b]], off[a : b + 1] - off[a]):
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            for k in range(b - a):
                parts[a + k].append(bucket[cut[k] : cut[k + 1]])
    bags = [np.unique(np.concatenate(p) if p else np.zeros(0, np.int64), return_counts=True) for p in parts]
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.normal(0, 0.1, (1 << BITS, DIM))
    soft, bias = rng.normal(0, 0.3, (DIM, len(names))), np.zeros(len(names))
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for k in rng.permutation(train):
            idx, cnt = bags[k]
            if not len(idx):
                continue
            w = (cnt / cnt.sum())[:, None]
            x = (table[idx] * w).sum(0)
            g = softmax(x @ soft + bias)
            g[y[k]] -= 1
            back = soft @ g
            soft -= 0.1 * rate * np.outer(x, g)
            bias -= 0.01 * rate * g
            table[idx] -= rate * np.sqrt(w) * back  # a root of the share: rare grams learn too
    z = np.array([(table[i] * (c / c.sum())[:, None]).sum(0) @ soft + bias if len(i) else bias for i, c in (bags[k] for k in held)]).reshape(-1, len(names))
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else t
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = softmax(z / temperature) if len(held) else np.zeros((0, len(names)))
    top, right = p.max(1), p.argmax(1) == y[held]
    least = next((t for t in np.arange(0, 1, 0.02) if (top >= t).any() and right[top >= t].mean() >= RIGHT), 0.5)
    return Model(names, table, soft, bias, float(temperature), float(least))


def train(docs: DataFrame, usable: Column, per_lang: int = PER_LANG) -> Model | None:
    known = docs.filter(usable & F.col("lang").isNotNull())
    langs = max(1, known.select("lang").distinct().count())
    quota = max(LEAST, min(per_lang, MOST // langs))
    rows = sample(known, lambda keys: keys.withColumn("__pl_class", F.col("lang")), ["lang"], F.lit(quota), quota, SAMPLE_BYTES // langs, 11)
    model = fit(rows.column("text").to_pylist(), rows.column("__pl_class").to_pylist())
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` columns of docs, lang_pred, score, accepted."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches):
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        for b in batches:
            col = b.column("__pl_text")
            data, off = text_buffers(col)
            ascii_letter = pc.fill_null(pc.match_substring_regex(col, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
            for lo, hi in slices(off):
                known = ascii_letter[lo:hi].copy()
                for k in np.flatnonzero(~known & (np.diff(off[lo : hi + 1]) > 0)).tolist():
                    known[k] = letter.search(col[lo + k].as_py()) is not None
                if m is None:
                    lang, score, ok = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                else:
                    p = m.scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    lang = np.where(known, np.array(m.names, object)[p.argmax(1)], "und").tolist()
                    score = np.where(known, p.max(1), 0.0)
                    ok = known & (score >= m.least)
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("__pl_text")).mapInArrow(run, schema)
