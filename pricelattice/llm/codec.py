"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Encoding. Let last[i] be the last token of the BPE encoding of the first i units of a word. A token t ending at i is last[i] exactly if
it starts the word, or last[i - |t|] and t stay two tokens when encoded together (Berglund and van der Merwe, "Formalizing BPE
tokenization"). So last[] grows unit by unit with no look back beyond the longest token. How far can later units change what stands
before? A change moves left only along merges of rising rank, each of which takes as its right part what the one before had as its left
part; lookahead() finds the longest such chain in one pass over the merge list. A token whose end lies that far behind the newest unit is
stable: it is emitted and its units are forgotten, so memory is constant whatever the word's length.

Decoding. A state machine over the tokens' bytes keeps at most three bytes of an unfinished character; invalid bytes become U+FFFD.
surface() streams what the library's decode() gives for a vocabulary without a decoder: the tokens' own spellings, joined by blanks.

Texts: null counts as empty and gives no ids and an empty decoding; repeated rows are encoded row by row; null or repeated doc_id,
other columns and empty tables need no special care.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pricelattice.llm.kernel import SpanCache, Spans, distinct, slices, text_buffers

_CACHE_MOST = 300_000
#: Bytes of text encoded at once: words that are said again in them go through once.
SLICE = 1 << 21


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself where printable in Latin-1, else from U+0100 on in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merge ranks and text rules of a word-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((x, y), r)
            if z not in self.parts:
                self.parts[z], self.born[z] = (x, y), r
        self.longest = max(self.width(s) for s in self.ids)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        self.lookahead = self._lookahead()

    def width(self, s: str) -> int:
        return len(s) - (len(self.end) if self.end and s.endswith(self.end) and len(s) > len(self.end) else 0)

    def _lookahead(self) -> int:
        """Units over which a later unit can act, by a pass over the merges in rank order: best[x] is the longest chain so far whose
        last merge has x as its left part; a later merge with x as its right part carries it on."""
        width = {i: self.width(s) for s, i in self.ids.items()}
        best: dict[int, int] = {}
        most = 0
        for (x, y), _ in sorted(self.rank.items(), key=lambda kv: kv[1]):
            chain = width[x] + max(best.get(y, 0), width[y])
            best[x] = max(best.get(x, 0), chain)
            most = max(most, chain)
        return most + self.longest

    def words(self, text: str) -> list[bytes | int]:
        """Words as UTF-8 bytes, and ids of special tokens, in order."""
        if self.special is None or "<" not in text:
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._words(text[at : m.start()]), self.specials[m.group()]]
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[bytes]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # character by character: no final sigma
        if low.isalpha():
            return [low.encode()]
        if low[-1:] in (".", ",") and low[:-1].isalpha():
            return [low[:-1].encode(), low[-1:].encode()]
        return [w.encode() for w in self.split.findall(low)]

    def units(self, w: bytes) -> str:
        return "".join([self.alphabet[b] for b in w])


class Transducer:
    """feed() units of one word, finish() it; both give tokens as they become stable."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        self.text, self.last, self.held = "", [None], ""

    def spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """Nodes on the right (side 1) or left (0) edge of a token's merge tree, unit first, with the rank at which each is merged on."""
        s = self.spines[side].get(t)
        if s is None:
            nodes, x = [t], t
            while x in self.v.parts:
                x = self.v.parts[x][side]
                nodes.append(x)
            s = [(n, self.v.born[nodes[i - 1]] if i else float("inf")) for i, n in enumerate(nodes)][::-1]
            self.spines[side][t] = s
        return s

    def stay_two(self, a: int, b: int) -> bool:
        """Whether a and b remain two tokens when their units are encoded together: no merge across the seam comes first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > _CACHE_MOST:
            self.pairs.clear()
        left, right, i, j, ok = self.spine(a, 1), self.spine(b, 0), 0, 0, True
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            q = self.v.rank.get((x, y))
            if q is not None and q < until_x and q <= until_y:
                ok = False
                break
            if until_x <= until_y:
                if until_x == float("inf"):
                    break
                i += 1
            else:
                j += 1
        self.pairs[key] = ok
        return ok

    def _step(self, end: str) -> None:
        """Extends last[] to all of self.text; `end` marks the last unit of the word."""
        text, ids, last = self.text, self.v.ids, self.last
        n = len(text)
        for size in range(min(n, self.v.longest), 0, -1):
            t = ids.get(text[n - size :] + end)
            if t is not None:
                before = last[n - size]
                if before is None:
                    if size == n and self.fresh:
                        last.append((t, size))
                        return
                elif self.stay_two(before[0], t):
                    last.append((t, size))
                    return
        raise ValueError("a unit is not in the vocabulary")

    fresh = True

    def feed(self, units: str):
        """Tokens that become stable with these units, which are not the last of the word."""
        for u in units:
            if self.held:
                self.text += self.held
                self._step("")
            self.held = u
            if len(self.text) > 4 * self.v.lookahead + 64:
                yield from self._emit(len(self.text) - self.v.lookahead)

    def _trace(self) -> list[tuple[int, int]]:
        out, at = [], len(self.text)
        while at > self.base:
            t, size = self.last[at]
            out.append((t, at))
            at -= size
        return out[::-1]

    base = 0

    def _emit(self, limit: int):
        """Gives out stable tokens and forgets their units, but for the last token, which the next one is held against."""
        stable = [x for x in self._trace() if x[1] <= limit]
        if len(stable) < 2:
            return
        for t, _ in stable:
            yield t
        t, cut = stable[-1]
        keep = self.last[cut]
        self.text = self.text[cut:]
        self.last = [keep, *self.last[cut + 1 :]]
        self.fresh = False

    def finish(self):
        """The rest of the word's tokens; the transducer is then ready for the next word."""
        if self.held:
            self.text += self.held
            self._step(self.v.end)
            for t, _ in self._trace():
                yield t
        self.reset()
        self.fresh = True

    def word(self, w: str) -> list[int]:
        out = list(self.feed(w))
        out.extend(self.finish())
        return out

class Lockstep:
    """The transducer's states for many words at once: column i of `tok` holds last[i] of every word. It takes words of at most MOST bytes,
    less than the lookahead: before a word's end none of its tokens is stable, and at the end all are."""

    MOST = 32

    def __init__(self, vocab: Vocabulary):
        self.v, self.one = vocab, Transducer(vocab)
        rng = np.random.Generator(np.random.PCG64(7))
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.pow = np.cumprod(np.full(self.MOST + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        self.inv = np.array([pow(int(p), -1, 1 << 64) for p in self.pow], np.uint64)
        self.at_end = np.uint64(0x5851F42D4C957F2D)
        keys, ids = [], []
        for s, i in vocab.ids.items():
            end = bool(vocab.end) and s.endswith(vocab.end) and len(s) > len(vocab.end)
            raw = [vocab.byte[c] for c in (s[: -len(vocab.end)] if end else s)]
            if len(raw) <= self.MOST:
                h = sum(int(self.byte[b]) * int(self.pow[k]) for k, b in enumerate(raw)) + (int(self.at_end) if end else 0)
                keys.append(h * int(self.inv[0]) & (1 << 64) - 1)
                ids.append(i)
        self.tokens = Table(np.array(keys, np.uint64), np.array(ids, np.int64))
        pairs = list(vocab.rank.items())
        self.far = 1 << 40
        self.merges = Table(np.array([x << 32 | y for (x, y), _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64))
        n = max(vocab.ids.values()) + 1
        edges = [[self.one.spine(t, side) if t in vocab.spelling else [(0, 0)] for t in range(n)] for side in (1, 0)]
        deep = max(len(s) for e in edges for s in e)
        self.node = [np.zeros((n, deep), np.int64) for _ in edges]
        self.until = [np.full((n, deep), self.far, np.int64) for _ in edges]
        for k, e in enumerate(edges):
            for t, s in enumerate(e):
                self.node[k][t, : len(s)] = [x for x, _ in s]
                self.until[k][t, : len(s)] = [self.far if u == float("inf") else u for _, u in s]

    def stay_two(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Transducer.stay_two() of pairs."""
        ok = np.ones(len(a), bool)
        i, j, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            p, q, x, y = a[live], b[live], i[live], j[live]
            ux, uy = self.until[0][p, x], self.until[1][q, y]
            r = self.merges.get(self.node[0][p, x].astype(np.uint64) << np.uint64(32) | self.node[1][q, y].astype(np.uint64), self.far + 1)
            bad = (r < ux) & (r <= uy)
            ok[live[bad]] = False
            left = ux <= uy
            go = ~bad & ~(left & (ux == self.far))
            i[live[go & left]] += 1
            j[live[go & ~left]] += 1
            live = live[go]
        return ok

    def run(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n > self.MOST or len(which) < 24:
                for k in which.tolist():
                    out[k] = self.one.word(self.v.units(words[k]))
                continue
            rows = which.tolist()
            tok, back = self._states(np.frombuffer(b"".join([words[k] for k in rows]), np.uint8).reshape(-1, n))
            at, every, steps = np.full(len(rows), n), np.arange(len(rows)), []
            while (at > 0).any():
                steps.append(np.where(at > 0, tok[every, at], -1))
                at = np.maximum(0, at - back[every, at])
            for k, row in zip(rows, np.stack(steps[::-1], 1).tolist(), strict=True):
                out[k] = [t for t in row if t >= 0]
        return out

    def _states(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, n = m.shape
        pre = np.zeros((n + 1, w), np.uint64)
        np.cumsum((self.byte[m] * self.pow[:n]).T, axis=0, out=pre[1:])
        tok, back = np.full((w, n + 1), -1, np.int64), np.zeros((w, n + 1), np.int64)
        for i in range(1, n + 1):
            todo = np.arange(w)
            for d in range(min(i, self.v.longest), 0, -1):
                j = i - d
                h = (pre[i][todo] - pre[j][todo]) * self.inv[j]
                if i == n:
                    h = h * self.pow[0] + self.at_end
                    h *= self.inv[0]
                t = self.tokens.get(h, -1)
                hit = np.flatnonzero(t >= 0)
                if j and len(hit):
                    hit = hit[self.stay_two(tok[todo[hit], j], t[hit])]
                if len(hit):
                    tok[todo[hit], i], back[todo[hit], i] = t[hit], d
                    left = np.ones(len(todo), bool)
                    left[hit] = False
                    todo = todo[left]
                if not len(todo):
                    break
            else:
                raise ValueError("a unit is not in the vocabulary")
        return tok, back


class Table:
    """64-bit keys to values: a slot by the key's hash, sorted search for the few keys that lost their slot."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.slot[self._at(keys)] = np.arange(len(keys))
        lost = np.flatnonzero(self.slot[self._at(keys)] != np.arange(len(keys)))
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_values = keys[lost], values[lost]
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[self._at(self.lost)] = True

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._at(keys)
        k = self.slot[at]
        out = np.where((k >= 0) & (self.keys[k] == keys), self.values[k], missing)
        again = np.flatnonzero(self.shared[at])
        if len(again):
            p = np.minimum(np.searchsorted(self.lost, keys[again]), len(self.lost) - 1)
            found = self.lost[p] == keys[again]
            out[again[found]] = self.lost_values[p[found]]
        return out


class TextMachine:
    """Incremental decoder: ids in, text out as soon as its characters are whole."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.byte = vocab.byte
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def text(self, t: int) -> str:
        """Byte-level text of one more token; a word's end is a blank."""
        if t in self.v.specials.values():
            return self.utf8.decode(b"", True) + self.v.spelling[t]
        s = self.v.spelling[t]
        end = bool(self.v.end) and s.endswith(self.v.end) and len(s) > len(self.v.end)
        raw = bytes(self.byte[c] for c in (s[: -len(self.v.end)] if end else s))
        return self.utf8.decode(raw + (b" " if end else b""))

    def surface(self, t: int) -> str:
        """Spelling of one more token, after a blank unless it is the first."""
        out = (" " if self.begun else "") + self.v.spelling[t]
        self.begun = True
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", True)


class Codec:
    """Whole texts through the transducer; each distinct word of a slice goes through once."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.machine = Transducer(self.v)
        self.many = Lockstep(self.v)
        self.text = TextMachine(self.v)
        self.cache = SpanCache(_CACHE_MOST)

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text, word by word through the streaming transducer."""
        out: list[int] = []
        for w in self.v.words(text):
            out.extend((w,) if isinstance(w, int) else self.machine.word(self.v.units(w)))
        return out

    def surface(self, ids: list[int]) -> str:
        """What decode() gives for the ids of one word, by the state machine."""
        self.text.begun = False
        return "".join([self.text.surface(t) for t in ids])

    def _chunks(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, surface) of white-space separated chunks; a word that several chunks hold is run once."""
        parts = [self.v.words(c) for c in b"\n".join(chunks).decode("utf-8", "replace").split("\n")]
        words = list({w for p in parts for w in p})
        todo = [w for w in words if not isinstance(w, int)]
        ids = dict(zip(todo, self.many.run(todo), strict=True)) | {w: [w] for w in words if isinstance(w, int)}
        both = {w: (array("I", t).tobytes(), self.surface(t).encode()) for w, t in ids.items()}
        return [both[p[0]] if len(p) == 1 else (b"".join([both[w][0] for w in p]), b" ".join([both[w][1] for w in p])) for p in parts]

    def documents(self, data: np.ndarray, bounds: np.ndarray):
        """(ids, surface) as bytes, document by document. Words never span white space, so chunks between it are encoded apart."""
        s = Spans(data, bounds)
        if not len(s):
            yield from [(b"", b"")] * (len(bounds) - 1)
            return
        keys, first, cls = distinct(s.hashes())
        gc.disable()  # many small objects, no cycles
        try:
            pairs = self.cache.resolve(keys, lambda new: self._chunks(s.bytes(first[new])))
        finally:
            gc.enable()
        ids, text, of, at = [p[0] for p in pairs], [p[1] for p in pairs], cls.tolist(), s.doc.tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = of[a:b]
            yield b"".join([ids[k] for k in own]), b" ".join([x for x in [text[k] for k in own] if x])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `full`, ids (binary, 32-bit) and decoded."""
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", "binary").add("decoded", "string") if full else schema

    def run(batches):
        c = codec(path)
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for lo, hi in slices(off, SLICE):
                n, ids_sha, text_sha, ids, text = [], [], [], [], []
                for i, t in c.documents(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    n.append(len(i) // 4)
                    ids_sha.append(hashlib.sha256(i).hexdigest())
                    text_sha.append(hashlib.sha256(t).hexdigest())
                    if full:
                        ids.append(i)
                        text.append(t.decode("utf-8"))
                cols = [b.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary()), pa.array(text, pa.string())] if full else []), names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: byte-level text of `ids` (binary, 32-bit) by the state machine. Words come back lower case, one blank after each."""
    schema = encoded.select("doc_id").schema.add("text", "string")

    def run(batches):
        c = codec(path)
        for b in batches:
            out = []
            for raw in b.column("ids").to_pylist():
                m = TextMachine(c.v)
                out.append("".join([m.text(t) for t in np.frombuffer(raw or b"", "<u4").tolist()]) + m.close())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers as p

    return p.path("word_bpe_49k.json")
