"""Cross-tokenizer alignment against the libraries, text by text."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from pricelattice.llm import alignment, plans
from pricelattice.llm.codec import byte_alphabet

SF = "/root/testdata/sf0.001"


def brute(texts: list[str | None]):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, from whole-text encodings and sets of end offsets."""
    a_path, b_path = alignment.paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    own = {c: x for x, c in enumerate(byte_alphabet())}
    spelling = {i: s for s, i in a.get_vocab().items()}
    held, links, said = Counter(), [], []
    for text in texts:
        mine, shown, n = Counter(), [], (0, 0)
        if text:
            ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            raw = ([bytes(own[c] for c in spelling[i]) for i in ids[0]], [])
            for i in ids[1]:
                p = b.id_to_piece(i)
                raw[1].append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F][0-9A-F]>", p) else p.replace("▁", " ").encode())
            if all(b"".join(x) == (" " + text).encode() for x in raw):
                ends, n = [], (len(ids[0]), len(ids[1]))
                for x in raw:
                    at, own_ends = 0, []
                    for t in x:
                        at += len(t)
                        own_ends.append(at)
                    ends.append(own_ends)
                i = j = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
                    for s in ids[0][i:x]:
                        for t in ids[1][j:y]:
                            mine[s, t] += 1
                    shown.append(f"{','.join(map(str, ids[0][i:x]))}|{','.join(map(str, ids[1][j:y]))}")
                    i, j = x, y
        held.update(mine.keys())
        links.append(mine)
        said.append((*n, len(shown), ";".join(shown)))
    top = defaultdict(int)
    for (s, _), k in held.items():
        top[s] = max(top[s], k)
    out = []
    for mine, (na, nb, ng, shown) in zip(links, said, strict=True):
        out.append((na, nb, ng, sum(mine.values()), sum(k for p, k in mine.items() if held[p] == top[p[0]]), sum(k * held[p] for p, k in mine.items()), shown))
    return out


def rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def wanted(ids, texts):
    return {i: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[0] else "") for i, x in zip(ids, brute(texts), strict=True)}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows(plans.op12_byte_labels(spark, SF)) == wanted([r.doc_id for r in docs], [r.text for r in docs])


def test_awkward_texts_and_white_space(spark):
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\t", " \n ", " ", "　", " ", "\u0085", " ", " ", " ", " ", "\x1c", "᠎", "​"]
    words = ["é", "naïve", "«quoted»", "“x”", "—", "12", "don't", "日本語", "🎈🎈", "<|endoftext|>", "<s>", "<0x41>", "a" * 300, "x\x00y", "ﬁ", "½", "é", "__", "...", "à", "Ġ"]
    texts = [None, "", " ", "\n", "a▁b", "▁", "same words here", "same words here", "a" * 3000] + ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += [rng.choice(blanks) + rng.choice(words) + " " + rng.choice(blanks) + " " + rng.choice(words) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = alignment.align(d, alignment.paths())
    assert rows(got) == wanted(range(len(texts)), texts)
    by = {r.doc_id: r.groups for r in got.collect()}
    assert [by[i] for i in range(len(texts))] == [x[6] for x in brute(texts)]


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, pair bigint, count bigint, n_a string, __pl_slice int"
    d = spark.createDataFrame([(None, "the cat", 1, 1, "x", 1), (None, "the cat", 1, 1, "x", 1), (3, "the dog", 2, 2, "y", 2), (3, None, 2, 2, None, None)], schema)
    got = sorted(((r.doc_id, r.n_links, r.count_sum) for r in alignment.align(d, alignment.paths()).collect()), key=str)
    assert got == [(3, 0, 0), (3, 2, 4), (None, 2, 5), (None, 2, 5)]
    assert alignment.align(d.limit(0), alignment.paths()).count() == 0


def test_groups_from_labels():
    label = alignment.labels(np.array([2, 5]), np.array([1, 5]), 5)
    assert label.tobytes() == b"ba..x"
    na, nb = alignment.groups(np.frombuffer(b"ba..x.x", np.uint8))
    assert (na.tolist(), nb.tolist()) == ([2, 1], [2, 1])


def test_links_of_large_groups(monkeypatch):
    ids, n = (np.array([7, 7, 8, 9, 7]), np.array([1, 2, 1, 3, 3, 3])), (np.array([1, 3, 1]), np.array([2, 3, 1]))
    plain = alignment._links(ids, *n)
    monkeypatch.setattr(alignment, "MANY", 1)
    few = alignment._links(ids, *n)
    total = lambda x: sorted((int(g), int(k), int(x[1][(x[0] == k) & (x[2] == g)].sum())) for g, k in {*zip(x[2].tolist(), x[0].tolist())})
    assert total(plain) == total(few) and (np.diff(few[2]) >= 0).all()
