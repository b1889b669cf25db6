"""Spelling variants against a brute-force version, and on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

from wardlens.llm import queries, spelling, storage

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(n):
    """By the words with one character left out, each pair checked."""
    shared = defaultdict(set)
    for w in n:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shared[x].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if a != b and b not in near[a] and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(counted(rows))
    assert sum(x[0] is not None for x in want.values()) > 20
    assert found(queries.op12_spelling_variants(spark, SF)) == want


def test_alike_words_of_all_lengths(spark):
    """Few letters, so grams are frequent, lists long and near words many; words about and beyond the length of halves; chains of forms."""
    storage.ready(spark)
    rng = random.Random(4)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(5, 9))) for _ in range(1500)}
    for size in (spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, 80):
        for _ in range(4):
            w = "".join(rng.choice("abc") for _ in range(size))
            words.add(w)
            for _ in range(12):
                i = rng.randrange(size)
                words |= {w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w + "q", "q" + w}
    n = {w: rng.choice([3, 4, 6, 9, 20, 50, 200]) for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    frequent = spelling.dictionary(frame)
    assert len(frequent) > 100 and max(map(len, frequent)) == spelling.LONGEST_GRAM
    pairs = {(r.word, r.other) for r in spelling.near_pairs(frame).collect()}
    want = {(max(a, b, key=lambda x: (len(x), x)), min(a, b, key=lambda x: (len(x), x))) for a in n for b in n if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert pairs == want and len(want) > 2000


def test_two_grams_lie_apart():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(5, 14)))
        sizes = {word[i:j]: rng.randint(1, 99) for i in range(len(word)) for j in range(i + 2, len(word) + 1) if rng.random() < 0.6}
        own = list(spelling.grams_for(word, len(word), sizes))
        (a, i), (b, j) = spelling.two_apart(own, sizes)
        cost = min(sizes.get(x, 0) + sizes.get(y, 0) for x, p in own for y, q in own if p + len(x) <= q)
        assert i + len(a) <= j and sizes.get(a, 0) + sizes.get(b, 0) == cost


def test_odd_rows(spark):
    storage.ready(spark)
    texts = [(None, None), (1, ""), (2, " \n"), (3, "Colour COLOUR colour, colour colour colour"), (4, "color color color"), (4, "color color color"), (None, "colr colr colr colour"),
             (5, "x" * 20_000 + " " + "x" * 20_000), (6, "x" * 20_000 + " ÉCLAIR éclair Éclair"), (7, "y" * 999 + " ") , (8, "colours colours colours")]
    frame = spark.createDataFrame([(i, t, "w", 7) for i, t in texts], "doc_id long, text string, word string, n int")
    want = brute(counted(texts))
    assert found(spelling.variants(frame)) == want and "x" * 20_000 in want and want["colour"][3] == 2
    assert spelling.variants(frame.limit(0)).count() == 0
    assert spelling.variants(frame.where("doc_id = 8")).count() <= 1
