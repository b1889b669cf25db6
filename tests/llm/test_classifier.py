"""The Kneser-Ney model against its definition, and what the classifier catches."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.llm import kneser_ney, storage

DOCS = "doc_id long, lang string, text string"


class Brute:
    """Interpolated modified Kneser-Ney of order 3 by its definition."""

    def __init__(self, texts):
        three = Counter()
        for t in texts:
            w = ["<", "<", *t.split()]
            three.update(zip(w, w[1:], w[2:]))
        two = Counter((b, c) for _, b, c in three)
        one = Counter(c for _, c in two)
        self.size, self.orders = len(one), []
        for counts in (three, two, {(c,): n for c, n in one.items()}):
            of = Counter(counts.values())
            y = of[1] / max(of[1] + 2 * of[2], 1)
            cuts = [max(0.1, min(k - 0.05, k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0.5 * k)) for k in (1, 2, 3)]
            total, freed = defaultdict(int), defaultdict(float)
            for g, n in counts.items():
                total[g[:-1]] += n
                freed[g[:-1]] += cuts[min(n, 3) - 1]
            self.orders.append(({g: (n - cuts[min(n, 3) - 1]) / total[g[:-1]] for g, n in counts.items()}, {c: freed[c] / total[c] for c in total}))

    def lowest(self, word):
        shares, weights = self.orders[2]
        return shares.get((word,), 0.0) + weights[()] / (self.size + 1)

    def nats(self, text):
        w, out = ["<", "<", *text.split()], []
        for a, b, c in zip(w, w[1:], w[2:]):
            p = self.lowest(c)
            p = self.orders[1][0].get((b, c), 0.0) + self.orders[1][1].get((b,), 1.0) * p
            p = self.orders[0][0].get((a, b, c), 0.0) + self.orders[0][1].get((a, b), 1.0) * p
            out.append(-math.log(p))
        return out


def _texts(rng, n, words, least=5, most=90):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(least, most))) for _ in range(n)]


def test_scores_equal_the_definition(spark):
    storage.ready(spark)
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    good, bad, asked = _texts(rng, 40, words), _texts(rng, 12, words + ["vile"] * 40), _texts(rng, 30, [*words, "vile", "new"]) + ["", "one", " w1  w1\n"]
    rows = [(i, "en", t, False) for i, t in enumerate(good)] + [(i, "en" + kneser_ney._TOXIC, t, False) for i, t in enumerate(bad)]
    model = kneser_ney._sent(kneser_ney.train(spark.createDataFrame(rows, DOCS + ", held_out boolean")))
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(asked)] + [(99, "xx", "no model")], DOCS)
    one, two = Brute(good), Brute(bad)
    for r in kneser_ney._scored(frame, model).collect():
        if r.doc_id == 99:
            assert r.worst is None
            continue
        nats = one.nats(asked[r.doc_id])
        assert r.n_words == len(nats) and r.nats == pytest.approx(sum(nats), rel=1e-5)
        more = sorted((math.log(two.lowest(w) / one.lowest(w)) for w in asked[r.doc_id].split()), reverse=True)[:kneser_ney.WORST]
        assert r.worst is None if not more else r.worst == pytest.approx(np.mean(more), abs=1e-4)
        size, single = kneser_ney.WINDOW, [-math.log(one.lowest(w)) for w in asked[r.doc_id].split()]
        means = [sum(single[i:i + size]) / size for i in range(len(single) - size + 1)]
        assert (r.high, r.low) == ((pytest.approx(max(means), abs=1e-4), pytest.approx(min(means), abs=1e-4)) if means else (None, None))


def test_catches_toxic_and_repeated_text_and_leaves_clean_text(spark):
    storage.ready(spark)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    insults = [f"vile{i}" for i in range(8)]
    rows, labels, want = [], [], {}
    for lang in ("en", None):
        for i, t in enumerate(_texts(rng, 500, words, 40, 200)):
            i += 10_000 * (lang is None)
            w = t.split()
            kind = ("toxic" if i % 5 == 0 else "again" if i % 11 == 0 else "clean")
            if kind == "toxic":
                for _ in range(5):
                    w[rng.randrange(len(w))] = rng.choice(insults)
            elif kind == "again":
                w = w[:3] + [f"own{i}"] * 150
            rows.append((i, lang, " ".join(w)))
            want[i] = kind
            if i % 3:
                labels.append((i, int(kind != "again"), int(kind == "toxic")))
    found = kneser_ney.perplexities(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {k: [r.kept for r in found if want[r.doc_id] == k] for k in ("clean", "toxic", "again")}
    assert len(found) == len(rows) and np.mean(kept["clean"]) >= 0.97 and np.mean(kept["toxic"]) <= 0.05 and np.mean(kept["again"]) <= 0.05


def test_without_toxic_labels_no_word_is_bad(spark):
    storage.ready(spark)
    rng = random.Random(9)
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(_texts(rng, 60, ["a", "b", "c", "d"]))], DOCS)
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    rows = kneser_ney.perplexities(frame, labels).collect()
    assert all(r.worst is None for r in rows) and np.mean([r.kept for r in rows]) > 0.9


def test_all_trusted_and_toxic_text_counts(spark, monkeypatch):
    """More documents and words than the sample's bounds: each trains or sets bounds, with its whole text, and any dealing gives the same scores."""
    storage.ready(spark)
    rng = random.Random(10)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    rows = [(i, ("en", None)[i % 2], t) for i, t in enumerate(_texts(rng, 300, words))] + [(300, "en", " ".join(words * 40))]
    frame = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(301)], "doc_id long, quality int, toxic int")
    for name, bound in (("SAMPLE_DOCS", 20), ("TRAIN_WORDS", 100), ("ALL_WORDS", 100), ("TOXIC_WORDS", 50), ("ALL_TOXIC_WORDS", 50)):
        monkeypatch.setattr(kneser_ney, name, bound)
    got = kneser_ney.labelled(frame, labels).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, _, t in rows} and len(got) == len(rows)
    held = Counter((r.lang, r.held_out) for r in got if r.doc_id % 10)
    assert held == {("en", True): 60, ("en", False): 60, (None, True): 75, (None, False): 75}
    assert not any(r.held_out for r in got if r.doc_id % 10 == 0)
    once = {r.doc_id: (r.perplexity, r.threshold, r.worst, r.kept) for r in kneser_ney.perplexities(frame, labels).collect()}
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(kneser_ney, "SHARD_GRAMS", 500)
    again = {r.doc_id: (r.perplexity, r.threshold, r.worst, r.kept) for r in kneser_ney.perplexities(frame, labels).collect()}
    assert once.keys() == again.keys()
    for i, (p, t, w, k) in once.items():
        assert again[i] == (pytest.approx(p, rel=1e-6), pytest.approx(t, rel=1e-6), w if w is None else pytest.approx(w, abs=1e-5), k)


def test_passes_do_not_change_scores(spark, monkeypatch):
    """Counting and scoring in parts gives what one part gives, and nothing of the parts stays behind."""
    storage.ready(spark)
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(150)]
    frame = spark.createDataFrame([(i, ("en", None)[i % 2], t) for i, t in enumerate(_texts(rng, 80, words))] + [(80, None, None), (81, "xx", "")], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    before = {t.name for t in spark.catalog.listTables()}
    once = {r.doc_id: r for r in kneser_ney.perplexities(frame, labels).collect()}
    for name, value in (("PASSES", 3), ("SCORE_PASSES", 3), ("PASS_BYTES", 500), ("PASS_BLOCKS", 2), ("SHARD_GRAMS", 2000)):
        monkeypatch.setattr(kneser_ney, name, value)
    again = {r.doc_id: r for r in kneser_ney.perplexities(frame, labels).collect()}
    assert once.keys() == again.keys() == set(range(82))
    for i, a in once.items():
        b = again[i]
        assert (a.lang, a.n_words, a.kept) == (b.lang, b.n_words, b.kept)
        for name in ("perplexity", "threshold", "high", "low", "worst"):
            assert b[name] is None if a[name] is None else b[name] == pytest.approx(a[name], rel=1e-6, abs=1e-6)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_shuffle_files_of_a_stored_table_go(spark):
    storage.ready(spark)

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in every.split() if "/shuffle_" in f}

    before, set_to = files(), spark.conf.get(storage.RELEASE, None)
    table = storage.stored(spark.range(0, 5000, 1, 3).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    assert not files() - before and spark.conf.get(storage.RELEASE, None) == set_to
    assert table.count() == 97


def test_model_is_packed(spark):
    """Less than ten bytes an n-gram on disk, of which eight are its hash: the shuffles and tables of the model are what fills the disk."""
    storage.ready(spark)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(200)]
    chosen = spark.createDataFrame([(i, "en", t, False) for i, t in enumerate(texts)], DOCS + ", held_out boolean")
    trained = kneser_ney.train(chosen)
    rows = trained.model.rows() if hasattr(trained, "model") else trained.rows()
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(rows.inputFiles()[0]).getParent()
    size = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()
    grams = set()
    for t in texts:
        w = ["<", "<", *t.split()]
        for n in (1, 2, 3):
            grams |= set(zip(*(w[i:] for i in range(n))))
    contexts = {g[:-1] for g in grams if len(g) > 1}
    assert size / (len(grams) + len(contexts)) < 10


def test_packed_numbers_come_back():
    for x in (np.array([], np.uint64), np.array([0, 1, 2 ** 40, 2 ** 64 - 1], np.uint64), np.array([3, 7, 2 ** 32 - 1], np.uint32)):
        assert kneser_ney._rising(kneser_ney._steps(x), x.dtype).tolist() == x.tolist() == kneser_ney._numbers(kneser_ney._planes(x), x.dtype).tolist()


def test_training_texts_are_gone_before_bigrams(spark, monkeypatch):
    """No n-grams of a lower order are shuffled or stored beside the texts, and four passes each shuffle a part of the trigrams."""
    storage.ready(spark)
    rng, did = random.Random(5), []
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(_texts(rng, 60, [f"w{i}" for i in range(90)]))], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    chosen = storage.stored(kneser_ney.labelled(frame, labels), "chosen")

    def store(df, name):
        did.append(name)
        return storage.stored(df, name)

    def remove(df):
        did.append("discard chosen" if df is chosen else "discard")
        storage.discard(df)
    monkeypatch.setattr(kneser_ney, "stored", store)
    monkeypatch.setattr(kneser_ney, "discard", remove)
    monkeypatch.setattr(kneser_ney, "PASS_BYTES", 500)
    trained = kneser_ney.train(chosen, 10_000)
    trained.discard()
    assert did[:9] == ["trigrams"] * 4 + ["discard chosen"] + ["bigrams"] * 4
