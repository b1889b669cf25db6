"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Each language has its own model, trained on every other one of the documents
that the labels call good, and its own threshold, a quantile of the
perplexity of the rest of them.  The counts, the continuation counts, the
discounts and the weights are sums on n-gram hashes.  What comes
out, one number for each n-gram and each context, grows with the corpus and
stays distributed: n-grams go to the shard of the hash space that their context
lies in, packed into a row for each task and shard, and are counted there; the
text to be scored is dealt to blocks, each block asks the shards for its distinct
n-grams, and a shard answers with the numbers of those that the model has.

A sparse fault hardly moves the perplexity of a whole text, so each document
also has the highest and the lowest mean surprise of a window of words, which
tell runs of repeated words, and its worst words: those that a second model
of the same kind, of text labelled toxic, expects the most against the model
of trusted text.  Of both the lowest order is held against each other, which
counts the different words that a word follows: an insult follows many, the
words of a passage that was copied follow one.  Quantiles of the trusted
documents bound all of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.storage import Buckets, discard, give_back, small_enough, stored
from wardlens.llm.text_hash import U64, gram_hashes, mix, slices
from wardlens.operators.order_stats import percentiles_of_counts
from wardlens.operators.ranks import value_ranks

ORDER = 3
#: Text of a block, and n-grams that a shard holds, about; n-grams that a task collects before it deals them to the shards.
BLOCK_BYTES, SHARD_GRAMS, DEALT_GRAMS = 16 << 20, 3_000_000, 1_000_000
#: The n-grams are counted in so many passes, each of a part of the hash space, and the text is scored in so many, each of a part of the
#: blocks; what a pass has shuffled is gone before the next one.  Text of a pass, at least; and blocks of one, where they can be smaller.
PASSES, SCORE_PASSES, PASS_BYTES, PASS_BLOCKS = 4, 12, 1 << 20, 12
#: The bounds of ``sample``: so many trusted documents of a language, the first by a hash of doc_id.  Every other one sets the threshold;
SAMPLE_DOCS = 3000
#: the others train the model, as many of them as hold so many words,
TRAIN_WORDS = 250_000
#: or an equal share of this where the languages are many.
ALL_WORDS = 1_000_000
#: A document trains with no more than its first words up to this part of its language's bound, so that no few documents fill it.
PART = 50
#: A document is kept up to this quantile of the held-out perplexities of its language, times the slack.
QUANTILE = 0.99
SLACK = 1.25
#: So many words at the language's mean count towards each perplexity, lest a few words decide.
PRIOR_WORDS = 20

#: Words of a window, the quantile up to which (or, for the least, down to which) a document is kept, and the slack in nats a word.
WINDOW, WINDOW_QUANTILE, WINDOW_SLACK = 32, 0.995, 0.5
#: The bounds on the words of toxic text that train its model, for a language and in all; how many worst words count, as a rare word may be
#: toxic by chance; the quantile of their mean in trusted text, and the slack.
TOXIC_WORDS, ALL_TOXIC_WORDS = 60_000, 240_000
WORST, TOXIC_QUANTILE, TOXIC_SLACK = 3, 0.995, 0.3
#: What is added to a language's name to name its model of toxic text.
_TOXIC = "\x01toxic"
#: A bound on a part is this many deviations from the mean of the trusted documents at least, lest a few of them decide.
DEVIATIONS = 4.0

_BEFORE = U64(0x5851F42D4C957F2D)
_SALT = 0xA24BAED4963EE407
_LAST = U64(0x9E3779B97F4A7C15)


def _salt(lang: str | None) -> np.uint64:
    h = 0
    for c in ("\x00" if lang is None else lang).encode():
        h = (h * 257 + c + 1) % (1 << 64)
    return U64((h * _SALT + 0x9FB21C651E98DF25) % (1 << 64))


def _pair(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of the n-gram of a context, by its hash, and the word after it."""
    return mix(contexts + words * _LAST)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash, rising with it."""
    return ((keys >> U64(32)) * U64(shards)) >> U64(32)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, as codecs make the most of."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    """What ``_planes`` wrote."""
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def _steps(rising: np.ndarray) -> bytes:
    return _planes(np.diff(rising, prepend=rising.dtype.type(0)))


def _rising(data: bytes, kind) -> np.ndarray:
    """What ``_steps`` wrote."""
    return np.cumsum(_numbers(data, kind), dtype=kind)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted columns a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _toxic_name():
    """The name under which the toxic text of a language is a language of its own."""
    return F.concat(F.coalesce("lang", F.lit("\x00")), F.lit(_TOXIC))


def _is_toxic():
    return F.coalesce(F.endswith("lang", F.lit(_TOXIC)), F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, h)`` of all trusted and toxic documents, the latter under ``_toxic_name``; h a hash of doc_id.

    Trusted are those whose labels are all of quality 1 and not toxic, toxic
    those with any label that says so.
    """
    bad = F.coalesce("toxic", F.lit(0)) != 0
    fits = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.coalesce((F.col("quality") == 1) & ~bad, F.lit(False))).alias("good"), F.max(bad).alias("bad")) \
        .where("(good or bad) and doc_id is not null").select("doc_id", "bad")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(fits, "doc_id") \
        .dropDuplicates(["doc_id"]).select("doc_id", F.when(F.col("bad"), _toxic_name()).otherwise(F.col("lang")).alias("lang"), F.xxhash64("doc_id").alias("h"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, text, held_out)``: all trusted and all toxic documents with their whole texts, every other one of the trusted held out."""
    ids = _labelled(docs, labels)
    # The ranks come from ranges of the hash, so no task ranks a language; a null one has a name meanwhile.
    ranks = value_ranks(ids.select(F.coalesce("lang", F.lit("\x00")).alias("of"), "h", F.lit(1).alias("cnt")), "h", keys=["of"])
    held_out = ~F.endswith("of", F.lit(_TOXIC)) & (F.col("rank") % 2 == 0)
    chosen = stored(ids.join(ranks.select("h", held_out.alias("held_out")), "h").select("doc_id", "lang", "held_out"), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen) if small_enough(chosen, 32) else chosen, "doc_id").dropDuplicates(["doc_id"]) \
        .select("doc_id", "lang", "text", "held_out")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``labelled``, but bounded samples, for a trial on a part of a corpus; the classifier itself takes all.

    The first ranks are taken within
    shards of a language, so no task sees more than a shard of it.  Texts that
    train are cut after a fiftieth of the bound on words; held-out ones, every
    other one of the trusted, are whole.
    """
    ids = _labelled(docs, labels)
    shard = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    first = ids.withColumn("r", F.row_number().over(shard)).where(F.col("r") <= SAMPLE_DOCS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = stored(first.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS).select("doc_id", "r", "lang"), "sampled")
    groups = chosen.select("lang").distinct().agg(F.count_if(~_is_toxic()), F.count_if(_is_toxic())).first()
    trusted, toxic = (max(1, min(most, of_all // max(1, n))) for most, of_all, n in ((TRAIN_WORDS, ALL_WORDS, groups[0]), (TOXIC_WORDS, ALL_TOXIC_WORDS, groups[1])))
    bound = F.when(_is_toxic(), F.lit(toxic)).otherwise(F.lit(trusted))
    longest = F.greatest(F.lit(1), F.floor(bound / PART)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen) if small_enough(chosen, 32) else chosen, "doc_id").dropDuplicates(["doc_id"])
    held_out = ~_is_toxic() & (F.col("r") % 2 == 0)
    words = F.split(F.regexp_replace("text", r"^[ \t-\r]+|[ \t-\r]+$", ""), r"[ \t-\r]+")
    total = F.sum(F.when(~held_out, F.least(F.size(words), longest)).otherwise(0)).over(Window.partitionBy("lang").orderBy("r"))
    cut = F.when(~held_out & (F.size(words) > longest), F.array_join(F.slice(words, F.lit(1), longest), " ")).otherwise(F.col("text"))
    return rows.withColumn("total", total).where(held_out | (F.col("total") <= bound)) \
        .select("doc_id", "lang", cut.alias("text"), held_out.alias("held_out"))


#: The columns of n-grams that are dealt to shards: the hashes of the context, of its last word and of the word after it, the number of
#: the language, how often.
_GRAM = {"context": np.uint64, "middle": np.uint64, "last": np.uint64, "code": np.uint32, "n": np.uint64}
_COUNTED = "shard long, context binary, size binary, middle binary, code binary, last binary, n binary, " \
    "stats array<struct<code:int,n1:long,n2:long,n3:long,n4:long,total:long,size:long>>"


def _dealt(found: Iterable[dict[str, np.ndarray]], by: str, shards: int) -> Iterator[pa.RecordBatch]:
    """N-grams of ``_GRAM`` -> a row for each shard by the hash in the column ``by``."""
    held, rows = [], 0

    def flush() -> pa.RecordBatch:
        cols = {name: np.concatenate([h[name] for h in held]).astype(kind, copy=False) for name, kind in _GRAM.items()}
        order = np.argsort(cols[by])
        cols = {name: c[order] for name, c in cols.items()}
        if by == "last":
            first = _heads(cols["last"])
            cols = {name: np.add.reduceat(c, first) if name == "n" else c[first] for name, c in cols.items()}
        shard = _shard(cols[by], shards).astype(np.int64)
        first = _heads(shard)
        bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(shard[first]), *(pa.array([_planes(c[i:j]) for i, j in bounds], pa.binary()) for c in cols.values())],
                                          names=["shard", *cols])
    for grams in found:
        held.append(grams)
        rows += len(grams["last"])
        if rows >= DEALT_GRAMS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()
    held = []
    give_back()


def _counted(rows: DataFrame) -> DataFrame:
    """Dealt n-grams -> a row for each shard: its contexts, rising, with the last word of each and how many words follow it, these words, how often, and sums for each language."""
    def count(table: pa.Table) -> pa.Table:
        cols = {name: np.concatenate([_numbers(x, kind) for x in table.column(name).to_pylist()]) for name, kind in _GRAM.items()}
        order = np.lexsort((cols["last"], cols["context"]))
        cols = {name: c[order] for name, c in cols.items()}
        first = _heads(cols["context"], cols["last"])
        n = np.add.reduceat(cols["n"], first)
        cols = {name: c[first] for name, c in cols.items()}
        head = _heads(cols["context"])
        codes, of = np.unique(cols["code"], return_inverse=True)
        sums = {"code": codes.astype(np.int32), **{f"n{k}": np.bincount(of, n == k).astype(np.int64) for k in (1, 2, 3, 4)},
                "total": np.bincount(of, n).astype(np.int64), "size": np.bincount(of)}
        stats = pa.StructArray.from_arrays([pa.array(x) for x in sums.values()], list(sums))
        out = {"context": _steps(cols["context"][head]), "size": _planes(np.diff(head, append=len(n)).astype(np.uint32)), "middle": _planes(cols["middle"][head]),
               "code": _planes(cols["code"][head]), "last": _planes(cols["last"]), "n": _planes(n)}
        return pa.table([table.column("shard").slice(0, 1), *(pa.array([v], pa.binary()) for v in out.values()),
                         pa.ListArray.from_arrays(pa.array([0, len(stats)], pa.int32()), stats)], names=["shard", *out, "stats"])
    return rows.groupBy("shard").applyInArrow(count, _COUNTED)


_DEALT = "shard long, " + ", ".join(f"{name} binary" for name in _GRAM)


def _trigrams(texts: DataFrame, codes: dict[str | None, int], shards: int, part: int, parts: int) -> DataFrame:
    """The n-grams of the highest order, counted, the start of a text being padded; of ``parts`` parts of the words in the middle, those of the given one."""
    def found(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for slice_ in slices(batch.column("text"), lower=False):
                own, n = langs[slice_.first:slice_.first + len(slice_)], np.diff(slice_.bounds)
                padded, places = Model.padded(slice_.words, np.array([_salt(x) for x in own], U64), n)
                one = gram_hashes(padded, 1)
                middle = one[places - 1]
                at = np.flatnonzero((middle >> U64(20)) % U64(parts) == part)
                yield {"context": gram_hashes(padded, 2)[places - 2][at], "middle": middle[at], "last": one[places][at],
                       "code": np.repeat(np.array([codes[x] for x in own], np.uint32), n)[at], "n": np.ones(len(at), np.uint64)}
    return _counted(texts.select("lang", "text").mapInArrow(lambda batches: _dealt(found(batches), "context", shards), _DEALT))


def _shorter(counted: DataFrame, shards: int, order: int) -> DataFrame:
    """Counted n-grams of the order above -> those without the first word, by how many words it is; all of a context, or none, are in ``counted``."""
    def found(batches):
        for batch in batches:
            for size, middle, code, last in zip(*(batch.column(c).to_pylist() for c in ("size", "middle", "code", "last")), strict=True):
                size, last = _numbers(size, np.uint32), _numbers(last, np.uint64)
                code = np.repeat(_numbers(code, np.uint32), size)
                # The context of single words is that of their language.
                context = np.repeat(_numbers(middle, np.uint64), size) if order == 2 else code.astype(np.uint64)
                yield {"context": context, "middle": np.zeros(len(last), np.uint64), "last": last, "code": code, "n": np.ones(len(last), np.uint64)}
    by = "context" if order == 2 else "last"
    return _counted(counted.select("size", "middle", "code", "last").mapInArrow(lambda batches: _dealt(found(batches), by, shards), _DEALT))


def _sums(counted: DataFrame) -> dict[int, dict[str, int]]:
    """For each language, by its number, how many n-grams occur 1 to 4 times, how many there are and how often all occur."""
    rows = counted.select(F.explode("stats").alias("s")).select("s.*")
    return {r["code"]: r.asDict() for r in rows.groupBy("code").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "code"]).collect()}


def _cuts(sums: dict[str, int]) -> list[float]:
    """The discounts of the n-grams of an order in a language that occur once, twice and more often."""
    y = sums["n1"] / max(sums["n1"] + 2 * sums["n2"], 1)
    steps = [k - (k + 1) * y * sums[f"n{k + 1}"] / sums[f"n{k}"] if sums[f"n{k}"] else 0.5 * k for k in (1, 2, 3)]
    return [max(0.1, min(k - 0.05, step)) for k, step in zip((1, 2, 3), steps, strict=True)]


def _weights(counted: DataFrame, order: int, sums: dict[int, dict[str, int]], toxic: np.ndarray) -> DataFrame:
    """Counted n-grams of an order -> ``(shard, kind, grams, numbers)``: hashes, rising, with the discounted shares of n-grams and the weights of the order below by contexts."""
    cuts, totals = np.zeros((len(toxic), 3)), np.ones(len(toxic))
    for code, own in sums.items():
        cuts[code], totals[code] = _cuts(own), own["total"]

    def run(batches):
        for batch in batches:
            rows = []
            for shard, *data in zip(*(batch.column(c).to_pylist() for c in ("shard", "context", "size", "code", "last", "n")), strict=True):
                context, size, code, last, n = _rising(data[0], np.uint64), *(_numbers(x, k) for x, k in zip(data[1:], (np.uint32, np.uint32, np.uint64, np.uint64), strict=True))
                each = np.repeat(code, size)
                cut = cuts[each, np.minimum(n, 3).astype(np.int64) - 1]
                if order == 1:
                    found = [(1, last, (n - cut) / totals[each])]
                else:
                    heads = np.cumsum(size, dtype=np.int64) - size
                    total, freed = np.add.reduceat(n, heads), np.add.reduceat(cut, heads)
                    # Of toxic text the lowest order is all that is asked for.
                    clean, own = ~toxic[each], ~toxic[code]
                    found = [(order, _pair(np.repeat(context, size), last)[clean], ((n - cut) / np.repeat(total, size))[clean]), (9 + order, context[own], (freed / total)[own])]
                for kind, grams, numbers in found:
                    by = np.argsort(grams)
                    rows.append((shard, kind, _steps(grams[by]), _planes(numbers[by].astype(np.float32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["shard", "kind", "grams", "numbers"])
    return counted.select("shard", "context", "size", "code", "last", "n").mapInArrow(run, "shard long, kind int, grams binary, numbers binary")


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def train(chosen: DataFrame, n_bytes: int = 0) -> Trained:
    """The model of all languages, of kinds 1 to 3 the shares of an order, 11 and 12 the weights of contexts of so many words.
    Of toxic text the lowest order is all that is asked for.  The rows are those of ``_weights``, a bucket a shard, so that no pass of
    scoring shuffles them.  ``n_bytes`` of text are going to be scored."""
    texts = chosen.where("not held_out").select("lang", "text")
    langs = [r["lang"] for r in texts.select("lang").distinct().collect()]
    codes, toxic = {x: i for i, x in enumerate(langs)}, np.array([x is not None and x.endswith(_TOXIC) for x in langs], bool)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, parts = max(1, -(-(n_bytes + 4 * size) // 8 // SHARD_GRAMS)), max(1, min(PASSES, size // PASS_BYTES))
    model = Buckets(chosen.sparkSession, "model", "shard", shards)
    # The texts are gone before the n-grams of the lower orders come.
    three = [stored(_trigrams(texts, codes, shards, part, parts), "trigrams") for part in range(parts)]
    discard(chosen)
    two = [stored(_shorter(rows, shards, 2), "bigrams") for rows in three]
    one = stored(_shorter(_together(two), shards, 1), "unigrams")
    for order, counted in ((1, [one]), (2, two), (3, three)):
        sums = _sums(_together(counted))
        if order == 1:
            sizes = {langs[code]: (x["size"], sum(n * d for n, d in zip((x["n1"], x["n2"], x["size"] - x["n1"] - x["n2"]), _cuts(x), strict=True)) / x["total"])
                     for code, x in sums.items()}
        # The parts of an order go to the model and are removed one by one.
        for rows in counted:
            model.add(_weights(rows, order, sums, toxic))
            discard(rows)
    return Trained(model, sizes)


@dataclass
class Trained:
    """A model: its rows, and for each language the size of the vocabulary and the weight below single words."""

    model: Buckets
    sizes: dict[str | None, tuple[int, float]]

    def discard(self) -> None:
        self.model.discard()


class Table:
    """A hash -> float32 table in sorted open addressing: the shard of a key is its highest bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        self.shift = U64(64 - max(4, int(len(keys) * 2).bit_length()))
        home = (keys >> self.shift).astype(np.int64)
        at = np.maximum.accumulate(home - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else home
        size = max((1 << (64 - int(self.shift))), int(at[-1]) + 1 if len(at) else 0) + 1
        self.keys, self.values = np.zeros(size, U64), np.zeros(size, np.float32)
        self.keys[at], self.values[at] = keys, values

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, np.float32)
        rest, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(rest):
            there = self.keys[at]
            want = keys[rest]
            same = there == want
            out[rest[same]] = self.values[at[same]]
            on = (there != 0) & ~same & (there < want)
            rest, at = rest[on], at[on] + 1
        return out


@dataclass
class Sent:
    """A model as ``_scored`` wants it: its rows, of how many shards, and the numbers of whole languages."""

    rows: DataFrame
    shards: int
    sizes: dict[str | None, tuple[int, float]]


def _sent(trained: Trained) -> Sent:
    return Sent(trained.model.rows(), trained.model.n, trained.sizes)


class Model:
    """The tables of the n-grams of a block of text, in all its languages and their toxic text."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], sizes: dict[str | None, tuple[int, float]]):
        none = Table(np.zeros(0, U64), np.zeros(0, np.float32))
        self.tables = {k: none for k in (1, 2, 3, 11, 12)} | {k: Table(*v) for k, v in tables.items()}
        self.sizes = sizes

    @staticmethod
    def padded(words: np.ndarray, salts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The salted words of documents of ``n`` words, two words of padding before each so that every word has a whole context, and where they are."""
        padded = np.repeat(_BEFORE ^ salts, n + 2)
        places = np.arange(len(words)) + 2 * (np.repeat(np.arange(len(n)), n) + 1)
        padded[places] = mix(words ^ np.repeat(salts, n))
        return padded, places

    @classmethod
    def asked(cls, words: np.ndarray, langs: list[str | None], n: np.ndarray, lowest: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By kind the hashes that ``surprise`` looks up, after those that their shards follow from; single words stand for kind 11 too."""
        padded, places = cls.padded(words, np.array([_salt(x) for x in langs], U64), n)
        one = gram_hashes(padded, 1)
        if lowest:
            return {1: (one[places], one[places])}
        context, before, last = gram_hashes(padded, 2)[places - 2], one[places - 1], one[places]
        return {1: (one, one), 2: (before, _pair(before, last)), 12: (context, context), 3: (context, _pair(context, last))}

    def surprise(self, words: np.ndarray, langs: list[str | None], n: np.ndarray, lowest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The negative log probability of each word of documents of ``n`` words, the same by the lowest order only, and which documents have a model.

        With ``lowest`` the first is the second."""
        t = self.tables
        salts = np.array([_salt(x) for x in langs], U64)
        size, weight = np.array([self.sizes.get(x, (0, 1.0)) for x in langs], np.float32).reshape(-1, 2).T
        below = weight / (size + 1)
        padded, places = self.padded(words, salts, n)
        one = gram_hashes(padded, 1)
        last = one[places]
        p = single = np.repeat(below, n) + t[1].get(last, 0.0)
        if not lowest:
            before, context = one[places - 1], gram_hashes(padded, 2)[places - 2]
            p = t[11].get(before, 1.0) * p + t[2].get(_pair(before, last), 0.0)
            p = t[12].get(context, 1.0) * p + t[3].get(_pair(context, last), 0.0)
        return *(-np.log(np.maximum(x.astype(np.float64), 1e-30)) for x in (p, single)), size > 0


def _extremes(sums: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the lowest mean of a window within each document; NaN in documents shorter than one."""
    means = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW if len(sums) > WINDOW else np.zeros(0)
    long = np.flatnonzero(np.diff(bounds) >= WINDOW)
    high, low = (np.full(len(bounds) - 1, np.nan) for _ in range(2))
    if len(long):
        # Windows of one document lie between its first word and the last at which one fits; those between documents are cut out.
        edges = np.stack((bounds[long], bounds[long + 1] - WINDOW + 1), 1).ravel()
        means = np.append(means, 0.0)
        high[long], low[long] = np.maximum.reduceat(means, edges)[::2], np.minimum.reduceat(means, edges)[::2]
    return high, low


def _worst(more: np.ndarray) -> float:
    """The mean of the ``WORST`` largest values, or of all if there are fewer."""
    return float((np.partition(more, -WORST)[-WORST:] if len(more) > WORST else more).mean())


def _toxic_names(langs: list[str | None]) -> list[str]:
    return [("\x00" if x is None else x) + _TOXIC for x in langs]


def _answers(dealt: DataFrame, sent: Sent) -> DataFrame:
    """``(kn_block, kind, grams, numbers)``: what the model has of the n-grams of each block.

    A block asks by the upper halves of the hashes, which lie close and pack well;
    the answer has whole hashes, so those that share a half only are told apart.
    """
    shards = sent.shards

    def ask(table: pa.Table) -> pa.Table:
        langs, block, found = table.column("lang").to_pylist(), table.column("kn_block")[0].as_py(), {k: [np.zeros(0, U64)] for k in (1, 2, 3, 12)}
        for part in slices(table.column("text"), lower=False):
            n, own = np.diff(part.bounds), langs[part.first:part.first + len(part)]
            for asked in (Model.asked(part.words, own, n), Model.asked(part.words, _toxic_names(own), n, lowest=True)):
                for kind, (by, keys) in asked.items():
                    found[kind].append(_distinct((_shard(by, shards) << U64(32)) | (keys >> U64(32))))
        rows = []
        for kind, parts in found.items():
            keys = _distinct(np.concatenate(parts))
            shard, halves = (keys >> U64(32)).astype(np.int64), keys.astype(np.uint32)
            first = _heads(shard).tolist() if len(keys) else []
            rows += [(int(shard[i]), block, kind, _steps(halves[i:j])) for i, j in zip(first, [*first[1:], len(keys)], strict=bool(first))]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                        names=["shard", "kn_block", "kind", "halves"])

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for kind, grams, numbers in zip(*(model.column(c).to_pylist() for c in ("kind", "grams", "numbers")), strict=True):
            found.setdefault(kind, []).append((_rising(grams, np.uint64), _numbers(numbers, np.float32)))
        tables = {}
        for kind, parts in found.items():
            grams, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1:  # sorted runs, which a stable sort merges
                order = np.argsort(grams, kind="stable")
                grams, numbers = grams[order], numbers[order]
            tables[kind] = grams, (grams >> U64(32)).astype(np.uint32), numbers
        out = []
        for block, asks, halves in zip(*(asked.column(c).to_pylist() for c in ("kn_block", "kind", "halves")), strict=True):
            halves = _rising(halves, np.uint32)
            for kind in {1, 11} & tables.keys() if asks == 1 else {asks} & tables.keys():
                grams, upper, numbers = tables[kind]
                hits, at, want = [], np.searchsorted(upper, halves), halves
                while len(at):
                    within = at < len(upper)
                    at, want = at[within], want[within]
                    same = upper[at] == want
                    at, want = at[same], want[same]
                    if len(at):
                        hits.append(at)
                    at = at + 1
                if hits:
                    hit = np.sort(np.concatenate(hits)) if len(hits) > 1 else hits[0]
                    out.append((block, kind, _steps(grams[hit]), _planes(numbers[hit])))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["kn_block", "kind", "grams", "numbers"])
    asked = dealt.groupBy("kn_block").applyInArrow(ask, "shard long, kn_block long, kind int, halves binary")
    return asked.groupBy("shard").cogroup(sent.rows.groupBy("shard")).applyInArrow(answer, "kn_block long, kind int, grams binary, numbers binary")


def _scored(docs: DataFrame, sent: Sent) -> DataFrame:
    """``docs``, stored, with ``n_words``, ``nats``, the negative log probability of all words under the model of its language, and what a part tells.

    ``high`` and ``low`` are the extreme mean surprises of a window by the
    lowest order, null in short texts; ``worst`` is by how much the worst words are likelier under the
    model of toxic text, null without words or without such a model.  ``sent`` is from
    ``_sent``; ``docs(doc_id, lang, text)``, other columns are passed through by name.
    """
    keep = [c for c in docs.columns if c != "text"]
    names = ["n_words", "nats", "high", "low", "worst"]
    sizes = sent.sizes
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small_blocks = min(SCORE_PASSES * PASS_BLOCKS, n_bytes // PASS_BYTES)
    blocks = max(1, -(-n_bytes // BLOCK_BYTES), small_blocks)
    passes = min(SCORE_PASSES, max(1, small_blocks))
    dealt = docs.withColumn("kn_block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks).cast("long")))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for kind, grams, numbers in zip(*(right.column(c).to_pylist() for c in ("kind", "grams", "numbers")), strict=True):
            found.setdefault(kind, []).append((_rising(grams, np.uint64), _numbers(numbers, np.float32)))
        model = Model({k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for k, v in found.items()}, sizes)
        langs = left.column("lang").to_pylist()
        out = {name: np.full(len(left), np.nan) for name in names}
        for part in slices(left.column("text"), lower=False):
            n = np.diff(part.bounds)
            own = langs[part.first:part.first + len(part)]
            nats, single, _ = model.surprise(part.words, own, n)
            toxic, _, able = model.surprise(part.words, _toxic_names(own), n, lowest=True)
            sums, singles = (np.concatenate(([0.0], np.cumsum(x))) for x in (nats, single))
            rows = slice(part.first, part.first + len(part))
            out["n_words"][rows], out["nats"][rows] = n, sums[part.bounds[1:]] - sums[part.bounds[:-1]]
            out["high"][rows], out["low"][rows] = _extremes(singles, part.bounds)
            more = single - toxic
            for i in np.flatnonzero(able & (n > 0)).tolist():
                out["worst"][part.first + i] = _worst(more[part.bounds[i]:part.bounds[i + 1]])
        del model, found
        give_back()
        return pa.table([*(left.column(c) for c in keep), pa.array(out["n_words"].astype(np.int64)),
                         *(pa.array(out[c], from_pandas=True) for c in names[1:])], names=[*keep, *names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    done = []
    for i in range(passes):
        some = dealt.where(F.col("kn_block") % passes == i) if passes > 1 else dealt
        done.append(stored(some.groupBy("kn_block").cogroup(_answers(some, sent).groupBy("kn_block")).applyInArrow(
            score, f"{kinds}, n_words long, nats double, high double, low double, worst double"), "scored"))
    return _together(done)


def _levels(held: DataFrame, quantile: float, slack: float) -> DataFrame:
    """``(of, mean, threshold, most, least, toxic)``: a row of bounds for each language, the quantiles exact and by selection; a null language has a name."""
    held = held.withColumn("of", F.coalesce("lang", F.lit("\x00")))
    means = held.groupBy("of").agg((F.sum("nats") / F.greatest(F.sum("n_words"), F.lit(1))).alias("mean"))
    rows = held.join(F.broadcast(means), "of").withColumn("perplexity", _perplexity())
    parts = {"perplexity": quantile, "high": WINDOW_QUANTILE, "low": 1 - WINDOW_QUANTILE, "worst": TOXIC_QUANTILE}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in parts]))
    counts = rows.select("of", cells.alias("x")).select("of", "x.*").where("value is not null").groupBy("of", "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    found = percentiles_of_counts(counts, ["of", "column_name"], parts, bound="some rows for each language")
    at = found.groupBy("of").agg(*[F.max(F.when(F.col("column_name") == c, F.col(c))).alias(f"q_{c}") for c in parts])
    around = rows.groupBy("of").agg(F.first("mean").alias("mean"), _away("high", DEVIATIONS).alias("a_high"), _away("low", -DEVIATIONS).alias("a_low"),
                                    _away("worst", DEVIATIONS).alias("a_worst"))
    return around.join(F.broadcast(at), "of", "left").select(
        "of", "mean", (F.col("q_perplexity") * slack).alias("threshold"), F.greatest(F.col("q_high") + WINDOW_SLACK, "a_high").alias("most"),
        F.least(F.col("q_low") - WINDOW_SLACK, "a_low").alias("least"), F.greatest(F.col("q_worst") + TOXIC_SLACK, "a_worst").alias("toxic"))


def _away(column: str, deviations: float):
    return F.avg(column) + deviations * F.stddev_pop(column)


def _perplexity():
    return F.exp((F.col("nats") + PRIOR_WORDS * F.col("mean")) / (F.col("n_words") + PRIOR_WORDS))


def perplexities(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, lang, n_words, perplexity, threshold, high, low, worst, kept)`` of each row of ``docs(doc_id, text, lang, ...)``, after the columns in ``carry``.

    ``labels(doc_id, quality, toxic)``; a document labelled twice is trusted
    only if all its labels are good, and toxic if any is.  A document is kept
    if its perplexity, its windows of highest and of lowest surprise and its
    worst words are all within the bounds of its language.  A language without
    trusted documents has no bounds, and its documents are kept; one without
    toxic documents has no bound on words.  A null or empty text has no words
    and counts as average, so it is kept.  A null language is a language.
    Repeated rows are scored each.  Other columns are ignored.  Empty documents
    give an empty result; empty labels keep everything.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"), *carry)
    chosen = stored(labelled(rows, labels).withColumn("text", F.when(~F.col("held_out"), F.col("text"))), "chosen")
    held_ids = stored(chosen.where("held_out").select("doc_id"), "held_ids")
    trained = train(chosen, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    scored = _scored(rows, _sent(trained)).withColumn("named", F.coalesce("lang", F.lit("\x00")))
    trained.discard()
    held = stored(scored.join(held_ids, "doc_id").dropDuplicates(["doc_id"]).select("lang", "n_words", "nats", "high", "low", "worst"), "held_out")
    levels = stored(_levels(held, quantile, slack), "levels")
    for table in (held_ids, held):
        discard(table)
    out = scored.join(F.broadcast(levels) if small_enough(levels, 64) else levels, F.col("named") == F.col("of"), "left") \
        .withColumn("perplexity", F.when(F.col("mean").isNotNull(), _perplexity()))
    within = [F.col(a) <= F.col(b) for a, b in (("perplexity", "threshold"), ("high", "most"), ("least", "low"), ("worst", "toxic"))]
    kept = within[0].isNull() | within[0]
    for w in within[1:]:
        kept = kept & (w.isNull() | w)
    return out.select(*carry, "doc_id", "lang", "n_words", "perplexity", "threshold", "high", "low", "worst", kept.alias("kept"))
