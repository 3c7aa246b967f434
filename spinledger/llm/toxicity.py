"""Toxicity from two Kneser-Ney language models, one of toxic and one of ordinary texts.

A word's probability in a class is Kneser-Ney's: in how many different surroundings, that
is behind how many different words, the class has it, less a discount. What discounting
takes goes to counts that both classes share, so a word that neither class has says
nothing and a rare one, or one that only comes in copies of one text, says little. Above
it stand pairs of words: those frequent in both classes together have a probability of
their own in each class, drawn towards the shared one, and the weight that a word leaves
to the level below is shared too. A word's evidence is the logarithm of its probability
among toxic texts over that among ordinary ones. A text's score comes from the mean
evidence of all its words and from that of its most toxic passage, both normalised by
length; a logistic curve over the two is fitted on labelled documents that the models did
not see.

Words and pairs of words are counted over all labelled documents for learning, on the
executors. The models are then tables of hash slots, so their size is a parameter while
the counts grow with the input. Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.llm.common import materialize

#: Words of a passage.
PASSAGE = 2
#: Surroundings taken off each word's number of them.
DISCOUNT = 2
#: Occurrences from which a pair counts as frequent, and how many the shared probability stands for in each class.
FREQUENT, SHARED = 50, 500
#: Slots of the tables of words and of pairs; 12 bytes each.
WORD_SLOTS, PAIR_SLOTS = 1 << 21, 1 << 21
#: Frequent pairs without a slot of their own that go to all tasks with the model, 16 bytes each; more are joined by shuffle.
HELD_PAIRS = 1 << 20
#: Bits of the table that holds back texts without a label; a million rows at most.
ID_BITS = 1 << 26
#: About as many labelled documents fit the logistic curve.
CURVE_DOCUMENTS = 20_000
#: Words and pairs remembered by a task before it hands its counts on.
REMEMBERED = 1 << 21

_WORD = re.compile(r"[^\W\d_]+")
_START = 0
#: Evidence is added up in whole numbers of this part.
UNIT = 1 << 20


class _Ids(dict):
    """crc32 of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = found = crc32(word.encode())
        return found


def word_ids(text: str | None, ids: _Ids) -> list[int]:
    return [ids[w] for w in _WORD.findall(text.lower())] if text else []


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)).view(np.int64)


def _pair_slots(before: np.ndarray, word: np.ndarray, slots: int) -> np.ndarray:
    mixed = (before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (slots - 1)


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, word, toxic, ordinary): how often a pair of word ids occurs in each class, in parts."""
    ids, held, size = _Ids(), ([], []), 0

    def rows() -> pa.RecordBatch:
        keys = [np.concatenate(h) if h else np.empty(0, np.uint64) for h in held]
        pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
        split = len(keys[0])
        counts = [np.bincount(w, minlength=len(pairs)).astype(np.int32) for w in (where[:split], where[split:])]
        columns = [*((x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for x in (pairs >> np.uint64(32), pairs)), *counts[::-1]]
        for h in held:
            h.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["before", "word", "toxic", "ordinary"])

    for part in parts:
        for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
            found = np.array([_START, *word_ids(text, ids)], np.uint64)
            if len(found) > 1:
                held[int(toxic)].append(found[:-1] << np.uint64(32) | found[1:])
                size += len(found)
        if size > REMEMBERED:
            yield rows()
            size = 0
    if size:
        yield rows()


@dataclass(frozen=True)
class Model:
    """By slot: probabilities of words in each class, weights left to words, and probabilities of pairs with their words.

    Frequent pairs whose slot another pair has stand in ``rest_pairs``, by sorted ``rest_keys``.
    """

    words: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    pair_words: np.ndarray
    curve: tuple[float, float, float]
    empty: float
    pair_before: np.ndarray | None = None
    rest_keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    rest_pairs: np.ndarray = field(default_factory=lambda: np.empty((2, 0), np.float32))

    def _owns(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        own = self.pair_words[pair] == word
        return own if self.pair_before is None else own & (self.pair_before[pair] == before)

    def displaced(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of the pairs whose slot another pair has."""
        pair = _pair_slots(before, word, self.pairs.shape[1])
        other = (self.pair_words[pair] >= 0) & ~self._owns(before, word, pair)
        return np.unique(_pair_keys(before[other], word[other]))

    def with_rest(self, part: pa.RecordBatch) -> Model:
        """The model with the pairs in column ``rest`` of ``part``, where it has that column."""
        if "rest" not in part.schema.names:
            return self
        found = part["rest"].flatten()
        keys, at = np.unique(found.field("key").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
        values = [found.field(c).to_numpy(zero_copy_only=False)[at] for c in ("toxic", "ordinary")]
        return replace(self, rest_keys=keys, rest_pairs=np.array(values, np.float32).reshape(2, -1))

    def evidence(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log ratio of toxic to ordinary probability of each word behind the one before."""
        mask = self.words.shape[1] - 1
        pair = _pair_slots(before, word, self.pairs.shape[1])
        own, left = self._owns(before, word, pair), self.weights[before & mask]
        high = own * self.pairs[:, pair]
        if len(self.rest_keys):
            keys = _pair_keys(before, word)
            at = np.minimum(np.searchsorted(self.rest_keys, keys), len(self.rest_keys) - 1)
            high = np.where(self.rest_keys[at] == keys, self.rest_pairs[:, at], high)
        toxic, ordinary = (high[c] + left * self.words[c][word & mask] for c in (0, 1))
        return np.log(toxic / ordinary)

    def features(self, texts: list[str | None], ids: _Ids) -> np.ndarray:
        """Mean evidence of each text and of its most toxic passage; not a number without words."""
        rows = [word_ids(t, ids) for t in texts]
        sizes = np.array([len(r) for r in rows])
        out = np.full((len(rows), 2), np.nan)
        if not sizes.sum():
            return out
        word = np.fromiter((i for r in rows for i in r), np.int64, sizes.sum())
        before = np.empty_like(word)
        before[1:] = word[:-1]
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        begins = (ends - sizes)[some]
        before[begins] = _START
        # whole numbers: a sum does not depend on the texts in front of it
        sums = np.concatenate([[0], np.cumsum(np.rint(self.evidence(before, word) * UNIT).astype(np.int64))])
        last = ends[some]
        out[some, 0] = (sums[last] - sums[begins]) / UNIT / sizes[some]
        short = sizes[some] <= PASSAGE
        if len(word) > PASSAGE:
            passages = (sums[PASSAGE:] - sums[:-PASSAGE]) / UNIT / PASSAGE
            inside = np.arange(len(passages)) + PASSAGE <= np.repeat(last, sizes[some])[: len(passages)]
            best = np.maximum.reduceat(np.append(np.where(inside, passages, -np.inf), [-np.inf] * PASSAGE), begins)
            out[some, 1] = np.where(short, out[some, 0], best)
        else:
            out[some, 1] = out[some, 0]
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        with np.errstate(over="ignore"):
            found = 1 / (1 + np.exp(-(a + features @ np.array([b, c]))))
        return np.where(np.isnan(features[:, 0]), self.empty, found)


def _filled(table: pa.Table, name: str, slots: int) -> np.ndarray:
    out = np.zeros(slots)
    out[table["slot"].to_numpy()] = table[name].to_numpy()
    return out


def _with_slots(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            slot = _pair_slots(part["before"].to_numpy(), part["word"].to_numpy(), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *part.columns], ["slot", *part.schema.names])

    return run


def fit_models(labelled: DataFrame, word_slots: int = WORD_SLOTS, pair_slots: int = PAIR_SLOTS) -> Model:
    """Models of the rows ``labelled`` (text, toxic boolean), without a curve yet, with all frequent pairs."""
    return _fit_models(labelled, word_slots, pair_slots, None)[0]


def _fit_models(
    labelled: DataFrame, word_slots: int, pair_slots: int, held_pairs: int | None
) -> tuple[Model, DataFrame | None]:
    """Models, and a table (key, toxic, ordinary) of the frequent pairs they do not hold, if any.

    Words that share a slot are one word to the models. Of pairs that share one, the most
    frequent has it; the others are held beside the slots, or, beyond ``held_pairs`` of
    them, are in the table.
    """
    if word_slots & (word_slots - 1) or pair_slots & (pair_slots - 1):
        raise ValueError("the numbers of slots must be powers of two")
    classes = ("toxic", "ordinary")
    counted = labelled.select("text", "toxic").mapInArrow(_count, "before int, word int, toxic int, ordinary int")
    signed = materialize(counted.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in classes]), "pairs")
    positive = [F.col(c).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)).alias(c) for c in ("before", "word")]
    pairs = signed.select(*positive, *classes, (F.col("toxic") + F.col("ordinary")).alias("n"))
    slot = lambda c: F.col(c).bitwiseAND(F.lit(word_slots - 1)).alias("slot")
    often = F.col("n") >= FREQUENT
    kinds = [F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in classes]
    by_word = pairs.groupBy(slot("word")).agg(*kinds, F.count(F.lit(1)).alias("both")).toArrow()
    frequent = [F.sum(F.when(often, F.col(c)).otherwise(0)).alias(f"often_{c}") for c in ("n", *classes)]
    behind = pairs.groupBy(slot("before")).agg(F.sum("n").alias("n"), *frequent).toArrow()

    shared = _filled(by_word, "both", word_slots) + 1.0 / word_slots
    shared /= shared.sum()
    words = np.empty((2, word_slots), np.float32)
    for k, name in enumerate(classes):
        n = _filled(by_word, name, word_slots)
        off = np.minimum(n, DISCOUNT)
        words[k] = (n - off + max(1.0, off.sum()) * shared) / max(1.0, n.sum())
    follows = {c: _filled(behind, c, word_slots) for c in ("n", "often_n", "often_toxic", "often_ordinary")}
    own = follows["often_n"] / (follows["n"] + FREQUENT)

    in_slot = Window.partitionBy("slot").orderBy(F.desc("n"), F.desc("before"), F.desc("word"))
    ranked = (
        pairs.filter(often)
        .mapInArrow(_with_slots(pair_slots), "slot bigint, before bigint, word bigint, toxic bigint, ordinary bigint, n bigint")
        .withColumn("first", F.row_number().over(in_slot) == 1)
    )
    ranked = materialize(ranked, "frequent")

    def probabilities(part: pa.Table | pa.RecordBatch, own: np.ndarray, follows: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Of each pair in the two classes."""
        context = part["before"].to_numpy() & (word_slots - 1)
        expected = SHARED * part["n"].to_numpy() / np.maximum(1, follows["often_n"][context])
        return [own[context] * (part[c].to_numpy() + expected) / (follows[f"often_{c}"][context] + SHARED) for c in classes]

    kept = ranked.filter("first").drop("first").toArrow()
    at = kept["slot"].to_numpy()
    table, pair_words, pair_before = np.zeros((2, pair_slots), np.float32), np.full(pair_slots, -1, np.int64), np.zeros(pair_slots, np.uint32)
    pair_words[at], pair_before[at] = kept["word"].to_numpy(), kept["before"].to_numpy()
    table[:, at] = probabilities(kept, own, follows)
    model = Model(words, (1 - own).astype(np.float32), table, pair_words, (0.0, 0.0, 0.0), 0.0, pair_before)
    others = ranked.filter("not first").drop("first", "slot")
    if held_pairs is None or others.count() <= held_pairs:
        held = others.toArrow()
        keys = _pair_keys(held["before"].to_numpy(), held["word"].to_numpy())
        order = np.argsort(keys)
        values = np.array(probabilities(held, own, follows), np.float32)
        return replace(model, rest_keys=keys[order], rest_pairs=values[:, order]), None
    sent = labelled.sparkSession.sparkContext.broadcast((own, follows))

    def valued(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = _pair_keys(part["before"].to_numpy(), part["word"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *probabilities(part, *sent.value))], ["key", *classes])

    rest = materialize(others.mapInArrow(valued, "key bigint, toxic double, ordinary double"), "rest")
    sent.destroy()
    return model, rest


def _with_rest(rows: DataFrame, rest: DataFrame | None, sent: Broadcast) -> DataFrame:
    """``rows`` with the pairs of ``rest`` that their text has, as a list of that name; as they are without ``rest``."""
    if rest is None:
        return rows

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for part in parts:
            for digest, text in zip(part["digest"].to_pylist(), part["text"].to_pylist(), strict=True):
                found = np.array([_START, *word_ids(text, ids)], np.int64)
                keys = sent.value.displaced(found[:-1], found[1:])
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(keys), pa.string()), pa.array(keys)], ["digest", "key"])

    known = rows.withColumn("digest", F.sha2("text", 256))
    wanted = known.select("digest", "text").mapInArrow(asked, "digest string, key bigint").distinct()
    lists = wanted.join(rest.hint("merge"), "key").groupBy("digest").agg(F.collect_list(F.struct("key", "toxic", "ordinary")).alias("rest"))
    return known.join(lists.hint("merge"), "digest", "left").drop("digest")


def _fit_curve(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a light penalty, by Newton's steps."""
    x = np.column_stack([np.ones(len(features)), features])
    beta, penalty = np.zeros(3), np.diag([1e-6, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (toxic - p) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def _remainder(name: str = "doc_id", of: int = 5) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8")) % of


def _marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` with their row of ``marks``; texts without one mostly stay where they are.

    A table of ``ID_BITS`` bits, one set for the hash of each marked id, goes to all tasks
    and holds back texts before the shuffle; the join decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    placed = marks.select(bit("doc_id").alias("bit"))
    words = placed.groupBy((F.col("bit") / 64).cast("bigint").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )
    near = docs.withColumn("bit", bit("doc_id")).join(F.broadcast(words), (F.col("bit") / 64).cast("bigint") == F.col("at"))
    held = near.filter(F.expr("getbit(bits, cast(bit % 64 as int)) = 1")).select("doc_id", "text")
    return held.join(marks.hint("merge"), "doc_id")


def fit(
    docs: DataFrame, labels: DataFrame, word_slots: int = WORD_SLOTS, pair_slots: int = PAIR_SLOTS, held_pairs: int = HELD_PAIRS
) -> tuple[Model, DataFrame | None] | None:
    """Models and curve, and the frequent pairs that the models do not hold, from ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks; None without both classes.

    A document that is marked both ways is toxic. Documents whose crc32(doc_id) mod 5 is 0
    are left out, those with remainder 1 fit the curve, on about ``CURVE_DOCUMENTS`` of
    them, and all others the models.
    """
    marks = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
        .withColumn("fold", _remainder())
        .filter("fold <> 0")
    )
    own = docs.select("doc_id", "text").filter("doc_id is not null")
    have = {(r["fold"] == 1, r["toxic"]): r["n"] for r in marks.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({t for _, t in have}) < 2:
        return None
    model, rest = _fit_models(_marked(own, marks.filter("fold > 1")).select("text", "toxic"), word_slots, pair_slots, held_pairs)
    waiting = marks.filter("fold = 1").count()
    share = min(1.0, CURVE_DOCUMENTS / max(1, waiting))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = _marked(own, marks.filter((F.col("fold") == 1) & drawn)).select("text", "toxic")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for part in parts:
            found = sent.value.with_rest(part).features(part["text"].to_pylist(), ids)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), part["toxic"]], ["whole", "passage", "toxic"])

    seen = _with_rest(sample, rest, sent).mapInArrow(features, "whole double, passage double, toxic boolean").toPandas()
    sent.destroy()
    seen = seen.dropna()
    toxic = seen["toxic"].to_numpy(float)
    base = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < base < 1:
        return replace(model, curve=(0.0, 1.0, 1.0), empty=base), rest  # no curve to be had: plain evidence
    curve = _fit_curve(seen[["whole", "passage"]].to_numpy(), toxic)
    return replace(model, curve=curve, empty=base), rest


def score_documents(
    docs: DataFrame, labels: DataFrame, word_slots: int = WORD_SLOTS, pair_slots: int = PAIR_SLOTS, held_pairs: int = HELD_PAIRS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    A text without a word, null ones included, gets the share of toxic documents. Without
    labels of both classes every score is 0, or 1 where all labels are toxic. Equal texts
    get equal scores; a null id is held out. Other columns play no part.
    """
    fitted = fit(docs, labels, word_slots, pair_slots, held_pairs)
    own = docs.select("doc_id", (_remainder() == 0).alias("held_out"), "text")
    if fitted is None:
        only = labels.filter("toxic is not null").filter(_remainder() != 0).agg(F.max((F.col("toxic") > 0).cast("int"))).first()[0] or 0
        return own.select("doc_id", "held_out", F.lit(float(only)).alias("score"), F.lit(int(only)).alias("predicted"))
    model, rest = fitted
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for part in parts:
            for i in range(0, part.num_rows, 256):
                some = part.slice(i, 256)
                found = sent.value.scores(sent.value.with_rest(some).features(some["text"].to_pylist(), ids))
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["held_out"], pa.array(found)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = _with_rest(own, rest, sent).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
