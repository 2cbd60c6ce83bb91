"""Language-model scores by deleted interpolation.

n-gram maximum-likelihood estimates of all orders are mixed with weights that depend on how often the context was seen.
A slice of the training documents is deleted from the counts; expectation-maximisation on that slice's tokens learns the
weights, and scores then use all training counts.

Documents are packed by shard. Each shard asks for each distinct n-gram once, with its own counts; buckets of the n-gram
space add the counts up and answer in the order asked. So a word in every document costs one request a shard, and no
model is sent to every task: only the weights are (orders x context buckets).

Defined results: null text is the empty text (the end token alone). Null doc_id is held out, and the row is returned.
Repeated rows count again. No training tokens: every estimate is zero and only the uniform part is left. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import hashing
from skerry.llm.exchange import Workspace, partitions, tasks_for
from skerry.llm.packs import by_shard, chunks, dump, load, pack

HELD_OUT, DELETED, NO_ID = 1, 2, 4
CONTEXT_BUCKETS = 24
_BEGIN, _END = hashing.mix(np.array([101, 102], np.uint64))
_STEP = 0.5  # width of the classes of log2 ratios in which the deleted tokens are counted
_NEVER = -1000


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the counts: bounded by orders and context buckets."""

    order: int
    tokens: int
    vocabulary: int
    weights: np.ndarray  # context bucket x (uniform, order 1, ..., order n)


def _items(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the n-gram that ends at each place, and for each text its first place; a text is begin, words, end."""
    words, first = hashing.words_of(texts)
    n = len(texts)
    tokens = np.insert(words, first[1:], _END)
    ends = first[1:] + np.arange(1, n + 1)
    starts = np.concatenate(([0], ends))
    seq = np.insert(tokens, starts[:-1], _BEGIN)
    starts = starts + np.arange(n + 1)
    place = np.arange(len(seq)) - np.repeat(starts[:-1], np.diff(starts))
    back = [seq, *(np.where(place >= d, np.roll(seq, d), _BEGIN) for d in range(1, order))]
    return [hashing.fold(back[:k][::-1]) for k in range(1, order + 1)], starts


def _bucket(items: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return (((items >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


@dataclass
class _Index:
    """A shard's distinct n-grams by order, with their training count and the part of it in the deleted slice; and by
    chunk of its documents the columns, the first place of each text and for each order the n-gram at each place."""

    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    chunks: list[tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]]


def _index(rows: list[tuple[int, bytes]], order: int) -> _Index:
    found: list[list[tuple]] = [[] for _ in range(order)]
    index = _Index([], [])
    for cols, texts in chunks(rows, 2 << 20):
        by_order, starts = _items(texts, order)
        flag = np.repeat(cols[1], np.diff(starts))
        train, deleted = (flag & HELD_OUT) == 0, (flag & DELETED) != 0
        places = []
        for k, items in enumerate(by_order):
            distinct, where = np.unique(items, return_inverse=True)
            found[k].append((distinct, np.bincount(where, train, len(distinct)), np.bincount(where, train & deleted, len(distinct))))
            places.append(where.astype(np.uint32))
        index.chunks.append((cols, starts, places))
    for k, parts in enumerate(found):
        distinct, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        index.grams.append((distinct, *(np.bincount(where, np.concatenate([p[j] for p in parts]), len(distinct)).astype(np.uint32) for j in (1, 2))))
        at = 0
        for (_, _, places), (mine, *_) in zip(index.chunks, parts, strict=True):
            places[k] = where[at : at + len(mine)].astype(np.uint32)[places[k]]
            at += len(mine)
    return index


_PART = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_PART_SQL = "shard int, kind int, payload binary"


def _ask(order: int, buckets: int):
    def ask(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        for k, (items, count, deleted) in enumerate(_index(rows, order).grams):
            cuts = np.searchsorted(_bucket(items, buckets), np.arange(buckets + 1))
            for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if y > x:
                    yield b, shard * order + k, dump(items[x:y], count[x:y], deleted[x:y])

    return ask


def _answer(order: int):
    """Totals in the order asked (kind: 1 + order * bucket + k), and a row of sums over the words (kind 0, shard -1)."""

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        for k in range(order):
            parts = [(asker // order, *load(p)) for asker, p in rows if asker % order == k]
            if not parts:
                continue
            items, where = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            total, deleted = (np.bincount(where, np.concatenate([p[j] for p in parts]), len(items)).astype(np.uint64) for j in (2, 3))
            if k == 0:
                word = items != hashing.fold([np.array([_BEGIN])])[0]
                yield -1, 0, dump(np.array([total[word].sum(), (total[word] > 0).sum(), deleted[word].sum()], np.int64))
            at = 0
            for shard, mine, *_ in parts:
                here = where[at : at + len(mine)]
                yield shard, 1 + order * bucket + k, dump(total[here], deleted[here])
                at += len(mine)

    return answer


def _counts(rows: list[tuple[int, bytes]], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order the totals and their deleted parts, in the order of the shard's distinct n-grams."""
    answers: list[list] = [[] for _ in range(order)]
    for kind, payload in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        answers[(kind - 1) % order].append(load(payload))
    return [tuple(np.concatenate([a[j] for a in got]) for j in (0, 1)) for got in answers]


def _chunk_estimates(rows: list[tuple[int, bytes]], model: Model, without_deleted: bool, tokens: int) -> Iterator[tuple]:
    """By chunk: the documents' columns, context bucket, estimates by order (uniform first) and training count of each
    token, the text that each token is of, and each text's first token."""
    docs = [r for r in rows if r[0] == 0]
    if not docs:
        return
    index, counts = _index(docs, model.order), _counts(rows, model.order)
    for cols, starts, places in index.chunks:
        token = np.ones(starts[-1], bool)
        token[starts[:-1]] = False
        ratio = [np.full(token.sum(), 1.0 / (model.vocabulary + 1))]
        before = word = None
        for k, where in enumerate(places):
            total, deleted = counts[k]
            here = (total[where] - deleted[where] if without_deleted else total[where]).astype(np.float64)
            context = np.full(token.sum(), float(tokens)) if before is None else np.roll(before, 1)[token]
            count = here[token]
            word = count if k == 0 else word
            ratio.append(np.divide(count, context, out=np.zeros_like(count), where=context > 0))
            before = here
        bucket = np.minimum(np.log2(context + 1), CONTEXT_BUCKETS - 1).astype(np.int64)
        n = len(starts) - 1
        yield cols, bucket, ratio, word, np.repeat(np.arange(n), np.diff(starts) - 1), starts[:-1] - np.arange(n)


_CLASS = pa.schema([("bucket", pa.int64()), ("classes", pa.list_(pa.int64())), ("n", pa.int64())])


def _deleted_classes(model: Model, tokens: int):
    """The deleted slice's tokens by context bucket and classes of log2(estimate / uniform)."""

    def classes(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        total: dict[tuple, int] = {}
        for cols, bucket, ratio, _, text, _ in _chunk_estimates(rows, model, True, tokens):
            kept = ((cols[1] & DELETED != 0) & (cols[1] & HELD_OUT == 0))[text]
            with np.errstate(divide="ignore"):
                cells = [np.where(r > 0, np.floor(np.log2(np.maximum(r, 1e-300) / ratio[0]) / _STEP), _NEVER).astype(np.int64)[kept] for r in ratio[1:]]
            keys, n = np.unique(np.stack([bucket[kept], *cells], 1), axis=0, return_counts=True)
            for key, c in zip(map(tuple, keys.tolist()), n.tolist(), strict=True):
                total[key] = total.get(key, 0) + c
        for key, c in total.items():
            yield key[0], list(key[1:]), c

    return classes


def learn_weights(buckets: np.ndarray, cells: np.ndarray, n: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by context bucket: expectation-maximisation over counted classes, each bucket shrunk to the overall weights."""
    parts = np.concatenate([np.ones((len(n), 1)), np.where(cells == _NEVER, 0.0, np.exp2((cells + 0.5) * _STEP))], 1)
    start = np.full(order + 1, 1.0 / (order + 1))

    def fit(mask: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
        w, p, c = prior.copy(), parts[mask], n[mask].astype(float)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = c @ share + strength * prior
            w /= w.sum()
        return w

    overall = fit(np.ones(len(n), bool), start, 1.0)
    weights = np.stack([fit(buckets == b, overall, 5.0) for b in range(CONTEXT_BUCKETS)])
    weights = np.maximum(weights, 1e-7)
    return weights / weights.sum(1, keepdims=True)


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORE_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(model: Model):
    def scores(shard: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        for cols, bucket, ratio, word, _, first in _chunk_estimates(rows, model, False, model.tokens):
            mixed = sum(model.weights[bucket, k] * r for k, r in enumerate(ratio))
            base = np.log10((word + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
            sums = [np.add.reduceat(x, first) for x in (np.log10(mixed), base, (word > 0).astype(np.int64))]
            for doc, flag, length, score, plain, known in zip(*cols, np.diff([*first, len(word)]), *sums, strict=True):
                yield None if flag & NO_ID else int(doc), bool(flag & HELD_OUT), int(length), int(known), model.tokens, float(plain), float(score)

    return scores


def score_documents(docs: DataFrame, order: int = 2, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of each row of docs(doc_id, text).

    Rows whose crc32 of doc_id as text is 0 modulo folds are held out; of the others, those whose quotient is 0 modulo
    folds are the deleted slice that learns the weights.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    space, parts = Workspace(spark, "lm"), partitions(spark)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    flags = (
        F.when(crc % folds == 0, HELD_OUT).otherwise(0)
        + F.when((crc % folds != 0) & (F.floor(crc / folds) % folds == 0), DELETED).otherwise(0)
        + F.when(F.col("doc_id").isNull(), NO_ID).otherwise(0)
    )
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("shard"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        flags.cast("bigint").alias("flags"),
        "text",
    )
    packs, size = space.weighed(pack(rows, ["id", "flags"]), "packs")
    tasks = tasks_for(size, parts)
    answers = space.settle(_answers(packs, order, parts, tasks), "answers")
    space.sweep()
    both = packs.unionByName(answers.where("shard >= 0"))
    model = _learn(both, answers, order, tasks, space)
    space.sweep()
    return by_shard(both, tasks, _scores(model), _SCORE_SQL, _SCORE)


def _answers(packs: DataFrame, order: int, parts: int, tasks: int) -> DataFrame:
    asked = by_shard(packs, tasks, _ask(order, parts), _PART_SQL, _PART)
    return by_shard(asked, tasks, _answer(order), _PART_SQL, _PART)


def _learn(both: DataFrame, answers: DataFrame, order: int, tasks: int, space: Workspace) -> Model:
    """Sums over the words (three numbers a bucket), and the weights from the deleted slice's classes, whose number is
    bounded by context buckets x classes of each order."""
    sums = [load(r.payload)[0] for r in answers.where("shard = -1").select("payload").toLocalIterator()]
    tokens, vocabulary, deleted = (int(x) for x in (np.sum(sums, 0) if sums else (0, 0, 0)))
    model = Model(order, tokens, vocabulary, np.full((CONTEXT_BUCKETS, order + 1), 1.0 / (order + 1)))
    classes = by_shard(both, tasks, _deleted_classes(model, tokens - deleted), "bucket bigint, classes array<bigint>, n bigint", _CLASS)
    grid = space.settle(classes.groupBy("bucket", "classes").agg(F.sum("n").alias("n")), "classes").collect()
    if not grid:
        return model
    weights = learn_weights(np.array([g.bucket for g in grid]), np.array([g.classes for g in grid]), np.array([g.n for g in grid]), order)
    return Model(order, tokens, vocabulary, weights)
