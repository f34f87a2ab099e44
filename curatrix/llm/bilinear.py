"""Language-model scoring: a log-bilinear model over words, trained by noise-contrastive estimation.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, then
one end token. The model's outputs are ``CLASSES`` classes: the end, each of the
most frequent training words (``WORD_CLASSES`` less one), and buckets of the other
words by their last two bytes. A token's probability is that of its class after
the two classes before it, times the token's share of its class (1 for a word
that is a class of its own; (c + 0.1) / (N_class + 0.1 * (V_class + 1)) in a
bucket, where one unseen word has a place), so it is normalised.

Token counts are one grouped aggregate over all training texts. Training passes
once over all of them too, in ``SHARES`` of growing size by a hash of the text:
every task goes through its part of the share in numpy mini-batches, beginning
with the mean of what all tasks made of the share before, and the means are
taken in a tree. The number of steps is that of the tokens, whatever the size.

For scoring, one matrix product gives the normalisers of all pairs of contexts.
Counts of the ``head`` most frequent tokens (a bounded table) are known to every
task. The other tokens of each text meet the counts in a join by token, and one
sum for each document comes back.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable, id_crc, slices, table, text_bytes

END = b"\n"
CLASSES = 2048
#: Classes that are the end or one word; the rest are buckets.
WORD_CLASSES = 1536
WIDTH = 32
HEAD = 200_000
#: Distinct tokens that a task counts before it passes them on.
FLUSH = 300_000
#: Parts of the training texts, in sixteenths, after each of which the models are averaged.
SHARES = (1, 3, 12)
#: Models that one task averages.
FAN_IN = 8
#: Rare tokens' logarithms are added as whole billionths, so sums do not depend on their order.
UNIT = 1e9


def bucket(word: bytes) -> int:
    return WORD_CLASSES + zlib.crc32((b"\0\0" + word)[-2:]) % (CLASSES - WORD_CLASSES)


#: The bucket of every ending of two bytes; zero stands before a lone byte.
_ENDINGS = np.array([[bucket(bytes([a, b])) for b in range(256)] for a in range(256)])


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over a frame with the column text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(text.lower().split())
            seen[END] += batch.num_rows
            if len(seen) >= FLUSH:
                yield flush()
        if seen:
            yield flush()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Totals, the words that are classes, the counts and classes of the head tokens, and the counts of each class."""

    total: int
    distinct: int
    named: dict[bytes, int]
    index: dict[bytes, int]
    count: np.ndarray
    klass: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray

    def tokens(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All tokens of the texts, the class of each, and where each text's end token stands."""
        words: list[bytes] = []
        ends = np.empty(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            words += text.lower().split()
            ends[k] = len(words)
            words.append(END)
        every = np.frombuffer(b"\0 " + b" ".join(words) + b" ", dtype=np.uint8)
        after = np.flatnonzero(every == 32)[1:]
        before = every[after - 2]
        klass = _ENDINGS[np.where(before == 32, 0, before), every[after - 1]]
        own = np.fromiter(map(self.named.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        return words, np.where(own < 0, klass, own), ends

    def heads(self, words: list[bytes], klass: np.ndarray) -> np.ndarray:
        """Head index of each token; -1: not in the head."""
        place = np.full(CLASSES, -1)
        place[list(self.named.values())] = [self.index.get(t, -1) for t in self.named]
        at = place[klass]
        rest = np.flatnonzero(klass >= WORD_CLASSES)
        at[rest] = np.fromiter(map(self.index.get, [words[k] for k in rest.tolist()], repeat(-1)), dtype=np.int64, count=len(rest))
        return at

    def triples(self, texts: list[bytes]) -> np.ndarray:
        """Classes (two before, one before, own) of all tokens; a text begins after two ends."""
        return contexts(*self.tokens(texts)[1:])

    @property
    def share(self) -> np.ndarray:
        """Share of all training tokens that each class has, smoothed."""
        return (self.class_total + 0.1) / (self.class_total.sum() + 0.1 * CLASSES)


def contexts(klass: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Triples of texts that follow each other; an end's class is 0, so it stands for one of the two before the next text."""
    out = np.zeros((3, len(klass)), dtype=klass.dtype)
    out[0, 2:], out[1, 1:], out[2] = klass[:-2], klass[:-1], klass
    out[0, ends[:-1] + 1] = 0
    return out


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Collects at most ``head`` of the most frequent tokens and one row for each class, nothing else.

    Counts are ranked by quarters of powers of two, so no rows are sorted; tokens
    of the rank that does not fit whole are none of the head.
    """
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rank = F.floor(4 * F.log2("n")).cast("int")
    left, least = head, None
    for row in sorted(counts.groupBy(rank.alias("rank")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["rank"]
    top = counts.where(rank >= least if least is not None else F.lit(False)).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    tokens, number = top["token"].to_pylist(), top["n"].to_numpy().astype(np.int64)
    index = {t: k for k, t in enumerate(tokens)}
    own = [t for t in tokens[:WORD_CLASSES] if t != END][: WORD_CLASSES - 1]
    named = {END: 0} | {t: k + 1 for k, t in enumerate(own)}
    klass = np.array([named[t] if t in named else bucket(t) for t in tokens] + [0], dtype=np.int64)
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for t, k in named.items():
        class_total[k] = number[index[t]] if t in index else 0
    last = F.substring(F.concat(F.lit(b"\0\0"), F.col("token")), -2, 2)
    rest = counts.where(~F.col("token").isin([F.lit(t) for t in named]))
    for row in rest.groupBy((F.crc32(last) % (CLASSES - WORD_CLASSES)).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_total[WORD_CLASSES + row["k"]], class_distinct[WORD_CLASSES + row["k"]] = row["n"], row["v"]
    return Vocabulary(int(totals["n"]), int(totals["v"]), named, index, np.append(number, 0), klass, class_total, class_distinct)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far below zero the exponential is infinite and the result zero."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gather(index: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct indices (of 65,536 at most) and the sums of their rows."""
    by = np.argsort(index.astype(np.uint16), kind="stable")
    index = index.take(by)
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[starts], *(np.add.reduceat(v.take(by, axis=0), starts, axis=0) for v in values)


@dataclass
class Bilinear:
    """Context vectors, a matrix for each context place, output vectors and biases; and the sums of squared slopes of each."""

    params: list[np.ndarray]
    squares: list[np.ndarray]

    @classmethod
    def first(cls, share: np.ndarray, width: int = WIDTH, seed: int = 7) -> Bilinear:
        """The model before training: the classes' shares, whatever the context (but for small random vectors)."""
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (len(share), width))
        params = [p.astype(np.float32) for p in (draw(), np.stack([np.eye(width) * 0.5, np.eye(width)]), draw(), np.log(share))]
        return cls(params, [np.full_like(p, 1e-6) for p in params])

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in (*self.params, *self.squares))

    def filled(self, data: bytes) -> Bilinear:
        """A model of this one's shape from ``to_bytes``."""
        out, at = [], 0
        for x in (*self.params, *self.squares):
            out.append(np.frombuffer(data, dtype=np.float32, count=x.size, offset=at).reshape(x.shape).copy())
            at += x.nbytes
        return Bilinear(out[:4], out[4:])

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        context, place = self.params[:2]
        return context[two] @ place[0] + context[one] @ place[1]

    def train(self, triples: np.ndarray, log_noise: np.ndarray, below: np.ndarray, rng: np.random.Generator, batch: int, rate: float = 0.1) -> None:
        """One pass over the triples in mini-batches, by noise-contrastive estimation with Adagrad, in place.

        ``below`` is the running sum of the noise's probabilities; ``log_noise`` the
        logarithm of how often each class is drawn for a token. The draws of a
        mini-batch are shared by its tokens.
        """
        context, place, output, bias = self.params
        triples = triples.take(rng.permutation(triples.shape[1]), axis=1)
        draws = round(float(np.exp(log_noise.astype(np.float64)).sum()))

        def move(kinds: tuple[int, ...], index: np.ndarray, *slopes: np.ndarray) -> None:
            index, *slopes = _gather(index, *slopes)
            for k, slope in zip(kinds, slopes, strict=True):
                squares = self.squares[k].take(index, axis=0) + slope * slope
                self.squares[k][index] = squares
                self.params[k][index] -= rate * slope / np.sqrt(squares)

        width = context.shape[1]
        both = place.reshape(2 * width, width)  # the same numbers: either place's matrix under the other
        for at in range(0, triples.shape[1], batch):
            before, own = triples[:2, at : at + batch].T.ravel(), triples[2, at : at + batch]
            noise = np.minimum(np.searchsorted(below, rng.random(draws) * below[-1]), len(bias) - 1)
            c = context.take(before, axis=0).reshape(len(own), 2 * width)
            q = c @ both
            r_noise, r_own = output[noise], output.take(own, axis=0)
            of_noise = q @ r_noise.T
            of_noise += bias[noise] - log_noise[noise]
            of_noise = _sigmoid(of_noise)
            of_own = _sigmoid(np.einsum("ij,ij->i", q, r_own) + bias[own] - log_noise[own]) - 1
            of_own /= len(own)
            of_noise /= len(own)
            g_q = of_noise @ r_noise
            r_own *= of_own[:, None]
            g_q += r_own
            move((2, 3), np.concatenate([own, noise]), np.concatenate([of_own[:, None] * q, of_noise.T @ q]), np.concatenate([of_own, of_noise.sum(axis=0)]))
            g_place = (c.T @ g_q).reshape(place.shape)
            move((0,), before, (g_q @ both.T).reshape(-1, width))
            self.squares[1] += g_place * g_place
            place -= 0.1 * rate * g_place / np.sqrt(self.squares[1])


def train_share(texts: DataFrame, shared, model: Bilinear, size: int, draws: int = 64, batch: int = 2048, tokens: int = 250_000) -> Bilinear:
    """The mean of what the tasks make of ``model``, each with its part of ``texts`` (of about ``size`` tokens); the same where there is none.

    Each task gives one row, its model (about a megabyte), so partitions are put
    together until a task has about ``tokens`` tokens to learn from; ``FAN_IN``
    models are averaged at a time until so few are left that the driver takes them.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)
    texts = texts.coalesce(max(1, size // tokens))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mine = shared.value, sent.value.filled(sent.value.to_bytes())
        noise = words.share
        log_noise, below = np.log(draws * noise).astype(np.float32), np.cumsum(noise)
        seen, rng, task = 0, None, 0
        for part in slices(batches, 1_000_000):
            found = part.column(0).to_pylist()
            if rng is None:
                task = zlib.crc32(found[0])
                rng = np.random.default_rng(task)
            triples = words.triples(found)
            # a small corpus takes small steps, so that it takes enough of them
            mine.train(triples, log_noise, below, rng, min(batch, max(32, words.total // 5000)))
            seen += triples.shape[1]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([float(seen)]), pa.array([mine.to_bytes()], pa.binary())], names=["task", "n", "model"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0.0, np.empty(0)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["task", "n", "model"])

        for part in batches:
            for group, weight, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                flat = np.frombuffer(data, dtype=np.float32).astype(np.float64) * weight
                if group != at:
                    if at is not None:
                        yield done()
                    at, n, total = group, 0.0, np.zeros(len(flat))
                n, total = n + weight, total + flat
        if at is not None:
            yield done()

    kind = "task long, n double, model binary"
    models = durable(texts.mapInArrow(learn, kind))
    left = models.count()
    while left > FAN_IN:
        group = F.pmod(F.xxhash64("task", "n"), F.lit(-(-left // FAN_IN))).alias("group")
        groups = models.select(group, "task", "n", "model").repartition("group").sortWithinPartitions("group", "task", "n")
        models = durable(groups.select("group", "n", "model").mapInArrow(average, kind))
        left = models.count()
    rows = sorted((r["n"], bytes(r["model"])) for r in models.collect())
    if not rows:
        return model
    total = sum(n for n, _ in rows)
    mean = np.zeros(len(rows[0][1]) // 4)
    for n, data in rows:
        mean += n / total * np.frombuffer(data, dtype=np.float32)
    return model.filled(mean.astype(np.float32).tobytes())


def fit(texts: DataFrame, shared, words: Vocabulary) -> Bilinear:
    """One pass over all of ``texts`` (the column text), averaged after each of the ``SHARES``."""
    model = Bilinear.first(words.share)
    part = F.pmod(F.xxhash64("text"), F.lit(sum(SHARES)))
    at = 0
    for size in SHARES:
        model = train_share(texts.where((part >= at) & (part < at + size)), shared, model, words.total * size // sum(SHARES))
        at += size
    return model


class Normaliser:
    """log P of class triples, normalised exactly.

    A class's score is the sum of what either context place gives it, so the sums
    of exponentials over all classes, for all pairs of contexts, are one matrix
    product. Its rows are made when a class first stands two places before.
    """

    def __init__(self, model: Bilinear):
        self.model = model
        output, bias = model.params[2:]
        self.two = model.params[0] @ model.params[1][0]
        self.one = model.params[0] @ model.params[1][1]
        every = self.one @ output.T
        self.shift = every.max(axis=1)
        self.powers = np.exp(every - self.shift[:, None]).T.copy()
        self.row = np.full(len(bias), -1)
        self.known = np.empty((0, len(bias)), dtype=np.float32)

    def _learn(self, new: np.ndarray) -> None:
        output, bias = self.model.params[2:]
        scores = self.two[new] @ output.T + bias
        top = scores.max(axis=1, keepdims=True)
        sums = np.exp(scores - top) @ self.powers
        with np.errstate(divide="ignore"):
            found = np.log(sums) + top + self.shift
        for i, j in np.argwhere(sums < 1e-30).tolist():  # the two places' best classes are far apart
            s = (scores[i] + self.one[j] @ output.T).astype(np.float64)
            found[i, j] = s.max() + np.log(np.exp(s - s.max()).sum())
        self.row[new] = len(self.known) + np.arange(len(new))
        self.known = np.concatenate([self.known, found.astype(np.float32)])

    def log10(self, two: np.ndarray, one: np.ndarray, own: np.ndarray) -> np.ndarray:
        output, bias = self.model.params[2:]
        new = np.unique(two[self.row[two] < 0])
        if len(new):
            self._learn(new)
        s = np.einsum("ij,ij->i", self.two.take(two, axis=0) + self.one.take(one, axis=0), output.take(own, axis=0)) + bias[own]
        return (s - self.known[self.row[two], one]).astype(np.float64) / np.log(10)


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train`` has the training texts in ``text_col``. A null text is empty and has
    the end token alone; rows that repeat an id keep a row each, ids may be null;
    without training rows all counts are zero and the model is near uniform over
    its classes. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = train.select(text_bytes(text_col).alias("text"))
    counts = durable(token_counts(texts))
    words = vocabulary(counts, head)
    shared = spark.sparkContext.broadcast(words)
    model_shared = spark.sparkContext.broadcast(fit(texts, shared, words))
    smooth = float(np.log10(words.total + 0.1 * (words.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, normaliser = shared.value, normaliser_of(model_shared.value)
        log_count = np.log10(words.count + 0.1)
        named = np.arange(CLASSES) < WORD_CLASSES
        share = np.where(named, 0.0, np.log10(words.class_total + 0.1 * (words.class_distinct + 1)))
        for batch in slices(batches):
            found = batch.column(1).to_pylist()
            n = len(found)
            tokens, klass, ends = words.tokens(found)
            at = words.heads(tokens, klass)
            sizes = np.diff(ends, prepend=-1)
            owner = np.repeat(np.arange(n), sizes)
            total = lambda values, of=owner: np.bincount(of, values, minlength=n)  # noqa: B023, E731
            inside = at >= 0
            bare = np.where(inside, log_count[at], 0.0)
            known = total(inside).astype(np.int64)
            base = total(bare) - ~inside[ends]  # the end token was never seen
            lexical = total(np.where(named[klass], 0.0, bare)) - total(share[klass])
            sums = lexical + total(normaliser.log10(*contexts(klass, ends)))
            inside[ends] = True
            out = np.flatnonzero(~inside)
            cuts = np.searchsorted(out, ends).tolist()
            rare = [tokens[k] for k in out.tolist()]
            tails = [Counter(rare[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            rows = np.append(np.arange(n), np.repeat(np.arange(n), [len(tail) for tail in tails]))
            first = np.arange(len(rows)) < n
            sigs = np.array([xxhash.xxh64_intdigest(text) - (1 << 63) for text in found], dtype=np.int64)
            only = lambda values: pa.array(values[rows], mask=~first)  # noqa: B023, E731
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    pa.array(sigs[rows]),
                    pa.array([f" {doc}".encode() for doc in ids.to_pylist()] + list(chain.from_iterable(tails)), pa.binary()),
                    pa.array([0] * n + list(chain.from_iterable(tail.values() for tail in tails)), pa.int64()),
                    pa.array(first.astype(np.int64)),
                    only(sizes),
                    only(known),
                    only(base),
                    only(sums),
                ],
                names=["doc_id", "sig", "token", "tf", "rows", "n_tokens", "n_known", "base", "chain"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    parts = source.mapInArrow(run, "doc_id long, sig long, token binary, tf long, rows long, n_tokens long, n_known long, base double, chain double")
    met = parts.join(counts, "token", "left")
    rare = F.col("tf") * F.round(F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1)) * UNIT).cast("long")
    known = F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)
    # rows of the same id and text are equal: their own sums are taken once, their rare tokens' in whole numbers
    out = met.groupBy("doc_id", "sig").agg(F.sum("rows").alias("rows"), *(F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "chain")), F.sum(known).alias("known"), F.sum(rare).alias("rare"))
    each = lambda c: F.col(c) / F.col("rows")
    out = out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + each("known").cast("long")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + each("rare") / UNIT - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("chain") + each("rare") / UNIT).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    )
    return out.drop("_copy")


_KEPT: dict[int, Normaliser] = {}


def normaliser_of(model: Bilinear) -> Normaliser:
    """The worker's normaliser of a model; what it has met serves the worker's later tasks too."""
    key = zlib.crc32(model.to_bytes())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Normaliser(model)
    return _KEPT[key]


def op9_bilinear_lm(spark, sf_dir: str) -> DataFrame:
    """Contract columns, learned from the texts whose crc32(doc_id as text) mod 10 is not 0."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, docs.where(id_crc() % 10 != 0))
    return found.select("doc_id", (id_crc() % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
