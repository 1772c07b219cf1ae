"""Language-model scores: a two-level log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Tokens are words of a text with A-Z in lower case, then one end. The first level predicts a token's class from the two
classes before it: each of the ``FREQUENT`` commonest words is a class of its own, other words fall into classes by the
bytes they end with. The second level predicts the word inside its class from the class before it, by a vector of each
of the ``VOCABULARY`` commonest words. Words without a vector share what is left of their class by their smoothed counts,
one unknown word included. Each factor is normalised, so the probabilities of all words, and of an unknown word in each
class, add up to one.

* Counts. Each task counts the words of its training documents and emits partial sums; Spark adds them up. The counts
  stay a table. The commonest words, ``HELD`` at most, are broadcast; other words of a document meet their
  counts in a join, which carries a row for each document and such word.
* Training. Each task counts the cells of its training documents, (context, class) and (class before, word), at most
  ``CLASSES ** 3 + CLASSES * VOCABULARY`` of them, so the sums that the driver trains from are bounded too, while they
  cover every training token. Each step goes over all cells, and over all noise: instead of drawing noise words, their
  expectation is taken, which is the limit of noise-contrastive estimation for many draws.
* Scoring. A batch's distinct contexts go through one matrix product and a log-softmax over all classes; the second
  level is one matrix product of all classes by all words with a log-softmax inside each class, made once by a worker.
  Tokens look their log-probabilities up.

Edge cases: a null or empty text is an end alone; a null id is not held out and is scored like any other; rows that
share an id keep their own scores, as each row is numbered in the written table of partial scores; equal rows are
scored alike; long texts are tokenised one at a time, and a row has what one text needs; an empty table gives an empty
result; without training tokens every class is equally likely; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import give_back, materialise, slices, small_batches, texts

FREQUENT, ENDINGS = 111, 16
#: Frequent words, classes of endings, and the end. The largest id is the end; it also stands before the first token.
CLASSES = FREQUENT + ENDINGS + 1
END = CLASSES - 1
#: The end as a word; no word has a space.
END_WORD = b" "
HELD = 200_000
#: Words with vectors: enough of them make up nearly all of a text, and their parameters fit into a worker.
VOCABULARY = 32_768
DIM, NOISE, STEPS, WORD_STEPS, RATE, SEED = 32, 24, 160, 40, 0.05, 20
FOLDS, HELD_OUT = 7, 2


def ending_class(word: bytes) -> int:
    """The class of a word that isn't frequent: by its last letters, which tell much of a word's language and kind."""
    tail = word.rstrip(b".,;:!?\"')")[-2:]
    if not tail:
        return FREQUENT
    if len(tail) == 2 and tail[-1] >= 128:
        return FREQUENT + 1
    last = tail[-1]
    return FREQUENT + 2 + (last - 97) % (ENDINGS - 3) if 97 <= last <= 122 else FREQUENT + ENDINGS - 1


def held_out(id_col: str) -> Column:
    """Documents outside training: CRC-32 of the id as text, modulo FOLDS."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """``w`` (binary) and ``n``: how often each token occurs; END_WORD is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in slices(batches, "t"):
            for raw in texts(batch.column("t")):
                found.update(raw.lower().split())
            found[END_WORD] += batch.num_rows
            if len(found) > 400_000:
                yield _counts(found)
                found.clear()
        if found:
            yield _counts(found)

    partial = training.select(F.col(text_col).alias("t")).mapInArrow(run, "w binary, n bigint")
    return partial.groupBy("w").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["w", "n"])


class Lexicon:
    """The held words (the commonest first) with their classes and counts, each class's totals, and which words have vectors."""

    def __init__(self, words: list[bytes], counts: list[int], totals: np.ndarray, kinds: np.ndarray):
        self.counts = dict(zip(words, counts, strict=True))
        common = [w for w in words if w != END_WORD]
        self.frequent = {w: i for i, w in enumerate(common[:FREQUENT])} | {END_WORD: END}
        own = common[FREQUENT : FREQUENT + VOCABULARY]
        classes = np.array([ending_class(w) for w in own], np.int64)
        order = np.argsort(classes, kind="stable")  # words of a class are together
        self.vectored = {own[k]: i for i, k in enumerate(order.tolist())}
        self.word_class = classes[order]
        self.word_counts = np.array([self.counts[own[k]] for k in order.tolist()], np.float64)
        self.totals, self.kinds = totals, kinds  # of each class: training tokens, distinct words
        self.tokens, self.distinct = int(totals.sum()), int(kinds.sum())

    def class_of(self, word: bytes) -> int:
        c = self.frequent.get(word)
        return ending_class(word) if c is None else c

    def inside(self) -> np.ndarray:
        """log10 of what a count + 1 is divided by, in each class, for words without a vector."""
        return np.log10(self.totals + self.kinds + 1.0)

    def with_vector(self) -> np.ndarray:
        """log10 of the part of each class that its words with vectors have; the others have (count + 1) / 10 ** inside."""
        left = self.totals - np.bincount(self.word_class, self.word_counts, CLASSES) + self.kinds - np.bincount(self.word_class, minlength=CLASSES) + 1.0
        return np.log10(np.maximum(1.0 - left / (self.totals + self.kinds + 1.0), 1e-300))


def learn_lexicon(counts: DataFrame) -> Lexicon:
    """From the table of counts; HELD words come to the driver, and two sums of each class."""
    step = F.floor(F.log2("n") * 32)  # a few thousand steps at most
    least, so_far = 1 << 62, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["n"]):
        so_far += r["k"]
        if so_far > HELD:
            break
        least = r["n"]
    top = counts.filter((F.col("n") >= least) | (F.col("w") == F.lit(END_WORD))).select("w", "n").toArrow()
    pairs = sorted(zip(top["w"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, numbers = [w for w, _ in pairs], [n for _, n in pairs]
    del top, pairs
    lexicon = Lexicon(words, numbers, np.zeros(CLASSES), np.zeros(CLASSES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            ids = np.array([classes(w) for w in texts(batch.column("w"))], np.int64)
            totals += np.bincount(ids, batch.column("n").to_numpy(), CLASSES).astype(np.int64)
            kinds += np.bincount(ids, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(totals), pa.array(kinds)], ["c", "n", "k"])

    frequent = lexicon.frequent
    classes = lambda w: frequent[w] if w in frequent else ending_class(w)
    sums = counts.mapInArrow(run, "c bigint, n bigint, k bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums.collect():
        totals[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    lexicon.totals, lexicon.kinds = totals, kinds
    lexicon.tokens, lexicon.distinct = int(totals.sum()), int(kinds.sum())
    return lexicon


class ClassCodes(dict):
    """A word's class and, from ``CLASSES`` on in steps of it, its vector; remembered as long as words fit into ``BYTES``."""

    BYTES = 32 << 20

    def __init__(self, frequent: dict[bytes, int], vectored: dict[bytes, int]):
        self.known = frequent | {w: ending_class(w) + CLASSES * (i + 1) for w, i in vectored.items()}
        super().__init__(self.known)
        self.left = self.BYTES

    def __missing__(self, word: bytes) -> int:
        c = ending_class(word)
        if len(word) > 200:
            return c
        self.left -= 100 + len(word)
        if self.left < 0:
            self.clear()
            self.update(self.known)
            self.left = self.BYTES
        self[word] = c
        return c


def class_sequences(raws: list[bytes], codes: ClassCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Classes of all tokens of the texts, their vectors (-1: none), their contexts (class before last * CLASSES + last
    class), each text's number of tokens, and the words."""
    words = [x.lower().split() for x in raws]
    parts, vectors, contexts = [], [], []
    for x in words:
        c = np.fromiter(map(codes.__getitem__, x), np.int64, len(x))
        v, c = np.divmod(np.append(c, END), CLASSES)
        vectors.append(v - 1)
        before = np.concatenate([[END, END], c[:-1]])
        parts.append(c)
        contexts.append(before[:-1] * CLASSES + before[1:])
    flat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
    return flat(parts), flat(vectors), flat(contexts), np.array([len(x) + 1 for x in words], np.int64), words


def cell_counts(training: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """``cell`` and ``n``, over every training token: context * CLASSES + class, and from CLASSES ** 3 on the class before *
    VOCABULARY + word."""
    shared = training.sparkSession.sparkContext.broadcast((lexicon.frequent, lexicon.vectored))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, found = ClassCodes(*shared.value), np.zeros(CLASSES**3 + CLASSES * VOCABULARY, np.int32)
        for batch in slices(batches, "t"):
            classes, vectors, contexts, _, _ = class_sequences(texts(batch.column("t")), codes)
            some = vectors >= 0
            words = CLASSES**3 + contexts[some] % CLASSES * VOCABULARY + vectors[some]
            for each in (contexts * CLASSES + classes, words):
                cells, n = np.unique(each, return_counts=True)
                found[cells] += n.astype(np.int32)
        cells = np.flatnonzero(found)
        for k in range(0, len(cells), 100_000):
            part = cells[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[part].astype(np.int64))], ["cell", "n"])

    partial = training.select(F.col(text_col).alias("t")).mapInArrow(run, "cell bigint, n bigint")
    return partial.groupBy("cell").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Scores of the next class, ``(far * words[x] + near * words[y]) . out[z] + bias[z]``, and of a word of vector w in its
    class, ``before[y] . vectors[w] + shares[w]``."""

    def __init__(self, word_class: np.ndarray | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.words, self.out, self.bias = small(CLASSES, DIM), small(CLASSES, DIM), np.zeros(CLASSES, np.float32)
        self.near, self.far = np.ones(DIM, np.float32), np.full(DIM, 0.5, np.float32)
        self.word_class = np.zeros(0, np.int64) if word_class is None else word_class
        n = len(self.word_class)
        self.before, self.vectors, self.shares = small(CLASSES, DIM), small(n, DIM), np.zeros(n, np.float32)

    def queries(self, contexts: np.ndarray) -> np.ndarray:
        return self.words[contexts // CLASSES] * self.far + self.words[contexts % CLASSES] * self.near

    def log10_rows(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes after each context."""
        s = (self.queries(contexts) @ self.out.T + self.bias).astype(np.float64)
        s -= s.max(1, keepdims=True)
        return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)

    def log10_words(self) -> np.ndarray:
        """Normalised log10 probabilities of each word among those of its class, after each class: CLASSES rows."""
        s = self.before @ self.vectors.T + self.shares
        if not s.shape[1]:
            return s
        starts = np.flatnonzero(np.diff(self.word_class, prepend=-1))
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=s.shape[1]))
        s -= np.maximum.reduceat(s, starts, 1)[:, of]
        return (s - np.log(np.add.reduceat(np.exp(s), starts, 1))[:, of]) / np.float32(np.log(10))


class Adam:
    """Steps along the gradient of a log-likelihood."""

    def __init__(self, model: LogBilinear, names: tuple[str, ...], rate: float = RATE):
        self.model, self.names, self.rate, self.t = model, names, rate, 0
        self.first, self.second = ({n: np.zeros_like(getattr(model, n)) for n in names} for _ in range(2))

    def step(self, grads: tuple[np.ndarray, ...]) -> None:
        self.t += 1
        for n, g in zip(self.names, grads, strict=True):
            self.first[n] += 0.1 * (g - self.first[n])
            self.second[n] += 0.01 * (g * g - self.second[n])
            hat, size = self.first[n] / (1 - 0.9**self.t), self.second[n] / (1 - 0.99**self.t)
            getattr(self.model, n)[...] += self.rate * hat / (np.sqrt(size) + 1e-8)


def train(cells: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = SEED, word_class: np.ndarray | None = None, word_steps: int = WORD_STEPS) -> LogBilinear:
    """Noise-contrastive estimation of both levels from all cells: to tell what followed from NOISE times as much noise by
    frequency."""
    model = LogBilinear(word_class, seed)
    first = cells < CLASSES**3
    if first.any():
        _train_classes(model, cells[first], counts[first].astype(np.float32), steps)
    if not first.all():
        _train_words(model, cells[~first] - CLASSES**3, counts[~first].astype(np.float32), word_steps)
    return model


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _train_classes(model: LogBilinear, cells: np.ndarray, counts: np.ndarray, steps: int) -> None:
    context, target = np.divmod(cells, CLASSES)
    unigram = np.bincount(target, counts, CLASSES) + 1.0
    unigram = (unigram / unigram.sum()).astype(np.float32)
    log_noise, model.bias = np.log(NOISE * unigram), np.log(unigram)
    distinct, at = np.unique(context, return_inverse=True)
    x, y = np.divmod(distinct, CLASSES)
    total = counts.sum()
    seen = np.bincount(at, counts).astype(np.float32) / total
    share = counts / total
    adam, n = Adam(model, ("words", "out", "bias", "near", "far")), len(distinct)
    for _ in range(steps):
        far, near = model.words[x], model.words[y]
        q = far * model.far + near * model.near
        s = q @ model.out.T + model.bias - log_noise
        real = np.zeros((n, CLASSES), np.float32)
        real[at, target] = share
        # of each context and class: what is seen pulls up, and what noise there is pushes down
        sure = _sigmoid(s)
        g = real * (1 - sure) - seen[:, None] * (NOISE * unigram) * sure
        dq = g @ model.out
        words = np.zeros_like(model.words)
        np.add.at(words, x, dq * model.far)
        np.add.at(words, y, dq * model.near)
        adam.step((words, g.T @ q, g.sum(0), (dq * near).sum(0), (dq * far).sum(0)))


def _train_words(model: LogBilinear, cells: np.ndarray, counts: np.ndarray, steps: int) -> None:
    y, w = np.divmod(cells, VOCABULARY)
    n, total = len(model.word_class), counts.sum()
    real = np.zeros((CLASSES, n), np.float32)
    real[y, w] = counts / total
    each = real.sum(0) + 1e-9
    in_class = np.bincount(model.word_class, each, CLASSES)
    unigram = (each / in_class[model.word_class]).astype(np.float32)
    log_noise, model.shares = np.log(NOISE * unigram), np.log(unigram)
    classes = np.unique(model.word_class)
    starts = np.searchsorted(model.word_class, classes)
    adam = Adam(model, ("before", "vectors", "shares"))
    for _ in range(steps):
        grads = np.zeros_like(model.before), np.zeros_like(model.vectors), np.zeros_like(model.shares)
        for a, b in zip(starts, [*starts[1:], n], strict=True):  # a class of words at a time
            s = model.before @ model.vectors[a:b].T + model.shares[a:b] - log_noise[a:b]
            sure = _sigmoid(s)
            mine = real[:, a:b]
            g = mine * (1 - sure) - mine.sum(1, keepdims=True) * (NOISE * unigram[a:b]) * sure
            grads[0][...] += g @ model.vectors[a:b]
            grads[1][a:b] = g.T @ model.before
            grads[2][a:b] = g.sum(0)
        adam.step(grads)


PARTIAL = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare_words array<binary>, rare_counts array<int>"


def partial_scores(docs: DataFrame, id_col: str, text_col: str, lexicon: Lexicon, model: LogBilinear) -> DataFrame:
    """Everything but the counts of words that aren't held: PARTIAL, where ``base`` and ``score`` lack those words'
    log10 (count + 1)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        codes, counts, inside = ClassCodes(lexicon.frequent, lexicon.vectored), lexicon.counts, lexicon.inside()
        table, with_vector = model.log10_words(), lexicon.with_vector()
        smoothed = {w: float(np.log10(n + 1)) for w, n in counts.items()}
        per_token = np.log10(lexicon.tokens + lexicon.distinct + 1.0)
        end, of_vector = smoothed.get(END_WORD, 0.0), np.log10(lexicon.word_counts + 1)
        for batch in slices(batches, "t"):
            raws = texts(batch.column("t"))
            classes, vectors, contexts, sizes, words = class_sequences(raws, codes)
            distinct, at = np.unique(contexts, return_inverse=True)
            logs = np.empty(len(contexts))
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(0, len(distinct) + 4096, 4096))
            for k, (a, b) in zip(range(0, len(distinct), 4096), zip(edges, edges[1:], strict=False), strict=False):
                rows = order[a:b]
                logs[rows] = model.log10_rows(distinct[k : k + 4096])[at[rows] - k, classes[rows]]
            some = vectors >= 0
            logs[~some] -= inside[classes[~some]]
            logs[some] += with_vector[classes[some]] + table[contexts[some] % CLASSES, vectors[some]]
            by_class = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else np.zeros(0)
            known, held, rare = [], [], []
            for x in words:
                found = [*map(smoothed.get, x)]
                missing = Counter(w for w, f in zip(x, found, strict=True) if f is None) if None in found else {}
                rare.append(missing)
                known.append(len(x) + (END_WORD in counts) - sum(missing.values()))
                held.append(sum(f for f in found if f is not None) + end)
            held_ = np.array(held)
            # a word with a vector has its share from that, not from its count
            bare = held_ - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], of_vector[vectors[some]], len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("i"), batch.column("h"), pa.array(sizes), pa.array(known, pa.int64()), pa.array(held_ - sizes * per_token), pa.array(by_class + bare),
                    pa.array([[*x] for x in rare], pa.list_(pa.binary())), pa.array([[*x.values()] for x in rare], pa.list_(pa.int32())),
                ],
                [x.split()[0] for x in PARTIAL.split(", ")],
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("i"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, PARTIAL)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    small_batches(docs.sparkSession)
    training = docs.filter(~held_out(id_col)).select(text_col)
    counts = materialise(word_counts(training, text_col), "counts")
    lexicon = learn_lexicon(counts)
    found = cell_counts(training, text_col, lexicon).toArrow()
    cells, n = found["cell"].to_numpy(), found["n"].to_numpy()
    del found
    give_back()
    model = train(cells, n, word_class=lexicon.word_class)
    del cells, n
    partial = partial_scores(docs, id_col, text_col, lexicon, model).withColumn("row", F.monotonically_increasing_id())
    partial = materialise(partial, "partial")
    rare = partial.select("row", F.explode(F.arrays_zip(F.col("rare_words").alias("w"), F.col("rare_counts").alias("k"))).alias("x")).select("row", "x.w", "x.k")
    more = (
        rare.join(counts, "w")
        .groupBy("row")
        .agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    zero = F.lit(0.0)
    return partial.join(more, "row", "left").select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("logs", zero)).alias("score"),
    )
