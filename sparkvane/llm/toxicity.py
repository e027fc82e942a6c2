"""Toxicity by maximum-scoring segments over token log-odds.

Training, on labelled rows of the training folds only: the number of toxic and of clean
documents that hold each token, over all of these rows; log-odds with an informative
Dirichlet prior (the pooled frequency of the token, weight ``PRIOR``), and its z value.
Tokens with a z of at least ``Z`` and log-odds of at least ``MIN_LOG_ODDS`` carry their
log-odds; every other token costs ``DRIFT``. Both are the same for any number of rows.

Scan: in each text, all maximal-scoring segments are found in linear time. By extreme-value
theory the best chance score of n clean tokens behaves as a Gumbel variable: the number of
segments of score S or more to be expected by chance is about K n exp(-lambda S), where lambda
solves ``sum(p_i exp(lambda s_i)) = 1`` over the clean token frequencies, and K is set by
the tail of the best segments of the clean training texts. Segments with an
expected count below ``SIGNIFICANT`` are reported as passages; a document's evidence is
lambda times the sum of the scores of its significant passages (of its best one otherwise)
minus log n. A logistic curve, fitted on the training rows with the document's own counts
left out, turns evidence into a score from 0 to 1.

Labels, lang, source and doc_id never enter a score. Training takes at most about ``ROWS``
labelled texts, a sample by the hash of the text where there are more; this bounds the
rows that are broadcast and the lexicon. Everything else covers all rows. Scale: one narrow
pass for the counts (pre-aggregated in each task), one for the calibration, one for the
scores; no text is shuffled.

Defined results: null and empty texts have no tokens and get the score of no evidence; rows
labelled null are not used; repeated label rows count by their maximum; copies of a text
with one label count once; tokens of any length count (one longer than ``TOKEN_BYTES`` stands
for itself by its 128-bit hash); with no labelled row
of either class every score is the rate of the class that is there (0 without labels).
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common

THRESHOLD = 0.3
#: Weight of the pooled frequency as a prior, as a share of the observed counts.
PRIOR = 0.1
#: Log-odds count where they are this many standard deviations from none, and at least this large:
#: with many rows, common words differ a little for sure. The level is 1 %, on one side.
Z = 2.326
MIN_LOG_ODDS = 1.5
DRIFT = 0.02
MIN_TOXIC = 2
#: Labelled texts to fit on (a sample by hash where there are more).
ROWS = 100_000
SIGNIFICANT = 0.05
#: K where too few clean texts have a hit to tell it, and the least number of texts in the tail that tells it.
K = 0.1
TAIL = 10
#: Longer tokens are kept as hashes.
TOKEN_BYTES = 64

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def token(word: bytes) -> bytes:
    """A word as the lexicon knows it."""
    if len(word) <= TOKEN_BYTES:
        return word
    from xxhash import xxh3_128_digest

    return b" " + xxh3_128_digest(word)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


class Lexicon:
    """Token document counts of both classes, and the weights that follow from them."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], n_toxic: int, n_clean: int, clean_tokens: float) -> None:
        self.counts, self.n_toxic, self.n_clean = counts, n_toxic, n_clean
        self.k = K
        self.weights = {t: w for t, (a, b) in counts.items() if (w := self.weight(a, b, n_toxic, n_clean)) is not None}
        self.scale = self._lambda(clean_tokens)
        self.hashed = any(t[:1] == b" " for t in counts)

    @staticmethod
    def z_weight(a: float, b: float, n_a: float, n_b: float) -> tuple[float, float]:
        prior = PRIOR * (a + b)
        if a <= 0 or prior <= 0:
            return 0.0, 0.0
        ra = (a + prior) / max(n_a + PRIOR * (n_a + n_b) - a - prior, 0.5)
        rb = (b + prior) / max(n_b + PRIOR * (n_a + n_b) - b - prior, 0.5)
        delta = math.log(ra / rb)
        return delta, delta / math.sqrt(1 / (a + prior) + 1 / (b + prior))

    def weight(self, a: float, b: float, n_a: float, n_b: float) -> float | None:
        delta, z = self.z_weight(a, b, n_a, n_b)
        return delta if z >= Z and delta >= MIN_LOG_ODDS and a >= MIN_TOXIC else None

    def _lambda(self, clean_tokens: float) -> float:
        """The positive root of sum(p exp(lambda s)) = 1 over clean text."""
        if not self.weights:
            return 1.0
        s = np.array(list(self.weights.values()))
        p = np.array([(self.counts[t][1] + 0.5) for t in self.weights]) / max(clean_tokens, 1.0)
        p = p / max(1.0, p.sum() * 2)
        f = lambda x: float((p * np.exp(np.minimum(x * s, 600))).sum() + (1 - p.sum()) * math.exp(-DRIFT * x) - 1)
        low, high = 1e-3, 50.0
        if f(high) < 0:
            return high
        if f(low) > 0:
            return low
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return (low + high) / 2

    def tokens(self, text: str) -> list[bytes]:
        words = words_of(text)
        return [*map(token, words)] if self.hashed else words

    def positive(self, words: list[bytes], toxic: int | None = None) -> list[tuple[int, float]]:
        """(position, weight) of the tokens that count; toxic: leave this document's own count out."""
        if toxic is None:
            return [(i, w) for i, w in enumerate(map(self.weights.get, words)) if w is not None]
        cache: dict[bytes, float | None] = {}
        out = []
        for i, (t, c) in enumerate(zip(words, map(self.counts.get, words), strict=True)):
            if c is not None:
                if t not in cache:
                    cache[t] = self.weight(c[0] - toxic, c[1] - (1 - toxic), self.n_toxic - toxic, self.n_clean - (1 - toxic))
                if cache[t] is not None:
                    out.append((i, cache[t]))
        return out

    @staticmethod
    def once(hits: list[tuple[int, float]], words: list[bytes]) -> list[tuple[int, float]]:
        """The first hit of each token: counts are of documents, so a repetition is no further evidence."""
        seen: set[bytes] = set()
        return [(i, w) for i, w in hits if words[i] not in seen and not seen.add(words[i])]

    def segment_scores(self, hits: list[tuple[int, float]], words: list[bytes]) -> list[float]:
        return [s for _, _, s in segments(self.once(hits, words))]

    def expected(self, score: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-min(self.scale * score, 700))

    def fit_k(self, found: list[tuple[int, list[float]]]) -> None:
        """K from (tokens, segment scores) of clean texts, so that a share of ``SIGNIFICANT`` of them has a
        significant passage; a tail of fewer than ``TAIL`` texts, or of texts without a hit, does not tell it."""
        best = sorted(self.scale * max(scores) - math.log(n) for n, scores in found if scores)
        most = int(SIGNIFICANT * len(found))
        if TAIL <= most <= len(best):
            self.k = -math.log1p(-SIGNIFICANT) * math.exp(min(best[-most], 300.0))

    def evidence(self, scores: list[float], n: int) -> float:
        """Lambda S - log n of the significant passages together (of the best one if none is)."""
        if not scores:
            return NO_EVIDENCE
        total = sum(s for s in scores if self.expected(s, n) < SIGNIFICANT) or max(scores)
        return max(NO_EVIDENCE, min(40.0, self.scale * total - math.log(max(n, 1))))


#: Evidence of a text without a hit, and of a passage that is toxic beyond doubt.
NO_EVIDENCE, CERTAIN = -12.0, 8.0


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, past the last, score), in linear time.

    Between two hits every token costs ``DRIFT``; segments start and end with a hit.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, score before, score through, link
    total, at = 0.0, 0
    for i, w in hits:
        before = total - DRIFT * (i - at)
        total, at = before + w, i + 1
        start, low, j = i, before, len(found) - 1
        while True:
            # the link of a segment is the last one before it that starts lower: all between start at least as high
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, low, total, j))
                break
            start, _, low, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, through - low) for a, b, low, through, _ in found]


class Model:
    def __init__(self, lexicon: Lexicon, intercept: float, slope: float) -> None:
        self.lexicon, self.intercept, self.slope = lexicon, intercept, slope

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))

    def of(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        words = self.lexicon.tokens(text)
        hits = self.lexicon.positive(words)
        if not hits:
            return self.score(NO_EVIDENCE), []
        segs = segments(hits)
        return self.score(self.lexicon.evidence(self.lexicon.segment_scores(hits, words), len(words))), [s for s in segs if self.lexicon.expected(s[2], len(words)) < SIGNIFICANT]


def training_rows(docs: DataFrame, labels: DataFrame, all_folds: bool = False, rows: int = ROWS) -> DataFrame:
    """Texts and labels of the training folds, about ``rows`` at most."""
    wanted = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if not all_folds:
        wanted = wanted.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    # copies of a text are one row of training: else the words of a text copied often look telling
    hashes = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    wanted = common.materialise(hashes.join(wanted, "doc_id").groupBy("h", "g", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", "g"), "labelled")
    share = min(1.0, rows / max(wanted.count(), 1))
    wanted = wanted.where(F.pmod("g", F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("doc_id", "toxic")
    # about ``rows`` pairs of numbers at most
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "toxic")


def fit(rows: DataFrame) -> Model:
    """Fit on (text, toxic) rows."""
    sc = rows.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.binary()), ("a", pa.int64()), ("n", pa.int64())])
        met: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        totals = [0, 0, 0]  # toxic documents, documents, clean tokens

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*met, b" n", b" clean"], pa.binary()), pa.array([*(v[0] for v in met.values()), totals[0], 0], pa.int64()), pa.array([*(v[1] for v in met.values()), totals[1], totals[2]], pa.int64())], schema=schema)
            met.clear()
            totals[:] = [0, 0, 0]
            return out

        for batch in batches:
            for part in common.text_blocks(batch):
                for text, toxic in zip(common.texts_of(part), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    totals[0] += toxic
                    totals[1] += 1
                    totals[2] += 0 if toxic else len(words)
                    for t in set(words):
                        c = met[t if len(t) <= TOKEN_BYTES else token(t)]
                        c[0] += toxic
                        c[1] += 1
                if len(met) > 300_000:
                    yield flush()
        yield flush()

    counts = common.materialise(rows.mapInArrow(common.tidy(count), "token binary, a long, n long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where((F.col("a") >= MIN_TOXIC) | F.col("token").isin(b" n", b" clean")), "toxic-counts")
    special = {bytes(r["token"]): r for r in counts.where(F.col("token").isin(b" n", b" clean")).collect()}
    n_toxic = special[b" n"]["a"] if b" n" in special else 0
    n_all = special[b" n"]["n"] if b" n" in special else 0
    clean_tokens = special[b" clean"]["n"] if b" clean" in special else 0
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        return Model(Lexicon({}, n_toxic, n_clean, clean_tokens), 30.0 if n_toxic else -30.0, 0.0)
    # the z of the training rows without any one document is at least near this looser one
    a, b = F.col("a"), F.col("n") - F.col("a")
    prior = F.lit(PRIOR) * F.col("n")
    delta = F.log((a + prior) / F.greatest(F.lit(n_toxic + PRIOR * n_all) - a - prior, F.lit(0.5))) - F.log((b + prior) / F.greatest(F.lit(n_clean + PRIOR * n_all) - b - prior, F.lit(0.5)))
    z = delta / F.sqrt(1 / (a + prior) + 1 / (b + prior))
    top = counts.where(~F.col("token").isin(b" n", b" clean")).where((z >= Z * 0.6) & (delta >= MIN_LOG_ODDS * 0.6)).orderBy("token")
    lexicon = Lexicon({bytes(r["token"]): (r["a"], r["n"] - r["a"]) for r in top.collect()}, n_toxic, n_clean, clean_tokens)
    sent = sc.broadcast(lexicon)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for batch in batches:
            for part in common.text_blocks(batch):
                labels = part.column(1).to_pylist()
                sizes, scores = [], []
                for text, toxic in zip(common.texts_of(part), labels, strict=True):
                    words = lex.tokens(text)
                    sizes.append(len(words))
                    scores.append(lex.segment_scores(lex.positive(words, toxic), words))
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["n", "scores", "toxic"])

    # a row for each of the training rows, whose number has a bound
    found = [(r["n"], r["scores"], r["toxic"]) for r in rows.mapInArrow(common.tidy(calibrate), "n long, scores array<double>, toxic int").collect()]
    lexicon.fit_k([(n, s) for n, s, toxic in found if not toxic])
    # with few rows, no token may stand once its own row is left out: one row of each kind says what evidence means
    known = [(CERTAIN, 1, 1), (NO_EVIDENCE, 0, 1)]
    intercept, slope = logistic(known + [(lexicon.evidence(s, n), toxic, 1) for n, s, toxic in found])
    return Model(lexicon, intercept, slope)


def logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak ridge on the slope."""
    x, y, n = (np.array(v, float) for v in zip(*sorted(bins), strict=True))
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n * (y - p)).sum() - 1e-3 * a, (n * (y - p) * x).sum() - 1e-1 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return a, max(b, 0.0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the significant passages (in words) of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", passage)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in common.text_blocks(batch):
                found = [m.of(t) for t in common.texts_of(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([s for s, _ in found], pa.float64()),
                        pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                        pa.array([[{"start": a, "stop": b, "score": s} for a, b, s in segs] for _, segs in found], passage),
                    ],
                    schema=schema,
                )

    return docs.select("doc_id", "text").mapInArrow(common.tidy(run), "doc_id long, score double, predicted int, passages array<struct<start:int,stop:int,score:double>>")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns; one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_blocks(batch):
                yield part.filter(pa.array([sent.value.of(t)[0] < threshold for t in common.texts_of(part)], pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from the training folds of ``labels``."""
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(training_rows(docs, common.read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return score(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
