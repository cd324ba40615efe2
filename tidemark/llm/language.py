"""Operator 5: languages of texts, and of spans inside them.

Learning. A bounded sample of documents per language (SAMPLE_PER_LANG, those of the smallest hash of doc_id outside the held-out fold)
gives, for each language, smoothed log shares of hashed letter trigrams (with word ends) and the Unicode scripts its words use. The more languages,
the fewer buckets a language has (from MODEL_NUMBERS / BUCKETS = 64 languages on), so that any number of them makes a bounded model.

Labelling. Letters form words. A word's script range narrows its candidates to the languages that use that script; the others lose
SCRIPT_PENALTY. Its scores are the sums of its trigrams' log shares, held within CLIP of the best one. A Viterbi pass over the words
of a text, with SWITCH as the price of changing the language, labels each word; runs of a label are spans. All texts of a batch step
through the words side by side in NumPy arrays. The text's language is the one with most letters; the score is its share of the letters.

Null and empty texts and texts without a letter get `und`, score 0. Ties go to the language that sorts first. Repeated rows are labelled
each. Without a single row to learn from every text is `und`; an empty table gives an empty result; other columns are kept, columns named
as output columns are replaced. Null languages aren't learned from.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_PARTS, bounded_batches, fold, mixed, slices, table, texts_of, written

#: Documents learned from, per language; trigram buckets at most and at least, and the numbers of a model that buckets of many languages are halved for.
SAMPLE_PER_LANG, BUCKETS, LEAST_BUCKETS, MODEL_NUMBERS = 600, 1 << 16, 1 << 6, 1 << 22
#: In nats: the price of a switch, the most a word can tell against a language, the price of a foreign script.
SWITCH, CLIP, SCRIPT_PENALTY = 9.0, 8.0, 30.0
#: Scripts by ranges of code points (fixed values of Unicode): Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai, Hangul, kana, Han.
SCRIPTS = ((0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0xDFF), (0xE00, 0xE7F), (0xAC00, 0xD7AF), (0x3040, 0x30FF), (0x4E00, 0x9FFF))
UND = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_SCRIPT = np.full(0x10000, len(SCRIPTS), dtype=np.int8)
for _k, (_a, _b) in enumerate(SCRIPTS):
    _SCRIPT[_a : _b + 1] = _k


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts joined by line ends: code points, starts and ends of words (runs of letters), and the start of each text.

    Characters beyond U+FFFF count as letters if Unicode says so; their trigrams hash by code point like any other.
    """
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    if points.size and points.max() > 0xFFFF:
        far = np.nonzero(points > 0xFFFF)[0]
        letter[far] = [chr(c).isalpha() for c in points[far]]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    return points, np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], np.concatenate([[0], np.cumsum(lengths)])


def trigrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter of the words (neighbours outside the word count as a space), and the word of each."""
    sizes = ends - starts
    word = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    low = points.copy()
    up = (low >= 0x41) & (low <= 0x5A) | (low >= 0xC0) & (low <= 0xDE) & (low != 0xD7) | (low >= 0x410) & (low <= 0x42F) | (low >= 0x391) & (low <= 0x3A9)
    low[up] += 32
    here = low[at].astype(np.uint64)
    before = np.where(at == starts[word], 32, low[np.maximum(at - 1, 0)]).astype(np.uint64)
    after = np.where(at == ends[word] - 1, 32, low[np.minimum(at + 1, len(low) - 1)]).astype(np.uint64)
    return (mixed(before << np.uint64(42) | here << np.uint64(21) | after) & np.uint64(buckets - 1)).astype(np.int64), word


@dataclass
class Model:
    """Languages in order, log shares (bucket by language), and which language uses which script."""

    langs: list[str] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    uses: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS) + 1, 0), bool))

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        bucket, _ = trigrams(points, starts, ends, len(self.logs))
        sizes = ends - starts
        scores = np.add.reduceat(self.logs[bucket], np.cumsum(sizes) - sizes, axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        np.maximum(scores, -CLIP, out=scores)
        fits = self.uses[_SCRIPT[np.minimum(points[starts], 0xFFFF)]]
        fits |= ~fits.any(axis=1, keepdims=True)  # no language uses the script: all stay
        return scores - SCRIPT_PENALTY * ~fits

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: starts and ends of its words, and the number of each word's language."""
        points, starts, ends, bounds = words_of(texts)
        scores = self.word_scores(points, starts, ends)
        first = np.searchsorted(starts, bounds)
        labels = viterbi(scores, first[:-1], np.diff(first))
        return [(starts[a:b] - o, ends[a:b] - o, labels[a:b]) for a, b, o in zip(first[:-1], first[1:], bounds[:-1], strict=True)]


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best label of each row of scores, where rows first[i] .. first[i] + counts[i] form a sequence; all sequences step together."""
    n = scores.shape[0]
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    came = np.zeros(scores.shape, dtype=kind)
    labels = np.zeros(n, dtype=kind)
    if not n:
        return labels
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left")  # sequences longer than t
    own = np.arange(scores.shape[1], dtype=kind)
    best = np.zeros((int(active[0]), scores.shape[1]), np.float64)
    best[:] = scores[first[: active[0]]]
    for t in range(1, len(active)):
        k = int(active[t])
        rows, old = first[:k] + t, best[:k]
        top = old.argmax(axis=1)
        switched = np.take_along_axis(old, top[:, None], 1) - SWITCH
        stays = old >= switched
        came[rows] = np.where(stays, own, top[:, None])
        best[:k] = np.where(stays, old, switched) + scores[rows]
    at = best.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        rows = first[:k] + t
        labels[rows] = at[:k]
        if t:
            at[:k] = came[rows, at[:k]]
    return labels


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model from at most about per_lang texts of each language of docs (rows of the smallest hashes of doc_id)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}  # as many as there are languages
    if not counts:
        return Model()
    langs = sorted(counts)
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * len(langs) > MODEL_NUMBERS:
        buckets //= 2
    # An even share of each language, by hash; the share is what bounds the sample.
    shares = spark.createDataFrame([(k, min(1.0, per_lang / counts[k])) for k in langs], "lang_ string, share_ double")
    unit = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    sample = usable.join(F.broadcast(shares), F.col(lang) == F.col("lang_")).where(unit < F.col("share_")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = written(sample.mapInArrow(functools.partial(_counts, buckets=buckets), "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).coalesce(SAMPLE_PARTS), "language").toPandas()
    number = {k: i for i, k in enumerate(langs)}
    grams, scripts = np.zeros((buckets, len(langs))), np.zeros((len(SCRIPTS) + 1, len(langs)))
    column = rows["lang"].map(number).to_numpy()
    for kind, into in ((0, grams), (1, scripts)):
        which = (rows["kind"] == kind).to_numpy()
        into[rows["bucket"].to_numpy()[which], column[which]] = rows["n"].to_numpy()[which]
    logs = np.log(grams + 0.3) - np.log(grams.sum(axis=0) + 0.3 * buckets)
    return Model(langs, logs.astype(np.float32), scripts >= 0.02 * np.maximum(1, scripts.sum(axis=0)))


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Trigrams (kind 0) and scripts of words (kind 1) of each language in a task."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = texts_of(batch), batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
            for a, b in slices(own, 500_000):
                points, starts, ends, _ = words_of(own[a:b])
                if len(starts):
                    grams[lang] = grams.get(lang, 0) + np.bincount(trigrams(points, starts, ends, buckets)[0], minlength=buckets)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(_SCRIPT[np.minimum(points[starts], 0xFFFF)], minlength=len(SCRIPTS) + 1)
    for kind, found in ((0, grams), (1, scripts)):
        for lang, n in found.items():
            bucket = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket)), pa.array(np.full(len(bucket), kind, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket].astype(np.int64))], names=["lang", "kind", "bucket", "n"])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def label(docs: DataFrame, model: Model, text: str = "text", spans: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (under other names if asked for), and if asked for, spans: (start, end, language) in code points."""
    spark = docs.sparkSession
    bounded_batches(spark)
    extra = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), *([T.StructField("spans", _SPANS)] * spans)]
    kept = docs.drop(*{f.name for f in extra} - {text})
    sent = spark.sparkContext.broadcast(model)  # MODEL_NUMBERS floats, or LEAST_BUCKETS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            preds, scores, runs = [], [], []
            texts = texts_of(batch, text)
            for a, b in slices(texts, 500_000):
                for starts, ends, labels in m.label(texts[a:b]) if m.langs else [((), (), ())] * (b - a):
                    letters = np.bincount(labels, weights=ends - starts, minlength=1) if len(starts) else np.zeros(1)
                    top = int(letters.argmax())
                    preds.append(m.langs[top] if len(starts) else UND)
                    scores.append(float(letters[top] / letters.sum()) if len(starts) else 0.0)
                    if spans:
                        cut = np.nonzero(np.diff(labels))[0] if len(starts) else []
                        ranges = zip([0, *(c + 1 for c in cut)], [*cut, len(starts) - 1], strict=True) if len(starts) else []
                        runs.append([{"start": int(starts[x]), "end": int(ends[y]), "lang": m.langs[labels[x]]} for x, y in ranges])
            made = [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                made.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in extra)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *extra]))


def learned(docs: DataFrame) -> Model:
    """The model of the rows outside the held-out fold."""
    return learn(docs.where(fold(F.col("doc_id"), 5) != 0))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    labelled = label(docs.select("doc_id", "text"), learned(docs.select("doc_id", "text", "lang")))
    return labelled.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
