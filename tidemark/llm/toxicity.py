"""Operator 3: toxicity by Levenshtein automata over a lexicon trie, scored in context windows.

Learning. From a bounded sample of labelled rows (SAMPLE_ROWS, those of the smallest hash of doc_id) a distributed count finds, for words
and word beginnings, how many toxic and other documents hold them. Words far more frequent in toxic documents become lexicon words;
beginnings that many such words share become stems, which match every word that begins with them. The sample bounds the lexicon.
A second pass over the sample lists which kinds of matches (entry, edits, quoted or plain) each document holds. Their weights are the causes of a noisy-or
with the base rate as its leak, found by expectation maximisation: a match that other words reach by chance, or that stands beside a
plain term that explains the label, earns little. Kinds that the sample doesn't show have the weight of their family: matches alike whose entries
begin with the same FAMILY_LETTERS, or all edits in stems and short entries.

Matching. The lexicon is a trie. The automaton of all words within one edit of an entry is intersected with it lazily: a state is a set
of (trie node, edits), steps are kept (letters outside the lexicon's are one), so a word costs a few look-ups and most words die after two letters. Stems take
one edit as well, before any ending. Words under SHORT_LETTERS letters match without edits only.

Context. A match between quotation marks (paired in one scan of the text, at any distance) or near a word of reporting is counted as quoted, and has a
weight of its own, which is low unless labels say otherwise. Matches within WINDOW words of each other raise each other. A text's score is the noisy-or of
the kinds it holds, each by its best match, over the base rate.

Null and empty texts have no match and get the base rate. Repeated rows are scored each; with no usable label the score is 0 for all;
an empty table gives an empty result; other columns are kept, columns named as output columns are replaced. A null label is no label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_PARTS, bounded_batches, fold, sampled_ids, table, texts_of, written

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 20_000
#: An entry needs so many toxic documents and different words before it (this many and this share of the toxic documents; copies of one
#: text show the same words before it), and to be so many times likelier in toxic ones.
LEAST_DOCS, LEAST_SHARE, LEAST_LIFT = 5, 0.005, 25.0
#: Letters of stems; words that a stem must explain.
STEM_LETTERS, STEM_WORDS = range(4, 9), 4
FUZZY_LETTERS, SHORT_LETTERS, WINDOW = 5, 4, 12
#: Letters that name a family of entries; rounds of fitting, and documents that a family or the first guess counts as.
FAMILY_LETTERS, ROUNDS, STRENGTH = 4, 300, 1.0
#: Words of reporting, in the corpus' languages (a fixed list of this operator).
REPORTING = frozenset("said says wrote writes called calls quoted quote claimed according sagte sagt schrieb nannte zitiert laut dit disait écrit appelé selon cite dijo dice escribió llamó según cita".split())
MARKS = re.compile("[\"“”«»„]")
WORD = re.compile(r"[^\W_][\w@$]*")
PREDICTED_AT = 0.3


class FuzzyTrie:
    """The words within one edit of a lexicon: edit automata of all words at once, intersected with the trie of entries."""

    def __init__(self, entries: Iterable[tuple[str, bool]], least: int | None = None, stems: bool = False):
        """Entries of `least` letters (FUZZY_LETTERS) and more take an edit; stems too, if wanted."""
        self.least, self.edited = FUZZY_LETTERS if least is None else least, stems
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.deep: list[int] = [0]  # the longest entry through a node, in letters
        for word, stem in sorted(entries):
            at = 0
            for c in word:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                    self.deep.append(0)
                at = self.arcs[at][c]
                if self.edited or not stem:
                    self.deep[at] = max(self.deep[at], len(word))
            self.ends[at] = (word, stem)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple | None] = []
        self.begun: list[tuple | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._deletions({(0, 0)}))
        self.known: dict[str, tuple | None] = {}
        self.letters = {c for arcs in self.arcs for c in arcs}

    def _deletions(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the nodes reached by leaving out a letter of the entry, where an edit is left."""
        more = {(child, 1) for node, edits in pairs if edits == 0 for child in self.arcs[node].values() if self.deep[child] >= self.least}
        return frozenset(pairs | {p for p in more if (p[0], 0) not in pairs})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            ends = sorted((edits, *self.ends[node]) for node, edits in pairs if self.ends[node])
            self.found.append(next(((w, e, s) for e, w, s in ends if not s and (e == 0 or len(w) >= self.least)), None))
            self.begun.append(next(((w, e, s) for e, w, s in ends if s and (e == 0 or self.edited and len(w) >= self.least)), None))
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            if c in self.arcs[node]:
                child = self.arcs[node][c]
                if edits == 0 or self.deep[child] >= self.least:
                    after.add((child, edits))
            if edits == 0 and (node == 0 or self.deep[node] >= self.least):
                after.add((node, 1))  # a letter too many
                after |= {(child, 1) for child in self.arcs[node].values() if self.deep[child] >= self.least}
        exact = {n for n, e in after if e == 0}
        to = self._state(self._deletions({(n, e) for n, e in after if e == 0 or n not in exact}))
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(entry, edits, whether it's a stem) of the best entry that matches, or None."""
        if word in self.known:
            return self.known[word]
        state, stem = self.start, None
        for c in word:
            if c not in self.letters:
                c = ""
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
            begun = self.begun[state]
            if begun and (stem is None or begun[1] <= stem[1]):
                stem = begun
        best = self.found[state]
        if stem and (best is None or best[1] > stem[1]):
            best = stem
        if len(word) <= 64:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[word] = best
        return best


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks, in order. A straight mark opens before a letter or sign and closes behind one; a mark without a partner is none."""
    spans, begun = [], {}
    for m in MARKS.finditer(text):
        at, c = m.start(), m[0]
        if c == '"':
            if '"' in begun and not text[at - 1].isspace() and at - 1 > begun['"']:
                spans.append((begun.pop('"'), at + 1))
            elif not text[at + 1 : at + 2].isspace():
                begun['"'] = at
        elif c in "„«":
            begun[c] = at
        elif c == "»":
            if "«" in begun:
                spans.append((begun.pop("«"), at + 1))
        elif "„" in begun:
            spans.append((begun.pop("„"), at + 1))
        elif c == "“":
            begun["“"] = at
        elif "“" in begun:
            spans.append((begun.pop("“"), at + 1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):  # spans of several kinds of marks can overlap
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


Kind = tuple[str, int, bool]


@dataclass
class Lexicon:
    """What is learned: entries, the weight of each kind of match and of each family of kinds, and the base rate."""

    entries: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[Kind, float] = field(default_factory=dict)
    base: float = 0.0
    families: dict[Kind, float] = field(default_factory=dict)
    _trie: FuzzyTrie | None = None
    _stems: frozenset[str] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None}

    def matches(self, text: str) -> list[tuple[int, str, int, bool]]:
        """(word number, entry, edits, quoted) of each match in a text."""
        if self._trie is None:
            self._trie = FuzzyTrie(self.entries, SHORT_LETTERS, stems=True)
        trie, low = self._trie, text.lower()
        words = WORD.findall(low)
        if not any(map(trie.match, set(words))):
            return []
        spans = quotations(low)
        starts = np.array([a for a, _ in spans])
        out = []
        for k, m in enumerate(WORD.finditer(low)):
            if found := trie.match(m[0]):
                at = int(np.searchsorted(starts, m.start(), "right")) - 1 if spans else -1
                quoted = at >= 0 and m.end() <= spans[at][1] or not REPORTING.isdisjoint(words[max(0, k - 4) : k])
                out.append((k, found[0], found[1], quoted))
        return out

    def family(self, kind: Kind) -> Kind:
        return ("" if self.is_loose(kind[0], kind[1]) else kind[0][:FAMILY_LETTERS], *kind[1:])

    def guess(self, kind: Kind) -> float:
        """The weight of a kind in whose family the sample shows none."""
        return 0.0 if self.is_loose(kind[0], kind[1]) else 0.1 if kind[2] else 0.5

    def weight(self, entry: str, edits: int, quoted: bool) -> float:
        kind = entry, edits, quoted
        known = self.weights.get(kind)
        return known if known is not None else self.families.get(self.family(kind), self.guess(kind))

    def is_loose(self, entry: str, edits: int) -> bool:
        """Whether a match is an edit in a stem or a short entry, which other words reach by chance."""
        if self._stems is None:
            self._stems = frozenset(e for e, stem in self.entries if stem)
        return edits > 0 and (len(entry) < FUZZY_LETTERS or entry in self._stems)

    def assess(self, text: str) -> tuple[float, int]:
        """Score, 0 to 1: the noisy-or of the base rate and the kinds of matches, each raised by neighbours in the window; and the number of matches."""
        found = self.matches(text)
        if not found:
            return self.base, 0
        best: dict[Kind, float] = {}
        for i, (k, *kind) in enumerate(found):
            w = self.weight(*kind)
            near = any(abs(found[j][0] - k) <= WINDOW for j in (i - 1, i + 1) if 0 <= j < len(found))
            best[tuple(kind)] = max(best.get(tuple(kind), 0.0), w + (1.0 - w) * 0.25 * w if near else w)
        rest = 1.0 - self.base
        for w in best.values():
            rest *= 1.0 - w
        return float(min(1.0, max(0.0, 1.0 - rest))), len(found)

    def score(self, text: str) -> float:
        return self.assess(text)[0]


_FEATURES = T.StructType([T.StructField("stem", T.BooleanType()), T.StructField("word", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each word, and each beginning of a word; in parts, to be summed."""
    counts: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0])

    def out() -> pa.RecordBatch:
        keys = list(counts)
        made = [[k[0] for k in keys], [k[1] for k in keys], [counts[k][0] for k in keys], [counts[k][1] for k in keys]]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(made, (pa.bool_(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=_FEATURES.fieldNames())

    for batch in batches:
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
            for w in words:
                counts[False, w][0 if toxic else 1] += 1
            for b in {w[:n] for w in words for n in STEM_LETTERS if len(w) > n}:
                counts[True, b][0 if toxic else 1] += 1
        if len(counts) > 150_000:
            yield out()
    if counts:
        yield out()


def _words_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the word before it."""
    for batch in batches:
        pairs = {(w, v) for t in texts_of(batch) for words in [WORD.findall(t.lower())] for v, w in zip(["", *words], words, strict=False) if len(w) >= 3}
        rows = sorted(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["word", "prior"])


def learn(labelled: DataFrame) -> Lexicon:
    """A lexicon from rows of text and toxic (0 or 1); at most SAMPLE_ROWS are meant to come."""
    bounded_batches(labelled.sparkSession)
    sample = written(labelled.where("toxic is not null").select("text", "toxic"), "toxic-sample")
    totals = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    n_pos, n_neg = totals.get(True, 0), totals.get(False, 0)
    if not n_pos:
        return Lexicon()
    counts = written(sample.mapInArrow(_feature_counts, _FEATURES).groupBy("stem", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 1 and neg <= pos").coalesce(SAMPLE_PARTS), "toxic-counts")
    least = max(LEAST_DOCS, int(LEAST_SHARE * n_pos))
    lift = (F.col("pos") + 0.5) / (F.col("neg") + 0.5) * ((n_neg + 1.0) / (n_pos + 1.0))
    good = counts.where((F.col("pos") >= least) & (lift >= LEAST_LIFT)).withColumn("lift", lift)
    before = written(sample.where("toxic = 1").mapInArrow(_words_before, "word string, prior string").distinct().coalesce(SAMPLE_PARTS), "toxic-contexts")
    contexts = before.groupBy("word").agg(F.count("*").alias("contexts"))
    # A stem explains several words that stand in toxic documents alone, none of which makes up most of it.
    begun = counts.where("not stem and neg = 0").select("word", "pos", F.explode(F.array_distinct(F.array(*(F.substring("word", 1, n) for n in STEM_LETTERS)))).alias("stem_of"))
    varied = before.join(begun.select("word", "stem_of"), "word").groupBy("stem_of").agg(F.countDistinct("prior").alias("contexts"))
    begun = begun.groupBy("stem_of").agg(F.count("*").alias("n_words"), F.max("pos").alias("most")).join(varied, "stem_of").withColumnRenamed("stem_of", "word")
    stems = good.where("stem").join(begun, "word").where((F.col("contexts") >= least) & (F.col("n_words") >= STEM_WORDS) & (F.col("most") < 0.6 * F.col("pos")))
    support = {r.word: r.pos for r in stems.orderBy(F.desc("lift"), "word").collect()}
    chosen: list[tuple[str, bool]] = []
    for word in sorted(support, key=lambda w: (-len(w), w)):  # the longest beginning that keeps nearly all that a shorter one explains
        shorter = [support[word[:n]] for n in STEM_LETTERS if n < len(word) and word[:n] in support]
        if support[word] >= 0.95 * max(shorter, default=0) and not any(s.startswith(word) and support[s] >= 0.95 * support[word] for s, _ in chosen):
            chosen.append((word, True))
    for r in good.where("not stem").join(contexts, "word").where(F.col("contexts") >= least).orderBy(F.desc("lift"), "word").collect():
        if (r.word, True) not in chosen:
            chosen.append((r.word, False))
    lexicon = Lexicon(chosen)
    return _weighed(sample, lexicon, n_pos, n_neg)


def noisy_or(documents: list[tuple[list, int, int]], guess: dict, leak: float) -> tuple[dict, float]:
    """Weights of causes and the leak, by expectation maximisation over (causes, toxic documents, other documents); each cause starts at its guess, which
    counts as STRENGTH documents."""
    causes = sorted({c for found, _, _ in documents for c in found})
    number = {c: k for k, c in enumerate(causes)}
    rows = np.repeat(np.arange(len(documents)), [len(found) for found, _, _ in documents])
    columns = np.array([number[c] for found, _, _ in documents for c in found], dtype=np.int64)
    pos, neg = (np.array([d[k] for d in documents], dtype=float) for k in (1, 2))
    prior = np.array([guess[c] for c in causes])
    shown = np.bincount(columns, (pos + neg)[rows], len(causes)) + STRENGTH
    w, total = np.clip(prior, 0.01, 0.99), (pos + neg).sum()
    for _ in range(ROUNDS):
        none = np.exp(np.bincount(rows, np.log1p(-np.minimum(w, 1 - 1e-9))[columns], len(documents))) * (1.0 - leak)
        each = pos / np.maximum(1.0 - none, 1e-12)
        w = (np.bincount(columns, each[rows] * w[columns], len(causes)) + STRENGTH * prior) / shown
        leak = (leak * each.sum() + 0.5) / (total + 1.0)
    return dict(zip(causes, w.tolist(), strict=True)), float(leak)


def _weighed(sample: DataFrame, lexicon: Lexicon, n_pos: int, n_neg: int) -> Lexicon:
    """Weights of the kinds of matches, from a second pass over the sample; what comes to the driver has a row for each document of the sample at most."""
    schema = "kinds array<struct<entry:string,edits:int,quoted:boolean>>, toxic boolean"
    entry = pa.list_(pa.struct([("entry", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [[dict(zip(("entry", "edits", "quoted"), k, strict=True)) for k in sorted({m[1:] for m in lexicon.matches(t)})] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, entry), pa.array([t == 1 for t in batch.column("toxic").to_pylist()])], names=["kinds", "toxic"])

    found = sample.mapInArrow(run, schema).groupBy("kinds").agg(F.sum(F.col("toxic").cast("long")).alias("pos"), F.count("*").alias("n"))
    documents = [([(k.entry, k.edits, k.quoted) for k in r.kinds], r.pos, r.n - r.pos) for r in found.collect()]
    leak = n_pos / (n_pos + n_neg) / 2
    of = {k: lexicon.family(k) for kinds, _, _ in documents for k in kinds}
    lexicon.families, _ = noisy_or([(sorted({of[k] for k in kinds}), p, n) for kinds, p, n in documents], {of[k]: lexicon.guess(k) for k in of}, leak)
    lexicon.weights, lexicon.base = noisy_or(documents, {k: lexicon.families[of[k]] if k[1] else lexicon.guess(k) for k in of}, leak)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", names: tuple[str, str] = ("score", "n_matches")) -> DataFrame:
    """docs with score and n_matches, under other names if asked for."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*set(names) - {text})
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.assess(t) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted, rows: int) -> DataFrame:
    """Texts of at most `rows` labelled rows for which `wanted` (a condition on doc_id) holds; their ids are broadcast, bounded by rows."""
    ids = sampled_ids(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(wanted).groupBy("doc_id").agg(F.max(label).alias(label)), "doc_id", rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", label)


def learned(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of the labelled rows outside the held-out fold."""
    return learn(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, SAMPLE_ROWS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), n_matches of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"), "n_matches")
