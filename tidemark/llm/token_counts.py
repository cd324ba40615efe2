"""Operator 8: token counts without token ids.

A first pass cuts documents into pre-tokens and counts, for each distinct one, how many documents hold it; each distinct pre-token of the corpus
is then counted once by the tokenizer library. A second pass makes every document's pre-token frequencies and joins them to that
table: the HEAVY_TOKENS pre-tokens that most documents hold (bounded in number and, by keys, in bytes) are joined inside the task, all others by a
shuffle on the pre-token, so that no hot pre-token meets in one task. Pieces times frequency are summed for each document; no id list of a
document is built. Pre-tokens over LONG_TOKEN characters are joined by their SHA-256.

Special tokens' own strings inside a text count as the library counts them by default: one token each, splitting the text around them.

Null texts count as empty (0 tokens). Repeated rows are counted each; an empty table gives an empty result; other columns are kept, and
columns named as the output columns are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter as Frequencies
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, table, texts_of, written

#: Pre-tokens that are joined inside tasks; characters beyond which a pre-token is named by its hash; distinct pre-tokens that a task sums before a shuffle.
HEAVY_TOKENS, LONG_TOKEN, PART_TOKENS = 200_000, 48, 200_000
#: The split of the byte-level pre-tokenizer (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Token counts of one tokenizers file with a byte-level pre-tokenizer."""

    def __init__(self, file: str):
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(Path(file).read_text())
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only a plain byte-level pre-tokenizer is supported")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match plainly")
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.split = regex.compile(SPLIT).findall
        self.tokenizer = Tokenizer.from_file(file)

    def pre_tokens(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens a text spells, and its pre-tokens in order."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1, [w for p in parts for w in self.split(p)]
        return 0, self.split(text)

    def pieces(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(e) for a in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch(words[a : a + 20_000], add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the tables give them: distinct pre-tokens counted once, times their frequencies."""
        made = [self.pre_tokens(t) for t in texts]
        words = sorted({w for _, found in made for w in found})
        of = dict(zip(words, self.pieces(words), strict=True))
        return [n + sum(of[w] * k for w, k in Frequencies(found).items()) for n, found in made]


@functools.lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def key(word: str) -> str:
    """What names a pre-token in the tables."""
    return word if len(word) <= LONG_TOKEN else "\0" + hashlib.sha256(word.encode()).hexdigest()


def vocabulary(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """token (its key), docs, pieces of each distinct pre-token of docs: how many documents hold it, and how many pieces it has."""
    bounded_batches(docs.sparkSession)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, found = counter(file), Frequencies()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "docs"])
            found.clear()
            return made

        for batch in batches:
            for t in texts_of(batch, text):
                found.update(set(c.pre_tokens(t)[1]))
                if len(found) > PART_TOKENS:
                    yield out()
        yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key, words), pa.string()), batch.column("docs"), pa.array(counter(file).pieces(words), pa.int64())], names=["token", "docs", "pieces"])

    distinct = docs.select(text).mapInArrow(held, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return written(distinct.mapInArrow(counted, "token string, docs long, pieces long"), "vocabulary")


def count_tokens(docs: DataFrame, file: str, text: str = "text", limit: int = 1024, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit); without the text, if it isn't to be carried through the join."""
    bounded_batches(docs.sparkSession)
    known = vocabulary(docs, file, text)
    top = known.orderBy(F.desc("docs"), "token").limit(HEAVY_TOKENS).select("token", "pieces").toArrow()
    heavy = dict(zip(top.column("token").to_pylist(), top.column("pieces").to_pylist(), strict=True))
    new = [c for c in ("n_bytes", "n_tokens", "over_limit") if c != text]
    kept = docs.drop(*new)
    names = [c for c in kept.columns if keep_text or c != text]
    own = "_"  # a prefix that no column has
    while any(c.startswith(own) for c in names):
        own += "_"
    fields = [f for f in kept.schema.fields if f.name in names]
    rest_type = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    longs = [T.StructField(f"{own}{c}", T.LongType()) for c in ("row", "bytes", "known")]
    schema = T.StructType([*fields, *longs, T.StructField(f"{own}rest", rest_type)])
    entry = pa.struct([("token", pa.string()), ("n", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row = counter(file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(texts := texts_of(batch, text), 2_000_000):
                sums, rest = [], []
                for t in texts[a:b]:
                    n, found = c.pre_tokens(t)
                    left = []
                    for w, k in Frequencies(found).items():
                        if (p := heavy.get(w if len(w) <= LONG_TOKEN else key(w))) is None:
                            left.append({"token": key(w), "n": k})
                        else:
                            n += p * k
                    sums.append(n)
                    rest.append(left)
                part = batch.slice(a, b - a)
                made = [pa.array(range(row, row + b - a), pa.int64()), pa.array([len(t.encode()) for t in texts[a:b]], pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(entry))]
                row += b - a
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[f.name for f in schema])

    made = written(kept.mapInArrow(frequencies, schema), "frequencies")
    rest = made.select(F.col(f"{own}row").alias("row"), F.explode(f"{own}rest").alias("e")).select("row", "e.token", "e.n")
    rest = rest.join(known.select("token", "pieces"), "token").groupBy(F.col("row").alias(f"{own}row")).agg(F.sum(F.col("n") * F.col("pieces")).alias(f"{own}others"))
    tokens = F.col(f"{own}known") + F.coalesce(f"{own}others", F.lit(0))
    columns = {"n_bytes": F.col(f"{own}bytes"), "n_tokens": tokens, "over_limit": tokens > limit}
    return made.drop(f"{own}rest").join(rest, f"{own}row", "left").select(*names, *(columns[c].alias(c) for c in new))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document under byte_bpe_50k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", F.col("n_bytes"), "n_tokens", "over_limit")
