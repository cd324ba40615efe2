"""Operator 6: SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into four machines. The normaliser writes the dummy prefix, escapes spaces, and leaves out extra ones where the model asks for it.
The pieces are a trie whose arcs read characters; the end of a piece is an arc back to the root that writes the piece and weighs its negated
score. The byte fallback is a loop on characters that no piece spells alone; it writes byte pieces and weighs more than any piece. The neighbours say
which piece may follow which: a unigram model's have one state and forbid nothing; those of a merge-trained model ("BPE"), which isn't a sum of
piece weights, have a state for each last piece, and an arc for each pair that merging the pair's own text leaves as it is; every other pair
weighs infinity. Such arcs are made when first asked for.

Each input is composed with the machines: a lattice whose states are a position in the text and a state of the neighbours, and whose arcs are pieces
and bytes with their weights. Its cheapest path in the tropical semiring (min, +) is the encoding. Under the neighbours of a merge-trained
model one path is left for each beginning of a text, and that is what the library's merging gives.

Text is cut into units before composing (a run of spaces with the characters up to the next space; line ends alone when no piece
holds them). No piece crosses such a cut - that is checked when the model is compiled - so units can be encoded apart, and a bounded cache
of units keeps their paths.

Nulls and empty texts encode to an empty list and decode to an empty text. Repeated rows are encoded each; other columns are kept; an
empty table gives an empty table with the same schema. A column named as an output column is replaced.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, table, texts_of

MARK = "▁"
#: Units that one worker keeps; the cache starts anew when it is full.
CACHE_UNITS = 500_000
#: Characters of a unit that is composed at once, without looking for further cuts.
SHORT_UNIT = 24
#: Kinds of pieces in a model file, and of models.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def merge(text: str, scores: dict[str, float], border: int = 0) -> list[str]:
    """The best-scored neighbours merge first, the leftmost of equals, until none can. A merge across the border, if one is given, ends it: no parts."""
    parts: list[str | None] = list(text)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (joined := parts[i] + parts[after[i]]) in scores:
            heapq.heappush(heap, (-scores[joined], i, joined))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
            continue
        if i < border < i + len(joined):
            return []
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Machine:
    """A deterministic transducer on characters: arcs[state] gives the next state and the output for a character; OTHER stands for all without an
    arc of their own, KEEP in an output for the character itself."""

    OTHER, KEEP = "", "\0"

    def __init__(self, arcs: list[dict[str, tuple[int, str]]], start: int = 0):
        self.arcs, self.start = arcs, start
        #: For states that no arc leaves and that write all but one character as it is: that character and its output.
        self.loops = [self.loop(k) for k in range(len(arcs))]

    def loop(self, state: int) -> tuple[str, str] | None:
        of = self.arcs[state]
        changed = [(c, out) for c, (_, out) in of.items() if c != self.OTHER]
        stays = all(to == state for to, _ in of.values()) and of[self.OTHER][1] == self.KEEP
        return changed[0] if stays and len(changed) == 1 and self.KEEP not in changed[0][1] else None

    def apply(self, text: str) -> str:
        state, out = self.start, []
        for i, c in enumerate(text):
            if (loop := self.loops[state]) is not None:
                out.append(text[i:].replace(*loop))
                break
            arc = self.arcs[state].get(c) or self.arcs[state][self.OTHER]
            state = arc[0]
            out.append(c if arc[1] == self.KEEP else arc[1].replace(self.KEEP, c))
        return "".join(out)


def normaliser(escape: bool, prefix: bool, extra: bool) -> Machine:
    """Spaces to the escape mark; a mark before the first character; without extra spaces, if asked for: none at the ends, one for each run inside."""
    other, keep, mark = Machine.OTHER, Machine.KEEP, MARK if escape else " "
    begin = mark if prefix else ""
    if not extra:
        return Machine([{" ": (0, ""), other: (1, begin + keep)}, {" ": (2, ""), other: (1, keep)}, {" ": (2, ""), other: (1, mark + keep)}])
    if prefix:
        return Machine([{" ": (1, begin + mark), other: (1, begin + keep)}, {" ": (1, mark), other: (1, keep)}])
    return Machine([{" ": (0, mark), other: (0, keep)}])


class Transducer:
    """The compiled machines of one model file."""

    #: The piece that bytes count as, and the state of neighbours at the start and behind bytes.
    FREE = -1

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(Path(model_file).read_bytes())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap:
            raise ValueError("a normaliser with a character map is not supported")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.normaliser = normaliser(spec.escape_whitespaces, spec.add_dummy_prefix, not spec.remove_extra_whitespaces)
        self.bpe = model.trainer_spec.model_type == BPE
        self.names = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.trie: dict[str, list] = {}  # by character: the arcs behind it, the piece that ends here or -1, its weight
        for piece, i in self.ids.items():
            arcs, arc = self.trie, None
            for c in piece:
                arc = arcs.setdefault(c, [{}, -1, 0.0])
                arcs = arc[0]
            if arc is not None:
                arc[1:] = i, -self.scores[piece]
        #: What the library adds to the worst score for a character that no piece spells.
        self.byte_weight = 10.0 - min(self.scores.values(), default=0.0)
        #: Characters that occur side by side in a piece; no piece crosses any other pair of neighbours.
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cuts = spec.escape_whitespaces and not any(MARK in p.lstrip(MARK) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.units = re.compile(f"{MARK}*[^{MARK}{line}]+|\n+|{MARK}+" if line else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.neighbours: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.out = [b""] * len(self.names)
        for piece, i in self.ids.items():
            self.out[i] = piece.replace(MARK, " ").encode()
        for value, i in self.byte_ids.items():
            self.out[i] = bytes([value])

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text gives these two pieces."""
        if len(self.neighbours) > 500_000:
            self.neighbours.clear()
        a, b = self.names[left], self.names[right]
        found = self.neighbours[left << 32 | right] = merge(a + b, self.scores, len(a)) == [a, b]
        return found

    def path(self, unit: str) -> list[int]:
        """The outputs of the cheapest path through the composition of a unit with the machines.

        A state is a position of the unit and a state of the neighbours. A unigram model's neighbours have one state; a merge-trained model's
        have one that can be reached at a position, since each beginning of a text has one path of allowed pairs. So a position's state is
        its last piece, and its cheapest way there is kept beside it.
        """
        n, pairs, neighbours, spelled = len(unit), self.bpe, self.neighbours, self.ids
        infinite = float("inf")
        cost, last, came = [infinite] * (n + 1), [self.FREE] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if (here := cost[i]) == infinite:
                continue
            arcs, before, j = self.trie, last[i], i
            while j < n and (arc := arcs.get(unit[j])) is not None:  # arcs of the pieces
                arcs, piece, weight = arc
                j += 1
                if piece >= 0 and (total := here + weight) < cost[j]:
                    if pairs and before >= 0:  # arcs of the neighbours
                        if (fits := neighbours.get(before << 32 | piece)) is None:
                            fits = self.may_follow(before, piece)
                        if not fits:
                            continue
                    cost[j], last[j], came[j] = total, piece, i
            if unit[i] not in spelled and (total := here + self.byte_weight) < cost[i + 1]:  # the arc of the byte fallback
                cost[i + 1], last[i + 1], came[i + 1] = total, self.FREE, i
        ids: list[int] = []
        while n > 0:
            i = came[n]
            if last[n] >= 0:
                ids.append(last[n])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(unit[i:n].encode())]
            else:
                ids.append(self.unknown)
            n = i
        return ids[::-1]

    def kept(self, unit: str, found: bytes) -> bytes:
        if len(self.cache) >= CACHE_UNITS:
            self.cache.clear()
        if len(unit) <= 64:
            self.cache[unit] = found
        return found

    def of_unit(self, unit: str) -> bytes:
        found = self.cache.get(unit)
        if found is not None:
            return found
        cut = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.side_by_side] if len(unit) > SHORT_UNIT else []
        if cut:
            return self.kept(unit, b"".join(self.of_unit(unit[a:b]) for a, b in zip([0, *cut], [*cut, len(unit)], strict=True)))
        return self.kept(unit, array("i", self.path(unit)).tobytes())

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of one text, as int32."""
        normal = self.normaliser.apply(text)
        units = self.units.findall(normal) if self.cuts else [normal] * bool(normal)
        ids = np.frombuffer(b"".join(map(self.of_unit, units)), dtype=np.int32)
        if not self.byte_ids and len(ids):  # unknown characters side by side are one piece
            unknown = ids == self.unknown
            ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; control and unknown pieces give nothing; bytes that aren't UTF-8 become the replacement character."""
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def transducer(model_file: str) -> Transducer:
    return Transducer(model_file)


def _extended(df: DataFrame, drop: tuple[str, ...], extra: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(*drop)
    return kept, T.StructType([*kept.schema.fields, *extra])


def encode(docs: DataFrame, model_file: str, text: str = "text", out: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of piece ids (array of int), and if a name is given, a column of the text that they decode to, in the same pass."""
    bounded_batches(docs.sparkSession)
    extra = [T.StructField(out, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    kept, schema = _extended(docs, tuple(f.name for f in extra), extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            for a, b in slices(texts := texts_of(batch, text), 2_000_000):
                ids = [machine.encode(t) for t in texts[a:b]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    made.append(pa.array([machine.decode(x) for x in ids], pa.string()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in extra)])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """encoded with a column of the text that the ids spell; a null list gives an empty text."""
    bounded_batches(encoded.sparkSession)
    kept, schema = _extended(encoded, (out,), [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            column = batch.column(ids)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [machine.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_pieces, ids_sha256 (of the ids in decimals with commas), round_trip (decoding gives the text back)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, model_path(), decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
