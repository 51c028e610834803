"""SentencePiece encoding and decoding.

An Aho-Corasick automaton holds all pieces. For a unigram model one pass over a
text follows its transitions; at each position the automaton's outputs (the
pieces that end there, longest first along the output links) relax the best
score. Of equal scores the longer last piece wins.

The scores of a BPE model are merge ranks, whose sums mean nothing. There the
neighbours whose union is the piece of the best rank are merged, leftmost first,
until no union is a piece; the automaton's pieces tell which unions are.

A character that is no piece scores less than any piece and is written as byte
pieces. No piece has a blank after another character, so the pieces of a text
are the pieces of its words (with the blanks before them) put together, and each
worker remembers words it has seen. Decoding gives back the exact text: texts
are not normalised, whatever the model says.

Defined cases: null and empty texts have no pieces and decode to an empty text;
a literal U+2581 is written as bytes, to be told from a blank; repeated rows are
encoded each; an empty table gives no rows; other columns are kept by
encode_column and left out by encode.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.common import documents, q, small_batches

BLANK = "▁"
MEMO = 500_000  # remembered words in a worker; others are encoded anew
LONG_WORD = 64  # longer ones are not remembered
WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Codec:
    """Pieces of a model file, their scores and the automaton over them; best sum of scores."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.automaton = ahocorasick.Automaton()
        self.written: list[bytes] = []
        self.bytes = [0] * 256
        self.scores = []
        lowest = 0.0
        for k in range(model.get_piece_size()):
            piece, score = model.id_to_piece(k), model.get_score(k)
            self.scores.append(score)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[value] = k
                self.written.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.written.append(b"")
            else:
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("pieces across words are not supported")
                self.automaton.add_word(piece, (len(piece), k, score))
                self.written.append(piece.replace(BLANK, " ").encode())
                lowest = min(lowest, score)
        self.automaton.make_automaton()
        self.unknown = lowest - 10.0
        self.memo: dict[str, tuple[tuple[int, ...], float]] = {}

    def best(self, text: str) -> tuple[tuple[int, ...], float]:
        """Piece ids and score of the best path; single-pass Viterbi."""
        n = len(text)
        score = [0.0] * (n + 1)
        last: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        # every position starts as an unknown character; it is settled when its outputs are in
        done = 0
        unknown = self.unknown
        for end, (length, k, gain) in self.automaton.iter(text):
            end += 1
            while done < end:
                score[done + 1] = score[done] + unknown
                last[done + 1] = (1, -1)
                done += 1
            reached = score[end - length] + gain
            if reached > score[end] or (reached == score[end] and length > last[end][0]):
                score[end] = reached
                last[end] = (length, k)
        while done < n:
            score[done + 1] = score[done] + unknown
            last[done + 1] = (1, -1)
            done += 1
        ids: list[int] = []
        at = n
        while at:
            length, k = last[at]
            if k < 0:
                ids += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(k)
            at -= length
        return tuple(reversed(ids)), score[n]

    cut = best

    def word(self, text: str) -> tuple[tuple[int, ...], float]:
        found = self.memo.get(text)
        if found is None:
            found = self.cut(text)
            if len(text) <= LONG_WORD:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        """Ids and score of a whole text."""
        if not text:
            return np.zeros(0, np.int32), 0.0
        found = []
        literal = tuple(self.bytes[b] for b in BLANK.encode())
        for k, part in enumerate(text.split(BLANK)):
            if k:
                found.append((literal, self.unknown))
            spaced = part.replace(" ", BLANK)
            found += map(self.word, WORDS.findall(spaced if k else BLANK + spaced))
        ids = np.fromiter(chain.from_iterable(f[0] for f in found), np.int32)
        return ids, sum(f[1] for f in found)

    def decode(self, ids) -> str:
        """The text that encode was given."""
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class MergingCodec(Codec):
    """Pieces of a BPE model by merges in order of rank, as the library makes them."""

    def __init__(self, proto: bytes):
        super().__init__(proto)
        self.listed = dict(self.automaton.items())

    def cut(self, text: str) -> tuple[tuple[int, ...], float]:
        """Piece ids and the sum of their scores."""
        n, piece = len(text), self.listed.get
        after = list(range(1, n + 1))  # where the symbol that starts here ends; 0 if merged away
        before = list(range(-1, n))  # where the symbol before it starts
        # best rank first, then leftmost; an entry is stale if one of its symbols has changed
        queue = [(-hit[2], i, i + 1, i + 2) for i in range(n - 1) if (hit := piece(text[i : i + 2]))]
        heapq.heapify(queue)
        while queue:
            _, start, middle, end = heapq.heappop(queue)
            if after[start] != middle or after[middle] != end:
                continue
            after[start], after[middle], before[end] = end, 0, start
            if start and (hit := piece(text[before[start] : end])):
                heapq.heappush(queue, (-hit[2], before[start], start, end))
            if end < n and (hit := piece(text[start : after[end]])):
                heapq.heappush(queue, (-hit[2], start, end, after[end]))
        ids: list[int] = []
        score, at = 0.0, 0
        while at < n:
            symbol = text[at : after[at]]
            if hit := piece(symbol):
                ids.append(hit[1])
                score += hit[2]
            else:
                ids += [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
                score += self.unknown
            at = after[at]
        return tuple(ids), score


def codec_of(proto: bytes) -> Codec:
    """The codec of the model's type."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto.FromString(proto)
    kinds, kind = format_.TrainerSpec, model.trainer_spec.model_type
    if kind == kinds.UNIGRAM:
        return Codec(proto)
    if kind != kinds.BPE:
        raise ValueError("only unigram and BPE models are supported")
    special = {format_.ModelProto.SentencePiece.USER_DEFINED, format_.ModelProto.SentencePiece.UNUSED}
    if any(p.type in special for p in model.pieces):
        raise ValueError("user-defined and unused pieces of BPE models are not supported")
    return MergingCodec(proto)


@functools.lru_cache(maxsize=1)
def held(proto: bytes) -> Codec:
    """A worker keeps its codec, and the words it has seen, from task to task."""
    return codec_of(proto)


RESULT = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def encoder(spark: SparkSession, model_path: str):
    """An expression builder: text to struct(ids, n_pieces, score, round_trip)."""
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())  # one file of fixed size
    small_batches(spark)

    @F.arrow_udf(RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = held(shared.value)
        for batch in batches:
            ids, scores, exact = [], [], []
            for text in batch.to_pylist():
                found, score = codec.encode(text)
                ids.append(found)
                scores.append(score)
                exact.append(codec.decode(found.tolist()) == (text or ""))
            sizes = [len(x) for x in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(offsets, flat), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(exact, pa.bool_())],
                RESULT.names,
            )

    return encode


def decoder(spark: SparkSession, model_path: str):
    """An expression builder: ids to text."""
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    small_batches(spark)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = held(shared.value)
        for batch in batches:
            yield pa.array([None if ids is None else codec.decode(ids) for ids in batch.to_pylist()], pa.string())

    return decode


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, score, round_trip) of every row."""
    found = docs.select(q(id_col).alias("doc_id"), encoder(docs.sparkSession, model_path)(q(text_col)).alias("e"))
    return found.select("doc_id", "e.*")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
