"""Alignment of the tokens that two tokenizers cut the same bytes into.

Both tokenizers cover the same bytes, so two arrays of end offsets say all. Where
tokens pair off one to one, the arrays agree place by place at a fixed index
shift; doubling probes compare ever longer slices at that shift until one
differs, halving probes find the place, and the whole stretch is jumped. There an
irregular group begins: the side that ends first moves on until both end at the
same byte, which gives the new shift. Byte offsets where both end cut the tokens
into groups; within a group neighbours overlap, so its links are the steps of
that walk.

Links are counted by pair of ids over all texts: each text keeps its distinct
pairs, tasks add them up, Spark adds up the tasks. Every text then meets the
counts of its pairs: those of the HEAD_PAIRS most frequent ones are sent to all
tasks (fixed size, found by a histogram of counts), rarer pairs are joined, and
none of them is frequent.

Tokenizers work on words where their tokens cannot cross a blank, and each worker
remembers words it has seen; other tokenizers get whole texts.

Defined cases: texts that are null, empty, or not covered byte for byte by both
tokenizers have no tokens: zeros and no groups; special strings in a text are
plain text; texts of any length are cut as a whole, in the memory of one text;
repeated rows are aligned and counted each; of equal counts every pair is the
best of its id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.common import Scratch, documents, q

BLANK = "▁"
HEAD_PAIRS = 2**18
MEMO = 360_000  # remembered words in a worker, about; others are encoded anew
LONG_WORD = 64  # longer ones are not remembered
SLICE = 1024 * 1024  # characters of text that are aligned before they are passed on
FLUSH = 2_000_000  # distinct pairs a task counts before it passes them on
SHARES = 16  # classes of counts for each power of two

# A blank between two characters that are no white space by any definition.
CUT = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
WHOLE = re.compile(r" [^\s᠎]+")
UNCLEAR = re.compile(r"(?:^|[\s᠎]) | (?:[\s᠎]|$)")


class ByteLevel:
    """A byte-level tokenizer file (.json): ids and the bytes of each entry."""

    def __init__(self, content: bytes):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        said = json.loads(content)
        self.encoder = tokenizers.Tokenizer.from_str(content.decode())
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.encoder.encode_special_tokens = True
        split = said.get("pre_tokenizer") or {}
        self.by_word = (
            said.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(re.search(r"\s", t["content"]) for t in said.get("added_tokens", ()))
        )
        printed = byte_signs()
        size = self.encoder.get_vocab_size()
        entries = [self.encoder.id_to_token(k) or "" for k in range(size)]
        self.bytes = [bytes(map(printed.__getitem__, e)) if all(c in printed for c in e) else e.encode() for e in entries]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank."""
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model that puts a blank before a text: ids and the bytes of each piece."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        odd = "ﬁ  Ⅷ  ａ "
        untouched = self.model.normalize(odd).replace(BLANK, " ").endswith(odd)
        self.by_word = untouched and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank, which the model adds itself."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """Tokens of both tokenizers as numbers: id and length in bytes; 0 alone marks a word that one does not cover."""

    def __init__(self, files: tuple[bytes, bytes]):
        self.both = ByteLevel(files[0]), Pieces(files[1])
        self.by_word = all(t.by_word for t in self.both)
        self.codes = [np.array([(k << 16) | len(b) for k, b in enumerate(t.bytes)], np.int64) for t in self.both]
        self.width = len(self.both[1].bytes)
        # how an id is written: within its group, at the end of its side, for both sides
        self.written = [f"{k}{end}" for t, last in zip(self.both, "|;", strict=True) for k in range(len(t.bytes)) for end in (",", last)]
        self.second = 2 * len(self.both[0].bytes)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def words(self, text: str | None) -> list[str]:
        """The words of a blank and the text, each with the blanks before it."""
        if not text:
            return []
        if not self.by_word:
            return [" " + text]
        if UNCLEAR.search(text):
            return CUT.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def learn(self, words: set[str]) -> None:
        """Remember the tokens of words; those not met for long are forgotten first."""
        if len(self.memo) > MEMO // 2:
            self.older, self.memo = self.memo, {}
        again = [w for w in words if w not in self.memo]
        self.memo.update((w, self.older[w]) for w in again if w in self.older)
        new = [w for w in again if w not in self.memo]
        if self.by_word:
            plain = [w for w in new if WHOLE.fullmatch(w)]
            whole = set(plain)
            self.remember(plain, *[self.joined(k, plain) for k in range(2)])
            new = [w for w in new if w not in whole]
        self.remember(new, *[self.apart(k, new) for k in range(2)])

    def remember(self, words: list[str], a: list[bytes], b: list[bytes]) -> None:
        self.memo.update(zip(words, zip(a, b, strict=True), strict=True))

    def apart(self, k: int, words: list[str]) -> list[bytes]:
        """Tokens of each word, encoded one by one."""
        tokenizer, own = self.both[k], []
        for word, ids in zip(words, tokenizer.encode(words), strict=True):
            covered = b"".join([tokenizer.bytes[i] for i in ids]) == word.encode()
            own.append(self.codes[k][ids].tobytes() if covered else bytes(8))
        return own

    def joined(self, k: int, words: list[str]) -> list[bytes]:
        """The same from one text of all words: no token crosses from one to the next."""
        if not words:
            return []
        tokenizer, parts = self.both[k], [w.encode() for w in words]
        ids = tokenizer.encode(["".join(words)])[0]
        if b"".join([tokenizer.bytes[i] for i in ids]) != b"".join(parts):
            return self.apart(k, words)
        codes = self.codes[k][ids]
        ends = np.searchsorted(np.cumsum(codes & 0xFFFF), np.cumsum([len(p) for p in parts])) + 1
        data, at = codes.tobytes(), [0, *(8 * ends).tolist()]
        return [data[at[i] : at[i + 1]] for i in range(len(words))]

    def forget(self, words: set[str]) -> None:
        for word in words:
            if len(word) > LONG_WORD:
                del self.memo[word]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        a, b = zip(*map(self.memo.__getitem__, words), strict=True) if words else ((), ())
        return np.frombuffer(b"".join(a), np.int64), np.frombuffer(b"".join(b), np.int64)


CODERS: dict[tuple[bytes, bytes], Coder] = {}


def coder(files: tuple[bytes, bytes]) -> Coder:
    """The worker's coder, kept from task to task with what it remembers."""
    if files not in CODERS:
        CODERS.clear()
        CODERS[files] = Coder(files)
        gc.set_threshold(100_000)  # words and tokens make no cycles that it would have to look for
    return CODERS[files]


def stretch(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many ends (four bytes each) agree from place i of a and place j of b on."""
    i, j, n, step = 4 * i, 4 * j, 0, 32
    while (x := a[i + n : i + n + step]) == b[j + n : j + n + step] and x:
        n, step = n + len(x), 2 * step
    while step > 4:
        step //= 2
        if (x := a[i + n : i + n + step]) == b[j + n : j + n + step]:
            n += len(x)
    return n // 4


def walk(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of two arrays of ends with the same last one: the places on either side that do not end a group,
    and the overlapping places of the groups that are not one to one."""
    a_inner, b_inner, left, right = [], [], [], []
    a_bytes, b_bytes = a_ends.astype(np.int32).tobytes(), b_ends.astype(np.int32).tobytes()
    a, b = memoryview(a_bytes).cast("i"), memoryview(b_bytes).cast("i")
    size = len(a)
    i = j = 0
    while i < size:
        n = stretch(a_bytes, b_bytes, i, j)
        i, j = i + n, j + n
        if i == size:
            break
        x, y = a[i], b[j]
        left.append(i)
        right.append(j)
        while x != y:
            if x < y:
                a_inner.append(i)
                i += 1
                x = a[i]
            else:
                b_inner.append(j)
                j += 1
                y = b[j]
            left.append(i)
            right.append(j)
        i, j = i + 1, j + 1
    return a_inner, b_inner, left, right


def align(a: np.ndarray, b: np.ndarray, coder: Coder) -> tuple[int, str, np.ndarray]:
    """Number of groups, the groups as text, and the pair of every link; a and b are Coder.tokens."""
    a_ids, b_ids = a >> 16, b >> 16
    a_inner, b_inner, left, right = walk(np.cumsum(a & 0xFFFF), np.cumsum(b & 0xFFFF))
    a_last, b_last = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    a_last[a_inner], b_last[b_inner] = 0, 0
    a_to, b_to = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1  # where each group ends
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    # a group's tokens of a come before those of b
    written = np.empty(len(a) + len(b), np.int64)
    written[np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]] = 2 * a_ids + a_last
    written[np.arange(len(b)) + a_to[b_group]] = coder.second + 2 * b_ids + b_last
    text = "".join(map(coder.written.__getitem__, written.tolist()))[:-1]
    single = (np.diff(a_to, prepend=0) == 1) & (np.diff(b_to, prepend=0) == 1)
    pairs = np.concatenate([a_ids[a_to[single] - 1] * coder.width + b_ids[b_to[single] - 1], a_ids[left] * coder.width + b_ids[right]])
    return len(a_to), text, pairs


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts in runs of about SLICE characters; a longer text is a run of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            if texts and size + len(text or "") > SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(batch.column(0)[k].as_py())
            texts.append(text)
            size += len(text or "")
    if texts:
        yield ids, texts


def vocabulary(files: tuple[bytes, bytes]) -> int:
    """Number of pieces of the second tokenizer: a pair's number is a * this + b."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()


def aligned(docs: DataFrame, files: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row; pairs are distinct and in order."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # two files of fixed size
    kind = docs.select(q(id_col).alias("doc_id")).schema["doc_id"]
    schema = T.StructType([kind]).simpleString()[7:-1]
    schema += ", n_a: bigint, n_b: bigint, n_groups: bigint, groups: string, pairs: array<bigint>, times: array<int>"
    id_type = T.StructType([kind])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(id_type).field(0).type
        own = coder(shared.value)
        for ids, texts in slices(batches):
            words = [own.words(t) for t in texts]
            every = set().union(*words)
            own.learn(every)
            found = []
            for w in words:
                a, b = own.tokens(w)
                whole = len(a) and a.all() and b.all()
                found.append((len(a), len(b), *align(a, b, own)) if whole else (0, 0, 0, "", a[:0]))
            own.forget(every)
            pairs = [np.unique(f[4], return_counts=True) for f in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in pairs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, arrow),
                    *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                    pa.array([f[3] for f in found], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for p, _ in pairs]), pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([n for _, n in pairs]).astype(np.int32), pa.int32())),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"],
            )

    return docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text")).mapInArrow(cut, schema)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of one task's texts; a pair may come several times."""

    def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(pairs, return_inverse=True)
        return distinct, np.bincount(place, weights=times, minlength=len(distinct)).astype(np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64())], ["pair", "n"])

    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        pairs, times = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        held = summed(np.concatenate([held[0], pairs]), np.concatenate([held[1], times]))
        if len(held[0]) >= FLUSH:
            yield out()
            held = held[0][:0], held[1][:0]
    yield out()


def frequent(counts: DataFrame, most: int) -> int:
    """The least count such that no more than most pairs have it or more; from a histogram of counts."""
    share = F.floor(F.log2("c") * SHARES).cast("int")
    rows = counts.groupBy(share.alias("share")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    taken, least = 0, None
    for _, n, low in sorted(rows, reverse=True):  # some SHARES * 63 rows at most
        taken += n
        if taken > most:
            break
        least = low
    return least if least is not None else 2**63 - 1


def agreement(texts: DataFrame, width: int, scratch: Scratch, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Stored texts (row, pairs, times, ...) with n_links, n_best and count_sum instead of pairs and times.

    width is the number of pieces of the second tokenizer, which bounds the table
    of the highest count of each of its ids.
    """
    spark = texts.sparkSession
    totals = scratch.stored(texts.select("pairs", "times").mapInArrow(count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("c")))
    highest = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("c").alias("most"))
    # one row for each piece of the second vocabulary at most
    ranked = totals.join(F.broadcast(highest), F.col("pair") % width == F.col("b")).select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
    counts = scratch.stored(ranked)
    least = frequent(counts, head_pairs)
    head = counts.filter(F.col("c") >= least).toArrow().sort_by("pair")
    table = [head[n].to_numpy(zero_copy_only=False) for n in ("pair", "c", "best")]
    shared = spark.sparkContext.broadcast(table)  # head_pairs entries at most
    kept = [c for c in texts.columns if c not in ("pairs", "times")]

    @F.arrow_udf("struct<n_links: bigint, n_best: bigint, count_sum: bigint, rare: array<bigint>, often: array<bigint>>")
    def meet(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pair, count, best = shared.value
        for pairs, times in batches:
            sizes = np.diff(pairs.offsets.to_numpy())
            p, t = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(pair, p)
            known = np.zeros(len(p), bool)
            inside = at < len(pair)
            known[inside] = pair[at[inside]] == p[inside]
            links, n_best, total = (np.zeros(len(sizes), np.int64) for _ in range(3))
            np.add.at(links, text, t)
            np.add.at(n_best, text[known], t[known] * best[at[known]])
            np.add.at(total, text[known], t[known] * count[at[known]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[~known], minlength=len(sizes)))]).astype(np.int32))
            yield pa.StructArray.from_arrays(
                [pa.array(links), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(offsets, pa.array(p[~known])), pa.ListArray.from_arrays(offsets, pa.array(t[~known]))],
                ["n_links", "n_best", "count_sum", "rare", "often"],
            )

    met = scratch.stored(texts.select(*kept, meet("pairs", "times").alias("m")).select(*kept, "m.*"))
    each = met.select("row", F.explode(F.arrays_zip("rare", "often")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.often").alias("n"))
    rest = each.join(counts.filter(F.col("c") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("c")).alias("more")
    )
    more = scratch.stored(rest)
    scratch.clear(met, more)
    none = F.lit(0).cast("long")
    return met.join(more, "row", "left").select(
        *kept, "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", none)).alias("count_sum"),
    )


def files_of(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def compared(docs: DataFrame, files: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    found = aligned(docs, files, id_col, text_col).withColumn("groups_sha256", digest).drop("groups")
    texts = scratch.stored(found.withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    return agreement(texts, vocabulary(files), scratch, head_pairs)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = files_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return compared(documents(spark, sf_dir), files).drop("row")
