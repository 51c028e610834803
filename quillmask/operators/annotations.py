"""Annotations from elsewhere: model entities, tagged tokens and dictionaries.

Models run outside this package. Their output comes in as tables keyed by row
and column and is turned into array columns of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.catalogue import MODEL_SCORE, WORD
from quillmask.functions.spans import find_matches
from quillmask.functions.sql import empty, let, name
from quillmask.operators.columns import as_text
from quillmask.plans.staging import stored


def _entity(df: DataFrame) -> Column:
    score = F.col("score").cast("double") if "score" in df.columns else F.lit(MODEL_SCORE)
    return F.struct(
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        F.col("label").alias("label"),
        score.alias("score"),
    )


def _token(df: DataFrame) -> Column:
    return F.struct(
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        F.col("text").alias("text"),
        F.col("pos").alias("pos"),
    )


def _attach(df: DataFrame, lists: DataFrame, key: list[str], partitions: int | None) -> DataFrame:
    """Left join of per-row arrays.

    The lists are gathered per row key, so each is bounded by the text of one
    row. Map-side partial lists keep the shuffle small, and no side is forced
    into a broadcast: a small table is broadcast by its size, else the join
    shuffles on the row key. Detection after the join is bound by CPU, while
    adaptive execution sizes partitions by bytes; ``partitions`` fixes their
    number.
    """
    if partitions is not None:
        df = df.repartition(partitions, *key)
    return df.join(lists, key, "left")


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _lists(kind: str, row: Column, columns: dict[str, str]) -> list[Column]:
    return [
        F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("source_column") == source), row))).alias(target)
        for source, target in columns.items()
    ]


def _gathered(tables: list[tuple[str, DataFrame, Column, dict[str, str]]], key: list[str]) -> DataFrame:
    """All annotation tables grouped by row key at once, one list for each target column."""
    parts = [
        t.filter(F.col("source_column").isin(*columns)).select(*key, F.lit(kind).alias("kind"), "source_column", row.alias(kind))
        for kind, t, row, columns in tables
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(*key).agg(*[c for kind, _, _, columns in tables for c in _lists(kind, F.col(kind), columns)])


def attach_annotations(
    df: DataFrame, entities: DataFrame, tokens: DataFrame, key, entity_columns, token_columns, partitions: int | None = None
) -> DataFrame:
    """Add entity and token columns with one grouping and one join."""
    tables = [("entity", entities, _entity(entities), entity_columns), ("token", tokens, _token(tokens), token_columns)]
    return _attach(df, _gathered(tables, _keys(key)), _keys(key), partitions)


def attach_entities(df: DataFrame, entities: DataFrame, key, columns: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add an entity column per source column.

    ``entities`` has the key columns, ``source_column``, ``start``, ``end``,
    ``label`` and optionally ``score``; ``columns`` maps source columns to the
    names of the new columns.
    """
    return _attach(df, _gathered([("entity", entities, _entity(entities), columns)], _keys(key)), _keys(key), partitions)


def attach_tokens(df: DataFrame, tokens: DataFrame, key, columns: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add a token column per source column, from ``start``, ``end``, ``text`` and ``pos``."""
    return _attach(df, _gathered([("token", tokens, _token(tokens), columns)], _keys(key)), _keys(key), partitions)


# Largest filter of first words: 8 MB, which is what Spark's own runtime filters may take.
MAX_FILTER_BITS = 1 << 26
_BITS_PER_WORD = 12
_PROBES = 3
# Terms of up to so many bytes in all go to every executor as one table.
BROADCAST_BYTES = 64 << 20


def _probes(word: str, bits: int) -> str:
    """The bit numbers of a word in a filter of ``bits`` bits, a power of two."""
    half = let("h", f"xxhash64({word})", "array(h & 4294967295L, shiftrightunsigned(h, 32) | 1L)")
    return let("hh", half, f"transform(sequence(0, {_PROBES - 1}), i -> (hh[0] + i * hh[1]) & {bits - 1}L)")


def _filter_bits(firsts: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of the column ``first`` as one row (bits array<bigint>), and its number of bits.

    Each task folds its words into partial bits, Spark merges them. The size
    follows the number of words up to MAX_FILTER_BITS, beyond which the filter
    lets more words through, without any effect on results.
    """
    n = firsts.agg(F.approx_count_distinct("first")).first()[0]
    bits = max(64, min(MAX_FILTER_BITS, 1 << (_BITS_PER_WORD * n).bit_length()))
    ones = firsts.select(F.expr(f"explode({_probes('first', bits)})").alias("p"))
    cells = ones.groupBy(F.expr("p div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    every = firsts.sparkSession.range(bits // 64).withColumnRenamed("id", "cell").join(cells, "cell", "left")
    row = F.sort_array(F.collect_list(F.struct("cell", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))))
    return every.agg(F.transform(row, lambda c: c["v"]).alias("bits")), bits


def dictionary_entities(
    df: DataFrame, column: str, key, dictionary: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, staging: str | None = None
) -> DataFrame:
    """Entities by look-up of word sequences in a dictionary, as an annotation table.

    ``dictionary`` holds ``term``, ``label`` and optionally ``score``. Word
    sequences as long as some term are compared without regard to case and to
    what separates the words. Whatever the size of the dictionary, sequences
    whose first word starts no term are mostly left out by a Bloom filter before
    they become rows.

    Terms of at most ``broadcast_bytes`` are broadcast. Others are joined by a
    shuffle: the sequences are stored (at ``staging``, else in the shared folder;
    the result reads them) and counted, and those so frequent that one would
    fill a task are joined apart, with only their own terms, which are broadcast:
    no more than there are shuffle partitions.
    """
    key = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    score = F.col("score").cast("double") if "score" in dictionary.columns else F.lit(MODEL_SCORE)
    words_of = F.regexp_extract_all(F.lower("term"), F.lit(WORD), F.lit(0))
    terms = (
        dictionary.select(F.array_join(words_of, " ").alias("gram"), F.col("label"), score.alias("score"))
        .filter(F.col("gram") != "")
        .distinct()
    )
    lengths = sorted(r[0] for r in terms.select(F.size(F.split("gram", " "))).distinct().collect())
    size = terms.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("label") + 32), F.lit(0))).first()[0]
    bits, n_bits = _filter_bits(terms.select(F.split("gram", " ")[0].alias("first")))
    words = df.select(*key, as_text(F.col(name(column))).alias("__text")).select(
        *key, F.expr(find_matches("__text", WORD)).alias("words")
    )
    filtered = spark.sql("SELECT *, (SELECT bits FROM {bits}) AS bits FROM {words}", bits=bits, words=words)
    # One row per word that may start a term; each carries the few sequences that start with it.
    starts = f"forall({_probes('lower(w.text)', n_bits)}, p -> (shiftright(get(bits, cast(p div 64 as int)), cast(p % 64 as int)) & 1L) = 1L)"
    steps = ", ".join(str(n - 1) for n in lengths)
    gram = (
        "named_struct('start', w.start, 'end', get(words, i + n).end, 'gram', "
        "lower(array_join(transform(slice(words, i + 1, n + 1), v -> v.text), ' ')))"
    )
    grams = filtered.select(
        *key,
        F.expr(
            f"explode(flatten(transform(words, (w, i) -> if({starts}, transform(filter(cast(array({steps}) as array<int>), "
            f"n -> i + n < size(words)), n -> {gram}), {empty('array<struct<start:int,end:int,gram:string>>')}))))"
        ).alias("g"),
    ).select(*key, "g.start", "g.end", "g.gram")
    if size <= broadcast_bytes:
        found = grams.join(F.broadcast(terms), "gram")
    else:
        found = _joined_apart(stored(grams, staging), terms)
    return found.select(*key, F.lit(column).alias("source_column"), "start", "end", "label", "score")


def _joined_apart(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """grams with their terms; a gram of more rows than an even task meets its terms by broadcast."""
    partitions = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, grams.count() // partitions)
    hot = stored(grams.groupBy("gram").count().filter(F.col("count") > most).select("gram"))
    # Fewer hot grams than partitions by construction.
    frequent = grams.join(F.broadcast(terms.join(F.broadcast(hot), "gram")), "gram")
    others = grams.join(F.broadcast(hot), "gram", "left_anti").join(terms.hint("shuffle_merge"), "gram")
    return frequent.unionByName(others)
