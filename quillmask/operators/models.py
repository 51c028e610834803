"""Hook for a language model of the caller's.

No model ships with the package. A caller who has one runs it here, in Arrow
batches inside the tasks that hold the rows, so its annotations need neither a
join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.catalogue import MODEL_SCORE
from quillmask.functions.sql import name
from quillmask.operators.columns import as_text
from quillmask.operators.detection import ENTITIES
from quillmask.operators.names import TOKENS

# Per text: entities as (start, end, label), tokens as (start, end, text, part of speech).
Annotated = tuple[Iterable[tuple[int, int, str]], Iterable[tuple[int, int, str, str]]]
Model = Callable[[list[str]], Iterable[Annotated]]


def attach_model(df: DataFrame, columns: dict[str, tuple[str, str]], load: Callable[[], Model]) -> DataFrame:
    """Add an entity and a token column per source column.

    ``columns`` maps a source column to the names of its two new columns.
    ``load`` is called once per task and returns the model; the model takes a
    list of texts. ``spark.sql.execution.arrow.maxRecordsPerBatch`` sets how
    many texts it gets at a time.
    """

    @F.pandas_udf(f"struct<entities:{ENTITIES},tokens:{TOKENS}>")
    def annotate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            done = [(list(entities), list(tokens)) for entities, tokens in model(texts.tolist())]
            yield pd.DataFrame(
                {
                    "entities": [
                        [{"start": s, "end": e, "label": label, "score": MODEL_SCORE} for s, e, label in ents]
                        for ents, _ in done
                    ],
                    "tokens": [
                        [{"start": s, "end": e, "text": t, "pos": pos} for s, e, t, pos in toks] for _, toks in done
                    ],
                }
            )

    out = df
    for source, (entities, tokens) in columns.items():
        out = (
            out.withColumn("__model", annotate(as_text(F.col(name(source)))))
            .withColumns({entities: F.col("__model.entities"), tokens: F.col("__model.tokens")})
            .drop("__model")
        )
    return out
