"""Word forms of context words from a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.catalogue import Catalogue
from quillmask.functions.sql import texts

# Forms that a plan may hold; only those of words that lift a detector count.
MOST_FORMS = 20_000


def with_lemma_table(catalogue: Catalogue, forms: DataFrame) -> Catalogue:
    """The catalogue with the forms (``form``, ``lemma``) whose lemma holds a context word.

    A form table covers a language, of which the context words take a few
    hundred forms. They are cut out by Spark and counted before they come to the
    plan; more than MOST_FORMS are refused, not cut.
    """
    words = texts(catalogue.all_context_words)
    pairs = forms.select(F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).filter(
        F.expr(f"form <> lemma and exists({words}, w -> contains(lemma, w))")
    )
    rows = pairs.distinct().limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"over {MOST_FORMS} forms of context words; narrow the table of forms")
    return catalogue.with_lemmas((r.form, r.lemma) for r in rows)
