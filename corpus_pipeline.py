"""A corpus pipeline of the operators in quillmask.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Null and empty texts pass the toxicity stage (score 0) and
leave in the language stage (no letters); empty tables stay empty. Rows are
judged one by one whatever their length; of copies the row of smallest id stays,
of several rows with that id and text any one; further columns pass through
unread, also under names that the operators use inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import languages, mixing, pieces, prob_minhash, toxicity
from quillmask.llm.common import documents, fold_of, shared_folder

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose most toxic word scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(spark, toxicity.train(docs, labels, fold_of(F.col("label_id"), 5) != 0))
    return docs.filter(score("text") < 0.5)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier in the learned languages, one or several, than by chance."""
    predict = languages.predictor(spark, languages.train(docs, fold_of(F.col("doc_id"), 5) != 0))
    found = predict("text")
    return docs.filter((found["lang_pred"] != languages.UNKNOWN) & (found["gain"] > 0))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return prob_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources meet their targets."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

# Models, signatures and the codec cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
