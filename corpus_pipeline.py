"""The corpus pipeline: toxic documents go, near copies go, contaminated documents go, personal data is masked, pieces are made.

Each stage takes all that the one before kept and returns the columns of documents; the last returns pieces. Further
columns of its input, whatever their names, are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import contamination, jaccard, pieces, pii, toxicity
from lociq.llm.shared import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't call toxic; it learns from those of `docs` that labels name.

    Null and empty texts have no toxic passage and stay. Every row is judged by its text, also repeated ones and those
    without an id; a score of just one half is toxic. Without labelled documents of both classes all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that Jaccard links join: of the smallest id, null being the last, then by its contents.

    Rows are told apart by a key of their own, so null and repeated ids neither lose nor keep others. Rows without
    words are linked with nothing; of those, equal ones of one id count as one, and those without an id all stay.
    """
    rows = keep(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    groups = jaccard.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("row"), (F.col("n_shingles") == 0).alias("bare"), "component_id")
    no_id = F.col("doc_id").isNull()
    facts = rows.select("row", "doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64(*COLUMNS).alias("contents"))
    same = F.when(~F.col("bare"), F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("digest"), F.col("component_id").alias("row")))
    same = same.otherwise(F.struct(F.col("doc_id").cast("long").alias("id"), F.when(~no_id, F.col("digest")).alias("digest"), F.when(no_id, F.col("row")).alias("row")))
    first = F.min_by("row", F.struct(no_id, "doc_id", "contents", "row")).alias("row")
    kept = facts.join(groups, "row").groupBy(same.alias("same")).agg(first).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows.

    Null and empty texts have no words and stay. Every row is judged by its text, also repeated ones and those without
    an id; just a twentieth goes. Without benchmark items all stay.
    """
    return contamination.without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null texts stay null, with no length. Rows are masked each, also repeated ones and those without an id.
    """
    text = pii.mask(F.col("text"))
    return docs.select("doc_id", text.alias("text"), "lang", "source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def make_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each document, how its next best ones differ, and whether decoding gives it back.

    Null and empty texts have no pieces; repeated rows and those without an id get a row each.
    """
    return pieces.encode_texts(docs, model=spark.conf.get(pieces.SETTING, pieces.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_private),
    ("pieces", make_pieces),
]
#: Models and piece lattices aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
