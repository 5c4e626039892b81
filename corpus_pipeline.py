"""The corpus pipeline: documents to a training mix, in stages that each work on what the one before kept.

Nulls: a document without id or source goes through all stages like any other; a null text counts
as empty, holds no benchmark item, stays null and gives the mix no words. Rows that repeat a
document wholly go with the copies. An empty table gives an empty result from every stage. Columns
of docs beside those of documents pass through, the mix's own names excepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unspool.llm import decontaminate, jaccard, mixing, pii, quality
from unspool.llm.common import delete, materialize, table, written

#: A document whose quality score is less is rejected.
QUALITY_FLOOR = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quadratic discriminant scores at QUALITY_FLOOR or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= QUALITY_FLOOR)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the Jaccard join links, the document with the smallest id; of rows with the same id and text, one.

    A document is a row, known by its id and text: rows that share an id but not a text go or stay
    by their own texts. Texts without words link with nothing. Where the smallest id stands for
    several texts of a group, the one with the smallest hash stays; a document without id stays
    only where its group has none with one.
    """
    tag = F.xxhash64(F.col("text"))
    joined = materialize(jaccard.join(docs, tag=tag), "joined")
    rows = joined.groupBy("group_id", "doc_id", "tag").agg(F.count("*").alias("n"))
    # The smallest (id, hash) of each group is made as a partial aggregate; what stands alone meets nothing.
    least = joined.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("least"))
    is_least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tag") == F.col("least.tag"))
    marked = rows.where("group_id is not null").join(least, "group_id").select("doc_id", "tag", "n", is_least.alias("stays"))
    marked = marked.unionByName(rows.where("group_id is null").select("doc_id", "tag", "n", F.lit(True).alias("stays")))
    # Every row has a key without nulls; what goes grows with the corpus, so it is never broadcast.
    key = lambda doc_id: F.coalesce(doc_id.cast("string"), F.lit(""))
    gone = marked.where("not stays").select(key(F.col("doc_id")).alias("__id"), F.col("tag").alias("__tag")).distinct()
    own = docs.withColumns({"__id": key(F.col("doc_id")), "__tag": tag})
    kept = own.join(gone.hint("merge"), ["__id", "__tag"], "left_anti")
    repeated = materialize(marked.where("stays and n > 1").select(key(F.col("doc_id")).alias("__id"), F.col("tag").alias("__tag")), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    # One row of each of those: a partial aggregate, so that no task gets all repetitions of a document.
    one = F.min(F.struct(*docs.columns)).alias("row")
    again = kept.join(repeated.hint("merge"), ["__id", "__tag"], "left_semi").groupBy("__id", "__tag").agg(one).select("row.*")
    return kept.join(repeated.hint("merge"), ["__id", "__tag"], "left_anti").select(docs.columns).unionByName(again)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), column="__hits")
    return found.where(F.size("__hits") == 0).select(docs.columns)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced and n_chars counted anew."""
    new = pii.pseudonymize(docs, pii.session_key(spark))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their first training position: columns of docs, size, source_size, target, taken, the position of every copy, and the first of them."""
    return mixing.mix(docs, keep=[c for c in docs.columns if c not in ("doc_id", "source")])


STAGES = [
    ("quality", keep_quality),
    ("jaccard", keep_one_of_each),
    ("decontaminate", drop_test_items),
    ("pii", replace_personal),
    ("mix", mix_sources),
]

#: No SQL: the first stage is a learned model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what all stages keep of documents; each stage's result is written and read again, and what it wrote besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written(spark)
        new = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        # The stage before has been read, and the tables that this stage made on its way.
        delete(spark, [p for p in written(spark)[:-1] if p not in before or "/stage-" in p])
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
