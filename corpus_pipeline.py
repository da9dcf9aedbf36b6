"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next one.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.

* ``toxicity`` drops the documents that the model rejects.
* ``near_duplicates`` keeps, of every group of linked rows, the one of the smallest id, and of a group without
  any id one row; of rows that repeat their id each counts by its own text; a row without words is its own
  group, but of those that repeat id and text one is kept.
* ``decontaminate`` drops the documents that hold a benchmark window.
* ``personal_data`` puts the kind in the place of every span.
* ``mix`` returns how many words of each document the mix takes.
"""

from pyspark.sql import functions as F

from tablekeeper.llm import decontaminate as benchmark_scan
from tablekeeper.llm import jaccard_join, mixing, pii
from tablekeeper.llm import toxicity as toxic
from tablekeeper.llm.tables import load, staged

#: The toxicity model, trees and samples have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def _packed(docs):
    """What the operators read, and the whole row in one column, so that no name of it meets one of theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def drop_toxic(spark, docs, folder):
    """Documents that are not rejected."""
    model = toxic.train(docs, load(spark, folder, "labels"))
    return toxic.scored(_packed(docs), model, carry=["row"]).where(~F.col("rejected")).select("row.*")


def drop_near_duplicates(spark, docs, folder):
    """One row of each group."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    packed = _packed(docs)
    if not repeated.isEmpty():
        return _one_row_of_each(packed)
    kept = jaccard_join.joined(packed).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept"))
    return packed.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")


def _one_row_of_each(packed):
    """The same where ids repeat: rows are numbered, and groups made of their numbers."""
    rows = staged(packed.withColumn("number", F.monotonically_increasing_id()), "numbered")
    # In this order the first row of a group is the one to keep.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("number"))
    kept = jaccard_join.joined(rows.select(key.alias("doc_id"), "text")).where(
        "n_shingles > 0 AND doc_id.number = component_id.number").select(F.col("doc_id.number").alias("kept"))
    blank = rows.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).groupBy(
        "doc_id", "text").agg(F.min("number").alias("kept")).select("kept")
    return rows.join(kept.unionByName(blank).hint("shuffle_hash"), F.col("number") == F.col("kept"), "left_semi").select(
        "row.*")


def drop_contaminated(spark, docs, folder):
    """Documents without a benchmark window."""
    found = benchmark_scan.contaminated(_packed(docs), load(spark, folder, "benchmark"), carry=["row"])
    return found.where(~F.col("contaminated")).select("row.*")


def redact(spark, docs, folder):
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    out = pii.redacted(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark, docs, folder):
    """Words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact),
    ("mix", mix_sources),
]


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
