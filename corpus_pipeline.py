"""A pipeline from documents to shards. Each stage reads what its predecessor kept.

1. language_id: documents without a language go: those without a letter, those without a language of half the posterior,
   and those that equally likely bytes explain better by 2.5 bits a byte. Without any label only the letter is asked for.
2. ngram_jaccard_join: of documents linked by five-word shingles at a similarity of 0.8, that of the smallest id stays.
3. benchmark_decontamination: documents that contain 0.8 of a benchmark item's five-word shingles go.
4. source_mixing: documents come as often as the mix takes them.
5. sharding: the mixed documents are put into 16 shards.

All but the last return the columns of documents, whatever their names: inside a stage columns are numbered, so none can
clash with a stage's own. Stages 2 and 3 decide row by row, so that rows with a null or a repeated id are documents like
others; of equal ids, or only null ones, in a group one row stays. An empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathquant.llm import decontamination, jaccard, langid, mixing, sharding
from pathquant.llm.common import shared_path, stored
from pathquant.plans.store import stored_run

ROW = "row_key"
MIN_SCORE, MIN_EVIDENCE = 0.5, -2.5  # short texts of mostly numbers have an evidence between -2 and 0


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ..., and the new name of each; of equal names the first."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language. A null, an empty and a letterless text has none; repeated rows fare alike.

    The model is learned from labelled rows (null labels are not used); labels are no input of a decision. Texts are
    scored whole, however long. An empty table stays empty.
    """
    rows, name = numbered(docs)
    ident, text = name["doc_id"], name["text"]
    model = langid.fit(rows.where(~langid.held_out(ident)), id_col=ident, text_col=text, lang_col=name["lang"])
    if not model[0]:  # nothing is labelled: there is no language to reject by
        return rows.where(F.col(text).rlike(r"\p{L}")).toDF(*docs.columns)
    scored = langid.predict(rows, model, id_col=ident, text_col=text, passed=rows.columns, evidence=True)
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE) & (F.col("evidence") > MIN_EVIDENCE))
    return kept.select(*rows.columns).toDF(*docs.columns)


def keyed(rows: DataFrame) -> DataFrame:
    """rows with a key of each, written down, as such keys differ from run to run."""
    return stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that of the smallest id, an id before none, and of equal ids any one.

    Null texts and texts without words are linked with nothing and stay. Repeated rows are copies. Texts are read
    whole. An empty table stays empty.
    """
    plain, name = numbered(docs)
    rows = keyed(plain)
    groups = jaccard.jaccard_components(rows, k=5, num=80, den=100, id_col=ROW, text_col=name["text"]).select(ROW, "component_id")
    placed = stored(groups.join(rows.select(ROW, F.col(name["doc_id"]).alias("id")), ROW), "pipeline-groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", ROW)
    first = placed.groupBy("component_id").agg(F.min(order)[ROW].alias(ROW))
    copies = placed.select(ROW).join(first.select(ROW), ROW, "left_anti")  # by row: a large group is no hot key
    return rows.join(copies, ROW, "left_anti").select(*plain.columns).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds less than 0.8 of the shingles of every benchmark item.

    Null and empty texts hold none and stay, as does every row if there are no items. Texts are read whole. Repeated
    rows fare alike. An empty table stays empty.
    """
    plain, name = numbered(docs)
    rows = keyed(plain)
    found = decontamination.containment(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, num=80, den=100, id_col=ROW, text_col=name["text"])
    return rows.join(found.select(ROW).distinct(), ROW, "left_anti").select(*plain.columns).toDF(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, up to three times. Null, empty and wordless texts are never taken.

    A null source is a source of its own. Repeated rows are queued one by one. An empty table stays empty.
    """
    rows, name = numbered(docs)
    mixed = mixing.mix(rows, id_col=name["doc_id"], text_col=name["text"], source_col=name["source"], keep=True).where("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*").toDF(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; see ``sharding.shard`` for odd rows."""
    rows, name = numbered(docs)
    return sharding.shard(rows, id_col=name["doc_id"], text_col=name["text"]).withColumnRenamed(name["doc_id"], "doc_id")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]
#: SQL can't express the learned language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with stored_run(spark):  # what the stage writes on the way goes
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
