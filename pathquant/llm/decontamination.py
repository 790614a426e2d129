"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

Items are partitioned by the size of their shingle sets. The sketch of an item is the s smallest hashes of
its shingles, with s = n - ceil(threshold * n) + 1 for the largest n of the item's partition: a document that
contains the threshold's share of an item holds at least one of any s of its shingles, so the search misses
none, however long the document is. Documents that hold a sketch hash are candidates for that item, and are
verified by counting the item's shingles that they hold: there shingles are found by hash and compared as words.

Texts are compared as lower-case words of letters and digits. An item with fewer words than a shingle is one
shingle of that many words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathquant.llm.common import stored

BROADCAST_BYTES = 64 << 20  # of item shingles that are broadcast at most, with their words; beyond, Spark shuffles


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws, k: int, spelled: bool = False):
    """Hashes of the k-word shingles of an array of words, in order; spelled, structs of the hash and the words."""

    def one(w, i):
        own = [w, *[F.get(ws, i + j) for j in range(1, k)]]
        return F.struct(F.xxhash64(*own).alias("h"), F.concat_ws(" ", *own).alias("words")) if spelled else F.xxhash64(*own)

    return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0))), one)


def _item_shingles(items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, k, h, words): the distinct shingles of each item. Rows that repeat an id may have shingles of several lengths."""
    ws = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    parts = []
    for size in range(1, k + 1):
        own = ws.where(F.size("ws") >= k) if size == k else ws.where(F.size("ws") == size)
        parts.append(own.select("item_id", F.lit(size).alias("k"), F.explode(F.array_distinct(shingles(F.col("ws"), size, True))).alias("s")).select("item_id", "k", "s.h", "s.words"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def containment(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared) with den * shared >= num * item_shingles.

    Null and empty texts hold no shingles and items without words are in no document. Rows that repeat an
    id are taken as one document, or item, with all their shingles. Null ids are not reported. Empty tables
    give an empty result. Other columns are not read. Texts are read whole, however long; all their shingles are looked up.
    """
    each = stored(_item_shingles(items.where(F.col(item_id_col).isNotNull()), item_id_col, item_text_col, k), "decontam-shingles")
    # an item's size counts its shingles of all lengths, and one sketch is drawn from all of them
    full = stored(each.join(each.groupBy("item_id").agg(F.count("*").alias("n")), "item_id"), "decontam-items")
    # partitions by powers of two of the size; within one, every sketch is as long as its largest item needs
    band = F.floor(F.log2(F.col("n"))).cast("int")
    most = (F.pow(F.lit(2), band + 1) - 1).cast("long")
    length = most - F.ceil(most * num / F.lit(den)) + 1
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "words"))
    sketch = stored(full.withColumn("band", band).withColumn("place", place).where(F.col("place") <= length).select("k", "h", "item_id"), "decontam-sketch")

    def sized(df: DataFrame) -> DataFrame:
        spelled = F.sum(F.octet_length("words")) if "words" in df.columns else F.lit(0)
        rows, held = df.agg(F.count("*"), F.coalesce(spelled, F.lit(0))).first()
        return F.broadcast(df) if 80 * rows + held <= BROADCAST_BYTES else df

    lengths = sorted(r["k"] for r in sketch.select("k").distinct().collect())  # k values at most
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def of(rows: DataFrame, spelled: bool = False) -> DataFrame:
        """(doc_id, k, h) of every shingle, or with its words; the words of a text are cut out once."""
        cut = rows.select("doc_id", words(F.col("text")).alias("ws"))

        def tagged(n: int):
            return F.transform(shingles(F.col("ws"), n, spelled), lambda s: F.struct(F.lit(n).alias("k"), s.alias("s")))

        if len(lengths) == 1:
            each = cut.select("doc_id", F.lit(lengths[0]).alias("k"), F.explode(shingles(F.col("ws"), lengths[0], spelled)).alias("s"))
        else:  # shingles of all lengths out of one pass
            each = cut.select("doc_id", F.explode(F.concat(*map(tagged, lengths))).alias("x")).select("doc_id", "x.k", "x.s")
        return each.select("doc_id", "k", "s.h", "s.words") if spelled else each.withColumnRenamed("s", "h")

    if not lengths:
        return base.select("doc_id").join(items.select(F.col(item_id_col).alias("item_id")), F.lit(False)).select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), F.lit(0).cast("long").alias("item_shingles"), F.lit(0).cast("long").alias("shared"))
    found = stored(of(base).join(sized(sketch), ["k", "h"]).select("doc_id", "item_id").distinct(), "decontam-candidates")
    suspects = base.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = of(suspects, True).join(sized(full), ["k", "h", "words"]).select("doc_id", "item_id", "words", "n").distinct()
    shared = shared.groupBy("doc_id", "item_id").agg(F.first("n").alias("item_shingles"), F.count("*").alias("shared"))
    verified = shared.join(found, ["doc_id", "item_id"], "left_semi").where(F.col("shared") * den >= F.col("item_shingles") * num)
    return verified.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), "item_shingles", "shared")


def op7_minhash_containment(spark, sf_dir):
    return containment(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
ik AS (SELECT item_id, ws, least(5, len(ws)) AS k FROM i WHERE len(ws) > 0),
si AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j+k-1], ' '))) AS h FROM ik),
sd AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j+k-1], ' '))) AS h FROM d, (SELECT DISTINCT k FROM si) WHERE len(ws) >= k),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n) AS BIGINT) AS item_shingles, CAST(count(*) AS BIGINT) AS shared
FROM sd JOIN si USING (k, h) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)
"""
