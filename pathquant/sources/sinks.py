"""Result tables in the layouts of the text outputs, and writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.operators.inference import path_abundances, tpm
from pathquant.sources import blockgzip


def significant(number, digits: int = 8):
    """A number as text with so many significant digits, without zeros at the end; very small and very large ones with an exponent."""
    text = F.regexp_replace(F.format_string(f"%.{digits}g", number), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.when(number.isNotNull(), F.regexp_replace(text, r"\.(e|$)", "$1"))


def write_tsv(df: DataFrame, path: str, gzip: bool = False, blocks: bool = False) -> None:
    """Tab-separated files with a header each; numbers keep eight significant digits. With blocks only the first has one:
    the files are parts of one block-gzip file, see ``write_lines``."""
    numbers = {f.name: significant(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.simpleString() == "double"}
    df = df.withColumns(numbers)
    if blocks:
        head = df.sparkSession.range(1, numPartitions=1).select(F.lit("\t".join(df.columns)).alias("line"))
        write_lines(head.union(df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]))), path)
    else:
        df.write.option("sep", "\t").option("header", "true").option("compression", "gzip" if gzip else "none").csv(path)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Lines (one column) as block-gzip parts: appended in their order, the parts are one block-gzip file."""
    blockgzip.register(lines.sparkSession)
    lines.write.format("blockgzip-text").mode("overwrite" if overwrite else "append").save(path)


def abundance_table(result: DataFrame, members: DataFrame, denominator: float, unknown: float, with_haplotypes: bool = False) -> DataFrame:
    """Name, ClusterID, Length, EffectiveLength, [HaplotypeProbability,] ReadCount, TPM, with a row for unknown reads."""
    spark = result.sparkSession
    rows = members.join(path_abundances(result), ["cluster_id", "path_id"], "left")
    count = F.coalesce("read_count", F.lit(0.0))
    probability = [F.coalesce("posterior", F.lit(0.0)).alias("HaplotypeProbability")] if with_haplotypes else []
    rows = rows.select(F.col("name").alias("Name"), (F.col("cluster_id") + 1).alias("ClusterID"), F.col("length").cast("double").alias("Length"), F.col("effective_length").alias("EffectiveLength"), *probability, count.alias("ReadCount"), tpm(count, F.col("effective_length"), denominator).alias("TPM"))
    last = spark.range(1).select(F.lit("Unknown").alias("Name"), F.lit(0).cast("long").alias("ClusterID"), F.lit(0.0).alias("Length"), F.lit(0.0).alias("EffectiveLength"), *([F.lit(0.0).alias("HaplotypeProbability")] if with_haplotypes else []), F.lit(float(unknown)).alias("ReadCount"), F.lit(0.0).alias("TPM"))
    return rows.unionByName(last)


def haplotype_table(result: DataFrame, members: DataFrame, ploidy: int, precision: float) -> DataFrame:
    """Name_1 ... Name_ploidy, ClusterID, HaplotypingProbability of combinations with at least the precision."""
    rows = _named(result.where("kind = 'group'").where(F.col("posterior") >= precision), members)
    return rows.select(*[F.coalesce(F.get("names", F.lit(i)), F.lit(".")).alias(f"Name_{i + 1}") for i in range(ploidy)], (F.col("cluster_id") + 1).alias("ClusterID"), F.col("posterior").alias("HaplotypingProbability"))


def joint_table(result: DataFrame, members: DataFrame, ploidy: int, precision: float, denominator: float, unknown: float) -> DataFrame:
    """Names, ClusterID, HaplotypingProbability, and count and TPM of each slot; unknown reads are split over the slots."""
    rows = _named(result.where("kind = 'group'").where(F.col("posterior") >= precision), members)
    columns = [F.coalesce(F.get("names", F.lit(i)), F.lit(".")).alias(f"Name_{i + 1}") for i in range(ploidy)]
    columns += [(F.col("cluster_id") + 1).alias("ClusterID"), F.col("posterior").alias("HaplotypingProbability")]
    for i in range(ploidy):
        count = F.coalesce(F.get("counts", F.lit(i)), F.lit(0.0))
        columns += [count.alias(f"ReadCount_{i + 1}"), F.coalesce(tpm(count, F.get("lengths", F.lit(i)), denominator), F.lit(0.0)).alias(f"TPM_{i + 1}")]
    last = [F.lit("Unknown").alias(f"Name_{i + 1}") for i in range(ploidy)] + [F.lit(0).cast("long").alias("ClusterID"), F.lit(0.0).alias("HaplotypingProbability")]
    for i in range(ploidy):
        last += [F.lit(unknown / ploidy).alias(f"ReadCount_{i + 1}"), F.lit(0.0).alias(f"TPM_{i + 1}")]
    return rows.select(*columns).unionByName(result.sparkSession.range(1).select(*last))


def _named(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the names and effective lengths of the paths of combinations, in their order."""
    keyed = groups.withColumn("_g", F.xxhash64("cluster_id", "path_ids"))
    each = keyed.select("cluster_id", "_g", F.posexplode("path_ids").alias("i", "path_id")).join(members.select("cluster_id", "path_id", "name", "effective_length"), ["cluster_id", "path_id"])
    lists = each.groupBy("cluster_id", "_g").agg(F.array_sort(F.collect_set(F.struct("i", "name", "effective_length"))).alias("l"))
    out = keyed.join(lists, ["cluster_id", "_g"])
    return out.withColumn("names", F.transform("l", lambda x: x["name"])).withColumn("lengths", F.transform("l", lambda x: x["effective_length"])).drop("_g", "l")


def gibbs_table(result: DataFrame, members: DataFrame, samples: int, unknown: list[float]) -> DataFrame:
    """Name, ClusterID, ReadCountSample_1 ... n of sampled paths: 0 where a sample's subset lacks the path. Last, the unknown reads."""
    each = result.where("kind = 'sample'").select("cluster_id", "sample", F.explode(F.arrays_zip("path_ids", "counts")).alias("x")).select("cluster_id", "sample", F.col("x.path_ids").alias("path_id"), F.col("x.counts").alias("c"))
    wide = each.groupBy("cluster_id", "path_id").pivot("sample", list(range(1, samples + 1))).agg(F.sum("c")).fillna(0.0)
    rows = members.select("cluster_id", "path_id", "name").join(wide, ["cluster_id", "path_id"])
    last = [F.lit("Unknown").alias("Name"), F.lit(0).cast("long").alias("ClusterID"), *[F.lit(float(x)).alias(f"ReadCountSample_{i + 1}") for i, x in enumerate(unknown)]]
    return rows.select(F.col("name").alias("Name"), (F.col("cluster_id") + 1).alias("ClusterID"), *[F.col(f"`{i}`").alias(f"ReadCountSample_{i}") for i in range(1, samples + 1)]).unionByName(result.sparkSession.range(1).select(*last))


def probability_lines(probs: DataFrame, members: DataFrame, digits: int = 8) -> DataFrame:
    """(cluster_id, line_no, line) of the probability dump: a mark, the paths, then "count noise prob:path,path ..." per read class."""
    order = F.struct("path_idx", F.concat_ws(",", "name", F.col("length").cast("string"), significant(F.col("effective_length"))).alias("text"))
    heads = members.join(probs.select("cluster_id").distinct(), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"])).alias("line"))
    cells = probs.join(members.select("cluster_id", "path_id", "path_idx"), ["cluster_id", "path_id"], "left")
    same = cells.groupBy("cluster_id", "read_class_id", "read_count", "noise_prob", F.round("prob", digits).alias("p")).agg(F.array_sort(F.collect_list("path_idx")).alias("paths"))
    part = F.when(F.col("p").isNotNull(), F.struct("p", F.concat(significant(F.col("p"), digits), F.lit(":"), F.concat_ws(",", F.col("paths").cast("array<string>"))).alias("text")))
    reads = same.groupBy("cluster_id", "read_class_id", "read_count", "noise_prob").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"])).alias("text"))
    lines = reads.select("cluster_id", F.concat_ws(" ", F.col("read_count").cast("string"), significant(F.col("noise_prob"), digits), F.nullif("text", F.lit(""))).alias("line"))
    marks = heads.select("cluster_id", F.lit(0).alias("line_no"), F.lit("#").alias("line"))
    return marks.unionByName(heads.select("cluster_id", F.lit(1).alias("line_no"), "line")).unionByName(lines.select("cluster_id", F.lit(2).alias("line_no"), "line"))


def write_probability_lines(lines: DataFrame, path: str) -> None:
    """Parts in the order of clusters; the lines of a large cluster go on in the next part."""
    order = ["cluster_id", "line_no", "line"]
    write_lines(lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line"), path)
