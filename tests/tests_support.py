"""Builders of small graphs and reads."""

from pyspark.sql import functions as F

from pathquant.operators import paths

SCHEMA = (
    "read_id long, mate int, sequence string, quality binary, score int, mapping_quality int, path struct<mapping:array<struct<position:struct<node_id:long,offset:long,is_reverse:boolean>,edit:array<struct<from_length:int,to_length:int>>>>>, "
    "start array<int>, subpath array<struct<path:struct<mapping:array<struct<position:struct<node_id:long,offset:long,is_reverse:boolean>,edit:array<struct<from_length:int,to_length:int>>>>>,score:int,next:array<int>,connection:array<struct<next:int,score:int>>>>, annotation map<string,string>"
)


def m(node, *edits, offset=None):
    """A mapping; a negative node is reversed; an edit is (from, to) or a length for both."""
    return ((abs(node), offset, node < 0 or None), [(e, e) if isinstance(e, int) else e for e in edits])


def single(mappings, length, score=0, mapq=10, mate=1):
    return (0, mate, "A" * length, None, score, mapq, (mappings,), None, None, None)


def multi(start, parts, length, mapq=10, mate=1, annotation=None):
    return (0, mate, "A" * length, None, None, mapq, None, start, [((ms,), score, nxt, None) for ms, score, nxt in parts], annotation)


def index(spark, lengths, *walks):
    """Paths as lists of nodes, negative if reversed; "rc" after a walk adds it the other way too."""
    nodes = spark.createDataFrame(list(lengths.items()), "node_id long, length int")
    rows, n = [], 0
    for w in walks:
        both = [w[:-1], [-x for x in w[-2::-1]]] if w[-1] == "rc" else [w]
        for own in both:
            rows += [(n, i, abs(x), x < 0) for i, x in enumerate(own)]
            n += 1
    steps = spark.createDataFrame(rows, "path_id long, ordinal int, node_id long, is_reverse boolean")
    return paths.with_offsets(steps, nodes).withColumn("node", F.col("node_id") * 2 + F.col("is_reverse").cast("int")).cache()
