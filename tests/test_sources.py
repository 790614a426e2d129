"""Block-gzip files and framed messages."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pathquant.sources import blockgzip, messages, readers, sinks


def test_members_are_gzip():
    data = [b"hello " * 1000, b"", b"x" * 60_000]
    whole = b"".join(blockgzip.member(d, i == 0) for i, d in enumerate(data)) + blockgzip.END
    assert gzip.decompress(whole) == b"".join(data)
    size, head, group = blockgzip.header(whole)
    assert group and blockgzip.header(whole[size:])[2] is False and head == 12 + 6 + 4


def test_messages_round_trip():
    rng = random.Random(0)
    for _ in range(50):
        path = {"mapping": [{"position": {"node_id": rng.choice([1, 2**40]), "offset": rng.choice([None, 5]), "is_reverse": rng.choice([None, True])}, "edit": [{"from_length": rng.choice([None, 3]), "to_length": 300, "sequence": rng.choice([None, "AC"])}]} for _ in range(rng.randrange(4))]}
        row = {"name": "r", "sequence": "ACé", "quality": bytes(rng.randrange(256) for _ in range(5)), "mapping_quality": 60, "score": rng.choice([-7, 5]), "annotation": {"a": "1", "b": ""}, "path": path, "fragment_length_distribution": rng.choice([None, "100:10:2:0:1"])}
        got = dict(zip(messages.ALIGNMENTS.columns, messages.ALIGNMENTS.row(messages.ALIGNMENTS.message(row))))
        assert got["score"] == row["score"] and got["quality"] == row["quality"] and got["annotation"] == row["annotation"] and got["sequence"] == "ACé"
        want = [((m["position"]["node_id"], m["position"]["offset"], m["position"]["is_reverse"]), [(e["from_length"], e["to_length"], e["sequence"]) for e in m["edit"]]) for m in path["mapping"]]
        assert got["path"] == (want,) and got["fragment_length_distribution"] == row["fragment_length_distribution"]
    # unknown fields of all wire types are skipped, unpacked numbers are taken, numbers in annotations become texts
    extra = b"\xf8\x06\x05" + b"\xf9\x06" + bytes(8) + b"\xfd\x06" + bytes(4) + b"\xfa\x06\x02ab" + b"\x40\x03\x40\x04"
    note = messages.encode({"annotation": {"fields": [{"key": "n", "value": {"number": 5.0}}, {"key": "t", "value": {"bool": True}}, {"key": "x", "value": {"number": 0.5}}]}}, messages.MULTIPATH)
    got = dict(zip(messages.MULTIPATHS.columns, messages.MULTIPATHS.row(extra + note)))
    assert got["start"] == [3, 4] and got["annotation"] == {"n": "5", "t": "true", "x": "0.5"} and got["subpath"] is None


def test_messages_by_columns_are_those_by_rows():
    """Columns of messages, also of a slice, give the bytes and values of single rows; nulls, zeros and empty lists stay apart."""
    import pyarrow as pa

    rng = random.Random(1)

    def path():
        edits = [{"from_length": rng.choice([None, 3]), "to_length": 300, "sequence": rng.choice([None, "é"])} for _ in range(rng.randrange(3))]
        position = {"node_id": rng.choice([1, 2**40, None]), "offset": rng.choice([None, 0, -5]), "is_reverse": rng.choice([None, False, True])}
        return rng.choice([None, {"mapping": [{"position": rng.choice([None, position]), "edit": edits} for _ in range(rng.randrange(3))]}])

    def subpath():
        return {"path": path(), "score": rng.choice([None, -2, 9]), "next": rng.choice([None, [0, 300]]), "connection": rng.choice([None, [{"next": 1, "score": -1}]])}

    for kind in (messages.ALIGNMENTS, messages.MULTIPATHS):
        own = {"path": path, "subpath": lambda: rng.choice([None, [subpath() for _ in range(3)]]), "annotation": lambda: rng.choice([None, {}, {"a": "1", "b": ""}, {"c": None}]), "quality": lambda: rng.choice([None, b"\0\xff"]), "start": lambda: rng.choice([None, [0, 128]])}
        number, text = lambda: rng.choice([None, 0, 60, -7]), lambda: rng.choice([None, "", "ACé" * 60])
        rows = [{c: own.get(c, number if c in ("score", "mapping_quality") else text)() for c in kind.columns} for _ in range(300)]
        fields = [(c, messages._TYPES[c]) for c in kind.columns]
        columns = [pa.array([list(r[c].items()) if c == "annotation" and r[c] is not None else r[c] for r in rows], t) for c, t in fields]
        batch = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
        data = [kind.message(r) for r in rows]
        assert kind.messages(batch) == data and kind.messages(batch.slice(50, 100)) == data[50:150]
        want = [kind.row(d) for d in data]
        assert list(zip(*[a.to_pylist() for a in kind.batch(data)])) == [tuple(_named(x, t, c) for x, (c, t) in zip(r, fields)) for r in want]
    gone = pa.array([[None]], messages._PATH.field("mapping").type)
    with pytest.raises(ValueError):
        messages.ALIGNMENTS.messages(pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([gone], ["mapping"])], ["path"]))


def _named(x, t, column=""):
    """Tuples of a row as Arrow gives them: by the names of their fields."""
    import pyarrow as pa

    if x is None:
        return None
    if column == "annotation":
        return list(x.items())
    if pa.types.is_struct(t):
        return {f.name: _named(v, f.type) for v, f in zip(x, t)}
    return [_named(v, t.value_type) for v in x] if pa.types.is_list(t) else x


def test_messages_of_one_row_group_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from pathquant.plans import operator_queries as O

    monkeypatch.setattr(O, "shared_path", lambda spark, name: str(tmp_path / name))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert O.QUERIES["message_scan"](spark, "/root/testdata/sf0.001").count() == orders.count()
    assert len(list((tmp_path / "messages").glob("*.gam"))) > 1


def reads(spark, n):
    path = F.expr("named_struct('mapping', array(named_struct('position', named_struct('node_id', id, 'offset', cast(null as bigint), 'is_reverse', id % 2 = 1), 'edit', array(named_struct('from_length', 1, 'to_length', 1, 'sequence', cast(null as string))))))")
    return spark.range(n).select(F.concat(F.lit("read"), F.col("id")).alias("name"), F.expr("repeat(cast(id as string), cast(if(id % 97 = 0, 40000, 5) as int))").alias("sequence"), F.expr("cast(cast(id as string) as binary)").alias("quality"), F.lit(60).alias("mapping_quality"), F.col("id").cast("int").alias("score"), path.alias("path"))


@pytest.mark.parametrize("split", [1, 700, 20_000, 1 << 30])
def test_files_are_read_by_several_tasks(spark, tmp_path, monkeypatch, split):
    """However a file is split, every message is read once, also those that reach over many members."""
    blockgzip.register(spark)
    path = f"{tmp_path}/reads.gam"
    reads(spark, 3000).repartition(3).write.format("gam").mode("append").save(path)
    with pytest.raises(Exception):
        reads(spark, 1).write.format("gam").mode("append").save(path)
    if split == 1:
        split = 4096
    rows = spark.read.format("gam").option("split", str(split)).load(path)
    files = [p.stat().st_size for p in Path(path).glob("*.gam")]
    assert rows.rdd.getNumPartitions() == sum(-(-s // split) for s in files)
    got = rows.select(F.coalesce("score", F.lit(0)).alias("score"), F.length("sequence").alias("n")).collect()  # a zero is left out of a message
    assert sorted((r["score"], r["n"]) for r in got) == sorted((i, len(str(i)) * (40000 if i % 97 == 0 else 5)) for i in range(3000))
    own = readers.read_alignments(spark, path, multipath=False, split=split)
    assert own.select("read_id").distinct().count() == 3000
    assert {(r["score"], r["p"]["node_id"], r["p"]["offset"], r["p"]["is_reverse"]) for r in own.select("score", F.col("path.mapping")[0]["position"].alias("p")).collect()} == {(i, i, 0, i % 2 == 1) for i in range(3000)}


def test_files_without_marks_and_pairs(spark, tmp_path):
    """A file whose members do not say where groups begin is read whole, once; records in a row are pairs."""
    rows = [messages.ALIGNMENTS.message({"name": f"r{i}", "score": i, "sequence": "ACGT" * 50}) for i in range(2500)]
    data = b"".join(blockgzip.groups(b"GAM", iter(rows)))
    untagged = blockgzip.varint(1) + blockgzip.varint(len(rows[0])) + rows[0]
    file = tmp_path / "one.gam"
    file.write_bytes(b"".join(blockgzip.member(d[i : i + 1000]) for d in (data, untagged) for i in range(0, len(d), 1000)) + blockgzip.END)
    blockgzip.register(spark)
    got = readers.read_alignments(spark, str(file), multipath=False, interleaved=True, split=5000)
    assert sorted((r["read_id"], r["mate"], r["score"]) for r in got.collect()) == sorted((i // 2, i % 2 + 1, i % 2500) for i in range(2501))
    with pytest.raises(Exception):
        spark.read.format("gam").load(f"{tmp_path}/none.gam").count()
    (tmp_path / "empty.gam").mkdir()
    assert spark.read.format("gam").load(f"{tmp_path}/empty.gam").count() == 0


def test_multipath_messages(spark, tmp_path):
    blockgzip.register(spark)
    graph = "array(named_struct('path', named_struct('mapping', array(named_struct('position', named_struct('node_id', 7L, 'offset', 0L, 'is_reverse', false), 'edit', array(named_struct('from_length', 2, 'to_length', 2, 'sequence', cast(null as string)))))), 'score', -3, 'next', array(1), 'connection', array(named_struct('next', 1, 'score', -5))))"
    spark.range(5).select(F.lit("ACGT").alias("sequence"), F.array(F.lit(0), F.lit(2)).alias("start"), F.expr(graph).alias("subpath"), F.lit(30).alias("mapping_quality")).write.format("gamp").mode("append").save(f"{tmp_path}/x.gamp")
    got = readers.read_alignments(spark, f"{tmp_path}/x.gamp").collect()
    assert len(got) == 5 and got[0]["start"] == [0, 2]
    part = got[0]["subpath"][0]
    assert part["score"] == -3 and part["next"] == [1] and part["connection"][0]["score"] == -5 and part["path"]["mapping"][0]["position"]["node_id"] == 7


def test_parts_append_to_one_file(spark, tmp_path):
    lines = [f"line {i} " + "x" * (150_000 if i == 7 else i % 50) for i in range(5000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").repartitionByRange(4, "i").sortWithinPartitions("i").select("line")
    sinks.write_lines(df, f"{tmp_path}/out")
    parts = sorted(Path(f"{tmp_path}/out").glob("part-*"))
    assert len(parts) == 4 and not list(Path(f"{tmp_path}/out").glob("_[0-9a-f]*"))
    whole = b"".join(p.read_bytes() for p in parts)
    assert gzip.decompress(whole).decode() == "\n".join(lines) + "\n"
    assert max(blockgzip.header(whole[:64])[0], 0) < 1 << 16
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(lines)
    sinks.write_lines(df.limit(3), f"{tmp_path}/out", overwrite=True)
    assert spark.read.text(f"{tmp_path}/out").count() == 3
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "Name string, x double")
    sinks.write_tsv(table, f"{tmp_path}/tsv", blocks=True)
    text = gzip.decompress(b"".join(p.read_bytes() for p in sorted(Path(f"{tmp_path}/tsv").glob("part-*")))).decode()
    assert text.splitlines()[0] == "Name\tx" and sorted(text.splitlines()[1:]) == ["a\t1.5", "b\t"]


def test_interleaved_pairs_are_numbered_from_file_to_file(spark, tmp_path):
    """Files of even and odd numbers of records: ids have no gaps, and no pair lies in two files."""
    sizes, line = [4, 3, 6, 2], 0
    (tmp_path / "reads").mkdir()
    for i, n in enumerate(sizes):
        (tmp_path / "reads" / f"part-{i}.json").write_text("".join(f'{{"sequence": "A", "score": {line + k}}}\n' for k in range(n)))
        line += n
    want, line, pair = [], 0, 0
    for n in sizes:
        want += [(pair + k // 2, k % 2 + 1, line + k) for k in range(n)]
        line, pair = line + n, pair + (n + 1) // 2
    got = readers.read_alignments(spark, f"{tmp_path}/reads", multipath=False, interleaved=True)
    assert sorted((r["read_id"], r["mate"], r["score"]) for r in got.collect()) == want
    single = readers.read_alignments(spark, f"{tmp_path}/reads", multipath=False)
    assert sorted((r["read_id"], r["score"]) for r in single.collect()) == [(i, i) for i in range(sum(sizes))]
