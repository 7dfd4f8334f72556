"""Large JSON arrays read by splits, against a JSON parser and against Spark's own reading of whole files."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import json_arrays, readers, schemas
from sparkloom.sources.json_arrays import brackets, read_array, record_in
from sparkloom.sources.workspace import settings

SCHEMA = "id STRING, n INT, inner STRUCT<a: ARRAY<STRUCT<b: STRING>>, s: STRING>"


def test_brackets():
    assert brackets('{"a": [1, "x{[') == (3, 2, 2)
    assert brackets(r'"\"{" [') == (2, 1, 1)
    assert brackets("") == (0, 0, 0)


def test_record_in():
    assert record_in(' , {"a":1}', 2, 2) == (None, '{"a":1}')
    assert record_in('{"t":"[{","info":{},"sims" : [ {"a":1}', 0, 2) == ("sims", '{"a":1}')
    assert record_in(',"b":{"x":1}', 2, 2) is None
    assert record_in('],"k\\"{":[[{}],3,{"a":1}', 2, 2) == ('k"{', '{"a":1}')
    assert record_in('[{"a":1}', 0, 1) == ("", '{"a":1}')


WORDS = ["{", "}", "[", "]", '"', "\\", ",", ":", 'simulations":[{', "é", "😀", "\n", "\t", "漢", "x" * 40, "\\\"}", "]}", "/"]


def text_of(rng):
    return "".join(rng.choices(WORDS, k=rng.choice([0, 1, 4, 30])))


def record(rng, k):
    inner = None if rng.random() < 0.2 else {"a": [{"b": text_of(rng)} for _ in range(rng.randrange(4))], "s": text_of(rng)}
    return {"id": f"r{k}" + text_of(rng), "n": k, "inner": inner, "more": {"deep": [[{"simulations": [{"id": "no"}]}]]}}


def document(rng, n):
    tasks = [record(rng, -k) for k in range(rng.randrange(3))]
    odd = [1, "x", None, [{"id": "no"}]]
    sims = [record(rng, k) for k in range(n)]
    mixed = sims[:1] + odd + sims[1:] if rng.random() < 0.5 else sims
    doc = {"timestamp": text_of(rng), "info": {"a": {"id": "no"}, "b": {"c": {}}, "simulations": [{"id": "no"}]}, "tasks": tasks, "simulations": mixed, "empty": [], "end": {"simulations": {"id": "no"}}}
    keys = list(doc)
    rng.shuffle(keys)
    return {k: doc[k] for k in keys}, sims


def plain(rows):
    return sorted(json.dumps({"id": r["id"], "n": r["n"], "inner": None if r["inner"] is None else {"a": r["inner"]["a"], "s": r["inner"]["s"]}}, sort_keys=True) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_equal_a_parser_whatever_the_cuts(spark, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for k in range(3):
        doc, sims = document(rng, rng.choice([0, 1, 25]))
        (tmp_path / f"f{k}.json").write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + rng.choice(["", "\n"]))
        want += sims
    lines = [document(rng, 5) for _ in range(3)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(doc) for doc, _ in lines))
    want += [s for _, sims in lines for s in sims]
    for size in (rng.randrange(150, 400), 1 << 20):
        with settings(spark, spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="1"):
            got = read_array(spark, f"file://{tmp_path}/*.json", "simulations", SCHEMA).collect()
        assert plain(r.asDict(True) for r in got) == plain(want)


def test_top_level_array_and_odd_files(spark, tmp_path):
    rng = random.Random(9)
    want = [record(rng, k) for k in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(want))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    with settings(spark, spark__sql__files__maxPartitionBytes="300", spark__sql__files__openCostInBytes="1"):
        got = read_array(spark, f"file://{tmp_path}", None, SCHEMA)
        assert plain(r.asDict(True) for r in got.collect()) == plain(want)


def test_one_file_of_100_000_simulations(spark, sf_dir, tmp_path):
    """Made of orders and lines, read by many tasks, equal to the reading of the file as one document."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    copies = lines.join(spark.range(-(-100_000 // lines.select("l_orderkey").distinct().count())).withColumnRenamed("id", "copy"))
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit('said "{['), "l_partkey", F.lit("\\ 😀")).alias("content"))
    sims = copies.groupBy("l_orderkey", "copy").agg(F.collect_list(message).alias("messages"))
    each = sims.select(F.to_json(F.struct(F.concat("l_orderkey", F.lit("-"), "copy").alias("id"), (F.col("l_orderkey") % 9).cast("string").alias("task_id"), "messages")).alias("j"))
    rows = [r.j for r in each.collect()]
    path = tmp_path / "results.json"
    path.write_text('{"timestamp": "t", "info": {"git_commit": "c"}, "tasks": [{"id": "1"}], "simulations": [' + ",\n".join(rows) + "]}")
    assert len(rows) >= 100_000
    with settings(spark, spark__sql__files__maxPartitionBytes=str(2 << 20)):
        got = readers.read_simulations(spark, f"file://{path}")
        assert spark.read.option("lineSep", "}").text(f"file://{path}").rdd.getNumPartitions() == -(-path.stat().st_size // (2 << 20))
        want = readers.read_results(spark, f"file://{path}").select(F.explode("simulations").alias("s")).select("s.*")
        assert got.columns == want.columns == [f.name for f in want.schema]
        hashed = lambda df: tuple(df.select(F.xxhash64("id", "task_id", F.to_json("messages")).alias("h")).agg(F.count("*"), F.sum(F.col("h") % 1_000_003), F.countDistinct("h")).first())
        assert hashed(got) == hashed(want)
    assert readers.read_array(spark, f"file://{path}", "tasks", schemas.fields(schemas.TASK)).select("id").collect()[0].id == "1"


def test_records_are_not_shuffled_to_learn_their_array(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"simulations": [{"id": str(k)} for k in range(50)]}))
    rows = read_array(spark, str(tmp_path / "run.json"), "simulations", "id STRING")
    assert "strategy=broadcast" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(int(r.id) for r in rows.collect()) == list(range(50))


@pytest.mark.parametrize("seed", range(3))
def test_marks_of_a_batch_equal_those_of_its_pieces(seed):
    rng = random.Random(seed)
    pieces = json.dumps([record(rng, k) for k in range(60)], ensure_ascii=False).split("}")
    column = pa.array(["left out", *pieces]).slice(1)
    sums = json_arrays._summed(iter([pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n), column.slice(k, n)], ["file", "split", "value"]) for k, n in ((0, 7), (7, 0), (7, len(pieces) - 7))]))
    got = pa.Table.from_batches(sums).to_pylist()
    whole = brackets("}".join(pieces) + "}")
    assert [(r["quotes"], r["deeper_out"], r["deeper_in"]) for r in got] == [whole]
