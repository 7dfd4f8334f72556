"""Writers of results, tables and checkpoints."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.topk import greedy_until
from sparkloom.sources import schemas

#: Folders that a task writes, about; a file takes some 20 ms, whatever it holds.
FOLDERS = 100


def _swapped(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Write beside ``path``, then take its place: what was there stays until all is written, also if ``df`` reads it.

    The old folder is moved aside and deleted last, so nothing is lost at any moment: a run that breaks off between
    the two moves leaves ``path`` empty, with the whole old and new folders beside it (``.old-`` and ``.new-``).
    """
    context = df.sparkSession.sparkContext
    jvm = context._jvm
    name, place = uuid.uuid4().hex, path.rstrip("/")
    write(df, f"{place}.new-{name}")
    target, old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (place, f"{place}.old-{name}", f"{place}.new-{name}"))
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    held = files.exists(target)
    if held and not files.rename(target, old):
        raise OSError(f"{path} could not be moved aside; the new folder is {new}")
    if not files.rename(new, target):
        if held:
            files.rename(old, target)
        raise OSError(f"{new} could not take the place of {path}")
    if held:
        files.delete(old, True)


def by_folder(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt so that each key's are in one task and tasks have about ``FOLDERS`` keys each, however small the data."""
    keys = df.agg(F.approx_count_distinct(key)).first()[0]
    return df.repartition(max(1, math.ceil(keys / FOLDERS)), key)


def write_folders(df: DataFrame, path: str, key: str, layout: str) -> None:
    """A folder for each key into ``path``, which must be new: tasks move their own files to their place, not the driver one by one."""
    df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).format(layout).save(path)


def write_results(df: DataFrame, path: str, layout: str = "json") -> None:
    """Simulations as one folder, or as a folder for each (K02, K10); a folder that is there is replaced when all is written."""
    if layout == "json":
        _swapped(df, path, lambda d, p: d.write.json(p))
    elif layout == "dir":
        _swapped(df.withColumn("sim_id", F.col("id")), path, lambda d, p: write_folders(by_folder(d, "sim_id"), p, "sim_id", "json"))
    else:
        raise ValueError(f"unknown layout {layout}")


def simulation_index(df: DataFrame) -> DataFrame:
    """The light index of simulations."""
    return df.select("id", "task_id", "trial", F.col("reward_info.reward").alias("reward"), "termination_reason", "agent_cost", "duration")


def one_per_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``, else (and among equals) the greatest as a row."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    kept = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    return rows.groupBy(*keys).agg(F.max(kept).alias("__r")).select(*(F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in rows.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with rows of the same key replaced and others added (K05): running it twice changes nothing."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(one_per_key(new, keys, order), allowMissingColumns=True)


def append_new(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Only the rows whose key isn't there yet, for an appending write."""
    return one_per_key(new.join(existing.select(*keys), keys, "left_anti"), keys, order)


def resumed(existing: DataFrame, planned: DataFrame, keys: list[str], termination: str = "termination_reason", void: tuple[str, ...] = ("infrastructure_error",)) -> tuple[DataFrame, DataFrame]:
    """What a run that is taken up again keeps, and what it has still to do (K05): runs that the infrastructure ended are done anew."""
    kept = existing.where(~F.coalesce(F.col(termination).isin(*void), F.lit(False)))
    return kept, planned.join(kept.select(*keys), keys, "left_anti")


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """One CSV file with a header; floats with fixed digits, missing values empty."""
    kinds = dict(df.dtypes)

    def shown(name: str) -> Column:
        if digits is not None and kinds[name] in ("double", "float"):
            return F.when(F.isnan(name) | F.col(name).isNull(), None).otherwise(F.format_string(f"%.{digits}f", F.col(name))).alias(name)
        return F.col(name)

    df.select(*(shown(c) for c in df.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def trimmed(df: DataFrame, message_fields: list[str], simulation_fields: list[str], messages: str = "messages") -> DataFrame:
    """Simulations without the named fields, and the bytes that this saves."""
    before = F.octet_length(F.to_json(F.struct(*df.columns)))
    slim = df.withColumn("__before", before).withColumn(messages, F.transform(messages, lambda m: m.dropFields(*message_fields))).drop(*simulation_fields)
    kept = [c for c in slim.columns if c != "__before"]
    return slim.withColumn("saved_bytes", F.col("__before") - F.octet_length(F.to_json(F.struct(*kept)))).drop("__before")


def truncated(df: DataFrame, key: str, bound: int, keep: int = 200, messages: str = "messages", content: str = "content", role: str = "tool") -> DataFrame:
    """Records of which the longest messages of a role are cut, longest first, until the record's contents fit.

    ``bound`` and ``keep`` are characters. Equal lengths are cut in the order of the messages; a record that
    doesn't fit even so has all of them cut.
    """
    size = F.coalesce(F.length(F.col("m")[content]), F.lit(0))
    total = F.aggregate(F.coalesce(messages, F.array()), F.lit(0), lambda a, m: a + F.coalesce(F.length(m[content]), F.lit(0)))
    each = df.select(key, total.alias("__total"), F.posexplode(messages).alias("at", "m")).withColumn("__size", size)
    long = each.where((F.col("m.role") == role) & (F.col("__size") > keep))
    cut = greedy_until(long, [key], [F.desc("__size"), F.col("at")], F.col("__size") - keep, F.col("__total"), bound)
    marks = cut.groupBy(key).agg(F.collect_set("at").alias("__cut"))
    shorter = F.transform(messages, lambda m, i: F.when(F.array_contains("__cut", i), m.withField(content, F.left(m[content], F.lit(keep)))).otherwise(m))
    return df.join(marks, key, "left").withColumn(messages, F.when(F.col("__cut").isNotNull(), shorter).otherwise(F.col(messages))).drop("__cut")


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(str(k))} = {_toml(v)}" for k, v in value.items() if v is not None) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(_toml(v) for v in value if v is not None) + "]"
    return json.dumps(value)


def _record_text(df: DataFrame, suffix: str) -> str:
    """One configuration record as YAML or TOML; NULLs are left out of TOML, which has none."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a .{suffix} file holds one record")
    record = json.loads(rows[0].j)
    if suffix == "toml":
        return "".join(f"{json.dumps(k)} = {_toml(v)}\n" for k, v in record.items() if v is not None)
    try:
        import yaml
    except ImportError:
        return json.dumps(record, indent=1)  # JSON is YAML
    return yaml.safe_dump(record, sort_keys=False, allow_unicode=True)


def write_any(df: DataFrame, path: str) -> None:
    """Write by suffix: JSON, YAML, TOML, text or Markdown, CSV, Parquet (K01); any other raises.

    Text files take the frame's one text column, YAML and TOML its one row.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        df.write.mode("overwrite").json(path)
    elif suffix in ("yaml", "yml", "toml"):
        df.sparkSession.createDataFrame([(_record_text(df, suffix),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif suffix in ("txt", "md"):
        df.write.mode("overwrite").text(path)
    elif suffix == "csv":
        write_csv(df, path)
    elif suffix == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no writer for .{suffix} files")


def write_metadata(df: DataFrame, path: str) -> None:
    """A run's metadata beside its simulations, which stay as they are (K03), as does the index that is on disk."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    new = df.drop("simulations")
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.schema(schemas.METADATA).option("multiLine", True).json(path).limit(1).select(F.col("simulation_index").alias("__index"))
        new = new.drop("simulation_index").join(old, how="left").withColumnRenamed("__index", "simulation_index")  # one row each
    _swapped(new, path, lambda d, p: d.write.json(p))
