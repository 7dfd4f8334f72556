"""Readers of run results, record stores, corpora, logs and tables.

All data goes through Spark's readers, so any path that Spark can open will do. YAML and TOML have no
reader there; such files are small configuration and are parsed from their text.
"""

from __future__ import annotations

import json
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources import schemas
from sparkloom.sources.json_arrays import read_array
from sparkloom.sources.workspace import listing

#: Names of runs, split into what they say.
RUN_NAME = r"^([^_]+(?:-[^_]+)*)_([a-z]+)_([a-z-]+)_([^_]+)_(\d+)trials?(?:_(\d+)tasks?)?\.json$"


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read by suffix: JSON, YAML, TOML, text, CSV or Parquet (S01); any other raises."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    if suffix in ("txt", "md"):
        return spark.read.text(path, wholetext=True)
    if suffix in ("yaml", "yml", "toml"):
        # One configuration file: its text is parsed to one record.
        parsed = [_parse(row.value, suffix) for row in spark.read.text(path, wholetext=True).limit(1).collect()]
        rows = spark.createDataFrame([(json.dumps(x, default=str),) for x in parsed], "json string")
        return rows.select(F.from_json("json", schema).alias("r")).select("r.*") if schema else rows.select(F.parse_json("json").alias("record"))
    if suffix == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{suffix} files")


def _parse(text: str, suffix: str) -> object:
    if suffix == "toml":
        return tomllib.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text)


def read_files(spark: SparkSession, paths: list[str], extension: str, schema: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of an extension under files, folders and globs, each once."""
    reader = spark.read.option("pathGlobFilter", f"*{extension}" if extension.startswith(".") else extension).option("recursiveFileLookup", recursive)
    if extension.endswith(".json") or extension == "json":
        reader = reader.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(sorted(set(paths)))
    return reader.text(sorted(set(paths)), wholetext=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Runs from one JSON file or a folder of metadata and simulations (S02, S04): one row a run."""
    return spark.read.schema(schemas.RESULTS).option("multiLine", True).json(path)


def index_problems(spark: SparkSession, path: str) -> DataFrame:
    """``id, problem`` of simulations that a folder's index names without a file, or that have a file without being named.

    Only the names of the files, or of their folders ``sim_id=ID``, are read. Without an index, as in a run in one file, there are none.
    """
    folder = path.rsplit("/", 1)[0] if path.endswith(".json") else path
    indexed = read_metadata(spark, path).where("simulation_index IS NOT NULL")
    named = indexed.select(F.explode("simulation_index.id").alias("id")).distinct().withColumn("named", F.lit(True))
    if results_format(spark, path) != "dir":
        return named.where("false").select("id", F.lit("missing").alias("problem"))
    with listing(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/simulations")
    name = F.coalesce(F.nullif(F.regexp_extract("path", r"/sim_id=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.json$", 1))
    stored = files.select(name.alias("id")).withColumn("stored", F.lit(True))
    problem = F.when(F.col("stored").isNull(), "missing").when(F.col("named").isNull(), "extra")
    found = named.join(stored, "id", "full_outer").select("id", problem.alias("problem")).where("problem IS NOT NULL")
    return found.join(indexed.select(F.lit(1)).limit(1), how="left_semi")


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A run's simulations from either format; an index that doesn't fit the files raises."""
    problems = index_problems(spark, path)
    first = problems.orderBy("problem", "id").limit(20).collect()
    if first:
        raise ValueError(f"the index of {path} doesn't fit its files: " + ", ".join(f"{r.problem} {r.id}" for r in first))
    return read_simulations(spark, path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Runs without their simulations; column pruning keeps them out of the parse."""
    return spark.read.schema(schemas.METADATA).option("multiLine", True).json(path)


def results_format(spark: SparkSession, path: str) -> str:
    """``dir`` if a run has its simulations beside it, else ``json``."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = base.getParent() if path.endswith(".json") else base
    return "dir" if files.exists(jvm.org.apache.hadoop.fs.Path(folder, "simulations")) else "json"


def read_simulations(spark: SparkSession, path: str) -> DataFrame:
    """One row a simulation, from either format (S06, S10); a run in one file is read by as many tasks as it has splits."""
    if results_format(spark, path) == "dir":
        folder = path.rsplit("/", 1)[0] if path.endswith(".json") else path
        files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("multiLine", True)
        with listing(spark):
            return files.schema(schemas.fields(schemas.SIMULATION)).json(f"{folder}/simulations")
    return read_array(spark, path, "simulations", schemas.fields(schemas.SIMULATION))


def with_tasks(simulations: DataFrame, tasks: DataFrame) -> DataFrame:
    """Simulations with their tasks' columns; a missing task leaves them NULL."""
    return simulations.join(tasks, simulations["task_id"] == tasks["id"], "left").drop(tasks["id"])


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment rows with a source, numbers coerced, and their number in their file.

    Numbers are those of lines: the header is 1, so rows start at 2; rows without a source are counted too.
    """
    rows = spark.read.schema(schemas.EXPERIMENTS).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)
    place = Window.partitionBy("__file").orderBy("__block", "__row")
    rows = rows.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    rows = rows.withColumn("line_number", F.row_number().over(place) + 1).drop("__file", "__block", "__row")
    numbers = ["num_tasks", "num_simulations", "pass_1", "pass_2", "pass_3", "rho"]
    kept = rows.where(F.trim(F.coalesce("simulation_source", F.lit(""))) != "")
    typed = kept.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    normal = {c: F.lower(F.trim(c)) for c in ("scenario", "domain", "language")}
    return typed.withColumns(normal).withColumn("source_row", F.col("line_number") - 2)


def clean_experiments(rows: DataFrame, wanted: dict[str, list[str]], metrics: list[str], keys: list[str], order: str = "source_row") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are wanted and have a metric, the last of each key (S12): the rows, the keys given more than once, and an audit.

    ``wanted`` maps a column to its allowed values. The audit is one row of counts, from one pass.
    """
    fits = reduce(lambda a, b: a & b, (F.coalesce(F.col(c).isin(values), F.lit(False)) for c, values in wanted.items()), F.lit(True))
    measured = F.coalesce(*(F.col(m).isNotNull() & ~F.isnan(m) for m in metrics[:1]), F.lit(False))
    for m in metrics[1:]:
        measured = measured | F.coalesce(F.col(m).isNotNull() & ~F.isnan(m), F.lit(False))
    kept = rows.where(fits & measured)
    rest = [c for c in rows.columns if c not in keys]
    clean = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
    groups = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    totals = rows.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(fits).alias("rows_matching"), F.count_if(fits & measured).alias("rows_before_dedupe"))
    after = groups.agg(F.count(F.lit(1)).alias("clean_rows"), F.count_if(F.col("row_count") > 1).alias("duplicate_groups"))
    audit = totals.crossJoin(F.broadcast(after)).withColumn("excluded_rows", F.col("raw_rows") - F.col("rows_before_dedupe"))  # one row each
    return clean, groups.where("row_count > 1"), audit


def log_intervals(spark: SparkSession, path: str, last_seconds: int = 20, name: str = "file_name", log: str | None = None) -> DataFrame:
    """Per log: silence after the last sound of the agent, the reward, and speech events within it.

    A file is a log, and ``name`` says what ``file`` holds, ``file_name`` or ``file_path``. Where files hold many logs,
    ``log`` is a pattern whose group is the name of a line's log, which ``file`` holds then; such files are read by
    splits. A log's lines lie in one file, in order; lines that name no log are left out.

    The agent last spoke in the last completed tick that is followed, within nine lines, by audio of some
    bytes. A log without such a tick or without an end has no row.
    """
    stamp = r"^.*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+).*"
    if log is None:
        with listing(spark):
            logs = spark.read.text(path, wholetext=True)
        files = logs.select(F.col(f"_metadata.{name}").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    else:
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        files = spark.read.option("lineSep", "\n").text(path).select(F.regexp_extract("value", log, 1).alias("file"), place.alias("at"), F.col("value").alias("line")).where("file <> ''")
    # Few lines say it: only those are searched for the time before it.
    when = lambda what: F.when(F.col("line").rlike(what) & F.col("line").rlike(stamp + what), F.to_timestamp(F.regexp_extract("line", stamp, 1)))
    audio = F.regexp_extract("line", r"Agent audio: (\d+) bytes", 1).try_cast("long")
    reward = F.nullif(F.regexp_extract("line", r"Reward:\s*([\d.]+)", 1), F.lit(""))
    # What a line says goes on, not its text.
    said = files.select("file", "at", when(r"Tick \d+ completed").alias("tick"), audio.alias("audio"), when("FINISHED SIMULATION").alias("end"), when("(speech_started|Speech started detected)").alias("began"), when(r"\[USER\].*speech=True").alias("user"), reward.alias("reward"))
    heard = F.max("audio").over(Window.partitionBy("file").orderBy("at").rowsBetween(1, 9)) > 0
    lines = said.withColumn("sound", F.when(heard, F.col("tick")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    found = lines.groupBy("file").agg(last("sound").alias("sound"), last("end").alias("end"), last("reward").cast("double").alias("reward"), F.array_compact(F.collect_list("began")).alias("began"), F.array_compact(F.collect_list("user")).alias("user"))
    late = F.col("end") - F.make_dt_interval(secs=F.lit(last_seconds))
    after = lambda c, t: F.size(F.filter(c, lambda x: x > t))
    return found.where("sound IS NOT NULL AND end IS NOT NULL").select(
        "file", ((F.unix_micros("end") - F.unix_micros("sound")) / 1e6).alias("silence_seconds"), F.coalesce("reward", F.lit(0.0)).alias("reward"), F.size("began").alias("speech_started"), after("began", F.col("sound")).alias("speech_in_silence"), after("began", late).alias("speech_at_end"),
        after("user", F.col("sound")).alias("user_speech_in_silence"), after("user", late).alias("user_speech_at_end"),
    )


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of JSON documents; of equal ids the last by file name stays."""
    docs = spark.read.schema("id STRING, title STRING, content STRING").option("multiLine", True).json(folder).withColumn("__file", F.col("_metadata.file_path"))
    return docs.groupBy("id").agg(F.max_by(F.struct("title", "content"), "__file").alias("d")).select("id", "d.*")


def read_collections(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One collection of a record store file as rows: a map by id, or a list."""
    record = read_any(spark, path, f"`{name}` {schema}")
    if schema.upper().startswith("MAP"):
        return record.select(F.explode(name).alias("record_id", "r")).select("record_id", "r.*")
    return record.select(F.explode(name).alias("r")).select("r.*")


def read_submissions(spark: SparkSession, path: str, schema: str, manifest: DataFrame | None = None) -> DataFrame:
    """Submission files; bad ones are left out, a manifest says which count."""
    with listing(spark):
        rows = spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("submission", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:submission=)?([^/]+)/[^/]+$", 1)).where("_corrupt_record IS NULL").drop("_corrupt_record")
    return rows.join(manifest.select("submission"), "submission", "left_semi") if manifest is not None else rows


def read_log_events(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """Log lines by the first pattern that they match, with its first group, counted later."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    kind = text = None
    for name, pattern in patterns.items():
        hit = F.col("line").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        found = F.regexp_extract("line", pattern, 1)
        text = F.when(hit, found) if text is None else text.when(hit, found)
    return lines.select("file", "line", kind.alias("event"), text.alias("detail")).where("event IS NOT NULL")


def run_name_parts(name: str = "file_name") -> dict:
    """What a run's file name says, as columns (S18, S19); NULL where it doesn't say."""
    part = lambda k: F.nullif(F.regexp_extract(name, RUN_NAME, k), F.lit(""))
    return {"llm": part(1), "domain": part(2), "mode": part(3), "user_llm": part(4), "num_trials": part(5).try_cast("int"), "num_tasks": part(6).try_cast("int")}


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of a folder with the parameters in their names (S18, V51): the file's, or its folder's if that is called ``run=NAME.json``."""
    rows = spark.read.schema(schemas.RESULTS).option("multiLine", True).json(folder)
    named = F.regexp_extract(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"/run=([^/]+\.json)/[^/]+$", 1)
    return rows.withColumn("file_name", F.coalesce(F.nullif(named, F.lit("")), F.col("_metadata.file_name"))).withColumns(run_name_parts())


def audio_figures(content: str = "content") -> dict:
    """Rate, channels, bits and seconds that the header of WAV bytes tells, as columns."""

    def little(at: int, n: int) -> Column:
        digits = F.array_join(F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda k: F.hex(F.substring(content, at + 1 + k, 1))), "")
        return F.conv(digits, 16, 10).cast("long")

    rate, channels, bits = little(24, 4), little(22, 2), little(34, 2)
    return {"rate": rate, "channels": channels, "bits": bits, "seconds": F.try_divide((F.octet_length(content) - 44).cast("double"), (rate * channels * bits / 8).cast("double"))}


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """WAV files as bytes with what their headers tell."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content").withColumns(audio_figures())
