"""Sources and sinks: JSONL with provenance, corpora, rollout dumps, key-value caches."""

from __future__ import annotations

import hashlib
import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE_TURN = "turn_index INT, raw_output STRING, information STRING"


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one schema, concatenated."""
    return spark.read.parquet(*paths)


def read_preferences(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths).select("prompt", "chosen", "rejected")


def read_jsonl(spark: SparkSession, *paths: str, schema: str | T.StructType, provenance: bool = False) -> DataFrame:
    """JSON lines of a stated schema; malformed lines are an error, blank lines none. With provenance,
    `_source_path` and `_source_line` (from one, blank lines counted) come along."""
    if not provenance:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(list(paths))
    # Lines come in the order of the file within a split of it, and splits are told apart by where they begin. So a line's number is its
    # place in its split and the lines of the splits before, and large files stay many tasks.
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("_source_path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), "value")
    sizes = lines.groupBy("_source_path", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("_source_path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = lines.join(sizes, ["_source_path", "__start"]).withColumn("_source_line", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")).filter(F.trim("value") != "")
    parsed = placed.select("_source_path", "_source_line", F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "_source_path", "_source_line")


def read_tree_dumps(spark: SparkSession, folder: str, schema: str, first_step: int = 0, last_step: int = 1 << 30) -> DataFrame:
    """Rollout dumps below a folder, by the step in their names `step_NNNNNN[_chunk_CC]_*.jsonl`."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST").schema(schema).json(folder)
    path = F.col("_metadata.file_path")
    got = got.withColumn("step", F.regexp_extract(path, r"step_(\d+)", 1).try_cast("int")).withColumn("chunk", F.coalesce(F.regexp_extract(path, r"_chunk_(\d+)", 1).try_cast("int"), F.lit(0)))
    return got.filter(F.col("step").between(first_step, last_step))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of JSON lines with id and contents, a title line above the body."""
    got = read_jsonl(spark, path, schema="id STRING, contents STRING")
    title = F.substring_index("contents", "\n", 1)
    return got.select(F.col("id").cast("long").alias("doc_id"), F.trim(title, F.lit('"')).alias("title"), F.expr("substr(contents, instr(contents, '\n') + 1)").alias("text"))


def messages(rows: DataFrame, column: str = "messages") -> DataFrame:
    """rows with messages as an array of structs, whether they were one or JSON text."""
    if isinstance(rows.schema[column].dataType, T.StringType):
        return rows.withColumn(column, F.from_json(column, "array<struct<role:string,content:string>>"))
    return rows


def coalesced_messages(messages, prompt_path: str, response_path: str):
    """Messages from a column of JSON text or structs where it is not null, else a user and an assistant turn from two key paths."""
    form = "array<struct<role:string,content:string>>"
    turn = lambda role, path: F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("content"))
    return F.coalesce(F.from_json(messages, form), F.array(turn("user", prompt_path), turn("assistant", response_path)))


def split_path(spark: SparkSession, folder: str, wanted: str = "test", forms: tuple[str, ...] = ("parquet", "jsonl", "json")) -> tuple[str, str]:
    """(split, path) of a dataset folder: the split wanted, else test, dev or train, whichever is there first, in any of the forms. Looked up
    with the cluster's file system, whatever the folder is on."""
    jvm = spark.sparkContext._jvm
    for split in dict.fromkeys((wanted, "test", "dev", "train")):
        for form in forms:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}.{form}")
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                return split, path.toString()
    raise FileNotFoundError(f"no split of {folder}")


def read_dataset(spark: SparkSession, folder: str, schema: str, wanted: str = "test") -> DataFrame:
    """Rows of a dataset folder's split with `split`, from Parquet, JSON lines or a JSON array."""
    split, path = split_path(spark, folder, wanted)
    rows = spark.read.schema(schema).parquet(path) if path.endswith(".parquet") else read_json_array(spark, path, schema) if path.endswith(".json") else read_jsonl(spark, path, schema=schema)
    return rows.withColumn("split", F.lit(split))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def make_folder(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(there)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder copied between any two file systems that the cluster knows; what is there already is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def copy_by_content(spark: SparkSession, source: str, folder: str) -> str:
    """A file or folder copied to `folder`/<hash of its name, sizes and times>/<name>, and that path. What was copied before is not copied again. Copies are
    made beside it and appear by one rename, so of two that copy at once one wins and neither sees half a copy."""
    fs, there = _hadoop(spark, source)
    status = fs.getFileStatus(there)
    files = [status] if status.isFile() else sorted(_files(fs, there), key=lambda f: f.getPath().toString())
    facts = "\n".join(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}" for f in files)
    home = f"{folder}/{hashlib.sha256(facts.encode()).hexdigest()[:32]}"
    target = f"{home}/{there.getName()}"
    if not exists(spark, target):
        staged = f"{folder}/_copying/{uuid4().hex}"
        make_folder(spark, staged)
        copy(spark, source, f"{staged}/{there.getName()}")
        make_folder(spark, folder)
        if not exists(spark, home):
            _move(spark, staged, home)
        _delete(spark, staged)
    return target


def _files(fs, there) -> list:
    found, it = [], fs.listFiles(there, True)
    while it.hasNext():
        found.append(it.next())
    return found


#: Columns of the wide training form, in their order.
WIDE = ("messages", "question", "question_id", "data_source", "teacher_model", "teacher_type", "trajectory", "original_trajectory", "trajectory_sha256", "original_trajectory_sha256", "messages_sha256", "original_token_length", "final_token_length", "compressed", "information_characters_removed", "information_tokens_removed", "information_blocks_compressed")


def write_wide(rows: DataFrame, path: str) -> None:
    """Training rows with messages as canonical JSON text and hashes of what they hold, as Parquet where nothing is yet."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    text = rows.withColumn("messages", canonical_messages(F.col("messages")))
    hashed = text.withColumns({"messages_sha256": sha("messages"), "trajectory_sha256": sha("trajectory"), "original_trajectory_sha256": sha("original_trajectory")})
    write_new(hashed.select(*WIDE), path)


def canonical_messages(messages):
    """JSON text of messages, keys in order and nothing between: content before role."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))), {"ignoreNullFields": "false"})


def manifest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One small row for each row: its key, the hash of each column, and one hash of all."""
    hashes = {c: F.sha2(F.col(c).cast("string").cast("binary"), 256) for c in columns}
    one = F.sha2(F.concat_ws(":", F.col(key).cast("string"), *[F.coalesce(h, F.lit("")) for h in hashes.values()]).cast("binary"), 256)
    return rows.select(key, *[h.alias(f"{c}_sha256") for c, h in hashes.items()], one.alias("row_sha256"))


def save_batch(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole, unless there is one already: of any number of writers one gets True. By a hard link on a mounted file
    system, by a rename that does not replace elsewhere (atomic on HDFS; object stores without such a rename are not served)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(conf)
    fs.mkdirs(there.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(staged.toUri().getPath(), there.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(there), none)
        return True
    except Exception:
        if fs.exists(there):
            return False
        raise
    finally:
        fs.delete(staged, False)


def save_cache(entries: DataFrame, path: str, key: str = "key", value: str = "value", attempts: int = 20) -> str:
    """The cache in a folder of generations with new entries, which win: a new generation is written whole beside the last and committed by an
    atomic create of `_commits/<number>`. A writer that finds its number taken reads what the other wrote, merges again and takes the next, so any number of
    writers may save at once and no key is lost; of two values for a key the later commit's stays. Readers take the newest committed
    generation and never see half a cache. Returns the new generation's path."""
    spark = entries.sparkSession
    mine = f"{path}/_writing/{uuid4().hex}"
    entries.select(key, value).write.parquet(f"{mine}-entries")
    entries = spark.read.parquet(f"{mine}-entries")
    for attempt in range(attempts):
        old, n = _last(spark, path)
        staged = f"{mine}-{attempt}"
        (merge_cache(spark.read.parquet(old), entries, key, value) if old else entries).write.parquet(staged)
        if create_once(spark, f"{path}/_commits/{n + 1:08d}", staged.rsplit("/", 1)[1]):
            _move(spark, staged, f"{path}/generation={n + 1:08d}")
            _delete(spark, f"{mine}-entries")
            return f"{path}/generation={n + 1:08d}"
        _delete(spark, staged)
    raise RuntimeError(f"{attempts} other writers were faster: {path}")


def _hadoop(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _hadoop(spark, source)
    fs.rename(a, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target))


def _delete(spark: SparkSession, path: str) -> None:
    fs, there = _hadoop(spark, path)
    fs.delete(there, True)


def _last(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """Path and number of the newest committed generation. One whose writer was lost between commit and move still lies where it was written."""
    fs, there = _hadoop(spark, f"{path}/_commits")
    if not fs.exists(there):
        return _completed(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(there) if "." not in f.getPath().getName())
    if not names:
        return _completed(spark, path)
    moved = f"{path}/generation={names[-1]}"
    if exists(spark, moved):
        return moved, int(names[-1])
    at = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{names[-1]}"))
    written = bytes(at.readAllBytes()).decode()
    at.close()
    kept = f"{path}/_writing/{written}"
    return (kept if exists(spark, kept) else moved), int(names[-1])


def newest(spark: SparkSession, path: str) -> str | None:
    """Path of the newest committed generation of a cache."""
    return _last(spark, path)[0]


def _completed(spark: SparkSession, path: str) -> tuple[str | None, int]:
    """The newest generation of a cache that was written without commits."""
    fs, there = _hadoop(spark, path)
    names = sorted(f.getPath().toString() for f in fs.listStatus(there)) if fs.exists(there) else []
    done = [n for n in names if "generation=" in n and exists(spark, f"{n}/_SUCCESS")]
    return (done[-1], int(done[-1].rsplit("=", 1)[1])) if done else (None, -1)


def warm_cache(entries: DataFrame, spark: SparkSession, path: str, key: str = "key", value: str = "value") -> str | None:
    """A cache filled beforehand: of the entries those that it lacks are saved; what it has stays. None if it lacks none."""
    old = newest(spark, path)
    missing = entries.select(key, value).dropDuplicates([key])
    if old:
        missing = missing.join(spark.read.parquet(old).select(key), key, "left_anti")
    return None if missing.isEmpty() else save_cache(missing, path, key, value)


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write where nothing is yet; Spark's commit makes it appear as a whole."""
    df.write.mode("errorifexists").format(form).save(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def dump_rollouts(selected: DataFrame, trees: DataFrame, path: str) -> None:
    """Selected trajectories and trees, one folder per step."""
    selected.write.mode("append").partitionBy("global_step").json(f"{path}/selected")
    trees.write.mode("append").partitionBy("global_step").json(f"{path}/trees")


def merge_cache(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Two key-value caches in one; the right one wins."""
    r = right.select(F.col(key), F.col(value).alias("__r"))
    return left.select(key, value).join(r, key, "full").select(key, F.coalesce("__r", value).alias(value))


def cache_misses(queries: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys asked for that the cache lacks."""
    return queries.select(key).distinct().join(cache.select(key), key, "left_anti")


def with_responses(rows: DataFrame, samples: DataFrame, key: str = "row_idx") -> DataFrame:
    """rows with `responses`, the samples (key, sample_index, response) of each in order."""
    nested = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_index", "response"))).alias("r"))
    return rows.join(nested.select(key, F.col("r.response").alias("responses")), key, "left")
