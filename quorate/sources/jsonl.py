"""JSON-lines sources and sinks of decision rows, predictions and cache records."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import arm_name, quoted
from ..plans.runtime import materialize

DECISION = (
    "row_id string, source string, split string, group_id string, state string, questions map<string,struct<kind:string,instructions:string,criteria:string>>, "
    "labels map<string,map<string,double>>, weight double, label_source string, meta string"
)
PREDICTION = "row_id string, question_id string, probs map<string,double>, confidence double, model string, latency_ms double, meta string"
SFT = (
    "row_id string, question_id string, split string, messages array<struct<role:string,content:string>>, label string, label_space array<string>, "
    "target_probs map<string,double>, schema_id string, source string, weight double, label_source string, group_id string, meta string"
)
CACHE = "key string, answer struct<distributions:map<string,map<string,double>>,confidence:double,usage:map<string,bigint>,latency_ms:double,model:string>"


def lines(spark: SparkSession, paths: list[str] | str, missing_ok: bool = False) -> DataFrame:
    """(file, ord, line, value) of the lines that aren't blank; ord counts along the files in the order of their paths, line from 1 in each.

    A missing path is an error, or skipped with missing_ok.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    if missing_ok:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        there = []
        for p in wanted:
            at = jvm.org.apache.hadoop.fs.Path(p)
            found = at.getFileSystem(conf).globStatus(at)
            if found is not None and len(found):
                there.append(p)
        wanted = there
    if not wanted:
        return spark.createDataFrame([], "file string, ord bigint, line bigint, value string")
    scan = spark.read.text(wanted).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    # Blocks in the order of paths and places give every line its number; there are as many as input splits.
    blocks = scan.groupBy("path", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("path", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("path", "at", "first", ahead().alias("before"), ahead("path").alias("above"))
    rows = scan.join(blocks, ["path", "at"])
    rows = rows.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("ord"), (F.col("above") + F.col("id") - F.col("first") + 1).alias("line"), "value")
    return rows.where(F.trim("value") != "")


def _strict(rows: DataFrame, schema: str, ok: Column) -> DataFrame:
    """Parsed rows, with an error that names file and line of the first bad one met."""
    parsed = rows.withColumn("r", F.from_json("value", schema))
    fine = F.coalesce(ok, F.lit(False))
    told = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat_ws(":", "file", F.col("line").cast("string"), F.substring("value", 1, 80))))
    return parsed.where(told).select("r.*", "ord")


def _object(value: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(F.try_parse_json(value)), "<", 1) == "OBJECT", F.lit(False))


def unique_keys(value: Column, path: str) -> Column:
    """Whether no key of the object at path comes twice; a map column would keep both."""
    keys = F.map_keys(F.from_json(F.get_json_object(value, path), "map<string,string>"))
    return F.coalesce(F.size(keys) == F.size(F.array_distinct(keys)), F.lit(True))


def read_rows(spark: SparkSession, paths: list[str] | str, missing_ok: bool = False) -> DataFrame:
    """Decision rows: strict, with the defaults weight 1 and meta {}; state and criteria stay JSON text, label order is kept."""
    ok = F.col("r.row_id").isNotNull() & F.col("r.labels").isNotNull() & F.col("r.questions").isNotNull() & F.lower(F.trim("r.split")).isin("train", "val", "test", "validation", "dev")
    rows = _strict(lines(spark, paths, missing_ok), DECISION, ok)
    return rows.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("meta", F.coalesce("meta", F.lit("{}")))


def read_predictions(spark: SparkSession, paths: list[str] | str, missing_ok: bool = False) -> DataFrame:
    """Predictions: strict; a probability key that comes twice in a line is an error."""
    ok = F.col("r.row_id").isNotNull() & F.col("r.question_id").isNotNull() & F.col("r.probs").isNotNull() & unique_keys(F.col("value"), "$.probs")
    return _strict(lines(spark, paths, missing_ok), PREDICTION, ok)


def read_sft(spark: SparkSession, paths: list[str] | str, missing_ok: bool = False) -> DataFrame:
    return _strict(lines(spark, paths, missing_ok), SFT, F.col("r.row_id").isNotNull() & F.col("r.messages").isNotNull())


def cache_view(cache_lines: DataFrame) -> DataFrame:
    """(key, answer) of raw lines (ord, line): the last good line of each key; blank, cut off and incomplete ones are skipped."""
    rows = cache_lines.where(F.trim("line") != "").select("ord", F.from_json("line", CACHE).alias("r"))
    good = rows.where(F.col("r.key").isNotNull() & F.col("r.answer.distributions").isNotNull())
    return good.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.answer", "ord").alias("answer"), F.max("ord").alias("ord"))


def decision_line(c: str = "") -> Column:
    """A decision row as one JSON object, keys in the contract's order, labels in theirs; state, criteria and meta unfold if they are JSON."""
    raw = lambda x: F.when(_object(x), x).otherwise(quoted(x))
    crit = lambda x: F.when(x.isNull(), "null").when(F.ltrim(x).startswith("{") | F.ltrim(x).startswith("["), x).otherwise(quoted(x))
    question = lambda e: F.concat(quoted(e["key"]), F.lit(':{"kind":'), quoted(e["value"]["kind"]), F.lit(',"instructions":'), quoted(e["value"]["instructions"]), F.lit(',"criteria":'), crit(e["value"]["criteria"]), F.lit("}"))
    parts = [(k, quoted(F.col(k))) for k in ("row_id", "source", "split", "group_id")]
    parts += [("state", raw(F.col("state"))), ("questions", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("questions"), question), ","), F.lit("}"))), ("labels", F.to_json("labels"))]
    parts += [("weight", F.coalesce(F.col("weight"), F.lit(1.0)).cast("string")), ("label_source", quoted(F.col("label_source"))), ("meta", F.coalesce(raw(F.col("meta")), F.lit("{}")))]
    pieces = [x for k, v in parts for x in (F.lit(f',"{k}":'), F.coalesce(v, F.lit("null")))]
    return F.concat(F.lit('{"row_id":'), *pieces[1:], F.lit("}"))


def write_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes decision rows as JSON lines (mode append adds to them) and returns how many."""
    seen = Observation("rows")
    rows.select(decision_line().alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).text(path)
    return seen.get["n"]


def write_predictions(rows: DataFrame, path: str, mode: str = "overwrite") -> int:
    names = [f.split(" ")[0] for f in PREDICTION.split(", ")]
    seen = Observation("predictions")
    rows.select(*names).observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path, ignoreNullFields=False)
    return seen.get["n"]


def append_rows(rows: DataFrame, path: str) -> int:
    """Adds decision rows to JSON lines that may be there already."""
    return write_rows(rows, path, "append")


def scored_resumable(rows: DataFrame, done_path: str, model: str, score, part: int = 100_000) -> int:
    """Scores what a model hasn't answered in done_path yet, and appends the answers part by part, so that a stopped run loses one part at most.

    score(rows) gives predictions of rows with row_id. Parts are hash ranges of the ids of about `part` rows.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(done_path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    left = unscored(rows, read_predictions(spark, done_path), model) if there else rows
    left = materialize(left, "unscored")
    parts = max(1, -(-left.count() // part))
    return sum(write_predictions(score(left.where(F.pmod(F.xxhash64("row_id"), F.lit(parts)) == k)), done_path, "append") for k in range(parts))


def file_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, arm, lines) of all files of a glob: a report over files by their names."""
    return lines(spark, pattern).groupBy("file").agg(F.count(F.lit(1)).alias("lines")).select("file", arm_name(F.col("file")).alias("arm"), "lines")


def unscored(rows: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Rows that a model hasn't answered yet, so that a stopped run goes on."""
    return rows.join(done.where(F.col("model") == model).select("row_id"), "row_id", "left_anti")


def checksums(spark: SparkSession, pattern: str, block: int = 1 << 20) -> DataFrame:
    """(file, sha256, bytes) of files of any size, each hashed block by block in its task; the folder must be readable by path from the executors."""
    import pyarrow as pa

    names = spark.read.format("binaryFile").load(pattern).select("path", "length")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                h = hashlib.sha256()
                with files.open_input_stream(at) as f:
                    while part := f.read(block):
                        h.update(part)
                found.append((at.rpartition("/")[2], h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), batch.column(1)], names=["file", "sha256", "bytes"])

    return names.mapInArrow(run, "file string, sha256 string, bytes bigint")


def checksum(path: str, block: int = 1 << 20) -> str:
    """sha256 of one local file of any size."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def write_report(path: str, payload: dict | str) -> None:
    """A small report (JSON with sorted keys, or text), all or nothing: a temporary file beside it, then a rename."""
    text = payload if isinstance(payload, str) else json.dumps(payload, sort_keys=True, indent=2) + "\n"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    handle, at = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w") as f:
            f.write(text)
        os.replace(at, path)
    except BaseException:
        os.unlink(at)
        raise
