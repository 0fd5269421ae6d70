"""The mailbox of native hooks: eight dialects to one record, ingested as a stream (SF27 to SF30, SC20, SM1 to SM8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions.patterns import INNERMOST_FIRST
from codefacts.functions.scalars import library_frame, stable_id, thread_of, to_int
from codefacts.sources import jsonl
from codefacts.session import ship

ORIGINS = ("main", "thread-main", "exception", "process", "signal", "worker", "promise", "goroutine", "task")
FRAME = "file string, short_src string, source string, line string, function string, method string, what string, class string, native boolean, locals map<string,string>"
LINK = "type string, message string"
ERROR = f"struct<type:string, module:string, message:string, origin:string, chain:array<struct<{LINK}>>>"
#: All that any dialect writes, as one type, so that a line is parsed once.
RECORD = (
    "language string, lang string, ts string, capture_method string, hook string, traceback string, backtrace string, trace_id string, span_id string, parent_span string, session_id string, "
    f"origin string, cwd string, project string, project_root string, pid string, ppid string, frames array<struct<{FRAME}>>, stack array<struct<{FRAME}>>, location struct<{FRAME}>, "
    f"exception {ERROR}, error {ERROR}, process struct<cwd:string, project:string, project_root:string, pid:string, ppid:string, runtime:string, command:string>"
)


def _text(*paths: str) -> Column:
    return F.coalesce(*[F.col(f"r.{p}") for p in paths])


def many_type() -> str:
    return f"array<struct<{FRAME}>>"


def _frame(f: Column, lang: Column) -> Column:
    """SF27: a hook's frame: class and method together, a source text only beside a file."""
    file = F.coalesce(f["file"], f["short_src"], f["source"])
    name = F.coalesce(f["function"], f["method"], f["what"], F.lit("?"))
    whole = F.when(f["class"].isNotNull() & f["function"].isNull(), F.concat_ws(".", f["class"], name)).otherwise(name)
    line = to_int(f["line"])
    source = F.when(f["source"].isNotNull() & f["file"].isNotNull(), F.array(F.struct(line.alias("n"), f["source"].alias("text"), F.lit(True).alias("is_fail")))).otherwise(F.array().cast("array<struct<n:int,text:string,is_fail:boolean>>"))
    return F.struct(file.alias("file"), line.alias("line"), whole.alias("function"), (F.coalesce(f["native"], F.lit(False)) | library_frame(file, lang)).alias("is_library"), source.alias("source"), f["locals"].alias("locals"))


def normalised(raw: DataFrame) -> DataFrame:
    """SF28, SF29: records of mailbox lines (value); lines that are no JSON object are left out."""
    rows = raw.where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    # a generator of one row keeps the optimiser from parsing the line anew for every field
    rows = rows.select(F.explode(F.array(F.from_json("value", RECORD))).alias("r")).where("r is not null")
    rows = rows.withColumn("lang", F.coalesce(_text("language", "lang"), F.lit("unknown")))
    many = F.coalesce(F.when(F.size("r.frames") > 0, F.col("r.frames")), F.col("r.stack"))
    rows = rows.withColumn("_f", F.coalesce(many, F.when(F.col("r.location").isNotNull(), F.array("r.location")), F.array().cast(many_type())))
    frames = F.transform(F.filter("_f", lambda f: f.isNotNull()), lambda f: _frame(f, F.col("lang")))
    rows = rows.withColumn("frames", F.when(F.col("lang").isin(*INNERMOST_FIRST), F.reverse(frames)).otherwise(frames))
    origin = _text("exception.origin", "error.origin", "origin")
    chain = F.transform(F.coalesce(_text("exception.chain", "error.chain"), F.array().cast("array<struct<type:string,message:string>>")), lambda c: F.struct(F.lit("cause").alias("kind"), F.coalesce(c["type"], F.lit("?")).alias("type"), F.coalesce(c["message"], F.lit("")).alias("message")))
    exception = F.struct(F.coalesce(_text("exception.type", "error.type"), F.lit("?")).alias("type"), _text("exception.module", "error.module").alias("module"), F.coalesce(_text("exception.message", "error.message"), F.lit("")).alias("message"), chain.alias("chain"), F.lit(None).cast("string").alias("origen"))
    process = F.struct(_text("process.cwd", "cwd").alias("cwd"), _text("process.project", "project", "project_root", "process.project_root").alias("project"), to_int(_text("process.pid", "pid")).alias("pid"), to_int(_text("process.ppid", "ppid")).alias("ppid"), _text("process.runtime").alias("runtime"), _text("process.command").alias("program"))
    out = rows.select(
        F.lit(1).alias("schema"),
        _text("ts").alias("ts"),
        F.coalesce(_text("capture_method", "hook"), F.lit("hook-nativo")).alias("source"),
        thread_of(origin, ORIGINS).alias("thread"),
        F.col("lang").alias("language"),
        exception.alias("exception"),
        "frames",
        F.lit(0).alias("frames_trimmed"),
        _text("traceback", "backtrace").alias("traceback"),
        process.alias("process"),
        *[_text(k).alias(k) for k in ("trace_id", "span_id", "parent_span", "session_id")],
        F.when(origin.isNotNull() & ~origin.isin(*ORIGINS), origin).alias("odd_origin"),
    )
    first = F.get("frames", F.lit(0))
    return out.withColumn("id", stable_id("ts", "language", F.col("exception.type"), F.col("exception.message"), first["file"], first["line"], F.col("process.pid")))


def ingest(spark: SparkSession, folder: str, root: str, most_files: int = 100):
    """SC20, SM1 to SM3: drain rotated mailbox files once each into the archive; reruns and repeated lines add nothing.

    Every batch is normalised, freed of what it or the archive holds already, and appended.
    """
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", most_files).text(folder)

    def store(batch: DataFrame, _: int) -> None:
        jsonl.archive(normalised(batch), root)

    query = raw.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """SM7: records per type and window of event time, with a bound on lateness."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def lifecycle(stream: DataFrame) -> DataFrame:
    """Each signature's transitions as its events come in (CH6 as a stateful stream).

    ``stream``: type, where, what (``capture``, ``read`` or ``commit``), ts.
    State a signature: first capture, read, last commit, captures after it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        first, read, commit, after = state.get if state.exists else (None, False, None, 0)
        was = _state(first, read, commit, after)
        rows = pd.concat(list(batches)).sort_values("ts")
        for what, ts in zip(rows["what"], rows["ts"]):
            at = int(pd.Timestamp(ts).value // 1000)
            if what == "capture":
                first = at if first is None else min(first, at)
                after += commit is not None and at > commit
            elif what == "read":
                read = True
            elif commit is None or at > commit:
                commit, after = at, 0
        state.update((first, read, commit, after))
        now = _state(first, read, commit, after)
        if now != was:
            yield pd.DataFrame({"type": [key[0]], "where": [key[1]], "was": [was], "state": [now]})

    return stream.groupBy("type", "where").applyInPandasWithState(step, "type string, where string, was string, state string", "first long, read boolean, commit long, after long", "append", GroupStateTimeout.NoTimeout)


def _state(first, read, commit, after) -> str:
    if first is None:
        return "nada"
    if commit is not None and commit > first:
        return "intervenida" if after else "en-silencio"
    return "leida" if read else "capturada"


ship(__name__)
