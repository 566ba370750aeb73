"""Jobs and accelerator samples: summaries, sampling, ticks, windows, states, runs of states, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalars import gib, offset, same_model

TICK = ("idx", "sm", "membw", "total", "used", "free")


# fixed values: statuses of jobs that didn't succeed
UNSUCCESSFUL = ("failed", "cancelled", "closed")


def job_summary(jobs: DataFrame, key: str = "task_id", top: int = 10, ids: int = 20) -> tuple[DataFrame, DataFrame]:
    """jobs (task, job_id, status, three diagnoses) -> (counts by status and the first unsuccessful ids, top errors).

    An unsuccessful job's error is its first non-empty diagnosis; empty errors take their place in the top list before
    they are dropped from it. Ids are ranked before they are listed, so that no task's jobs are gathered.
    """
    counts = jobs.groupBy(key, F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    failed = jobs.filter(F.col("status").isin(*UNSUCCESSFUL))
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    error = F.coalesce(*(empty(c) for c in ("pilot_error", "ddm_error", "exe_error")), F.lit(""))
    by_error = failed.groupBy(key, error.alias("error")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "error"))
    errors = by_error.withColumn("rank", rank).filter((F.col("rank") <= top) & (F.col("error") != ""))
    place = F.row_number().over(Window.partitionBy(key).orderBy("job_id"))
    firsts = failed.select(key, "job_id").withColumn("r", place).filter(F.col("r") <= ids).groupBy(key).agg(F.array_sort(F.collect_list("job_id")).alias("failed_ids"))
    return counts.join(firsts, key, "left"), errors


def sample_jobs(jobs: DataFrame, key: str = "task_id", most: int = 5) -> DataFrame:
    """`most` jobs of each task: scouts first, then unsuccessful ones of an error code that none before has, then other unsuccessful ones."""
    code = F.coalesce(F.nullif(F.col("error_code").cast("string"), F.lit("")), F.lit(""))
    rows = jobs.withColumn("__code", code).withColumn("__failed", F.col("status").isin(*UNSUCCESSFUL)).filter(F.col("is_scout") | F.col("__failed"))
    nth = F.row_number().over(Window.partitionBy(key, "is_scout").orderBy("job_id"))
    scout = rows.withColumn("__nth", nth)
    shown = F.max((F.col("is_scout") & (F.col("__nth") <= most)).cast("int")).over(Window.partitionBy(key, "__code"))
    first = F.row_number().over(Window.partitionBy(key, "is_scout", "__code").orderBy("job_id"))
    tier = F.when(F.col("is_scout"), 0).when((F.col("__code") != "") & (F.col("__shown") == 0) & (F.col("__first") == 1), 1).otherwise(2)
    staged = scout.withColumn("__shown", shown).withColumn("__first", first).withColumn("tier", tier)
    place = F.row_number().over(Window.partitionBy(key).orderBy("tier", "job_id"))
    return staged.withColumn("place", place).filter(F.col("place") <= most).drop("__code", "__failed", "__nth", "__shown", "__first")


def ticks(samples: DataFrame, host: str = "host") -> DataFrame:
    """samples (host, seq, idx, sm, membw, total, used, free) -> sums per tick; a tick ends where the index stops rising."""
    order = Window.partitionBy(host).orderBy("seq")
    started = (F.coalesce(F.lag("idx").over(order), F.lit(1 << 30)) >= F.col("idx")).cast("int")
    numbered = samples.withColumn("tick", F.sum(started).over(order))
    return numbered.groupBy(host, "tick").agg(F.min("seq").alias("seq"), *(F.sum(c).alias(c) for c in TICK[1:]))


def windows(samples: DataFrame, every: int = 15, at: str = "offset_s", host: str = "host") -> DataFrame:
    """Tumbling windows: min, mean (half to even), max of load, largest bandwidth, last total, most used, least free, samples."""
    slot = (F.floor(F.col(at) / every) * every).cast("long")
    return samples.groupBy(host, slot.alias("window_s")).agg(
        F.min("sm").alias("sm_min"), F.bround(F.avg("sm")).cast("int").alias("sm_mean"), F.max("sm").alias("sm_max"), F.max("membw").alias("membw_max"),
        F.max_by("total", at).alias("total"), F.max("used").alias("used"), F.min("free").alias("free"), F.count("sm").alias("n"),
    )


def state(size: Column, vram: Column) -> Column:
    """unloaded, cpu, gpu-full or gpu-partial by a model's size and its part in video memory."""
    return F.when(size <= 0, "unloaded").when(vram <= 0, "cpu").when(vram >= size, "gpu-full").otherwise("gpu-partial")


def runs(rows: DataFrame, key: str, order: str, value: str, **extra: Column) -> DataFrame:
    """Runs of an unchanged value: key, run, value, first, last, n and extra aggregates."""
    by = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)).cast("int")
    numbered = rows.withColumn("run", F.sum(changed).over(by))
    return numbered.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *(c.alias(k) for k, c in extra.items()))


# fixed values: states in the order of reports, and the load up to which a resident model does nothing
STATES = ("gpu-full", "gpu-partial", "cpu", "unloaded", "unreachable")
IDLE = 2


def state_report(samples: DataFrame, key: str = "host", at: str = "offset_s") -> DataFrame:
    """Per host: samples, their share of each state in whole percent, the transitions and the first time off the accelerator."""
    counts = samples.groupBy(key).agg(
        F.count("*").alias("n"), *(F.count_if(F.col("state") == s).alias(f"n_{s.replace('-', '_')}") for s in STATES[:4]), F.min(F.when(~F.col("state").startswith("gpu"), F.col(at))).alias("first_off")
    )
    path = runs(samples, key, at, "state").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "state"))), lambda x: x["state"]), " -> ").alias("transitions"))
    percent = F.floor((F.col("n_gpu_full") + F.col("n_gpu_partial")) * 100 / F.col("n")).cast("int")
    return counts.withColumn("gpu_percent", percent).join(path, key)


def sm_range(low: Column, high: Column, mean: Column) -> Column:
    """sm 0-88% (mean 41%), or that it wasn't measured."""
    text = F.concat(F.lit("sm "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit("% (mean "), F.coalesce(F.bround(mean).cast("int"), F.lit(0)).cast("string"), F.lit("%)"))
    return F.when(high.isNull(), "sm not measured").otherwise(text)


def verdict(on_gpu: Column, n: Column, sm_max: Column) -> Column:
    """What the samples say: never on the accelerator, resident without any load, always on it, or for a part of the time."""
    return (
        F.when(on_gpu == 0, "the GPU was NEVER used by ollama during this job")
        .when(sm_max <= IDLE, F.concat(F.lit("resident on the GPU but NO COMPUTE observed (sm never exceeded "), sm_max.cast("string"), F.lit("%)")))
        .when(on_gpu == n, "ollama was on the GPU for every sample")
        .otherwise(F.concat(F.lit("ollama was on the GPU for "), F.floor(on_gpu * 100 / n).cast("string"), F.lit("% of samples")))
    )


def report(samples: DataFrame, key: str = "host") -> DataFrame:
    """samples (key, and the fields of parse_samples) -> key, text: the summary that ends a job's log, with a line per run of a state."""
    at, size = F.col("offset_s"), F.col("size")
    on_gpu = F.count_if(F.col("state").startswith("gpu-"))
    measured = F.col("free").isNotNull() & F.col("total").isNotNull()
    about = samples.select(key, "offset_s", "state", "size", "size_vram", F.col("gpu_total_mib").alias("total"), F.col("gpu_used_mib").alias("used"), F.col("gpu_free_mib").alias("free"), "sm_min", "sm_mean", "sm_max")
    facts = about.groupBy(key).agg(
        F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("span"), on_gpu.alias("on_gpu"), *(F.count_if(F.col("state") == s).alias(f"c{i}") for i, s in enumerate(STATES)),
        F.min_by(F.col("state"), F.when(~F.col("state").startswith("gpu-"), at)).alias("off_state"), F.min(F.when(~F.col("state").startswith("gpu-"), at)).alias("off_at"),
        F.min("sm_min").alias("low"), F.max("sm_max").alias("high"), F.avg("sm_mean").alias("mean"), F.min("free").alias("free"), F.max("total").alias("total"), F.max(F.coalesce("used", F.lit(0))).alias("used"), F.max(size).alias("size"), F.max("size_vram").alias("vram"),
    )
    spans = runs(about, key, "offset_s", "state", vram=F.max("size_vram"), low=F.min("sm_min"), high=F.max("sm_max"), mean=F.avg("sm_mean"))
    shown = F.when(F.col("vram") > 0, gib(F.col("vram"))).otherwise("—")
    line = F.concat(F.format_string("  %-15s %-12s %4d smp  vram %-10s ", F.concat(offset(F.col("first")), F.lit("-"), offset(F.col("last"))), F.col("state"), F.col("n"), shown), sm_range(F.col("low"), F.col("high"), F.col("mean")))
    timeline = spans.withColumn("line", line).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "line"))), lambda x: x["line"]), "\n").alias("timeline"), F.transform(F.array_sort(F.collect_list(F.struct("run", "state"))), lambda x: x["state"]).alias("path"))
    share = lambda i, s: F.when(F.col(f"c{i}") > 0, F.format_string(f"  {s:<12} %5d  %3d%%", F.col(f"c{i}"), F.floor(F.col(f"c{i}") * 100 / F.col("n"))))
    whole = F.concat_ws(
        "\n",
        F.concat(F.lit("accelerator over the job: "), F.col("n").cast("string"), F.lit(" samples spanning "), offset(F.col("span"))),
        *(share(i, s) for i, s in enumerate(STATES)),
        F.when(F.size("path") > 1, F.concat(F.lit("  transitions: "), F.array_join("path", " -> "))),
        F.when(F.col("off_at").isNotNull(), F.concat(F.lit("  first non-GPU sample: "), F.col("off_state"), F.lit(" at +"), offset(F.col("off_at")))),
        F.concat(F.lit("  verdict: "), verdict(F.col("on_gpu"), F.col("n"), F.col("high"))),
        F.concat(F.lit("  compute: "), sm_range(F.col("low"), F.col("high"), F.col("mean")), F.lit(" — device-wide, all processes")),
        F.when(measured, F.format_string("  device VRAM: min free %d MiB of %d MiB total (max used %d MiB, all processes)", "free", "total", "used")).otherwise("  device VRAM: not recorded — no nvidia-smi samples (see the accel-sampler lines in this log)"),
        F.when(F.col("size") > 0, F.concat(F.lit("  model footprint: "), gib(F.col("size")), F.lit(" total, peak "), gib(F.col("vram")), F.lit(" in VRAM"))),
        F.lit("timeline:"),
        F.col("timeline"),
    )
    return facts.join(timeline, key).select(key, whole.alias("text"))


def residency(payload: Column, model: str) -> Column:
    """struct(state, size, size_vram) of a model in a server's list of loaded ones (JSON); unreachable where there is no list."""
    parsed = F.from_json(payload, "models array<struct<model:string,name:string,size:bigint,size_vram:bigint>>")
    mine = F.filter(F.coalesce(parsed["models"], F.array().cast("array<struct<model:string,name:string,size:bigint,size_vram:bigint>>")), lambda e: same_model(F.coalesce(F.nullif(e["model"], F.lit("")), e["name"], F.lit("")), F.lit(model)))
    first = F.when(F.size(mine) > 0, mine[0])
    size, vram = (F.coalesce(first[k], F.lit(0)).cast("long") for k in ("size", "size_vram"))
    readable = F.try_parse_json(payload).isNotNull()
    told = F.when(~F.coalesce(readable, F.lit(False)), "unreachable").when(first.isNull(), "unloaded").otherwise(state(size, vram))
    return F.struct(told.alias("state"), size.alias("size"), vram.alias("size_vram"))


def downsample(rows: DataFrame, key: str, order: str, most: int = 100) -> DataFrame:
    """Every ceil(n / most)-th row of each key, and its last."""
    by = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    stride = F.ceil(n / most)
    return rows.withColumn("place", F.row_number().over(by)).withColumn("n", n).withColumn("stride", stride).filter(((F.col("place") - 1) % F.col("stride") == 0) | (F.col("place") == F.col("n"))).drop("n", "stride")


def parse_samples(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines of twelve tab-separated fields -> samples; wrong counts, required fields that aren't numbers and unknown states are dropped, optional ones null."""
    f = F.split(column, "\t")
    whole = lambda i: F.element_at(F.col("f"), i).try_cast("long")
    names = ["size", "size_vram", "gpu_total_mib", "gpu_used_mib", "gpu_free_mib", "sm_min", "sm_mean", "sm_max", "membw_max", "util_ticks"]
    out = lines.withColumn("f", f).filter(F.size("f") == 12).select(whole(1).alias("offset_s"), F.element_at("f", 2).alias("state"), *(whole(i + 3).alias(n) for i, n in enumerate(names)))
    return out.filter(F.col("offset_s").isNotNull() & F.col("size").isNotNull() & F.col("size_vram").isNotNull() & F.col("state").isin("gpu-full", "gpu-partial", "cpu", "unloaded"))


def line_lengths(lines: DataFrame, key: str) -> DataFrame:
    """Per key: characters, lines, longest, the lengths at places max(0, int(0.99 n) - 1) and n // 2 of the sorted ones, and the whole mean."""
    by = Window.partitionBy(key).orderBy("length", "line_no")
    sized = lines.withColumn("length", F.length("line")).withColumn("at", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    pick = lambda place: F.max(F.when(F.col("at") == place, F.col("length")))
    return sized.groupBy(key).agg(
        F.sum("length").alias("chars"), F.count("*").alias("lines"), F.max("length").alias("longest"),
        pick(F.greatest(F.lit(0), F.floor(F.col("n") * 99 / 100).cast("int") - 1)).alias("p99"), pick(F.floor(F.col("n") / 2)).alias("p50"), F.floor(F.sum("length") / F.count("*")).cast("long").alias("mean"),
    )
