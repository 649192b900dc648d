"""Ordered folds, rankings and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.plans.jumps import first_overfull
from kilnwork.plans.running import PART, carry_forward, ranges, row_before, running_totals


def ema(samples: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str], alpha: float = 0.3, part: Column | None = None) -> DataFrame:
    """``keys, ema_<col>..., sample_count``: exponential moving averages, the first sample as the start.

    With samples x1..xn in order the value is (1-a)^n x1 plus the sum of
    a (1-a)^(n-i) xi, so a ranked sum replaces the ordered fold. A null leaves
    a column's value as it was; a column of nulls gives null. A key may span
    many ranges of rows: each is summed by itself and then fades by the number
    of values in the key's ranges after it. ``part``, such as the month of the
    first column of ``order``, cuts the rows into ranges that rise with
    ``order``; without it they are found by a sample and stored.
    """
    places = [f"__o{i}" for i in range(len(order))]
    slim = [*keys, *cols, *[o.alias(p) for o, p in zip(order, places, strict=True)]]
    ranged = ranges(samples.select(*slim), [*keys, *places]) if part is None else samples.select(*slim, part.alias(PART))
    newest = Window.partitionBy(PART, *keys).orderBy(*[F.col(p).desc() for p in places]).rowsBetween(Window.unboundedPreceding, -1)
    fade = lambda n: F.pow(F.lit(1.0 - alpha), n)
    # ranks among the column's own values, so that nulls take no place
    weighed = ranged.withColumns({f"__w{i}": F.col(c) * alpha * fade(F.count(c).over(newest)) for i, c in enumerate(cols)})
    sums = []
    for i, c in enumerate(cols):
        known = F.col(c).isNotNull()
        first = F.min_by(F.when(known, F.col(c)), F.when(known, F.struct(*places)))
        sums += [F.sum(f"__w{i}").alias(f"__s{i}"), F.count(c).alias(f"__n{i}"), first.alias(f"__first{i}")]
    parts = weighed.groupBy(PART, *keys).agg(*sums, F.count("*").alias("__rows"))
    later = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({f"__after{i}": F.coalesce(F.sum(f"__n{i}").over(later), F.lit(0)) for i in range(len(cols))})
    value = lambda i: (
        F.sum(F.col(f"__s{i}") * fade(F.col(f"__after{i}")))
        + fade(F.sum(f"__n{i}")) * F.min_by(f"__first{i}", F.when(F.col(f"__first{i}").isNotNull(), F.col(PART)))
    )
    return placed.groupBy(*keys).agg(*[value(i).alias(f"ema_{c}") for i, c in enumerate(cols)], F.sum("__rows").alias("sample_count"))


def ema_with_reset(samples: DataFrame, keys: Sequence[str], order: Sequence[Column], col: str, is_reset: Column, alpha: float = 0.3, part: Column | None = None) -> DataFrame:
    """As ``ema`` of one column, but a reset row overwrites the average with its own value."""
    place = F.struct(*order)
    resets = samples.filter(is_reset).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(place).alias("__reset"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    since = samples.join(resets, on, "left").filter(F.col("__reset").isNull() | (place >= F.col("__reset")))
    return ema(since.select(*samples.columns), keys, order, [col], alpha, part)


def ratchet_peak(history: DataFrame, observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``history`` with its memory raised to the highest peak seen of a node that is not terminal."""
    from kilnwork.operators.filters import TERMINAL

    live = observations.join(nodes.filter(~F.col("status").isin(*TERMINAL)).select("node_id"), "node_id", "left_semi")
    peaks = live.groupBy("pname", "system").agg(F.max("peak_memory_bytes").alias("__peak"))
    joined = history.join(peaks, ["pname", "system"], "left")
    return joined.withColumn("ema_peak_memory_bytes", F.greatest("ema_peak_memory_bytes", "__peak")).drop("__peak")


def equal_load_cutoffs(samples: DataFrame, n: int, prev: Sequence[float] | None = None, min_samples: int = 500, alpha: float = 0.3) -> DataFrame:
    """``number, cutoff``: durations that cut the total duration into n equal loads.

    Cutoff i is the least duration up to which the durations sum to at least
    total * i / n. Fewer than ``min_samples`` samples or n below 2 give no
    rows. Cutoffs are smoothed with ``prev`` where their numbers match. Equal
    durations are summed first; sums are decimal, over ranges of durations.
    """
    spark = samples.sparkSession
    if n <= 1:
        return spark.createDataFrame([], "number int, cutoff double")
    load = F.col("duration_secs").cast("decimal(38,6)")
    grouped = samples.groupBy("duration_secs").agg(F.count("*").alias("rows"), F.sum(load).alias("load"))
    summed = running_totals(grouped, [F.col("duration_secs")], {"upto": F.col("load")})
    total = grouped.agg(F.sum("load").alias("total"), F.sum("rows").alias("all_rows"))
    targets = spark.range(1, n).select(F.col("id").cast("int").alias("number"))
    at = summed.crossJoin(F.broadcast(total)).filter(F.col("all_rows") >= min_samples).withColumn("reached", F.least(F.floor(F.col("upto") * n / F.col("total")), F.lit(n - 1)).cast("int"))
    least = at.groupBy("reached").agg(F.min("duration_secs").alias("least"))
    cut = targets.join(F.broadcast(least), F.col("reached") >= F.col("number")).groupBy("number").agg(F.min("least").alias("cutoff"))
    if prev is not None and len(prev) == n - 1:
        old = F.element_at(F.array(*[F.lit(float(p)) for p in prev]), F.col("number"))
        cut = cut.withColumn("cutoff", alpha * F.col("cutoff") + (1 - alpha) * old)
    return cut


def dispatch_rank(nodes: DataFrame, build_nodes: DataFrame, builds: DataFrame, boost: float = 1e9) -> DataFrame:
    """``node_id, score, place`` of ready nodes: priority, far up if an interactive build wants the node, then arrival."""
    urgent = build_nodes.join(builds.filter("priority_class = 'interactive'").select("build_id"), "build_id", "left_semi").select("node_id").distinct()
    ready = nodes.filter("status = 'ready'").join(urgent.withColumn("__urgent", F.lit(boost)), "node_id", "left")
    scored = ready.select("node_id", (F.col("priority") + F.coalesce("__urgent", F.lit(0.0))).alias("score"), "arrival")
    order = [F.col("score").desc(), F.col("arrival")]
    return running_totals(scored, order, {"place": F.lit(1)}).select("node_id", "score", "place")


def prefetch_paths(nodes: DataFrame, edges: DataFrame, build_nodes: DataFrame, outputs: DataFrame, ready_k: int = 32, path_k: int = 100) -> DataFrame:
    """``path_id, wanted``: the outputs that the children of the most wanted ready nodes have, the most frequent first."""
    interest = build_nodes.groupBy("node_id").agg(F.count("*").alias("interest"))
    top = nodes.filter("status = 'ready'").join(interest, "node_id").orderBy(F.col("interest").desc(), "node_id").limit(ready_k)
    children = edges.join(F.broadcast(top.select(F.col("node_id").alias("parent_id"))), "parent_id").select(F.col("child_id").alias("node_id"))
    return children.join(outputs, "node_id").groupBy("path_id").agg(F.count("*").alias("wanted")).orderBy(F.col("wanted").desc(), "path_id").limit(path_k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` of each key, by partial maxima."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def log_tail(lines: DataFrame, n: int = 100_000, since: int = 0, width: int = 65_536) -> DataFrame:
    """The last n lines of each log, from line ``since`` on.

    Lines are counted by stretches of ``width`` numbers first. Only stretches
    that fewer than n lines follow are ranked, so a task ranks about n + width
    lines of a log, however long the log is.
    """
    stretch = F.floor(F.col("line_no") / width)
    counts = lines.groupBy(F.col("log_id").alias("__log"), stretch.alias("__stretch")).agg(F.count("*").alias("__rows"))
    later = Window.partitionBy("__log").orderBy(F.col("__stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("__after", F.coalesce(F.sum("__rows").over(later), F.lit(0))).filter(F.col("__after") < n).select("__log", "__stretch")
    near = lines.join(last, F.col("log_id").eqNullSafe(F.col("__log")) & stretch.eqNullSafe(F.col("__stretch")), "left_semi")
    newest = Window.partitionBy("log_id").orderBy(F.col("line_no").desc())
    return near.withColumn("__back", F.row_number().over(newest)).filter(F.col("__back") <= n).drop("__back").filter(F.col("line_no") >= since)


def number_lines(batches: DataFrame) -> DataFrame:
    """``log_id, line_no, line``: lines of the batches of each log in order, numbered from 0."""
    lines = F.split("batch_text", "\n")
    upto = running_totals(batches.select("log_id", "batch_no", "batch_text"), [F.col("batch_no")], {"__upto": F.size(lines).cast("long")}, ["log_id"])
    based = upto.select("log_id", lines.alias("__lines"), (F.col("__upto") - F.size(lines)).alias("__base"))
    return based.select("log_id", "__base", F.posexplode("__lines").alias("__i", "line")).select("log_id", (F.col("__base") + F.col("__i")).alias("line_no"), "line")


def log_violations(lines: DataFrame, max_bytes: int, max_lines_per_sec: int) -> DataFrame:
    """``log_id, line_no, fault`` of the first line of each log beyond its limits, size before rate on one line.

    The size is a running sum. A rate window starts at its own first line; a
    log that spans many ranges is followed through all of them at once
    (``plans/jumps.py``).
    """
    ranged = ranges(lines.select("log_id", F.col("line_no").cast("long").alias("line_no"), F.octet_length("line").cast("long").alias("__bytes"), "at_secs"), ["log_id", "line_no"])
    size = running_totals(ranged.drop("at_secs"), [F.col("line_no")], {"__sum": F.col("__bytes")}, ["log_id"]).filter(F.col("__sum") > max_bytes)
    by_size = size.groupBy("log_id").agg(F.min("line_no").alias("line_no")).withColumn("fault", F.lit("size"))
    by_rate = first_overfull(ranged, "log_id", "line_no", "at_secs", max_lines_per_sec).withColumn("fault", F.lit("rate"))
    both = by_size.select("log_id", "line_no", "fault").unionByName(by_rate)
    first = both.groupBy("log_id").agg(F.min(F.struct("line_no", F.when(F.col("fault") == "size", 0).otherwise(1).alias("rank"), "fault")).alias("f"))
    return first.select("log_id", F.col("f.line_no").alias("line_no"), F.col("f.fault").alias("fault"))


def phantoms(heartbeats: DataFrame, part: Column | None = None) -> DataFrame:
    """Heartbeats whose suspect is that of the executor's heartbeat before; ``part`` as in ``carry_forward``."""
    before = row_before(heartbeats, ["executor_id"], ["ts", "beat_id"], F.col("suspect"), "__before", part)
    return before.filter(F.col("suspect") == F.col("__before.value")).drop("__before")


def missed_heartbeats(heartbeats: DataFrame, as_of: str, interval: int = 10, misses: int = 3, part: Column | None = None) -> DataFrame:
    """``executor_id, ts, gap_secs`` of silences of at least interval * misses, the last one up to ``as_of``.

    ``part`` as in ``carry_forward``. Beats without a time are none.
    """
    beats = heartbeats.filter("ts is not null").select("executor_id", "ts", "beat_id")
    between = carry_forward(beats, ["executor_id"], ["ts", "beat_id"], "ts", "__since", part, own=False).filter("__since is not null")
    silences = between.select("executor_id", F.col("__since").alias("ts"), F.col("ts").alias("__until"))
    ends = beats.groupBy("executor_id").agg(F.max("ts").alias("ts")).withColumn("__until", F.expr(f"timestamp_ntz'{as_of}'").cast(beats.schema["ts"].dataType))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gaps = silences.unionByName(ends).select("executor_id", "ts", ((micros("__until") - micros("ts")) / 1e6).alias("gap_secs"))
    return gaps.filter(F.col("gap_secs") >= interval * misses)


def backoff_schedule(attempts: DataFrame, base: float = 5, mult: float = 2, cap: float = 300) -> DataFrame:
    """Add ``wait_secs`` before attempt number ``attempt`` (from 0), without jitter."""
    return attempts.withColumn("wait_secs", F.least(base * F.pow(F.lit(float(mult)), F.col("attempt")), F.lit(float(cap))))


def overdue_nodes(running: DataFrame, as_of: str, factor: float = 3.0, least: float = 7200.0, grace: float = 600.0) -> DataFrame:
    """Nodes that run longer than the larger of factor * estimate and least + grace; an estimate that is null, not finite or not above 0 is none."""
    age = (F.unix_micros(F.expr(f"timestamp_ntz'{as_of}'").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    estimate = F.col("estimate").cast("double")
    known = ~F.isnan(estimate) & (estimate > 0) & (estimate < float("inf"))
    limit = F.greatest(F.when(known, estimate * factor).otherwise(0.0), F.lit(least + grace))
    return running.withColumns({"age_secs": age, "limit_secs": limit}).filter("age_secs > limit_secs")


def dispatch_wait(changes: DataFrame, entered: str = "started", left: str = "completed", part: Column | None = None) -> DataFrame:
    """``build_id, sequence, wait_secs`` at each change to ``left`` since the last change to ``entered`` in its visit; ``part`` as in ``carry_forward``."""
    kinds = changes.filter(F.col("kind").isin(entered, left))
    marked = kinds.select("build_id", "sequence", "kind", "ts", F.when(F.col("kind") == entered, F.col("ts")).alias("__in"), F.when(F.col("kind") == left, F.col("ts")).alias("__out"))
    begun = carry_forward(marked, ["build_id"], ["sequence"], "__in", "__begun", part, own=False)
    rows = carry_forward(begun, ["build_id"], ["sequence"], "__out", "__done", part, own=False).filter(F.col("kind") == left)
    fresh = rows.filter(F.col("__begun").isNotNull() & (F.col("__done").isNull() | (F.col("__begun") > F.col("__done"))))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return fresh.select("build_id", "sequence", ((micros("ts") - micros("__begun")) / 1e6).alias("wait_secs"))


def sequence_gaps(event_log: DataFrame, width: int = 65_536) -> DataFrame:
    """``build_id, sequence, fault``: rows that repeat a number or come after a missing one.

    A build's rows are cut into stretches of ``width`` numbers.
    """
    found = row_before(event_log.select("build_id", "sequence"), ["build_id"], ["sequence"], F.col("sequence"), "__before", F.floor(F.col("sequence") / width))
    before = F.when(F.col("__before").isNull(), F.lit(0)).otherwise(F.col("__before.value"))
    fault = F.when(F.col("sequence") == before, "repeated").when(F.col("sequence") > before + 1, "gap")
    return found.select("build_id", "sequence", fault.alias("fault")).filter("fault is not null")


def surplus_oldest(jobs: DataFrame, queued: DataFrame, min_age_secs: float) -> DataFrame:
    """Pending jobs beyond what their pool has queued, the oldest first, of a minimal age; a pool may span many ranges."""
    placed = running_totals(jobs, [F.col("age_secs").desc(), F.col("job_id")], {"__place": F.lit(1)}, ["pool"])
    totals = jobs.groupBy("pool").agg(F.count("*").alias("__n")).join(queued, "pool", "left")
    surplus = totals.select(F.col("pool").alias("__pool"), (F.col("__n") - F.coalesce("queued", F.lit(0))).alias("__surplus"))
    joined = placed.join(surplus, F.col("pool").eqNullSafe(F.col("__pool")))
    return joined.filter((F.col("__place") <= F.col("__surplus")) & (F.col("age_secs") >= min_age_secs)).select(*jobs.columns)


def trailing_rate(samples: DataFrame, seconds: int, by: Sequence[str], ts: str = "ts", span: int = 86_400) -> DataFrame:
    """Add ``rate``: events a second over the ``seconds`` before and at each row.

    Rows are counted by second first. A key's seconds are cut into spans, and
    the last ``seconds`` of a span are counted in the next one too, so a key
    with a long history is spread over many tasks.
    """
    span = max(span, seconds + 1)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(by)]
    keys = [f"__key{i}" for i in range(len(by))]
    counts = samples.groupBy(*named, second.alias("__second")).agg(F.count("*").alias("__n"))
    at = lambda c: F.floor(c / span)
    spans = F.array_distinct(F.array(at(F.col("__second")), at(F.col("__second") + seconds)))
    dealt = counts.select(*keys, "__second", "__n", F.explode(spans).alias("__span"))
    trailing = Window.partitionBy(*keys, "__span").orderBy("__second").rangeBetween(-seconds, 0)
    rates = dealt.withColumn("rate", F.sum("__n").over(trailing) / float(seconds)).filter(F.col("__span").eqNullSafe(at(F.col("__second")))).select(*keys, "__second", "rate")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(by)], second.eqNullSafe(F.col("__second")))
    return samples.join(rates, on).select(*samples.columns, "rate")
