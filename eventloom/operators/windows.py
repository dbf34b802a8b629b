"""Rows generated from intervals: windows and sample times, as native arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.intervals import REACH, frames_in_ranges, overlap_join
from eventloom.operators.lookups import key_ranges
from eventloom.sources.shared import stored


def sliding_windows(start: Column, end: Column, duration: float = 2.5, stride: float = 0.5) -> Column:
    """Array of (s, e): fixed stride, one centred window for a short interval, an end-aligned last one when 0.1 s is left over."""
    n = F.floor((end - start - duration) / stride + 1e-9).cast("int")
    regular = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct((start + i * stride).alias("s"), (start + i * stride + duration).alias("e")))
    last = start + n * stride
    tail = F.when(last + duration < end - 0.1, F.array(F.struct((end - duration).alias("s"), end.alias("e")))).otherwise(F.array().cast("array<struct<s:double,e:double>>"))
    middle = (start + end) / 2
    short = F.array(F.struct(F.greatest(start, middle - duration / 2).alias("s"), F.least(end, middle + duration / 2).alias("e")))
    return F.when(end - start <= duration, short).otherwise(F.concat(regular, tail))


def sample_times(start: Column, end: Column, fps: float) -> Column:
    """Times from start to end at fps, both ends included once."""
    n = F.floor((end - start) * fps + 1e-9).cast("int")
    times = F.transform(F.sequence(F.lit(0), n), lambda i: start + i / F.lit(fps))
    return F.when(end - (start + n / F.lit(fps)) > 1e-6, F.concat(times, F.array(end))).otherwise(times)


#: Windows that meet the events together: a minute of them at the usual stride.
RUN = 120


def window_manifest(candidates: DataFrame, events: DataFrame, duration: float = 2.5, stride: float = 0.5) -> DataFrame:
    """Sliding windows of each candidate, labelled by the first event (t_start, event_id) whose closed interval holds the centre.

    Runs of RUN windows, not single ones, meet the events and are joined to what they met; windows are taken out of them last, and are never shuffled.
    """
    w = candidates.select("candidate_id", "clip_id", sliding_windows(F.col("window_start_s"), F.col("window_end_s"), duration, stride).alias("__w"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / RUN).cast("int")), lambda i: F.slice("__w", i * RUN + 1, F.lit(RUN)))
    runs = w.filter("__w is not null").select("candidate_id", "clip_id", F.posexplode(cuts).alias("__run", "__w"))
    middle = lambda x: (x["s"] + x["e"]) / 2
    centers = F.transform("__w", middle)
    ends = runs.select("candidate_id", "clip_id", "__run", F.array_min(centers).alias("__lo"), F.array_max(centers).alias("__hi"))
    ev = events.select("clip_id", "event_id", "type", "t_start", "t_end")
    met = overlap_join(ends, ev, ["clip_id"], "__lo", "__hi", "t_start", "t_end", closed=True)
    met = met.groupBy("candidate_id", "__run").agg(F.array_sort(F.collect_list(F.struct("t_start", "event_id", "type", "t_end"))).alias("__met"))
    rows = runs.hint("merge").join(met.hint("merge"), ["candidate_id", "__run"], "left")

    def labelled(x: Column) -> Column:
        held = F.filter("__met", lambda v: middle(x).between(v["t_start"], v["t_end"]))
        return F.struct(x["s"].alias("window_start_s"), x["e"].alias("window_end_s"), middle(x).alias("center"), F.coalesce(F.get(held, F.lit(0))["type"], F.lit("background")).alias("label"))

    rows = rows.select("candidate_id", "clip_id", "__run", F.posexplode(F.transform("__w", labelled)).alias("__k", "__x"))
    return rows.select("candidate_id", (F.col("__run") * RUN + F.col("__k")).alias("k"), "clip_id", "__x.*")


def inference_windows(candidates: DataFrame, least: float = 0.5, duration: float = 2.5, stride: float = 0.5) -> DataFrame:
    """(candidate_id, clip_id, k, window_start_s, window_end_s, center) of sliding windows; candidates whose window is shorter than `least` have none."""
    s, e = F.col("window_start_s"), F.col("window_end_s")
    w = candidates.filter(e - s >= least).select("candidate_id", "clip_id", F.posexplode(sliding_windows(s, e, duration, stride)).alias("k", "w"))
    return w.select("candidate_id", "clip_id", "k", F.col("w.s").alias("window_start_s"), F.col("w.e").alias("window_end_s"), ((F.col("w.s") + F.col("w.e")) / 2).alias("center"))


def cell_runs(candidates: DataFrame, duration: float, stride: float, cell: float) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The sliding_windows() of candidates as one row a cell of their centres, with __lo and __hi, the first and last k there; and the window (s, e) of a k, from such a row's columns.

    Windows are never put into an array of a whole candidate; k grows with the centre, so that those of a cell are neighbours.
    """
    s, e = F.col("window_start_s"), F.col("window_end_s")
    short, n = e - s <= duration, F.floor((e - s - duration) / stride + 1e-9).cast("int")
    middle = (s + e) / 2

    def window(k: Column) -> Column:
        regular = F.struct((s + k * stride).alias("s"), (s + k * stride + duration).alias("e"))
        one = F.struct(F.greatest(s, middle - duration / 2).alias("s"), F.least(e, middle + duration / 2).alias("e"))
        return F.when(short, one).when(k > n, F.struct((e - duration).alias("s"), e.alias("e"))).otherwise(regular)

    at = lambda k: (window(k)["s"] + window(k)["e"]) / 2
    top = F.when(short, 0).otherwise(n + (s + n * stride + duration < e - 0.1).cast("int"))
    rows = candidates.withColumn("__top", top).withColumns({"__from": at(F.lit(0)), "__to": at(F.col("__top"))})
    rows = rows.withColumns({"__a": F.floor(F.col("__from") / cell), "__z": F.floor(F.col("__to") / cell)})
    rows = rows.withColumn("__cell", F.explode(F.sequence("__a", "__z")))
    near = lambda c: ((c * cell - F.col("__from")) / stride).cast("int")
    some = F.sequence(F.greatest(F.lit(0), near(F.col("__cell")) - 2), F.least(F.col("__top"), near(F.col("__cell") + 1) + 2))
    inside = F.filter(some, lambda k: F.floor(at(k) / cell) == F.col("__cell"))
    # most candidates lie in one cell; what must be searched is an array of one element, so that a search is made once
    rows = rows.withColumn("__in", F.explode(F.array(F.when(F.col("__a") != F.col("__z"), inside)))).filter("__in is null or size(__in) > 0")
    rows = rows.withColumns({"__lo": F.coalesce(F.array_min("__in"), F.lit(0)), "__hi": F.coalesce(F.array_max("__in"), F.col("__top"))})
    return rows.drop("__top", "__from", "__to", "__a", "__z", "__in"), window


def with_met(runs: DataFrame, spans: DataFrame, start: str, end: str, values: list[str], name: str, cell: float) -> DataFrame:
    """runs (clip_id, __cell) with `name`, the array of `values` of spans of their clip that touch their cell, in order.

    Spans meet runs as one row a cell. Spans over REACH cells, if there are any, are asked in cells REACH x REACH times as wide, so that none is repeated without bound.
    """
    far = F.coalesce(F.col(end) - F.col(start) > REACH * cell, F.lit(False))
    parts = [(spans.filter(~far), 1)] + ([] if spans.filter(far).isEmpty() else [(spans.filter(far), REACH * REACH)])
    for i, (some, times) in enumerate(parts):
        at = some.filter(F.col(start) <= F.col(end)).select("clip_id", *values, F.explode(F.sequence(F.floor(F.col(start) / (cell * times)), F.floor(F.col(end) / (cell * times)))).alias("__c"))
        # dealt as plain columns, which are smaller than arrays of one
        met = at.repartition("clip_id", "__c").groupBy(F.col("clip_id").alias("__clip"), "__c").agg(F.array_sort(F.collect_list(F.struct(*values))).alias(f"__met{i}"))
        mine = F.col("__cell") if times == 1 else F.floor(F.col("__cell") / times)
        runs = runs.hint("merge").join(met.hint("merge"), (F.col("clip_id") == F.col("__clip")) & (mine == F.col("__c")), "left").drop("__clip", "__c")
    met = [f"__met{i}" for i in range(len(parts))]
    return runs.withColumn(name, F.col(met[0]) if len(met) == 1 else F.array_sort(F.concat(*[F.coalesce(m, F.array().cast(runs.schema[m].dataType)) for m in met]))).drop(*met)


def window_samples(candidates: DataFrame, events: DataFrame, ignores: DataFrame, clips: DataFrame, split: str | None = None, least: float = 0.5, duration: float = 2.5, stride: float = 0.5, weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> DataFrame:
    """(sample_id, candidate_id, clip_id, k, window_start_s, window_end_s, label, event_id, event_confidence, weight, split): inference_windows() whose centre no closed ignore interval holds.

    The first event of the two types, by (t_start, event_id), whose closed interval holds the centre labels a window, else background; high, med and low confidence have weights, all else the first.
    Samples are numbered in the order of (candidate_id, k), inside key ranges and not in one task; numbers over 999,999 have more digits. With a split, only its clips.
    Rows are runs of a candidate's windows in one cell, stored with the number of windows before them; windows are taken out of them last, and are never shuffled.
    """
    cell, s, e = 60.0, F.col("window_start_s"), F.col("window_end_s")
    of = clips.groupBy("clip_id").agg(F.min("split").alias("split"))
    c = candidates.filter(e - s >= least).select("candidate_id", "clip_id", "window_start_s", "window_end_s")
    c = c.withColumn("__b", key_ranges(c, "candidate_id")).hint("merge").join((of if split is None else of.filter(F.col("split") == split)).hint("merge"), "clip_id", "left" if split is None else "inner")
    runs, window = cell_runs(c, duration, stride, cell)
    center = lambda k: (window(k)["s"] + window(k)["e"]) / 2
    holds = lambda met, at: F.filter(met, lambda v: at.between(v["t_start"], v["t_end"]))

    ev = events.filter(F.col("type").isin("pickup", "putdown")).select("clip_id", "t_start", "event_id", "type", F.col("confidence").alias("sure"), "t_end")
    runs = with_met(runs, ev, "t_start", "t_end", ["t_start", "event_id", "type", "sure", "t_end"], "__ev", cell)
    runs = with_met(runs, ignores.select("clip_id", "t_start", "t_end"), "t_start", "t_end", ["t_start", "t_end"], "__ign", cell)
    touching = lambda met: F.filter(met, lambda v: (v["t_start"] <= center(F.col("__hi"))) & (v["t_end"] >= center(F.col("__lo"))))
    runs = runs.withColumns({m: F.nullif(touching(F.col(m)), F.array().cast(runs.schema[m].dataType)) for m in ("__ev", "__ign")})
    every = F.sequence("__lo", "__hi")
    kept = F.when(F.col("__ign").isNull(), every).otherwise(F.filter(every, lambda k: F.size(holds(F.col("__ign"), center(k))) == 0))
    # runs without a window only count as the first of their candidate
    runs = runs.withColumn("__n", F.size(kept)).filter("__n > 0 or __lo = 0")
    before = F.sum("__n").over(Window.partitionBy("__b").orderBy(F.asc_nulls_last("candidate_id"), "__cell").rowsBetween(Window.unboundedPreceding, -1))
    twins = (F.sum((F.col("__lo") == 0).cast("int")).over(Window.partitionBy("__b", "candidate_id")) > 1) | F.col("candidate_id").isNull()
    runs = stored(runs.withColumns({"__before": F.coalesce(before, F.lit(0)), "__twins": twins}).drop("__cell"), "window_runs")

    ranges = {r["__b"]: r for r in runs.groupBy("__b").agg(F.sum("__n").alias("n"), F.max("__twins").alias("twins")).collect()}
    start, total = [], 0
    for b in range(max(ranges, default=-1) + 1):
        start.append(total)
        total += ranges[b]["n"] if b in ranges else 0
    first = F.get(F.array(*[F.lit(x).cast("long") for x in start or [0]]), F.col("__b")) + F.col("__before")

    def exploded(some: DataFrame) -> DataFrame:
        out = some.withColumn("__first", first).select("*", F.posexplode(kept).alias("__p", "k"))
        out = out.withColumns({"s": window(F.col("k"))["s"], "e": window(F.col("k"))["e"]})
        v = F.when(F.col("__ev").isNotNull(), F.get(holds(F.col("__ev"), (F.col("s") + F.col("e")) / 2), F.lit(0)))
        return out.select("candidate_id", "clip_id", "split", "__first", "__p", "k", "s", "e", v.alias("v"))

    rows = exploded(runs.filter("not __twins")).withColumn("n", F.col("__first") + F.col("__p"))
    if any(r["twins"] for r in ranges.values()):  # several candidates of one id are numbered and labelled together; without an id there is no event
        own = Window.partitionBy("candidate_id")
        at = F.row_number().over(own.orderBy("k", "clip_id", "s", "e")) - 1
        both = exploded(runs.filter("__twins")).withColumns({"n": F.min("__first").over(own) + at, "v": F.when(F.col("candidate_id").isNotNull(), F.min("v").over(Window.partitionBy("candidate_id", "k")))})
        rows = rows.unionByName(both)
    sure = F.col("v.sure")
    weight = F.when(sure == "med", weights[1]).when(sure == "low", weights[2]).otherwise(weights[0])
    name = F.concat(F.lit("b1_"), F.format_string("%06d", "n"))
    return rows.select(name.alias("sample_id"), "candidate_id", "clip_id", "k", F.col("s").alias("window_start_s"), F.col("e").alias("window_end_s"), F.coalesce("v.type", F.lit("background")).alias("label"), F.col("v.event_id").alias("event_id"), sure.alias("event_confidence"), weight.alias("weight"), "split")


def preview_frames(ranges: DataFrame, observations: DataFrame, clips: DataFrame, preview_fps: float) -> DataFrame:
    """(clip_id, frame), each once: of half-open ranges (clip_id, start_frame, end_frame) every step-th frame and the last one, and the frames of observations (clip_id, frame) in them.

    clips has fps and total_frames; the step is their ratio to preview_fps, rounded half to even, at least 1. Frames outside a clip's total are left out.
    """
    r = ranges.join(clips.select("clip_id", "fps", "total_frames"), "clip_id")
    total = F.col("total_frames").cast("long")
    a = F.least(F.greatest(F.lit(0), F.col("start_frame")), total).cast("long")
    b = F.least(F.greatest(a, F.col("end_frame")), total).cast("long")
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / F.least(F.lit(float(preview_fps)), F.col("fps")))).cast("long")
    r = r.select("clip_id", a.alias("start_frame"), b.alias("end_frame"), step.alias("step")).filter("start_frame < end_frame")
    grid = r.select("clip_id", F.explode(F.concat(F.sequence(F.col("start_frame"), F.col("end_frame") - 1, F.col("step")), F.array(F.col("end_frame") - 1))).alias("frame"))
    seen = frames_in_ranges(observations.select("clip_id", F.col("frame").cast("long").alias("frame")), r)
    return grid.union(seen).distinct()


def span_windows(start: Column, end: Column, duration: float = 10.0, step: float = 5.0, least: float = 2.0, cap: int = 50) -> Column:
    """Array of (s, e): overlapping windows of a span. Where the last one would be shorter than `least`, the one before is cut to `least` and
    a window from there to the end follows; none for a span under `least`, at most cap."""
    span = end - start
    # the first window that starts at T with less than `least` left, or reaches the end
    regular = F.ceil(span / step - 1e-12).cast("int")  # starts before the end
    n = F.greatest(regular, F.lit(1))
    short = end - (start + (n - 1) * step) < least  # only the last start can leave so little, as step >= least
    keep = F.least(F.when(short, n - 1).otherwise(n), F.lit(cap))
    full = F.transform(F.sequence(F.lit(0), keep - 1), lambda i: F.struct((start + i * step).alias("s"), F.least(start + i * step + duration, end).alias("e")))
    last = start + (n - 2) * step
    cut = F.array(F.struct(last.alias("s"), (last + least).alias("e")))
    rest = F.when(end - (last + least) >= least, F.array(F.struct((last + least).alias("s"), F.least(last + least + duration, end).alias("e")))).otherwise(F.array().cast("array<struct<s:double,e:double>>"))
    none = F.array().cast("array<struct<s:double,e:double>>")
    shrunk = F.concat(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), cut, rest)
    can = short & (n > 1) & (n - 1 <= cap) & (F.least(last + duration, end) - last > least)
    return F.when((span < least) | (span <= 0), none).when(can, F.slice(shrunk, 1, cap)).otherwise(full)


def adaptive_times(start: Column, end: Column, contact: Column, most: float = 1.0) -> Column:
    """Array of (t, position): pre, contact and post, with mids between them so that no gap is longer than `most`. A contact at either end is not repeated."""

    def mids(a: Column, b: Column) -> Column:
        n = F.ceil((b - a) / most).cast("int")
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: point(a + i * ((b - a) / n), "mid"))).otherwise(F.array().cast("array<struct<t:double,position:string>>"))

    def point(t: Column, position: str) -> Column:
        return F.struct(t.cast("double").alias("t"), F.lit(position).alias("position"))

    none = F.array().cast("array<struct<t:double,position:string>>")
    at = F.when(F.abs(contact - start) <= 1e-6, none).otherwise(F.array(point(contact, "contact")))
    post = F.when(F.abs(contact - end) <= 1e-6, none).otherwise(F.array(point(end, "post")))
    return F.concat(F.array(point(start, "pre")), mids(start, contact), at, mids(contact, end), post)


def frames_at_rate(total: Column, fps: float, target: float) -> Column:
    """Frame numbers at a target rate: half-even rounding of i x fps / min(target, fps), each once, all below total."""
    step = fps / min(target, fps)
    n = F.ceil(total / step).cast("int")
    frames = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.bround(i * F.lit(step)).cast("long")))
    return F.filter(frames, lambda f: f < total)


def frames_by_stride(total: Column, stride: int) -> Column:
    return F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def frames_between(start: Column, end: Column, n: int, fps: float) -> Column:
    """n frame numbers evenly spaced from the first to the last frame of an interval, rounded down."""
    a = (start * fps).cast("int")
    b = F.greatest((end * fps).cast("int"), a + 1) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(a + i * ((b - a) / F.lit(max(1, n - 1)))).cast("int"))


def expand_items(rows: DataFrame, count: str, key: str) -> DataFrame:
    """One row per item (at least one); with several items the key ends in _item0, _item1, ..."""
    n = F.greatest(F.coalesce(count, F.lit(1)), F.lit(1)).cast("int")
    out = rows.withColumn("__n", n).withColumn("item", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return out.withColumn(key, F.when(F.col("__n") > 1, F.concat(F.col(key), F.lit("_item"), F.col("item").cast("string"))).otherwise(F.col(key))).drop("__n")
