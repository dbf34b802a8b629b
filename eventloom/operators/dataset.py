"""Labels, statistics, splits and ledgers of training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hand_state(label: Column, position: Column, crop: Column) -> Column:
    """empty or carrying for hand crops before and after an event, else null."""
    before, after = position == "pre", position == "post"
    empty = (label == "pickup") & before | (label == "putdown") & after
    carrying = (label == "pickup") & after | (label == "putdown") & before
    return F.when(crop != "hand", None).when(empty, "empty").when(carrying, "carrying")


def shelf_state(label: Column, position: Column, crop: Column) -> Column:
    """removed, placed or no_change for shelf crops after an event, else null."""
    return F.when((crop == "shelf") & (position == "post"), F.when(label == "pickup", "removed").when(label == "putdown", "placed").when(label == "negative", "no_change"))


def dataset_stats(records: DataFrame) -> DataFrame:
    """Counts by label, split and crop type, and in all, from one scan."""
    names = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("label", "split", "crop_type")], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    return records.select(F.explode(names).alias("g")).groupBy("g.dimension", "g.value").agg(F.count("*").alias("n"))


def manifest_stats(records: DataFrame) -> DataFrame:
    """dataset_stats() and, as one more row, how many distinct batches there are; a null batch is none."""
    batches = records.agg(F.count_distinct("batch_id").alias("n")).select(F.lit("batches").alias("dimension"), F.lit("distinct").alias("value"), "n")
    return dataset_stats(records).unionByName(batches)


def class_weights(records: DataFrame, label: str = "label") -> DataFrame:
    """n / (k x count) per label."""
    c = records.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, f1, null for classes absent from truth."""
    cells = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    t = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("n_predicted"))
    out = t.join(p, "class", "left").fillna(0, ["n_predicted"])
    precision = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    recall = F.col("tp") / F.col("support")
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def split_leakage(records: DataFrame, key: str = "clip_id", split: str = "split") -> DataFrame:
    """Keys that are in more than one split."""
    return records.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.array_sort(F.collect_set(split)).alias("splits")).filter("n_splits > 1")


def ledger_sync(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """Known files keep their flags; new ones are added with none set."""
    new = listing.select("file_name", F.col("etag").alias("source_etag"), F.col("size").alias("source_size_bytes")).join(ledger, "file_name", "left_anti")
    return ledger.unionByName(new.withColumns({c: F.lit(False) for c in ("downloaded", "generated", "uploaded")}))


def ledger_reconcile(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_name, outcome): missing, adopted, changed or unchanged."""
    a, b = ledger.alias("a"), listing.alias("b")
    both = a.join(b, "file_name", "full_outer")
    outcome = F.when(F.col("b.etag").isNull(), "missing").when(F.col("a.source_etag").isNull(), "adopted").when((F.col("a.source_etag") != F.col("b.etag")) | (F.col("a.source_size_bytes") != F.col("b.size")), "changed").otherwise("unchanged")
    return both.select("file_name", outcome.alias("outcome"))


def read_ledger(rows: DataFrame) -> DataFrame:
    """A ledger of today's columns from text columns of either header: file_name and processed (then generated and uploaded are what processed was, and
    nothing counts as downloaded), or file_name with a flag each. Rows without a name are left out, of repeated names the last in text order stays."""
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in rows.columns else F.lit("").alias(c)
    legacy = "processed" in rows.columns and len(rows.columns) == 2
    flags = {"downloaded": F.lit(False), "generated": yes("processed"), "uploaded": yes("processed")} if legacy else {c: yes(c) if c in rows.columns else F.lit(False) for c in ("downloaded", "generated", "uploaded")}
    named = rows.withColumn("file_name", F.trim("file_name")).filter("file_name <> ''")
    out = named.select("file_name", *[v.alias(k) for k, v in flags.items()], *map(text, ("local_source_path", "source_etag", "source_size_bytes", "last_error")))
    rest = [c for c in out.columns if c != "file_name"]
    return out.groupBy("file_name").agg(F.max(F.struct(*rest)).alias("s")).select("file_name", "s.*")


def reconcile(ledger: DataFrame, disk: DataFrame, listing: DataFrame, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ledger, warnings) after a look at disk (file_name, size), the files at a row's path, and at listing (file_name, etag, size), the source.

    A downloaded row whose file is missing is no longer downloaded. One whose source has another etag, or with equal or unknown etags another size, has changed: it is no longer
    downloaded, with source_changed as its error, unless refresh is on. A row with a path that is not downloaded is adopted, with the source's etag and size, if its file has the source's size. warnings: (file_name, warning).
    """
    d = disk.select("file_name", F.col("size").cast("string").alias("__disk"))
    s = listing.select("file_name", F.col("etag").cast("string").alias("__etag"), F.col("size").cast("string").alias("__size"))
    rows = ledger.join(d, "file_name", "left").join(s, "file_name", "left")
    known = lambda a, b: (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    etag = known("__etag", "source_etag") & (F.col("__etag") != F.col("source_etag"))
    size = known("__size", "source_size_bytes") & (F.col("__size") != F.col("source_size_bytes"))
    lost = F.col("downloaded") & F.col("__disk").isNull()
    warning = F.when(lost, "file is missing").when(F.col("downloaded") & etag, "source has another etag").when(F.col("downloaded") & size, "source has another size")
    adopted = ~F.col("downloaded") & (F.coalesce("local_source_path", F.lit("")) != "") & F.coalesce(F.col("__disk") == F.col("__size"), F.lit(False))
    rows = rows.withColumns({"__w": warning, "__a": adopted})
    changed = F.col("__w").startswith("source") & F.lit(not refresh)
    new = {
        "downloaded": F.when(F.col("__a"), True).when((F.col("__w") == "file is missing") | changed, False).otherwise(F.col("downloaded")),
        "last_error": F.when(F.coalesce(changed, F.lit(False)), "source_changed").otherwise(F.col("last_error")),
        "source_etag": F.when(F.col("__a"), F.coalesce("__etag", "source_etag")).otherwise(F.col("source_etag")),
        "source_size_bytes": F.when(F.col("__a"), F.col("__size")).otherwise(F.col("source_size_bytes")),
    }
    out = rows.select(*[new.get(c, F.col(c)).alias(c) for c in ledger.columns])
    return out, rows.filter("__w is not null").select("file_name", F.col("__w").alias("warning"))


def duplicate_sources(listing: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The first row per key is kept and linked to the last row dropped for it; null keys compare as ''."""
    k = [F.coalesce(c, F.lit("")) for c in keys]
    rank = F.row_number().over(Window.partitionBy(*k).orderBy(name))
    last = F.last(name).over(Window.partitionBy(*k).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = listing.withColumn("__r", rank).withColumn("__last", last).filter("__r = 1")
    return rows.withColumn("duplicate_of", F.when(F.col("__last") != F.col(name), F.col("__last"))).drop("__r", "__last")


def track_summaries(obs: DataFrame, max_gap: float, min_obs: int, min_duration: float, min_confidence: float) -> DataFrame:
    """Runs of a track split where the gap exceeds max_gap, with a track stable if any run is."""
    by = Window.partitionBy("clip_id", "track_key").orderBy("t_h", "sample_index")
    gap = F.col("t_h") - F.lag("t_h").over(by)
    rows = obs.withColumn("gap", gap).withColumn("run", F.sum(F.when(F.col("gap") > max_gap, 1).otherwise(0)).over(by))
    inside = F.when(F.col("gap") <= max_gap, F.col("gap"))
    runs = rows.groupBy("clip_id", "track_key", "run").agg(F.min("t_h").alias("first_seen"), F.max("t_h").alias("last_seen"), F.count("*").alias("n_observations"), F.coalesce(F.max(inside), F.lit(0.0)).alias("max_gap"), F.min("confidence").alias("least"))
    ok = (F.col("n_observations") >= min_obs) & (F.col("last_seen") - F.col("first_seen") >= min_duration) & (F.col("least") >= min_confidence)
    return runs.withColumn("is_stable", F.bool_or(ok).over(Window.partitionBy("clip_id", "track_key"))).drop("least")


def with_stability(obs: DataFrame, max_gap: float, min_obs: int, min_duration: float, min_confidence: float) -> DataFrame:
    """obs with is_stable of their track, as track_summaries has it."""
    tracks = track_summaries(obs, max_gap, min_obs, min_duration, min_confidence).select(F.col("clip_id").alias("__c"), F.col("track_key").alias("__t"), "is_stable").distinct()
    return obs.join(tracks, F.col("clip_id").eqNullSafe(F.col("__c")) & F.col("track_key").eqNullSafe(F.col("__t"))).drop("__c", "__t")


def list_batches(records: DataFrame) -> DataFrame:
    """Rows per batch, null as unknown, with the first created_at where there is such a column."""
    first = [F.min("created_at").alias("created_at")] * ("created_at" in records.columns)
    return records.groupBy(F.coalesce("batch_id", F.lit("unknown")).alias("batch_id")).agg(F.count("*").alias("n"), *first)


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.agg(*[F.count_if(F.col(c)).alias(c) for c in ("downloaded", "generated", "uploaded")], F.count("*").alias("total"))


def select_ready(ledger: DataFrame, stage: str, limit: int, skip: DataFrame | None = None) -> DataFrame:
    """The first `limit` files, by name, that a stage (download, generation, upload) may take: the flag before it is set, its own is not, and skip lacks them."""
    ready = {"download": "not downloaded", "generation": "downloaded and not generated", "upload": "generated and not uploaded"}[stage]
    rows = ledger.filter(ready)
    rows = rows if skip is None else rows.join(skip.select("file_name"), "file_name", "left_anti")
    return rows.select("file_name").orderBy("file_name").limit(limit)


def rewritten(column: str, old: str, new: str) -> tuple[Column, Column]:
    """A path with every occurrence of a prefix replaced, and how many there were."""
    left = F.length(F.replace(F.col(column), F.lit(old), F.lit("")))
    return F.replace(F.col(column), F.lit(old), F.lit(new)), ((F.length(column) - left) / len(old)).cast("int")


def milliseconds(column: str) -> Column:
    return F.round(F.col(column) * 1000).cast("long").cast("string")


def stable_id(prefix: str, digits: int, *parts) -> Column:
    """A name from the SHA-256 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def clip_universe(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Clips of either side, and in which they are."""
    both = gt.select("clip_id", F.lit("gt").alias("src")).unionByName(pred.select("clip_id", F.lit("pred").alias("src")))
    return both.groupBy("clip_id").agg(F.bool_or(F.col("src") == "gt").alias("in_gt"), F.bool_or(F.col("src") == "pred").alias("in_pred"))


def report_summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, balanced accuracy, macro precision, recall and f1 over the classes of truth, and the share of uncertain predictions."""
    macro = classification_report(rows, truth, predicted).agg(F.avg("recall").alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    whole = rows.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg((F.col(predicted) == "uncertain").cast("double")).alias("uncertain_share"))
    return whole.crossJoin(macro)  # two single rows


def confusion_counts(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def row_weights(records: DataFrame, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """records with weight: its label's class weight times 1 for high and med, 0.5 for low confidence."""
    w = class_weights(records, label).select(label, F.col("weight").alias("__w"))
    return records.join(w, label).withColumn("weight", F.col("__w") * F.when(F.col(confidence) == "low", 0.5).otherwise(1.0)).drop("__w")
