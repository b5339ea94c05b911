"""The streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pictorium.functions import fixed_values as V
from pictorium.operators import ingest, metrics
from pictorium.plans.scratch import new_path

from .runtime import batch_folder, drain, latest_rows, read_batches, start


CATALOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("file_hash", T.StringType()), T.StructField("mime_type", T.StringType())])


def stream_ingest(files: DataFrame, out: str | None = None, checkpoint: str | None = None, library: DataFrame | None = None) -> DataFrame:
    """Validate, hash and store new files ``(seq, path, length, content)``.
    A file whose hash the ``library`` (column ``file_hash``), an earlier batch, or an earlier row of its own
    batch holds is left out; this holds over any time span, as the catalog itself
    is the state."""
    spark = files.sparkSession
    out = out or new_path(spark, "ingest")

    def store(batch: DataFrame, batch_id: int) -> None:
        checked = ingest.hash_content(ingest.validate_assets(batch)).drop("content")
        good = checked.filter(F.col("reason").isNull()).select(*CATALOG.names)
        if batch_id > 0:
            # only older batches, so that running a batch again changes nothing
            stored = read_batches(batch.sparkSession, out, CATALOG).filter(F.col("batch_id") < batch_id)
        else:
            stored = good.limit(0)
        hashes = stored.select("file_hash")
        if library is not None:
            hashes = hashes.unionByName(library.select("file_hash"))
        fresh = ingest.exact_dedup(good, hashes)
        fresh.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    start(files, store, "append", checkpoint or new_path(spark, "ingest-state")).awaitTermination()
    return read_batches(spark, out, CATALOG).drop("batch_id")


def stream_exact_dedup(rows: DataFrame, key: str, **where) -> DataFrame:
    """One row of every key, the first that arrives; keys are remembered for
    the stream's whole life, however late a copy comes.

    The state store holds one key per distinct value, hash-partitioned like the shuffle.  On a
    cluster use the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``), which keeps it on disk."""
    kept = rows.dropDuplicates([key])
    schema = kept.schema
    return read_batches(rows.sparkSession, drain(kept, "append", **where), schema).drop("batch_id")


def _running(grouped: DataFrame, keys: list[str], **where) -> DataFrame:
    schema = grouped.schema
    return latest_rows(read_batches(grouped.sparkSession, drain(grouped, "update", **where), schema), keys)


def stream_progress(assets: DataFrame, **where) -> DataFrame:
    """Running counts by work state."""
    return _running(assets.groupBy("ai_status").agg(F.count(F.lit(1)).alias("n")), ["ai_status"], **where)


def stream_error_patterns(events: DataFrame, **where) -> DataFrame:
    """Running counters per pattern with first and last sighting."""
    counted = events.groupBy("pattern_name").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return _running(counted, ["pattern_name"], **where)


def stream_daily_accuracy(assets: DataFrame, **where) -> DataFrame:
    """Accuracy per day of processing.  The state is one row per day, so days
    never close and rows may come in any order."""
    done = assets.filter((F.col("ai_status") == "completed") & F.col("ai_processed_at").isNotNull())
    rows = done.groupBy(F.date_format("ai_processed_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ai_tag_status") == "verified").alias("correct")
    )
    return _running(rows, ["day"], **where).withColumn("accuracy", F.col("correct") / F.col("total"))


BIN_SUMS = T.StructType([T.StructField("bin", T.LongType()), T.StructField("confidence_sum", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("n_correct", T.LongType())])


def stream_calibration(samples: DataFrame, n_bins: int = 10, **where) -> tuple[DataFrame, DataFrame]:
    """``(bins, errors)`` of all samples so far.  A batch stores its bin sums
    (at most ``n_bins`` rows), so a refresh never reads samples again."""

    def sums(batch: DataFrame, batch_id: int) -> DataFrame:
        good, _ = metrics.split_samples(batch)
        index = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).cast("long")
        return good.groupBy(index.alias("bin")).agg(
            F.sum("confidence").alias("confidence_sum"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("long")).alias("n_correct")
        )

    stored = read_batches(samples.sparkSession, drain(samples, "append", sums, **where), BIN_SUMS)
    merged = stored.groupBy("bin").agg(F.sum("confidence_sum").alias("s"), F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
    bins = merged.select(
        "bin", (F.col("s") / F.col("n")).alias("avg_confidence"), (F.col("n_correct") / F.col("n")).alias("accuracy"), "n", "n_correct"
    )
    return bins, metrics.calibration_errors(bins)


RETRY = "item string, status string, retry_count long, next_retry_us long"


def _retry_columns(ok_us: Column, failures_us: Column, max_attempts: int) -> list[Column]:
    """State from the first success and the earliest failures before it."""
    before = F.filter(failures_us, lambda t: ok_us.isNull() | (t < ok_us))
    n = F.size(before).cast("long")
    status = F.when(n >= max_attempts, F.lit("failed")).when(ok_us.isNotNull(), F.lit("completed")).otherwise(F.lit("pending"))
    wait = F.element_at(before, -1) + (F.pow(F.lit(2), n) * 1_000_000).cast("long")
    return [status.alias("status"), n.alias("retry_count"), F.when(status == "pending", wait).alias("next_retry_us")]


def _earliest(us: DataFrame, max_attempts: int) -> DataFrame:
    """First success and earliest failures of every item: all that decides its
    state.  At most that many rows per item and task reach the shuffle."""
    order = Window.partitionBy("item", "ok").orderBy("us")
    ranked = us.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_attempts)
    return ranked.filter(~F.col("ok") | (F.col("_rank") == 1)).drop("_rank")


def _states(earliest: DataFrame, max_attempts: int) -> DataFrame:
    # at most max_attempts + 1 rows per item
    state = earliest.groupBy("item").agg(
        F.min(F.when(F.col("ok"), F.col("us"))).alias("ok_us"),
        F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("us")))).alias("failures"),
    )
    return state.select("item", *_retry_columns(F.col("ok_us"), F.col("failures"), max_attempts))


def _micros(attempts: DataFrame) -> DataFrame:
    return attempts.select("item", "ok", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def retry_state(attempts: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Batch form over ``(item, ts, ok)``: an item is completed by its first
    success and failed by its third failure, whichever comes first; otherwise
    it waits ``2^n`` seconds after the last failure."""
    return _states(_earliest(_micros(attempts), max_attempts), max_attempts)


def stream_retry_state(attempts: DataFrame, max_attempts: int = V.MAX_ATTEMPTS, **where) -> DataFrame:
    """Streaming form of :func:`retry_state`, without a Python worker.

    What decides an item merges in any order, so a batch stores its first
    success and earliest failures per item, and reading merges the batches;
    late rows are handled exactly.
    """
    us = _micros(attempts)
    out = drain(us, "append", lambda batch, _: _earliest(batch, max_attempts), **where)
    stored = read_batches(attempts.sparkSession, out, us.schema).drop("batch_id")
    return _states(_earliest(stored, max_attempts), max_attempts)


#: State rows that :func:`stream_retry_updates` deals its items to.
RETRY_BUCKETS = 16_384


def stream_retry_updates(attempts: DataFrame, max_attempts: int = V.MAX_ATTEMPTS, buckets: int = RETRY_BUCKETS, **where) -> DataFrame:
    """The same states kept in the state store, for consumers that want every
    change of an item as it happens.

    The state of an item is its first success and its earliest failures, which
    merge in any order; late rows are therefore handled exactly.  Each task
    first reduces its rows to that many per item, so an item that makes up a
    third of the stream sends a handful of rows per task.  Items are dealt to ``buckets`` by a hash, and a state row holds
    those of a bucket: a batch costs a Python call per bucket at most, however many items it has.  ``buckets`` may not change between restarts.
    """
    us = _micros(attempts)

    def earliest(batches):
        for pdf in batches:
            pdf = pdf.sort_values("us", kind="stable")
            nth = pdf.groupby(["item", "ok"], sort=False, dropna=False).cumcount()
            yield pdf[(nth < 1) | (pdf["ok"].eq(False) & (nth < max_attempts))]

    def advance(key, chunks, state):
        import pandas as pd

        known = {item: (ok, failures) for item, ok, failures in zip(*state.get)} if state.exists else {}
        changed = {}
        for pdf in chunks:
            for item, good, at in zip(pdf["item"].tolist(), pdf["ok"].tolist(), pdf["us"].tolist()):
                ok, failures = known.get(item, (None, []))
                if at == at and at is not None:  # a row without time or outcome only makes its item known
                    if good:
                        ok = int(at) if ok is None else min(ok, int(at))
                    elif good is not None:
                        failures = sorted([*failures, int(at)])[:max_attempts]
                known[item] = changed[item] = (ok, failures)
        state.update((list(known), [ok for ok, _ in known.values()], [failures for _, failures in known.values()]))
        rows = []
        for item, (ok, failures) in changed.items():
            before = [t for t in failures if ok is None or t < ok]
            n = len(before)
            status = "failed" if n >= max_attempts else "completed" if ok is not None else "pending"
            # -1 stands for "no retry" until the rows are read back
            rows.append((item, status, n, before[-1] + 2**n * 1_000_000 if status == "pending" and before else -1))
        yield pd.DataFrame(rows, columns=["item", "status", "retry_count", "next_retry_us"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    reduced = us.mapInPandas(earliest, us.schema)
    dealt = reduced.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
    states = dealt.groupBy("bucket").applyInPandasWithState(
        advance, RETRY, "items array<string>, ok array<long>, failures array<array<long>>", "update", GroupStateTimeout.NoTimeout
    )
    latest = _running(states, ["item"], **where)
    return latest.withColumn("next_retry_us", F.when((F.col("status") == "pending") & (F.col("next_retry_us") >= 0), F.col("next_retry_us")))
