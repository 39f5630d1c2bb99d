"""What a chunked replay of the utterances reports along the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerovox.limits import check_range
from aerovox.operators.polls import ISO_UTC
from aerovox.operators.sequence import Numbered, totals_before, unfold
from aerovox.operators.utterances import UTTERANCE_ORDER
from aerovox.session import store


def _check(chunk_size: int, total: int) -> None:
    check_range("chunk_size", chunk_size, 10, 10_000)
    check_range("total_utterances", total, 0, 1_000_000)


def _epoch(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / 1e6


def _rate(sent: Column, elapsed: Column) -> Column:
    return F.coalesce(sent / F.nullif(elapsed, F.lit(0.0)), F.lit(0.0))


def describe_rate(rate: Column) -> Column:
    return F.concat(F.round(rate, 0).cast("string"), F.lit(" utterances/second"))


def chunk_progress(utterances: DataFrame, chunk_size: int = 100, total_utterances: int = 0) -> DataFrame:
    """One row per chunk of a replay in time order: size, total and percent sent, elapsed
    time and throughput so far. ``total_utterances`` ends the replay early, 0 means all.

    Which utterance closes a chunk depends on counts per time only, so the utterances are
    counted where they lie and never sorted or numbered one by one.
    """
    _check(chunk_size, total_utterances)
    times = store(utterances.groupBy("timestamp").agg(F.count("*").alias("n")), "times")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    whole = times.agg(
        F.sum("n").alias("n"),
        F.min("timestamp").alias("begin"),
        F.bool_and(micros % 1_000_000 == 0).alias("whole_seconds"),
    ).first()
    # A missing time counts as the first one, when nothing has elapsed yet.
    counted = totals_before(times, "timestamp", ["n"], bool(whole.whole_seconds))
    everything = min(whole.n or 0, total_utterances or whole.n or 0)
    before, upto = F.col("n_before"), F.least(F.col("n_before") + F.col("n"), F.lit(everything))
    # A time closes every chunk that ends among its own utterances, and the last one, if short.
    full = F.floor(upto / chunk_size)
    closed = F.when(upto == everything, F.ceil(upto / chunk_size)).otherwise(full)
    chunk, sent = F.col("chunk_number"), F.col("total_sent")
    elapsed = F.coalesce(_epoch(F.col("timestamp")) - _epoch(F.lit(whole.begin)), F.lit(0.0))
    return (
        unfold(counted.where(before < everything), F.floor(before / chunk_size) + 1, closed, "chunk_number")
        .withColumn("total_sent", F.least(chunk * chunk_size, F.lit(everything)))
        .select(
            "chunk_number",
            (sent - (chunk - 1) * chunk_size).alias("chunk_size"),
            "total_sent",
            F.round(sent / everything * 100, 2).alias("percent"),
            F.round(elapsed, 2).alias("elapsed_seconds"),
            F.round(_rate(sent, elapsed), 2).alias("throughput"),
            describe_rate(_rate(sent, elapsed)).alias("throughput_description"),
        )
    )


def sample_chunks(chunks: DataFrame, every: int = 10, head: int = 5) -> DataFrame:
    """The chunks a display shows: the first few, then every tenth."""
    return chunks.where((F.col("chunk_number") % every == 0) | (F.col("chunk_number") <= head))


def chunk_envelopes(utterances: DataFrame, chunk_size: int = 100, total_utterances: int = 0) -> DataFrame:
    """Each chunk as JSON text: its utterances in order, the time of the last, and how far the replay
    has come. A chunk is at most 10,000 rows.

    ``total_utterances`` ends the replay early; only then is the end known beforehand and the JSON
    has ``progress``. A replay goes by the utterances' own times.
    """
    _check(chunk_size, total_utterances)
    numbered = Numbered(utterances, UTTERANCE_ORDER)
    end = F.col("position") + F.col("copies") - 1
    if total_utterances:
        end = F.least(end, F.lit(total_utterances))
    first, last = (F.floor((at - 1) / chunk_size) + 1 for at in (F.col("position"), end))
    # What is behind the end has an empty run of chunks.
    wanted = numbered.rows.where(F.col("position") <= end)
    parts = unfold(wanted, first, last, "chunk_number")
    low = F.greatest(F.col("position"), (F.col("chunk_number") - 1) * chunk_size + 1)
    high = F.least(end, F.col("chunk_number") * chunk_size)
    part = F.struct(
        low.alias("low"),
        (high - low + 1).cast("int").alias("times"),
        F.struct(*[_plain(utterances, c) for c in utterances.columns]).alias("utterance"),
    )
    ordered = F.sort_array(F.collect_list(part))
    repeated = F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["utterance"], p["times"])))
    chunks = parts.groupBy("chunk_number").agg(repeated.alias("utterances"), F.max("timestamp").alias("timestamp"))
    reports = chunk_progress(utterances, chunk_size, total_utterances)
    stats = ("total_sent", "elapsed_seconds", "throughput", "throughput_description")
    fields = [
        F.date_format("timestamp", ISO_UTC).alias("timestamp"),
        "chunk_number",
        "chunk_size",
        "utterances",
        F.struct(*stats).alias("stats"),
    ]
    if total_utterances:
        total = F.lit(total_utterances).cast("long").alias("total")
        percent = F.round(F.col("total_sent") / total_utterances * 100, 2).alias("percent")
        fields.append(F.struct(F.col("total_sent").alias("sent"), total, percent).alias("progress"))
    return chunks.join(reports, "chunk_number").select(
        "chunk_number",
        "chunk_size",
        "total_sent",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("envelope"),
    )


def _plain(df: DataFrame, name: str) -> Column:
    if name == "timestamp":
        return F.date_format(name, ISO_UTC).alias(name)
    return F.col(name)


def utterance_progress(utterances: DataFrame, max_utterances: int = 50) -> DataFrame:
    """The first ``max_utterances`` in replay order, each with its ``k/n`` and as JSON text."""
    check_range("max_utterances", max_utterances, 5, 500)
    first = utterances.orderBy(*UTTERANCE_ORDER).limit(max_utterances)
    place = F.row_number().over(Window.orderBy(*UTTERANCE_ORDER))  # over those few rows only
    return first.withColumn("progress", F.concat_ws("/", place, F.lit(max_utterances))).select(
        "conversation_id",
        "utterance_id",
        "progress",
        F.to_json(
            F.struct(
                _plain(utterances, "timestamp"),
                F.struct(*[_plain(utterances, c) for c in utterances.columns]).alias("utterance"),
                "progress",
            ),
            {"ignoreNullFields": "false"},
        ).alias("envelope"),
    )
