"""Sequence scores for lines as they come: a file's last lines are carried from one micro-batch to the next.

Sequences run within a file, in the order of its line numbers.  The state of a file is its number of lines and the ids
and severities of the last ``w`` of them, so a line is scored with the lines before it wherever a micro-batch was cut,
and also after a restart from the checkpoint.  ``file_sequences`` gives the same rows for a finished table.

A file is one sequence by nature, so its new lines of a micro-batch are put in order by one task; the size of a
micro-batch (``maxFilesPerTrigger`` and the like) bounds that.  Lines must reach the stream in the order of their file;
a line that comes late counts as the newest one.  With ``idle``, a file that gets no line for that long, by event
time, is forgotten: it starts anew if it comes back, and lines later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.severity import severity_score
from ..operators.detectors import context_tree, tfidf_seq
from ..operators.detectors.ngram_next import UNKNOWN
from ..operators.ordering import PART, POS, lay_out, number_rows
from ..operators.sequences import BUCKET_ROWS, OWN, frame, with_backward_halo
from ..operators.vocabulary import with_template, with_template_id
from .live import score_batches

LINE = ["file_path", "line_number", "timestamp", "template_id", "severity_score"]
SEQUENCES = "file_path string, position long, line_number long, sequence array<long>, max_severity_score long"
CHUNK = 50_000  # lines of a file that are handed on at once
CARRIED = "lines long, ids array<long>, severities array<long>"


def line_ids(logs: DataFrame, vocab: DataFrame) -> DataFrame:
    """What a sequence needs of each line; for streams and for tables."""
    ids = with_template_id(with_template(logs), vocab, UNKNOWN)
    return ids.withColumn("severity_score", severity_score(F.col("level"), F.col("message")).cast("long")).select(*LINE)


def carried_sequences(lines: DataFrame, w: int, idle: str | None = None) -> DataFrame:
    """For each line of the stream that ends a full sequence: the ids of the last ``w + 1`` lines (``w`` at first)."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, ids, severities = state.get if state.exists else (0, [], [])
        new = pd.concat(list(chunks)).sort_values("line_number", kind="stable")
        before = len(ids)
        ids = np.concatenate([np.array(ids, np.int64), new["template_id"].to_numpy(np.int64)])
        severities = np.concatenate([np.array(severities, np.int64), new["severity_score"].to_numpy(np.int64)])
        numbers = new["line_number"].to_numpy()
        state.update((seen + len(new), ids[-w:].tolist(), severities[-w:].tolist()))
        if idle:
            newest = int(new["timestamp"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
        for at in range(max(before, w - 1), len(ids), CHUNK):
            ends = np.arange(at, min(at + CHUNK, len(ids)))
            some = list(sliding_window_view(ids, w + 1)[ends[ends >= w] - w]) if len(ids) > w else []
            yield pd.DataFrame({
                "file_path": [key[0]] * len(ends),
                "position": seen - before + ends,
                "line_number": numbers[ends - before],
                "sequence": [ids[:w], *some] if ends[0] < w else some,  # the first has no line before it
                "max_severity_score": sliding_window_view(severities, w)[ends + 1 - w].max(axis=1),
            })

    if idle:
        lines = lines.withWatermark("timestamp", idle)
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return lines.groupBy("file_path").applyInPandasWithState(step, SEQUENCES, CARRIED, "append", timeout)


def file_sequences(lines: DataFrame, w: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``carried_sequences`` for a table; a file of any size is cut into equal buckets."""
    rows = number_rows(lay_out(lines, ["file_path", "line_number"], "files")).drop(PART, POS)
    starts = rows.groupBy("file_path").agg(F.min("idx").alias("_first"))
    halo = with_backward_halo(rows, w + 1, bucket_rows=bucket_rows)
    near = F.collect_list(F.struct("file_path", "template_id", "severity_score")).over(frame(-w, 0))
    mine = halo.withColumn("_near", near).filter(OWN).withColumn(
        "_near", F.filter("_near", lambda x: x["file_path"] == F.col("file_path"))
    )
    last = F.transform(F.slice("_near", -F.least(F.size("_near"), F.lit(w)), w), lambda x: x["severity_score"])
    return mine.filter(F.size("_near") >= w).join(starts, "file_path").select(
        "file_path", (F.col("idx") - F.col("_first")).alias("position"), "line_number",
        F.transform("_near", lambda x: x["template_id"]).alias("sequence"), F.array_max(last).alias("max_severity_score"),
    )


def score_sequences(found: DataFrame, tree: context_tree.Fitted, tfidf: tfidf_seq.Fitted) -> DataFrame:
    """``prediction_prob`` of each line after the ``w`` before it (null for the first), ``max_z_score`` of the last ``w``.

    Both models must be fitted with the same ``w``, the ids must be those of the vocabulary of ``tree``.  Equal
    sequences are scored once.
    """
    w = tree.w
    if tfidf.w != w:
        raise ValueError("the two models look back over different numbers of lines")
    kinds = found.select("sequence").distinct().withColumns({
        "_before": F.when(F.size("sequence") > w, F.slice("sequence", 1, w)),
        "_last": F.slice("sequence", -w, w), "_next": F.element_at("sequence", -1),
    })
    cases = kinds.filter(F.col("_before").isNotNull()).select(F.col("_before").alias("sequence"), F.col("_next").alias("next_id"))
    probs = context_tree.score_cases(cases, tree).select(
        F.col("sequence").alias("_before"), F.col("next_id").alias("_next"), "predicted_template", "prediction_prob"
    )
    deviations = tfidf_seq.score_id_sequences(kinds.select(F.col("_last").alias("sequence")).distinct(), tfidf, tree.vocab)
    scored = kinds.join(probs, ["_before", "_next"], "left").join(deviations.withColumnRenamed("sequence", "_last"), "_last")
    # the lines are exchanged once, by their sequence
    return found.join(scored, "sequence").select(
        "file_path", "position", "line_number", "max_severity_score", "predicted_template", "prediction_prob", "max_z_score",
    )


def score_lines(
    logs: DataFrame, tree: context_tree.Fitted, tfidf: tfidf_seq.Fitted, path: str, checkpoint: str,
    idle: str | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Score a stream of parsed lines; the results appear once each below ``path/scores``."""
    found = carried_sequences(line_ids(logs, tree.vocab), tree.w, idle)
    return score_batches(found, lambda batch: {"scores": score_sequences(batch, tree, tfidf)}, path, checkpoint, available_now)
