"""Conversations as a stream: every row is scrubbed before anyone reads it, and withheld if that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import State, cut
from ..operators.scrub import scrub

WITHHELD = "[shroud: content withheld because scrubbing failed]"
# Where a row comes from. Responses and notices are not read again; what a person typed passes while the engine is down.
SKIPPED = ("response", "notice")
TYPED = ("prompt", "command")
SAFE_ATTACHMENTS = (
    "skill_listing", "deferred_tools_delta", "todo_reminder", "auto_mode", "auto_mode_exit", "plan_mode", "plan_mode_exit",
    "critical_system_reminder", "output_style",
)


def scrub_batch(rows: DataFrame, column: str, key: list[str], state: State, door: str | None = None, attachment: str | None = None, ready: bool = True) -> DataFrame:
    """One batch, fail-closed: rows that need no scrubbing pass, the others are scrubbed, or withheld when anything fails.

    ``door``, ``attachment``: columns that tell where a row comes from. ``ready``: whether the engine is known to work.
    """
    passes = F.lit(False)
    if door:
        passes = passes | F.coalesce(F.col(door).isin(*SKIPPED), F.lit(False))
    if attachment:
        passes = passes | F.coalesce(F.col(attachment).isin(*SAFE_ATTACHMENTS), F.lit(False))
    passes = passes | F.coalesce(~F.col(column).rlike(r"(?U)\S"), F.lit(True))
    if not ready and door:
        passes = passes | F.coalesce(F.col(door).isin(*TYPED), F.lit(False))
    free = rows.where(passes).withColumns({"hits": F.lit(0), "withheld": F.lit(False)})
    bound = rows.where(~passes)
    try:
        if not ready:
            raise RuntimeError("the engine is not ready")
        done = cut(scrub(bound, column, key, state)).withColumn("withheld", F.lit(False))
    except Exception:  # whatever it is: nothing that was not scrubbed may pass
        done = bound.withColumns({column: F.lit(WITHHELD), "hits": F.lit(0), "withheld": F.lit(True)})
    return free.unionByName(done.select(free.columns))


def scrub_stream(stream: DataFrame, column: str, key: list[str], state: State, sink: Callable[[DataFrame, int], None], checkpoint: str, door: str | None = None, once: bool = True, attachment: str | None = None, ready: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """Scrub a stream batch by batch; numbering has one writer, so batches follow one another.

    ``door``, ``attachment``: as for a batch. ``ready`` is asked before each batch. ``sink`` gets each scrubbed batch and its number, and should write so that a repeated batch does no harm.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(scrub_batch(cut(batch), column, key, state, door, attachment, ready()), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, over what an earlier attempt left there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
