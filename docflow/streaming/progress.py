"""What streams do, as log lines."""

from __future__ import annotations

import logging

from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


class ProgressLog(StreamingQueryListener):
    """One line for the start of a stream, each of its batches, and its end; errors as errors.

    Add it with ``spark.streams.addListener``; where the lines go is the logger's business.
    """

    def __init__(self, log: logging.Logger | None = None) -> None:
        self.log = log or logging.getLogger("docflow.streaming")

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self.log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        self.log.info("stream %s batch %d: %d rows", p.name or p.id, p.batchId, p.numInputRows)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        self.log.debug("stream %s idle", event.id)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if event.exception:
            self.log.error("stream %s failed: %s", event.id, event.exception)
        else:
            self.log.info("stream %s ended", event.id)
