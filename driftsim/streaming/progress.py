"""What Spark itself reports of each trigger of a stream."""

import time

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Collects the times of every trigger of the query ``name`` that handled a batch.

    ``found`` has for each epoch its input rows and Spark's times by name, in milliseconds:
    the trigger as a whole, asking the source, the batch itself, and both commits.
    """

    def __init__(self, name: str):
        self.name, self.found = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name and "addBatch" in progress.durationMs:
            self.found[progress.batchId] = (progress.numInputRows, dict(progress.durationMs))

    def onQueryTerminated(self, event) -> None:
        pass

    def wait_for(self, epochs: set[int], seconds: float = 10.0) -> None:
        """Reports come a little later than what they report."""
        end = time.time() + seconds
        while not epochs <= set(self.found) and time.time() < end:
            time.sleep(0.02)

    def rows(self) -> list[tuple]:
        """(epoch, rows, times) of every trigger, in order."""
        return [(epoch, *self.found[epoch]) for epoch in sorted(self.found)]
