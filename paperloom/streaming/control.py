"""Running queries that can be cancelled, with signs of life on the way."""

from __future__ import annotations

from collections.abc import Callable


def run_until_cancelled(query, cancelled: Callable[[], bool], beat: Callable[[int], None] | None = None, every: float = 0.5) -> bool:
    """Waits for a streaming query; true if it ran to its end, false if ``cancelled`` stopped it.

    ``beat`` is told the rows that the recent batches have read, at the start and every ``every`` seconds.  What a stopped
    query has committed stays, and its checkpoint lets another run go on from there.
    """
    while True:
        if beat:
            beat(sum(p["numInputRows"] or 0 for p in query.recentProgress))
        if cancelled():
            query.stop()
            return False
        if query.awaitTermination(every):
            return True


def progress_text(processed: int, total: int, seconds: float) -> tuple[str, int]:
    """What to show while work goes on: a line with the time left, if over five seconds, and a percentage of 10 to 90."""
    left = seconds / max(1, processed) * (total - processed)
    eta = f" ~{int(left)}s left" if left > 5 else ""
    return f"Processing {processed}/{total} (working...){eta}", 10 + int(80 * processed / max(1, total))
