"""How streaming queries are triggered.

Restarts are Spark's: a query started again with its checkpoint goes on where it stopped.
"""

from __future__ import annotations


def every(seconds: float) -> dict[str, str]:
    """Trigger of a polled query."""
    return {"processingTime": f"{seconds} seconds"}


def drain(writer, trigger: dict | None = None) -> None:
    """Process everything available and stop."""
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
