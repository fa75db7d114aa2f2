"""coffer: ledger and inventory analytics for team economies, on Spark.

Read queries are DataFrame operators over all teams and users at once
(``coffer.operators``); write handlers become batch jobs that fold request
logs into new state tables (``coffer.plans``) or Structured Streaming jobs
(``coffer.streaming``). Inputs are the eight logical tables described in
``coffer.schemas``; ``coffer.sources`` maps the driver's test tables onto them.
"""

from coffer.sources.tables import Tables

__all__ = ["Tables"]
