"""New dates as they arrive: factor values of a stream of bars, from a table that holds the lookback before them.

The reference of a factor is its batch evaluation. A micro-batch is joined with the history that its lookback needs (the last
``lookback`` dates before it), evaluated by the same plan, and only its own dates are written, so a stream and a batch give the
same values for factors whose state ends with their lookback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..prep.panel import panel


def evaluate_stream(bars: DataFrame, history: Callable[[], DataFrame], engine: Engine, expression: str, fields: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a query that hands (code, date, value) of each micro-batch's dates to ``sink``.

    ``bars`` streams (code, date, fields); ``history`` gives the stored bars, read anew for each micro-batch. The sink must
    replace what it has for a batch id, as a failed micro-batch is run again.
    """
    compiled = engine.compile(expression)
    plan = engine.plan(compiled)

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        own = batch.select("date").distinct()
        first = own.agg(F.min("date")).first()[0]
        before = history().filter(F.col("date") < F.lit(first))
        reach = before.select("date").distinct().orderBy(F.desc("date")).limit(compiled.lookback)  # dates only
        rows = before.join(reach, "date", "left_semi").select("code", "date", *fields).unionByName(batch.select("code", "date", *fields))
        out = plan.results(panel(rows, fields)).join(own, "date", "left_semi")
        sink(out.select("code", "date", F.col(compiled.factor_id).alias("value")), number)

    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
