"""The registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources import events_panel
from . import analytics, evaluation, language, market, pool, similarity, streams  # noqa: F401 (modules register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the five-row mean against the day before, over the events panel."""
    value = c.cs_rank(c.divide(c.ts_mean("close", 5), c.delay("close", 1)) - 1)
    return events_panel(spark, sf_dir).select("datetime", "instrument", F.round(value, 6).alias("v"))


QUERIES = {"flagship": flagship, **language.QUERIES, **analytics.QUERIES}
ORACLE_SQL = {
    "flagship": f"""WITH {language.PANEL_SQL}, {language.STEP},
x AS (SELECT datetime, instrument, CASE WHEN count(close) {language.rows(5)} >= 5 THEN avg(close) {language.rows(5)} END / nullif(prev, 0) - 1 AS e FROM r)
SELECT datetime, instrument, round(CASE WHEN e IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY e ASC NULLS LAST) + (count(*) OVER (PARTITION BY datetime, e) - 1) / 2.0) / count(e) OVER (PARTITION BY datetime) END, 6) AS v FROM x""",
    **language.ORACLE_SQL,
    **analytics.ORACLE_SQL,
}
