"""Metric series queries."""

from lumenspan.operators import metrics
from lumenspan.registry.base import WITH_POINTS, joined, points_of, query, rounded

NAME = "purchase"
_SERIES = f"series AS (SELECT service_name, attributes, time_unix_nano, value FROM points WHERE name = '{NAME}')"
_WITH_SERIES = f"{WITH_POINTS}, {_SERIES}"
_COLUMNS = "service_name, attributes, time_unix_nano"

# 2024-01-05 00:00 .. 2024-01-25 00:00 UTC
WINDOW = (1_704_412_800_000_000_000, 1_706_140_800_000_000_000)


def _series(spark, sf_dir, **selection):
    return metrics.metric_series(points_of(spark, sf_dir), NAME, **selection)


def _rounded(series):
    return series.withColumn("value", rounded("value", 9))


@query(
    "metric_catalog",
    f"""{WITH_POINTS} SELECT name, min(description) AS description, min(unit) AS unit, min(metric_type) AS metric_type,
    array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM points GROUP BY name""",
)
def metric_catalog(spark, sf_dir):
    return metrics.list_metrics(points_of(spark, sf_dir)).withColumn("services", joined("services"))


@query(
    "metric_series",
    f"""{_WITH_SERIES} SELECT {_COLUMNS}, value FROM series WHERE service_name = 'svc-1'
    AND time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]}""",
)
def metric_series(spark, sf_dir):
    return _series(spark, sf_dir, service="svc-1", time_min=WINDOW[0], time_max=WINDOW[1])


_STRIDED = """strided AS (SELECT service_name, attributes, time_unix_nano, value FROM (SELECT *,
  row_number() OVER (PARTITION BY service_name, attributes ORDER BY time_unix_nano, value) - 1 AS i,
  CAST(ceil(CAST(count(*) OVER (PARTITION BY service_name, attributes) AS DOUBLE) / {}) AS BIGINT) AS stride FROM series)
  WHERE i % stride = 0)"""


@query("downsample", f"{_WITH_SERIES}, {_STRIDED.format(40)} SELECT * FROM strided")
def downsample(spark, sf_dir):
    return metrics.downsample(_series(spark, sf_dir), 40)


def _steps(source: str, expression: str, name: str = "stepped") -> str:
    return f"""{name} AS (SELECT service_name, attributes, time_unix_nano, {expression} AS value FROM (SELECT *,
  lag(value) OVER w AS before, lag(time_unix_nano) OVER w AS since FROM {source}
  WINDOW w AS (PARTITION BY service_name, attributes ORDER BY time_unix_nano, value)) WHERE time_unix_nano > since)"""


_RATE = "CASE WHEN value < before THEN value ELSE value - before END / (CAST(time_unix_nano - since AS DOUBLE) / 1e9)"
_INCREASE = "CASE WHEN value < before THEN 0 ELSE value - before END"


@query("rate", f"{_WITH_SERIES}, {_steps('series', _RATE)} SELECT {_COLUMNS}, round(value, 9) AS value FROM stepped")
def rate(spark, sf_dir):
    return _rounded(metrics.rate(_series(spark, sf_dir)))


@query("increase", f"{_WITH_SERIES}, {_steps('series', _INCREASE)} SELECT {_COLUMNS}, round(value, 9) AS value FROM stepped")
def increase(spark, sf_dir):
    return _rounded(metrics.increase(_series(spark, sf_dir)))


def _folded(source: str, function: str, buckets: int = 120, of: str = "series") -> str:
    return f"""ends AS (SELECT min(time_unix_nano) AS lo,
  greatest((greatest(max(time_unix_nano), min(time_unix_nano) + 1) - min(time_unix_nano)) // {buckets}, 1) AS width FROM {source}),
means AS (SELECT least((time_unix_nano - lo) // width, {buckets} - 1) AS slot, service_name, attributes, avg(value) AS value
  FROM {source}, ends GROUP BY ALL)
SELECT '{function}' AS service_name, '{{"aggregation":"{function}","series":'
    || (SELECT count(*) FROM (SELECT DISTINCT service_name, attributes FROM {of})) || '}}' AS attributes,
  CAST(lo + slot * width + width // 2 AS BIGINT) AS time_unix_nano, round({function}(value), 9) AS value
FROM means, ends GROUP BY slot, lo, width"""


def _aggregate_query(function: str) -> None:
    @query(f"series_{function}", f"{_WITH_SERIES}, {_folded('series', function)}")
    def aggregate(spark, sf_dir):
        return _rounded(metrics.aggregate_series(_series(spark, sf_dir), function))


for _function in ("sum", "avg", "min", "max"):
    _aggregate_query(_function)


@query(
    "metric_query",
    f"{_WITH_SERIES}, {_STRIDED.format(100)}, {_steps('strided', _RATE)}, {_folded('stepped', 'sum')}",
)
def metric_query(spark, sf_dir):
    return _rounded(metrics.metric_query(points_of(spark, sf_dir), NAME, "rate", "sum", max_points=100))


@query(
    "series_stats",
    f"""{_WITH_SERIES} SELECT service_name, attributes, count(*) AS points,
    arg_min(value, (time_unix_nano, value)) AS first_value, arg_max(value, (time_unix_nano, value)) AS last_value,
    min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value,
    max(time_unix_nano) AS latest_unix_nano FROM series GROUP BY service_name, attributes""",
)
def series_stats(spark, sf_dir):
    return metrics.series_stats(_series(spark, sf_dir)).withColumn("avg_value", rounded("avg_value"))


@query(
    "exemplars",
    f"""{WITH_POINTS} SELECT name AS metric_name, service_name, metric_type, unit, exemplar_trace AS trace_id,
    exemplar_trace AS span_id, time_unix_nano, value FROM points WHERE exemplar_trace = '9'
    ORDER BY time_unix_nano DESC, metric_name, service_name, span_id, value LIMIT 50""",
)
def exemplars(spark, sf_dir):
    return metrics.find_exemplars(points_of(spark, sf_dir), " 9 ")
