import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumenspan import configure  # noqa: E402
from lumenspan import schema as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _text(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture(scope="session")
def make_spans(spark):
    def build(*rows):
        """Rows of (trace, span, parent, service, start, end) with optional keyword fields."""
        out = []
        for row in rows:
            *base, extra = row if isinstance(row[-1], dict) else (*row, {})
            trace, span, parent, service, start, end = base
            record = {
                "trace_id": trace, "span_id": span, "parent_span_id": parent, "service_name": service,
                "name": f"op-{span}", "kind": "server", "start_time_unix_nano": start, "end_time_unix_nano": end,
                "status_code": 0, "status_message": "", "attributes": {}, "resource_attributes": {},
                "events": [], "links": [], "scope_name": "", "scope_version": "", **extra,
            }
            record["duration_nanos"] = max(record["end_time_unix_nano"] - record["start_time_unix_nano"], 0)
            for key in ("attributes", "resource_attributes"):
                record[key] = _text(record[key])
            out.append(tuple(record[f.name] for f in S.SPANS.fields))
        return spark.createDataFrame(out, S.SPANS)

    return build


@pytest.fixture(scope="session")
def make_logs(spark):
    def build(*rows):
        out = []
        for row in rows:
            record = {
                "time_unix_nano": 0, "observed_time_unix_nano": 0, "severity_number": 9, "severity_text": "INFO",
                "body": "", "attributes": {}, "resource_attributes": {}, "service_name": "svc", "trace_id": "",
                "span_id": "", "scope_name": "", **row,
            }
            body = record["body"]
            record["body_json"] = _text(body)
            record["body"] = body if isinstance(body, str) else _text(body)
            for key in ("attributes", "resource_attributes"):
                record[key] = _text(record[key])
            out.append(tuple(record[f.name] for f in S.LOGS.fields))
        return spark.createDataFrame(out, S.LOGS)

    return build


@pytest.fixture(scope="session")
def make_points(spark):
    def build(*rows):
        out = []
        for row in rows:
            record = {
                "name": "m", "description": "", "unit": "1", "metric_type": "gauge", "service_name": "svc",
                "time_unix_nano": 0, "value": 0.0, "count": 0, "attributes": {}, "resource_attributes": {},
                "extra": {}, "exemplars": [], **row,
            }
            for key in ("attributes", "resource_attributes", "extra"):
                record[key] = _text(record[key])
            record["value"] = float(record["value"])
            out.append(tuple(record[f.name] for f in S.POINTS.fields))
        return spark.createDataFrame(out, S.POINTS)

    return build


@pytest.fixture(scope="session")
def holds():
    """Truth of many predicates on a one-row table, in one job."""

    def check(df, expected):
        columns = [p.alias(f"p{i}") for i, (p, _) in enumerate(expected)]
        row = df.select(*columns).first()
        wrong = [(i, str(p)[:120], row[i]) for i, (p, want) in enumerate(expected) if row[i] is not want]
        assert not wrong, wrong

    return check
