"""Small event builders."""

from datetime import datetime, timedelta, timezone

from nightjar.schema import EVENT_SCHEMA

START = datetime(2024, 3, 4, 9, 0, tzinfo=timezone.utc)


def event(seq, seconds=0.0, **fields):
    row = {f.name: None for f in EVENT_SCHEMA.fields}
    row |= {"event_id": f"evt_{seq:06x}", "tenant_id": "t", "timestamp": START + timedelta(seconds=seconds), "source": "windows", "event_type": "authentication",
            "action": "login_failure", "severity_hint": "info", "tags": [], "seq": seq}
    return row | fields


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT_SCHEMA.fields) for r in rows], EVENT_SCHEMA)
