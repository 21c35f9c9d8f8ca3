"""The forensic view of the test table ``events``: a deterministic event for each row.

`forensic_view` and `VIEW_SQL` say the same in Spark and in DuckDB. Columns that the
view does not derive are null in the full model (`full_events`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.plans.session import table
from casebook.schema import EVENT_COLUMNS

DERIVED = {
    "event_id": "event_id",
    "raw_event_id": "event_id div 10",
    "event_type": "event_type",
    "severity": "severity",
    "occurred_at": "occurred_at",
    "observed_at": "occurred_at + interval '1' second * k",
    "received_at": "occurred_at + interval '1' second * (k * 60)",
    "actor_id": "case when user_id % 17 = 0 then '   ' when user_id % 5 = 0 then concat(' user-', user_id, ' ') else concat('user-', user_id) end",
    "actor_name": "case when user_id % 3 = 0 then cast(null as varchar(40)) else concat('User ', user_id) end",
    "src_ip": "case when k % 7 = 0 then cast(null as varchar(40)) else concat('10.0.', user_id % 8, '.', k % 16) end",
    "dst_ip": "case when k % 4 = 0 then concat('192.168.0.', k % 5) when k % 11 = 0 then concat('10.0.', user_id % 8, '.', k % 16) else cast(null as varchar(40)) end",
    "device_id": "case when raw_type = 'click' then cast(null as varchar(40)) else concat('dev-', user_id % 40) end",
    "hostname": "case when k % 3 = 0 then concat('host-', k % 12) else '' end",
    "source_id": "concat('src-', event_id % 4)",
    "source_type": "case when event_id % 4 < 2 then 'idp' else 'app' end",
    "tags": "split(concat(raw_type, case when value > 100 then ',hot' else '' end, case when k % 2 = 0 then ',even' else '' end), ',')",
    "custom_fields": """case when k % 5 = 0 then concat('{"session_id": ', k, '}')
        when k % 5 = 1 then concat('{"session": "sess-', user_id, '"}')
        when k % 5 = 2 then concat('{"session_id": "sess-', user_id, '", "access_token": "tok-', k, '"}')
        else '{}' end""",
}
BASE = {
    "event_id": "event_id",
    "occurred_at": "ts",
    "user_id": "user_id",
    "raw_type": "event_type",
    "value": "value",
    "k": "cast(regexp_extract(props, '[0-9]+', 0) as int)",
    "event_type": """case event_type when 'signup' then 'auth.login' when 'view' then 'file.access' when 'purchase' then 'data.export'
        when 'error' then case when cast(regexp_extract(props, '[0-9]+', 0) as int) % 2 = 0 then 'auth.login_failed' else 'error.app' end
        else case when cast(regexp_extract(props, '[0-9]+', 0) as int) % 10 = 0 then 'deploy.release' else 'ui.click' end end""",
    "severity": """cast(case when value > 200 then 4 when event_type = 'error' then 3 when event_type = 'purchase' then 2
        when event_type = 'signup' then 1 else 0 end as int)""",
}


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{v} as {k}" for k, v in columns.items()]


#: DuckDB: a WITH list that defines ``ev``.
VIEW_SQL = f"ev as (select {', '.join(_list(DERIVED)).replace(' div ', ' // ')} from (select {', '.join(_list(BASE))} from events) b)"


def forensic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_list(BASE)).selectExpr(*_list(DERIVED))


def full_events(view: DataFrame) -> DataFrame:
    """All columns of the event model; those that ``view`` lacks are null."""
    return view.select(*(F.col(c) if c in view.columns else F.lit(None).cast(kind).alias(c) for c, kind in EVENT_COLUMNS.items()))
