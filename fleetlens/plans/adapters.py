"""The star-schema tables seen as telemetry: one SQL text for Spark and DuckDB.

``MS(x)`` stands for milliseconds of a timestamp and ``STAMP(x)`` for its log-header form; each dialect
replaces them by its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LEVEL = "case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' when 'click' then 'INFO' when 'view' then 'DEBUG' else '{other}' end"
_FAULT = "case cast(user_id % 3 as int) when 0 then 'cpu_anomalies' when 1 then 'memory_anomalies' else 'login failure' end"

ADAPTERS = {
    "log_lines": f"select event_id line_id, MS(ts) ts_ms, 'svc'||(user_id%10) service, {_LEVEL.format(other='UNKNOWN')} level, event_type||' user '||user_id||' value '||value||' '||props payload from events",
    "raw_messages": f"select event_id line_id, 'svc'||(user_id%10) service, STAMP(ts)||' | '||{_LEVEL.format(other='TRACE')}||' | 10.0.0.'||(user_id%250)||' | '||event_type||' user '||user_id||' '||props message from events",
    "metric_points": "select event_id, MS(ts) ts_ms, 'svc'||(user_id%10) service, event_type feature, value from events",
    "spans": (
        "select trace_id, span_id, parent_id, service_name, status_code, MS(st) start_ms, MS(en) end_ms, l_partkey, l_suppkey, l_extendedprice from ("
        "select l_orderkey trace_id, cast(l_linenumber as bigint) span_id, cast(l_linenumber-1 as bigint) parent_id, 'svc'||(l_suppkey%10) service_name, l_returnflag||l_linestatus status_code, "
        "least(o_orderdate,l_shipdate) st, greatest(o_orderdate,l_shipdate) en, l_partkey, l_suppkey, l_extendedprice from lineitem join orders on l_orderkey=o_orderkey) q0"
    ),
    "span_chain": "select conv_id trace_id, turn span_id, turn-1 parent_id, role service_name, 0 start_ms, 0 end_ms, 'OK' status_code from conversations",
    "label_events": f"select event_id idx, 'svc'||(user_id%10) service, '['||{_FAULT}||']' anomaly_type, MS(ts) st_ms, MS(ts) + cast(floor(value) as bigint)*1000 ed_ms from events where event_type='error'",
    "conversations_": "select conv_id, turn, role from conversations",
    "scored": "select l.doc_id window_id, 'svc'||(l.doc_id%10) service, l.toxic y, (d.n_chars%997)/cast(997 as double) p_cls, cast(d.n_chars as double) energy from labels l join documents d on l.doc_id=d.doc_id",
    "doc_lines": "select doc_id, source service, lang level, text payload from documents",
    "service_host": "select distinct 'svc'||(user_id%10) service, '10.0.0.'||(user_id%4) ip from events where user_id%10 = user_id%20",
    "faults": (
        f"select event_id idx, 'svc'||(user_id%10) service, STAMP(ts)||' | '||{_LEVEL.format(other='WARNING')}||' | svc | '||case cast(user_id % 7 as int) "
        "when 0 then '[memory_anomalies] start at '||replace(STAMP(ts), ',', '.')||' and lasts '||(user_id%900)||' seconds' "
        "when 1 then '[cpu_anomalies] start at '||replace(STAMP(ts), ',', '.')||' and lasts '||(user_id%500)||' seconds' "
        "when 2 then '[normal memory freed label]' when 3 then 'login failure, wait for '||(user_id%30)||' seconds' "
        "when 4 then 'file moving program start with '||replace(STAMP(ts), ',', '.')||' and last for '||(user_id%60)||' seconds' "
        "when 5 then 'access permission denied exception lasts '||(user_id%99)||' seconds' else 'something else' end message from events"
    ),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _replace(sql: str, ms: str, stamp: str) -> str:
    sql = re.sub(r"MS\((\w+)\)", lambda m: ms.format(m[1]), sql)
    return re.sub(r"STAMP\((\w+)\)", lambda m: stamp.format(m[1]), sql)


def spark_sql(name: str) -> str:
    return _replace(ADAPTERS[name], "unix_millis(cast({} as timestamp))", "date_format({},'yyyy-MM-dd HH:mm:ss,SSS')")


def duck_sql(name: str) -> str:
    return _replace(ADAPTERS[name], "(epoch_us({})//1000)", "strftime({},'%Y-%m-%d %H:%M:%S,%g')")


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter ``name`` over the tables in ``sf_dir``, lazily."""
    sql = spark_sql(name)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_adapters(sql: str) -> str:
    """DuckDB SQL with the adapters that it names in front, as common table expressions."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]
    parts = ", ".join(f"{n} AS ({duck_sql(n)})" for n in used)
    if not parts:
        return sql
    return f"WITH {parts}, {sql.lstrip()[5:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {parts} {sql}"
