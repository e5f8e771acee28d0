"""Row-wise operators: time, log headers, fault events, token masks, feature names, numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordered masks (name, Java pattern, replacement).
COMMON_MASKS = [
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "<:ID:>"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "<:IP:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "<:HEX:>"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "<:NUM:>"),
]
#: Further masks of the service profile, and of the host profile.
SERVICE_MASKS = [
    (r"(?<=http://)([\S]+)", "<:URL:>"),
    (r"(?<=uuid=)([\S]+?)(?=&)", "<:UUID:>"),
    (r"(?<=user_id=)([\S]+)", "<:USERID:>"),
    (r"(?<=user_name=')([^']+)", "<:USERNAME:>"),
    (r"(?<=query = )(.+)", "<:QUERY:>"),
]
HOST_MASKS = [(r'(?<=executed cmd )(".+?")', "<:CMD:>")]
#: Masks that any regular-expression engine has, for engines without lookaround.
PLAIN_MASKS = [(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "<:IP:>"), (r"0x[0-9a-fA-F]+", "<:HEX:>"), (r"[0-9]+", "<:NUM:>")]
#: Keywords that choose how duplicate samples of a metric are reduced.
MAX_KEYWORDS = ("max", "peak", "highest", "watermark")
SUM_KEYWORDS = (
    "network", "bytes", "packets", "dropped", "errors", "fault", "ops", "operations", "request", "requests", "sectors", "switches",
    "total_", "_total", "count", "connections",
)
#: The levels that log lines name.
LEVELS = ("WARNING", "ERROR", "INFO", "DEBUG")


def epoch_ms(ts: Column, zone: str = "Asia/Shanghai", offset_s: int = 0) -> Column:
    """B1, B1b. Milliseconds since the epoch of a zone-local timestamp (text or timestamp), less ``offset_s``.

    Text that is no timestamp, and null, give null. The session's zone must be UTC.
    """
    return F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(ts.cast("string")), zone)) - offset_s * 1000


def bucket(ts: Column, step: int = 30_000) -> Column:
    """B2. The grid cell at or before ``ts``, also before the epoch."""
    return ts - F.pmod(ts, F.lit(step))


def time_range(df: DataFrame, ts: str, low: int, high: int, slack: int = 0) -> DataFrame:
    """B3. Rows from ``low`` to ``high``, both included, the end ``slack`` later. Null times go."""
    return df.where(F.col(ts).between(low, high + slack))


def parse_log_header(df: DataFrame, message: str = "message", zone: str = "UTC") -> DataFrame:
    """B4. Add ts_ms, level and payload. Rows without a leading timestamp have a null ts_ms (see ``split_rejects``)."""
    text = F.trim(F.col(message))
    header = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),(\d{3})"
    stamp = F.nullif(F.regexp_replace(F.regexp_extract(text, header, 1), r"\s+", " "), F.lit(""))
    level = F.regexp_extract(text, rf"\|\s*({'|'.join(LEVELS)})\s*\|", 1)
    payload = F.when(F.contains(text, F.lit("|")), F.trim(F.split_part(text, F.lit("|"), F.lit(-1)))).otherwise(text)
    ts = F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(stamp), zone)) + F.regexp_extract(text, header, 2).try_cast("long")
    return df.withColumns({"ts_ms": ts, "level": F.when(level == "", "UNKNOWN").otherwise(level), "payload": payload})


def split_rejects(df: DataFrame, ts: str = "ts_ms") -> tuple[DataFrame, DataFrame]:
    """B4. Parsed rows, and the rows to quarantine."""
    return df.where(F.col(ts).isNotNull()), df.where(F.col(ts).isNull())


def classify_fault(df: DataFrame, message: str = "message", zone: str = "UTC") -> DataFrame:
    """B5. Add level, anomaly_type, st_ms, ed_ms and duration_s by the ordered rules of fault messages.

    Memory, CPU and file events that state no start or no length have no end, and so never reach a grid.
    A null message is of unknown type.
    """
    text = F.trim(F.coalesce(F.col(message), F.lit("")))
    zoned = lambda stamp: F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(F.nullif(F.regexp_replace(stamp, r"\s+", " "), F.lit(""))), zone))
    stamp, header = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),(\d{3})"
    seconds = lambda words: F.regexp_extract(text, rf"{words} (\d+) seconds", 1).try_cast("long")
    kind = F.regexp_extract(text, rf"\|\s*({'|'.join(LEVELS)})\s*\|", 1)
    head = zoned(F.regexp_extract(text, header, 1))
    head_ms = head + F.regexp_extract(text, header, 2).try_cast("long")
    start_at, start_with = zoned(F.regexp_extract(text, f"start at {stamp}", 1)), zoned(F.regexp_extract(text, f"start with {stamp}", 1))
    lasts = F.regexp_extract(text, r"lasts\s+(\d+)\s+seconds", 1).try_cast("long")
    has = lambda words: (kind == "WARNING") & F.contains(text, F.lit(words))
    none, zero, some = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1)
    # The levels, phrases, types and default lengths of fault messages, in the order in which they are tried.
    # test, type, start, length; the last says whether a length of 0 leaves the end open
    rules = [
        (kind == "INFO", "normal", none, zero, False),
        (kind == "ERROR", "error_event", head, zero, False),
        (has("[memory_anomalies]"), "memory_anomalies", start_at, lasts, True),
        (has("[cpu_anomalies]"), "cpu_anomalies", start_at, lasts, True),
        (has("[normal memory freed label]"), "normal memory freed label", head_ms, 600 * some, False),
        (has("login failure"), "login failure", head_ms, F.coalesce(seconds("wait for"), 11 * some), False),
        (has("file moving program"), "file moving program", start_with, seconds("last for"), True),
        (has("access permission denied exception"), "access permission denied exception", head_ms, F.when(F.contains(text, F.lit("an hour")), 3600).otherwise(F.coalesce(lasts, 3600 * some)), False),
        (kind == "WARNING", "unknown_warning", head_ms, zero, False),
    ]
    # Each test runs once: the first that holds gives the rule's number, and the rest follows from that
    number = F.lit(len(rules))
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(rule[0], i).otherwise(number)

    def of_rule(value: int, otherwise: Column) -> Column:
        for i, rule in enumerate(rules):
            otherwise = F.when(F.col("_rule") == i, rule[value]).otherwise(otherwise)
        return otherwise

    ruled = df.withColumn("_rule", number)
    ruled = ruled.withColumns({"level": F.when(kind == "", "UNKNOWN").otherwise(kind), "anomaly_type": F.concat(F.lit("["), of_rule(1, F.lit("unknown")), F.lit("]")), "st_ms": of_rule(2, none), "duration_s": F.coalesce(of_rule(3, zero), zero).cast("long")})
    open_end = F.col("_rule").isin([i for i, rule in enumerate(rules) if rule[4]]) & (F.col("duration_s") == 0)
    return ruled.withColumn("ed_ms", F.when(~open_end, F.col("st_ms") + F.col("duration_s") * 1000)).drop("_rule")


def strip_suffix(df: DataFrame, col: str, n: int) -> DataFrame:
    """B6. Drop the last ``n`` characters; shorter text becomes empty."""
    return df.withColumn(col, F.left(F.col(col), F.greatest(F.length(col) - n, F.lit(0))))


def mask_tokens(col: Column, masks: list[tuple[str, str]] = COMMON_MASKS) -> Column:
    """B7. Replace by each mask in turn."""
    for pattern, name in masks:
        col = F.regexp_replace(col, pattern, name)
    return col


def reduce_mode(feature: Column) -> Column:
    """B8. How equal timestamps of a metric are reduced: max, sum or mean."""
    name = F.lower(feature)
    any_of = lambda words: name.rlike("|".join(words))
    return F.when(any_of(MAX_KEYWORDS), "max").when(any_of(SUM_KEYWORDS), "sum").otherwise("mean")


def canonical_feature(feature: Column, marker: str = "docker_cpu_core_") -> Column:
    """B9. One name for all cores of a per-core metric."""
    return F.when(F.contains(feature, F.lit(marker)), F.regexp_replace(feature, r"core_\d+", "core_X")).otherwise(feature)


def finite(value: Column) -> Column:
    """B10. A double, or null where the value is no number, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def duration_s(start_ms: Column, end_ms: Column) -> Column:
    """B11. Seconds from start to end."""
    return (end_ms - start_ms) / F.lit(1000.0)


def one_hot(label: Column, n: int) -> Column:
    """B12. array<int> of ``n`` with a 1 at the label; all 0 for a null label."""
    return F.array(*(F.coalesce((label == i).cast("int"), F.lit(0)) for i in range(n)))


def only_entities(df: DataFrame, col: str, entities: list[str]) -> DataFrame:
    """B13. Rows of the listed entities."""
    return df.where(F.col(col).isin(*entities)) if entities else df.limit(0)


def first_k_features(df: DataFrame, entity: str, feature: str, k: int) -> DataFrame:
    """B14. The first ``k`` features of each entity in name order; ranks run over the distinct names alone."""
    from pyspark.sql import Window

    names = df.select(entity, feature).distinct()
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(feature))
    return df.join(names.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"), [entity, feature], "left_semi")


def fit_vector(vector: Column, n: int, fill: float = 0.0) -> Column:
    """B15. A vector of exactly ``n`` entries, cut or filled."""
    return F.slice(F.concat(F.coalesce(vector, F.array().cast("array<double>")), F.array_repeat(F.lit(fill), n)), 1, n)


def sentinel_to_null(col: Column, sentinel: str = "wrong") -> Column:
    """B16. Null in place of the sentinel."""
    return F.nullif(col, F.lit(sentinel))
