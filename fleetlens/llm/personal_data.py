"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern, a validator and a prior score. A proposal that its validator refuses is dropped, and
what it covered is not tried again. Words in the ``BEFORE`` characters ahead of a span raise or lower its score. Spans of
the base kinds (email, ip, card, phone) are found whatever their score; the method's own kinds need a score of ``LEAST`` at least:

- ``iban``: an international account number of its country's length whose remainder by 97 is 1,
- ``ssn``: three, two and four digits of a valid range, named by a word before them,
- ``local_phone``: three, three and four digits without a country's number, named by a word before them.

Their matches are leftmost and non-overlapping too, and dropped if they are part of a longer run of such characters.

Every pattern is read in time proportional to the text: runs are consumed whole (possessively), whether or not they
lead to a match, which finds the same leftmost matches as trying at every character, since a run's later characters
lead to the same end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points before a span in which words speak for or against it, and the least score of the method's own kinds
BEFORE, LEAST = 40, 0.5
RAISED, LOWERED = 0.3, 0.2


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    """Whether the digits' weighted sum, every second from the right doubled, ends in 0."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = (ord(c) - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def valid_card(text: str) -> bool:
    number = digits(text)
    return 14 <= len(number) <= 19 and luhn(number)


def valid_phone(text: str) -> bool:
    return 10 <= len(digits(text)) <= 15


def valid_iban(text: str) -> bool:
    """The country and check digits moved to the end, letters as 10 to 35: 1 modulo 97."""
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def valid_ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


#: Characters of account numbers in the countries with most of them. Fixed values of the international standard.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_IBAN = "|".join(f"{country}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{{{n - 4}}}}}" for country, n in IBAN_LENGTHS.items()).replace("{{", "{").replace("}}", "}")


class Kind(NamedTuple):
    name: str
    #: A cheap necessary test, then the pattern that reads runs whole, and what tells a match from a run without one
    needs: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    prior: float
    #: Words (parts of them, in small letters) that speak for the kind and against it
    favour: str
    against: str
    base: bool
    #: Characters that may not stand right before or after a span
    joined: str = ""


#: In the order in which kinds that begin at the same place are listed
KINDS = (
    Kind("email", "@", re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"), lambda _: True, 0.8, "mail|contact|write", "example|noreply", True),
    Kind("ip", ".", re.compile(r"[0-9]++((?:\.[0-9]++){3})?"), valid_ip, 0.5, "address|host|server|client|ip", "version|release|section", True),
    Kind("card", "", re.compile(r"[0-9]((?:[\x20-]?[0-9])++)?"), valid_card, 0.6, "card|visa|master|credit|debit|payment", "order|isbn|tracking|serial", True),
    Kind("phone", "+", re.compile(r"(\+[0-9][\x20().0-9-]+[0-9])"), valid_phone, 0.6, "phone|call|tel|mobile|fax", "score|offset", True),
    Kind("iban", "", re.compile(f"({_IBAN})"), valid_iban, 0.7, "iban|account|bank|transfer", "serial|part", False, "[A-Za-z0-9]"),
    Kind("ssn", "-", re.compile(r"([0-9]{3}-[0-9]{2}-[0-9]{4})"), valid_ssn, 0.3, "ssn|social security|taxpayer", "order|part|serial", False, "[0-9-]"),
    Kind("local_phone", "", re.compile(r"(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4})"), lambda _: True, 0.3, "phone|call|tel|mobile|fax", "order|isbn|tracking|serial", False, "[0-9()+-]"),
)
CONTEXT = {k.name: (re.compile(k.favour), re.compile(k.against)) for k in KINDS}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def score(kind: Kind, text: str, start: int) -> float:
    """The prior of the kind, more if words before the span speak for it, less if others speak against it."""
    before = text[max(0, start - BEFORE) : start].translate(LOWER)
    favour, against = CONTEXT[kind.name]
    return round(kind.prior + RAISED * bool(favour.search(before)) - LOWERED * bool(against.search(before)), 6)


class Covered:
    """Where base spans lie; ``kinds`` list them first."""

    def __init__(self, ranges: list[tuple[int, int]]):
        ranges = sorted(ranges)
        self.starts = [a for a, _ in ranges]
        self.reach = list(accumulate((z for _, z in ranges), max))

    def meets(self, start: int, end: int) -> bool:
        ahead = bisect_left(self.starts, end)
        return ahead > 0 and self.reach[ahead - 1] > start


def spans(text: str, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> list[dict]:
    """All spans of a text, by start and then in the order of the kinds."""
    out, has_digit, covered = [], any(c in text for c in "0123456789"), None
    for rank, kind in enumerate(kinds):
        if kind.needs not in text or not (has_digit or kind.name == "email"):
            continue
        for m in kind.pattern.finditer(text):
            if m[1] is None or not kind.valid(m[0]):
                continue
            start, end, certainty = m.start(), m.end(), score(kind, text, m.start())
            if not kind.base:
                covered = covered or Covered([(x["start"], x["end"]) for _, _, x in out if x["base"]])
                if certainty < least or covered.meets(start, end) or re.match(kind.joined, text[start - 1 : start]) or re.match(kind.joined, text[end : end + 1]):
                    continue
            out.append((start, rank, {"kind": kind.name, "start": start, "end": end, "score": min(1.0, max(0.0, certainty)), "base": kind.base}))
    return [one for _, _, one in sorted(out, key=lambda x: x[:2])]


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: (kind, start, end, score, base) of each span of personal data, in code points, the end exclusive.

    Spans stand in the order of their starts, those that tie in that of ``KINDS``. A null or empty text has none. Each row is read by
    itself, its whole text however long, so repeated rows get equal spans; a column named ``out`` is replaced and
    all others pass. An empty table stays empty.
    """
    field = T.StructField(out, SPAN)
    return common.with_batch_columns(docs, text, [field], lambda: lambda texts: [pa.array([spans(t or "") for t in texts.to_pylist()], _SPAN)])


def redact(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(k.name for k in KINDS)) -> DataFrame:
    """``docs`` with each span of the ``kinds`` in ``text`` replaced by its kind in angle brackets; spans that overlap become one, named by the first.

    Null texts stay null. Other columns pass as they are.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([None if t is None else "".join(_redacted(t, kinds)) for t in texts.to_pylist()], pa.string())]

    columns = docs.columns
    return common.with_batch_columns(docs, text, [T.StructField("_clean", T.StringType())], lambda: run).drop(text).withColumnRenamed("_clean", text).select(*[F.col(f"`{c}`") for c in columns])


def _redacted(text: str, kinds: tuple[str, ...]) -> Iterator[str]:
    at = 0
    for one in spans(text):
        if one["kind"] in kinds:
            if one["start"] >= at:
                yield text[at : one["start"]]
                yield f"<{one['kind']}>"
            at = max(at, one["end"])
    yield text[at:]


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, score) from ``find_spans``; score is that of the surest span, 0 without any."""
    line = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    surest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), surest.alias("score"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_spans(docs).select("doc_id", "spans"))


def oracle() -> str:
    """The same in SQL: the pieces between matches give their places."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    sum_of = lambda n: f"list_sum(list_transform(range(length({n})), lambda i: (ascii({n}[length({n}) - i]) - 48) * (1 + i % 2) - CASE WHEN i % 2 = 1 AND ascii({n}[length({n}) - i]) > 52 THEN 9 ELSE 0 END))"
    moved = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])"
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"length({number}) BETWEEN 14 AND 19 AND {sum_of(number)} % 10 = 0", "phone": f"length({number}) BETWEEN 10 AND 15",
        "iban": f"list_reduce(list_transform(range(1, length({moved}) + 1), lambda i: CAST(ascii({moved}[i]) AS BIGINT)), lambda a, c: CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97, CAST(0 AS BIGINT)) = 1",
        "ssn": "m[:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'", "local_phone": "true",
    }
    parts, kept = [], []
    for rank, kind in enumerate(KINDS):
        pattern = (patterns.get(kind.name) or kind.pattern.pattern).replace("'", "''")
        parts.append(f"""m{rank} AS (SELECT k, text, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_transform(range(len(string_split_regex(text, '{pattern}')) - 1), lambda i:
  list_sum(list_transform(string_split_regex(text, '{pattern}')[:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{pattern}')[:i], lambda x: length(x))), 0))) AS s FROM docs),
s{rank} AS (SELECT k, '{kind.name}' AS kind, {rank} AS rank, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, {str(kind.base).lower()} AS base,
  round({kind.prior} + CASE WHEN regexp_matches(before, '{kind.favour}') THEN {RAISED} ELSE 0 END - CASE WHEN regexp_matches(before, '{kind.against}') THEN {LOWERED} ELSE 0 END, 6) AS score
  FROM (SELECT *, translate(substr(text, CAST(greatest(s - {BEFORE}, 0) + 1 AS BIGINT), CAST(least(s, {BEFORE}) AS BIGINT)), '{UPPER}', '{UPPER.lower()}') AS before FROM m{rank})
  WHERE {valid[kind.name]}{f" AND NOT regexp_matches(substr(text, CAST(s AS BIGINT), 1), '^{kind.joined}') AND NOT regexp_matches(substr(text, CAST(s + length(m) AS BIGINT) + 1, 1), '^{kind.joined}')" if kind.joined else ''})""")
        kept.append(f"SELECT * FROM s{rank}" if kind.base else f"SELECT * FROM s{rank} x WHERE score >= {LEAST} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = x.k AND b.s < x.e AND x.s < b.e)")
    base = " UNION ALL ".join(f"SELECT * FROM s{rank}" for rank, kind in enumerate(KINDS) if kind.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    return f"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), {', '.join(parts)},
base AS ({base}), every AS ({' UNION ALL '.join(kept)}),
found AS (SELECT k, {counts}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base), '') AS base_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, max(least(1, greatest(0, score))) AS score FROM every GROUP BY k)
SELECT doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in KINDS if k.base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (k)"""
