"""Log templates: mined from token positions, refined by similarity, numbered, looked up and resumed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import COMMON_MASKS, HOST_MASKS, SERVICE_MASKS, mask_tokens
from ..storage import stored
from .ranks import numbered

WILD = "<:*:>"
SEPARATOR = " "  # what tokens are split at, so none holds it
#: Characters of templates that a task sums up at a time
MOST_HELD = 1 << 24
#: Masks, delimiters and similarity of the two kinds of fleets.
SERVICE_PROFILE = {"masks": COMMON_MASKS + SERVICE_MASKS, "delimiters": ("_", "->", "|")}
HOST_PROFILE = {"masks": COMMON_MASKS + HOST_MASKS, "delimiters": ("_",)}
SIMILARITY = {"service": 0.3, "host": 0.2}


def tokenize(payload: Column, masks: list[tuple[str, str]] = COMMON_MASKS, delimiters: tuple[str, ...] = ("_",)) -> Column:
    """Tokens of a masked line, delimiters read as blanks."""
    text = mask_tokens(F.coalesce(payload, F.lit("")), masks)
    for d in delimiters:
        text = F.replace(text, F.lit(d), F.lit(" "))
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def leaf_key(tokens: Column, depth: int = 3) -> Column:
    """(size, token 1, token 2): the leaf that a line falls into; tokens with a digit are wildcards."""
    head = [F.coalesce(F.get(tokens, F.lit(i)), F.lit("")) for i in range(depth - 1)]
    return F.struct(F.size(tokens).cast("long").alias("size"), *(F.when(t.rlike("[0-9]"), WILD).otherwise(t).alias(f"t{i}") for i, t in enumerate(head)))


def leaves(lines: DataFrame, masks=COMMON_MASKS, delimiters=("_",), depth: int = 3, payload: str = "payload") -> DataFrame:
    """Add tokens and leaf; lines without a token go. Lines that have both already, kept from an earlier step, pass as they are."""
    if {"tokens", "leaf"} <= set(lines.columns):
        return lines
    one = F.explode(F.array(tokenize(F.col(payload), masks, delimiters)))  # so that a line is masked once, and not for the filter again
    return lines.select(*(c for c in lines.columns if c != "tokens"), one.alias("tokens")).where(F.size("tokens") > 0).withColumn("leaf", leaf_key(F.col("tokens"), depth))


def joined(tokens: Column | str) -> Column:
    """Tokens as one text, as they are shuffled: an array takes more than twice the bytes."""
    return F.array_join(tokens, SEPARATOR)


def distinct_lines(lines: DataFrame, order: str = "line_id", **how) -> DataFrame:
    """(leaf, tokens, n, first): equal token lines once, so mining works on shapes and not on traffic."""
    return distinct_texts(lines, order, **how).select("leaf", F.split("text", SEPARATOR).alias("tokens"), "n", "first")


def distinct_texts(lines: DataFrame, order: str = "line_id", **how) -> DataFrame:
    """(leaf, text, n, first): ``distinct_lines`` with joined tokens."""
    texts = leaves(lines, **how).select("leaf", joined("tokens").alias("text"), F.col(order).alias("_order"))
    return texts.groupBy("leaf", "text").agg(F.count("*").alias("n"), F.min("_order").alias("first"))


def _in_common(one: str, other: str) -> str:
    """Two texts of as many tokens: the token of each position that both have there, else a wildcard."""
    return one if one == other else SEPARATOR.join([a if a == b else WILD for a, b in zip(one.split(SEPARATOR), other.split(SEPARATOR))])


def agreed(rows: DataFrame, key: str) -> DataFrame:
    """(key, tokens, n, first) from (key, text, n, first): for each ``key``, a struct, the tokens that all its texts have in common, the sum of n, the least first.

    No built-in function sums up lists position by position before a shuffle, and a row for each token is many times the text. So each task
    sums up its own rows, and hands on one for each key; a key with most of the traffic is no hot group. It holds ``MOST_HELD`` characters at most and hands on what it has then.
    """
    rows = rows.select(key, "text", "n", "first")
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds = {}, 0, None

        def emptied() -> pa.RecordBatch:
            fields = [pa.array(c, f.type) for c, f in zip(zip(*held), kinds[0].type)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held.values()), kinds[1:])]
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(kinds[0].type)), *columns], schema=pa.schema(kinds))

        for batch in batches:
            kinds = list(batch.schema)
            for one, text, n, first in zip(zip(*(f.to_pylist() for f in batch.column(0).flatten())), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if (had := held.get(one)) is None:
                    held[one] = [text, n, first]
                    size += len(text)
                else:
                    had[:] = _in_common(had[0], text), had[1] + n, min((x for x in (had[2], first) if x is not None), default=None)
                if size > MOST_HELD:
                    yield emptied()
                    held, size = {}, 0
        if held:
            yield emptied()

    parts = rows.mapInArrow(run, schema).groupBy(key).agg(F.collect_list("text").alias("_texts"), F.sum("n").alias("n"), F.min("first").alias("first"))
    both = lambda a, b: F.zip_with(a, F.split(b, SEPARATOR), lambda x, y: F.when(x == y, x).otherwise(WILD))
    tokens = F.aggregate(F.slice("_texts", 2, F.greatest(F.size("_texts"), F.lit(1))), F.split(F.get("_texts", F.lit(0)), SEPARATOR), both)
    return parts.select(key, tokens.alias("tokens"), "n", "first")


def mine_templates(lines: DataFrame, order: str = "line_id", **how) -> DataFrame:
    """G1. (leaf, template, size, first): in each leaf a position keeps its token if all lines agree on it.

    The result does not depend on the order of lines; what a task's lines of a leaf agree on is one row before the shuffle, so a leaf with
    most of the traffic is no hot group.
    """
    return templates_of(leaves(lines, **how).select("leaf", joined("tokens").alias("text"), F.lit(1).cast("long").alias("n"), F.col(order).alias("first")))


def templates_of(texts: DataFrame) -> DataFrame:
    """G1 over lines of joined tokens (leaf, text, n, first)."""
    found = agreed(texts, "leaf")
    kept = F.transform("tokens", lambda t: F.when(t.rlike("^[0-9]+$"), WILD).otherwise(t))
    return found.select("leaf", kept.alias("template"), F.col("n").alias("size"), "first")


def greedy_clusters(shapes: list[tuple[str, int, object]], similarity: float) -> list[tuple[str, int, object]]:
    """Distinct token lines (text, n, first) of one leaf in first-seen order: each joins the likest template, or begins one.

    Tokens are numbers here, 0 a wildcard, so a line is compared with all templates at once.
    """
    if len(shapes) == 1:
        return shapes
    codes: dict[str, int] = {WILD: 0}
    lines = np.array([[codes.setdefault(t, len(codes)) for t in text.split(SEPARATOR)] for text, _, _ in shapes], np.int32)
    found, counts, firsts, size = np.empty_like(lines), [], [], lines.shape[1]
    for line, (_, n, first) in zip(lines, shapes):
        k = len(counts)
        if k:
            same = ((found[:k] == line) & (line > 0)).sum(1)
            best = int(same.argmax())  # the first of those that tie
            if same[best] / size >= similarity:
                found[best, found[best] != line] = 0
                counts[best] += n
                continue
        found[k] = line
        counts.append(n)
        firsts.append(first)
    names = list(codes)
    return [(SEPARATOR.join(names[c] for c in row), n, first) for row, n, first in zip(found[: len(counts)].tolist(), counts, firsts)]


def mine_greedy(lines: DataFrame, similarity: float = 0.3, order: str = "line_id", chunk: int = 5000, **how) -> DataFrame:
    """G2. (leaf, template, size, first): as G1, but a leaf is split into templates of at least ``similarity``.

    Only distinct masked token lines are clustered. A leaf of more than ``chunk`` of them is dealt out by a hash into
    chunks of about that size. Their templates are merged in rounds: those of a leaf stand in the order of their signature (which positions are
    constant, and the tokens there), neighbours are merged up to ``chunk`` at a time, and each round cuts at other places. It ends when a
    leaf's templates fit into one chunk, which is merged last, or when two rounds find nothing more to merge; so no group is ever larger than a
    chunk, whatever the similarity. Most leaves have a line or a few, so a task reads the groups of its sorted rows one after the other.
    """
    texts = distinct_texts(lines, order, **how)
    shapes = stored(texts.select(F.to_json("leaf").alias("key"), F.col("text").alias("tokens"), "n", "first"), "shapes")
    columns = ["key", "part", "tokens", "n", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((row, batch.schema) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out, size, schema = [], 0, None
        for (key, _), group in groupby(rows, lambda x: x[0][:2]):
            group = list(group)
            schema = pa.schema([f for f in group[0][1] if f.name != "part"])
            found = greedy_clusters([row[2:] for row, _ in group], similarity)
            out += [(key, *one) for one in found]
            size += sum(len(one[0]) for one in found)
            if size > MOST_HELD // 8:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def merge(dealt: DataFrame) -> DataFrame:
        sorted_ = dealt.select(*columns).repartition("key", "part").sortWithinPartitions("key", "part", "first", "tokens")
        return stored(sorted_.mapInArrow(run, shapes.schema), "templates")

    parts = shapes.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("parts")).where("parts > 1")
    large = stored(parts, "large")  # few, and known to be before the lines meet them
    # dealt by the hash of tokens joined by \x01, which decides what is merged with what
    found = merge(shapes.join(large, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.translate("tokens", SEPARATOR, "\x01")), F.col("parts")), F.lit(0).cast("long"))))
    open_, found = found.join(large, "key", "left_semi"), found.join(large, "key", "left_anti")
    before, idle, turn = None, 0, 0
    while idle < 2 and (now := open_.count()):
        idle = idle + 1 if now == before else 0
        small = open_.groupBy("key").count().where(F.col("count") <= chunk).select("key")
        found = found.unionByName(merge(open_.join(small, "key", "left_semi").withColumn("part", F.lit(0).cast("long"))))
        kinds = F.transform(F.split("tokens", SEPARATOR), lambda t: F.when(t == WILD, "1").otherwise("0"))
        placed = numbered(open_.join(small, "key", "left_anti").withColumn("_sign", F.array_join(kinds, "")), ("_sign", "tokens"), "_place", keys=("key",))
        shift = chunk // 2 if turn % 2 else 0
        open_ = merge(placed.withColumn("part", F.floor((F.col("_place") + shift) / chunk)))
        before, turn = now, turn + 1
    every = found.unionByName(open_)
    leaf = F.from_json("key", "struct<size:bigint,t0:string,t1:string>")
    return every.select(leaf.alias("leaf"), F.split("tokens", SEPARATOR).alias("template"), F.col("n").alias("size"), "first")


def assign_ids(templates: DataFrame, start: int = 1) -> DataFrame:
    """G3. Add template_id from ``start``, in the order in which templates were first seen, then by text.

    Templates are kept and shuffled as texts, and dealt out by the beginnings of these. One whose tokens a text cannot give back stays a list beside it.
    """
    back = F.split("_text", SEPARATOR)
    texts = templates.withColumn("_text", F.array_join("template", " "))
    texts = texts.withColumn("_list", F.when(back != F.col("template"), F.col("template"))).drop("template")
    ids = numbered(texts, ("first", "_text"), "template_id", start, dealt=("first", F.substring("_text", 1, 100)))
    return ids.withColumn("template", F.coalesce("_list", back)).select(*templates.columns, "template_id")


def matches(tokens: Column, template: Column) -> Column:
    """Whether a line fits a template of the same length: equal but at wildcards."""
    return F.forall(F.zip_with(tokens, template, lambda a, b: (a == b) | (b == WILD)), lambda x: x)


def match_templates(lines: DataFrame, templates: DataFrame, line: str = "line_id", **how) -> DataFrame:
    """C10. (line, template_id): each line's fitting template with the fewest wildcards, then the smallest id; null if none fits.

    Candidates share the leaf, so token counts agree. A leaf's templates stand in one row in that order, so a line is masked once,
    meets one row and takes the first that fits; Spark broadcasts the dictionary if it is small and splits hot leaves otherwise.
    """
    return _met(lines, templates, line, **how).select(line, "template_id")


def _met(lines: DataFrame, templates: DataFrame, line: str, **how) -> DataFrame:
    """(line, leaf, text, template_id) of C10. Texts are shuffled; a leaf's templates are split once, and a line once."""
    wild = F.size(F.filter("template", lambda t: t == WILD))
    rows = templates.select("leaf", F.struct(wild.alias("wild"), "template_id", joined("template").alias("text")).alias("one"))
    by_leaf = rows.groupBy("leaf").agg(F.array_sort(F.collect_list("one")).alias("candidates"))
    by_leaf = by_leaf.select("leaf", F.transform("candidates", lambda c: F.struct(c["template_id"].alias("template_id"), F.split(c["text"], SEPARATOR).alias("template"))).alias("candidates"))
    read = leaves(lines, **how).select(line, "leaf", joined("tokens").alias("text"))
    first = F.transform(F.array(F.split("text", SEPARATOR)), lambda tokens: F.get(F.filter("candidates", lambda c: matches(tokens, c["template"])), F.lit(0))["template_id"])
    return read.join(by_leaf, "leaf", "left").select(line, "leaf", "text", F.get(first, F.lit(0)).alias("template_id"))


def resume(lines: DataFrame, saved: DataFrame, line: str = "line_id", **how) -> DataFrame:
    """G4. The saved dictionary (leaf, template, template_id, ...) and, numbered after it, templates of lines that fit none."""
    saved = stored(saved.select("leaf", "template", "template_id"), "saved")
    fresh = _met(lines, saved, line, **how).where("template_id is null").select("leaf", "text", F.lit(1).cast("long").alias("n"), F.col(line).alias("first"))
    most = saved.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    new = assign_ids(templates_of(fresh), most + 1)
    return saved.unionByName(new.select("leaf", "template", "template_id"))


def versioned(dictionary: DataFrame) -> DataFrame:
    """G4. A dictionary (leaf, template, template_id) whose templates may change: all of version 1."""
    return dictionary.select("leaf", "template", "template_id", F.lit(1).cast("long").alias("version"))


def resume_versions(lines: DataFrame, saved: DataFrame, similarity: float = 0.3, line: str = "line_id", **how) -> tuple[DataFrame, DataFrame]:
    """G4. Continue with a versioned dictionary: the new one (leaf, template, template_id, version) and what changed, as (template_id, version, template).

    A line that fits no saved template but shares at least ``similarity`` of its tokens with one of its leaf generalises the likest (the smallest id
    of those that tie): where such lines differ from it, it gets a wildcard and its next version, and keeps its id. All lines
    count against the saved templates at once, so their order does not matter. Lines that are like none give new templates, numbered after the
    saved ones. Lines that fit change nothing, so resuming twice with the same lines is the same as once.
    """
    saved = stored(saved.select("leaf", "template", "template_id", "version"), "saved")
    one = F.struct("template_id", joined("template").alias("text"))
    by_leaf = saved.groupBy("leaf").agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # a leaf's templates, not its lines
    by_leaf = by_leaf.select("leaf", F.transform("candidates", lambda c: F.struct(c["template_id"].alias("template_id"), F.split(c["text"], SEPARATOR).alias("template"))).alias("candidates"))
    same = lambda tokens, c: F.size(F.filter(F.zip_with(tokens, c["template"], lambda a, b: (a == b) & (b != WILD)), lambda x: x)) / F.size(tokens)
    likest = lambda tokens: F.array_max(F.transform("candidates", lambda c: F.struct(same(tokens, c).alias("score"), (-c["template_id"]).alias("order"))))
    fits = lambda tokens: F.coalesce(F.exists("candidates", lambda c: matches(tokens, c["template"])), F.lit(False))
    found = F.explode(F.transform(F.array(F.split("text", SEPARATOR)), lambda tokens: F.when(~fits(tokens), F.struct(likest(tokens).alias("best")))))
    met = distinct_texts(lines, line, **how).join(by_leaf, "leaf", "left").select("leaf", "text", "n", "first", found.alias("found")).where("found is not null")
    met = stored(met.select("leaf", "text", "n", "first", "found.best.score", F.expr("-found.best.order").alias("template_id")), "unmatched")
    near = agreed(met.where(F.col("score") >= similarity).withColumn("of", F.struct("template_id")), "of").select("of.template_id", "tokens")
    changed = F.when(F.col("tokens").isNotNull(), F.zip_with("template", "tokens", lambda a, b: F.when(a == b, a).otherwise(WILD)))
    both = saved.join(near, "template_id", "left").select("leaf", "template", "template_id", "version", changed.alias("now"))
    kept_rows = both.select("leaf", F.coalesce("now", "template").alias("template"), "template_id", (F.col("version") + F.col("now").isNotNull().cast("long")).alias("version"))
    far = met.where(F.coalesce(F.col("score") < similarity, F.lit(True)))
    most = saved.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    fresh = versioned(assign_ids(templates_of(far), most + 1))
    after = stored(kept_rows.unionByName(fresh), "dictionary")
    log = after.join(saved.select("template_id", F.col("version").alias("_was")), "template_id", "left").where("_was is null or version > _was").select("template_id", "version", "template")
    return after, log
