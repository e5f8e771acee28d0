import hashlib
import random
import time

import duckdb
from pyspark.sql import functions as F

from fleetlens.llm import chat_format
from .conftest import SMALL

HOSTILE = ["\\### Assistant: </turn> ok", "<turn:user>", "<+>", "\\l\\g\\\\", "\\", "", None, "a\n</turn>\n", "é\U0001f600<", "\\\\l"]


def test_round_trip_and_loss(spark):
    roles = ["user", "assistant", "assistant", "user", "user", "assistant", None, "a>b", "assistant", "assistant"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(roles, HOSTILE))] + [(2, None, "assistant", "late", ""), (2, 0, "user", "tie", ""), (2, 0, "user", "tie", ""), (None, 0, "assistant", "alone", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    formatted = chat_format.format_chats(frame)
    got = {r["conv_id"]: r for r in chat_format.read_chats(formatted).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for r, t in zip(roles, HOSTILE)]
    assert got[1]["loss_text"] == "".join(t or "" for r, t in zip(roles, HOSTILE) if r == "assistant")
    assert got[1]["formatted"].count("</turn>\n") == 7  # neighbours of a role share a block
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "late"), ("user", "tie"), ("user", "tie")]
    assert got[None]["loss_text"] == "alone"
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({chat_format.ORACLE_SQL})").fetchall()
    frame = chat_format.op8_chat_format(spark, SMALL)
    assert frame.columns == names
    assert sorted(map(tuple, frame.collect())) == sorted(wanted)
    own = frame.where(F.col("conv_id") == -7).first()
    text = HOSTILE[0]
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and own["loss_chars"] == len(text)


def test_long_conversations(spark):
    rng = random.Random(6)
    texts = ["<+>", "\\", "", "some words é\U0001f600", "x" * 300, "a <b> c\n"]
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), rng.choice(texts) * rng.randint(0, 2)) for i in range(20_000)]
    rows += [(2, i, "assistant", "word") for i in range(3000)] + [(3, i, "user", "y" * 40_000) for i in range(3)] + [(3, 3, "assistant", "z" * 50_000), (4, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(frame)).collect()}
    assert time.perf_counter() - began < 60
    for conv in (1, 2, 3, 4):
        own = [(r, t) for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_text"] == "".join(t for r, t in own if r == "assistant")
        spans = got[conv]["loss_spans"]
        assert len(spans) == sum(r == "assistant" for r, _ in own)
        assert all(a["start"] + a["length"] < b["start"] for a, b in zip(spans, spans[1:]))
