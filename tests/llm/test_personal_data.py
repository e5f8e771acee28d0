import random
import re
import time
from hashlib import sha256

import pytest

from fleetlens.llm import personal_data as pd_
from .conftest import EDGES

#: The base kinds as they are agreed, tried at every character
AGREED = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
PIECES = ["1", "23", "456", "@", "a", ".", "-", " ", "+", "(", ")", "x.y", "@b.c", "255", "1.2.3.4", "4539 1488 0343 6467", "é", "\n", "_", "%", "GB82 WEST 1234 5698 7654 32", "123-45-6789", " SSN ", " call 555-123-4567"]
TEXTS = EDGES + [
    "mail a.b+c@d-e.example.org, not a@b", "a@b.c._x@d.e", "256.1.1.1 1.2.3.4.5 01.002.3.4 9" + "." + "1" * 5000 + ".1.1", "card 4539-1488-0343-6467 and 4539148803436468", "+1 (729) 555-7725 +1234 +12345678901234567",
    "\U0001f600 é x@y.zz", "1" * 30, "4" * 16, "0" * 16, "10.0.0.1 release 10.0.0.1",
]


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


def agreed(text):
    out = []
    for rank, (kind, pattern) in enumerate(AGREED):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".") if len(p) < 4000) and max(map(len, m[0].split("."))) < 4000, "card": lambda: 14 <= len(n) <= 19 and luhn(n), "phone": lambda: 10 <= len(n) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{a}:{z}" for a, _, kind, z in sorted(out)]


def listed(text, base_only=True):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in pd_.spans(text or "") if s["base"] or not base_only]


def test_base_kinds_at_the_edges_and_at_random():
    draw = random.Random(3)
    for text in TEXTS + ["".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 14))) for _ in range(20_000)]:
        assert listed(text) == agreed(text), text


def test_query_rows(spark):
    frame = spark.createDataFrame([(i, t, "taken", 1) for i, t in enumerate(TEXTS + ["same a@b.cd", "same a@b.cd"])], "doc_id long, text string, spans string, score int")
    found = pd_.find_spans(frame)
    assert found.columns == ["doc_id", "text", "score", "spans"]
    for row, text in zip(pd_.digest(found).orderBy("doc_id").collect(), TEXTS + ["same a@b.cd"] * 2):
        base = agreed(text)
        assert row["base_sha256"] == sha256(",".join(base).encode()).hexdigest() and row["spans"] == ",".join(listed(text, False))
        assert [row[f"n_{k}"] for k, _ in AGREED] == [sum(s.startswith(k + ":") for s in base) for k, _ in AGREED]
        assert (row["score"] > 0) == bool(row["spans"])
    assert pd_.digest(pd_.find_spans(frame.where("false"))).count() == 0


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("account GB82 WEST 1234 5698 7654 32 AND MORE", ["iban:8:35"]), ("GB83 WEST 1234 5698 7654 32", []), ("XGB82WEST12345698765432", []), ("NO9386011117947", ["iban:0:15"]),
        ("her SSN is 123-45-6789.", ["ssn:11:22"]), ("part 123-45-6789", []), ("ssn 000-45-6789 666-45-6789 923-45-6789 123-00-6789 123-45-0000 1123-45-6789", []),
        ("call (555) 123-4567", ["local_phone:5:19"]), ("(555) 123-4567", []), ("order of the phone 555-123-4567", []),
    ],
)
def test_kinds_of_the_method(text, wanted):
    assert [s for s in listed(text, False) if s.split(":")[0] not in dict(AGREED)] == wanted


def test_words_nearby_adjust_the_score():
    score = lambda text: pd_.spans(text)[0]["score"]
    assert score("pay by card 4539 1488 0343 6467") > score("4539 1488 0343 6467") > score("serial 4539 1488 0343 6467")
    assert score("card" + " " * 40 + "4539148803436467") == score("4539148803436467")


def test_what_base_spans_cover_is_theirs():
    found = pd_.spans("phone +1 555-123-4567 tel 5551234567")
    assert [s["kind"] for s in found] == ["phone"]


def test_redacted_texts(spark):
    rows = [(1, "write to a@b.cd or 10.0.0.1!"), (2, None), (3, ""), (4, "clean"), (5, "+4539148803436467 x")]
    clean = {r["doc_id"]: r["text"] for r in pd_.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == {1: "write to <email> or <ip>!", 2: None, 3: "", 4: "clean", 5: "+<card> x"}


@pytest.mark.parametrize("unit", ["x", "1", "1.", "a@", "+1", "1 ", "GB29 ", "A1", "123-45-", "(123", "call 555-123-4567 a@b.c "])
def test_long_runs_take_time_in_proportion(unit):
    began = time.process_time()
    pd_.spans(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 20
