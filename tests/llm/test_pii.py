"""What op1 adds to the base spans: rewritten forms of each kind, and clean text that must stay as it is."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lattica.llm import pii

PROSE = "the river was low that year and the boats stood on the sand while people walked across".split()


def luhn_digits(rnd, n):
    body = [rnd.randint(0, 9) for _ in range(n - 1)]
    total = sum(x if i % 2 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(body)))
    return "".join(map(str, [*body, -total % 10]))


def planted(rnd):
    say, name = lambda: " ".join(rnd.choice(PROSE) for _ in range(6)), lambda: rnd.choice(["maria", "j.smith", "tom_b", "info", "li.wei88"])
    host = lambda: rnd.choice(["example", "mail-server", "uni", "acme"])
    for at, dot in ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" AT ", " DOT ")):
        yield "email", f"{say()}, write to {name()}{at}{host()}{dot}{rnd.choice(['com', 'org', 'net'])} {say()}"
    for point in ("[.]", "(.)", "[dot]", " [.] "):
        yield "ip", f"{say()} host {point.join(str(rnd.randint(1, 255)) for _ in range(4))} {say()}"
    for gap in (".", "/", " - ", "_"):
        d = luhn_digits(rnd, 16)
        yield "card", f"{say()} card {gap.join(d[i : i + 4] for i in (0, 4, 8, 12))} {say()}"
    a, b, c = rnd.randint(200, 999), rnd.randint(200, 999), rnd.randint(1000, 9999)
    for form in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0049 {a} {b} {c}", f"1-{a}-{b}-{c}"):
        yield "phone", f"{say()}, call {form} {say()}"


def clean(rnd):
    say, n = lambda: " ".join(rnd.choice(PROSE) for _ in range(8)), lambda k: str(rnd.randint(10 ** (k - 1), 10**k - 1))
    yield from (f"{say()} {x} {say()}" for x in (f"on 2023-{n(2)[:1]}1-12", f"order {n(9)}", f"version {n(1)}.{n(2)}.{n(1)}", f"arrived at station.Then", f"page {n(4)}", f"{n(3)},{n(3)} of them", f"see at index.html", f"pp. {n(3)}-{n(3)}", f"for {n(2)}.{n(2)}", "at noon", f"ISBN 978-3-16-{n(6)}-0", f"in 19{n(2)}-20{n(2)}", f"12/05/20{n(2)} 10:{n(2)}"))  # noqa: F541


@pytest.fixture(scope="module")
def models(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(PROSE) + rnd.choice(["", ",", ".", f" {rnd.randint(1, 10**6)}"]) for _ in range(60))) for i in range(200)]
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def found(spark, models, texts):
    df = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), models)
    return {r.doc_id: r.added for r in df.select("doc_id", "added").collect()}


def test_each_kind_is_added(spark, models):
    rnd = random.Random(4)
    rows = [x for _ in range(40) for x in planted(rnd)]
    got = found(spark, models, [t for _, t in rows])
    for kind in pii.KINDS:
        own = [i for i, (k, _) in enumerate(rows) if k == kind]
        assert sum(any(s.kind == kind for s in got[i]) for i in own) >= 0.9 * len(own), kind
    assert sum(s.kind == rows[i][0] for i, spans in got.items() for s in spans) >= 0.9 * sum(map(len, got.values()))


def test_clean_text_stays(spark, models):
    rnd = random.Random(8)
    rows = [t for _ in range(60) for t in clean(rnd)]
    got = found(spark, models, rows)
    assert sum(map(bool, got.values())) <= 0.02 * len(rows)


def test_redacted_and_clashing_columns(spark, models):
    text = "call (357) 555-2937 now, a.b@c.org 4111 1111 1111 1111 end " + chr(0xE005) + " x"
    df = spark.createDataFrame([(1, text, 5, "k"), (2, None, 6, "k")], "doc_id long, text string, added int, b_email string")
    got = {r.doc_id: r for r in pii.redacted(df, models).collect()}
    assert got[1].text == "call <phone> now, <email> <card> end " + chr(0xFFFD) + " x"
    assert got[2].text is None and (got[1].added, got[2].b_email) == (5, "k")


def test_long_texts_are_linear(spark, models):
    def seconds(n):
        text = " ".join(f"a{i}@b.com at {i} dot c{i} at d dot com" for i in range(n))
        df = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), models).select(F.size("b_email").alias("n"), F.size("added").alias("m"))
        began = time.time()
        row = df.first()
        assert row.n == n and row.m > 0.8 * n
        return time.time() - began

    seconds(500)
    assert seconds(32_000) < 4 * seconds(8_000) + 8


def test_fit_sees_every_document(spark):
    """Each of 9,000 documents proposes a number; all are examples."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('lot ', id, ' of (555) 123-', lpad(id, 4, '0'), ' went') AS text")
    assert pii.examples(docs, synthetic=8).filter("kind = 'phone' AND label = 0").count() >= 9000
