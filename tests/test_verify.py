import random

import pytest
from barspark.operators import context

CASES = [  # claim, source, found
    ("11", "11.49999999", True), ("12", "11.49999999", False), ("1,234.50", "1234.5", True), ("1234.5", "1,234.50", True), ("0.123456789", "0.1234567891", True),
    ("0.123456788", "0.1234567891", False), ("1234567890123456789012345.1234567890", "1,234,567,890,123,456,789,012,345.12", True),
    ("1234567890123456789012345.1234567890", "7", False), ("2.67", "2.675", True), ("2.68", "2.675", False), ("-5", "-5.4", True), ("-5", "5", False),
    ("2026-01-05", "2026-01-05", True), ("2026-01-05", "2026", False), ("2026", "2026-01-05", False), ("0.5", "0.50000000000000000000000001", True), ("1" * 60, "1" * 60 + ".0", True),
]


def alike(a, b):
    """The definition, by Python's own number texts."""
    dated = ["-" in t[1:] for t in (a, b)]
    if any(dated):
        return all(dated) and a == b
    x, y = (t.replace(",", "") for t in (a, b))
    decimals = {len(t.partition(".")[2]) for t in (x, y)}
    return any(f"{float(x):.{d}f}" == f"{float(y):.{d}f}" for d in decimals)


def test_cases(spark):
    claims = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CASES)], "k int, token string")
    sources = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(CASES)], "k int, token string")
    got = {r.k: r.found for r in context.judged(claims, sources, ["k"]).collect()}
    assert got == {i: f for i, (_, _, f) in enumerate(CASES)} == {i: alike(c, s) for i, (c, s, _) in enumerate(CASES)}


def test_random_numbers_agree_with_the_definition(spark):
    rng = random.Random(4)
    number = lambda: f"{rng.choice(['', '-'])}{rng.choice([rng.randrange(30), rng.randrange(10**9), 999999])}" + rng.choice(["", f".{rng.randrange(10 ** rng.randrange(1, 14))}", ".5", ".25"])
    base = [number() for _ in range(60)]
    near = lambda t: f"{float(t):.{rng.randrange(0, 9)}f}" if rng.random() < 0.7 else number()
    claims, sources = [(i % 5, near(rng.choice(base))) for i in range(300)], [(i % 5, near(rng.choice(base))) for i in range(200)]
    got = context.judged(spark.createDataFrame(claims, "k int, token string"), spark.createDataFrame(sources, "k int, token string"), ["k"]).collect()
    small = lambda t: "." not in t and 1 <= int(t) <= 10
    want = sorted((k, t, any(alike(t, s) for j, s in sources if j == k)) for k, t in claims if not small(t))
    assert sorted((r.k, r.token, r.found) for r in got) == want and 20 < sum(f for *_, f in want) < len(want) - 20


def test_missing_have_field_and_place_and_rates(spark):
    report = [("r", "technical", "It closed at 6,810 and 7.5 on 2026-01-05, day 3."), ("r", "summary", "5 of 10, 99.4 then 99.4"), ("n", "summary", "nothing"), (None, "summary", "42")]
    claims = context.tokens(spark.createDataFrame(report, "id string, field string, text string"))
    sources = context.tokens(spark.createDataFrame([("r", "7.49 and 6810.0; 2026-01-04", 1), (None, "42.1", 1), ("q", None, 1)], "id string, text string, found int"))
    gone = context.missing(claims, sources, ["id"]).collect()
    assert sorted((r.field, r.place, r.token, r.number, r.text[:7]) for r in gone) == [
        ("summary", 2, "99.4", "99.4", "5 of 10"), ("summary", 3, "99.4", "99.4", "5 of 10"), ("technical", 2, "2026-01-05", "2026-01-05", "It clos"),
    ]
    assert sorted(((r.id or ""), r.checked, r.found, r.rate) for r in context.verify(claims, sources, ["id"]).collect()) == [("", 1, 1, 1.0), ("r", 5, 2, pytest.approx(0.4))]
    assert context.judged(claims.limit(0), sources, ["id"]).count() == 0 and context.verify(claims, sources.limit(0), ["id"]).agg({"found": "sum"}).first()[0] == 0
