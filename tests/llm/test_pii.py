import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from luminal.llm import pii

TEXTS = [
    "card 4111 1111 1111 1111 and 4111111111111111 x", "iban DE89 3704 0044 0532 0130 00. GB82WEST12345698765432", "call +1 (017) 555-7713 or (555) 123-4567",
    "ip 192.168.0.255 999.1.1.1", "on 2024-02-29, 29.02.2024 and 2023-02-30", "ssn 123-45-6789 000-12-3456", "mail a.user34@mail7.example.com!", "7536784127813050 4845168114407329", None, "",
    "no digits", 'token = "908038b7daaf91e730d2f64001c52934d43d9336" 1234567890123456', "4111111111111111" * 1 + " end " * 3000 + "4111111111111111",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_formats_links_and_back(spark):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again")], "doc_id long, text string, _t string")
    out = pii.pseudonymise(df, "k")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(TEXTS) + 1
    one, two = rows[0].text[5:24], rows[0].text[29:45]
    assert one.replace(" ", "") == two != "4111111111111111" and luhn(two) and one[4] == " "
    assert rows[12].text.count(two) == 2 and rows[12].n_values == 2
    assert rows[1].text[5:7] == "DE" and rows[1].text[-22:-20] == "GB" and "3704" not in rows[1].text
    assert rows[3].text.endswith("999.1.1.1") and rows[3].n_values == 1
    a, b = rows[4].text[3:13], rows[4].text[15:25]
    assert a.split("-") == b.split(".")[::-1] and rows[4].text.endswith("2023-02-30")
    assert rows[5].text.endswith("000-12-3456") and rows[6].text.endswith("@mail7.example.com!") and "user34" not in rows[6].text
    assert rows[8].text is None and rows[9].text == "" and rows[10].text == TEXTS[10] and rows[11].text == TEXTS[11]
    back = {r.doc_id: r.text for r in pii.pseudonymise(out.select("doc_id", "text"), "k", restore=True).collect()}
    assert back == dict(enumerate(TEXTS))
    assert {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}[0] != rows[0].text
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_permutations_are_one_to_one(spark):
    n = pii.DAYS[0] * pii.DAYS[1]
    d = spark.range(n).select(F.col("id"), pii.permute_number(F.col("id"), pii.DAYS, "k", "date").alias("y"))
    r = d.agg(F.count_distinct("y"), F.min("y"), F.max("y")).first()
    assert tuple(r) == (n, 0, n - 1)
    s = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(pii.permute_characters(F.col("s"), "k", "x").alias("p"))
    assert s.distinct().count() == 1000
    back = d.limit(50).select("id", pii.permute_number(F.col("y"), pii.DAYS, "k", "date", restore=True).alias("b"))
    assert back.filter("id <> b").count() == 0


def test_a_key_is_needed_and_no_plan_shows_it(spark, capsys):
    df = spark.createDataFrame([(1, "ip 10.0.0.1")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")
    pii.pseudonymise(df, "hush-hush").explain("extended")
    assert "hush-hush" not in capsys.readouterr().out


def test_long_texts_of_every_kind(spark):
    """A megabyte that each pattern could repeat over."""
    n = 200_000
    texts = ["x a@" + "b." * n, "a@b" + ".c" * n, "a." * n + "@b.c", "a@" * n, "AB12" + " ABCD" * n, "+1" + " (22)" * n, "1." * n, "1" * n, "1234 " * n, "12/" * n, "2024-01-" * n, "9-" * n, "mail a1@x.org " * (n // 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert all(len(out[i].text) == len(t) for i, t in enumerate(texts) if i != 12)
    assert out[1].n_values == 1 and out[12].n_candidates == out[12].n_values == n // 4
    back = pii.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in out.items()], "doc_id long, text string"), "k", restore=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def feistel(value, key, kind, size):
    """A number below size[0] * size[1], pseudonymised in plain Python."""
    a, b = divmod(value, size[1])
    for r in range(pii.ROUNDS):
        drawn = int(hashlib.sha256(f"{key}/{kind}/{r}/{b}".encode()).hexdigest()[:12], 16)
        a, b = b, (a + drawn) % (size[0] if r % 2 == 0 else size[1])
    return a * size[1] + b


def test_numbers_as_in_plain_python(spark):
    def ip(x):
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def ssn(x):
        area, rest = divmod(x, 99 * 9999)
        return f"{area + (2 if area >= 665 else 1):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"

    def day(x):
        return (datetime.date(2000, 1, 1) + datetime.timedelta(days=x)).isoformat()

    rows, want = [], []
    for i in range(60):
        a, s, d = i * 71_000_003 % (1 << 32), i * 14_000_029 % (898 * 99 * 9999), i * 2_411 % (pii.DAYS[0] * pii.DAYS[1])
        rows.append((i, f"at {ip(a)} id {ssn(s)} on {day(d)}"))
        want.append(f"at {ip(feistel(a, 'k', 'ip', (1 << 16, 1 << 16)))} id {ssn(feistel(s, 'k', 'ssn', pii.SSNS))} on {day(feistel(d, 'k', 'date', pii.DAYS))}")
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.text for r in got] == want
