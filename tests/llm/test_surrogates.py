import re

import duckdb
import pytest
from pyspark.sql import functions as F

from draftsmith.llm import entries
from draftsmith.llm import surrogates as G
from tests.llm.helpers import PROSE, docs_frame, long_text

TEXT = (
    "Mr. John Smith (john.smith-7@Mail.example.com) called +1 (437) 555-0689 from 10.20.30.40; "
    "Mrs. Mary Smith paid with 4539578763621486 or 4539 5787 6362 1486, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\". "
    "Herr MÜLLER, г-н Иванов, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 and 437-555-0689."
)
PLAIN = "Version 3.0 of 46370890 rows in 2024-05-06 at 12:30, price 1,234.56, ids 12345678 and 1.2.3, a@b, Mrs. and Mr. alone, x1y2z3."


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10


def replaced(spark, rows, **kw):
    return {r.doc_id: r for r in G.replace_entities(docs_frame(spark, rows), **kw).collect()}


def test_kinds_keep_their_format(spark):
    got = replaced(spark, [(1, TEXT)])[1].text
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+) \(([\w.-]+@[\w.]+\.com)\) called (\+1 \(\d{3}\) \d{3}-\d{4}) from (\d+\.\d+\.\d+\.\d+); "
        r"Mrs\. (\w+) (\w+) paid with (\d{16}) or (\d{4} \d{4} \d{4} \d{4}), token = \"([0-9a-f]{40})\"\. "
        r"Herr (\w+), г-н (\w+), SSN (\d{3}-\d{2}-\d{4}), IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (\d{3}-\d{3}-\d{4})\.",
        got,
    )
    assert m, got
    john, smith, mail, phone, ip, mary, smith2, card, card2, token, mueller, ivanov, ssn, iban, phone2 = m.groups()
    assert smith == smith2 and smith not in ("Smith",) and john != "John" and mary.endswith("a")
    assert mueller.isupper() and re.fullmatch("[А-Яа-я]+", ivanov)
    assert card == card2.replace(" ", "") and card[0] == "4" and (luhn(card) % 10 == 0) == (luhn("4539578763621486") % 10 == 0)
    assert not set(re.findall(r"[\w.@-]{6,}", TEXT)) & {mail, phone, ip, card, token, ssn, phone2}


def test_plain_text_stays(spark):
    rows = [(1, PLAIN), (2, PROSE), (3, None), (4, "")]
    got = replaced(spark, rows)
    assert all(got[d].text == t and got[d].n_entities == 0 for d, t in rows)


def test_coreference_and_distinctness_over_documents(spark):
    rows = [(i, f"write to user{i % 50}@host.example.org or +1 (200) 555-{i % 50:04d}, ip 9.8.7.{i % 50} card 40000000000{i % 50:05d}") for i in range(200)]
    got = replaced(spark, rows)
    pat = re.compile(r"write to (\S+) or (.*), ip (\S+) card (\d+)")
    seen = [{} for _ in range(4)]
    for i in range(200):
        for k, v in enumerate(pat.fullmatch(got[i].text).groups()):
            assert seen[k].setdefault(i % 50, v) == v
    assert all(len(set(s.values())) == 50 for s in seen)
    assert got[0].text != replaced(spark, rows[:1], key="another")[0].text


def test_collisions_draw_again(spark, monkeypatch):
    monkeypatch.setattr(G, "_draw", lambda attempt, key: F.concat(F.col("type"), F.lit("-"), F.when(F.lit(attempt) == 0, F.lit("0")).otherwise(F.concat(F.lit(f"{attempt}-"), F.when(F.col("unit") == "c", "x").otherwise(F.col("unit"))))))
    units = spark.createDataFrame([("t", u) for u in ("a", "b", "c", "d", "t-1-d")], "type string, unit string")
    got = {r.unit: r.surrogate for r in G.surrogate_table(units).collect()}
    assert len(set(got.values())) == 5 and not set(got.values()) & set(got)
    assert got["a"] == "t-0" and got["b"] == "t-1-b" and got["d"] == "t-2-d"  # t-1-d is a unit itself


def test_crowded_formats_get_distinct_surrogates(spark):
    """More addresses than half of their shape, and a kind with ten values."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.de" for a in letters for b in letters]
    rows = [(i, f"mail {m} or {m.upper()} now") for i, m in enumerate(mails)]
    got = replaced(spark, rows)
    seen = {}
    for i, m in enumerate(mails):
        one, two = re.fullmatch(r"mail (\S+@\S+\.de) or (\S+@\S+\.DE) now", got[i].text).groups()
        assert one.upper() == two and one not in mails
        seen[m] = one
    assert len(set(seen.values())) == 676
    units = spark.createDataFrame([("ssn", str(d)) for d in range(10)] + [("ip", "1.2.3.4")], "type string, unit string")
    table = {r.unit: r.surrogate for r in G.surrogate_table(units).collect()}
    assert len(set(table.values())) == 11 and not set(table.values()) & set(table)
    shown = spark.createDataFrame([("123-45", "123459"), ("123-45", "12345")], "e string, s string")
    shown = shown.select(G._render(F.col("e"), F.lit("ssn"), F.array("s")).alias("r")).collect()
    assert [r.r for r in shown] == ["123-459", "123-45"]


def test_draws_that_never_differ_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(G, "_draw", lambda attempt, key: F.lit("same"))
    monkeypatch.setattr(G, "_ROUNDS", 3)
    with pytest.raises(ValueError, match="still collide"):
        G.surrogate_table(spark.createDataFrame([("t", "a"), ("t", "b")], "type string, unit string"))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, TEXT), (3, TEXT), (3, "mail a1@b.example.org"), (None, "x.1@mail1.example.com end"), (4, "x.1@mail1.example.com"), (5, long_text(50_000) + " 8.8.4.4"), (6, "9" * 100_000), (7, "a" * 100_000 + "@")]
    docs = docs_frame(spark, rows, extra=True)
    out = G.replace_entities(docs)
    assert [c for c in out.columns if c != "n_entities"] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[None][0] == by[4][0] + " end" and by[1] == [None] and by[2] == [""]
    assert by[6] == ["9" * 100_000] and by[7] == ["a" * 100_000 + "@"]
    assert sum(TEXT.split("@")[0] in t for t in by[3]) == 0 and len(set(by[3])) == 2
    assert by[5][0].startswith(long_text(50_000)) and "8.8.4.4" not in by[5][0]
    assert G.replace_entities(docs.limit(0)).count() == 0


def test_op2_on_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    src = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in entries.QUERIES["op2_pii_surrogates"](spark, sf).collect()}
    assert set(got) == set(src)
    pii = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{40}\b")
    names: dict[str, str] = {}
    for d, t in src.items():
        old, new = pii.findall(t), pii.findall(got[d].text)
        assert pii.sub("#", t) == pii.sub("#", got[d].text) and len(old) == len(new) == got[d].n_entities
        for a, b in zip(old, new):
            assert a != b and len(a) == len(b) or "." in a
            assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names) > 20
