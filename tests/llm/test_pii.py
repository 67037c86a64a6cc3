"""Spans against the contract's expressions run one by one."""

import hashlib
import re
import time

import pytest

from recspark.llm import pii
from recspark.llm.queries import op9_pii

SF = "/root/testdata/sf0.001"


def _luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def _expected(text):
    found = base(text or "")
    return (tuple(sum(f[2] == k for f in found) for k in pii.BASE),
            hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest())


ODD = ["", None, "a@b", "@b.c", "a@b.c@d.e", "x..y@z-1.q.r. tail", "a@@b.c", "1.2.3.4.5 999.1.1.1 1.2.3.04",
       "0000000000000000 4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1 2 3", "é 4111111111111111",
       "+1 +1 (017) 555-7713", "a" * 3000, "1" * 3000, "1." * 2000, "a@b." * 2000, "+1 " * 2000,
       "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "ssn 123-45-6789", "123-45-6789 order"]


def _check(rows, texts):
    for r in rows:
        counts, digest = _expected(texts[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in pii.BASE) == counts, texts[r["doc_id"]]
        assert r["base_sha256"] == digest


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    _check(rows, docs)
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) > 0


def test_odd_texts(make_docs):
    rows = pii.digest(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    _check(rows, dict(enumerate(ODD)))
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans[17].count("iban:") == 2 and spans[18] == "ssn:4:15" and spans[19] == ""


def test_ibans_before_other_words_and_local_phones():
    found = lambda t, kind: [t[a:b] for k, a, b, _ in pii.spans_of(t) if k == kind]
    for iban, tail in [("DE89 3704 0044 0532 0130 00", " BIC COBADEFF"), ("DE89370400440532013000", " EUR"),
                       ("GB82WEST12345698765432", " 2024"), ("DE89 3704 0044 0532 0130 00", "."), ("NO93 8601 1117 947", " NOK 5")]:
        for head in ("", "IBAN ", "XX12 AB34 ", "AB12 "):
            assert found(head + iban + tail, "iban") == [iban], head + iban + tail
    assert found("GB82WEST12345698765432 DE89370400440532013000 EUR", "iban") == ["GB82WEST12345698765432", "DE89370400440532013000"]
    assert pii.redacted("pay to DE89 3704 0044 0532 0130 00 BIC COBADEFF") == "pay to <IBAN> BIC COBADEFF"
    assert found("DE88370400440532013000 EUR", "iban") == [] and found("DE89370400440532013000x", "iban") == []
    for phone in ("555 123 4567", "555-123-4567", "(555) 123-4567", "555.123.4567"):
        for head in ("call ", "call  ", "call (home) "):
            assert found(f"{head}{phone} now", "phone_local") == [phone], head + phone
    assert found("call 5555 123 4567", "phone_local") == [] and found("555 123 4567", "phone_local") == []


def test_very_long_texts_take_linear_time():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "a@b." * 10**5, "+1 " * 10**5, "A1" * 10**6):
        began = time.process_time()
        pii.spans_of(text)
        assert time.process_time() - began < 10


def test_empty_and_repeated(make_docs):
    assert pii.digest(make_docs([])).collect() == []
    rows = pii.digest(make_docs([(5, "a@b.cc"), (5, "a@b.cc"), (None, "a@b.cc"), (2**60 + 1, None)])).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 5, 5, 2**60 + 1]


def test_redact_keeps_columns_and_rows(make_docs):
    docs = make_docs([(1, "mail a@b.cc now"), (2, None), (3, "plain")])
    rows = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert rows[1]["text"] == "mail <EMAIL> now" and rows[1]["n_chars"] == len("mail <EMAIL> now")
    assert rows[2]["text"] is None and rows[3]["text"] == "plain"


@pytest.mark.parametrize("part", range(4))
def test_long_runs_of_zeros_are_numbers(make_docs, part):
    """Numbers longer than Python converts."""
    for zeros in (5_000, 1_000_000):
        parts = ["1"] * 4
        parts[part] = "0" * zeros + "7"
        ok = ".".join(parts)
        parts[part] = "9" * zeros
        rows = {r["doc_id"]: r for r in pii.digest(make_docs([ok, ".".join(parts)])).collect()}
        assert rows[0]["n_ip"] == 1 and f"ip:0:{len(ok)}" in rows[0]["spans"] and rows[1]["n_ip"] == 0


def test_redact_takes_whole_rows_in_bounded_batches(make_docs):
    docs = make_docs([(k, "mail a.b@c.de now" if k % 2 else None) for k in range(1500)])
    out = pii.redact(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    rows = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in out.collect()}
    assert rows == {k: (("mail <EMAIL> now", 16, "en") if k % 2 else (None, None, "en")) for k in range(1500)}
