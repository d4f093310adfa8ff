import datetime
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pii
from sparkloom.llm.queries import op7_feistel_pseudonyms

VALUES = ["4845168114407329", "4845 1681 1440 7329", "378282246310005", "+1 (017) 555-7713", "(212) 555-0199", "212-555-0199", "97.51.17.173", "und.34@mail7.example.com", "078-05-1120", "2020-02-29", "31/12/1999", "12/31/1999", "10.10.2010", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
LEFT = ["4845168114407328", "999-05-1120", "2021-02-29", "45/13/1999", "1.2.3.4.5", "300.1.1.1", "GB83 WEST 1234 5698 7654 32", "0000000000000000", "12345", "x4845168114407329"]


def shape(s):
    return "".join("9" if c.isdigit() else c for c in s)


def test_values_keep_their_format():
    for v in VALUES:
        found = pii.found_in(f"see {v} there")
        assert len(found) == 1 and f"see {v} there"[found[0][1] : found[0][2]] == v, v
        new = found[0][3]
        assert new != v
        if found[0][0] in ("card", "phone", "ssn", "date"):
            assert shape(new) == shape(v)
        assert pii.found_in(f"see {new} there")[0][0] == found[0][0]
        assert pii.reveal(f"see {new} there") == f"see {v} there"
        assert pii.found_in(f"see {v} there", b"another key")[0][3] != new


def test_what_fails_its_check_stays():
    for v in LEFT:
        assert pii.found_in(f"see {v} there") == [], v


def test_values_before_more_digits_or_words():
    cards = ["4111 1111 1111 1111", "4845168114407329", "4845-1681-1440-7329", "3782 822463 10005"]
    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]
    cases = [("card", v, more) for v in cards for more in (" 12/26", " 2026", " 7", "-12", " 100 200 300 400", " 4111")]
    cases += [("iban", v, more) for v in ibans for more in (" BIC", " BIC NWBKGB2L", " 2026", " A B C D E F G", " EUR 100")]
    cases += [("phone", "212-555-0199", " 12345"), ("date", "2020-02-29", " 12345 678"), ("ssn", "078-05-1120", " 123456")]
    for kind, v, more in cases:
        text = f"see {v}{more} there"
        found = pii.found_in(text)
        assert (kind, 4, 4 + len(v)) in [f[:3] for f in found], text
        new = pii.rewritten(text, found)
        assert v not in new and pii.reveal(new) == text, text
    two = f"{ibans[0]} {ibans[2]} X"
    assert [two[a:b] for _, a, b, _ in pii.found_in(two)] == [ibans[0], ibans[2]]
    assert [f[:3] for f in pii.found_in("12 4111 1111 1111 1111")] == [("card", 3, 22)]
    assert [f[:3] for f in pii.found_in("41111 11111 11111 1 99")] == [("card", 0, 19)]


def test_dates_are_permuted():
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000) for m in range(1, 13) for d in range(1, 29)]
    new = [pii.rewritten(d, pii.found_in(d)) for d in days]
    assert len(set(new)) == len(days)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**12), st.integers(0, 10**12), st.binary(min_size=1, max_size=16))
def test_permutation_has_an_inverse(size, value, key):
    value %= size
    there = pii.permute(value, size, key, "t")
    assert 0 <= there < size and pii.permute(there, size, key, "t", back=True) == value


def test_small_domain_is_a_permutation():
    assert sorted(pii.permute(v, 97, b"k", "t", lambda x: x % 3 > 0) for v in range(97) if v % 3) == [v for v in range(97) if v % 3]


def test_no_value_is_its_own_pseudonym():
    for key in (b"a", b"b", b"c"):
        assert sorted(pii.moved(v, 26, key, "t") for v in range(26)) == list(range(26))
        assert all(pii.moved(v, n, key, "t") != v for n in (2, 26, 97) for v in range(n))
        for c in "abcdefghijklmnopqrstuvwxyz":
            new = pii.rewritten(t := f"{c}@x.org", pii.found_in(t, key))
            assert new != t and pii.reveal(new, key) == t
    for v in ["665-01-0001", "667-99-9999", "001-01-0001", "899-99-9999"]:
        assert pii.reveal(pii.rewritten(v, pii.found_in(v))) == v


def test_phones_are_linked(spark):
    spelled = ["(212) 555-0199", "212-555-0199", "+1 (212) 555-0199", "+1 212 555 0199"]
    assert len({"".join(c for c in pii.found_in(v)[0][3] if c.isdigit())[-10:] for v in spelled}) == 1


def test_query_against_revealing_it(spark, sf_dir):
    """Every text of the query, revealed, is the original; its spans are those of the texts by themselves."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_feistel_pseudonyms(spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r.has_pii for r in got)
    for r in got:
        assert pii.reveal(r.text) == texts[r.doc_id] and (r.text != texts[r.doc_id]) == r.has_pii
        assert r.pii == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.found_in(texts[r.doc_id]))


def test_odd_rows(spark, odd, none):
    got = pii.pseudonymised(odd.withColumn("pii", odd["id"]))
    assert got.columns == [*odd.columns, "pii"]
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd.collect())
    assert pii.pseudonymised(none).count() == 0
    docs = spark.createDataFrame([(1, "a 97.51.17.173 b"), (2, "97.51.17.173")], "doc_id long, text string")
    one, two = (r.text for r in pii.pseudonymised(docs).orderBy("doc_id").collect())
    assert one == f"a {two} b" and two != "97.51.17.173"


def test_query_against_a_plain_scan(spark, sf_dir):
    """What plain patterns and checks find in the documents is among the query's values, with the same bounds."""
    def luhn_ok(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    def day_ok(s):
        try:
            return bool(datetime.date.fromisoformat(s))
        except ValueError:
            return False

    plain = {
        "card": (r"(?<![\w.-])(?<!\d )(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{16})(?![\w-])(?! \d)", luhn_ok),
        "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", lambda s: all(int(x) < 256 and x == str(int(x)) for x in s.split("."))),
        "date": (r"(?<![\w-])\d{4}-\d\d-\d\d(?![\w-])", lambda s: day_ok(s) and s[:2] in ("19", "20")),
        "email": (r"(?<![\w.+-])[a-z0-9]+(?:\.[a-z0-9]+)?@[a-z0-9]+\.(?:example\.)?(?:com|org|net)(?![\w.-])", lambda s: True),
        "ssn": (r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", lambda s: True),
    }
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    met = Counter()
    for r in op7_feistel_pseudonyms(spark, sf_dir).collect():
        spans = set(filter(None, r.pii.split(",")))
        for kind, (pattern, fine) in plain.items():
            for m in re.finditer(pattern, texts[r.doc_id]):
                if fine(m.group()):
                    met[kind] += 1
                    assert f"{kind}:{m.start()}:{m.end()}" in spans, (kind, m.group(), r.pii)
    assert sum(met.values()) >= 5, met
