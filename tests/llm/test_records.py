"""Chat formatting and pseudonyms."""

import datetime
import json
import random
import re

import pytest
from docaudit.llm import chat_format as C
from docaudit.llm import pseudonyms as P
from hypothesis import given
from hypothesis import strategies as st

SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {}, "n": {"type": "integer", "minimum": 0, "maximum": 9}}}}


def chats(spark, messages, results):
    m = spark.createDataFrame(messages, "conv string, turn long, role string, text string, calls array<struct<id:string,name:string,arguments:string>>")
    return C.format_chats(m.selectExpr("*", "1 AS message", "2 AS c"), spark.createDataFrame(results, "conv string, call_id string, turn long, content string").selectExpr("*", "3 AS n"), SCHEMAS)


def test_calls_are_linked_ordered_and_checked(spark):
    ref = lambda i: json.dumps({"a": {"$ref": i}})
    calls = [("x3", "f", ref("x2")), ("x2", "f", ref("x1")), ("x1", "f", '{"n": 3.0, "a": "é"}'), ("x4", "g", "{}"), ("x5", "f", "{"), ("x6", "f", '{"n": 10, "b": 1}'), ("x7", "f", ref("later")), ("x8", "f", ref("nowhere")), ("y", "f", ref("z")), ("z", "f", ref("y"))]
    messages = [("c", 0, "user", "hi", None), ("c", 1, "assistant", "go", calls), ("c", 1, "assistant", "go", calls), ("c", 3, "assistant", None, [("later", "f", '{"a":1}'), ("x1", "f", '{"a":1}'), (None, "f", None)]), (None, None, None, None, [])]
    results = [("c", "x1", 2, "one"), ("c", "x1", 3, "two"), ("c", "x2", 2, None), ("d", "x3", 2, "other"), ("c", "stray", 2, "s"), ("c", None, 2, "none")]
    rows = chats(spark, messages, results).collect()
    main = sorted((r for r in rows if r.conv == "c" and r.turn == 1), key=lambda r: r.part)
    assert [r.call_id for r in main] == [None, "x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8", "y", "z"]
    assert main[0].json == json.dumps(json.loads(main[0].json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert '"arguments":{"a":"é","n":3}' in main[0].json
    problems = {r.call_id: set(r.problems) for r in rows if r.role == "tool" and r.turn == 1}
    assert problems["x1"] == {"several results"} and problems["x2"] == set() and problems["x3"] == {"no result"}
    assert "unknown tool" in problems["x4"] and "arguments are no JSON" in problems["x5"]
    assert {"/n: above 9", "/a: missing", "/b: unknown"} <= problems["x6"]
    assert "needs later call later" in problems["x7"] and "needs unknown call nowhere" in problems["x8"]
    assert "in or behind a circle" in problems["y"] and "in or behind a circle" in problems["z"]
    assert json.loads(next(r.json for r in main if r.call_id == "x1"))["content"] == "one"
    assert any("identifier used before" in r.problems for r in rows if r.call_id == "x1" and r.turn == 3)
    assert sorted((r.conv, r.call_id or "") for r in rows if r.problems == ["no call"]) == [("c", ""), ("c", "stray"), ("d", "x3")]
    assert sum(r.conv is None for r in rows) == 1
    assert chats(spark, [], []).collect() == []


@given(st.lists(st.sets(st.integers(0, 7)), max_size=8))
def test_order_brute_force(needs):
    ids = [str(i) for i in range(len(needs))]
    order, circle = C.ordered(ids, [{str(x) for x in own} for own in needs])
    assert sorted(order) == list(range(len(needs)))
    place = {i: k for k, i in enumerate(order)}
    for i, own in enumerate(needs):
        if i not in circle:
            assert all(place[j] < place[i] for j in own if j < len(needs))


@given(st.integers(2, 10**19), st.integers(0, 10**19))
def test_permutation_turns_back(size, number):
    number %= size
    there = P.permute(number, size, b"k", "x")
    assert 0 <= there < size and P.permute(there, size, b"k", "x", back=True) == number


def test_small_sets_are_permuted():
    for size in (1, 2, 3, 10, 97, 256):
        assert sorted(P.permute(i, size, b"k", "x") for i in range(size)) == list(range(size))


VALUES = {
    "card": ["4785380592391139", "4785 3805 9239 1139", "4785-3805-9239-1139"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ip": ["152.143.123.131", "8.8.8.8"],
    "date": ["2024-02-29", "1/31/1999", "31/1/1999", "31.12.2000"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0123", "212-555-0123", "+49 30 1234567"],
    "email": ["ann.99@mail4.example.com", "A+b_c@x.org"],
}
NOT = ["4785380592391138", "999.1.1.1", "1.2.3.4.5", "2023-02-29", "99/99/1999", "000-12-3456", "12345", "ann@", "v1.2.3", "DE00370400440532013000", "0000000000000000"]


def shape(text):
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in text)


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_formats_and_stay_valid(kind):
    for value in VALUES[kind]:
        new, spans = P.pseudonymize(f"see {value}, and {value}!", b"key")
        assert [s["kind"] for s in spans] == [kind, kind] and spans[0]["pseudonym"] == spans[1]["pseudonym"] != value
        own = spans[0]["pseudonym"]
        assert new == f"see {own}, and {own}!"
        assert [s["kind"] for s in P.pseudonymize(own, b"key")[1]] == [kind]
        if kind not in ("ip", "date"):
            assert shape(own) == shape(value)
        assert P.pseudonymize(value, b"other")[0] != own
    cards = [P.pseudonymize(v, b"key")[1][0]["pseudonym"] for v in VALUES["card"]]
    assert len({c.replace(" ", "").replace("-", "") for c in cards}) == 1


@pytest.mark.parametrize("behind", [" 12/27", " 12/2027", " 123", " 1", " 20", " 2024 10", " 12345678", " BIC", " BIC CAIXESBB", " AB12", ", 7"])
def test_what_stands_behind_a_value_stays(behind):
    for value in sum(VALUES.values(), ["ES91 2100 0418 4502 0005 1332", "+1 (974) 555-3436", "+33 1 23 45 67 89", "3782 822463 10005"]):
        own, spans = P.pseudonymize(value, b"key")
        new, found = P.pseudonymize(value + behind, b"key")
        assert found == spans and new == own + behind, value + behind


def test_values_behind_other_numbers_are_found():
    for value in ["4785380592391139", "4785 3805 9239 1139"]:
        own = P.pseudonymize(value, b"key")[0]
        for before in ("AB12 ", "12 ", "Ref 1234567 ", "+1 ", "DE00370400440532013000 "):
            assert P.pseudonymize(before + value, b"key")[0] == before + own, before + value
    assert [s["kind"] for s in P.pseudonymize("1234 567 123-45-6789", b"key")[1]] == ["ssn"]


def test_other_numbers_stay():
    for value in NOT:
        assert P.pseudonymize(f"x {value} y", b"key") == (f"x {value} y", []), value


def test_dates_stay_days_apart_in_no_way_but_valid():
    seen = set()
    for i in range(400):
        day = datetime.date(1990, 1, 1) + datetime.timedelta(i)
        new = P.pseudonymize(day.isoformat(), b"key")[0]
        seen.add(datetime.date.fromisoformat(new))
    assert len(seen) == 400


def test_mask(spark, docs):
    rng = random.Random(1)
    long = " ".join(rng.choice(["word", "4785380592391139", "é"]) for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, "none here"), (4, "é 8.8.8.8"), (4, "é 8.8.8.8"), (None, "a@b.cd"), (5, long)]
    df = docs(rows)
    got = P.mask(df, b"key").collect()
    assert len(got) == 7 and P.mask(df, b"key").columns == [*df.columns, "spans"]
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == "none here" and by[1].spans == []
    assert rows[3][1][by[4].spans[0].start : by[4].spans[0].end] == "8.8.8.8"
    assert "4785380592391139" not in by[5].text and len(by[5].text) == len(long)
    assert P.mask(docs([]), b"key").collect() == []


def test_different_days_get_different_pseudonyms():
    import datetime

    days = [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(900)]
    for forms in ([("%m/%d/%Y", False), ("%d/%m/%Y", True)], [("%d.%m.%Y", False), ("%m.%d.%Y", True)], [("%Y-%m-%d", False)], [("%B %-d, %Y", False)], [("%d %B %Y", False)]):
        # The second order counts where the first cannot be meant.
        written = {d.strftime(form): d for form, late in forms for d in days if not late or d.day > 12}
        new = {value: P.pseudonymize(f"on {value}.", b"key") for value in written}
        assert all(len(spans) == 1 and spans[0]["kind"] == "date" for _, spans in new.values())
        assert len({text for text, _ in new.values()}) == len(written)
    assert P.pseudonymize("MAY 03, 2024", b"key")[0].isupper()
    assert P.pseudonymize("Mayor 3, 2024 or February 30, 2024 or in March 2024", b"key")[1] == []


def test_mask_keeps_columns_of_any_name(spark, docs):
    df = docs([(1, "call 8.8.8.8")])
    df = df.selectExpr("*", "5 AS _masked", "6 AS made", "'old' AS spans")
    got = P.mask(df, b"key").collect()[0]
    assert (got["_masked"], got["made"], got["row"]) == (5, 6, 7) and got["spans"][0]["kind"] == "ip" and P.mask(df, b"key").columns == df.columns


def slow_values(text):
    """Numbers of cards, addresses of machines and mail, by trying every substring of a text against the definition."""
    def card(x):
        d = [int(c) for c in x]
        total = sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(reversed(d)))
        return 13 <= len(x) <= 19 and total % 10 == 0 and len(set(x)) > 1

    def address(x):
        parts = x.split(".")
        return len(parts) == 4 and all(p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts)

    out = []
    for word in text.split(" "):
        if word.isdigit() and card(word):
            out.append(("card", word))
        elif address(word):
            out.append(("ip", word))
        elif word.count("@") == 1 and word.split("@")[0].isalnum() and all(map(str.isalnum, word.split("@")[1].split("."))) and re.fullmatch("[a-z]{2,24}", word.split(".")[-1]) and "." in word:
            out.append(("email", word))
    return out


def test_detection_against_a_slow_scanner():
    rng = random.Random(4)
    for _ in range(60):
        words = []
        for _ in range(30):
            n = "".join(rng.choice("0123456789") for _ in range(rng.choice([5, 13, 16, 16, 19])))
            words.append(rng.choice([n, n[:-1] + str(P.luhn(n[:-1])), ".".join(str(rng.randrange(300)) for _ in range(4)), f"ab{n[:3]}@{rng.choice(['mail', 'x'])}.{rng.choice(['org', 'c0'])}", "word"]))
            words.append("and")  # so that numbers do not run into each other
        text = " ".join(words)
        new, spans = P.pseudonymize(text, b"key")
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans if s["kind"] != "phone"] == slow_values(text)
        at, rebuilt = 0, []
        for s in spans:
            rebuilt += [text[at : s["start"]], s["pseudonym"]]
            at = s["end"]
        assert "".join([*rebuilt, text[at:]]) == new
