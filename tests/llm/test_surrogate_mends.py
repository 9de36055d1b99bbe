"""Surrogates: whole names, cards with their check digit, secrets of eight characters, and a plain reading of the patterns."""

import re

from graincast.llm import pii

KEY = "0f" * 32


def luhn(card):
    digits = [int(c) for c in re.sub(r"\D", "", card)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.replace(rows, KEY).orderBy("doc_id").collect()]


def test_whole_names_go(spark):
    names = ["Mr. José García-López", "Mr. O'Brien", "Dr. Anna Bell", "Prof Jean-Luc Roux", "Mrs. Mary-Jane O’Neil", "Господин Иван Петров-Водкин"]
    for name, got in zip(names, replaced(spark, *(f"then {n}, who left" for n in names)), strict=True):
        words = [w for w in re.findall(r"[^\W\d_]+", name.split(" ", 1)[1]) if len(w) > 1]
        assert got["n_name"] == 1 and not any(w in got["text"] for w in words) and got["text"].startswith("then " + name.split(" ")[0] + " ") and got["text"].endswith(", who left")


def test_one_person_is_one_person(spark):
    got = [r["text"] for r in replaced(spark, "Dr. Anna Bell met Prof. Carl Bell.", "Dr. Anna Bell; Anna Bell", "Bell rang")]
    first, second = re.findall(r"(?:Dr|Prof)\. (\w+) (\w+)", got[0])
    assert first[1] == second[1] and first[0] != second[0] and got[1] == f"Dr. {first[0]} {first[1]}; {first[0]} {first[1]}" and got[2] == "Bell rang"


def test_cards_by_their_check_digit(spark):
    cards = ["4111111111111111", "5500 0000 0000 0004", "4012-8888-8888-1881", "378282246310005"]
    others = ["1234567890123456", "1700000000123", "4111111111111112"]
    assert all(map(luhn, cards)) and not any(map(luhn, others))
    rows = replaced(spark, *(f"paid by {c} now" for c in cards), *(f"order {n} now" for n in others))
    seen = set()
    for row, card in zip(rows[: len(cards)], cards, strict=True):
        made = row["text"].removeprefix("paid by ").removesuffix(" now")
        assert row["n_card"] == 1 and made != card and luhn(made) and re.sub(r"\d", "9", made) == re.sub(r"\d", "9", card)
        seen.add(made)
    assert len(seen) == len(cards)
    assert [(r["text"], r["n_card"]) for r in rows[len(cards) :]] == [(f"order {n} now", 0) for n in others]


def test_secrets_after_a_key_word(spark):
    cases = [("password: hunter22", "hunter22"), ("token = 'ab12cd34'", "ab12cd34"), ("password: hunter2", None), ("password: holidays", None)]
    for (text, gone), got in zip(cases, replaced(spark, *(t for t, _ in cases)), strict=True):
        assert got["n_secret"] == (gone is not None) and (got["text"] == text if gone is None else gone not in got["text"] and len(got["text"]) == len(text))


def test_odd_rows(spark):
    got = replaced(spark, None, "", "x" * 100_000 + " Mr. Bell", "Mr. Bell", "Mr. Bell")
    assert [r["text"] for r in got[:2]] == [None, ""] and got[3]["text"] == got[4]["text"] and got[2]["text"].endswith(got[3]["text"]) and got[2]["n_name"] == 1
    assert pii.replace(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
