from __future__ import annotations

import re

import regex

from pyspark.sql import functions as F

from plumbline.llm import surrogates
from plumbline.llm.surrogates import NAMES, PATTERNS, with_surrogates

TEXTS = [
    "Write to jane.doe@mail7.example.com or +1 (017) 555-7713, not jane.doe@mail7.example.com.",
    'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde',
    "host 97.51.17.173, card 9807915762804490 4845168114407329 and 4417-7442-8035-1547; 078-05-1120",
    "Mrs. Anna Keller met Herr Keller and Anna Keller; Mr. Jones stayed. Г-жа Анна Петрова и Γιώργος Παππάς.",
    "DE89 3704 0044 0532 0130 00 is an account, +49 30 1234567 a line",
    "clean text 3.14 and 1.2.3 v10 of 2024-01-02, price 100000, a@b, 12:30, x@y.z",
    "9807915762804490",
]


def cleaned(table, texts, key="k"):
    return {r.row.doc_id: r for r in with_surrogates(table(texts), key).collect()}


def test_every_mention_goes_and_its_form_stays(table):
    got = cleaned(table, TEXTS)
    assert [got[i].n_found for i in range(len(TEXTS))] == [3, 2, 5, 6, 2, 0, 1]
    assert got[5].clean_text == TEXTS[5]
    for i, kind in ((0, "email"), (0, "phone"), (2, "ip"), (2, "card"), (2, "ssn"), (4, "phone")):
        old, new = (regex.findall(PATTERNS[kind], t) for t in (TEXTS[i], got[i].clean_text))
        assert len(old) == len(new) > 0 and not set(old) & set(new)
        if kind != "ip":
            assert [re.sub(r"\d", "0", re.sub("[a-z]", "a", x.split("@")[0])) for x in new] == [re.sub(r"\d", "0", re.sub("[a-z]", "a", x.split("@")[0])) for x in old]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, not", got[0].clean_text)
    assert all(int(o) < 256 for o in re.search(r"host ([\d.]+),", got[2].clean_text)[1].split("."))


def test_coreference(table):
    got = cleaned(table, TEXTS)
    mails = re.findall(r"\S+@\S+[a-z]", got[0].clean_text)
    assert mails[0] == mails[1] and mails[0].endswith(".com")
    secrets = re.findall(r"[0-9a-f]{40}", got[1].clean_text)
    assert len(secrets) == 2 and secrets[0] == secrets[1] and got[1].clean_text.startswith('token = "')
    assert re.search(r"card (\d{16}) ", got[2].clean_text)[1] == got[6].clean_text
    names = re.match(r"Mrs\. (\w+a) (\w+) met Herr (\w+) and (\w+a) (\w+); Mr\. (\w+) stayed\. Г-жа ([а-яА-Я]+а) ([а-яА-Я]+) и ([α-ωΑ-Ως]+ος) ([α-ωΑ-Ω]+)\.", got[3].clean_text)
    assert names and names[1] == names[4] and names[2] == names[3] == names[5] and names[6] != names[2] and "Keller" not in names[0]
    again = cleaned(table, TEXTS)
    assert {i: r.clean_text for i, r in got.items()} == {i: r.clean_text for i, r in again.items()}
    assert cleaned(table, TEXTS, "other")[0].clean_text != got[0].clean_text


def test_numbers_without_country_code_and_long_addresses(table):
    texts = [
        "call 212-555-0147, 212.555.0148, 06 12 34 56 78, 030 1234567 or 020 7946 0958 now",
        "call +493012345678 or +1 212 555 0199 or +380 44 123 4567 now",
        "hosts 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:8A2E:0370:7335 and fe80::1 up",
        "at 12:30:45 in 2024-01-02, std::vector, a::b, cafe:babe, 1.2.3, 100 200 3000, 5-10-15, 00:1b:44:11:3a:b7",
    ]
    got = cleaned(table, texts)
    assert [got[i].n_found for i in range(4)] == [5, 3, 3, 0]
    shape = lambda t: re.sub("[A-F]", "A", re.sub("[a-f]", "a", re.sub(r"\d", "0", t)))
    for i in (0, 1, 2):
        assert len(got[i].clean_text) == len(texts[i])
    assert shape(got[0].clean_text) == shape(texts[0])
    assert re.fullmatch(r"call \+49\d{10} or \+1 \d{3} \d{3} \d{4} or \+380 \d\d \d{3} \d{4} now", got[1].clean_text)
    for old, new in zip(texts[2].split()[1:6:2], got[2].clean_text.split()[1:6:2]):
        assert old != new and re.fullmatch("[0-9A-Fa-f:]+", new) and [len(g) for g in old.split(":")] == [len(g) for g in new.split(":")]


def test_persons_by_title_list_and_bare_surname(table):
    texts = [
        "Keller came early. Dr. Anna Keller and Prof. Dr. Xaver Braun met; Braun spoke, Keller's notes and Kellermann stayed.",
        "Keller is a word of this text.",
        "Mme Xaver Braun and Dr. Xaver Braun",
        "Count Orlok and Nosferatu Orlok",
    ]
    got = cleaned(table, texts)
    assert [got[i].n_found for i in range(4)] == [5, 0, 2, 0]
    m = re.fullmatch(r"(\w+) came early\. Dr\. (\w+a) (\w+) and Prof\. Dr\. (\w+a) (\w+) met; (\w+) spoke, (\w+)'s notes and Kellermann stayed\.", got[0].clean_text)
    assert m and m[1] == m[3] == m[7] != "Keller" and m[5] == m[6] != "Braun"
    assert got[1].clean_text == texts[1]
    n = re.fullmatch(r"Mme (\w+) (\w+) and Dr\. (\w+) (\w+)", got[2].clean_text)
    assert n and n[1] == n[3] == m[4] and n[2] == n[4] == m[5]
    more = NAMES.extended(neutral_titles=["Count"], male_names=["Nosferatu"])
    other = {r.row.doc_id: r.clean_text for r in with_surrogates(table(texts), "k", more).collect()}
    c = re.fullmatch(r"Count (\w+) and (\w+en) (\w+)", other[3])
    assert c and c[1] == c[3] != "Orlok" and other[1] == texts[1]


def test_check_digits_and_scripts(table):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    texts = [f"to {i} now" for i in ibans] + ["card 4111 1111 1111 1111 and 4111111111111112", "почта иван.петров@пример.рф и ok"]
    got = cleaned(table, texts)
    for i, old in enumerate(ibans):
        new = got[i].clean_text[3:-4]
        moved = new.replace(" ", "")[4:] + new[:4]
        assert new != old and new[:2] == old[:2] and len(new) == len(old) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1

    def luhn(card):
        digits = [int(c) for c in reversed(card) if c.isdigit()]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10

    right, _ = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", got[3].clean_text).groups()
    assert luhn(right) == 0 and right != "4111 1111 1111 1111"
    assert re.fullmatch(r"почта [а-я]{4}\.[а-я]{6}@[а-я]{6}\.рф и ok", got[4].clean_text)


def test_collisions_are_drawn_again(spark, monkeypatch):
    """Three-digit entities: hundreds of a thousand values, so first draws collide, with each other and with entities."""
    rows = [("ssn", f"{i:03}") for i in range(0, 600)]
    found = surrogates.entity_surrogates(spark.createDataFrame(rows, "part_kind string, part string").where("part < '300'"), "k").collect()
    assert len(found) == 300 and len({r.surrogate for r in found}) == 300
    assert not {r.surrogate for r in found} & {r.part for r in found}


def test_against_a_plain_scan(table, prose):
    """Every planted value disappears, all else stays, distinct values stay distinct."""
    values = [f"user{i}.x@site{i % 7}.example.org" for i in range(40)] + [f"10.{i}.7.{i * 3}" for i in range(40)] + [f"{4000000000000000 + i * 7919}" for i in range(40)]
    texts = [f"{prose(i, 20)} {v} {prose(i + 500, 20)}" for i, v in enumerate(values)]
    got = cleaned(table, texts)
    put = []
    for i, v in enumerate(values):
        head, tail = texts[i].split(v)
        assert got[i].clean_text.startswith(head) and got[i].clean_text.endswith(tail)
        put.append(got[i].clean_text[len(head):len(got[i].clean_text) - len(tail)])
    assert len(set(put)) == len(values) and not set(put) & set(values)


def test_odd_rows(table, odd_rows):
    rows, ids = odd_rows
    docs = table([*rows, TEXTS[0], TEXTS[0]], [*ids, 60, 60]).withColumn("part", F.lit("clash")).withColumn("replacements", F.lit(1))
    got = with_surrogates(docs, "k").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.row.doc_id, r.clean_text) for r in got if r.row.doc_id != 60), key=key) == sorted(zip(ids, rows), key=key)
    assert len({r.clean_text for r in got if r.row.doc_id == 60}) == 1
    assert with_surrogates(docs.limit(0), "k").collect() == []
