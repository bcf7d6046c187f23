"""Pseudonyms are valid in their format, distinct, linked, and undone by the inverse permutation."""

import hashlib
import random
import re


from tessera.llm import pii

KEY = "k"


def secret(round_, about, value):
    return int(hashlib.sha256(f"{KEY}|{about}|{round_}|{value}".encode()).hexdigest()[:13], 16)


def undone(a, b, m, n, about):
    for r in range(pii.ROUNDS, 0, -1):
        b = (b - secret(r + 100, about, a)) % n
        a = (a - secret(r, about, b)) % m
    return a, b


def rewritten(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, found string, n_found int")
    rows = pii.pseudonymise(docs, KEY).orderBy("doc_id").collect()
    assert all(r.found == "x" and r.n_found == 5 for r in rows)  # the caller's own columns stay
    return rows


def test_social_security_numbers_stay_valid_and_can_be_undone(spark):
    r = random.Random(1)
    numbers = list(dict.fromkeys(f"{r.choice([a for a in range(1, 900) if a != 666]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" for _ in range(1500)))
    numbers += ["001-01-0001", "899-99-9999", "665-01-0001", "667-01-0001"]
    got = [x.text for x in rewritten(spark, numbers)]
    assert len(set(got)) == len(numbers)
    for old, new in zip(numbers, got, strict=True):
        area, group, serial = new.split("-")
        assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", new) and not re.match(r"000|666|9", new) and group != "00" and serial != "0000"
        a, b = undone(int(area) - 1 - (int(area) > 666), (int(group) - 1) * 9999 + int(serial) - 1, 898, 99 * 9999, "ssn")
        assert old == f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def test_phones_keep_their_country_and_one_number_has_one_pseudonym(spark):
    r = random.Random(2)
    plain = [f"{r.randrange(200, 1000)}-{r.randrange(200, 1000)}-{r.randrange(10000):04d}" for _ in range(300)]
    rows = rewritten(spark, plain + [f"+1 {x}" for x in plain] + ["+49 30 1234567", "+49 30 1234568", "+420 601 234 567", None, "", "no numbers"])
    got = [x.text for x in rows]
    digits = [re.sub(r"\D", "", x) for x in got[:600]]
    assert [f"1{x}" for x in digits[:300]] == digits[300:] and len(set(digits[:300])) == len(set(plain))
    assert all(re.fullmatch(r"[2-9]\d{2}-[2-9]\d{2}-\d{4}", x) for x in got[:300]) and all(x.startswith("+1 ") for x in got[300:600])
    assert re.fullmatch(r"\+49 \d{2} \d{7}", got[600]) and got[600] != got[601] and got[602].startswith("+420 ")
    assert got[603:] == [None, "", "no numbers"] and rows[603]._n_found == 0


def test_repeated_rows_and_empty_tables(spark):
    rows = rewritten(spark, ["a 123-45-6789 b"] * 3)
    assert len({x.text for x in rows}) == 1 and rows[0]._n_found == rows[0].n_changed == 1
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
