"""Groupings and forms of personal data, each alone in a sentence."""

import re

from tessera.llm import pii

FOUND = ["3782 822463 10005", "3782-822463-10005", "37828 22463 10005", "4111 1111 1111 1111", "555.123.4567", "555 123 4567", "(555) 123 4567", "1/5/2024", "5.11.2024", "2024-1-05", "01/05/2024", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
LEFT = ["3782 822463 10006", "GB82 WEST 1234 5698 7654 33", "1.2.3", "13/45/2024", "12 34 56 78"]


def mod97(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_forms_are_found_and_kept(spark):
    df = spark.createDataFrame([(i, f"see {x}, thanks") for i, x in enumerate(FOUND + LEFT)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    new = [re.fullmatch("see (.*), thanks", got[i])[1] for i in range(len(got))]
    assert [x for x, y in zip(FOUND, new) if x == y] == [] and new[len(FOUND) :] == LEFT
    shape = lambda x: re.sub(r"\d", "9", x)
    assert all(shape(x) == shape(y) for x, y in zip(FOUND, new) if x not in ("1/5/2024", "5.11.2024", "2024-1-05"))
    assert mod97(new[-len(LEFT) - 2]) == 1 and mod97(new[-len(LEFT) - 1]) == 1
