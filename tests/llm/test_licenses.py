"""Licence scans against plain readings of their definition."""

import random
import re

import duckdb
import pytest

from crateflow.llm import license_rules, licenses

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_by_hand(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("blank", ["\u00a0", "\u0085", "\u3000", "\u2028", " ", "\t", "-", "\x1f", "é", "_"])
def test_words_end_at_ascii_marks_alone(blank):
    for text in (f"cc by{blank}foo", f"x{blank}cc by", f"general{blank}public license", f"all rights reserved{blank}", f"CC BY{blank}cc by{blank}CC by"):
        got = licenses.scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base_by_hand(text), text


def test_base_places_of_random_words():
    rng, own = random.Random(4), "cc by general public license all rights reserved x cc-by 2,0".split()
    for _ in range(500):
        text = " ".join(rng.choice(own) for _ in range(rng.randint(0, 40)))
        got = licenses.scan(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base_by_hand(text)
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))


def inside(d, e):
    return e[1] <= d[1] and d[2] <= e[2]


def by_hand(found):
    """Every pair looked at."""
    return {d for d in found if not any(e != d and inside(d, e) and (e[3], e[2] - e[1]) >= (d[3], d[2] - d[1]) and ((e[3], e[2] - e[1]) > (d[3], d[2] - d[1]) or e[0] < d[0]) for e in found)}


def test_suppression_is_the_one_defined():
    rng = random.Random(9)
    for _ in range(400):
        found = {(rng.choice("abc"), s := rng.randint(0, 12), s + rng.randint(1, 6), rng.choice([40, 70, 100])) for _ in range(rng.randint(0, 25))}
        assert set(licenses.suppressed(list(found))) == by_hand(found)


def test_gates_let_every_match_through():
    """All rules over all texts, with no prefilter, find what the gated scan finds."""
    rng, rules = random.Random(2), license_rules.rules()
    sentences = [s.replace("*", "some one") for own in (*license_rules.SIGNATURES.values(), *license_rules.NOTICES.values()) for s in own]
    plain = [re.sub(r"[()?\\[\\]:|]", "", s) for s in sentences]
    names = "gpl v3|GPLv3|mit license|Apache License, Version 2.0|cc by-sa 4.0|BSD 3-Clause|lgpl 2.1|Eclipse Public License 2.0|cc0 1.0 universal|openrail m license|the unlicense|copyright (c) 2021|released into the public domain".split("|")
    for _ in range(150):
        text = ". ".join(rng.choice([*plain, *names, "licensed under the terms of " + rng.choice(names), "lorem ipsum"]) for _ in range(6))
        words = " ".join(words_of(text))
        found = {(r.label, m.start(), m.end(), r.priority) for r in rules for m in r.pattern.finditer(words)}
        got = licenses.scan(text)
        want = by_hand(found)
        assert set(filter(None, got["labels"].split(","))) == {d[0] for d in want} | set(filter(None, got["base_labels"].split(",")))
        assert len(got["detections"]) == len(want) and 0 <= got["score"] <= 1


def test_rules_are_hundreds_and_each_is_gated():
    rules = license_rules.rules()
    assert len(rules) > 800 and sum(map(len, license_rules.SIGNATURES.values())) > 100
    assert all(r.keyword in r.gate for r in rules)


@pytest.mark.parametrize(("text", "label"), [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Neither the name of the Example Corporation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause")])
def test_known_texts(text, label):
    assert label in licenses.scan(text)["labels"].split(",")


def test_many_detections_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        text = "licensed under the mit license. all rights reserved. " * n
        began = time.process_time()
        assert licenses.scan(text)["n_base"] == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_base_places_are_those_of_the_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in licenses.base_places(docs).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == sorted(con.execute(licenses.BASE_SQL).fetchall())
