"""Personal data: the query against the patterns, the field's finds on text that its generator didn't make."""

import hashlib
import random
import re

from textloom.llm import pii

# fmt: off
HAND = [
    ("Please ring me on (020) 7946-0018 before Friday.",[("phone","(020) 7946-0018")]),
    ('{"name":"Ann","phone":"555-123-4567","zip":"90210"}',[("phone","555-123-4567")]),
    ("tel:555-867-5309;ext=12",[("phone","555-867-5309")]),
    ("Write to jane.doe at example dot com for tickets.",[("email","jane.doe at example dot com")]),
    ("Contact: info [at] museum [dot] org or the desk.",[("email","info [at] museum [dot] org")]),
    ("My address is bob(at)mail(dot)net, thanks.",[("email","bob(at)mail(dot)net")]),
    ("The server 192.168.10.44 answered, 10.0.0.1 didn't.",[("ip","192.168.10.44"),("ip","10.0.0.1")]),
    ("Card 4111 1111 1111 1111 was charged 25.00 on 2023-11-05.",[("card","4111 1111 1111 1111")]),
    ("visa=4012888888881881,exp=1225",[("card","4012888888881881")]),
    ("Old style 4111.1111.1111.1111 still parses.",[("card","4111.1111.1111.1111")]),
    ("Call +49 30 1234567 or mail support@firm.example.com.",[("phone","+49 30 1234567"),("email","support@firm.example.com")]),
    ("Order 1234567890123456 shipped in 3 boxes of 24.",[]),
    ("Version 4.12.7 came out in 2019; see pages 12-15.",[]),
    ("The years 1914-1918 and 1939-1945 are covered.",[]),
    ("ISBN 978-3-16-148410-0 is in stock.",[]),
    ("It cost $1,299.00 at noon, 12:30 at the latest.",[]),
    ("name,phone\nAl,415-555-0132\nBo,415-555-0199",[("phone","415-555-0132"),("phone","415-555-0199")]),
    ("Numbers: 800-555-0100 / 800-555-0101 (toll free)",[("phone","800-555-0100"),("phone","800-555-0101")]),
    ("sales @ shop.example.com is read daily",[("email","sales @ shop.example.com")]),
    ("ip=172.16.254.1;host=db7",[("ip","172.16.254.1")]),
    ("Meet at noon at the dot on the map.",[]),
    ("Reach the clinic at 212-555-0147, fax 212-555-0148.",[("phone","212-555-0147"),("phone","212-555-0148")]),
    ("id 00012 sha 9f86d081884c7d659a2feaa0c55ad015",[]),
    ("He paid with 5500-0000-0000-0004 yesterday",[("card","5500-0000-0000-0004")]),
]
# fmt: on


def test_field_on_text_of_another_make():
    field = pii.SemiCRF(pii.trained())
    hit = gold = found = by_rules = 0
    for text, want in HAND:
        base, every = pii.spans_of(text, field)
        got = [(pii.KINDS[k], text[a:b]) for k, a, b in every]
        assert set(base) <= set(every)
        hit, gold, found = hit + sum(x in got for x in want), gold + len(want), found + len(got)
        by_rules += sum((pii.KINDS[k], text[a:b]) in want for k, a, b in base)
    assert hit / gold >= 0.9 and hit / found >= 0.9 and by_rules / gold < 0.6


def test_field_on_fresh_sentences():
    field, rng, hit, gold, found = pii.SemiCRF(pii.trained()), random.Random(99), 0, 0, 0
    for _ in range(200):
        text, want = pii._make(rng)
        got = set(pii.spans_of(text, field)[1])
        hit, gold, found = hit + len(got & set(want)), gold + len(want), found + len(got)
    assert hit / gold >= 0.95 and hit / found >= 0.95


def plain(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_query_rows(spark):
    texts = [None, "", " \n", "a@b.org 10.0.0.1 +44 20 7946 0018 4111 1111 1111 1111", "é a@b.org", "1." * 30_000 + " 9" * 20_000, "a@b.org", *(t for t, _ in HAND)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(6, texts[6], "x", 1), (None, texts[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int").repartition(2)
    got = sorted(map(tuple, pii.find_pii(docs).collect()), key=str)
    assert len(got) == len(rows) and pii.find_pii(docs.limit(0)).count() == 0
    held = {}
    for i, t, *_ in rows:
        held.setdefault(i, plain(t or ""))
    for i, *counts, digest, every, added in got:
        base = held[i]
        assert counts == [sum(x[0] == k for x in base) for k in range(4)]
        assert digest == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert {*pii.shown(base).split(","), ""} <= {*every.split(","), ""} and added == len([x for x in every.split(",") if x]) - len(base)
