import random
import re
from itertools import product

import pytest

from palimpsest.llm import secrets as sc

SCHEMA = "doc_id long, text string, secrets string, id int"
#: The base patterns as they are given, with what a match needs.
BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    kinds = [*BASE, *[(r.kind, re.compile(r.regex), lambda m: True) for r in sc.RULES if not r.base]]
    found = [(m.start(), k, kind, m.end()) for k, (kind, regex, ok) in enumerate(kinds) for m in regex.finditer(text or "") if ok(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def corpus():
    rnd = random.Random(6)
    bits = ["Password", "passwd", "SECRET", "token", "token=a:", "token=token:abcdefgh", "api_key", "apikey", "api__key", "=", ": ", " = \"", "'", "abc/def.=x", "short", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef01234567", "é", "ſecret=abcdefgh", "👍", "\n", " ", "ghp_" + "a1B2" * 9, "xoxb-1234567890-ab", "AIza" + "x" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(14)))) for i in range(300)]
    rows += [(1, rows[1][1]), (1, "token=other-text"), (None, "secret: abcdefgh"), (None, None), (400, None), (401, ""), (402, "x " * 30000 + "token: abcdefgh " + "deadbeef" * 400), (403, "token=abcdef " * 400), (404, " " * 5000 + "token" + " " * 5000)]
    return [(*r, "clash", 1) for r in rows]


def test_spans_equal_brute_force(spark):
    rows = corpus()
    out = sc.find_secrets(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "id", "secrets"]
    got = sorted(((r.doc_id, r.text, [(s.kind, s.start, s.end) for s in r.secrets]) for r in out.collect()), key=str)
    assert got == sorted(((r[0], r[1], brute(r[1])) for r in rows), key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_are_necessary_conditions():
    def holds(query, low):
        return query is True or (query in low if isinstance(query, str) else (all if query[0] == "and" else any)(holds(q, low) for q in query[1]))

    for rule in sc.RULES:
        query = sc.trigram_query(rule.regex)
        assert (query is True) == (rule.kind == "hex")
        for _, text, *_ in corpus():
            for m in re.finditer(rule.regex, text or "", re.A):
                assert holds(query, m[0].lower())


@pytest.mark.parametrize(("regex", "query"), [("abcd", ("and", frozenset({"abc", "bcd"}))), ("ab?cd", ("or", frozenset({"acd", ("and", frozenset({"abc", "bcd"}))}))), ("abc|xy", True), ("[0-9]+", True), ("abc[0-9]*def", ("and", frozenset({"abc", "def"}))), ("(foo|bar)+", ("or", frozenset({"foo", "bar"}))), ("(foo|bar)*", True)])
def test_derivation(regex, query):
    assert sc.trigram_query(regex) == query


def test_rules_that_scan_fully_and_empty_tables(spark):
    only = (sc.Rule("hex", r"[0-9a-f]{24,}"),)
    out = sc.find_secrets(spark.createDataFrame([(1, "0" * 30, "", 0)], SCHEMA), rules=only).first()
    assert [(s.start, s.end) for s in out.secrets] == [(0, 30)]
    assert sc.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_nested_group_of_many_strings_leaves_a_gap():
    def holds(query, text):
        if isinstance(query, tuple):
            return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])
        return query is True or query in text

    regex = "key-([ab][cd][ef][gh][ij][kl][mn])"
    query = sc.trigram_query(regex)
    texts = ["key-" + "".join(t) for t in product("ab", "cd", "ef", "gh", "ij", "kl", "mn")]
    assert all(re.fullmatch(regex, t) and holds(query, t) for t in texts) and not holds(query, "kex")
