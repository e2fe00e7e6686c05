import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lectern.llm import secrets, trigrams
from lectern.llm.queries import ORACLES, QUERIES
from tests import oracle
from tests.llm import data

PATTERNS = [r.pattern for r in secrets.RULES] + [
    "abc", "(abc|def)+x", "a{3}b", "x?yz(ab|cd)?ef", "[ab]c[de]f", "(?i)Kiss", "(?ai)Kiss", "ab.cde", "a+b+c+", "(foo|ba[rz])qux?", "^hello world$", "(?:x|)", "é{2}a", "(?i)éab", "[^a]bcd", "\\bword\\b", "(ab){2,}c", "(?<!x)a(?!x)bcd", "(?:ab|cde){5}",
]


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text).encode("utf-8", "surrogatepass")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_satisfies_the_query(pattern):
    query = trigrams.query_of(pattern)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(text):
        assert re.search(pattern, text)
        assert trigrams.holds(query, trigrams.trigrams_of(folded(text)))

    check()


def test_queries():
    assert trigrams.query_of("[0-9a-f]{24,}") is True
    assert trigrams.query_of("ab") is True
    code = lambda s: int.from_bytes(s)
    assert trigrams.query_of("AKIA[A-Z0-9]+") == ("and", frozenset({code(b"aki"), code(b"kia")}))
    assert trigrams.query_of("abc|xyz") == ("or", frozenset({code(b"abc"), code(b"xyz")}))
    assert [r.kind for r in secrets.RULES if trigrams.query_of(r.pattern) is True] == ["hex"]


def test_postings():
    r = random.Random(2)
    texts = ["".join(r.choice("abAé ") for _ in range(r.randint(0, 40))) for _ in range(30)] + ["", "ab", None]
    import pyarrow as pa

    got = set(zip(*(x.tolist() for x in secrets.postings(*secrets._bytes(pa.array(["gone", *texts]).slice(1))))))
    assert got == {(g, i) for i, t in enumerate(texts) for g in trigrams.trigrams_of(folded(t or ""))}
    long = np.frombuffer(bytes(r.randrange(97, 123) for _ in range(5000)), np.uint8)
    whole = secrets.postings(long, np.array([0, 5000]))[0]
    assert set(whole.tolist()) == trigrams.trigrams_of(long.tobytes())


def test_long_text_in_steps(monkeypatch):
    monkeypatch.setattr(secrets, "SMALL_CHUNK", 7)
    text = bytes(range(97, 123)) * 3
    assert set(secrets.postings(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()) == trigrams.trigrams_of(text)


def brute(text):
    """By the contract's own patterns, read from left to right."""
    out = []
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for order, (kind, pattern, group, least) in enumerate(base):
        out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


ODD = [
    (40, "é token=token:abcdefghij secret = 'abc' password:\"hunter2hunter\""), (41, "API_KEY=xyzxyz APIKEY: 123456 apikey=12345"), (42, "AKIA" + "Z9" * 8 + " AKIAQ " + "x" * 3 + "AKIA" + "A" * 40), (43, "f" * 23 + "g" + "0a" * 12 + "G" + "a" * 100),
    (44, "日本 toKen:\x20\x20'deadbeef" + "deadbeef" * 3), (None, "secret=abcdefgh"), (None, None), (46, "to" + "ken=abcdefgh"), (46, "other"), (47, "ghp_" + "z1" * 18), (48, "toKen=abcdefgh"), (49, "x" * 100_000 + " passwd=" + "q" * 9),
]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_odd_rows(spark, broadcast_rows):
    rows = [*data.odd_rows(), *ODD]
    out = secrets.scan(data.odd_docs(spark, rows), broadcast_rows=broadcast_rows).collect()
    kinds = {r.kind for r in secrets.BASE_RULES}
    got = sorted((repr(r.doc_id), r.text or "", [(s.kind, s.start, s.end) for s in r.spans if s.kind in kinds]) for r in out)
    assert got == sorted((repr(i), t or "", brute(t or "")) for i, t in rows)
    assert [[s.kind for s in r.spans] for r in out if r.doc_id == 47] == [["code_host"]]
    assert "lang" in out[0] and "kept" in out[0]
    assert secrets.scan(data.empty_docs(spark)).count() == 0


def test_one_index_for_later_rules(spark):
    docs = data.odd_docs(spark, [*data.odd_rows(), *ODD])
    index = secrets.build_index(docs)
    rules = (secrets.Rule("dead", "(dead|live)beef"), secrets.Rule("nowhere", "qqqqqqqqqqqqzz"))
    assert secrets.candidates(index, rules).count() == 1
    found = secrets.scan(docs, rules, index).where("size(spans) > 0").collect()
    assert [(r.doc_id, len(r.spans)) for r in found] == [(44, 4)]
    assert secrets.candidates(index, (secrets.Rule("any", "[0-9]+"),)).count() == 0  # scanned in full instead


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    oracle.check(spark, QUERIES["op11_secret_scans"], ORACLES["op11_secret_scans"], f"/root/testdata/{sf}")
