import random

import pytest

from lectern.operators import terms


@pytest.mark.parametrize("parts", [1, 8])
def test_hits_against_all_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(terms, "PARTS", parts)
    r = random.Random(parts)
    pick = lambda n: "".join(r.choice("abé 日x") for _ in range(n))
    own = [pick(r.randint(1, 9)) for _ in range(300)] + ["", None, "a", "a", "日", "\n", "a\nb"]
    texts = [pick(r.randint(0, 60)) for _ in range(80)] + [None, "", "x a\nb", "a" * 3000]
    got = terms.hits(spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4), "k", "t", spark.createDataFrame([(x,) for x in own], "w string"), "w").collect()
    want = sorted((i, w) for i, t in enumerate(texts) for w in {x for x in own if x} if t and w in t)
    assert sorted(tuple(x) for x in got) == want
    nothing = spark.createDataFrame([], "w string")
    assert terms.hits(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", nothing, "w").count() == 0


PROFILES = ["BUSINESS_CLEAR", "STORY_NARRATIVE", "GENERAL_CLEAR"]
ALIASES = [("BUSINESS_CLEAR", "kinh doanh"), ("BUSINESS_CLEAR", "Rõ ràng"), ("STORY_NARRATIVE", "story"), ("STORY_NARRATIVE", "kể chuyện"), ("STORY_NARRATIVE", "cảm xúc"), ("GENERAL_CLEAR", "clear"), ("GENERAL_CLEAR", "neutral"), ("NO_PROFILE", "clear")]
#: request, recommended, and what comes of it: literals of the surveyed rules.
REQUESTS = [
    ("Kể chuyện, cảm xúc!", None, ("STORY_NARRATIVE", "owner_request", 2, ["cảm xúc", "kể chuyện"])),
    ("kinh-doanh & STORY", None, ("BUSINESS_CLEAR", "owner_request", 1, ["kinh doanh"])),  # a tie, by the order of profiles
    ("history", None, ("STORY_NARRATIVE", "owner_request", 1, ["story"])),  # anywhere in the text
    (" business_plus ", ["STORY_NARRATIVE"], ("STORY_NARRATIVE", "book_profile", 0, [])),
    ("general_clear", None, ("GENERAL_CLEAR", "owner_request", 1, ["clear"])),
    ("story_narrative?", ["X"], ("STORY_NARRATIVE", "owner_request", 1, ["story"])),
    (None, ["X", "BUSINESS_CLEAR", "GENERAL_CLEAR"], ("BUSINESS_CLEAR", "book_profile", 0, [])),
    ("", ["X"], ("GENERAL_CLEAR", "default", 0, [])),
    ("nothing known", None, ("GENERAL_CLEAR", "default", 0, [])),
]


def test_style_requests(spark):
    rows = [(i, q, rec) for i, (q, rec, _) in enumerate(REQUESTS)]
    d = spark.createDataFrame(rows, "i int, q string, rec array<string>")
    a = spark.createDataFrame(ALIASES, "profile string, alias string")
    got = {r.i: (r.profile, r.source, r.votes, r.aliases) for r in terms.resolve_styles(d, "i", "q", a, PROFILES, "rec").collect()}
    assert got == {i: w for i, (*_, w) in enumerate(REQUESTS)}
    direct = terms.resolve_styles(spark.createDataFrame([(1, " Business_Clear")], "i int, q string"), "i", "q", a.where("profile = 'STORY_NARRATIVE'"), PROFILES).first()
    assert (direct.profile, direct.source, direct.aliases) == ("BUSINESS_CLEAR", "owner_profile_key", [" Business_Clear"])


def test_ten_thousand_aliases(spark):
    a = spark.range(10_000).selectExpr("concat('P', id % 3) AS profile", "concat('alias number ', id, ' of them') AS alias")
    d = spark.range(200).selectExpr("id AS i", "concat('please, ALIAS  number ', id * 7, ' of them, and alias number ', id * 7 + 3, ' of them') AS q")
    got = terms.resolve_styles(d, "i", "q", a, ["P0", "P1", "P2"]).collect()
    assert len(got) == 200 and all(r.source == "owner_request" and r.votes == 2 and r.profile == f"P{r.i * 7 % 3}" for r in got)


@pytest.mark.parametrize("most", [(0, 10**6), (10**6, 10), (10**6, 10**6)])
def test_scan_and_index_agree(spark, monkeypatch, most):
    """Few terms are looked for in one pass that shuffles no text; many, or long ones, by the index."""
    monkeypatch.setattr(terms, "MOST_SCANNED", most[0])
    monkeypatch.setattr(terms, "MOST_CHARS", most[1])
    own, texts = ["ab", "b", "abc", "\0x", "👍 b", "ab", "", None, "zz"], ["xabc", None, "", "\0x👍 b", "bb" * 9]
    found = terms.hits(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "k string, t string"), "k", "t", spark.createDataFrame([(w,) for w in own], "w string"), "w")
    assert sorted(map(tuple, found.collect())) == sorted((f"k{i}", w) for i, t in enumerate(texts) for w in {w for w in own if w} if t and w in t)
    assert ("Exchange" in found._jdf.queryExecution().toString()) == (min(most) < 10**6)
