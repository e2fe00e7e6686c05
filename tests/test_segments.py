import json
import random
import re
import time
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.functions import beats as B
from lectern.functions import numbers as N
from lectern.functions import spoken as P
from lectern.functions import text as X
from lectern.jobs import editorial_manifest
from lectern.operators import ordered as O
from lectern.plans import ORACLES, QUERIES
from lectern.plans import segments as S
from tests import oracle


def units(spark, text, **rules):
    rows = S.reading_units(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], "text", **rules).orderBy("k").collect()
    return [(r.t, r.beat, r.pause_after_ms, r.must_check) for r in rows]


def test_sentences_and_clauses(spark):
    long = "the first part of it goes on and on for quite a while; " * 3 + "and then it stops, but not here, and so it ends."
    got = units(spark, f"One. Two? \u201cThree!\u201d he said\n\n{long}")
    assert [t for t, *_ in got[:4]] == ["One.", "Two?", "\u201cThree!\u201d", "he said"]
    parts = [t for t, *_ in got[4:]]
    assert parts[-1] == "and so it ends." and parts[-2] == "but not here" and all(len(p) <= S.UNIT_CHARS for p in parts)
    assert " ".join(parts).replace(",", "") == long.strip().replace(",", "")


def test_classes_pauses_and_checks(spark):
    got = units(spark, "Suddenly it fell. She would smile with love. version 2.0 is out? In the end all was well.", must_check=["Version 2.0", " VERSION 2.0", ""])
    assert [(b, p, c) for _, b, p, c in got] == [("TENSION", 370, []), ("WARM_RELIEF", 450, []), ("NARRATIVE", 650, ["Version 2.0", "VERSION 2.0"]), ("RESOLUTION", 900, [])]
    assert units(spark, "") == [] and units(spark, None) == []
    # whole words: no love in a glove, no ernst in Ernster
    assert [b for _, b, *_ in units(spark, "A glove. Ernster Fall. Ein Spaß, am Ende.")] == ["NARRATIVE", "NARRATIVE", "RESOLUTION"]


def test_emphasis(spark):
    rows = S.reading_units(spark.createDataFrame([("Die GROSSE Straße. Nichts.",)], "text string"), [], "text", emphasis=["große", "STRASSE"]).orderBy("k").collect()
    assert [r.emphasis for r in rows] == [["große", "STRASSE"], []]


def beats(spark, texts, cues=B.VIETNAMESE, given=None):
    d = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, given or [None] * len(texts)))], "i int, t string, g string")
    return [(r.beat, r.cues, r.confidence) for r in B.with_beat(d, "t", cues, "g" if given else None).orderBy("i").collect()]


#: Every class, with its cues and confidence, by the surveyed rules.
CLASSES = [
    ("Minh nhớ đến ngày cha mất, cổ họng nghẹn lại.", ("REFLECTIVE_SAD", ["reflective:nhớ", "reflective:cha mất", "reflective:nghẹn"], 0.84)),
    ("Bất ngờ cánh cửa bật mở, Minh giật mình quay lại.", ("TENSION", ["tension:bất ngờ", "tension:giật mình"], 0.88)),
    ("“Mẹ ơi, con về rồi.”", ("DIALOGUE_TENDER", ["dialogue"], 0.90)),
    ("“Được.”", ("DIALOGUE_TENDER", ["dialogue"], 0.72)),
    ('"Sao mẹ lại thế?"', ("DIALOGUE_TENSION", ["dialogue"], 0.90)),
    ("“Con sợ, con nhớ nhà.”", ("DIALOGUE_TENSION", ["dialogue", "tension:sợ"], 0.90)),
    ("“Con nhớ nhà.”", ("DIALOGUE_TENDER", ["dialogue", "reflective:nhớ", "warm:nhớ nhà"], 0.90)),
    ("Sáng hôm sau, mưa tạnh.", ("SCENE_TRANSITION", ["transition:sáng hôm sau"], 0.90)),
    ("Đêm đó, mất điện.", ("SCENE_TRANSITION", ["transition:đêm đó", "tension:mất điện"], 0.90)),
    ("Đêm đó là đêm GIAO THỪA.", ("RESOLUTION", ["resolution:giao thừa"], 0.92)),
    ("Mẹ mỉm cười.", ("WARM_RELIEF", ["warm:mỉm cười"], 0.84)),
    ("Anh đặt túi xuống ghế.", ("NARRATIVE", ["default_narrative"], 0.60)),
    ("Trung thu.", ("TENSION", ["tension:run"], 0.88)),  # these cues may stand inside a word
]


def test_every_class(spark):
    assert beats(spark, [t for t, _ in CLASSES]) == [x for _, x in CLASSES]


def test_given_class(spark):
    assert beats(spark, ["Giao thừa.", "Giao thừa.", "Giao thừa."], given=[" tension", None, "NARRATIVE"]) == [("TENSION", ["explicit_beat"], 1.0), ("RESOLUTION", ["resolution:giao thừa"], 0.92), ("NARRATIVE", ["explicit_beat"], 1.0)]
    with pytest.raises(Exception, match="unsupported beat: SLEEPY"):
        beats(spark, ["x"], given=["sleepy"])


#: Pause by last mark, then by class; literals of the surveyed rules.
PAUSES = [
    ("a…", "NARRATIVE", 800), ("a...", "NARRATIVE", 800), ("a?", "NARRATIVE", 650), ("a!", "NARRATIVE", 550), ("a.", "NARRATIVE", 450), ("a”", "NARRATIVE", 450), ('a"', "NARRATIVE", 450), ("a,", "NARRATIVE", 300), ("a;", "WARM_RELIEF", 300), ("a:", "NARRATIVE", 300),
    ("a", "NARRATIVE", 380), ("a. \n", "NARRATIVE", 450), ("a.", "REFLECTIVE_SAD", 630), ("a.”", "DIALOGUE_TENDER", 630), ("a.", "SCENE_TRANSITION", 800), ("a.", "RESOLUTION", 900), ("a…", "RESOLUTION", 1250), ("a,", "TENSION", 280), ("a.", "TENSION", 370), ("a?", "DIALOGUE_TENSION", 650),
]


def test_every_pause(spark):
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(PAUSES)], "i int, t string, b string, ms int")
    assert [r.p for r in d.withColumn("p", B.pause_after(F.col("t"), F.col("b"))).orderBy("i").collect()] == [ms for *_, ms in PAUSES]


def test_shapes(spark):
    rows = [("Đi rồi .", "RESOLUTION", "Đi rồi…"), ("Đi rồi!", "RESOLUTION", "Đi rồi!"), ("Sáng, trưa, tối.", "SCENE_TRANSITION", "Sáng… trưa, tối."), (", x", "SCENE_TRANSITION", ", x"), ("A.... b", "TENSION", "A… b"), ("A.... b.", "NARRATIVE", "A.... b.")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, b string, w string")
    assert [r.s for r in d.withColumn("s", B.shaped(F.col("t"), F.col("b"))).orderBy("i").collect()] == [w for *_, w in rows]


def test_vietnamese_clauses(spark):
    text = "Minh muốn đáp thật bình thường, nhưng cổ họng nghẹn lại. Anh đặt túi xuống ghế. “Con chỉ về mấy hôm thôi.” Mẹ gật đầu, đôi tay vẫn chậm rãi nhặt từng cọng rau."
    rows = S.clause_units(spark.createDataFrame([(text,)], "text string"), [], "text", B.VIETNAMESE, S.VIETNAMESE_CLAUSES).orderBy("k").collect()
    assert " ".join(r.t for r in rows) == text and len(rows) == 4
    assert [(r.beat, r.pause_before_ms, r.pause_after_ms) for r in rows] == [("REFLECTIVE_SAD", 220, 1050), ("NARRATIVE", 120, 650), ("DIALOGUE_TENDER", 220, 950), ("NARRATIVE", 120, 650)]
    long = "Minh " + "đi " * 40 + "xa, nhưng không về; còn mẹ, và em."
    assert [r.t for r in S.clause_units(spark.createDataFrame([(long,)], "text string"), [], "text", B.VIETNAMESE, S.VIETNAMESE_CLAUSES).orderBy("k").collect()] == [long.split(",")[0], "nhưng không về;", "còn mẹ", "và em."]


def greedy(items, most=280, hold=180):
    out, held = [], None
    for s, calm in items:
        if calm and held is not None and len(held) + len(s) + 1 <= most:
            held += " " + s
            continue
        out += [held] if held is not None else []
        held = s if calm and len(s) < hold else None
        out += [] if held is not None else [s]
    return out + ([held] if held is not None else [])


def test_merge_of_neighbours(spark):
    r = random.Random(1)
    for n in (0, 1, 2, 40, 511, 512, 513, 1500):
        parts = [("x" * r.choice([3, 40, 90, 100, 139, 140, 179, 180, 200, 279, 300]), r.random() < 0.8) for _ in range(n)]
        d = spark.createDataFrame([([len(s) for s, _ in parts], [c for _, c in parts])], "n array<int>, c array<boolean>")
        ends = d.select(O.merged_ends(F.col("n"), F.col("c"), 280, 180).alias("e")).first().e
        got = [" ".join(s for s, _ in parts[a:b]) for a, b in zip([0, *ends], ends)]
        assert got == greedy(parts)


def test_story_is_linear(spark):
    """A text of 100,000 sentences, in seconds."""
    d = spark.range(1).select(F.repeat(F.lit("He went on as before. Suddenly? "), 50_000).alias("text"))
    start = time.perf_counter()
    assert S.story_units(d, [], "text").count() == 100_000
    assert time.perf_counter() - start < 20


LEXICON = [P.Entry("ot", "of the", "o'the"), P.Entry("t", "the", "thee"), P.Entry("api", "API", "A P I", True)]


def said(spark, text, entries, **rules):
    r = P.spoken_form(spark.createDataFrame([(text,)], "t string"), entries, "t", **rules).first()
    return r.spoken_text, [(m.start, m.end, m.key) for m in r.applied]


def test_lexicon(spark, tmp_path):
    assert [x.key for x in P.checked(LEXICON)] == ["ot", "api", "t"]
    assert said(spark, "The top of the api, the API and other", LEXICON) == ("thee top o'the api, thee A P I and other", [(0, 3, "t"), (8, 14, "ot"), (20, 23, "t"), (24, 27, "api")])
    assert said(spark, "bathe thee", LEXICON) == ("bathe thee", [])
    assert said(spark, None, LEXICON) == (None, []) and said(spark, "", LEXICON) == ("", []) and said(spark, "x", []) == ("x", [])
    (tmp_path / "l.json").write_text(json.dumps({"entries": [{"key": "t", "source": "the", "spoken": "thee", "note": 1}]}))
    assert P.load(spark, str(tmp_path / "l.json")) == [P.Entry("t", "the", "thee")]
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"key": "u", "source": "C++", "spoken": "see", "whole_word": False, "category": "name"}]}))
    assert [e.key for e in P.load(spark, str(tmp_path))] == ["u", "t"]
    for bad in ([P.Entry("a", "x", "y"), P.Entry("b", "X", "z")], [P.Entry("a", "", "y")], [P.Entry("a", "x", " ")], [P.Entry("a", "x", "y"), P.Entry("a", "z", "y")], [P.Entry("a", "x", "y", category="verb")]):
        with pytest.raises(ValueError):
            P.checked(bad)
    P.checked([P.Entry("a", "x", "y"), P.Entry("b", "X", "z", True), P.Entry("c", "x", "z", whole_word=False)])  # other rules, so no repetition


def test_places_and_overlaps(spark):
    entries = [P.Entry("c", "C++", "see"), P.Entry("d", "a.b", "dot", category="name"), P.Entry("ai", "AI", "ây ai", True), P.Entry("open", "OpenAI", "ô-pần", True), P.Entry("end", "the end of", "fin"), P.Entry("dl", "Đắk Lắk", "Đắc Lắc"), P.Entry("in", "xx", "in", whole_word=False), P.Entry("sp", "the", "ze")]
    assert said(spark, "OpenAI và AI, not ai.", entries) == ("ô-pần và ây ai, not ai.", [(0, 6, "open"), (10, 12, "ai")])
    assert said(spark, "c++ and axb, a.b; C++x", entries)[1] == [(0, 3, "c"), (13, 16, "d")]
    # what starts first stays, then the longest
    assert said(spark, "the end of the", entries)[1] == [(0, 10, "end"), (11, 14, "sp")]
    assert said(spark, "axxxxxa", entries)[1] == [(1, 3, "in"), (3, 5, "in")]
    decomposed = unicodedata.normalize("NFD", "đắk lắk!")
    r = P.spoken_form(spark.createDataFrame([(decomposed,)], "t string"), entries, "t").first()
    assert r.canonical_text == "đắk lắk!" and r.spoken_text == "Đắc Lắc!" and [(m.source_text, m.spoken_text, m.category) for m in r.applied] == [("đắk lắk", "Đắc Lắc", "other")]


def test_numbers_and_suspects(spark):
    entries = [P.Entry("abbr:AI", "AI", "ây ai", True, category="abbreviation"), P.Entry("unit:kg", "kg", "ki-lô-gam", category="unit"), P.Entry("abbr:API", "API", "ây pi ai", True)]
    assert said(spark, "AI xử lý 15 kg dữ liệu.", entries, numbers=True) == ("ây ai xử lý mười lăm ki-lô-gam dữ liệu.", [(0, 2, "abbr:AI"), (9, 11, "number:15"), (12, 14, "unit:kg")])
    d = spark.createDataFrame([(0, "AI truyền 12 kg dữ liệu qua API.", ["AI", "12"]), (1, "Thuật ngữ Zephyr, AI.", ["Zephyr", "«ai»", " ", "Zephyr", "!"]), (2, "kg 1.5 7", None), (3, None, ["x"])], "i int, t string, s array<string>")
    rows = P.spoken_form(d, entries, "t", "s", numbers=True).orderBy("i").collect()
    assert [(r.spoken_text, [m.key for m in r.applied], r.unresolved) for r in rows] == [("ây ai truyền mười hai kg dữ liệu qua API.", ["abbr:AI", "number:12"], []), ("Thuật ngữ Zephyr, ây ai.", ["abbr:AI"], ["Zephyr"]), ("kg 1.5 7", [], []), (None, [], ["x"])]


def test_integer_words_agree(spark):
    numbers = [*range(0, 1200), 1001, 1010, 1015, 2005, 9021, 10_000, 15_005, 20_100, 100_000, 121_021, 999_999, 500_055]
    d = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", N.spoken_integer(F.col("n")).alias("w"))
    assert [(r.n, r.w) for r in d.collect() if r.w != P.integer_words(r.n)] == []


def brute_matches(text, entries):
    """Each entry by a regular expression of its own, then the overlaps."""
    found = []
    for e in entries:
        body = re.escape(e.source)
        for m in re.finditer(rf"(?<!\w){body}(?!\w)" if e.whole_word else body, text, 0 if e.case_sensitive else re.I):
            found.append((m.start(), -m.end(), e.key))
    out, until = [], 0
    for s, e, k in sorted(found):
        if s >= until:
            out.append((s, -e, k))
            until = -e
    return out


def test_thousands_of_entries(spark):
    r = random.Random(2)
    syllables = ["ba", "Ko", "ti", "é", "ß", "c++", "a.b", "x_", "9", "(", "Đ", "ng", " "]
    sources = list(dict.fromkeys("".join(r.choice(syllables) for _ in range(r.randint(1, 5))).strip() or "q" for _ in range(9000)))
    entries, seen = [], set()
    for i, s in enumerate(sources):
        e = P.Entry(f"k{i:05d}", s, f"<{i}>", r.random() < 0.3, r.random() < 0.7)
        own = (s if e.case_sensitive else s.casefold(), e.case_sensitive, e.whole_word)
        if own not in seen and len(entries) < 5000:
            seen.add(own), entries.append(e)
    assert len(entries) > 3000
    texts = ["".join(r.choice(syllables + ["  ", "."]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: [(m.start, m.end, m.key) for m in x.applied] for x in P.spoken_form(d, entries, "t").collect()}
    assert got == {i: brute_matches(t, entries) for i, t in enumerate(texts)}


def test_case_folding(spark):
    letters = [chr(c) for c in range(0x20, 0x2000)] + ["Straße ΟΔΟΣ ﬁn µ", "ŉab İ", "ꭰᎠ", "Spaß", ""]
    got = spark.createDataFrame([(x,) for x in letters], "t string").select("t", X.casefold(F.col("t")).alias("f")).collect()
    assert [r.t for r in got if r.f != r.t.casefold() and ord(r.t[0]) not in (0x1C89,)] == []


def test_manifest_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One. Two.\n\nThree?")
    (tmp_path / "in" / "b.txt").write_text("Alone, and \"quoted.\"")
    editorial_manifest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.source.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [u.t for u in got["a.txt"].units] == ["One.", "Two.", "Three?"] and got["a.txt"].n_units == 3
    assert got["b.txt"].version == editorial_manifest.VERSION and [u.ordinal for u in got["a.txt"].units] == [0, 1, 2]


#: Commas right behind conjunctions, conjunctions at the end, and neighbours of letters, in sentences long enough to be cut.
CROWDED = ["x " * 80 + s for s in (", and, and, but then it ends.", ", und, und, und, und.", ", and", ", Y, y, andes, AND; and: but, when", "; , if, if , if,  because", ", and, et́, et_, car.")]


@pytest.mark.parametrize("name", ["clause_units", "editorial_units"])
def test_commas_behind_conjunctions(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(CROWDED)), pa.int64()), "text": CROWDED}), tmp_path / "documents.parquet")
    oracle.check(spark, QUERIES[name], ORACLES[name], str(tmp_path))


def test_every_conjunction_is_cut_before_unless_lone(spark):
    d = spark.createDataFrame([("x " * 80 + ", and, and, but then",)], "text string")
    of = lambda **k: [r.t for r in S.reading_units(d, [], "text", **k).orderBy("k").collect()][1:]
    assert of() == ["and", "and", "but then"] and of(lone=True) == ["and, and", "but then"]
