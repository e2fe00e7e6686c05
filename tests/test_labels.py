import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import genre as N
from lectern.functions import text as X

#: A text and its genre, confidence, densities and evidence; literals of the surveyed rules.
BOOKS = [
    ("Chiến lược kinh doanh cho doanh nghiệp: 15 kg, 20% và 3 triệu.", ("BUSINESS", "GENERAL_BUSINESS", "BUSINESS_CLEAR", 0.74, "low", "medium", [3, 0, 0, 3])),
    ("Cô ấy mỉm cười. Anh ấy thì thầm.", ("FICTION", "GENERAL_FICTION", "STORY_NARRATIVE", 0.74, "low", "low", [0, 4, 0, 0])),
    ("– Một.\n— Hai.\n- Ba.\n“Bốn” \"Năm\"", ("FICTION", "GENERAL_FICTION", "STORY_NARRATIVE", 0.8, "medium", "low", [0, 0, 6, 0])),
    ("kinh doanh và nhân vật", ("GENERAL", "UNCLASSIFIED", "GENERAL_CLEAR", 0.55, "low", "low", [1, 1, 0, 0])),
    ("marketing " * 20, ("BUSINESS", "GENERAL_BUSINESS", "BUSINESS_CLEAR", 0.9, "low", "low", [20, 0, 0, 0])),
    ("đầu tư, lợi nhuận, nhân vật, trái tim", ("FICTION", "GENERAL_FICTION", "STORY_NARRATIVE", 0.68, "low", "low", [2, 2, 0, 0])),
    ("", ("GENERAL", "UNCLASSIFIED", "GENERAL_CLEAR", 0.55, "low", "low", [0, 0, 0, 0])),
]


def test_genres(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOOKS)], "i int, t string")
    for r in N.classify(d, "t", N.VIETNAMESE).collect():
        got = (r.genre, r.subgenre, r.profile, r.confidence, r.dialogue_density, r.technical_density, [int(e.split("=")[1]) for e in r.evidence])
        assert got == BOOKS[r.i][1], BOOKS[r.i][0]
    assert N.classify(d, "t", N.VIETNAMESE).where("genre = 'BUSINESS'").first().tone == ["clear", "authoritative", "practical"]


ELEMENTS = [
    (("x", "button", True, None), "script_editor"), (("MP3", "textbox", False, "3"), "script_editor"), ((" Mp3 ", "tab", None, None), "format_mp3"), (("aac", "tab", None, None), None), (("MP3", "button", False, None), None),
    (("x", "slider", False, None), "slider_unresolved"), (("login", "button", False, "0"), "slider_unresolved"), (("Đăng nhập để xem lịch sử", None, None, None), "login"), (("Sign  In", "button", False, None), "login"),
    (("VI", "button", False, None), "language_selector"), (("Tự động", "button", False, None), "voice_selector"), (("lịch sử", "tab", False, None), "history_tab"), ((None, None, None, None), None),
]


def test_elements(spark):
    d = spark.createDataFrame([(i, *e) for i, (e, _) in enumerate(ELEMENTS)], "i int, name string, role string, editable boolean, now string")
    got = d.select("i", N.element_key(F.col("name"), F.col("role"), F.col("editable"), F.col("now")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in ELEMENTS]


def test_pauses_are_all_there_or_fail(spark):
    whole = "Dấu chấm • − 0.5s, dấu PHẨY , - 0.25s; Dấu chấm phẩy ;−1s\nXuống  dòng ¶ - 2.75s"
    pick = lambda t: spark.createDataFrame([(t,)], "t string").select(*(v.alias(k) for k, v in X.pause_values(F.col("t")).items())).first()
    assert pick(whole).asDict() == {"dot_seconds": 0.5, "comma_seconds": 0.25, "semicolon_seconds": 1.0, "newline_seconds": 2.75}
    for gone, name in (("Dấu chấm •", "dot_seconds"), ("PHẨY ,", "comma_seconds"), ("phẩy ;", "semicolon_seconds"), ("¶ - 2.75s", "newline_seconds")):
        with pytest.raises(Exception, match=f"pause value {name} not found"):
            pick(whole.replace(gone, ""))


def test_base64_in_lines(spark):
    content = bytes(range(256)) * 3
    d = spark.createDataFrame([(base64.encodebytes(content).decode(),), ("",), (None,)], "t string")
    got = [r[0] for r in d.select(F.sha1(X.decoded(F.col("t")))).collect()]
    assert got == [hashlib.sha1(content).hexdigest(), hashlib.sha1(b"").hexdigest(), None]


def test_bare_letters(spark):
    d = spark.createDataFrame([("Élève ÑANDÚ 日本 ok",), (None,)], "t string")
    assert [r[0] for r in d.select(X.bare_letters(F.col("t"))).collect()] == ["eleve nandu  ok", None]
