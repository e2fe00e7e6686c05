import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import packing, pieces, warc
from lectern.llm.queries import ORACLES, QUERIES
from lectern.llm.store import fresh_dir
from tests import oracle

from .data import empty_docs, odd_docs, odd_rows

BPE = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROOT = Path(__file__).resolve().parents[2]


def test_warc_query_against_sql(spark):
    oracle.check(spark, QUERIES["op3_warc"], ORACLES["op3_warc"])


def test_warc_round_trip(spark):
    big, small = "<p>é日</p>" * 30, "tiny"
    rows = [(1, "http://a/%0A\n", big), (2, "http://b", big), (3, None, None), (4, "http://c", ""), (5, "http://d", small), (6, "http://e", small), (7, "http://f", "\r\n\r\nWARC/1.1\r\n" * 30), (0, "http://g", "z" * 3_000_000), (None, "http://h", big), (2, "http://b", big)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int").repartition(3)
    index = warc.write(pages)
    got = warc.read(index).collect()
    assert len(got) == len(rows) and all(r.payload_ok for r in got)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (0, "response", None), (None, "response", None)}
    by = {r.page_id: r for r in got}
    assert bytes(by[1].payload).decode() == big and by[2].payload is None and by[2].payload_bytes == len(big.encode())
    assert by[1].url == "http://a/%0A\n"
    assert by[4].url == "http://c" and by[3].url == ""
    some = warc.read(index.where("page_id in (1, 7)")).collect()
    assert {r.page_id for r in some} == {1, 7}


def test_warc_headers_are_for_other_readers(spark, monkeypatch):
    """Addresses as they are, valid ids that never repeat, references that can be followed, and archives of bounded size."""
    big = "x" * 200
    rows = [(1, "http://a/%41?q=1%2C2 é", big), (2, "http://b/\r\nWARC-Type: x", big), (3, "http://c/%0A", "three"), (3, "http://c/%0A", "three"), (3, "http://c/%0A", "other")]
    monkeypatch.setattr(warc, "ARCHIVE", 300)
    write = warc._write(f"{fresh_dir(spark, 'warc-test')}")
    first, digest = "http://a/%41?q=1%2C2 é", "d"
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([digest] * 5), pa.array([None, 1, None, None, None], pa.int64()), pa.array([first] * 5)], names=["page_id", "url", "html", "digest", "refers_to", "refers_url"])
    index = [r for out in write(iter([batch])) for r in out.to_pylist()]
    assert len({r["path"] for r in index}) > 1
    records = [warc.parse(zlib.decompress(warc.files.reader(r["path"]).read_at(r["length"], r["offset"]), 31))["fields"] for r in index]
    assert [f["WARC-Target-URI"] for f in records] == [first, "http://b/%0D%0AWARC-Type: x", "http://c/%0A", "http://c/%0A", "http://c/%0A"]
    assert len({f["WARC-Record-ID"] for f in records}) == 5 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) for f in records)
    assert records[1]["WARC-Type"] == "revisit" and records[1]["WARC-Refers-To-Target-URI"] == first and "WARC-Refers-To" not in records[1]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.url for r in warc.read(warc.write(pages)).collect()) == sorted(r[1] for r in rows)


def test_warc_on_nothing(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def reference_ids(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_tokenizers():
    import pyarrow as pa

    random.seed(5)
    alphabet = "ab'sA Éé ́ \n\t 12<|endoftext|>...ſİΣς ßﬁ,!​\x1c"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(300)] + [t for _, t in odd_rows()]
    ids, bounds = packing.doc_ids(pa.array(texts), packing.WordIds(BPE))
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == reference_ids(t)


@pytest.mark.parametrize("size", [4096, 64])
def test_packing_holds_every_token_once(spark, size):
    rows = odd_rows()
    got = packing.pack(odd_docs(spark), BPE, size=size).collect()
    ids = {i: reference_ids(t) for i, t in rows}
    times = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    for i, x in ids.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(x) * times[i] and {r.doc_tokens for r in own} == {len(x)}
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
    for _, rs in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rs:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs, BPE).collect()
    assert sum(r.length for r in got) >= 0.97 * 4096 * len({r.sequence_id for r in got})


def test_packing_on_nothing(spark):
    assert packing.pack(empty_docs(spark), BPE).count() == 0


def all_segmentations(p, text):
    s, out = (" " + text if text else ""), []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        known = s[i] in p.score
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in p.score:
                go(j, score + p.score[s[i:j]][0], [*ids, *p.score[s[i:j]][1]])
        if not known:
            b = [p.byte[x] for x in s[i].encode()]
            go(i + 1, score + p.byte_score * len(b), ids + b)

    go(0, 0.0, [])
    return sorted(out, reverse=True)


def test_n_best_against_all_segmentations():
    e = pieces.Encoder(MODEL, 4)
    random.seed(2)
    for _ in range(150):
        text = "".join(random.choice("  the aén\n.,▁'日x\tz") for _ in range(random.randint(0, 10)))
        want, got = all_segmentations(e.pieces, text), e.encode([text])[0]
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:4]]
        scores = {ids: s for s, ids in want}
        assert all(abs(scores[tuple(ids.tolist())] - s) < 1e-6 and e.pieces.decode(ids) == text for s, ids in got)


_LONG_UNITS = """
import resource, sys, time
from lectern.llm import pieces
e = pieces.Encoder(sys.argv[1], 4)
e.both(["warm up"])
size = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (size + (300 << 20),) * 2)
for unit in ("=", ".", "a", " ", "ha", "-", "x", "\\u65e5", "\\U0001f44d"):
    text, start = unit * (100_000 // len(unit)), time.perf_counter()
    (encoded,), (best,) = e.both([text])
    assert time.perf_counter() - start < 5, unit
    assert len(best) == (1 if ord(unit[0]) > 127 else 4) and all(a[0] >= b[0] for a, b in zip(best, best[1:])), unit  # one: no two pieces meet there
    assert all(e.pieces.decode(ids) == text for _, ids in [encoded, *best]), unit
    assert len({ids.tobytes() for _, ids in best}) == len(best), unit
print("done")
"""


def test_long_units_in_linear_memory():
    """A hundred thousand equal characters are one unit: under 5 s and 300 MB each."""
    got = subprocess.run([sys.executable, "-c", _LONG_UNITS, MODEL], capture_output=True, text=True, timeout=300, cwd=ROOT, env={**os.environ, "OPENBLAS_NUM_THREADS": "1"})
    assert got.stdout.strip() == "done", got.stderr[-2000:]


def test_registered_pieces(spark):
    got = QUERIES["op7_sentencepiece"](spark, oracle.SF).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    for r in got:
        ids = model.encode(texts[r.doc_id] or "")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert len(got) == len(texts)


def test_pieces_are_the_tokenizers():
    model, e = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(MODEL, 4)
    random.seed(3)
    texts = [t.replace("▁", "_") for i, t in odd_rows() if t and i != 14] + ["Hello world", "a\x00b", "  two  blanks ", "\n\n", "\r\n x", " "]
    texts += ["".join(random.choice("  theaéinr\n.,'日xñ👍\tz") for _ in range(random.randint(1, 40))) for _ in range(300)]
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts += [t for t in docs[:40] if t and "▁" not in t]
    encoded, _ = e.both(texts)
    assert [ids.tolist() for _, ids in encoded] == [model.encode(t) for t in texts]
    assert all(abs(sum(e.pieces.score_of[ids]) - s) < 1e-9 * max(1, abs(s)) for s, ids in encoded)


def test_pieces_on_odd_texts(spark):
    got = pieces.segment(odd_docs(spark), MODEL).collect()
    assert len(got) == len(odd_rows()) and all(r.round_trip for r in got)
    for r in got:
        assert len(r.ids) == r.n_pieces and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert [x.score for x in r.n_best] == sorted((x.score for x in r.n_best), reverse=True)
    assert {r.n_pieces for r in got if r.doc_id in (5, 6)} == {0}
    assert pieces.segment(empty_docs(spark), MODEL).count() == 0


def test_caches_of_other_operators_are_emptied(monkeypatch):
    from lectern.llm import words as W

    emptied = []
    monkeypatch.setitem(W.CACHES, "one", lambda: emptied.append("one"))
    monkeypatch.setitem(W.CACHES, "two", lambda: emptied.append("two"))
    assert list(W.chunks(iter([]), owner="one")) == [] and emptied == ["two"]
    known = packing.shared_word_ids(BPE)
    assert list(W.chunks(iter([]), owner="packing")) == [] and packing.shared_word_ids(BPE) is known
    assert list(W.chunks(iter([]))) == [] and packing.shared_word_ids(BPE) is not known


def test_units_are_searched_forward_alone(monkeypatch):
    """Best and second best of a new unit come without the search for the N best, of which a text needs N - 1 units' at most; ties, units
    of several scripts and the table of neighbouring characters included."""
    e, searched, own = pieces.Encoder(MODEL, 4), [], pieces.Pieces.n_best
    monkeypatch.setattr(pieces.Pieces, "n_best", lambda self, unit, n: searched.append(unit) or own(self, unit, n))
    random.seed(4)
    texts = [" ".join("".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(200)) for _ in range(5)]
    e.both(texts)
    assert len(e.two) > 500 and len(searched) <= 3 * len(texts)
    tied = pieces.Pieces(MODEL)
    for k, (p, (s, ids)) in enumerate(sorted(tied.score.items())):  # scores of few values make many ties, of three ways and more
        tied.score[p] = (-float(k % 3), ids)
    tied.known = dict.fromkeys((p[:k] for p in tied.score for k in range(1, len(p))), ()) | tied.score
    tied.root = pieces.tree(tied.score)
    units = ["".join(random.choice("  theaéinr\n.,'日xñ👍\tz▁") for _ in range(random.randint(1, 14))) for _ in range(1500)] + ["=" * 50, "a" * 31, " "]
    for p in (e.pieces, tied):
        for u in units:
            (score, ids), *more = own(p, u, 2)
            assert p.two_best(u) == (score, ids, score - more[0][0] if more else np.inf), u
    points = np.array([random.choice([random.randrange(32, 700), random.randrange(32, 0x3100), random.randrange(32, 0x20000)]) for _ in range(20_000)], "<u4")
    together = {a + b for p in e.pieces.score for a, b in zip(p, p[1:])}
    assert e.pieces.cuts(points).tolist() == [chr(a) + chr(b) not in together for a, b in zip(points[:-1].tolist(), points[1:].tolist())]
