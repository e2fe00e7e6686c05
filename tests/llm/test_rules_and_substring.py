import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lectern.llm import quality_rules, substring
from lectern.llm.queries import ORACLES, QUERIES
from tests import oracle

from .data import empty_docs, odd_docs, odd_rows, prose, words


def test_queries_against_sql(spark):
    for name in ("op1_quality_rules", "op4_substring_dedup"):
        oracle.check(spark, QUERIES[name], ORACLES[name])


def brute_rules(text):
    w, t = words(text), text or ""
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_texts(spark):
    rows = odd_rows() + [(20, "a | b | c\n" * 30), (21, "GO!! " * 40 + "#$% x"), (22, "l1 of ten\nl1 of ten\n" + "tail " * 9), (23, prose(200, 8) + ". " + prose(20, 9)), (24, "")]
    got = quality_rules.measure(odd_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    expect = Counter((i, *brute_rules(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expect
    kept = {r.doc_id: r.kept for r in got}
    assert kept[23] and not kept[1] and not kept[13] and not kept[5] and not kept[11] and not kept[20] and not kept[21]


def test_cleaned_text(spark):
    """Lines that break a rule go, in each language of the rules; the others stay as they stand."""
    good = ["  This sentence has an end to it. ", "Short line", "« Elle a une fin. »", "Er sagte: „Es ist vorbei.“", "¿Y ahora qué?"]
    bad = ["a line of words that ends nowhere", "Home | News | About", "GO!! NOW!! BUY.", "## $$ text%% is&& here.", "Tous DROITS réservés."]
    bad += ["Alle Rechte vorbehalten.", "Lee la POLÍTICA de privacidad.", "Licensed under the MIT License."]
    mixed = [x for pair in zip(bad, good + good) for x in pair] + ["", " \t"]
    rows = [(1, "\n".join(mixed)), (2, "\n".join(good)), (3, "\n".join(bad)), (4, None), (5, "")]
    got = {r.doc_id: r for r in quality_rules.measure(odd_docs(spark, rows)).collect()}
    assert got[1].clean_text == "\n".join((good + good)[: len(bad)])
    assert (got[2].clean_text, got[3].clean_text, got[4].clean_text, got[5].clean_text) == ("\n".join(good), "", "", "")
    assert all(r.line_words_kept == len(words(r.clean_text)) for r in got.values())


def test_rules_plan_is_native(spark):
    plan = quality_rules.measure(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.split("RDD")[0]


def test_rules_on_nothing(spark):
    assert quality_rules.measure(empty_docs(spark)).count() == 0


def brute_substring(rows):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w, own, gone = words(t), set(), [False] * len(words(t))
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in own or (i is not None and first[g] < i):
                gone[k : k + 20] = [True] * 20
            own.add(g)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_on_odd_texts(spark):
    rows = odd_rows()
    got = substring.remove(odd_docs(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(rows)


def test_substring_tells_rows_of_one_id_apart(spark):
    """Several texts under one id, ids at both ends of a long's range, null ids that share windows with others."""
    a, b, c, d = (prose(70, k) for k in (41, 42, 43, 44))
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(1, a), (5, a), (5, b), (5, d + " " + b), (5, b), (low, c), (low + 1, c + " x"), (high, c), (high, b), (high, d), (None, a), (None, c + " " + c), (0, d + " z"), (None, d)]
    for batches in (1, 2, 4):
        got = substring.remove(odd_docs(spark, rows), batches).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(rows)


def test_substring_leaves_nothing_behind(spark):
    tables, setting = {t.name for t in spark.catalog.listTables()}, spark.conf.get(substring._ORDERED)
    substring.remove(odd_docs(spark)).count()
    assert {t.name for t in spark.catalog.listTables()} == tables and spark.conf.get(substring._ORDERED) == setting


def test_substring_batches_agree(spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    results = [Counter((r.doc_id, r.n_removed) for r in substring.remove(odd_docs(spark, rows), batches=b).collect()) for b in (1, 2, 5)]
    assert results[0] == results[1] == results[2]


def index_parts():
    """Stretches and windows are the same whatever batches they come in, but for where a text's stretches begin."""
    rows = sorted((r for r in odd_rows() if r[0] is not None), key=lambda r: r[0])
    return [rows[:3], rows[3:6], rows[6:9], rows[9:12], rows[12:]]


def run_rows(index):
    return Counter((r.fp, r.content, r.doc_id, r.start, r.n) for run in index.history() for r in run.collect())


def test_index_levels(spark):
    """Runs of one level are merged into one of the next, and hold the same first stretches as a single run."""
    one, two, three = (substring.FingerprintIndex(spark, fan_out=n) for n in (100, 2, 3))
    for part in index_parts():
        for index in (one, two, three):
            index.add(odd_docs(spark, part))
    assert sorted(level for level, *_ in one.runs) == [0] * 5
    assert sorted(level for level, *_ in two.runs) == [0, 2]
    assert sorted(level for level, *_ in three.runs) == [0, 0, 1]
    assert run_rows(one) == run_rows(two) == run_rows(three)
    assert max(run_rows(one).values()) == 1


def test_index_goes_on_in_a_later_session(spark):
    parts = index_parts()
    whole, first = substring.FingerprintIndex(spark, fan_out=3), substring.FingerprintIndex(spark, fan_out=3)
    for part in parts[:3]:
        first.add(odd_docs(spark, part))
    later = substring.FingerprintIndex(spark.newSession(), first.folder, fan_out=3)
    assert run_rows(later) == run_rows(first)
    for part in parts[:3]:
        whole.add(odd_docs(spark, part))
    for part in parts[3:]:
        got, want = (index.add(odd_docs(spark, part)) for index in (later, whole))
        for g, w in zip(got, want):
            assert Counter(map(tuple, g.collect())) == Counter(map(tuple, w.collect()))
    assert run_rows(later) == run_rows(whole) and later.version == whole.version


def test_history_is_merged_in_its_order(spark):
    """The plan of the join with the runs shuffles and sorts the batch alone."""
    index = substring.FingerprintIndex(spark, fan_out=9)
    for part in index_parts()[:2]:
        index.add(odd_docs(spark, part))
    fps = spark.createDataFrame([(1,), (2,)], "fp long").groupBy("fp").count()
    found = index.known(fps)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = plan.split("SortMergeJoin")[1:]
    assert len(joins) == 2
    for join in joins:
        above_the_run = join.split("Scan parquet")[0]
        assert "Exchange" not in above_the_run and "Sort" not in above_the_run, plan


def test_windows_of_colliding_words_are_told_apart(spark, monkeypatch):
    """Both hashes of a window would have to collide, and they are of different hashes of its words."""
    hashes = substring.Words.hashes
    monkeypatch.setattr(substring.Words, "hashes", lambda self, seed=0: hashes(self, seed) if seed else hashes(self, 0) | np.uint64(1))
    a, b = (pa.record_batch([pa.array([1, 2]), pa.array([prose(40, 1), prose(40, k)]), pa.array([[{"start": 0, "n": 21}]] * 2), pa.array([7, 8])], names=["doc_id", "text", "spans", "text_hash"]) for k in (1, 2))
    same, other = ([r for out in substring._compare(iter([x])) for r in out.to_pylist()] for x in (a, b))
    assert sum(r["settled"] for r in same) == 21 and sum(r["settled"] for r in other) == 0


def test_substring_on_nothing(spark):
    assert substring.remove(empty_docs(spark)).count() == 0
