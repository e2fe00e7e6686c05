import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import elias_fano, langid, ngram_lm, quality_bayes
from lectern.llm.queries import QUERIES

from .data import empty_docs, odd_docs, odd_rows, prose, words

SF = "/root/testdata/sf0.01"


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 3), (1000, 50), (1000, 2**40), (3000, 2**38), (64, 64), (3, 2**60)):
        v = np.sort(r.integers(0, u, n))
        s = elias_fano.Sequence(np.frombuffer(elias_fano.encode(v), np.uint8))
        assert (s.get(np.arange(n)) == v).all()
        q = np.concatenate([v, v + 1, r.integers(0, u, 100)])
        a, b = r.integers(0, n + 1, len(q)), r.integers(0, n + 1, len(q))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        assert (s.find(q, lo, hi) == np.clip(np.searchsorted(v, q), lo, hi)).all()


def test_elias_fano_neighbours():
    """Elements with their followers, and whether a successor is the value itself: high parts of many elements, gaps of many words."""
    r = np.random.default_rng(1)
    for n, u in ((2, 1), (5, 3), (1000, 50), (4000, 7), (1000, 2**40), (3000, 2**38), (64, 64), (63, 1), (65, 2), (3, 2**60)):
        for v in (np.sort(r.integers(0, u, n)), np.sort(np.where(r.random(n) < 0.9, u - 1, r.integers(0, u, n)))):
            s = elias_fano.Sequence(np.frombuffer(elias_fano.encode(v), np.uint8))
            a, b = s.get_two(np.arange(n - 1))
            assert (a == v[:-1]).all() and (b == v[1:]).all()
            q = np.concatenate([v, v + 1, r.integers(0, u, 100), [-1]])
            lo, hi = np.sort(r.integers(0, n + 1, (2, len(q))), axis=0)
            at, same = s.search(q, lo, hi)
            want = np.clip(np.searchsorted(v, q), lo, hi)
            assert (at == want).all() and (same == [k < h and v[k] == x for k, h, x in zip(want, hi, q)]).all()


def test_lm_lookups_select_few_bits(spark, monkeypatch):
    """A successor's lookup selects a bit for its context, one for the context before and one for its value, with few more where words
    end (six and more before); words are hashed as Arrow has them, without a Python string of each."""
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(k).zipf(1.3, 300) % 5000) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_lm, "parallelism", lambda spark: 1)
    model = ngram_lm.train(docs)
    t = ngram_lm.Tokens(pa.array(texts))
    asked, selected, select, find = [], [], elias_fano.Sequence._select, ngram_lm.Level.find
    monkeypatch.setattr(elias_fano.Sequence, "_select", lambda self, counts, k, flip: selected.append(len(k)) or select(self, counts, k, flip))
    monkeypatch.setattr(ngram_lm.Level, "find", lambda self, v, w, lower: asked.append(len(v) + 2 * len(np.unique(v))) or find(self, v, w, lower))
    ngram_lm.Found(t, model.vocabulary, model.pairs).scores(model.triples)
    assert sum(asked) > 30_000 and sum(selected) < 1.2 * sum(asked), (sum(selected), sum(asked))
    own = ngram_lm.Words(pa.array(["Zoë b", "b \U0001f44d"]))
    assert own.vocab_hashes(3).tolist() == [xxhash.xxh3_64_intdigest(w.encode(), 3) for w in ("Zoë", "b", "\U0001f44d")] and "vocab" not in own.__dict__
    assert own.vocab == ["Zoë", "b", "\U0001f44d"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.held_out(F.col("doc_id"), 3)
    got = langid.predict(docs, langid.fit(docs.where(~held))).where(held & (F.length("text") > 100)).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_a_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    en, fr = (docs.where((F.col("lang") == x) & (F.length("text") > 2000)).first().text for x in ("en", "fr"))
    r = langid.predict(spark.createDataFrame([(1, en[:1500] + "\n" + fr[:600])], "doc_id long, text string"), model).first()
    assert r.lang_pred == "en" and r.n_languages == 2 and 0.5 < r.score < 0.9


def brute_language(text, model):
    """Proportions and set of one text, in plain Python."""
    w = words(text)
    segs = []
    for at in range(0, len(w), langid.SEGMENT):
        total = np.zeros(len(model.langs))
        for x in w[at : at + langid.SEGMENT]:
            t = f" {x.lower()} "
            for k in range(len(t) - 2):
                key = (ord(t[k]) << 42) ^ (ord(t[k + 1]) << 21) ^ ord(t[k + 2])
                total += model.log_p[(key * 0x9E3779B97F4A7C15 % 2**64) >> 49]
        segs.append([math.exp(v - max(total)) for v in total])

    def em(allowed):
        share = {i: 1 / len(allowed) for i in allowed}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for p in segs:
                s = sum(share[i] * p[i] for i in allowed) + 1e-300
                for i in allowed:
                    new[i] += share[i] * p[i] / s / len(segs)
            share = new
        return share, sum(math.log(sum(share[i] * p[i] for i in allowed) + 1e-300) for p in segs)

    full, _ = em(range(len(model.langs)))
    order = sorted(full, key=lambda i: (-full[i], i))
    best, best_score, size = None, -math.inf, 0
    for k in range(1, len(order) + 1):
        share, fit = em(sorted(order[:k]))
        score = fit - langid.PENALTY * (k - 1) * math.log1p(len(segs))
        if score <= best_score:
            break
        best, best_score, size = share, score, k
    return best, size


def test_language_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    parts = {r.lang: r.text for r in docs.where(F.length("text").between(700, 3000)).groupBy("lang").agg(F.min("text").alias("text")).collect()}
    langs = sorted(parts)
    assert len(langs) >= 4
    # six languages, two of them shifted copies, and texts of one to six of them
    rot = lambda t, k: "".join(chr(97 + (ord(c) - 97 + k) % 26) if "a" <= c <= "z" else c for c in t.lower())
    parts |= {"r1": rot(parts[langs[0]], 9), "r2": rot(parts[langs[0]], 17)}
    train = spark.createDataFrame([(t, x) for x, t in parts.items()], "text string, lang string")
    model = langid.fit(train)
    names = sorted(parts)
    texts = [" ".join(parts[x][:600] for x in names[:k]) for k in range(1, 7)] + [parts[x][:90] for x in names] + [t for _, t in odd_rows() if words(t) and len(t) < 5000]
    for at_once, long in ((langid.AT_ONCE, langid.LONG), (500, langid.LONG), (langid.AT_ONCE, 4), (langid.AT_ONCE, 1)):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        monkeypatch.setattr(langid, "LONG", long)
        shares, size = langid.mixtures(pa.array(texts), model)
        for t, own, n in zip(texts, shares, size):
            want, k = brute_language(t, model)
            assert n == k
            assert np.allclose(own, [want.get(i, 0.0) for i in range(len(model.langs))], atol=1e-4)
        assert size[5] > 4  # no bound of languages in a set


def test_language_of_dirty_labels(spark):
    """Every value is learned; with a bound those with most text are, and nothing fails."""
    rows = [(prose(200, k), x) for k, x in enumerate("abc")] + [(prose(5, 50 + k), f"dirt{k}") for k in range(40)]
    train = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert langid.fit(train, 3).langs == ["a", "b", "c"]
    whole = langid.fit(train)
    assert len(whole.langs) == 43 and langid.predict(spark.createDataFrame([(prose(200, 1),)], "text string"), whole).first().lang_pred == "b"


def test_many_languages_in_bounded_memory_and_time():
    """256 languages, and 4 MB of words that are all different: scored by trigrams, in steps."""
    import resource
    import time

    g = np.random.default_rng(1)
    model = langid.Model([f"l{i:03d}" for i in range(256)], g.gamma(0.3, 200, (256, langid.BUCKETS)))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(x) for x in letters[g.integers(0, 26, (50_000, 7))]) for _ in range(10)] + ["".join(letters[g.integers(0, 26, 40)]) for _ in range(200)]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    shares, size = langid.mixtures(pa.array(texts), model)
    took, grown = time.perf_counter() - start, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert np.allclose(shares.sum(axis=1), 1) and (size >= 1).all()
    assert took < 20 and grown < 600, (took, grown)


def test_segments_by_words_and_by_trigrams_agree(monkeypatch):
    g = np.random.default_rng(2)
    model = langid.Model(list("abcdefg"), g.gamma(0.3, 20, (7, langid.BUCKETS)))
    texts = pa.array([prose(n, n) for n in (1, 15, 16, 17, 5000)] + ["", None])
    whole = langid.mixtures(texts, model)
    monkeypatch.setattr(langid, "TABLE", 0)
    for at_once in (langid.AT_ONCE, 50):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        shares, size = langid.mixtures(texts, model)
        assert np.allclose(shares, whole[0], atol=1e-4) and (size == whole[1]).all()


def test_registered_language_query(spark):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id].text or ""):
            assert r.lang_pred == "und"


def test_language_on_odd_texts(spark):
    docs = odd_docs(spark)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0.0) == (r.doc_id in (5, 6, 7))
    nothing = langid.fit(empty_docs(spark))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty_docs(spark), nothing).count() == 0


def test_quality_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = F.col("doc_id") % 2 == 0
    model = quality_bayes.fit(docs, labels.where(even))
    got = quality_bayes.classify(docs, model, "source", "lang").join(labels, "doc_id").where(~even).collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.quality_ok for r in clean) >= 0.97 * len(clean)
    assert sum(not r.quality_ok for r in bad) >= 0.9 * len(bad)


def test_quality_uses_every_telling_word(spark):
    """A hundred words that each pass the test, joined to digits, and forms of their stems that no labelled text has."""
    stems = [f"{a}{b}orv" for a in "bcdfghklmn" for b in ("ada", "ede", "idi", "odo", "udu", "aba", "ebe", "ibi", "obo", "ubu")]
    rows, labels = [], []
    for k, w in enumerate(stems):
        for j in range(20):
            rows.append((20 * k + j, f"{prose(30, 20 * k + j)} {w}us77 {prose(10, 200_000 + 20 * k + j)}"))
            labels.append((20 * k + j, 1, 1))
    for k in range(4000):
        rows.append((10_000 + k, prose(41, 50_000 + k)))
        labels.append((10_000 + k, 1, 0))
    new = [(20_000 + k, f"{prose(30, 90_000 + k)} 12{w}arum88 {prose(10, 95_000 + k)}") for k, w in enumerate(stems)]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows + new], "doc_id long, text string, source string, lang string")
    model = quality_bayes.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model.parts["toxic"][2]) >= 100
    x = model.log_odds(pa.array([t for _, t in rows + new]))[1]
    assert (x[:2000] > 0).all() and (x[2000:6000] < 0).all() and x[6000:].min() > np.median(x[2000:6000]) + 2


def test_quality_shrinks_sparse_sites(spark):
    """A site with a few bad documents moves less than one with many."""
    p = [("big", "x", 0.9)] * 400 + [("small", "x", 0.9)] * 2 + [("rest", "y", 0.02)] * 2000 + [("other", "y", 0.03)] * 500
    d = spark.createDataFrame([(h, q, a, a) for h, q, a in p], "host string, path string, _p_bad double, _p_toxic double")
    site = {r.h: r._site_bad for r in quality_bayes._sites(d, "host", "path").collect()}
    assert site["big"] > site["small"] > site["rest"]


def test_quality_on_odd_texts(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (99, 0, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_bayes.classify(docs, quality_bayes.fit(docs, labels), "source", "lang").collect()
    assert len(got) == len(odd_rows()) and all(r.quality_ok for r in got if r.doc_id == 1)
    assert quality_bayes.classify(empty_docs(spark), quality_bayes.fit(empty_docs(spark), labels), "source", "lang").count() == 0


def brute_sites(rows):
    """Log odds of each site against the global rate, of rows (host, path, probability), in plain Python."""
    def mean_var(x):
        m = sum(x) / len(x) if x else 0
        return sum((v - m) ** 2 for v in x) / (len(x) - 1) if len(x) > 1 else 0.0

    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    rate = max(sum(p for *_, p in rows) / len(rows), 1e-6)
    strength = lambda v: min(max(rate * (1 - rate) / max(v, 1e-6) - 1, 10), 1000)
    mean = lambda x: sum(x) / len(x)
    by = strength(mean_var([mean(x) for x in hosts.values() if len(x) >= 20]))
    below = strength(mean_var([mean(x) - mean(hosts[h]) for (h, _), x in paths.items() if len(x) >= 20]))
    out = {}
    for (h, q), x in paths.items():
        host = (sum(hosts[h]) + by * rate) / (len(hosts[h]) + by)
        out[h, q] = logit((sum(x) + below * host) / (len(x) + below)) - logit(rate)
    return out


def test_quality_against_brute_force(spark, monkeypatch):
    """Posteriors of the registered query and of the way with many sites, from the evidence of each text."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_bayes.fit(docs, labels)
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    x = model.log_odds(pa.array([r.text for r in rows], pa.string()))
    site = {k: brute_sites([(r.source, r.lang, 1 / (1 + math.exp(-v))) for r, v in zip(rows, x[j])]) for j, k in enumerate(quality_bayes.KINDS)}
    p = lambda j, k, r, i: 1 / (1 + math.exp(-(x[j][i] + site[k][r.source, r.lang])))
    want = {r.doc_id: tuple(p(j, k, r, i) for j, k in enumerate(quality_bayes.KINDS)) for i, r in enumerate(rows)}
    for limit in (50_000, 7, 0):
        monkeypatch.setattr(quality_bayes, "BROADCAST_SITES", max(limit, 1))
        got = QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.001").collect()
        assert len(got) == len(rows)
        for r in got:
            assert np.allclose((r.p_bad, r.p_toxic), want[r.doc_id], atol=1e-9)
            assert r.kept == (max(want[r.doc_id]) < 0.5)


def test_quality_texts_are_scored_once(spark):
    docs = odd_docs(spark)
    out = quality_bayes.classify(docs, quality_bayes.Classifier(), "source", "lang", keep_text=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "text" not in out.columns and "MapInArrow" not in plan and "Python" not in plan


def brute_lm(rows, train):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tok = [(i, words(low(t)) + [None]) for i, t in rows]
    c, b, b3 = Counter(), Counter(), Counter()
    for i, w in tok:
        if train(i):
            c.update(w)
            b.update(zip([None, *w[:-1]], w))
            b3.update(zip(zip([None, *w[:-2]], w), w[1:]))
    n, v = sum(c.values()), len(c)
    deg, tot = Counter(x for x, _ in b), Counter()
    for (x, _), k in b.items():
        tot[x] += k
    deg3, tot3 = Counter(x for x, _ in b3), Counter()
    for (x, _), k in b3.items():
        tot3[x] += k
    p0 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda x, w: (b[x, w] + deg[x] * p0(w)) / (tot[x] + deg[x]) if deg[x] else p0(w)
    p3 = lambda x, y, w: (b3[(x, y), w] + deg3[x, y] * p(y, w)) / (tot3[x, y] + deg3[x, y]) if deg3[x, y] else p(y, w)
    for i, w in tok:
        q = [p(None, w[0]), *(p3(x, y, z) for x, y, z in zip([None, *w[:-2]], w, w[1:]))]
        yield i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), sum(map(math.log10, q))


def test_lm_against_brute_force(spark):
    rows = odd_rows() + [(30 + k, prose(40 + k, k % 5).title()) for k in range(20)]
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else True
    docs = odd_docs(spark, rows)
    model = ngram_lm.train(docs.where(~langid.held_out(F.col("doc_id"), 5)))
    got = sorted(ngram_lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[5]))
    want = sorted(brute_lm(rows, train), key=lambda r: (r[0] is not None, r[0] or 0, r[5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:4]) == w[:4]
        assert abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert abs(g[5] - w[5]) < 0.06 * w[1]  # code books


def test_lm_holds_different_pairs_alone(tmp_path, monkeypatch):
    """A hundred blocks of one context with the same successors take the room of a few, and give the file of their sum."""
    monkeypatch.setattr(ngram_lm, "HELD_PAIRS", 50_000)
    monkeypatch.setattr(ngram_lm, "new_name", lambda folder, name, end: f"{folder}/{name}{end}")
    made = []
    monkeypatch.setattr(ngram_lm, "write", lambda path, data: made.append(data))

    class Vocabulary:
        size, tokens = 20_000, 2_000_000
        counts = staticmethod(lambda ids: np.full(len(ids), 100))
        log_p0 = staticmethod(lambda counts: np.full(len(counts), -4.0))

    w = np.arange(20_000, dtype="<u4")
    block = lambda n: pa.record_batch([pa.array([0], pa.int32()), *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (0 * w, w, 0 * w + n))], names=["shard", "v", "w", "n"])
    run = ngram_lm._build(str(tmp_path), "pairs", 20_000, 20_000, Vocabulary)
    list(run(iter([block(300)])))
    tracemalloc.start()
    list(run(block(3) for _ in range(100)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made[0] == made[1]
    assert peak < 12e6, peak


def test_lm_shards_agree(spark, monkeypatch):
    """One shard of pairs, three and about a thousand give the same scores, few levels open or many."""
    docs, got, sums = odd_docs(spark), [], []
    for tokens, levels in ((1 << 40, 256), (12_000, 2), (33, 5)):
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
        monkeypatch.setattr(ngram_lm, "OPEN_LEVELS", levels)
        monkeypatch.setattr(ngram_lm, "parallelism", lambda spark: 1 if tokens > 100 else 8)
        model = ngram_lm.train(docs)
        texts = pa.array([t for _, t in odd_rows()], pa.string())
        t = ngram_lm.Tokens(texts)
        ids, counts = model.vocabulary.lookup(t.hash)
        order = np.lexsort((t.codes, ids[t.before()]))
        v, w = ids[t.before()][order], ids[t.codes][order]
        got.append((model.pairs.shards, dict(zip(zip(v.tolist(), w.tolist()), model.pairs.find(v, w, model.vocabulary.log_p0(counts)[t.codes][order])[0].tolist()))))
        assert len(model.pairs._levels) <= levels
        sums.append(ngram_lm.Found(t, model.vocabulary, model.pairs).scores(model.triples))
        assert len(model.triples._levels) <= levels and model.triples.size > model.pairs.size / 2
    assert [n for n, _ in got][0] == 1 and got[1][0] >= 3 and got[2][0] >= 900
    for other in sums[1:]:
        assert np.abs(other - sums[0]).max() < 0.5 and abs(other.sum() - sums[0].sum()) < 0.01 * abs(sums[0].sum())
    name = [dict(sorted(x.items())) for _, x in got]
    assert name[0].keys() == name[1].keys() == name[2].keys()
    for other in name[1:]:
        assert max(abs(name[0][k] - other[k]) for k in name[0]) < 0.5 and abs(sum(name[0].values()) - sum(other.values())) < 0.01 * abs(sum(name[0].values()))


def test_lm_refuses_what_ids_do_not_hold(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MOST_WORDS", 10)
    with pytest.raises(ValueError):
        ngram_lm.train(odd_docs(spark))


def test_registered_lm_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for i, n, known, total, base, score in brute_lm(rows, lambda i: not held(i)):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i), n, known, total)
        assert abs(g.base_score - base) < 1e-6 * abs(base) and abs(g.score - score) < 0.06 * n


def test_lm_prefers_its_own_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 5)
    s = ngram_lm.score(docs, ngram_lm.train(docs.where(~held))).where(held).agg(F.sum("base_score").alias("b"), F.sum("score").alias("m")).first()
    assert s.m > s.b


def test_lm_on_nothing(spark):
    model = ngram_lm.train(empty_docs(spark))
    assert ngram_lm.score(empty_docs(spark), model).count() == 0
    assert {r.score for r in ngram_lm.score(odd_docs(spark), model).collect()} == {0.0}


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Rows go into the sample in their order while their features fit, and a model comes out whatever the bound is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = quality_bayes.fit(docs, labels)
    monkeypatch.setattr(quality_bayes, "MAX_SAMPLE_BYTES", 60_000)
    part = quality_bayes.fit(docs, labels)
    assert set(whole.parts) == {"bad", "toxic"}
    assert sum(len(p[2]) for p in part.parts.values()) < sum(len(p[2]) for p in whole.parts.values())
    monkeypatch.setattr(quality_bayes, "MAX_SAMPLE_BYTES", 0)
    assert quality_bayes.fit(docs, labels).parts == {}
