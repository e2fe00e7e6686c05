"""Signal and numeric queries; embeddings play the waveform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as S
from ..session import ship
from .registry import query, table

_X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS s FROM embeddings)"
_SUM = "list_sum(list_transform({0}, lambda v: v * v))"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("s"))


@query("signal_stats", f"WITH {_X} SELECT vec_id, round(sqrt({_SUM.format('s')} / len(s)), 6) AS rms, round(20 * log10(sqrt({_SUM.format('s')} / len(s))), 4) AS dbfs, round(list_max(list_transform(s, lambda v: abs(v))), 6) AS peak, round(len(list_filter(s, lambda v: abs(v) >= 0.25)) / len(s), 6) AS clipped FROM x")
def signal_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    return _samples(spark, sf).select("vec_id", F.round(S.rms(s), 6).alias("rms"), F.round(S.decibels(S.rms(s)), 4).alias("dbfs"), F.round(S.peak(s), 6).alias("peak"), F.round(S.share_above(s, 0.25), 6).alias("clipped"))


@query("frame_energy", f"WITH {_X}, f AS (SELECT vec_id, k, list_slice(s, k * 16 + 1, k * 16 + 16) AS f FROM x, (SELECT unnest(range(0, 4)) AS k)) SELECT vec_id, CAST(k AS INT) AS frame, round(sqrt({_SUM.format('f')} / 16), 6) AS rms FROM f")
def frame_energy(spark: SparkSession, sf: str) -> DataFrame:
    f = _samples(spark, sf).select("vec_id", F.posexplode(S.frames(F.col("s"), 16)).alias("frame", "f"))
    return f.select("vec_id", "frame", F.round(S.rms(F.col("f")), 6).alias("rms"))


@query("edge_fade", f"WITH {_X}, f AS (SELECT vec_id, list_transform(s, lambda v, i: v * least(1.0, (i - 1) / 8.0, (len(s) - i) / 8.0)) AS f FROM x) SELECT vec_id, round(list_sum(f), 6) AS total, round(list_sum(list_transform(f, lambda v: abs(v))), 6) AS absolute, f[1] = 0 AND f[64] = 0 AS closed FROM f")
def edge_fade(spark: SparkSession, sf: str) -> DataFrame:
    f = _samples(spark, sf).select("vec_id", S.fade(F.col("s"), 8).alias("f"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return f.select("vec_id", F.round(total(F.col("f")), 6).alias("total"), F.round(total(F.transform("f", lambda x: F.abs(x))), 6).alias("absolute"), ((F.element_at("f", 1) == 0) & (F.element_at("f", -1) == 0)).alias("closed"))


@query("peak_limit", f"WITH {_X}, p AS (SELECT vec_id, s, list_max(list_transform(s, lambda v: abs(v))) AS p FROM x) SELECT vec_id, p > 0.25 AS limited, round(list_sum(list_transform(s, lambda v: abs(CASE WHEN p > 0.25 THEN v * 0.25 / p ELSE v END))), 6) AS absolute FROM p")
def peak_limit(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    total = F.aggregate(S.limit(s, 0.25), F.lit(0.0), lambda a, x: a + F.abs(x))
    return _samples(spark, sf).select("vec_id", (S.peak(s) > 0.25).alias("limited"), F.round(total, 6).alias("absolute"))


@query("trim_edges", f"""WITH {_X}, u AS (SELECT vec_id, unnest(s) AS v, unnest(range(1, len(s) + 1)) AS i FROM x), b AS (SELECT vec_id, min(i) AS a, max(i) AS b FROM u WHERE abs(v) >= 0.15 GROUP BY vec_id)
    SELECT x.vec_id, CAST(coalesce(b.b - b.a + 1, 0) AS BIGINT) AS kept FROM x LEFT JOIN b USING (vec_id)""")
def trim_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("vec_id", F.size(S.trim(F.col("s"), 0.15)).cast("long").alias("kept"))


@query("crossfade_mix", f"""WITH {_X}, p AS (SELECT a.vec_id, a.s AS a, b.s AS b FROM x a JOIN x b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_sum(list_slice(a, 1, 60)) + list_sum(list_transform(range(1, 5), lambda i: a[60 + i] * (1 - i / 5.0) + b[i] * (i / 5.0))) + list_sum(list_slice(b, 5, 64)), 6) AS total, CAST(124 AS BIGINT) AS n FROM p""")
def crossfade_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours joined with an overlap of four samples."""
    x = _samples(spark, sf)
    p = x.select("vec_id", F.col("s").alias("a")).join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("b")), "vec_id")
    m = p.select("vec_id", S.crossfade(F.col("a"), F.col("b"), 4).alias("m"))
    return m.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("m").cast("long").alias("n"))


#: Vectors that are one clip, and the rate they are taken to have.
CLIP, RATE = 32, 2000


#: A tone that differs from vector to vector is added to its samples, which are noise.
_TONE_SQL = f"list_transform(s, lambda v, j: v + 0.3 * sin(2 * pi() * (80 + 5 * (vec_id % 32)) * (j - 1) / {RATE}))"


@query("pitch_spread", f"""WITH {_X}, c AS (SELECT vec_id // {CLIP} AS clip, flatten(list({_TONE_SQL} ORDER BY vec_id)) AS s FROM x GROUP BY ALL), n AS (SELECT *, greatest(0, (len(s) - 256) // 128 + 1) AS n FROM c),
    f AS (SELECT clip, unnest(list_transform(range(n), lambda k: list_slice(s, k * 128 + 1, k * 128 + 256))) AS f, unnest(range(n)) AS k FROM n),
    l AS (SELECT *, 10 * log10(list_sum(list_transform(f, lambda v: v * v)) / 256 + 1e-12) AS db, list_sum(f) / 256 AS m FROM f), w AS (SELECT clip, k, db, list_transform(f, lambda v, i: (v - m) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 255))) AS w FROM l),
    a AS (SELECT clip, k, db, unnest(range(0, 29)) AS lag, w FROM w), r AS (SELECT clip, k, db, lag, list_sum(list_transform(range(1, 257 - lag), lambda i: w[i] * w[i + lag])) AS ac FROM a),
    p AS (SELECT clip, k, max(db) AS db, arg_max(lag, (ac, -lag)) FILTER (lag >= 5) AS lag, max(ac) FILTER (lag >= 5) / max(ac) FILTER (lag = 0) AS height FROM r GROUP BY clip, k),
    v AS (SELECT clip, {RATE}.0 / lag AS f0 FROM p WHERE db >= -38 AND height >= 0.25 AND {RATE}.0 / lag BETWEEN 70 AND 350),
    s AS (SELECT clip, median(f0) AS m, count(*) AS n FROM v GROUP BY clip), d AS (SELECT clip, s.n, round(stddev_pop(12 * log2(f0 / m)), 6) AS semitones FROM v JOIN s USING (clip) GROUP BY clip, s.n)
    SELECT CAST(clip AS BIGINT) AS clip, CAST(n.n AS INT) AS n_frames, CAST(coalesce(d.n, 0) AS INT) AS n_voiced, CASE WHEN d.n >= 4 THEN semitones END AS semitones FROM n LEFT JOIN d USING (clip)""")
def pitch_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch of every frame of a clip, and its population deviation in semitones about the median."""
    tone = lambda j: 0.3 * F.sin(2 * F.pi() * (80 + 5 * (F.col("vec_id") % 32)) * j / RATE)
    x = _samples(ship(spark), sf).select("vec_id", F.transform("s", lambda v, j: v + tone(j)).alias("s"))
    clips = x.groupBy(F.expr(f"vec_id div {CLIP}").alias("clip")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "s"))).alias("parts"))
    f = clips.select("clip", S.pitch(RATE)(F.flatten(F.transform("parts", lambda x: x["s"]))).alias("f0"))
    return f.select("clip", F.size("f0").alias("n_frames"), F.size(F.array_compact("f0")).alias("n_voiced"), F.round(S.semitone_spread(F.col("f0")), 6).alias("semitones"))


@query("minmax_ratio", "WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand) SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE 0 END, 6) AS ratio FROM part JOIN r USING (p_brand)")
def minmax_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    r = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    ratio = F.when(F.col("hi") > F.col("lo"), (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return p.join(r, "p_brand").select("p_partkey", F.round(ratio, 6).alias("ratio"))


POINTS = [0.3, 0.45, 0.6, 0.75, 0.9]


@query("nearest_calibration", f"WITH c AS (SELECT unnest({POINTS}) AS k), v AS (SELECT event_id, value / 100 AS v FROM events) SELECT event_id, CAST(arg_min(k, (abs(v - k), k)) AS DOUBLE) AS key FROM v, c GROUP BY event_id")
def nearest_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest calibrated key, ties to the smaller. The keys are a short fixed list, compared in place."""
    v = F.col("value") / 100
    near = F.array_min(F.array(*(F.struct(F.abs(v - k).alias("d"), F.lit(k).alias("k")) for k in POINTS)))
    return table(spark, sf, "events").select("event_id", near["k"].alias("key"))


@query("number_guard", "SELECT event_id, CASE WHEN value BETWEEN 1 AND 60 AND event_id % 50 <> 0 THEN value END AS guarded FROM events")
def number_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Finite numbers in range; anything else is null."""
    v = F.when(F.col("event_id") % 50 == 0, F.lit("nan")).otherwise(F.col("value").cast("string"))
    x = v.try_cast("double")
    return table(spark, sf, "events").select("event_id", F.when(~F.isnan(x) & x.between(1, 60), x).alias("guarded"))


@query("speech_rate", "SELECT conv_id, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, round(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) / greatest(sum(length(text)) / 900.0, 0.000001), 4) AS wpm FROM conversations GROUP BY conv_id")
def speech_rate(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as X

    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("n"))
    return g.select("conv_id", "words", F.round(F.col("words") / F.greatest(F.col("n") / 900.0, F.lit(1e-6)), 4).alias("wpm"))
