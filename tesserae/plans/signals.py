"""Queries over vectors as signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import signal as S
from ..session import table


@query("vector_metrics", """SELECT vec_id, round(sqrt(sum(x * x) / count(*)), 4) AS rms, round(max(abs(x)), 4) AS peak, CAST(count(*) FILTER (abs(x) >= 0.15) AS INTEGER) AS clipped
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""")
def vector_metrics(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.rms(e), 4).alias("rms"), F.round(S.peak(e), 4).alias("peak"), S.clipped(e, 0.15).alias("clipped"))


@query("vector_gain_normalize", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, max(0) OVER () AS z FROM embeddings), p AS (SELECT vec_id, max(abs(x)) AS p, sum(abs(x)) AS s FROM x GROUP BY vec_id)
  SELECT vec_id, round(pow(10, -3 / 20e0), 4) AS peak, round(s / p * pow(10, -3 / 20e0), 3) AS total FROM p""")
def vector_gain_normalize(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select("vec_id", S.normalize_peak(F.col("embedding"), -3.0).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda acc, v: acc + F.abs(v))
    return n.select("vec_id", F.round(S.peak(F.col("n")), 4).alias("peak"), F.round(total, 3).alias("total"))


@query("overlay_sum", """SELECT label, vec_id % 50 + i - 1 AS sample_idx, round(sum(embedding[i]::DOUBLE), 4) AS value FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2""")
def overlay_sum(spark, sf_dir):
    tracks = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 50).alias("at"))
    return S.overlay_sum(tracks, "label", "embedding", "at").withColumn("value", F.round("value", 4))


@query("mean_vector_corr", """WITH x AS (SELECT label, i, embedding[i]::DOUBLE AS v FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2)
  SELECT a.label AS label_a, b.label AS label_b, round(corr(a.v, b.v), 4) AS correlation FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def mean_vector_corr(spark, sf_dir):
    flat = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = flat.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = (m.select(F.col("label").alias(f"label_{x}"), "i", F.col("v").alias(f"v_{x}")) for x in "ab")
    return a.join(b, "i").where("label_a < label_b").groupBy("label_a", "label_b").agg(F.round(F.corr("v_a", "v_b"), 4).alias("correlation"))


@query("label_spread", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(max(v) - min(v), 4) AS span, round(20 * log10(greatest(max(abs(v)), 1e-10)), 2) AS peak_db FROM x GROUP BY 1""")
def label_spread(spark, sf_dir):
    flat = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return flat.groupBy("label").agg(
        F.round(F.avg("v"), 4).alias("mean"),
        F.round(F.stddev_pop("v"), 4).alias("std"),
        F.round(F.max("v") - F.min("v"), 4).alias("span"),
        F.round(20 * F.log10(F.greatest(F.max(F.abs("v")), F.lit(1e-10))), 2).alias("peak_db"),
    )


@query("faded_vectors", """SELECT vec_id, round(sum(x * least((i - 1) / 15e0, 1)), 4) AS faded FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id""")
def faded_vectors(spark, sf_dir):
    faded = table(spark, sf_dir, "embeddings").select("vec_id", S.fade_in(F.col("embedding").cast("array<double>"), 16).alias("f"))
    return faded.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 4).alias("faded"))


#: Frames of 64 samples, 16 apart, of a signal of 64 samples at 2205 Hz: their samples, spectra and, on these, eight mel bands.
FRAMES_SQL = """f AS (SELECT vec_id, embedding AS e, unnest(range(5)) AS f FROM embeddings WHERE len(embedding) > 0), g AS (SELECT *, unnest(range(64)) AS i FROM f),
  s AS (SELECT vec_id, f, i, CASE WHEN f * 16 + i BETWEEN 32 AND 95 THEN e[f * 16 + i - 31]::DOUBLE ELSE 0 END AS v, e[least(greatest(f * 16 + i - 31, 1), 64)]::DOUBLE AS edged FROM g)"""
SPECTRA_SQL = f"""{FRAMES_SQL}, w AS (SELECT vec_id, f, i, v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM s WHERE v <> 0),
  m AS (SELECT vec_id, f, k, k * 2205 / 64e0 AS hz, sqrt(pow(sum(v * cos(2 * pi() * i * k / 64)), 2) + pow(sum(v * sin(2 * pi() * i * k / 64)), 2)) AS m FROM w, (SELECT unnest(range(33)) AS k) GROUP BY ALL)"""
MEL_SQL = f"""{SPECTRA_SQL}, b AS (SELECT b, list_transform([b, b + 1, b + 2], lambda c: 700 * (pow(10, c * log10(1 + 1102.5 / 700) / 9) - 1)) AS c FROM (SELECT unnest(range(8)) AS b)),
  l AS (SELECT vec_id, f, b, 10 * log10(greatest(sum(m * m * greatest(0, least((hz - c[1]) / (c[2] - c[1]), (c[3] - hz) / (c[3] - c[2])))), 1e-10)) AS level FROM m, b GROUP BY ALL)"""


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    return e.select("vec_id", S.audio_features(F.col("embedding"), 2205.0, frame=64, hop=16, bands=8, coefficients=5).alias("s")).select("vec_id", "s.*")


def _rounded(df, digits, *columns):
    return df.select("vec_id", *[F.round(c, digits).alias(c) for c in columns])


@query("spectral_features", f"""WITH {SPECTRA_SQL}, c AS (SELECT *, sum(m) OVER (PARTITION BY vec_id, f ORDER BY k) AS c, sum(m) OVER (PARTITION BY vec_id, f) AS t FROM m),
  p AS (SELECT vec_id, f, sum(hz * m) / sum(m) AS centroid, min(hz) FILTER (c >= 0.85 * t) AS rolloff FROM c GROUP BY ALL),
  z AS (SELECT vec_id, f, i, v, (edged < 0) <> lag(edged < 0) OVER (PARTITION BY vec_id, f ORDER BY i) AS crossed FROM s),
  q AS (SELECT vec_id, f, count(*) FILTER (crossed) / 64e0 AS crossings, 20 * log10(greatest(sqrt(sum(v * v) / 64), 1e-10)) < -60 AS silent FROM z GROUP BY ALL)
  SELECT vec_id, round(avg(silent::INT), 4) AS silence_ratio, round(avg(centroid), 4) AS centroid, round(avg(rolloff), 4) AS rolloff, round(avg(crossings), 4) AS zero_crossings FROM p JOIN q USING (vec_id, f) GROUP BY 1""")
def spectral_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir), 4, "silence_ratio", "centroid", "rolloff", "zero_crossings")


@query("chroma_variance", f"""WITH {SPECTRA_SQL}, c AS (SELECT vec_id, f, round(12 * log2(hz / 440) + 69)::INT % 12 AS c, sum(m * m) AS p FROM m WHERE hz >= 27.5 GROUP BY ALL),
  n AS (SELECT vec_id, c, p / max(p) OVER (PARTITION BY vec_id, f) AS p FROM c), v AS (SELECT vec_id, c, var_pop(p) AS v FROM n GROUP BY ALL)
  SELECT vec_id, round(sum(v) / 12, 5) AS chroma_variance FROM v GROUP BY 1""")
def chroma_variance(spark, sf_dir):
    return _rounded(_features(spark, sf_dir), 5, "chroma_variance")


@query("onset_strength", f"""WITH {MEL_SQL}, r AS (SELECT vec_id, f, level - lag(level) OVER (PARTITION BY vec_id, b ORDER BY f) AS rise FROM l),
  o AS (SELECT vec_id, f, avg(greatest(coalesce(rise, 0), 0)) AS o FROM r GROUP BY ALL) SELECT vec_id, round(max(o), 4) AS onset_max, round(avg(o), 4) AS onset_mean FROM o GROUP BY 1""")
def onset_strength(spark, sf_dir):
    return _rounded(_features(spark, sf_dir), 4, "onset_max", "onset_mean")


@query("cepstral_means", f"""WITH {MEL_SQL}, a AS (SELECT vec_id, b, avg(level) AS level FROM l GROUP BY ALL)
  SELECT vec_id, k AS coefficient, round(sum(level * cos(pi() / 8 * k * (b + 0.5))) * CASE k WHEN 0 THEN sqrt(1 / 8e0) ELSE 0.5 END, 4) AS mean FROM a, (SELECT unnest(range(5))::INT AS k) GROUP BY vec_id, k""")
def cepstral_means(spark, sf_dir):
    flat = _features(spark, sf_dir).select("vec_id", F.posexplode("mfcc").alias("coefficient", "mean"))
    return flat.withColumn("mean", F.round("mean", 4))


@query("pitch_stats", f"""WITH {FRAMES_SQL}, r AS (SELECT a.vec_id, a.f, lag, sum(a.v * coalesce(b.v, 0)) AS r FROM (SELECT *, unnest(range(35)) AS lag FROM s) a LEFT JOIN s b ON a.vec_id = b.vec_id AND a.f = b.f AND b.i = a.i + a.lag GROUP BY ALL),
  n AS (SELECT *, r / nullif(max(r) FILTER (lag = 0) OVER (PARTITION BY vec_id, f), 0) AS r0, lag(r) OVER w AS x, lead(r) OVER w AS z FROM r WINDOW w AS (PARTITION BY vec_id, f ORDER BY lag)),
  t AS (SELECT * FROM n WHERE lag BETWEEN 2 AND 33 QUALIFY row_number() OVER (PARTITION BY vec_id, f ORDER BY r DESC, lag) = 1),
  p AS (SELECT vec_id, CASE WHEN r0 >= 0.3 THEN 2205 / (lag + CASE WHEN x - 2 * r + z < 0 THEN greatest(least(0.5 * (x - z) / (x - 2 * r + z), 0.5), -0.5) ELSE 0 END) END AS hz FROM t)
  SELECT vec_id, round(coalesce(avg(hz), 0), 3) AS pitch_mean, round(coalesce(stddev_pop(hz), 0), 3) AS pitch_std, round(coalesce(max(hz) - min(hz), 0), 3) AS pitch_range, count(hz) / count(*) AS voiced_ratio FROM p GROUP BY 1""")
def pitch_stats(spark, sf_dir):
    return _rounded(_features(spark, sf_dir), 3, "pitch_mean", "pitch_std", "pitch_range", "voiced_ratio")


@query("voiced_gaps", """WITH f AS (SELECT vec_id, embedding AS e, len(embedding) AS n, unnest(range(len(embedding) // 4 + 1)) AS f FROM embeddings WHERE len(embedding) > 0), g AS (SELECT *, unnest(range(f * 4 - 8, f * 4 + 8)) AS i FROM f),
  r AS (SELECT vec_id, n, f, greatest(sqrt(sum(CASE WHEN i BETWEEN 0 AND n - 1 THEN e[i + 1]::DOUBLE * e[i + 1]::DOUBLE ELSE 0 END) / 16), 1e-5) AS r FROM g GROUP BY ALL),
  l AS (SELECT *, r > max(r) OVER (PARTITION BY vec_id) * pow(10, -3 / 20e0) AS loud FROM r), k AS (SELECT *, f - row_number() OVER (PARTITION BY vec_id ORDER BY f) AS k FROM l WHERE loud)
  SELECT vec_id, CAST(min(f) * 4 AS INT) AS start, CAST(least(max(f) * 4 + 4, any_value(n)) AS INT) AS end FROM k GROUP BY vec_id, k HAVING min(f) * 4 < any_value(n)""")
def voiced_gaps(spark, sf_dir):
    i = S.voiced_intervals(F.col("embedding"), top_db=3, frame=16, hop=4)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(i).alias("i")).select("vec_id", "i.start", "i.end")


@query("ducked_mix", """WITH s AS (SELECT label, vec_id % 50 + i - 1 AS sample_idx, sum(embedding[i]::DOUBLE) AS value FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
  r AS (SELECT DISTINCT label, label % 5 * 10 AS a, label % 5 * 10 + 30 AS b FROM embeddings)
  SELECT s.label, sample_idx, round(value * CASE WHEN sample_idx < a OR sample_idx >= b THEN 1 WHEN sample_idx - a < 8 THEN 1 - (1 - pow(10, -14 / 20e0)) * (sample_idx - a) / 8
    WHEN sample_idx - a >= 22 THEN pow(10, -14 / 20e0) + (1 - pow(10, -14 / 20e0)) * (sample_idx - a - 22) / 8 ELSE pow(10, -14 / 20e0) END, 4) AS value FROM s JOIN r USING (label)""")
def ducked_mix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mixed = S.overlay_sum(e.select("label", "embedding", (F.col("vec_id") % 50).alias("at")), "label", "embedding", "at")
    start = (F.col("label") % 5 * 10).cast("bigint")
    ranges = e.select("label").distinct().select("label", start.alias("start"), (start + 30).alias("end"), F.lit(-14.0).alias("depth_db"), F.lit(8).alias("fade"))
    return S.apply_ducking(mixed, ranges, "label").withColumn("value", F.round("value", 4))
