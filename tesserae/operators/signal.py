"""Numeric arrays: metrics, gain, fades, overlay sums, ducking. Array functions stay in the JVM; spectra go through pandas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from .ordered import gap_to_next


def _sum(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def rms(x: Column) -> Column:
    return F.sqrt(_sum(x, lambda v: v * v) / F.size(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def clipped(x: Column, at: float = 0.99) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) >= at))


def gain(x: Column, db: float) -> Column:
    return F.transform(x, lambda v: v.cast("double") * 10 ** (db / 20))


def fit_length(x: Column, n: int) -> Column:
    """Padded with zeros or cut to n samples."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def fade_in(x: Column, n: int) -> Column:
    return F.transform(x, lambda v, i: v * F.least(i / F.lit(float(max(n - 1, 1))), F.lit(1.0)))


def fade_out(x: Column, n: int) -> Column:
    size = F.size(x)
    return F.transform(x, lambda v, i: v * F.least((size - 1 - i) / F.lit(float(max(n - 1, 1))), F.lit(1.0)))


def normalize_peak(x: Column, db: float) -> Column:
    """Scaled so that the largest sample is at `db`; silence stays."""
    top = peak(x)
    return F.transform(x, lambda v: F.when(top > 0, v.cast("double") / top * 10 ** (db / 20)).otherwise(v.cast("double")))


def clamp(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)))


def overlay_sum(tracks: DataFrame, group: str, samples: str, offset: str) -> DataFrame:
    """(group, sample_idx, value): tracks added up at their offsets; one combining shuffle, no canvas."""
    flat = tracks.select(group, F.col(offset).alias("__at"), F.posexplode(samples).alias("__i", "__v"))
    return flat.groupBy(group, (F.col("__at") + F.col("__i")).alias("sample_idx")).agg(F.sum(F.col("__v").cast("double")).alias("value"))


def duck_gain(sample: Column, start: Column, end: Column, depth_db: Column, fade: Column) -> Column:
    """Gain of one sample inside a ducked range [start, end): ramps of min(fade, n / 3) samples if n > 2 * fade, else one ramp down."""
    n, low = end - start, F.pow(F.lit(10.0), depth_db / 20)
    ramp = F.greatest(F.least(fade, F.floor(n / 3)), F.lit(1))
    at = sample - start
    down, up = 1 - (1 - low) * at / ramp, low + (1 - low) * (at - (n - ramp)) / ramp
    long = F.when(at < ramp, down).when(at >= n - ramp, up).otherwise(low)
    return F.when((sample < start) | (sample >= end), F.lit(1.0)).when(n > 2 * fade, long).otherwise(1 - (1 - low) * at / F.greatest(n - 1, F.lit(1)))


def apply_ducking(samples: DataFrame, ranges: DataFrame, group: str, depth_db: str = "depth_db", fade: str = "fade", width: int = 4096) -> DataFrame:
    """samples (group, sample_idx, value) times the gains of all ranges (group, start, end, depth_db, fade) that cover them; overlaps
    multiply. Ranges are repeated for each bucket of `width` samples they meet."""
    buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    r = ranges.where("end > start").select(F.col(group).alias("__g"), "start", "end", F.col(depth_db).alias("__d"), F.col(fade).alias("__f"), F.explode(buckets).alias("__b"))
    s = samples.withColumn("__bucket", F.floor(F.col("sample_idx") / width))
    hit = s.join(r, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")) & (F.col("sample_idx") >= F.col("start")) & (F.col("sample_idx") < F.col("end")), "left")
    factor = F.coalesce(duck_gain(F.col("sample_idx"), F.col("start"), F.col("end"), F.col("__d"), F.col("__f")), F.lit(1.0))
    log = F.sum(F.log(F.greatest(factor, F.lit(1e-12))))
    return hit.groupBy(group, "sample_idx").agg((F.first("value") * F.exp(log)).alias("value"))


def mix(layers: DataFrame, group: str, mode: str) -> DataFrame:
    """(group, sample_idx, value) of the layers that a mode holds: voice, music, music_fx, full."""
    held = {"voice": ["voice"], "music": ["music"], "music_fx": ["music", "ambient", "spot", "accent"], "full": ["voice", "music", "ambient", "spot", "accent"]}[mode]
    return layers.where(F.col("layer").isin(held)).groupBy(group, "sample_idx").agg(F.sum("value").alias("value"))


def pause_stats(intervals: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, least: float = 0.05) -> DataFrame:
    """(keys, pauses, mean, longest): gaps of more than `least` between each interval and the next one in order."""
    gaps = intervals.select(*keys, gap_to_next(F.col(start), F.col(end), keys, order).alias("gap")).where(F.col("gap") > least)
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("pauses"), F.avg("gap").alias("mean"), F.max("gap").alias("longest"))


def _framed(x: np.ndarray, frame: int, hop: int, mode: str = "constant") -> np.ndarray:
    """Centred frames as views, without a copy."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, frame // 2, mode=mode), frame)[::hop]


def frame_rms(x: np.ndarray, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """RMS of centred, zero-padded frames."""
    padded = np.pad(np.asarray(x, np.float64), frame // 2)
    starts = np.arange(0, max(len(padded) - frame, 0) + 1, hop)
    power = np.concatenate([[0.0], np.cumsum(padded * padded)])
    return np.sqrt(np.maximum(power[np.minimum(starts + frame, len(padded))] - power[starts], 0) / frame)


def _mel_filters(freq: np.ndarray, bands: int) -> np.ndarray:
    """Triangles with equally spaced corners on the mel scale, as a matrix of (frequency, band)."""
    corner = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + freq[-1] / 700), bands + 2) / 2595) - 1)
    low, mid, high, f = corner[:-2], corner[1:-1], corner[2:], freq[:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


def _pitches(block: np.ndarray, rate: float, low: float, high: float, voiced: float) -> np.ndarray:
    """Pitch of each frame by its largest autocorrelation, the peak interpolated by a parabola; NaN where that is below `voiced`."""
    n = block.shape[1]
    r = np.fft.irfft(np.abs(np.fft.rfft(block, 2 * n, axis=1)) ** 2, axis=1)[:, :n]
    first, last = max(1, int(np.ceil(rate / high))), min(n - 2, int(rate / low))
    if first > last:
        return np.full(len(block), np.nan)
    r, row = r / np.where(r[:, :1] > 0, r[:, :1], np.inf), np.arange(len(block))
    lag = first + r[:, first : last + 1].argmax(axis=1)
    before, top, after = r[row, lag - 1], r[row, lag], r[row, lag + 1]
    bend = before - 2 * top + after
    shift = np.clip(np.divide(0.5 * (before - after), bend, out=np.zeros(len(block)), where=bend < 0), -0.5, 0.5)
    return np.where(top >= voiced, rate / (lag + shift), np.nan)


def _features(x: np.ndarray, rate: float, frame: int, hop: int, bands: int, coefficients: int, low: float, high: float, voiced: float) -> dict:
    freq = np.fft.rfftfreq(frame, 1 / rate)
    window, mel = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame), _mel_filters(freq, bands)
    tone = freq >= 27.5  # the lowest key of a piano; what lies below has no pitch class
    classes = np.zeros((len(freq), 12))
    classes[tone, np.round(12 * np.log2(freq[tone] / 440) + 69).astype(int) % 12] = 1
    views, edged = _framed(x, frame, hop), _framed(x, frame, hop, "edge")
    centroid, rolloff, crossings, chroma, levels, pitch = ([] for _ in range(6))
    for k in range(0, len(views), 256):  # a bounded number of frames at a time
        block = views[k : k + 256]
        m = np.abs(np.fft.rfft(block * window, axis=1))
        sums, total = np.cumsum(m, axis=1), m.sum(axis=1)
        centroid.append(np.divide(m @ freq, total, out=np.zeros(len(m)), where=total > 0))
        rolloff.append(freq[(sums >= 0.85 * sums[:, -1:]).argmax(axis=1)])
        crossings.append((np.diff(np.signbit(edged[k : k + 256]), axis=1)).sum(axis=1) / frame)
        c = m**2 @ classes
        top = c.max(axis=1, keepdims=True)
        chroma.append(np.divide(c, top, out=np.zeros_like(c), where=top > 0))
        levels.append(10 * np.log10(np.maximum(m**2 @ mel, 1e-10)))
        pitch.append(_pitches(block, rate, low, high, voiced))
    level, found = np.concatenate(levels), np.concatenate(pitch)
    onset = np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).mean(axis=1)])
    turn = np.cos(np.pi / bands * np.outer(np.arange(coefficients), np.arange(bands) + 0.5)) * np.sqrt(2 / bands)
    turn[0] /= np.sqrt(2)
    f0 = found[~np.isnan(found)]
    return {
        "silence_ratio": float((20 * np.log10(np.maximum(frame_rms(x, frame, hop), 1e-10)) < -60).mean()),
        "centroid": float(np.concatenate(centroid).mean()),
        "rolloff": float(np.concatenate(rolloff).mean()),
        "zero_crossings": float(np.concatenate(crossings).mean()),
        "chroma_variance": float(np.concatenate(chroma).var(axis=0).mean()),
        "onset_max": float(onset.max()),
        "onset_mean": float(onset.mean()),
        "mfcc": (turn @ level.mean(axis=0)).tolist(),
        "pitch_mean": float(f0.mean()) if len(f0) else 0.0,
        "pitch_std": float(f0.std()) if len(f0) else 0.0,
        "pitch_range": float(np.ptp(f0)) if len(f0) else 0.0,
        "voiced_ratio": len(f0) / len(found),
    }


_NUMBERS = ("silence_ratio", "centroid", "rolloff", "zero_crossings", "chroma_variance", "onset_max", "onset_mean", "pitch_mean", "pitch_std", "pitch_range", "voiced_ratio")


def audio_features(
    x: Column, rate: float, frame: int = 2048, hop: int = 512, bands: int = 40, coefficients: int = 13, low: float = 65.41, high: float = 2093.0, voiced: float = 0.3
) -> Column:
    """A struct of features over centred frames (Hann window for the spectra): share of frames under -60 dB; means of spectral centroid,
    85 % roll-off and zero-crossing rate; variance in time of the twelve pitch classes (each frame scaled to its largest); onset
    strength (mean rise of the mel bands in dB) at most and on average; mean cepstral coefficients; and mean, deviation,
    range and share of frames with a pitch (`low` to `high` Hz, 0 without any). Null for a null or empty signal."""

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = [None if v is None or not len(v) else _features(np.asarray(v, np.float64), rate, frame, hop, bands, coefficients, low, high, voiced) for v in batch]
        return pd.DataFrame([r or dict.fromkeys((*_NUMBERS, "mfcc")) for r in rows], columns=[*_NUMBERS, "mfcc"])

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    kind = K.StructType([*(K.StructField(c, K.DoubleType()) for c in _NUMBERS), K.StructField("mfcc", K.ArrayType(K.DoubleType()))])
    return F.pandas_udf(run, kind)(x)


def voiced_intervals(x: Column, top_db: float = 30, frame: int = 2048, hop: int = 512) -> Column:
    """An array of (start, end): runs of frames within `top_db` of the loudest, as samples. Empty for a null or empty signal; a silent signal is
    as loud as its loudest frame throughout."""

    def run(batch: pd.Series) -> pd.Series:
        out = []
        for v in batch:
            n = 0 if v is None else len(v)
            level = np.maximum(frame_rms(v, frame, hop), 1e-5) if n else np.zeros(0)
            loud = np.concatenate([[False], level > level.max(initial=0) * 10 ** (-top_db / 20), [False]])
            edge = np.minimum(np.flatnonzero(np.diff(loud.astype(np.int8))) * hop, n)
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True) if b > a])
        return pd.Series(out)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, K.ArrayType(K.StructType([K.StructField(c, K.IntegerType()) for c in ("start", "end")])))(x)


def asset_flags(clip: Column, silence: Column, rms_db: Column, peak_db: Column, duration: Column, wanted: Column) -> Column:
    """Names of the quality flags of an asset, in order; `OK` if none."""
    from .quality import flags

    off = F.abs(duration - wanted) > F.greatest(0.2 * wanted, F.lit(0.5))
    return flags({"CLIPPING": clip > 10, "SILENCE": silence > 0.40, "QUIET": rms_db < -40, "HOT_PEAK": peak_db > -0.1, "DURATION": off})
