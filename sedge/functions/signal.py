"""Levels, mixing and framing of sample arrays (array<double> or array<float> columns)."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-12


def rms(x: Column) -> Column:
    """Root mean square; null for no samples."""
    return F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), F.nullif(F.size(x), F.lit(0)).cast("double")))


def dbfs(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(FLOOR)))


def centred(x: Column) -> Column:
    """Without its mean."""
    # in the last step the sum is a variable: it isn't worked out again for each sample
    less = lambda total: F.transform(x, lambda v: v.cast("double") - F.try_divide(total, F.size(x).cast("double")))
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"), less)


def frames(x: Column, width: int) -> Column:
    """Whole frames of width samples; the remainder is dropped."""
    n = F.floor(F.size(x) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(x, i * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))


def active_rms(x: Column, width: int, range_db: float = 30.0) -> Column:
    """RMS over the frames within range_db of the loudest; 0 if that is silent; null without a whole frame."""
    levels = F.transform(frames(x, width), rms)
    peak = F.array_max(levels)
    active = F.filter(levels, lambda v: dbfs(v) >= dbfs(peak) - range_db)
    level = F.sqrt(F.try_divide(F.aggregate(active, F.lit(0.0), lambda a, v: a + v * v), F.size(active).cast("double")))
    return F.when(peak <= FLOOR, F.lit(0.0)).otherwise(level)


#: Names of the status word's bits.
THROTTLE_BITS = {
    0: "under_voltage_now",
    1: "arm_freq_capped_now",
    2: "currently_throttled",
    3: "soft_temp_limit_now",
    16: "under_voltage_occurred",
    17: "arm_freq_capped_occurred",
    18: "throttling_occurred",
    19: "soft_temp_limit_occurred",
}


def throttle_flags(word: Column) -> Column:
    """Names of the bits set in a status word."""
    named = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name")) for b, n in THROTTLE_BITS.items()])
    return F.transform(F.filter(named, lambda x: F.bit_get(word, x["bit"]) == 1), lambda x: x["name"])


def throttled_now(word: Column) -> Column:
    return word.bitwiseAND(15) != 0


@F.pandas_udf(T.StructType().add("rate", "integer").add("samples", T.ArrayType(T.FloatType())))
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """Sample rate and first channel of 16-bit WAV files; null for what isn't one."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as f:
                x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())[:, 0]
                rows.append((f.getframerate(), (x / 32768.0).astype(np.float32).tolist()))
        except (wave.Error, EOFError, TypeError):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["rate", "samples"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(x: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    """Samples at another rate, by cutting or padding their spectrum: nothing above half the lower rate stays."""

    def one(a: np.ndarray, r: int, t: int) -> list[float]:
        n = round(len(a) * t / r)
        return (np.fft.irfft(np.fft.rfft(a)[: n // 2 + 1], n) * n / len(a)).tolist() if n and len(a) and r != t else a.tolist()

    return pd.Series([None if s is None else one(np.asarray(s, float), int(r), int(t)) for s, r, t in zip(x, rate, target, strict=True)])


@F.pandas_udf(T.DoubleType())
def mains_share(x: pd.Series, rate: pd.Series) -> pd.Series:
    """Share of energy within 5 Hz of 50, 100 and 150 Hz."""
    out = []
    for samples, r in zip(x, rate, strict=True):
        a = np.asarray(samples if samples is not None else [], float)
        power = np.abs(np.fft.rfft(a - a.mean())) ** 2 if len(a) else np.zeros(0)
        hz = np.fft.rfftfreq(len(a), 1 / r) if len(a) else power
        near = np.zeros(len(hz), bool)
        for h in (50, 100, 150):
            near |= np.abs(hz - h) <= 5
        out.append(float(power[near].sum() / power.sum()) if power.sum() > 0 else 0.0)
    return pd.Series(out)


@F.pandas_udf(T.StructType().add("samples", T.ArrayType(T.DoubleType())).add("gain", "double").add("attenuation", "double"))
def mix_at_snr(speech: pd.Series, noise: pd.Series, snr_db: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Speech plus noise at a signal-to-noise ratio of active levels; a peak above 0.99 is attenuated to it. Silence on either side gives null."""
    rows = []
    for s, n, snr, r in zip(speech, noise, snr_db, rate, strict=True):
        a, b = np.asarray(s, float), np.resize(np.asarray(n, float), len(s))
        la, lb = active_level(a, int(r)), active_level(b, int(r))
        if la <= FLOOR or lb <= FLOOR:
            rows.append((None, None, None))
            continue
        gain = la / lb / 10 ** (snr / 20)
        mixed = a + gain * b
        peak = float(np.abs(mixed).max())
        cut = 0.99 / peak if peak > 0.99 else 1.0
        rows.append(((mixed * cut).tolist(), gain, cut))
    return pd.DataFrame(rows, columns=["samples", "gain", "attenuation"])


def active_level(x: np.ndarray, rate: int, frame_ms: int = 20, range_db: float = 30.0) -> float:
    width = max(1, rate * frame_ms // 1000)
    whole = x[: len(x) // width * width].reshape(-1, width)
    if not len(whole):
        return float(np.sqrt(np.mean(x**2))) if len(x) else 0.0
    level = np.sqrt((whole**2).mean(1))
    active = level[level >= level.max() * 10 ** (-range_db / 20)]
    return float(np.sqrt((active**2).mean()))


@F.pandas_udf(T.DoubleType())
def measured_snr(mixed: pd.Series, noise: pd.Series, rate: pd.Series) -> pd.Series:
    """The ratio in dB of a mixture whose noise part is known: active level of the rest over the noise's level."""
    out = []
    for m, n, r in zip(mixed, noise, rate, strict=True):
        part = np.asarray(n, float)
        out.append(20 * np.log10((active_level(np.asarray(m, float) - part, int(r)) + FLOOR) / (np.sqrt(np.mean(part**2)) + FLOOR)))
    return pd.Series(out)


def tiled(samples: Column, offset: Column, n: Column) -> Column:
    """n samples from offset, of samples repeated as often as that takes."""
    times = F.ceil((offset + n) / F.size(samples)).cast("int")
    return F.slice(F.flatten(F.array_repeat(samples, F.greatest(times, F.lit(1)))), (offset + 1).cast("int"), n.cast("int"))


#: How clips are varied for training. Shares of clips with a room and with noise, ranges of the noise ratio and of the gain in dB.
ROOM_SHARE, NOISE_SHARE, SNR_RANGE, GAIN_RANGE = 0.65, 0.8, (3.0, 25.0), (-9.0, 0.0)


@F.pandas_udf(T.StructType().add("samples", T.ArrayType(T.DoubleType())).add("offset", "integer"))
def placed_in_window(x: pd.Series, key: pd.Series, width: pd.Series) -> pd.DataFrame:
    """A clip at a place in a silent window that its key draws (a longer one is cut at such a place, and its offset is 0)."""
    rows = []
    for samples, k, w in zip(x, key, width, strict=True):
        a, w = np.asarray(samples, float), int(w)
        at = int(np.random.default_rng([*str(k).encode()]).integers(0, abs(w - len(a)) + 1))
        if len(a) >= w:
            rows.append((a[at : at + w].tolist(), 0))
        else:
            rows.append((np.concatenate([np.zeros(at), a, np.zeros(w - len(a) - at)]).tolist(), at))
    return pd.DataFrame(rows, columns=["samples", "offset"])


@F.pandas_udf(T.StructType().add("samples", T.ArrayType(T.DoubleType())).add("room", "boolean").add("snr_db", "double").add("gain_db", "double"))
def augmented(x: pd.Series, key: pd.Series, room: pd.Series, noise: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """A clip in a room (convolved, at its own peak), with noise (dry where the clip is silent) and with a gain, as its key draws them; what was done is recorded."""
    rows = []
    for samples, k, h, n, r in zip(x, key, room, noise, rate, strict=True):
        a, rng = np.asarray(samples, float), np.random.default_rng([*b"augment", *str(k).encode()])
        roomy, noisy, snr, gain = rng.random() < ROOM_SHARE and h is not None, rng.random() < NOISE_SHARE and n is not None, rng.uniform(*SNR_RANGE), rng.uniform(*GAIN_RANGE)
        if roomy:
            wet = np.convolve(a, np.asarray(h, float))[: len(a)]
            a = wet * (np.abs(a).max() / np.abs(wet).max()) if np.abs(wet).max() > 0 else a
        level = active_level(a, int(r))
        if noisy and level > FLOOR:
            b = np.resize(np.asarray(n, float), len(a))
            a = a + b * level / max(np.sqrt(np.mean(b**2)), FLOOR) / 10 ** (snr / 20)
        rows.append((np.clip(a * 10 ** (gain / 20), -0.999, 0.999).tolist(), bool(roomy), round(snr, 2) if noisy and level > FLOOR else None, round(gain, 2)))
    return pd.DataFrame(rows, columns=["samples", "room", "snr_db", "gain_db"])
