"""Pitch, intensity and period marks of samples, a row per speaker.

Pitch is the autocorrelation method of Boersma (1993): of every frame the windowed signal's autocorrelation, divided by
that of the window, has its maxima as candidates, and the cheapest path through the candidates of all frames wins, where
jumps of pitch and changes of voicing cost. Period marks go from the middle of each voiced stretch to its ends, each time
to where the signal correlates best with what surrounds the last mark. Frames are worked on in blocks, so memory follows
the samples; rows are independent, so Spark spreads speakers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .voice import FRAME_S, resample, speaker_samples, voice_metrics

# Rate that samples are brought to, lowest and highest pitch (Hz).
RATE, FLOOR_HZ, CEILING_HZ = 16_000, 75.0, 600.0
# Fixed values of the method: candidates of a frame, share of the greatest amplitude that is silence, correlation from
# which a frame is voiced, costs of a lower octave, of a jump by an octave and of a change of voicing.
CANDIDATES, SILENCE, VOICING, OCTAVE_COST, JUMP_COST, CHANGE_COST = 15, 0.03, 0.45, 0.01, 0.35, 0.14
# Shortest and longest period (s).
PERIOD_S = (0.0001, 0.02)
#: Frames that are worked on at once.
_BLOCK = 1024
#: Least correlation of two neighbouring periods.
_ALIKE = 0.3


def frames(samples: np.ndarray, width: int, step: int) -> np.ndarray:
    """Views of `width` samples every `step`, in the middle of the recording; none if it is shorter."""
    n = (len(samples) - width) // step + 1
    if n < 1:
        return np.empty((0, width), samples.dtype)
    first = (len(samples) - (n - 1) * step - width) // 2
    return np.lib.stride_tricks.sliding_window_view(samples, width)[first : first + (n - 1) * step + 1 : step]


def intensity(samples: np.ndarray, rate: int) -> np.ndarray:
    """Level in dB of every frame: the weighted mean square against the square of 2e-5."""
    width = int(6.4 / FLOOR_HZ * rate) | 1
    weights = np.kaiser(width, 20.0)
    weights /= weights.sum()
    out = [np.empty(0)]
    views = frames(samples, width, round(FRAME_S * rate))
    for at in range(0, len(views), _BLOCK):
        x = views[at : at + _BLOCK].astype(np.float64)
        x -= (x @ weights)[:, None]
        out.append(10 * np.log10(np.maximum((x * x) @ weights, 1e-30) / 4e-10))
    return np.concatenate(out)


def _candidates(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(pitch, strength) of each frame's candidates; 0 Hz, the first, is unvoiced, and a missing one has no strength."""
    width = int(3 / FLOOR_HZ * rate)
    low, high = int(rate / CEILING_HZ), int(rate / FLOOR_HZ) + 2
    size = 1 << (width + high).bit_length()
    window = np.hanning(width + 2)[1:-1]
    own = np.fft.irfft(np.abs(np.fft.rfft(window, size)) ** 2, size)[: high + 1]
    own /= own[0]
    views = frames(samples, width, round(FRAME_S * rate))
    loudest = float(np.abs(samples - samples.mean()).max(initial=0)) or 1.0
    pitch, strength = (np.zeros((len(views), CANDIDATES)) for _ in range(2))
    strength[:, 1:] = -np.inf
    for at in range(0, len(views), _BLOCK):
        x = views[at : at + _BLOCK].astype(np.float64)
        x -= x.mean(1, keepdims=True)
        level = np.abs(x).max(1) / loudest
        strength[at : at + len(x), 0] = VOICING + np.maximum(0, 2 - level * (1 + VOICING) / SILENCE)
        r = np.fft.irfft(np.abs(np.fft.rfft(x * window, size, axis=1)) ** 2, size, axis=1)[:, : high + 1]
        r = r / np.where(r[:, :1] > 0, r[:, :1], 1) / own
        a, b, c = r[:, low - 1 : high - 1], r[:, low:high], r[:, low + 1 : high + 1]
        peak = (b > a) & (b >= c) & (b > 0.5 * VOICING)
        bend = np.where(peak, 2 * b - a - c, 1)
        shift = np.where(peak, (c - a) / (2 * bend), 0)  # of the parabola's top
        lag = np.arange(low, high) + shift
        got = np.where(peak, np.minimum(b + (c - a) * shift / 4, 1) - OCTAVE_COST * np.log2(FLOOR_HZ * lag / rate), -np.inf)
        got = np.where((rate / lag >= FLOOR_HZ) & (rate / lag <= CEILING_HZ), got, -np.inf)
        best = np.argpartition(-got, CANDIDATES - 1, axis=1)[:, : CANDIDATES - 1]
        strength[at : at + len(x), 1:] = np.take_along_axis(got, best, 1)
        pitch[at : at + len(x), 1:] = rate / np.take_along_axis(lag, best, 1)
    return pitch, strength


def pitch(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch in Hz of every frame, 0 where it is unvoiced: the path of greatest strength less the costs of its steps."""
    hz, strength = _candidates(samples, rate)
    if not len(hz):
        return np.empty(0)
    octave = np.log2(np.where(hz > 0, hz, 1))
    voiced = hz > 0
    total, back = strength[0], np.zeros(hz.shape, np.int8)
    for t in range(1, len(hz)):
        jump = JUMP_COST * np.abs(octave[t - 1][:, None] - octave[t][None, :])
        cost = np.where(voiced[t - 1][:, None] & voiced[t][None, :], jump, np.where(voiced[t - 1][:, None] ^ voiced[t][None, :], CHANGE_COST, 0.0))
        reach = total[:, None] - cost
        back[t] = reach.argmax(0)
        total = reach[back[t], np.arange(CANDIDATES)] + strength[t]
    path = np.empty(len(hz), np.int64)
    path[-1] = total.argmax()
    for t in range(len(hz) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return hz[np.arange(len(hz)), path]


def _walk(x: np.ndarray, at: float, end: float, period, rate: int, way: int) -> list[float]:
    """Marks from `at` (in samples) towards `end`, one period after the other."""
    out = []
    while True:
        t = period(at)
        n, home = max(4, int(round(t))), int(round(at))
        lo, hi = int(0.8 * t), int(1.25 * t) + 1
        a = home - n // 2
        first, last = (a + lo, a + hi) if way > 0 else (a - hi, a - lo)
        if a < 0 or a + n > len(x) or first < 1 or last + n + 1 > len(x):
            return out
        near = np.lib.stride_tricks.sliding_window_view(x[first - 1 : last + n + 1], n)
        own = x[a : a + n]
        r = (near @ own) / np.maximum(np.sqrt((near * near).sum(1) * (own @ own)), 1e-12)
        k = 1 + int(r[1:-1].argmax())
        if r[k] < _ALIKE:
            return out
        bend = 2 * r[k] - r[k - 1] - r[k + 1]
        at += first - 1 + k - a + (float(np.clip((r[k + 1] - r[k - 1]) / (2 * bend), -0.5, 0.5)) if bend > 0 else 0.0)
        if at * way > end * way:
            return out
        out.append(at)


def marks(samples: np.ndarray, rate: int, f0: np.ndarray) -> tuple[list[float | None], list[float | None]]:
    """(periods in s, amplitudes) between and at the marks of each voiced stretch; None stands between stretches."""
    step = round(FRAME_S * rate)
    middle = (len(samples) - (len(f0) - 1) * step) / 2  # of the first frame
    x = samples.astype(np.float64) - samples.mean()
    periods, amplitudes = [], []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (f0 > 0).astype(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2).tolist():
        own = f0[a:b]
        period = lambda at, a=a, own=own: rate / own[int(np.clip(round((at - middle) / step) - a, 0, len(own) - 1))]
        lo, hi = max(0.0, middle + (a - 0.5) * step), min(len(x) - 1.0, middle + (b - 0.5) * step)
        centre = (lo + hi) / 2
        half = int(period(centre) / 2)
        first = max(0, int(centre) - half)
        at = float(first + np.abs(x[first : int(centre) + half + 1]).argmax())
        found = [*_walk(x, at, lo, period, rate, -1)[::-1], at, *_walk(x, at, hi, period, rate, 1)]
        if len(found) > 1:
            steps = np.diff(found) / rate
            good = (steps >= PERIOD_S[0]) & (steps <= PERIOD_S[1])
            periods += [*(float(s) if ok else None for s, ok in zip(steps, good)), None]
            for m in found:
                n = int(period(m))
                part = x[max(0, int(m) - n // 2) : int(m) - n // 2 + n]
                weights = np.hanning(len(part) + 2)[1:-1]
                amplitudes.append(float(np.sqrt((part * part) @ weights / weights.sum())) if len(part) else None)
            amplitudes.append(None)
    return periods, amplitudes


def analysed(speakers: DataFrame) -> DataFrame:
    """speakers (rate int, samples array<float>; others kept) with f0 and intensity (one value per 10 ms), periods and
    amplitudes (null between voiced stretches), all array<double>, in place of rate and samples.

    Samples are brought to 16 kHz. A null, empty or too short recording gives empty arrays; silence gives unvoiced frames;
    samples that are null or not finite count as 0.
    """
    names = speakers.columns
    at, rate_at = names.index("samples"), names.index("rate")
    kept = [c for c in names if c not in ("samples", "rate", "f0", "intensity", "periods", "amplitudes")]
    schema = speakers.select(*[f"`{c}`" for c in kept]).schema
    for c in ("f0", "intensity", "periods", "amplitudes"):
        schema = schema.add(c, T.ArrayType(T.DoubleType()))

    def analyse(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x, rate in zip(b.column(at), b.column(rate_at).to_pylist(), strict=True):
                x = x.values.to_numpy(zero_copy_only=False).astype(np.float32) if x.is_valid and len(x) else np.empty(0, np.float32)
                x = resample(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), rate or RATE, RATE)
                f0 = pitch(x, RATE)
                for values, new in zip(out, (f0.tolist(), intensity(x, RATE).tolist(), *marks(x, RATE, f0))):
                    values.append(new)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), *(pa.array(v, kind) for v in out)], names=schema.names)

    return speakers.mapInArrow(analyse, schema)


def voices(spans: DataFrame, audio: DataFrame, least_s: float = 0.5) -> DataFrame:
    """(transcript_id, speaker_id, f0_mean_hz, f0_stdev_hz, voiced_duration_s, articulation_rate, jitter_local,
    shimmer_local) of the speakers heard for least_s or more; spans and audio as in speaker_samples."""
    return voice_metrics(analysed(speaker_samples(spans, audio, least_s))).drop("f0", "intensity", "periods", "amplitudes")


def tones(rows: DataFrame, rate: int, n: int) -> DataFrame:
    """rows (hz, odd; others kept) with rate and samples: n samples of pulses at hz that ring off; odd lengthens and
    shortens the periods in turn by this share. Made by expressions, as known input for the analysis."""
    period = F.lit(float(rate)) / F.col("hz")

    def sample(i):
        pair = F.floor(i / (2 * period))
        into = i - pair * 2 * period  # of a long and a short period
        t = F.when(into < period * (1 + F.col("odd")), into).otherwise(into - period * (1 + F.col("odd")))
        return (F.exp(-6 * t / period) * F.sin(t * (2 * np.pi * 900 / rate)) * 0.5).cast("float")

    return rows.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)).withColumn("rate", F.lit(rate))
