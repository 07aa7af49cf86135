import numpy as np
import pytest

from gridwake.operators.spikes import Channel, flag_implausible

PLAIN = [Channel("x", "v", -40.0, 0.0)]
SCHEMA = "src string, at int, id long, v double, rec_id string, field string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)


def faults(df):
    return sorted((r.rec_id, r.fault) for r in df.collect())


def brute(data, low=-40.0, high=0.0):
    """Faults by the plain definition, over rows with distinct ids."""
    out, by = [], {}
    for s, t, i, v in {r[2]: r for r in data if r[2] is not None and r[1] is not None}.values():
        if v is not None and v == v:
            by.setdefault(s, []).append((t, i, v))
    for readings in by.values():
        readings.sort()
        values = [v for _, _, v in readings]
        kinds = ["impossible" if not low <= v <= high else "" for v in values]
        start = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[start]:
                if k - start >= 5:
                    kinds[start:k] = [x or "stuck" for x in kinds[start:k]]
                start = k
        clean = np.array([v for v, x in zip(values, kinds) if not x])
        if len(clean):
            mid = np.median(clean)
            mad = 1.4826 * np.median(abs(clean - mid))
            kinds = [x or ("spike" if abs(v - mid) > 8 * mad else "") for v, x in zip(values, kinds)]
        out += [(i, x) for (_, i, _), x in zip(readings, kinds) if x]
    return sorted(out)


def random_data(seed, sources=6, n=80):
    rng = np.random.default_rng(seed)
    data, i = [], 0
    for s in range(sources):
        base = rng.normal(-10, 1, n).round(2)
        base[rng.integers(0, n, 4)] -= 20
        base[rng.integers(0, n, 2)] = 3.0
        start = int(rng.integers(0, n - 8))
        base[start : start + int(rng.integers(3, 8))] = -9.5
        for t, v in enumerate(base):
            i += 1
            data.append((f"s{s}" if s else None, int(t // 2), i, float(v)))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, seed):
    data = random_data(seed)
    assert faults(
        flag_implausible(frame(spark, data + data[:20]), ["src"], "at", "id", PLAIN, confirm=8.0)
    ) == brute(data)


def test_hot_sources_agree_with_the_others(spark):
    data = random_data(3, sources=3)
    assert faults(flag_implausible(frame(spark, data), ["src"], "at", "id", PLAIN, confirm=8.0, hot=30)) == brute(data)


def test_nulls_empty_and_constant(spark):
    data = [
        ("a", 1, 1, None), ("a", 2, 2, float("nan")), ("a", None, 3, -1.0), ("a", 3, None, -1.0), ("b", 1, 4, 5.0),
        ("c", 1, 5, -1.0), ("c", 2, 6, -2.0), ("c", 3, 7, -1.0), ("c", 4, 8, -1.0)
    ]
    assert faults(
        flag_implausible(frame(spark, data), ["src"], "at", "id", PLAIN, confirm=8.0)
    ) == [(4, "impossible"), (6, "spike")]
    assert faults(flag_implausible(frame(spark, []), ["src"], "at", "id", PLAIN, confirm=8.0)) == []


def test_decibels(spark):
    data = [("a", t, t, 0.02 * (1 + 0.01 * (t % 7))) for t in range(50)] + [("a", 60, 60, 0.0), ("a", 61, 61, 2.0)]
    found = flag_implausible(
        frame(spark, data), ["src"], "at", "id", [Channel("vh", "v", 0.0, low_open=True, decibel=True)], confirm=8.0
    )
    assert faults(found) == [(60, "impossible"), (61, "spike")]


def phase_space(values, rounds=10):
    """Places outside the ellipsoid by the plain definition, one reading at a time."""
    u = [v - np.median(values) for v in values]
    flagged = [False] * len(u)
    for _ in range(rounds):
        bridged, last = [], 0.0
        for v, f in zip(u, flagged):
            last = last if f else v
            bridged.append(last)
        step = lambda s: [
            ((s[i + 1] if i + 1 < len(s) else s[i]) - (s[i - 1] if i else s[i])) / 2 for i in range(len(s))
        ]
        du = step(bridged)
        axes = [bridged, du, step(du)]
        kept = [i for i, f in enumerate(flagged) if not f]
        limit = np.sqrt(2 * np.log(max(len(kept), 2)))
        sizes = [limit * 1.4826 * np.median([abs(a[i]) for i in kept]) for a in axes]
        new = [
            i for i in kept
            if sum(0 if a[i] == 0 else np.inf if s == 0 else (a[i] / s) ** 2 for a, s in zip(axes, sizes)) > 1
        ]
        if not new:
            break
        for i in new:
            flagged[i] = True
    return {i for i, f in enumerate(flagged) if f}


def wandering(seed, n=120):
    """A slow wave with noise, some jumps that are no outliers in value, and some that are."""
    rng = np.random.default_rng(seed)
    v = -20 + 6 * np.sin(np.arange(n) / 18) + rng.normal(0, 0.15, n)
    v[rng.integers(5, n - 5, 4)] += rng.choice([-4.0, 4.0], 4)
    return v


@pytest.mark.parametrize("hot", [500_000, 40])
def test_the_phase_space_alone_decides(spark, hot):
    data, want, i = [], [], 0
    for s in range(3):
        values = wandering(s)
        want += [(i + k, "spike") for k in phase_space(list(values))]
        for t, v in enumerate(values):
            data.append((f"s{s}", t, i, float(v)))
            i += 1
    got = faults(flag_implausible(frame(spark, data).repartition(5), ["src"], "at", "id", PLAIN, hot=hot))
    assert got == sorted(want) and len(got) > 3
    # Differences decide: most of these lie within eight usual deviations of the median.
    assert len(faults(flag_implausible(frame(spark, data), ["src"], "at", "id", PLAIN, confirm=8.0))) < len(got)
