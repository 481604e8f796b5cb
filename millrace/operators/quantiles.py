"""Exact interpolated quantiles that never hold a column in one aggregation buffer."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import DataFrame, functions as F

GATHER = 100_000  # rows a single task may sort in the last step
SLACK = 2e-3  # half width of the rank bracket; percentile_approx below is good to 1e-3
ACCURACY = 1_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], gather: int = GATHER
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of the non-null values, ``{column: [one value per probability]}``.

    Each wanted rank lives in an open value interval. While an interval holds more than ``gather`` rows, one pass
    proposes a much narrower bracket (mergeable sketch) and one pass counts what lies below, on and inside it, so
    the exact rank moves along. The last pass sorts at most ``gather`` values per rank. All passes serve all
    columns together, and only counts and bracket ends reach the driver.
    """
    columns = list(columns)
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    targets = []
    for c in columns:
        for p in probabilities:
            last = counts[c] - 1
            base = floor(p * last) if last >= 0 else 0
            for rank in {base, min(base + 1, max(last, 0))}:
                targets.append(
                    {"c": c, "key": (c, rank), "rank": rank, "n": counts[c], "lo": None, "hi": None, "value": None}
                )
    targets = list({t["key"]: t for t in targets}.values())

    def inside(t):
        x = F.col(t["c"]).cast("double")
        if t["lo"] is not None:
            x = F.when(F.col(t["c"]) > t["lo"], x)
        if t["hi"] is not None:
            x = F.when(F.col(t["c"]) < t["hi"], x)
        return x

    open_ = [t for t in targets if t["n"] > gather]
    while open_:
        # Ranks that still share an interval share one sketch.
        shared: dict[tuple, list[int]] = {}
        for i, t in enumerate(open_):
            shared.setdefault((t["c"], t["lo"], t["hi"]), []).append(i)
        sketch = []
        for j, members in enumerate(shared.values()):
            fractions = []
            for i in members:
                p = open_[i]["rank"] / max(open_[i]["n"] - 1, 1)
                fractions += [max(0.0, p - SLACK), min(1.0, p + SLACK)]
            sketch.append(F.percentile_approx(inside(open_[members[0]]), fractions, ACCURACY).alias(f"s{j}"))
        got = df.agg(*sketch).first()
        ends = {i: got[f"s{j}"][2 * m : 2 * m + 2] for j, members in enumerate(shared.values()) for m, i in enumerate(members)}
        tally = []
        for i, t in enumerate(open_):
            x, (a, b) = inside(t), ends[i]
            tally += [
                F.count_if(x < a).alias(f"below{i}"),
                F.count_if(x == a).alias(f"on_a{i}"),
                F.count_if((x > a) & (x < b)).alias(f"mid{i}"),
                F.count_if(x == b).alias(f"on_b{i}"),
            ]
        got = df.agg(*tally).first()
        for i, t in enumerate(open_):
            a, b = ends[i]
            below, on_a, mid = got[f"below{i}"], got[f"on_a{i}"], got[f"mid{i}"]
            on_b = got[f"on_b{i}"] if b > a else 0
            r = t["rank"]
            if r < below:
                t.update(hi=a, n=below)
            elif r < below + on_a:
                t.update(value=a)
            elif r < below + on_a + mid:
                t.update(lo=a, hi=b, rank=r - below - on_a, n=mid)
            elif r < below + on_a + mid + on_b:
                t.update(value=b)
            else:
                passed = below + on_a + mid + on_b
                t.update(lo=b, rank=r - passed, n=t["n"] - passed)
        open_ = [t for t in targets if t["value"] is None and t["n"] > gather]

    rest = [t for t in targets if t["value"] is None and t["n"] > 0]
    if rest:
        frames = {}
        picks = []
        for i, t in enumerate(rest):
            bounds = (t["c"], t["lo"], t["hi"])
            frames.setdefault(bounds, F.sort_array(F.collect_list(inside(t))))
            picks.append(F.element_at(frames[bounds], t["rank"] + 1).alias(f"v{i}"))
        got = df.agg(*picks).first()
        for i, t in enumerate(rest):
            t["value"] = got[f"v{i}"]

    value = {t["key"]: t["value"] for t in targets}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            last = counts[c] - 1
            if last < 0:
                out[c].append(None)
                continue
            position = p * last
            base = floor(position)
            low, high = value[(c, base)], value[(c, min(base + 1, last))]
            out[c].append(low + (high - low) * (position - base))
    return out
