"""Identity links by cells and blocks against a comparison of all tracks."""

from __future__ import annotations

import numpy as np
import pytest

from missionspark.operators import identities as I

KIND = "mission_id long, track_id string, label string, born double, ended double, vector array<double>"


def brute(tracks, resets, least_cosine, least_gap):
    found = {}
    for m, t, label, born, _, v in tracks:
        best = None
        last = max((r for q, r in resets if q == m and born is not None and r <= born), default=None)
        for m2, t2, label2, _, ended, v2 in tracks:
            if m2 != m or t2 == t or label is None or label2 != label or v is None or v2 is None or not np.any(v) or not np.any(v2) or ended is None or born is None or ended > born:
                continue
            cut = last is not None and last > ended
            if (cut or born - ended >= least_gap) and np.dot(v, v2) / (np.linalg.norm(v) * np.linalg.norm(v2)) >= least_cosine:
                best = max(best or (ended, t2, cut), (ended, t2, cut))
        if best:
            found[m, t] = (best[1], "camera_cut" if best[2] else "occlusion")
    return found


def made(n, seed, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 8))
    rows = []
    for k in range(n):
        born = float(rng.integers(0, 200)) / 2
        v = middle[rng.integers(groups)] * rng.choice([0.1, 5.0]) + 0.05 * rng.normal(size=8)
        rows.append((int(rng.integers(2)), f"t{k}", str(rng.choice(["car", "box"])), born, born + float(rng.integers(1, 8)), v.tolist()))
    return rows


def linked(df):
    rows = df.collect()
    assert len({(r.mission_id, r.track_id) for r in rows}) == len(rows)
    return {(r.mission_id, r.track_id): (r.linked, r.reason) for r in rows}


@pytest.mark.parametrize("block, cell_tracks", [(1, 256), (3, 8), (64, 16)])
def test_links_are_those_of_all_pairs(spark, block, cell_tracks, monkeypatch):
    monkeypatch.setattr(I, "CELL_TRACKS", cell_tracks)
    sample = I.unit([r[5] for r in made(260, 4)])
    assert (len(I.centres(sample, 260, 0.85)) > 1) == (cell_tracks < 256)
    tracks = made(260, 4) + [(1, "bare", "car", 90.0, 91.0, None), (1, "zero", "car", 90.0, 91.0, [0.0] * 8), (1, "no label", None, 90.0, 91.0, [1.0] * 8), (1, "open", "car", 99.0, None, made(1, 4)[0][5]), (1, "unborn", "car", None, 3.0, [1.0] * 8), (0, "alone", "car", 99.0, 100.0, [1.0, -9.0] * 4)]
    resets = [(0, 20.0), (0, 60.5), (1, 44.0), (2, 1.0)]
    want = brute(tracks, resets, 0.85, 2.0)
    got = linked(I.link_identities(spark.createDataFrame(tracks, KIND), "vector", spark.createDataFrame(resets, "mission_id long, t_sec double"), block=block))
    assert got == want and len(want) > 100 and {r for _, r in want.values()} == {"camera_cut", "occlusion"}


def test_a_link_far_back_is_found(spark):
    old = [(1, "old", "car", 0.0, 1.0, [1.0, 0.0])]
    between = [(1, f"n{k:03}", "car", 2.0 + k, 3.0 + k, [0.6, 0.8]) for k in range(200)]
    tracks = old + between + [(1, "new", "car", 500.0, 501.0, [1.0, 0.01])]
    got = linked(I.link_identities(spark.createDataFrame(tracks, KIND), "vector", block=2))
    assert got[1, "new"] == ("old", "occlusion") and got == brute(tracks, [], 0.85, 2.0)


def test_vectors_without_structure_have_one_cell():
    sample = I.unit(np.random.default_rng(2).normal(size=(2_000, 32)))
    assert len(I.centres(sample, 100_000, 0.2)) == 1 < len(I.centres(I.unit([r[5] for r in made(2_000, 4)]), 20_000, 0.85))


def test_ends_at_one_time_and_empty_tables(spark):
    tracks = [(1, t, "car", 0.0, 5.0, [1.0, 0.0]) for t in ("a", "c", "b")] + [(1, "d", "car", 7.0, 9.0, [1.0, 0.0]), (1, "e", "car", 6.9, 9.0, [1.0, 0.0])]
    assert linked(I.link_identities(spark.createDataFrame(tracks, KIND), "vector", block=1)) == {(1, "d"): ("c", "occlusion")}
    assert linked(I.link_identities(spark.createDataFrame([], KIND), "vector")) == {}
    assert linked(I.link_identities(spark.createDataFrame([tracks[0]], KIND), "vector")) == {}
