"""Instances matched one by one, grids, fits and quantiles against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import ranges, storage
from corvane.functions.ranges import quantiles
from corvane import plans
from corvane.operators import audit, corpus, fits, rasters

RUNS = "array<struct<line:long,x0:long,x1:long>>"


def test_quantiles(spark):
    g = random.Random(3)
    rows = [(k, float(g.randint(0, 9)) if g.random() < 0.9 else None) for k in ("a", "b", None) for _ in range(g.randint(1, 60))] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "p33": 0.33, "half": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        values = [v for q, v in rows if q == k and v is not None]
        assert [r[n] for n in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()])
    nothing = audit.distribution(df.where("k = 'x'"), [], "v", 1.0).collect()
    assert [tuple(r) for r in nothing] == [(0.0,) * 6 + (0,)]
    assert {r.k: r.p50 for r in audit.distribution(df, ["k"], "v", 1.0).collect()}["none"] == 0.0


def boxed(x, y, w, h):
    return [(y + j, x, x + w) for j in range(h)]


def test_matched_cases(spark):
    g = random.Random(8)
    box = lambda: (g.randint(0, 30), g.randint(0, 20), g.randint(1, 12), g.randint(1, 12))
    truth, found = [], []
    for i in range(6):
        for k in range(4):
            b = box()
            truth.append((i, 1, f"t{k}", b))
            found += [(m, i, 1, f"d{k}{j}", g.choice([0.5, 0.9, g.random()]), (b[0] + g.randint(0, 2), b[1] + g.randint(0, 2), b[2], b[3])) for m in ("a", "b") for j in range(2)]
    found.append(("c", 0, 1, "x", 0.9, (0, 0, 3, 3)))
    images = spark.createDataFrame([(i, 40, 30) for i in range(6)], "image_id long, width int, height int")
    t = spark.createDataFrame([(*r[:3], boxed(*r[3])) for r in truth] + [(0, 1, "empty", [])], f"image_id long, category_id long, ann_key string, runs {RUNS}")
    p = spark.createDataFrame([(*r[:5], boxed(*r[5])) for r in found], f"model string, image_id long, category_id long, ann_key string, score double, runs {RUNS}")
    cells = lambda b: {(y, x) for y, a, c in boxed(*b) for x in range(a, c) if y < 30 and x < 40}
    want = {}
    for m in ("a", "b", "silent"):
        for i in range(6):
            used = set()
            for _, _, _, name, _, b in sorted((r for r in found if r[:2] == (m, i)), key=lambda r: (-r[4], r[3])):
                free = [(len(cells(b) & cells(q)) / len(cells(b) | cells(q)), k) for j, _, k, q in truth if j == i and k not in used and cells(b) | cells(q)]
                iou, k = max(((u, k) for u, k in free), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, None))
                if iou >= 0.4:
                    used.add(k)
                    want[m, i, name] = (k, iou)
    rows = rasters.matched_cases(t, p, images, ["a", "b", "silent"], 0.4).collect()
    got = {(r.model, r.image_id, r.det): (r.gt, pytest.approx(r.iou)) for r in rows}
    assert got == want and len(want) > 20
    assert all(r.dice == pytest.approx(2 * r.iou / (1 + r.iou)) for r in rows) and all((r.hd95 == 0) == (r.iou == 1) for r in rows if r.hd95 is not None)


def trip_by_hand(mask, grid):
    """The whole image, pixel by pixel."""
    h, w = mask.shape
    small = np.zeros((grid, grid))
    for i in range(grid):
        for j in range(grid):
            for y in range(h):
                for x in range(w):
                    a = min(y + 1, (i + 1) * h / grid) - max(y, i * h / grid)
                    b = min(x + 1, (j + 1) * w / grid) - max(x, j * w / grid)
                    small[i, j] += mask[y, x] * max(a, 0) * max(b, 0) * grid * grid / (h * w)
    small = small >= 0.5 - 1e-12
    back = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            u, v = (min(max((p + 0.5) * grid / s - 0.5, 0), grid - 1) for p, s in ((y, h), (x, w)))
            total = sum(small[i, j] * max(0, 1 - abs(u - i)) * max(0, 1 - abs(v - j)) for i in range(grid) for j in range(grid))
            back[y, x] = total >= 0.5 - 1e-12
    both = (mask & back).sum()
    return 2 * both / (mask.sum() + back.sum()), both / (mask | back).sum()


def test_grid_ceilings(spark):
    g = random.Random(4)
    rows = []
    for i in range(12):
        runs = [r for _ in range(2) for r in boxed(g.randint(0, 14), g.randint(0, 9), g.randint(1, 9), g.randint(1, 6))]
        rows.append((i % 3, runs, 13, 20))
    df = spark.createDataFrame([*rows, (7, [], 13, 20), (8, None, 13, 20), (9, [(50, 0, 4)], 13, 20)], f"category_id long, runs {RUNS}, height int, width int")
    want = []
    for c, runs, h, w in rows:
        mask = np.zeros((h, w), dtype=bool)
        for y, a, b in runs:
            if y < h:
                mask[y, a:b] = True
        want += [(c, grid, *trip_by_hand(mask, grid), math.sqrt(mask.sum())) for grid in (4, 7)]
    ceilings = rasters.grid_ceilings(df, ["category_id"], (4, 7))
    got = sorted(tuple(r) for r in ceilings.collect())
    assert np.allclose(np.array(got), np.array(sorted(want)))
    summary = {(r.kind, r.grid, r.category_id): r for r in rasters.ceiling_summary(ceilings, spark.createDataFrame([(0, 6000), (1, 3)], "category_id long, train_n long")).collect()}
    of = [r for r in want if r[:2] == (1, 4)]
    assert summary["class", 4, 1].median_dice == pytest.approx(np.median([r[2] for r in of])) and summary["class", 4, 1].below_75 == pytest.approx(np.mean([r[3] < 0.75 for r in of]))
    assert summary["all", 7, None].n == 12 and summary["all", 7, None].iou == pytest.approx(np.mean([r[3] for r in want if r[1] == 7]))
    assert {r.grp: r.n for r in rasters.ceiling_summary(ceilings, spark.createDataFrame([(0, 6000), (1, 3)], "category_id long, train_n long")).where("kind = 'group' and grid = 4").collect()} == {"head": 4, "tail": 8}
    assert rasters.grid_ceilings(df.limit(0), ["category_id"]).count() == 0


def test_grid_ceilings_of_polygons(spark):
    g = random.Random(21)
    box = lambda n: (x := g.uniform(-3, 25), y := g.uniform(-3, 25), x + g.uniform(0, n), y + g.uniform(0, n))
    rows = [(k, g.choice([23, 31]), g.choice([19, 40]), box(g.choice([1, 2, 9, 40]))) for k in range(40)]
    shapes = spark.createDataFrame([(k, h, w, [a, b, c, b, c, d, a, d]) for k, h, w, (a, b, c, d) in rows], "k long, height int, width int, polygon array<double>")
    want = {}
    for k, h, w, (a, b, c, d) in rows:
        mask = np.array([[a <= 2 * x + 1 < c and b <= 2 * y + 1 < d for x in range(w)] for y in range(h)])
        if mask.any():
            want |= {(k, grid): (*trip_by_hand(mask, grid), math.sqrt(mask.sum())) for grid in (5, 12)}
    got = {(r.k, r.grid): (r.dice, r.iou, r.side) for r in rasters.grid_ceilings(shapes, ["k"], (5, 12), 2.0).collect()}
    assert set(got) == set(want) and len(want) > 40 and np.allclose([got[k] for k in want], list(want.values()))


def test_quantiles_rank_equal_values_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ranges, "durable", lambda df: (made := storage.durable(df), kept.append(made.count()))[0])
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r.k: (r.half, r.top) for r in quantiles(df, ["k"], "v", {"half": 0.5, "top": 1.0}).collect()}
    assert got == {0: (3.0, 6.0), 1: (3.0, 6.0)} and max(kept) == 14


def test_ridge_fits(spark):
    rng = np.random.default_rng(5)
    groups = {("a", 1): 40, ("a", 2): 3, (None, 1): 25, ("b", 1): 200}
    data = {k: (rng.normal(size=(n, 4)), rng.choice([-1.0, 1.0], n)) for k, n in groups.items()}
    rows = [(*k, x.tolist(), float(y)) for k, (xs, ys) in data.items() for x, y in zip(xs, ys, strict=True)]
    rows += [("zero", 1, [0.0] * 4, 1.0)] * 3 + [("bad", 1, [1.0, 2.0], 1.0), ("bad", 1, None, 1.0), ("bad", 1, [1.0, None, 1.0, 1.0], 1.0), ("bad", 1, [float("nan")] * 4, 1.0), ("bad", 1, [1.0] * 4, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, features array<double>, target double").repartition(5)
    found = fits.ridge_fits(df, ["k", "j"], 4, 0.01)
    got = {(r.k, r.j): r for r in found.collect()}
    assert set(got) == {*groups, ("zero", 1)} and got["zero", 1].coefficients is None and got["zero", 1].n == 3
    for k, (x, y) in data.items():
        gram = x.T @ x
        want = np.linalg.solve(gram + 0.01 * np.trace(gram) / 4 * np.eye(4), x.T @ y)
        assert got[k].n == len(y) and np.allclose(got[k].coefficients, want)
        positive = x @ want > 0
        dice = {(r.k, r.j): r.dice for r in fits.fit_scores(df, found, ["k", "j"]).collect()}[k]
        assert dice == pytest.approx(2 * (positive & (y > 0)).sum() / max(1, positive.sum() + (y > 0).sum()))
    assert fits.ridge_fits(df.limit(0), ["k", "j"], 4).count() == 0


def parts_by_hand(cells):
    left, out = set(cells), []
    while left:
        part, edge = set(), [min(left)]
        while edge:
            y, x = edge.pop()
            if (y, x) in left:
                left.discard((y, x))
                part.add((y, x))
                edge += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        out.append(part)
    return out


def test_components_and_outlines():
    g = random.Random(7)
    for _ in range(80):
        mask = np.array([[g.random() < 0.45 for _ in range(9)] for _ in range(7)])
        runs = np.array([(y, x, x + 1) for y, x in np.argwhere(mask).tolist()] or [(0, 0, 1)])
        merged = []
        for y, a, b in sorted(runs.tolist()):
            if merged and merged[-1][0] == y and merged[-1][2] == a:
                merged[-1][2] = b
            else:
                merged.append([y, a, b])
        parts = rasters.components(np.array(merged))
        cells = [{(y, x) for y, a, b in p.tolist() for x in range(a, b)} for p in parts]
        assert sorted(map(sorted, cells)) == sorted(map(sorted, parts_by_hand({tuple(c) for c in np.argwhere(mask).tolist()} or {(0, 0)})))
        for part, inside in zip(parts, cells, strict=True):
            shape, top, left = rasters.filled(part)
            line = [(y + top, x + left) for x, y in rasters.outline(shape)]
            assert set(line) <= inside and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(line, line[1:] + line[:1], strict=True))
            ys, xs = [y for y, _ in inside], [x for _, x in inside]
            assert {min(ys), max(ys)} == {min(y for y, _ in line), max(y for y, _ in line)} and {min(xs), max(xs)} == {min(x for _, x in line), max(x for _, x in line)}


def test_polygons_of_masks(spark):
    square = boxed(3, 2, 11, 9)
    ring = [r for y in range(20, 30) for r in ([(y, 0, 10)] if y in (20, 29) else [(y, 0, 1), (y, 9, 10)])]
    rows = [(1, square), (2, [*square, (40, 0, 3)]), (3, [(0, 0, 50)]), (4, boxed(0, 0, 4, 4)), (5, []), (6, None), (7, [*square, *ring])]
    got = {r.image_id: r.polygon for r in rasters.mask_polygons(spark.createDataFrame(rows, f"image_id long, runs {RUNS}")).collect()}
    corners = lambda p: {(p[i], p[i + 1]) for i in range(0, len(p), 2)}
    assert corners(got[1]) == corners(got[2]) == {(3, 2), (13, 2), (13, 10), (3, 10)}
    assert [got[i] for i in (3, 4, 5, 6)] == [None] * 4
    assert corners(got[7]) == {(0, 20), (9, 20), (9, 29), (0, 29)}  # the greater of both, holes filled
    images = spark.createDataFrame([(i, 20, 40) for i in range(1, 4)], "image_id long, width int, height int")
    found = spark.createDataFrame([(1, 5, "a", 0.95, 1.0, 1.0, 9.0, 9.0, got[1]), (2, 5, "a", 0.95, 1.0, 1.0, 9.0, 39.5, None)], "image_id long, category_id long, ann_key string, score double, x double, y double, w double, h double, polygon array<double>")
    lines = {r.image_id: r.line for r in corpus.pseudo_labels(found, images).collect()}
    assert lines[1].split()[0] == "0" and len(lines[1].split()) == 9 and lines[2] == "0 0.050000 0.025000 0.500000 0.025000 0.500000 1.000000 0.050000 1.000000" and lines[3] is None


def test_outlines_of_many_masks_at_once(spark, monkeypatch):
    g = np.random.default_rng(3)
    shapes = []
    for k in range(150):
        mask = np.zeros((60, 60), dtype=bool)
        for y, x, h, w in g.integers(1, 25, (3, 4)):
            mask[y : y + h, x : x + w] = True
        mask &= g.random(mask.shape) < (1.0, 0.9, 0.4)[k % 3]
        edges = np.diff(mask.astype(int), axis=1, prepend=0, append=0)
        shapes.append([(int(y) - 9, int(a) - 7, int(b) - 7) for (y, a), (_, b) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True)])
    want = [None if found is None else found.ravel().tolist() for found in (rasters.largest_outline(np.array(r)) for r in shapes)]
    assert sum(w is not None for w in want) > 80
    monkeypatch.setattr(rasters, "largest_outline", None)  # tracing goes without it
    rows = spark.createDataFrame(list(enumerate(shapes)), f"k long, runs {RUNS}")
    assert [r.polygon for r in rasters.mask_polygons(rows).orderBy("k").collect()] == want
    numbers = np.array([(k, *r) for k, rs in enumerate(shapes) for r in rs]).T
    monkeypatch.setattr(rasters.masks, "AT_ONCE", 64)
    flat, sizes = rasters.masks.largest_outlines(rasters.masks.Runs(*numbers), len(shapes))
    assert [f.tolist() or None for f in np.split(flat, np.cumsum(sizes)[:-1])] == want
    hexagons = spark.createDataFrame([(k, [k - 9.5, 0.25, k + 9.0, 0.5, k + 14.0, 20.0, k + 9.0, 41.5, k - 9.0, 40.0, k - 14.0, 20.0]) for k in range(9)], "k long, polygon array<double>")
    scanned = hexagons.select("k", rasters.scanlines(F.col("polygon"), 2.0).alias("runs"))
    assert rasters.mask_polygons(hexagons, 2.0).orderBy("k").collect() == rasters.mask_polygons(scanned).select("k", "polygon").orderBy("k").collect()


def test_pseudo_polygons_trace_once_and_in_many_tasks(spark):
    df = plans.QUERIES["pseudo_polygons"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()  # traced masks are kept, as two steps read them


def test_pseudo_polygons_run_as_registered(spark):
    lines = [r.line for r in plans.QUERIES["pseudo_polygons"](spark, "/root/testdata/sf0.01").where("line is not null").collect()]
    assert lines and all(len(v.split()) % 2 == 1 and len(v.split()) >= 7 for v in lines)


def test_simplified_keeps_what_lies_off():
    circle = np.array([(round(20 * math.cos(t / 50 * math.tau)), round(20 * math.sin(t / 50 * math.tau))) for t in range(50)], dtype=float)
    few = rasters.simplified(circle, 1.0)
    assert 6 <= len(few) < 30 and len(rasters.simplified(circle, 0.0)) >= len(few)
    assert len(rasters.simplified(np.array([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0), (0.0, 2.0)]), 0.1)) == 4


def test_cross_split_hashes(spark):
    g = random.Random(2)
    base = [g.getrandbits(63) for _ in range(40)]
    rows = [(f"f{i}{j}", g.choice(["train", "valid", "test"]), h ^ sum(1 << b for b in g.sample(range(63), g.choice([0, 0, 2, 5, 6])))) for i, h in enumerate(base) for j in range(3)]
    rows += [(f"blank{i}", "train", 0) for i in range(30)] + [("other", "test", 0), ("none", "test", None), ("alone1", "train", 2**62), ("alone2", "train", 2**62)]
    df = spark.createDataFrame(rows, "file_name string, split string, dhash long")
    classes = {}
    for f, s, h in rows:
        if h is not None:
            classes.setdefault(h, []).append((f, s))
    want = set()
    for a, x in classes.items():
        for b, y in classes.items():
            if min(x) <= min(y) and (a ^ b).bit_count() <= 5 and len({s for _, s in x + y}) > 1:
                want.add((min(x)[0], min(y)[0], (a ^ b).bit_count(), len(x), len(y)))
    assert {tuple(r) for r in audit.cross_split_hashes(df).collect()} == want and ("blank0", "blank0", 0, 31, 31) in want
    assert {r.file_name: r.class_file for r in audit.hash_members(df).collect()} == {f: min(m)[0] for m in classes.values() for f, _ in m}


def test_search_leaves_out_groups_of_several_splits_only(spark):
    files = spark.createDataFrame([("a", "train", "1"), ("b", "train", "1"), ("c", "train", "2"), ("d", "test", "2"), ("e", "test", "3")], "file_name string, split string, sha string")
    assert {r.file_name for r in audit.apart_from_groups(files, audit.exact_groups(files)).collect()} == {"a", "b", "e"}
