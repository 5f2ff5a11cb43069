"""Queries of the contour chain: terrain smoothed where it is flat, and lines with codes, helper lines and slope ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import cellsets, grid
from geoloom.operators import contours as C
from geoloom.operators import lines as L
from geoloom.sources import tables as T
from geoloom.sources.store import written

#: Metres; lines on a map of 1:5,000. Index contours are every fifth, and the least length follows the interval.
SIZE, SIDE, INTERVAL, SCALE = 10.0, 40, 2.5, 5000
LEAST_LENGTH = max(15.0, 2.5 * INTERVAL)
PAPER_MM = SCALE / 1000
#: Helper lines keep this far from contours, and are no shorter (on paper 0.35 and 1.5 mm). Slope ticks: from 2 mm on, one more every 40 mm, three at most.
GAP, LEAST_HELPER = 0.35 * PAPER_MM, 1.5 * PAPER_MM
TICKS = (2.0 * PAPER_MM, 40.0 * PAPER_MM, 3)
SIMPLIFIED = 0.08 * PAPER_MM


def _terrain(spark, d):
    """Mean height in cells of 10 m, with buildings as town ground, and roads (areas one level up) protected."""
    cells = grid.densify(grid.with_cell(T.points(spark, d), SIZE).groupBy("rr", "cc").agg(F.avg("z").alias("z")), SIDE, SIDE)
    cells = cells.drop("valid")
    for flag, where in (("urban", "kind = 'BUILDING'"), ("protect", "lvl = 1 and kind = 'MACHINERY'")):
        inside = cellsets.box_cells(T.rects(spark, d).where(where), SIZE).select("rr", "cc").distinct().withColumn(flag, F.lit(True))
        cells = cells.join(inside, ["rr", "cc"], "left")
    return cells


def _surface(spark, d):
    return C.adaptive_surface(_terrain(spark, d), SIZE, INTERVAL, SCALE)


def ras24_adaptive_surface(spark, d):
    """Height and weight of every cell after smoothing."""
    return _surface(spark, d).select("rr", "cc", F.round(F.col("z") + 1e-7, 4).alias("z"), F.round(F.col("w") + 1e-7, 4).alias("w"))


def _metres(vertices):
    return vertices.withColumns({c: (F.col(c) + 0.5) * SIZE for c in ("x", "y")})


def ras32_contour_lines(spark, d):
    """Ordered lines on the terrain as it is: rings and open lines by level, their nodes and length."""
    z = grid.with_cell(T.points(spark, d), SIZE).groupBy("rr", "cc").agg(F.avg("z").alias("z"))
    facts = C.line_facts(_metres(C.contour_lines(z, INTERVAL)))
    return facts.groupBy("level").agg(F.count("*").alias("lines"), F.sum(F.col("closed").cast("long")).alias("rings"), (F.sum("vertices") - F.sum(F.col("closed").cast("long"))).alias("nodes"), F.round(F.sum("length") + 1e-6, 3).alias("length"))


def pip05_contours(spark, d):
    """Contours and index contours of the smoothed terrain, short ones left out, simplified and rounded, with ticks into depressions; and the
    stretches of half-way lines that keep their distance."""
    surface = written(_surface(spark, d))
    main, half = (written(_metres(C.contour_lines(surface, INTERVAL, offset))) for offset in (0.0, INTERVAL / 2))
    facts = written(C.line_facts(main).where(F.col("length") >= LEAST_LENGTH))
    kept = main.join(facts.select("line_id"), "line_id", "left_semi")
    shaped = L.corners_cut(kept.join(L.simplified(kept, SIMPLIFIED), ["line_id", "pos"]).select("line_id", "pos", "x", "y"))
    size = shaped.groupBy("line_id").agg(F.count("*").alias("drawn"))
    code = F.when(F.col("k") % 5 == 0, "102").otherwise("101")
    lines = facts.join(size, "line_id").select(code.alias("code"), "level", "closed", "vertices", "drawn", F.round("length", 3).alias("length"), F.coalesce(F.col("area") < 0, F.lit(False)).alias("sunk"), C.slope_ticks(facts, *TICKS).alias("ticks"))
    helper = C.helper_runs(half, main, GAP, LEAST_HELPER).select(F.lit("103").alias("code"), "level", F.lit(False).alias("closed"), "vertices", F.col("vertices").alias("drawn"), F.round("length", 3).alias("length"), F.lit(False).alias("sunk"), F.lit(0).cast("long").alias("ticks"))
    return lines.unionByName(helper)


def _gauss(source: str, value: str, out: str, metres: float) -> str:
    """A table ``out`` (rr, cc, v): Gaussian means of a column, over cells that have it."""
    s = metres / SIZE
    n = int(C.REACH * s + 0.5)
    weight = f"exp(-0.5 * (power(a.rr - b.rr, 2) + power(a.cc - b.cc, 2)) / {s * s!r}::DOUBLE)"
    return f"{out} AS MATERIALIZED (SELECT a.rr, a.cc, sum({weight} * b.{value}) / sum({weight}) AS v FROM {source} a JOIN {source} b ON b.{value} IS NOT NULL AND b.rr BETWEEN a.rr - {n} AND a.rr + {n} AND b.cc BETWEEN a.cc - {n} AND a.cc + {n} GROUP BY 1, 2)"


def _step(x: str, low: str, high: str) -> str:
    t = f"greatest(0, least(1, ({x} - {low}) / greatest({high} - {low}, 1e-9::DOUBLE)))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_S = C.Smoothing()
_Z = f"zc AS (SELECT CAST(floor(y/{SIZE}) AS BIGINT) AS rr, CAST(floor(x/{SIZE}) AS BIGINT) AS cc, avg(z) AS z FROM fx_points GROUP BY 1, 2)"
_IN = f"(g.cc+0.5::DOUBLE)*{SIZE} >= x0 AND (g.cc+0.5::DOUBLE)*{SIZE} < x1 AND (g.rr+0.5::DOUBLE)*{SIZE} >= y0 AND (g.rr+0.5::DOUBLE)*{SIZE} < y1"
_SIDE = lambda a, s: f"(coalesce(h{s}.z, CASE WHEN c.{a} = {SIDE - 1} THEN c.z END) - coalesce(l{s}.z, CASE WHEN c.{a} = 0 THEN c.z END)) / (CASE WHEN c.{a} IN (0, {SIDE - 1}) THEN {SIZE} ELSE {2 * SIZE} END)"
_SQUARE = f"""zs AS (SELECT a.rr, a.cc, a.z AS a, b.z AS b, c.z AS c, d.z AS d FROM zc a JOIN zc b ON b.rr = a.rr AND b.cc = a.cc + 1 JOIN zc c ON c.rr = a.rr + 1 AND c.cc = a.cc JOIN zc d ON d.rr = a.rr + 1 AND d.cc = a.cc + 1),
      tri AS (SELECT rr, cc, 0 AS half, a AS pv, rr AS pr, cc AS pc, b AS qv, rr AS qr, cc + 1 AS qc, c AS sv, rr + 1 AS sr, cc AS sc FROM zs UNION ALL SELECT rr, cc, 1, b, rr, cc + 1, d, rr + 1, cc + 1, c, rr + 1, cc FROM zs),
      lev AS (SELECT *, unnest(range(CAST(floor(least(pv, qv, sv)/{INTERVAL}) AS BIGINT) + 1, CAST(floor(greatest(pv, qv, sv)/{INTERVAL}) AS BIGINT) + 1)) AS k FROM tri),
      sides AS (SELECT k, rr, cc, half, least(pr*1000 + pc, qr*1000 + qc) AS m, greatest(pr*1000 + pc, qr*1000 + qc) AS n, pc + (k*{INTERVAL} - pv)/(qv - pv)*(qc - pc) AS x, pr + (k*{INTERVAL} - pv)/(qv - pv)*(qr - pr) AS y FROM lev WHERE (pv >= k*{INTERVAL}) <> (qv >= k*{INTERVAL})
        UNION ALL SELECT k, rr, cc, half, least(qr*1000 + qc, sr*1000 + sc), greatest(qr*1000 + qc, sr*1000 + sc), qc + (k*{INTERVAL} - qv)/(sv - qv)*(sc - qc), qr + (k*{INTERVAL} - qv)/(sv - qv)*(sr - qr) FROM lev WHERE (qv >= k*{INTERVAL}) <> (sv >= k*{INTERVAL})
        UNION ALL SELECT k, rr, cc, half, least(sr*1000 + sc, pr*1000 + pc), greatest(sr*1000 + sc, pr*1000 + pc), sc + (k*{INTERVAL} - sv)/(pv - sv)*(pc - sc), sr + (k*{INTERVAL} - sv)/(pv - sv)*(pr - sr) FROM lev WHERE (sv >= k*{INTERVAL}) <> (pv >= k*{INTERVAL})),
      seg AS (SELECT k, min(m*1000000 + n) AS u, max(m*1000000 + n) AS v, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) * {SIZE} AS len FROM sides GROUP BY k, rr, cc, half)"""

SQL = {
    "ras24_adaptive_surface": f"""WITH {_Z}, bs AS MATERIALIZED (SELECT g.rr, g.cc, z, CASE WHEN z IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM fx_rects WHERE kind = 'BUILDING' AND {_IN}) THEN 1.0::DOUBLE ELSE 0 END AS urban, CASE WHEN z IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM fx_rects WHERE kind = 'MACHINERY' AND lvl = 1 AND {_IN}) THEN 1.0::DOUBLE ELSE 0 END AS protect
        FROM (SELECT r.range AS rr, k.range AS cc FROM range(0, {SIDE}) r, range(0, {SIDE}) k) g LEFT JOIN zc ON zc.rr = g.rr AND zc.cc = g.cc),
      gr AS MATERIALIZED (SELECT c.rr, c.cc, CASE WHEN c.z IS NOT NULL THEN sqrt(power({_SIDE('cc', 'x')}, 2) + power({_SIDE('rr', 'y')}, 2)) END AS grad FROM bs c LEFT JOIN bs lx ON lx.rr = c.rr AND lx.cc = c.cc - 1 LEFT JOIN bs hx ON hx.rr = c.rr AND hx.cc = c.cc + 1 LEFT JOIN bs ly ON ly.cc = c.cc AND ly.rr = c.rr - 1 LEFT JOIN bs hy ON hy.cc = c.cc AND hy.rr = c.rr + 1),
      {_gauss('bs', 'z', 'strong', _S.strong)}, {_gauss('gr', 'grad', 'mean', _S.slope)}, {_gauss('bs', 'z', 'town', _S.urban_strong)}, {_gauss('bs', 'urban', 'nt', _S.urban)}, {_gauss('bs', 'protect', 'np', _S.urban / 2)},
      sp AS (SELECT bs.rr, bs.cc, bs.z, strong.v AS strong, town.v AS town, nt.v AS nt, np.v AS np, {INTERVAL} / greatest(coalesce(mean.v, 0), 1e-6::DOUBLE) / {SCALE} * 1000 AS s FROM bs LEFT JOIN strong USING (rr, cc) LEFT JOIN mean USING (rr, cc) LEFT JOIN town USING (rr, cc) LEFT JOIN nt USING (rr, cc) LEFT JOIN np USING (rr, cc)),
      uu AS (SELECT *, least(nt * 2, 1) * {_step('s', f'{_S.urban_mm[0]}::DOUBLE', f'{_S.urban_mm[1]}::DOUBLE')} AS u FROM sp),
      fl AS MATERIALIZED (SELECT *, CASE WHEN z IS NOT NULL THEN greatest({_step('s', f'{_S.flat_mm[0]}::DOUBLE', f'{_S.flat_mm[1]}::DOUBLE')}, u) END AS flat, (strong - z) * (1 - u) + (town - z) * u AS delta FROM uu),
      {_gauss('fl', 'flat', 'ar', _S.zone)},
      w0 AS (SELECT fl.*, least(ar.v * flat, 1) AS w FROM fl LEFT JOIN ar USING (rr, cc)), w1 AS (SELECT * REPLACE (CASE WHEN w < 0.02 THEN 0 ELSE w END AS w) FROM w0),
      w2 AS (SELECT *, w * (1 - {_step('abs(delta)', f'({_S.detail[0]}::DOUBLE + u * {_S.urban_detail})', f'({_S.detail[1]}::DOUBLE + u * {_S.urban_detail})')}) * (1 - least(np * 2, 1)) AS w3 FROM w1),
      w4 AS (SELECT *, CASE WHEN w3 < 0.02 THEN 0 ELSE w3 END AS w5 FROM w2)
      SELECT rr, cc, round(CASE WHEN w5 > 0 THEN z + w5 * greatest({-_S.cap * INTERVAL!r}::DOUBLE, least({_S.cap * INTERVAL!r}::DOUBLE, delta)) ELSE z END + 1e-7, 4) AS z, round(CASE WHEN z IS NOT NULL THEN w5 END + 1e-7, 4) AS w FROM w4""",
    "ras32_contour_lines": f"""WITH RECURSIVE {_Z}, {_SQUARE},
      lk AS (SELECT k, u AS a, v AS b FROM seg UNION ALL SELECT k, v, u FROM seg), f(k, root, id) AS (SELECT DISTINCT k, a, a FROM lk UNION SELECT f.k, f.root, lk.b FROM f JOIN lk ON lk.k = f.k AND lk.a = f.id AND lk.b > f.root),
      nd AS (SELECT f.k, id, min(root) AS line, any_value(deg) AS deg FROM f JOIN (SELECT k, a, count(*) AS deg FROM lk GROUP BY 1, 2) g ON g.k = f.k AND g.a = f.id GROUP BY f.k, id),
      ln AS (SELECT k, line, count(*) AS nodes, min(deg) = 2 AS ring FROM nd GROUP BY 1, 2)
      SELECT ln.k * {INTERVAL}::DOUBLE AS level, count(*) AS lines, CAST(sum(CASE WHEN ring THEN 1 ELSE 0 END) AS BIGINT) AS rings, CAST(sum(nodes) AS BIGINT) AS nodes, round(any_value(s.len) + 1e-6, 3) AS length FROM ln JOIN (SELECT k, sum(len) AS len FROM seg GROUP BY k) s ON s.k = ln.k GROUP BY ln.k""",
}

QUERIES = {f.__name__: f for f in (ras24_adaptive_surface, ras32_contour_lines, pip05_contours)}
