"""SQL fragments shared by the reference SQL of several queries."""

from __future__ import annotations

from wetlens.functions import geo


def grid_sql(source: str, lon: str, lat: str, keep: str) -> str:
    """CTEs ``sphere`` and ``grid``: ``keep``, e and n of ``lon`` and ``lat`` of ``source``."""
    series = lambda f, g, axis: " + ".join([axis, *(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))])
    return f"""
conformal AS (SELECT {keep}, sinh(atanh(sin(radians({lat}))) - {geo._ECC!r} * atanh({geo._ECC!r} * sin(radians({lat})))) AS t,
  radians({lon} - {geo.CENTRAL!r}) AS d FROM {source}),
sphere AS (SELECT {keep}, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM conformal),
grid AS (SELECT {keep}, {geo.FALSE_EAST!r} + {geo.RADIUS!r} * ({series("cos", "sinh", "eta")}) AS e,
  {geo.RADIUS!r} * ({series("sin", "cosh", "xi")}) AS n FROM sphere)"""


#: CTE ``pos`` (row_idx, e, n): the position of each manifest row that has one.
POSITION = f"""
inside AS (SELECT row_idx, CASE WHEN x > 100000 AND x < 800000 AND y > 6600000 AND y < 7800000 THEN x ELSE y END AS e,
    CASE WHEN x > 100000 AND x < 800000 AND y > 6600000 AND y < 7800000 THEN y ELSE x END AS n FROM manifest
  WHERE (x > 100000 AND x < 800000 AND y > 6600000 AND y < 7800000) OR (y > 100000 AND y < 800000 AND x > 6600000 AND x < 7800000)),
degrees AS (SELECT row_idx, x AS lon, y AS lat FROM manifest WHERE x BETWEEN -5 AND 59 AND y BETWEEN 50 AND 80
  UNION ALL SELECT row_idx, y, x FROM manifest WHERE y BETWEEN -5 AND 59 AND x BETWEEN 50 AND 80 AND NOT (x BETWEEN -5 AND 59 AND y BETWEEN 50 AND 80)),
{grid_sql("degrees", "lon", "lat", "row_idx")},
pos AS (SELECT row_idx, e, n FROM inside UNION ALL
  SELECT row_idx, e, n FROM grid WHERE e > 100000 AND e < 800000 AND n > 6600000 AND n < 7800000)"""


def path_sql(path: str) -> str:
    """The canonical form of ``path``, with up to four nested ``..`` steps."""
    s = f"lower(nfc_normalize(replace(trim(url_decode(trim({path}, ' ' || chr(9) || chr(10) || chr(13) || chr(34) || chr(39))), ' ' || chr(9) || chr(10) || chr(13) || chr(34) || chr(39)), chr(92), '/')))"
    s = f"regexp_replace({s}, '^(file:/*|[a-z]:/|/)(.*?/)??(data/)', '\\3')"
    s = f"regexp_replace({s}, '/(\\./|/)+', '/', 'g')"
    s = f"regexp_replace({s}, '^(\\./)+', '')"
    for _ in range(4):
        s = f"regexp_replace({s}, '(^|/)[^/.][^/]*/\\.\\./', '\\1', 'g')"
    return s


def near_sql(radius: float) -> str:
    """CTE ``near`` (row_a, row_b): pairs of ``pos`` at most ``radius`` apart."""
    return f"""
cells AS (SELECT row_idx, e, n, floor(e / {radius})::BIGINT AS cx, floor(n / {radius})::BIGINT AS cy FROM pos),
near AS (SELECT a.row_idx AS row_a, b.row_idx AS row_b FROM
  (SELECT *, cx + dx AS kx, cy + dy AS ky FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) a
  JOIN cells b ON a.kx = b.cx AND a.ky = b.cy AND a.row_idx < b.row_idx
  WHERE (a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) <= {radius * radius})"""


def box_segment_sql(box: str = "w", seg: str = "s") -> str:
    """Squared distance of a box (xmin, ymin, xmax, ymax) and a segment (x1, y1, x2, y2).

    0 where the part of the segment between both pairs of sides is not empty; else the least
    of the distances of the segment's ends to the box and of the box's corners to the segment.
    """
    low, high = ["0.0"], ["1.0"]
    for v in "xy":
        a, d = f"{seg}.{v}1", f"({seg}.{v}2 - {seg}.{v}1)"
        lo, hi = f"{box}.{v}min", f"{box}.{v}max"
        low.append(f"CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN {lo} AND {hi} THEN 0.0 ELSE 2.0 END ELSE least(({lo} - {a}) / nullif({d}, 0), ({hi} - {a}) / nullif({d}, 0)) END")
        high.append(f"CASE WHEN {d} = 0 THEN 1.0 ELSE greatest(({lo} - {a}) / nullif({d}, 0), ({hi} - {a}) / nullif({d}, 0)) END")
    parts = []
    for k in "12":
        parts.append(" + ".join(f"pow(greatest(0.0, {box}.{v}min - {seg}.{v}{k}, {seg}.{v}{k} - {box}.{v}max), 2)" for v in "xy"))
    dx, dy = (f"({seg}.{v}2 - {seg}.{v}1)" for v in "xy")
    for px in ("xmin", "xmax"):
        for py in ("ymin", "ymax"):
            x, y = f"{box}.{px}", f"{box}.{py}"
            t = f"greatest(0.0, least(1.0, coalesce((({x} - {seg}.x1) * {dx} + ({y} - {seg}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0.0)))"
            parts.append(f"pow({seg}.x1 + {t} * {dx} - {x}, 2) + pow({seg}.y1 + {t} * {dy} - {y}, 2)")
    return f"CASE WHEN greatest({', '.join(low)}) <= least({', '.join(high)}) THEN 0.0 ELSE least({', '.join(parts)}) END"
