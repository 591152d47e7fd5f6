"""SQL fragments that say in plain ANSI SQL what the scenes and functions are (for checks)."""

BOXES = """b AS (SELECT p_partkey AS object_id, CAST(300 + p_partkey % 40 * 90 AS DOUBLE) AS cx,
    CAST(300 + p_partkey // 40 % 50 * 70 AS DOUBLE) AS cy, CAST(150 + p_partkey % 7 * 40 AS DOUBLE) AS cz,
    CAST(4 + p_size * 5 AS DOUBLE) AS ex, CAST(4 + p_size * 3 % 97 AS DOUBLE) AS ey, CAST(4 + p_size * 7 % 61 AS DOUBLE) AS ez FROM part),
v AS (SELECT object_id, CAST(vid AS INTEGER) AS vid, cx + CASE WHEN vid & 1 > 0 THEN 0.5 ELSE -0.5 END * ex AS x,
    cy + CASE WHEN vid & 2 > 0 THEN 0.5 ELSE -0.5 END * ey AS y, cz + CASE WHEN vid & 4 > 0 THEN 0.5 ELSE -0.5 END * ez AS z
    FROM b, (SELECT unnest(range(8)) AS vid))"""

FACES = """f AS (SELECT object_id, CAST(fid AS INTEGER) AS fid, a, b, c FROM b, (VALUES (0,0,4,6),(1,0,6,2),(2,1,3,7),(3,1,7,5),(4,0,1,5),(5,0,5,4),
    (6,2,6,7),(7,2,7,3),(8,0,2,3),(9,0,3,1),(10,4,5,7),(11,4,7,6)) AS t(fid, a, b, c)),
tri AS (SELECT f.object_id, f.fid, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
    FROM f JOIN v p ON p.object_id = f.object_id AND p.vid = f.a JOIN v q ON q.object_id = f.object_id AND q.vid = f.b
    JOIN v r ON r.object_id = f.object_id AND r.vid = f.c)"""

POINTS = """p AS (SELECT l_suppkey AS object_id, CAST(l_partkey % 1024 AS DOUBLE) AS x, l_quantity * 20 AS y,
    date_diff('day', timestamp '1995-01-01', l_shipdate) / 2 AS z FROM lineitem)"""


def morton(i: str, j: str, k: str) -> str:
    """Bit by bit, so that it shares nothing with the bit spread it checks."""
    parts = [f"(((CAST({x} AS BIGINT) >> {n}) & 1) << {3 * n + a})" for n in range(17) for a, x in enumerate((i, j, k))]
    return "(" + " + ".join(parts) + ")"


CELLS = f"""pc AS (SELECT object_id, x, y, z, {morton('floor(x / 128)', 'floor(y / 128)', 'floor(z / 64)')} AS cell0 FROM p),
pl AS (SELECT object_id, x, y, z, level, cell0 >> (3 * level) AS cell FROM pc, (SELECT unnest([0, 1, 2]) AS level)),
cat AS (SELECT level, cell, min(x) AS bbox_min_x, min(y) AS bbox_min_y, min(z) AS bbox_min_z, max(x) AS bbox_max_x, max(y) AS bbox_max_y,
    max(z) AS bbox_max_z, count(*) AS vertex_count, count(DISTINCT object_id) AS object_count FROM pl GROUP BY level, cell),
mask AS (SELECT level + 1 AS level, cell >> 3 AS cell, bit_or(CAST(1 AS BIGINT) << (cell & 7)) AS child_mask FROM cat GROUP BY 1, 2),
own AS (SELECT level, cell, 128.0 * (1 << level) / 65535 + CASE WHEN level > 0 THEN CAST(level * (vertex_count % 5) AS DOUBLE) ELSE 0.0 END AS own FROM cat),
err AS (SELECT c.level, c.cell, max(o.own) AS lod_error FROM cat c JOIN own o ON o.level <= c.level AND o.cell >> (3 * (c.level - o.level)) = c.cell GROUP BY 1, 2),
full_ AS (SELECT cat.*, coalesce(mask.child_mask, 0) AS child_mask, err.lod_error FROM cat LEFT JOIN mask USING (level, cell) JOIN err USING (level, cell))"""


def descent(wanted: str, good: str, columns: str = "level, cell", before: str = "") -> str:
    """A plan over full_, level by level. wanted, good: conditions on its columns."""
    return f"""WITH {POINTS}, {CELLS}, {before}
w AS (SELECT *, ({good}) AS good FROM full_ WHERE {wanted}),
k AS (SELECT DISTINCT level + 1 AS level, cell >> 3 AS cell FROM w),
o AS (SELECT w.*, NOT good AND k.cell IS NOT NULL AS opens FROM w LEFT JOIN k ON k.level = w.level AND k.cell = w.cell),
r2 AS (SELECT * FROM o WHERE level = 2),
r1 AS (SELECT * FROM o WHERE level = 1 AND cell >> 3 IN (SELECT cell FROM r2 WHERE opens)),
r0 AS (SELECT * FROM o WHERE level = 0 AND cell >> 3 IN (SELECT cell FROM r1 WHERE opens)),
planned AS (SELECT * FROM r2 WHERE NOT opens UNION ALL SELECT * FROM r1 WHERE NOT opens UNION ALL SELECT * FROM r0 WHERE NOT opens)
SELECT {columns} FROM planned"""
