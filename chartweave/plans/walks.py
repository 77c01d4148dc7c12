"""Queries of trajectories: every user of ``events`` walks over the positions of ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import trajectories as W
from ..operators.near import Near
from ..session import table
from .fixtures import SQL_VIEWS, charts, hulls
from .samples import _GRAPH, REACH

SEED, LENGTHS, INTERVAL, LEAST, CIRCLE = 27, (6, 9), 3, 0.012, (0.05, 0.2)
LINE, STEP, KEEP = (0.05, 0.3), (0.01, 0.05), 0.7


def _users(spark, sf_dir, points, kinds):
    return W.users_at(table(spark, sf_dir, "events"), points, "vec_id", SEED, kinds, LENGTHS)


def walked(spark, sf_dir, kind: str):
    """The places, their neighbour graph, and the walks of all users on it."""
    points, graph = charts(spark, sf_dir).select("vec_id", "x", "y"), Near(REACH, hulls(spark))
    return points, graph, W.graph_trajectories(graph, points, _users(spark, sf_dir, points, (kind,)), "vec_id", SEED, INTERVAL, LEAST, CIRCLE)


def _walks(kind: str):
    def query(spark, sf_dir):
        found = walked(spark, sf_dir, kind)[2]
        return found.select("walker", F.col("t").cast("long").alias("t"), "node", F.col("redraws").cast("long").alias("redraws"))

    query.__name__ = f"trajectory_{kind}"
    query.__doc__ = f"Walks of kind {kind} on the neighbour graph."
    return query


def _paths(kind: str):
    def query(spark, sf_dir):
        points = charts(spark, sf_dir).select("vec_id", "x", "y")
        paths = W.free_paths(_users(spark, sf_dir, points, (kind,)), points, "vec_id", SEED, LINE, STEP, KEEP)
        found = W.snapped_paths(paths, points, "vec_id", REACH)
        return found.select("walker", F.col("t").cast("long").alias("t"), "node")

    query.__name__ = f"trajectory_{kind}"
    query.__doc__ = f"Free paths of kind {kind}, snapped to positions."
    return query


QUERIES = {f.__name__: f for f in (*map(_walks, W.WALKS), *map(_paths, W.PATHS))}


def _u(purpose: str, *keys: str) -> str:
    return f"(CAST('0x' || substr(md5('{SEED}:{purpose}:' || {' || chr(58) || '.join(keys)}), 1, 12) AS BIGINT) / 281474976710656.0)"


def _int(purpose: str, below: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{purpose}:' || walker), 1, 12) AS BIGINT) % {below}"


_2PI = repr(2 * math.pi)
_NORMAL = lambda p, *k: f"sqrt(-2 * ln(1 - {_u(p + '-r', *k)})) * cos({_2PI} * {_u(p + '-a', *k)})"
_BEGUN = f""", placed AS (SELECT vec_id AS node, x, y, row_number() OVER (ORDER BY vec_id) - 1 AS spot FROM charts),
walkers AS (SELECT *, {_int('start', '(SELECT count(*) FROM charts)')} AS spot, {LENGTHS[0]} + {_int('length', str(LENGTHS[1] - LENGTHS[0] + 1))} AS length FROM (SELECT DISTINCT user_id AS walker FROM events WHERE user_id IS NOT NULL)),
begun AS (SELECT walker, length, node, x, y FROM walkers JOIN placed USING (spot))"""


def _orbit(purpose: str, t: str) -> str:
    r = f"({CIRCLE[0]!r} + {CIRCLE[1] - CIRCLE[0]!r} * {_u(purpose + '-radius', 'walker', t)}) / 2"
    angle = f"{_2PI} * {_u(purpose + '-centre', 'walker', t)}"
    return f"x + {r} * cos({angle}) AS ncx, y + {r} * sin({angle}) AS ncy, CASE WHEN {_u(purpose + '-spin', 'walker', t)} < 0.5 THEN -1.0 ELSE 1.0 END AS nspin"


def walk_ctes(kind: str) -> str:
    """Views up to s0, s1, ...: where each user stands at every step of a walk of this kind."""
    angle = f"{_2PI} * {_u('heading', 'walker')}"
    turn = f"CASE WHEN {_u('side', 'walker')} < 0.5 THEN -1.0 ELSE 1.0 END * ({math.pi / 2!r} + {W.TURN_SPREAD} * {_NORMAL('turn', 'walker')})"
    sql = SQL_VIEWS + _GRAPH + _BEGUN + f""", moves AS MATERIALIZED (
  SELECT src, dst, q.x AS x1, q.y AS y1, q.x - p.x AS dx, q.y - p.y AS dy FROM graph JOIN charts p ON p.vec_id = src JOIN charts q ON q.vec_id = dst
  UNION ALL SELECT vec_id, vec_id, x, y, 0, 0 FROM charts WHERE vec_id NOT IN (SELECT src FROM graph)),
s0 AS MATERIALIZED (SELECT walker, length, node, x, y, cos(angle) AS hx, sin(angle) AS hy, cos(angle + turn) AS lx, sin(angle + turn) AS ly, ncx AS cx, ncy AS cy, nspin AS spin,
  0.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0 AS redraws FROM (SELECT *, {angle} AS angle, {turn} AS turn, {_orbit('orbit', "'0'")} FROM begun))"""
    for t in range(LENGTHS[1] - 1):
        fresh, check = t % INTERVAL == 1 % INTERVAL, t > 0 and t % INTERVAL == 0 and kind != "full"
        f = "x AS fx, y AS fy" if fresh else "fx, fy"
        add = (lambda s, v: f"{v} AS {s}") if fresh else (lambda s, v: f"{s} + {v} AS {s}")
        same = "walker, length, node, x, y, lx, ly"
        stuck = f"greatest(qx / {INTERVAL} - sx * sx / {INTERVAL**2}, qy / {INTERVAL} - sy * sy / {INTERVAL**2}) < {LEAST!r} * {LEAST!r}" if check else "false"
        again = f"{_2PI} * {_u('again', 'walker', repr(str(t)))}"
        second = f"length // 2 = {t}" if kind == "neighbor_l" else "false"
        weight = "0.0" if kind == "full" else f"{W.SHARPNESS} * ((dx * hx + dy * hy) / (sqrt(dx * dx + dy * dy) + 1e-8))"
        u = _u("move", "walker", repr(str(t)), "dst")
        sql += f""",
a{t} AS (SELECT {same}, hx, hy, cx, cy, spin, {f}, sx, sy, qx, qy, redraws FROM s{t} WHERE {t + 1} < length),
b{t} AS (SELECT {same}, hx, hy, cx, cy, spin, fx, fy, {add('sx', '(x - fx)')}, {add('sy', '(y - fy)')}, {add('qx', '(x - fx) * (x - fx)')}, {add('qy', '(y - fy) * (y - fy)')}, redraws FROM a{t}),
c{t} AS (SELECT *, {stuck} AS stuck, {again} AS again, {_orbit('again', repr(str(t)))} FROM b{t}),
d{t} AS (SELECT {same}, CASE WHEN stuck THEN cos(again) WHEN {second} THEN lx ELSE hx END AS hx, CASE WHEN stuck THEN sin(again) WHEN {second} THEN ly ELSE hy END AS hy,
  CASE WHEN stuck THEN ncx ELSE cx END AS cx, CASE WHEN stuck THEN ncy ELSE cy END AS cy, CASE WHEN stuck THEN nspin ELSE spin END AS spin, fx, fy, sx, sy, qx, qy, redraws + stuck::INT AS redraws FROM c{t}),
e{t} AS MATERIALIZED (SELECT * REPLACE ({"-spin * (y - cy) / r AS hx, spin * (x - cx) / r AS hy" if kind == "circular" else "hx AS hx"}) FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM d{t})),
m{t} AS (SELECT e{t}.*, m.*, {weight} - ln(-ln(({u} * 1e12 + 0.5) / (1e12 + 1))) AS w FROM e{t} JOIN moves m ON src = node),
s{t + 1} AS MATERIALIZED (SELECT walker, length, dst AS node, x1 AS x, y1 AS y, CASE WHEN size > 1e-8 THEN dx / size ELSE hx END AS hx, CASE WHEN size > 1e-8 THEN dy / size ELSE hy END AS hy, lx, ly, cx, cy, spin, fx, fy, sx, sy, qx, qy, redraws
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS size, row_number() OVER (PARTITION BY walker ORDER BY w DESC, dst DESC) AS place FROM m{t}) WHERE place = 1)"""
    return sql


def steps_sql() -> str:
    return " UNION ALL ".join(f"SELECT walker, CAST({t} AS BIGINT) AS t, node, CAST(redraws AS BIGINT) AS redraws FROM s{t}" for t in range(LENGTHS[1]))


def _path_sql(kind: str) -> str:
    grid = SQL_VIEWS + _BEGUN + ", steps AS (SELECT *, unnest(generate_series(0, length - 1)) AS t FROM begun)"
    if kind == "linear":
        size, angle = f"({LINE[0]!r} + {LINE[1] - LINE[0]!r} * {_u('reach', 'walker')})", f"{_2PI} * {_u('way', 'walker')}"
        paths = f", paths AS (SELECT walker, t, x + t / (length - 1) * {size} * cos({angle}) AS x, y + t / (length - 1) * {size} * sin({angle}) AS y FROM steps)"
    else:
        paths = f""", kept AS (SELECT *, t <= 1 OR {_u('keep', 'walker', 't')} > {KEEP} AS new FROM steps),
legs AS (SELECT *, sum(new::INT) OVER (PARTITION BY walker ORDER BY t) AS leg, CASE WHEN new THEN {_2PI} * {_u('new', 'walker', 't')} ELSE {W.KEPT_TURN} * {_NORMAL('turn', 'walker', 't')} END AS turn,
  CASE WHEN t = 0 THEN 0.0 ELSE {STEP[0]!r} + {STEP[1] - STEP[0]!r} * {_u('step', 'walker', 't')} END AS size FROM kept),
turned AS (SELECT *, sum(turn) OVER (PARTITION BY walker, leg ORDER BY t) AS angle FROM legs),
paths AS (SELECT walker, t, x + sum(size * cos(angle)) OVER (PARTITION BY walker ORDER BY t) AS x, y + sum(size * sin(angle)) OVER (PARTITION BY walker ORDER BY t) AS y FROM turned)"""
    d2 = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)"
    return grid + paths + f" SELECT walker, CAST(t AS BIGINT) AS t, arg_min(vec_id, ({d2}, vec_id)) AS node FROM paths p, charts c GROUP BY walker, t"


ORACLES = {f"trajectory_{k}": walk_ctes(k) + " " + steps_sql() for k in W.WALKS} | {f"trajectory_{k}": _path_sql(k) for k in W.PATHS}
