"""Training of the sites' encoders on triplets, with a loss on shared points that pulls neighbouring charts together.

Spark does the work that grows: each step sums the gradients of all rows of a batch inside the
tasks, adds the sums by (part, position) in a shuffle, and the driver gets one vector a site and
a site pair. Their size follows the network and the number of pairs, never the data. Write the
samples as a table first; every step scans them again, so use few batches on large data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schedules import ramp, sigmoid_ramp
from . import alignment as A

#: method -> how the charts of a pair are brought together.
METHODS = {
    "vanilla": None,
    "federated": None,
    "personalized": None,
    "cover": "identity",
    "bundle": "orthogonal",
    "flat": "frames",
    "diagonal": "closed diagonal",
    "trained_diagonal": "trained diagonal",
    "transport": "trained affine",
}


@dataclass(frozen=True)
class Training:
    """How to train. ``weight`` multiplies the pairs' loss and rises from ``low`` by ``ramp``; with ``decoder`` the
    triplets' share of the private loss rises as a sigmoid of ``steepness`` while reconstruction fades. With ``norm`` a decoder's hidden layers are
    normalised over the batch, and a share ``dropout`` of their units is left out, drawn for each row."""

    method: str = "flat"
    epochs: int = 5
    batches: int = 1
    rate: float = 1e-3
    decay: float = 0.0
    margin: float = 1.0
    weight: float = 1.0
    low: float = 0.0
    ramp: str = "none"
    layers: int = 3
    out: int = 2
    decoder: bool = False
    norm: bool = False
    dropout: float = 0.0
    steepness: float = 1.0
    shared_layers: float = 0.5
    seed: int = 80

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method: {self.method}")
        if not 0 <= self.dropout < 1 or (self.norm or self.dropout) and not self.decoder:
            raise ValueError("normalisation and dropout are of decoders, dropout below 1")
        if self.out != 2 and METHODS[self.method] in ("orthogonal", "frames", "closed diagonal"):
            raise ValueError("closed maps are for charts of two dimensions")


@dataclass
class Model:
    """Parameters: ``nets`` site -> flat vector, ``maps`` (i, j) -> flat vector of both sides' (M, t, s)."""

    dims: list[int]
    decoder: bool
    nets: dict[int, np.ndarray]
    maps: dict[tuple[int, int], np.ndarray]
    history: list[tuple[int, float, float]] = field(default_factory=list)
    #: Of normalised decoders: site -> running mean and variance of each hidden layer.
    running: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    norm: bool = False

    @property
    def normal(self) -> frozenset[int]:
        """Layers that are normalised: a decoder's, but for its last."""
        return frozenset(range(len(self.dims) - 1, len(self.shapes) - 1)) if self.norm else frozenset()

    @property
    def shapes(self) -> list[tuple[int, int]]:
        down = list(zip(self.dims, self.dims[1:]))
        return down + [(b, a) for a, b in reversed(down)] if self.decoder else down

    def table(self, spark: SparkSession) -> DataFrame:
        """agent, key, pos, v: every parameter; keys are layer<k>.weight and layer<k>.bias."""
        rows = [(site, key, k, float(v)) for site, flat in self.nets.items() for key, part in self.named(flat) for k, v in enumerate(part)]
        rows += [(site, key, k, float(v)) for site, own in self.running.items() for n, pair in enumerate(own) for key, part in zip((f"running{n}.mean", f"running{n}.var"), pair) for k, v in enumerate(part)]
        return spark.createDataFrame(rows, "agent int, key string, pos int, v double")

    def named(self, flat: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        at = 0
        for k, (a, b) in enumerate(self.shapes):
            sizes = [("layer", "weight", a * b), ("layer", "bias", b)] + [("norm", "weight", b), ("norm", "bias", b)] * (k in self.normal)
            for kind, name, size in sizes:
                yield f"{kind}{k}.{name}", flat[at : at + size]
                at += size


def layer_dims(inputs: int, layers: int, out: int) -> list[int]:
    """Every layer halves the width; the last one goes to ``out``."""
    return [inputs // 2**k for k in range(layers)] + [out]


def initial(spec: Training, inputs: int, sites: list[int], pairs: list[tuple[int, int]]) -> Model:
    """Weights uniform within sqrt(6 / (in + out)), biases zero; maps start as the identity."""
    model = Model(layer_dims(inputs, spec.layers, spec.out), spec.decoder, {}, {}, norm=spec.norm)
    rng = np.random.default_rng(spec.seed)
    for site in sorted(sites):
        parts = []
        for k, (a, b) in enumerate(model.shapes):
            bound = (6 / (a + b)) ** 0.5
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
            if k in model.normal:
                parts += [np.ones(b), np.zeros(b)]
        model.nets[site] = np.concatenate(parts)
        if spec.norm:
            model.running[site] = [(np.zeros(model.shapes[k][1]), np.ones(model.shapes[k][1])) for k in sorted(model.normal)]
    side = np.concatenate([np.eye(spec.out).ravel(), np.zeros(2 * spec.out)])
    model.maps = {p: np.concatenate([side, side]) for p in pairs}
    return model


def layers_of(flat: np.ndarray, shapes: list[tuple[int, int]], normal: frozenset[int] = frozenset()) -> list[tuple[np.ndarray, ...]]:
    """Weight and bias of each layer, and scale and shift of those that are normalised."""
    out, at = [], 0
    for k, (a, b) in enumerate(shapes):
        parts = [flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]]
        at += a * b + b
        if k in normal:
            parts += [flat[at : at + b], flat[at + b : at + 2 * b]]
            at += 2 * b
        out.append(tuple(parts))
    return out


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """Inputs of each layer and the last one's output; between layers negative values become zero."""
    steps = [x]
    for k, (w, b) in enumerate(layers):
        y = steps[-1] @ w + b
        steps.append(np.maximum(y, 0) if k + 1 < len(layers) else y)
    return steps


def backward(steps: list[np.ndarray], layers, slope: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients in the order of the flat vector, and the slope at the input."""
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(steps[k].T @ slope).ravel(), slope.sum(0), *parts]
        slope = slope @ layers[k][0].T
        if k:
            slope = slope * (steps[k] > 0)
    return parts, slope


#: Added to variances; the share of a batch in running means and variances.
NORM_EPS, MOMENTUM = 1e-5, 0.1


@dataclass
class Normals:
    """What the tasks need of a whole batch to normalise their rows: by site, mean and variance of each hidden layer, and
    on the way back the means of its slopes and of slopes times values. Both grow by a layer a pass. ``step`` and ``dropout`` draw the units left out."""

    step: int
    dropout: float
    seed: int
    stats: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    back: dict[int, list[tuple[np.ndarray, np.ndarray]]]

    def masks(self, keys: np.ndarray, layer: int, width: int) -> np.ndarray | float:
        """Zero for units left out, else 1 / (1 - dropout): a hash of row, layer, unit and step, so no matter which task holds a row."""
        if not self.dropout:
            return 1.0
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((self.seed * 1_000_003 + self.step) * 8191 + layer) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        x = x + np.arange(1, width + 1, dtype=np.uint64)[None] * np.uint64(0x94D049BB133111EB)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        u = (x ^ x >> np.uint64(31)) / 2.0**64
        return (u >= self.dropout) / (1 - self.dropout)


def normal_forward(z: np.ndarray, up, stats, mask) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """What each normalised layer held, the inputs of the next layer, and what that gives: the output, or before its normalisation the first layer without ``stats``."""
    held, h = [], z
    for k, (w, b, *scale) in enumerate(up):
        y = h @ w + b
        if not scale:
            break
        y = np.maximum(y, 0)
        if k == len(stats):
            break
        deviation = np.sqrt(stats[k][1] + NORM_EPS)
        value, on = (y - stats[k][0]) / deviation, mask(k, y.shape[1])
        held.append((h, y, value, on, deviation))
        h = (value * scale[0] + scale[1]) * on
    return held, h, y


def normal_backward(held, h, up, slope, back) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients in the order of the flat vector and the slope at the input; or, at the last layer that ``back`` does not know yet, the sums it wants."""
    w = up[-1][0]
    parts, slope = [(h.T @ slope).ravel(), slope.sum(0)], slope @ w.T
    for k in range(len(held) - 1, -1, -1):
        h, y, value, on, deviation = held[k]
        slope = slope * on
        scaled = slope * up[k][2]
        known = len(held) - 1 - k
        if known == len(back):
            return [scaled.sum(0), (scaled * value).sum(0)], slope
        own = (scaled - back[known][0] - value * back[known][1]) / deviation * (y > 0)
        parts = [(h.T @ own).ravel(), own.sum(0), (slope * value).sum(0), slope.sum(0), *parts]
        slope = own @ up[k][0].T
    return parts, slope


def batch_normals(samples: DataFrame, model: Model, spec: Training, alpha: float, step: int) -> Normals:
    """The normals of a batch: for each hidden layer one pass forward, then one pass back; a pass sums in the tasks and returns two vectors a site."""
    shapes, depth, nets, normal = model.shapes, len(model.dims) - 1, model.nets, model.normal
    found = Normals(step, spec.dropout, spec.seed, {s: [] for s in nets}, {s: [] for s in nets})

    def one_pass(forward_pass: bool) -> dict[int, np.ndarray]:
        def work(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for site, rows in batch.groupby("site"):
                    own, keys, a = layers_of(nets[site], shapes, normal), rows["key"].to_numpy(), np.stack(rows["xa"])
                    z = forward(a, own[:depth])[-1]
                    held, h, y = normal_forward(z, own[depth:], found.stats[site], lambda k, n: found.masks(keys, k, n))
                    if forward_pass:
                        both = [y.sum(0), (y * y).sum(0)]
                    else:
                        both, _ = normal_backward(held, h, own[depth:], 2 * (1 - alpha) * (y - a) / a.shape[1], found.back[site])
                    sums[site] = sums.get(site, 0) + np.concatenate([*both, [len(rows)]])
            if sums:
                yield pd.DataFrame({"site": list(sums), "g": list(sums.values())})

        parts = samples.where("other < 0").select("site", "key", "xa").mapInPandas(work, "site int, g array<double>")
        summed = parts.select("site", F.posexplode("g").alias("pos", "v")).groupBy("site", "pos").agg(F.sum("v").alias("v"))
        whole = summed.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("g"))
        return {r.site: np.array(r.g) for r in whole.select("site", F.col("g.v").alias("g")).collect()}

    for forward_pass in (True, False):
        for _ in normal:
            for site, g in one_pass(forward_pass).items():
                (first, second), n = np.split(g[:-1], 2), g[-1]
                pair = (first / n, np.maximum(second / n - (first / n) ** 2, 0)) if forward_pass else (first / n, second / n)
                (found.stats if forward_pass else found.back)[site].append(pair)
                if forward_pass:
                    k = len(found.stats[site]) - 1
                    mean, var = model.running[site][k]
                    model.running[site][k] = (1 - MOMENTUM) * mean + MOMENTUM * pair[0], (1 - MOMENTUM) * var + MOMENTUM * pair[1] * n / max(n - 1, 1)
    return found


def private_gradient(flat, shapes, depth, a, p, n, margin, alpha, normal=frozenset(), normals=None) -> tuple[np.ndarray, float]:
    """Sum of alpha * max(0, |a - p| - |a - n| + margin), and with a decoder (1 - alpha) * squared error / width of a.

    ``normals``: of a normalised decoder the batch's (stats, back, masks) of this site.
    """
    own = layers_of(flat, shapes, normal)
    down, up = own[:depth], own[depth:]
    rows = len(a)
    steps = forward(np.concatenate([a, p, n]), down)
    za, zp, zn = np.split(steps[-1], 3)
    to_p, to_n = za - zp, za - zn
    dp, dn = (np.linalg.norm(d, axis=1, keepdims=True) + 1e-12 for d in (to_p, to_n))
    loss = np.maximum(0, dp - dn + margin)
    on = alpha * (loss > 0)
    slope = np.concatenate([on * (to_p / dp - to_n / dn), -on * to_p / dp, on * to_n / dn])
    total, rest = alpha * float(loss.sum()), []
    if up and normals:
        stats, sums, mask = normals
        held, h, y = normal_forward(za, up, stats, mask)
        gap = y - a
        total += (1 - alpha) * float((gap * gap).sum()) / a.shape[1]
        rest, at_code = normal_backward(held, h, up, 2 * (1 - alpha) * gap / a.shape[1], sums)
        slope[:rows] += at_code
    elif up:
        back = forward(za, up)
        gap = back[-1] - a
        total += (1 - alpha) * float((gap * gap).sum()) / a.shape[1]
        rest, at_code = backward(back, up, 2 * (1 - alpha) * gap / a.shape[1])
        slope[:rows] += at_code
    parts, _ = backward(steps, down, slope)
    return np.concatenate(parts + rest), total


def mapped(z: np.ndarray, side: np.ndarray) -> np.ndarray:
    """(M z - t) / exp(s) of each row."""
    d = z.shape[1]
    m, t, s = side[: d * d].reshape(d, d), side[d * d : d * d + d], side[d * d + d :]
    return (z @ m.T - t) / np.exp(s)


def pair_gradient(flats, shapes, depth, maps, xi, xj) -> tuple[np.ndarray, float]:
    """Sum of |T_i z_i - T_j z_j|^2: gradients of both encoders (decoders: zero) and of both maps."""
    own = [layers_of(f, shapes[:depth]) for f in flats]
    steps = [forward(x, o[:depth]) for x, o in zip((xi, xj), own)]
    sides = np.split(maps, 2)
    gap = mapped(steps[0][-1], sides[0]) - mapped(steps[1][-1], sides[1])
    nets, turned = [], []
    for sign, st, o, side in zip((1, -1), steps, own, sides):
        z = st[-1]
        d = z.shape[1]
        scale = np.exp(-side[d * d + d :])
        slope = 2 * sign * gap * scale
        parts, _ = backward(st, o[:depth], slope @ side[: d * d].reshape(d, d))
        nets.append(np.concatenate(parts + [np.zeros(flats[0].size - sum(map(np.size, parts)))]))
        turned.append(np.concatenate([(slope.T @ z).ravel(), -slope.sum(0), -(2 * sign * gap * mapped(z, side)).sum(0)]))
    return np.concatenate(nets + turned), float((gap * gap).sum())


def gradient_sums(samples: DataFrame, model: Model, spec: Training, alpha: float, normals: Normals | None = None) -> dict[tuple[int, int], np.ndarray]:
    """(site, -1) or (i, j) -> summed gradient, then loss and number of rows."""
    shapes, depth, nets, maps, margin, normal = model.shapes, len(model.dims) - 1, model.nets, model.maps, spec.margin, model.normal

    def work(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for (site, other), rows in batch.groupby(["site", "other"]):
                a, p = np.stack(rows["xa"]), np.stack(rows["xp"])
                if other < 0:
                    keys = rows["key"].to_numpy()
                    own = normals and (normals.stats[site], normals.back[site], lambda k, n, keys=keys: normals.masks(keys, k, n))
                    g, loss = private_gradient(nets[site], shapes, depth, a, p, np.stack(rows["xn"]), margin, alpha, normal, own)
                else:
                    g, loss = pair_gradient((nets[site], nets[other]), shapes, depth, maps[site, other], a, p)
                sums[site, other] = sums.get((site, other), 0) + np.concatenate([g, [loss, len(rows)]])
        if sums:
            yield pd.DataFrame({"site": [k[0] for k in sums], "other": [k[1] for k in sums], "g": list(sums.values())})

    parts = samples.mapInPandas(work, "site int, other int, g array<double>")
    summed = parts.select("site", "other", F.posexplode("g").alias("pos", "v")).groupBy("site", "other", "pos").agg(F.sum("v").alias("v"))
    whole = summed.groupBy("site", "other").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("g"))
    return {(r.site, r.other): np.array(r.g) for r in whole.select("site", "other", F.col("g.v").alias("g")).collect()}


class Adam:
    """Moments of each vector by name; decay is added to the gradient."""

    def __init__(self, rate: float, decay: float) -> None:
        self.rate, self.decay, self.state = rate, decay, {}

    def step(self, name, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = gradient + self.decay * value
        m, v, n = self.state.get(name, (0.0, 0.0, 0))
        m, v, n = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, n + 1
        self.state[name] = (m, v, n)
        return value - self.rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)


def one_table(samples: DataFrame, shared: DataFrame | None) -> DataFrame:
    """site, other (-1: a triplet), key, xa, xp, xn: triplets (site, key, xa, xp, xn) and shared points (i, j, key, xi, xj)."""
    own = samples.select(F.col("site").cast("int").alias("site"), F.lit(-1).alias("other"), "key", "xa", "xp", "xn")
    if shared is None:
        return own
    return own.unionByName(shared.select(F.col("i").cast("int").alias("site"), F.col("j").cast("int").alias("other"), "key", F.col("xi").alias("xa"), F.col("xj").alias("xp"), F.col("xj").alias("xn")))


def encode_shared(shared: DataFrame, model: Model) -> DataFrame:
    """i, j, key, a0, a1, b0, b1: both sites' charts of their shared points."""
    shapes, depth, nets = model.shapes, len(model.dims) - 1, model.nets

    def work(batches):
        for batch in batches:
            for (i, j), rows in batch.groupby(["i", "j"]):
                za, zb = (forward(np.stack(rows[x]), layers_of(nets[s], shapes)[:depth])[-1] for x, s in (("xi", i), ("xj", j)))
                yield pd.DataFrame({"i": i, "j": j, "key": rows["key"], "a0": za[:, 0], "a1": za[:, 1], "b0": zb[:, 0], "b1": zb[:, 1]})

    return shared.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("key").cast("long").alias("key"), "xi", "xj").mapInPandas(work, "i int, j int, key long, a0 double, a1 double, b0 double, b1 double")


def encode(points: DataFrame, model: Model, site: str = "site", key: str = "key", x: str = "x") -> DataFrame:
    """site, key, z: the chart of every point by its site's encoder."""
    shapes, depth, nets = model.shapes, len(model.dims) - 1, model.nets

    def work(batches):
        for batch in batches:
            for s, rows in batch.groupby("site"):
                z = forward(np.stack(rows["x"]), layers_of(nets[s], shapes)[:depth])[-1]
                yield pd.DataFrame({"site": s, "key": rows["key"], "z": list(z)})

    return points.select(F.col(site).cast("int").alias("site"), F.col(key).cast("long").alias("key"), F.col(x).alias("x")).mapInPandas(work, "site int, key long, z array<double>")


def decode(codes: DataFrame, model: Model) -> DataFrame:
    """site, key, x: what the decoders make of charts (site, key, z); normalised ones by their running means, with all units."""
    if not model.decoder:
        raise ValueError("the model has no decoder")
    shapes, depth, nets, normal, running = model.shapes, len(model.dims) - 1, model.nets, model.normal, model.running

    def work(batches):
        for batch in batches:
            for s, rows in batch.groupby("site"):
                up, z = layers_of(nets[s], shapes, normal)[depth:], np.stack(rows["z"])
                made = normal_forward(z, up, running[s], lambda k, n: 1.0)[2] if normal else forward(z, up)[-1]
                yield pd.DataFrame({"site": s, "key": rows["key"], "x": list(made)})

    return codes.mapInPandas(work, "site int, key long, x array<double>")


def _sides(first, second) -> np.ndarray:
    zero = np.zeros(4)
    return np.concatenate([np.ravel(first), zero, np.ravel(second), zero])


def close_epoch(model: Model, spec: Training, shared: DataFrame | None, pairs: DataFrame, spark: SparkSession, frames: dict[int, list[float]]) -> None:
    """The method's update between epochs: closed maps from all shared points, or averaged parameters."""
    kind, eye = METHODS[spec.method], np.eye(2)
    if kind == "orthogonal":
        found = A.nearest_orthogonal(A.cross_covariance(encode_shared(shared, model)))
        model.maps |= {(r.i, r.j): _sides(eye, [r.o00, r.o01, r.o10, r.o11]) for r in found.collect()}
    elif kind == "closed diagonal":
        model.maps |= {(r.i, r.j): _sides(eye, np.diag([r.d0, r.d1])) for r in A.diagonal_map(encode_shared(shared, model)).collect()}
    elif kind == "frames":
        old = spark.createDataFrame([(s, *f) for s, f in frames.items()], "agent int, f00 double, f01 double, f10 double, f11 double")
        frames |= {r.agent: [r.f00, r.f01, r.f10, r.f11] for r in A.frame_update(encode_shared(shared, model), old).collect()}
        model.maps |= {(i, j): _sides(frames[i], frames[j]) for i, j in model.maps}
    elif spec.method in ("federated", "personalized"):
        names = [k for k, _ in model.named(next(iter(model.nets.values())))]
        some = A.late_layers(names, spec.shared_layers) if spec.method == "personalized" else None
        place, at = {}, 0
        for k, part in model.named(next(iter(model.nets.values()))):
            place[k], at = at, at + len(part)
        new = {s: flat.copy() for s, flat in model.nets.items()}
        for r in A.averaged(model.table(spark), pairs, some).collect():
            new[r.agent][place[r.key] + r.pos] = r.v
        model.nets = new


def train(samples: DataFrame, shared: DataFrame | None, pairs: DataFrame, spec: Training, inputs: int) -> Model:
    """A model of all sites that ``samples`` (site, key, xa, xp, xn) names; ``history`` has (epoch, private, pair) mean losses.

    ``shared`` (i, j, key, xi, xj) may be None for methods without a loss on pairs. Rows with null vectors are not
    used; sites without rows keep their first parameters. An empty table gives a model without sites.
    """
    spark, kind = samples.sparkSession, METHODS[spec.method]
    if kind and shared is None:
        raise ValueError(f"{spec.method} needs shared points")
    rows = one_table(samples, shared if kind else None).where("xa is not null and xp is not null and xn is not null")
    edges = [(r.i, r.j) for r in pairs.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).collect()]
    sites = {r.site for r in samples.select(F.col("site").cast("int").alias("site")).distinct().collect()}
    sites |= {s for e in edges for s in e} if sites else set()
    model = initial(spec, inputs, list(sites), edges)
    epoch = F.col("id")
    weights = spark.range(spec.epochs).select(ramp(spec.ramp, epoch, spec.epochs, spec.low, spec.weight).alias("w"), sigmoid_ramp(epoch, spec.epochs, spec.steepness).alias("a")).collect()
    adam, frames = Adam(spec.rate, spec.decay), {s: [1.0, 0.0, 0.0, 1.0] for s in sites}
    for e, (weight, alpha) in enumerate(weights if sites else []):
        private, pair = [], []
        for b in range(spec.batches):
            batch = rows if spec.batches == 1 else rows.where(F.pmod(F.xxhash64("key", F.lit(e)), F.lit(spec.batches)) == b)
            share = alpha if spec.decoder else 1.0
            normals = batch_normals(batch, model, spec, share, e * spec.batches + b) if model.normal else None
            sums = gradient_sums(batch, model, spec, share, normals)
            nets = {s: np.zeros_like(v) for s, v in model.nets.items()}
            for (site, other), g in sums.items():
                g, loss, n = g[:-2], g[-2], g[-1]
                if other < 0:
                    nets[site] += g / n
                    private.append(loss / n)
                    continue
                size = nets[site].size
                nets[site] += weight * g[:size] / n
                nets[other] += weight * g[size : 2 * size] / n
                pair.append(loss / n)
                if kind.startswith("trained"):
                    turn = weight * g[2 * size :] / n
                    if kind == "trained diagonal":
                        d = spec.out
                        turn = turn * np.tile(np.concatenate([np.eye(d).ravel(), np.zeros(2 * d)]), 2)
                    model.maps[site, other] = adam.step((site, other), model.maps[site, other], turn)
            model.nets = {s: adam.step(s, model.nets[s], g) for s, g in nets.items()}
        close_epoch(model, spec, shared, pairs, spark, frames)
        mean = lambda v: float(np.mean(v)) if v else 0.0
        model.history.append((e, mean(private), mean(pair)))
    return model


def save_checkpoint(model: Model, spark: SparkSession, root: str, name: str) -> str:
    """The parameters as Parquet in a folder whose name carries the last epoch and loss; returns its path."""
    epoch, private, pair = model.history[-1] if model.history else (-1, 0.0, 0.0)
    path = f"{root}/{name}_epoch{epoch}_loss{private + pair:.4f}_params"
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_checkpoint(spark: SparkSession, path: str, model: Model) -> Model:
    """``model`` with the parameters of a checkpoint."""
    rows = spark.read.parquet(path).groupBy("agent", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select("agent", "key", "x.v").collect()
    parts = {(r.agent, r.key): r.v for r in rows}
    nets = {s: np.concatenate([parts[s, k] for k, _ in model.named(flat)]) for s, flat in model.nets.items()}
    running = {s: [tuple(np.array(parts[s, f"running{n}.{name}"]) for name in ("mean", "var")) for n in range(len(own))] for s, own in model.running.items()}
    return Model(model.dims, model.decoder, nets, dict(model.maps), list(model.history), running, model.norm)
