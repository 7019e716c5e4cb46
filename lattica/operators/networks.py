"""Ensembles of autoencoders and the per-cell networks that attribution reads out of them.

Models train one to a task; their weights (kilobytes) come to the driver. Attribution runs over cells: a cell's task needs the
weights only and emits one packed array per cell, which is exploded as late as possible.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-10
MODEL_TYPES = ("ZINBAutoencoder", "NegativeBinomialAutoencoder", "Autoencoder")
METHODS = ("GradientShap", "GuidedBackprop", "Deconvolution")


def _softplus(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, a)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -60, 60)))


def _lgamma_digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Gamma and its derivative for x > 0: shifted by 6 for the asymptotic series."""
    shift, slope, y = np.zeros_like(x), np.zeros_like(x), x.copy()
    for _ in range(6):
        shift += np.log(y)
        slope += 1 / y
        y += 1
    r = 1 / (y * y)
    gamma = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / y - shift
    return gamma, np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r / 252)) - slope


#: Activations inside the chains: value and derivative. Other names mean relu.
ACTIVATIONS = {
    "relu": (lambda a: np.maximum(a, 0), lambda a: (a > 0).astype(float)),
    "leaky_relu": (lambda a: np.where(a > 0, a, 0.01 * a), lambda a: np.where(a > 0, 1.0, 0.01)),
    "elu": (lambda a: np.where(a > 0, a, np.expm1(np.minimum(a, 0))), lambda a: np.where(a > 0, 1.0, np.exp(np.minimum(a, 0)))),
    "sigmoid": (_sigmoid, lambda a: _sigmoid(a) * (1 - _sigmoid(a))),
}


class Model:
    """An encoder chain (hidden sizes, latent) and one decoder chain (hidden sizes reversed, genes) for each head.

    ``hidden`` is a size or a list of sizes, which may be empty. Heads: mu, theta and, zero-inflated, pi, all with softplus; a
    plain autoencoder has mu with ReLU.
    """

    def __init__(self, genes: int, latent: int = 8, hidden: int | list[int] = 64, kind: str = "ZINBAutoencoder", loss: str = "mse", seed: int = 0, activation: str = "relu") -> None:
        if kind == "Autoencoder" and loss not in ("mse", "logcosh"):
            raise ValueError("loss must be mse or logcosh")
        self.kind, self.loss_name, self.activation = kind, loss, activation.lower() if activation.lower() in ACTIVATIONS else "relu"
        self.heads = {"ZINBAutoencoder": ("mu", "theta", "pi"), "Autoencoder": ("mu",)}.get(kind, ("mu", "theta"))
        hidden = [hidden] if isinstance(hidden, int) else list(hidden)
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        self.layers = len(hidden) + 1
        for chain, sizes in (("e", [genes, *hidden, latent]), *((h, [latent, *reversed(hidden), genes]) for h in self.heads)):
            for k, (i, o) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
                self.p[f"{chain}{k}w"], self.p[f"{chain}{k}b"] = rng.uniform(-1, 1, (i, o)) / np.sqrt(i), np.zeros(o)

    def _chain(self, name: str, x: np.ndarray, seen: dict, dropout: float = 0.0, rng=None) -> np.ndarray:
        """What the last layer gives before its activation; ``seen`` keeps each layer's input, sums and dropout."""
        for k in range(self.layers):
            a = x @ self.p[f"{name}{k}w"] + self.p[f"{name}{k}b"]
            keep = (rng.random(a.shape) >= dropout) / (1 - dropout) if dropout and rng is not None and k < self.layers - 1 else 1.0
            seen[name, k] = (x, a, keep)
            x = ACTIVATIONS[self.activation][0](a) * keep
        return a

    def _out(self, a: np.ndarray) -> np.ndarray:
        return np.maximum(a, 0) if self.kind == "Autoencoder" else _softplus(a)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self._chain("e", x, {})

    def forward(self, x: np.ndarray, dropout: float = 0.0, rng=None) -> dict:
        """x, z and each head's output; dropout follows every hidden activation."""
        c: dict = {"x": x, "seen": {}}
        c["z"] = self._chain("e", x, c["seen"], dropout, rng)
        for k in self.heads:
            c[f"{k}a"] = self._chain(k, c["z"], c["seen"], dropout, rng)
            c[k] = self._out(c[f"{k}a"])
        return c

    def loss(self, c: dict) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradient by the heads' outputs."""
        y, mu = c["x"], c["mu"]
        if self.kind == "Autoencoder":
            d = mu - y
            if self.loss_name == "mse":
                return float((d * d).mean()), {"mu": 2 * d / d.size}
            return float((np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) - np.log(2)).mean()), {"mu": np.tanh(d) / d.size}
        th = np.minimum(c["theta"], 1e6)
        g1, d1 = _lgamma_digamma(th + EPS)
        g2, d2 = _lgamma_digamma(y + th + EPS)
        log = np.log1p(mu / (th + EPS))
        nb = g1 + _lgamma_digamma(y + 1.0)[0] - g2 + (th + y) * log + y * (np.log(th + EPS) - np.log(mu + EPS))
        dmu = (th + y) / (th + mu + EPS) - y / (mu + EPS)
        dth = d1 - d2 + log - (th + y) * mu / ((th + EPS) * (th + mu + EPS)) + y / (th + EPS)
        if "pi" not in self.heads:
            return float(nb.mean()), {"mu": dmu / y.size, "theta": dth / y.size}
        pi = np.clip(c["pi"], EPS, 1 - EPS)
        ratio = th / (th + mu + EPS)
        zero = ratio**th
        mix = pi + (1 - pi) * zero + EPS
        is0 = y < EPS
        out = np.where(is0, -np.log(mix), nb)
        inner = (1 - pi) * zero / mix
        dmu = np.where(is0, inner * th / (th + mu + EPS), dmu)
        dth = np.where(is0, -inner * (np.log(ratio) + 1 - ratio), dth)
        dpi = np.where(is0 & (c["pi"] < 1 - EPS), -(1 - zero) / mix, 0.0)
        return float(out.mean()), {"mu": dmu / y.size, "theta": dth / y.size, "pi": dpi / y.size}

    def gradients(self, c: dict, by: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g: dict[str, np.ndarray] = {}

        def back(name: str, da: np.ndarray) -> np.ndarray:
            for k in reversed(range(self.layers)):
                x, _, _ = c["seen"][name, k]
                g[f"{name}{k}w"], g[f"{name}{k}b"] = x.T @ da, da.sum(0)
                da = da @ self.p[f"{name}{k}w"].T
                if k:
                    _, a, keep = c["seen"][name, k - 1]
                    da = da * keep * ACTIVATIONS[self.activation][1](a)
            return da

        dz = 0
        for k in self.heads:
            dz = dz + back(k, by[k] * ((c[f"{k}a"] > 0) if self.kind == "Autoencoder" else _sigmoid(c[f"{k}a"])))
        back("e", dz)
        return g

    def jacobians(self, x: np.ndarray, rule: str = "plain", head: str = "mu") -> np.ndarray:
        """cells x targets x inputs; the rule sets what passes a ReLU backwards: plain, guided or deconv. Other activations pass
        their derivative."""
        seen: dict = {}
        out = self._chain(head, self._chain("e", x, seen), seen)

        def passed(g: np.ndarray, a: np.ndarray, relu: bool) -> np.ndarray:
            a = a[:, None]
            if not relu:
                return g * ACTIVATIONS[self.activation][1](a)
            return g * {"plain": a > 0, "guided": (a > 0) & (g > 0), "deconv": g > 0}[rule]

        # the outermost derivative is diagonal: it scales the rows of the last weights
        slope = {"plain": out > 0, "guided": out > 0, "deconv": np.ones_like(out, bool)}[rule] if self.kind == "Autoencoder" else _sigmoid(out)
        g = slope[:, :, None] * self.p[f"{head}{self.layers - 1}w"].T[None]
        for name, k in self._behind(head):
            if k < self.layers - 1:
                g = passed(g, seen[name, k][1], self.activation == "relu")
            g = g @ self.p[f"{name}{k}w"].T
        return g

    def _behind(self, head: str) -> list[tuple[str, int]]:
        """Layers before a head's last one, from the last to the first."""
        return [*((head, k) for k in reversed(range(self.layers - 1))), *(("e", k) for k in reversed(range(self.layers)))]

    def jacobian(self, x: np.ndarray, rule: str = "plain", head: str = "mu") -> np.ndarray:
        """targets x inputs for one cell."""
        return self.jacobians(x[None], rule, head)[0]


def train(x: np.ndarray, kind: str, epochs: int, latent: int, hidden: int | list[int], dropout: float, seed: int, lr: float = 1e-4, batch: int = 32, patience: int = 10, min_delta: float = 1e-3, every: int = 10, early_stop: bool = True, activation: str = "relu") -> Model | None:
    """Adam on a random 80 % of the cells, keeping the weights of the best validation; None if the loss is never finite."""
    rng = np.random.default_rng(seed)
    model, order = Model(x.shape[1], latent, hidden, kind, seed=seed, activation=activation), rng.permutation(len(x))
    n_val = max(1, len(x) // 5) if early_stop else 0
    val, own = x[order[:n_val]], x[order[n_val:]]
    m, v, t = {k: np.zeros_like(w) for k, w in model.p.items()}, {k: np.zeros_like(w) for k, w in model.p.items()}, 0
    best, saved, waited = np.inf, None, 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(own)), max(1, len(own) // batch)):
            c = model.forward(own[at], dropout, rng)
            grads, t = model.gradients(c, model.loss(c)[1]), t + 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if early_stop and (epoch + 1) % every == 0:
            now = model.loss(model.forward(val))[0]
            if now < best - min_delta:
                best, saved, waited = now, {k: w.copy() for k, w in model.p.items()}, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    if early_stop and epochs >= every:
        if saved is None:
            return None
        model.p = saved
    return model if np.isfinite(model.loss(model.forward(own))[0]) else None


def packed(expr: DataFrame) -> DataFrame:
    """cell_id, v: a cell's values in gene order."""
    return expr.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "x"))), lambda s: s["x"].cast("double")).alias("v"))


def model_zoo(expr: DataFrame, n_models: int = 10, epochs: int = 10_000, kind: str = "ZINBAutoencoder", dropout: float = 0.1, latent: int = 8, hidden: int | list[int] = 64, seed: int = 0, failures: int = 5, lr: float = 1e-4, early_stop: bool = True, activation: str = "relu") -> list[Model]:
    """Models trained in parallel, one to a task. An unknown kind is a negative binomial. Only if models don't converge, up to
    ``failures`` spare seeds are trained for them. The training matrix must fit a task, as any one model's must."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        i = int(df["model_id"].iloc[0])
        x = np.stack(df.sort_values("cell_id")["v"].to_numpy())
        model = train(x, kind, epochs, latent, hidden, dropout, seed + i, lr, early_stop=early_stop, activation=activation)
        return pd.DataFrame({"model_id": [i], "model": [pickle.dumps(model.__dict__) if model else None]})

    def trained(first: int, end: int) -> list[Model]:
        cells = packed(expr).withColumn("model_id", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
        out = []
        for r in cells.groupBy("model_id").applyInPandas(one, "model_id int, model binary").filter("model is not null").orderBy("model_id").collect():
            out.append(Model.__new__(Model))
            out[-1].__dict__.update(pickle.loads(r["model"]))
        return out

    out = trained(0, n_models)
    if len(out) < n_models and failures > 0:
        out += trained(n_models, n_models + failures)
    return out[:n_models]


def attribution_of_cells(model: Model, x: np.ndarray, method: str = "GradientShap", background: np.ndarray | None = None, raw: bool = False, samples: int = 5, seed: int = 0) -> np.ndarray:
    """cells x targets x sources. GradientShap: mean gradient at random points between a background and the cell, times their
    difference unless ``raw``; the points depend on the cell's values only."""
    if method == "GuidedBackprop":
        return model.jacobians(x, "guided")
    if method == "Deconvolution":
        return model.jacobians(x, "deconv")
    if method != "GradientShap":
        raise ValueError(f"unknown method {method}")
    background = np.zeros((1, x.shape[1])) if background is None else background
    rngs = [np.random.default_rng((seed, *np.abs(row[:4] * 1e3).astype(np.int64).tolist())) for row in x]
    total = 0
    for _ in range(samples):
        b = background[[r.integers(len(background)) for r in rngs]]
        g = model.jacobians(b + np.array([[r.random()] for r in rngs]) * (x - b))
        total = total + (g if raw else g * (x - b)[:, None])
    return total / samples


def attribution(model: Model, x: np.ndarray, method: str = "GradientShap", background: np.ndarray | None = None, raw: bool = False, samples: int = 5, seed: int = 0) -> np.ndarray:
    """targets x sources of one cell."""
    return attribution_of_cells(model, x[None], method, background, raw, samples, seed)[0]


def backgrounds(x: np.ndarray, kind: str = "zeros", seed: int = 0) -> np.ndarray:
    """zeros (also for unknown kinds), data, or randomize: every column permuted on its own; ValueError unless 2-D."""
    if x.ndim != 2:
        raise ValueError("two dimensions are needed")
    if kind == "data":
        return x
    return np.random.default_rng(seed).permuted(x, axis=0) if kind == "randomize" else np.zeros((1, x.shape[1]))


def attributions(models: list[Model], expr: DataFrame, method: str = "GradientShap", background: np.ndarray | None = None, raw: bool = False, swap_labels: bool = False) -> DataFrame:
    """cell_id, model_id, source, target, w for every cell, model and ordered pair of genes, self pairs included."""
    genes = [r[0] for r in expr.select("gene").distinct().orderBy("gene").collect()]
    kinds = dict(expr.dtypes)

    def run(batches):
        for b in batches:
            for i, model in enumerate(models):
                # cells of a block go together; a block's arrays stay below some 100 MB
                step = max(1, 4_000_000 // (len(genes) * max(len(genes), *map(max, (w.shape for w in model.p.values())))))
                for at in range(0, len(b), step):
                    part = b.iloc[at : at + step]
                    w = attribution_of_cells(model, np.stack(part["v"].to_numpy()), method, background, raw)
                    yield pd.DataFrame({"cell_id": part["cell_id"], "model_id": i, "w": list(w.reshape(len(part), -1))})

    wide = packed(expr).mapInPandas(run, f"cell_id {kinds['cell_id']}, model_id int, w array<double>")
    names = F.array(*map(F.lit, genes))
    out = wide.select("cell_id", "model_id", F.posexplode("w").alias("at", "w"))
    n = len(genes)
    source, target = F.element_at(names, F.col("at") % n + 1), F.element_at(names, F.expr(f"int(at div {n})") + 1)
    return out.select("cell_id", "model_id", *((target.alias("source"), source.alias("target")) if swap_labels else (source.alias("source"), target.alias("target"))), "w")


def infer(models: list[Model], expr: DataFrame, method: str = "GradientShap", strategy: str = "mean", **kw) -> DataFrame:
    """The per-cell network of an ensemble."""
    from lattica.operators.stats import aggregate_models

    return aggregate_models(attributions(models, expr, method, **kw), strategy)


def summaries(model: Model, expr: DataFrame, head: str = "mu", cells: DataFrame | None = None) -> DataFrame:
    """[cluster,] gene, mean of a head's output over cells."""
    genes = [r[0] for r in expr.select("gene").distinct().orderBy("gene").collect()]

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell_id": b["cell_id"], "out": list(model.forward(np.stack(b["v"].to_numpy()))[head])})

    rows = packed(expr).mapInPandas(run, f"cell_id {dict(expr.dtypes)['cell_id']}, out array<double>").select("cell_id", F.posexplode("out").alias("i", "x"))
    rows = rows.withColumn("gene", F.element_at(F.array(*map(F.lit, genes)), F.col("i") + 1))
    keys = ["gene"]
    if cells is not None:
        rows, keys = rows.join(cells, "cell_id"), ["cluster", "gene"]
    return rows.groupBy(*keys).agg(F.avg("x").alias("mean"))
