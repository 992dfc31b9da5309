"""Poisson bootstrap: weights by a hash of row and replicate, summed in the tasks as arrays; medians, areas and refits of all replicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

_U = np.uint64
#: Weights of 2^16 equally likely draws of a Poisson variable with mean 1.
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_TABLE = np.searchsorted(_CDF, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
#: Cells of a weight matrix that a task holds at once.
CELLS = 1 << 21


#: Cells of a weight matrix that are hashed at once.
CACHED = 1 << 15
_ROUNDS = [(_U(30), _U(0xBF58476D1CE4E5B9)), (_U(27), _U(0x94D049BB133111EB))]


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in _ROUNDS:
        h = (h ^ (h >> shift)) * factor
    return h ^ (h >> _U(31))


def weights(ids: np.ndarray, draws: int, seed: int = 7) -> np.ndarray:
    """``(len(ids), draws)`` Poisson(1) weights that depend on the id, the replicate and the seed alone, so
    neither layout nor retries matter."""
    rows = _mix(np.asarray(ids, np.int64).view(_U) + _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    columns = _mix(np.arange(1, draws + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    out = np.empty((len(rows), draws), _TABLE.dtype)
    step = max(1, CACHED // max(1, draws))
    h, g = (np.empty((min(step, len(rows)), draws), _U) for _ in range(2))
    for at in range(0, len(rows), step):  # in place, as arrays that a core's cache holds take a third of the time
        part = rows[at : at + step, None]
        x, y = h[: len(part)], g[: len(part)]
        np.bitwise_xor(part, columns, out=x)
        for shift, factor in _ROUNDS:
            np.bitwise_xor(x, np.right_shift(x, shift, out=y), out=x)
            np.multiply(x, factor, out=x)
        # the last step of _mix leaves the upper 16 bits as they are
        np.take(_TABLE, np.right_shift(x, _U(48), out=x).view(np.int64), out=out[at : at + step], mode="wrap")
    return out


def replicate_sums(rows: DataFrame, key: Column, cell: Column, value: Column, draws: int, seed: int = 7, group: Column | None = None) -> DataFrame:
    """``(g, c, n, s)``: for each group and cell the replicates' weights and weighted sums, as arrays.

    A task sends one row a group and cell, whatever its rows; rows of one group and cell are then
    added up. Null values are left out.
    """

    def sums(batches):
        held: dict = {}
        for batch in batches:
            frame = batch.to_pandas()
            step = max(1, CELLS // 8 // draws)
            for name, places in frame.groupby(["g", "c"], sort=True).indices.items():
                n, s = held.setdefault(name, (np.zeros(draws), np.zeros(draws)))
                k, v = frame["k"].to_numpy()[places], frame["v"].to_numpy()[places]
                for at in range(0, len(k), step):
                    w = weights(k[at : at + step], draws, seed).astype(np.float64)
                    n += w.sum(0)
                    s += v[at : at + step] @ w
        for (g, c), (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([c], pa.int32()), pa.array([n], pa.list_(pa.float64())), pa.array([s], pa.list_(pa.float64()))], names=["g", "c", "n", "s"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": part["g"].iloc[:1], "c": part["c"].iloc[:1], "n": [np.sum(part["n"].to_list(), axis=0)], "s": [np.sum(part["s"].to_list(), axis=0)]})

    g = F.coalesce(group.cast("string"), F.lit("")) if group is not None else F.lit("")
    long = rows.select(g.alias("g"), cell.cast("int").alias("c"), key.cast("long").alias("k"), value.cast("double").alias("v")).where("v is not null and k is not null")
    schema = "g string, c int, n array<double>, s array<double>"
    return long.mapInArrow(sums, schema).groupBy("g", "c").applyInPandas(add, schema)


def interval(sums: DataFrame, level: float = 0.95) -> DataFrame:
    """``(g, low, high)``: the percentile interval of the replicates' means, linear between them."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, s = np.array(r["n"]), np.array(r["s"])
                m = s[n > 0] / n[n > 0]
                low, high = np.quantile(m, [(1 - level) / 2, (1 + level) / 2]) if len(m) else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]]), pa.array([low], pa.float64()), pa.array([high], pa.float64())], names=["g", "low", "high"])

    return sums.select("g", "n", "s").mapInArrow(run, "g string, low double, high double")


def nested_upper(sums: DataFrame, steps: int, level: float = 0.95) -> DataFrame:
    """``(g, c, upper)``: for cells 1 to ``steps`` that nest, the quantile of the replicates' means up to each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        draws = len(part["n"].iloc[0])
        n, s = np.zeros((steps, draws)), np.zeros((steps, draws))
        n[part["c"].to_numpy() - 1] = np.array(part["n"].to_list())
        s[part["c"].to_numpy() - 1] = np.array(part["s"].to_list())
        n, s = n.cumsum(0), s.cumsum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            upper = [np.quantile(m, level) if len(m := (b / a)[a > 0]) else None for a, b in zip(n, s)]
        return pd.DataFrame({"g": [part["g"].iloc[0]] * steps, "c": np.arange(1, steps + 1), "upper": upper})

    # a group has at most ``steps`` rows of two arrays
    return sums.groupBy("g").applyInPandas(run, "g string, c int, upper double")


#: Replicates whose arrays travel as one row, so that a reducer holds little however many tasks send.
BLOCK = 64


def _dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of the order, sorted, with the range's number ``_part``; materialised, so that passes agree."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def _blocks(part: int, draws: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """Rows ``(block, part, ...)``, each with a block of the replicates of every array."""
    at = list(range(0, draws, BLOCK))
    cols = [pa.array([b // BLOCK for b in at], pa.int32()), pa.array([part] * len(at), pa.int32())]
    cols += [pa.array([np.asarray(a, float)[b : b + BLOCK] for b in at], pa.list_(pa.float64())) for a in arrays.values()]
    return pa.RecordBatch.from_arrays(cols, names=["block", "part", *arrays])


def replicate_aurocs(rows: DataFrame, key: str, score: str, label: str, draws: int, seed: int = 7) -> DataFrame:
    """``(block, auroc)``: the AUROC of every replicate, ties exact; null where a replicate has one class only.

    Rows are dealt by range of the score (and the key, so that a value that very many rows have is dealt out, too). A range sends, for
    each replicate, the weights of its positives and negatives, the wins within it, and those weights of its first and
    last value; the reducer adds what ranges win against each other and corrects values that go on in the next range.
    """

    def run(batches):
        part, cum, wins, pos = None, np.zeros(draws), np.zeros(draws), np.zeros(draws)
        runs: list = []  # the first run and the one that is open: [value, positives, negatives]
        step = max(1, CELLS // draws)

        def close(r):
            nonlocal cum, wins, pos
            wins += r[1] * (cum + r[2] / 2)
            cum += r[2]
            pos += r[1]

        first = None
        for batch in batches:
            s, y, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "y", "k"))
            if len(s):
                part = batch.column("_part")[0].as_py()
            for at in range(0, len(s), step):
                v, p = s[at : at + step], y[at : at + step] == 1
                w = weights(k[at : at + step], draws, seed).astype(np.float64)
                starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                both = [np.add.reduceat(w * m[:, None], starts, axis=0) for m in (p, ~p)]
                for i, a in enumerate(starts.tolist()):
                    if runs and runs[-1][0] == v[a]:
                        runs[-1][1] += both[0][i]
                        runs[-1][2] += both[1][i]
                        continue
                    if runs:
                        done = runs.pop()
                        close(done)
                        first = first or done
                    runs.append([v[a], both[0][i].copy(), both[1][i].copy()])
        if runs:
            last = runs.pop()
            close(last)
            first = first or last
            ends = {"fp": first[1], "fn": first[2], "lp": last[1], "ln": last[2]}
            batch = _blocks(part, draws, pos=pos, neg=cum, wins=wins, **ends)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(first[0])] * n), pa.array([float(last[0])] * n)], names=[*batch.schema.names, "low", "high"])

    def add(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part")
        a = {c: np.array(found[c].to_list()) for c in ("pos", "neg", "wins", "fp", "fn", "lp", "ln")}
        before = np.cumsum(a["neg"], 0) - a["neg"]
        wins = (a["wins"] + a["pos"] * before).sum(0)
        # a value that goes on: its positives have won half too much against later ranges' negatives, and all against earlier ones'
        open_: list = []

        def settle():
            nonlocal wins
            p, n = (np.array([x[i] for x in open_]) for i in (0, 1))
            earlier = np.cumsum(n, 0) - n
            wins = wins + (p * (n.sum(0) - 2 * earlier - n) / 2).sum(0)

        value = None
        for i, (low, high) in enumerate(zip(found["low"], found["high"])):
            if value is not None and low == value:
                open_.append((a["fp"][i], a["fn"][i]))
                if high == low:
                    continue
            if len(open_) > 1:
                settle()
            value, open_ = high, [(a["lp"][i], a["ln"][i])]
        if len(open_) > 1:
            settle()
        total = a["pos"].sum(0) * a["neg"].sum(0)
        return pd.DataFrame({"block": found["block"].iloc[:1], "auroc": [[float(x) if t > 0 else None for x, t in zip(wins / np.maximum(total, 1), total)]]})

    long = rows.select(F.col(key).cast("long").alias("k"), F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("int").alias("y")).where("k is not null and s is not null and y is not null")
    arrays = ", ".join(f"{c} array<double>" for c in ("pos", "neg", "wins", "fp", "fn", "lp", "ln"))
    sent = _dealt(long, [F.col("s"), F.col("k")]).mapInArrow(run, f"block int, part int, {arrays}, low double, high double")
    return sent.groupBy("block").applyInPandas(add, "block int, auroc array<double>")  # a row a range, of BLOCK replicates


def replicate_medians(rows: DataFrame, key: str, value: str, draws: int, seed: int = 7, group: Column | None = None) -> DataFrame:
    """``(g, medians)``: every replicate's weighted median, the mean of the two middle elements where they differ.

    Rows are dealt by range of group and value (and key, so that a common value is dealt out). The first pass sums each
    range's weights by replicate; from the sums before it a range knows which replicates have a middle element in it, and the
    second pass sends just those elements.
    """
    g = F.coalesce(group.cast("string"), F.lit("")) if group is not None else F.lit("")
    long = rows.select(g.alias("g"), F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and k is not null")
    dealt = _dealt(long, [F.col("g"), F.col("v"), F.col("k")])
    step = max(1, CELLS // draws)

    def pieces(batches):
        """``(part, g, keys, values)`` of one group each, in order."""
        for batch in batches:
            frame = batch.to_pandas()
            for at in range(0, len(frame), step):
                for name, part in frame.iloc[at : at + step].groupby("g", sort=False):
                    yield int(part["_part"].iloc[0]), name, part["k"].to_numpy(), part["v"].to_numpy()

    def sums(batches):
        now, held = None, None
        for part, name, k, _ in pieces(batches):
            if (part, name) != now:
                if now:
                    yield pa.RecordBatch.from_arrays([pa.array([now[1]]), pa.array([now[0]], pa.int32()), pa.array([held], pa.list_(pa.int64()))], names=["g", "part", "w"])
                now, held = (part, name), np.zeros(draws, np.int64)
            held += weights(k, draws, seed).sum(0, dtype=np.int64)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[1]]), pa.array([now[0]], pa.int32()), pa.array([held], pa.list_(pa.int64()))], names=["g", "part", "w"])

    def offsets(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("part")
        w = np.array(found["w"].to_list())
        return pd.DataFrame({"g": found["g"], "part": found["part"], "before": list(np.cumsum(w, 0) - w), "total": [w.sum(0)] * len(w)})

    table = dealt.mapInArrow(sums, "g string, part int, w array<long>").groupBy("g").applyInPandas(offsets, "g string, part int, before array<long>, total array<long>")
    met = dealt.groupBy("_part").cogroup(cut(table).groupBy("part"))

    def elements(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, rows_ in part.sort_values(["g", "v", "k"]).groupby("g", sort=False):
            own = known[known["g"] == name].iloc[0]
            at, total = np.array(own["before"]), np.array(own["total"])
            k, v = rows_["k"].to_numpy(), rows_["v"].to_numpy()
            for a in range(0, len(v), step):
                upto = at + np.cumsum(weights(k[a : a + step], draws, seed), axis=0, dtype=np.int64)
                for middle in ((total - 1) // 2, total // 2):
                    r = np.flatnonzero((total > 0) & (at <= middle) & (middle < upto[-1]))
                    place = (upto[:, r] <= middle[r]).sum(0)
                    out.append(pd.DataFrame({"g": name, "r": r, "v": v[a : a + step][place]}))
                at = upto[-1]
        return pd.concat(out) if out else pd.DataFrame({"g": pd.Series(dtype=str), "r": pd.Series(dtype="int64"), "v": pd.Series(dtype=float)})

    each = met.applyInPandas(elements, "g string, r long, v double").groupBy("g", "r").agg(F.avg("v").alias("m"))
    return each.groupBy("g").agg(F.collect_list("m").alias("medians"))  # a number for each replicate


def logistic_refits(rows: DataFrame, key: str, features: list[str], y: str, l2: float, draws: int, seed: int = 7, rounds: int = 25) -> np.ndarray:
    """``(draws, features + 1)``: coefficients, the intercept last, of the logistic fit to each replicate: mean cross-entropy plus ``l2``
    times the squared norm, the intercept free.

    All replicates take Newton steps together. In a pass every task sums the weighted gradients and Hessians of its rows for all
    replicates, by matrix products; reducers add them up and solve a block of replicates each, and the driver gets the new
    coefficients. A replicate without both classes has none (not a number).
    """
    names = [*features]
    p = len(names) + 1
    width = 16
    x = cut(rows.select(F.col(key).cast("long").alias("k"), (F.col(y) == 1).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in names], F.lit(1.0)).alias("x")).where("k is not null and y is not null"))
    beta = np.zeros((draws, p))

    def one_pass(beta: np.ndarray) -> np.ndarray:
        def sums(batches):
            n, gradient, hessian = np.zeros((2, draws)), np.zeros((draws, p)), np.zeros((draws, p * p))
            for batch in batches:
                step = max(1, CELLS // draws)
                for at in range(0, batch.num_rows, step):
                    b = batch.slice(at, step)
                    xs = b.column("x").flatten().to_numpy().reshape(-1, p)
                    ys = b.column("y").to_numpy()
                    w = weights(b.column("k").to_numpy(), draws, seed).astype(np.float64)
                    q = 1 / (1 + np.exp(-np.clip(xs @ beta.T, -35, 35)))
                    n += np.stack([w.sum(0), ys @ w])
                    gradient += (w * (q - ys[:, None])).T @ xs
                    hessian += (w * q * (1 - q)).T @ (xs[:, :, None] * xs[:, None, :]).reshape(-1, p * p)
            for at in range(0, draws, width):
                block = slice(at, at + width)
                flat = np.concatenate([n[:, block].T, gradient[block], hessian[block]], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([at // width], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["block", "s"])

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            s = np.sum(part["s"].to_list(), axis=0).reshape(-1, 2 + p + p * p)
            at = int(part["block"].iloc[0]) * width
            penalty = np.full(p, 2 * l2)
            penalty[-1] = 0
            new = []
            for row, b in zip(s, beta[at : at + width]):
                n, pos = row[:2]
                if not 0 < pos < n:
                    new.append(np.full(p, np.nan))
                    continue
                step = np.linalg.solve(row[2 + p :].reshape(p, p) / n + np.diag(penalty + 1e-12), row[2 : 2 + p] / n + penalty * b)
                new.append(b - step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-12)))
            return pd.DataFrame({"block": part["block"].iloc[:1], "beta": [np.concatenate(new)]})

        found = x.mapInArrow(sums, "block int, s array<double>").groupBy("block").applyInPandas(solve, "block int, beta array<double>").collect()
        out = np.full((draws, p), np.nan)
        for r in found:
            b = np.array(r["beta"]).reshape(-1, p)
            out[r["block"] * width : r["block"] * width + len(b)] = b
        return out

    for _ in range(rounds):
        new = one_pass(np.nan_to_num(beta))
        moved = np.nanmax(np.abs(new - beta), initial=0.0) if np.isfinite(new).any() else 0.0
        beta = new
        if moved < 1e-8:
            break
    return beta
