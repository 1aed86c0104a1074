"""Projection and clustering of feature rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, id: str, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, pc1..pck) and the explained ratios. The covariance is aggregated on the cluster; only its matrix comes to the driver. Signs: the largest loading is positive."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            yield pd.DataFrame({"i": np.arange(len(s)), "n": n, "s": s, "c": list(c)})

    parts = df.select(vector).mapInPandas(moments, "i int, n long, s double, c array<double>")
    flat = parts.select("i", "n", "s", F.posexplode("c").alias("j", "c")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c")).toPandas()
    if not len(flat):
        return df.select(id, *[F.lit(None).cast("double").alias(f"pc{j + 1}") for j in range(k)]), [0.0] * k
    d = int(flat["i"].max()) + 1
    c, s = np.zeros((d, d)), np.zeros(d)
    c[flat["i"], flat["j"]], s[flat["i"]] = flat["c"], flat["s"]
    n = int(flat["n"].iloc[0])
    mean = s / n
    values, vectors = np.linalg.eigh(c / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    load = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    ratio = (values[order] / max(values.sum(), 1e-300)).tolist()
    pcs = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(v)) for v in load[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - float(mean @ load[:, j]) for j in range(load.shape[1])]
    return df.select(id, *[p.alias(f"pc{j + 1}") for j, p in enumerate(pcs)]), ratio


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows; the same for (a, b) and (b, a) to the last bit."""
    return ((a - b) ** 2).sum(-1)


def ward_merges(x: np.ndarray) -> np.ndarray:
    """Linkage (a, b, distance, size) by Ward's criterion on nearest-neighbour chains, sorted by distance. Distances are measured from the
    centres of the clusters as they are needed, so memory is that of x; the time is quadratic. Products of vectors find the few that can be nearest, differences decide."""
    n = len(x)
    x = np.asarray(x, float)
    centre = x - x.mean(0) if n else x
    size, norm, raw, chain = np.ones(n), (centre**2).sum(-1), [], []
    live, at = np.arange(n), np.arange(n)  # clusters that live, in ascending order (with some that ended since), and their rows
    ended = np.zeros(n, bool)
    for _ in range(n - 1):
        if not chain:
            chain = [int(live[np.flatnonzero(~ended)[0]])]
        while True:
            a = chain[-1]
            k = at[a]
            weight = 2 * size[k] * size / (size[k] + size)
            about, slack = norm + norm[k] - 2 * (centre @ centre[k]), 1e-12 * (norm + norm[k])
            out = ended.copy()
            out[k] = True
            can = np.flatnonzero(~out & (weight * (about - slack) <= np.min(weight * (about + slack), where=~out, initial=np.inf)))
            d = weight[can] * squared(centre[can], centre[k])
            best = int(d.argmin())
            b, least = int(live[can[best]]), d[best]
            if len(chain) > 1:
                before = at[chain[-2]]
                if weight[before] * squared(centre[before], centre[k]) <= least:
                    b = chain[-2]
                    least = weight[before] * squared(centre[before], centre[k])
                    break
            chain.append(b)
        chain = chain[:-2]
        raw.append((a, b, least))
        j = at[b]
        centre[k] = (size[k] * centre[k] + size[j] * centre[j]) / (size[k] + size[j])
        size[k] += size[j]
        norm[k] = (centre[k] ** 2).sum()
        ended[j] = True
        if ended.sum() * 4 > len(live):
            stay = ~ended
            live, centre, size, norm = live[stay], centre[stay], size[stay], norm[stay]
            ended = np.zeros(len(live), bool)
            at[live] = np.arange(len(live))
    names, out, counts = list(range(n)), [], np.ones(2 * n)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step, (a, b, dist) in enumerate(sorted(raw, key=lambda r: r[2])):
        i, j = find(a), find(b)
        p, q = sorted((names[i], names[j]))
        counts[n + step] = counts[p] + counts[q]
        out.append((p, q, np.sqrt(max(dist, 0)), counts[n + step]))
        root[j] = i
        names[i] = n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 1..k by order of first member."""
    root = np.arange(2 * n)
    for i, (a, b, *_) in reversed(list(enumerate(merges[: max(0, n - k)]))):
        root[int(a)] = root[int(b)] = root[n + i]
    out = root[:n]
    _, first, label = np.unique(out, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label] + 1


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right of the dendrogram."""
    if n < 2:
        return list(range(n))
    stack, out = [2 * n - 2], []
    while stack:
        i = stack.pop()
        if i < n:
            out.append(i)
        else:
            stack += [int(merges[i - n, 1]), int(merges[i - n, 0])]
    return out


def ward(df: DataFrame, group: str, id: str, vector: str, k: int) -> DataFrame:
    """(group, id, cluster, position in the dendrogram). A group is one analysis in one task, whose memory is that of its rows and whose time is quadratic; groups are spread."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id, kind="stable")
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        merges = ward_merges(x)
        place = np.empty(len(pdf), np.int64)
        place[leaf_order(merges, len(pdf))] = np.arange(len(pdf))
        return pd.DataFrame({group: pdf[group], id: pdf[id], "cluster": cut_tree(merges, len(pdf), min(k, len(pdf))), "place": place})

    kinds = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id} {kinds[id]}, cluster long, place long")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows by a matrix product; those of rows so near to each other that it would lose digits by their differences."""
    size = (x**2).sum(1)[:, None] + (y**2).sum(1)
    sq = size - 2 * (x @ y.T)
    near = np.flatnonzero(sq < 1e-5 * size)
    for k in range(0, len(near), 1 << 16):
        i, j = np.divmod(near[k : k + (1 << 16)], len(y))
        sq[i, j] = squared(x[i], y[j])
    return np.sqrt(sq, out=sq)


def silhouette(df: DataFrame, id: str, label: str, vector: str, least: int = 512, most: int = 32768) -> DataFrame:
    """(id, label, a, b, s) with Euclidean distances; rows alone in their label are left out. Rows are dealt to about 16 tiles, of `most`
    rows at most; each pair of tiles is a group, measured once as a matrix, strip by strip, and only sums per row and label leave it. A row moves once per tile."""
    plain = df.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    tiles = max(1, -(-df.count() // min(max(least, df.count() // 16), most)))
    pairs = plain.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = pairs.select(F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "id", "label", "v")

    def run(key, table):
        low, high = (k.as_py() for k in key)
        tile = table["t"].to_numpy()
        v = pc.list_flatten(table["v"]).to_numpy().astype(float).reshape(len(tile), -1)
        v -= v.mean(0)
        kinds, code = np.unique(table["label"].to_pandas().to_numpy(), return_inverse=True)
        ids = table["id"].to_pandas().to_numpy()
        x, y = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        sums = np.zeros((len(tile), len(kinds)))
        one = np.eye(len(kinds))[code]
        for k in range(0, len(y), 256):
            part = y[k : k + 256]
            for r in range(0, len(x), 4096):
                rows = x[r : r + 4096]
                d = distances(v[rows], v[part])
                sums[rows] += d @ one[part]
                if low != high:
                    sums[part] += d.T @ one[rows]
        counts = np.empty(sums.shape, np.int64)
        counts[x] = one[y].sum(0)
        if low == high:
            counts[x, code[x]] -= 1
        else:
            counts[y] = one[x].sum(0)
        m = len(kinds)
        return pa.table([pa.array(np.repeat(ids, m)), pa.array(np.repeat(kinds[code], m)), pa.array(np.tile(kinds, len(ids))), pa.array(sums.ravel()), pa.array(counts.ravel())], ["id", "label", "other", "d", "n"])

    kinds = {c: "long" if t in ("int", "smallint", "tinyint") else t for c, t in df.dtypes}
    parts = pairs.withColumns({c: F.col(c).cast(kinds[n]) for c, n in (("id", id), ("label", label))}).groupBy("i", "j").applyInArrow(run, f"id {kinds[id]}, label {kinds[label]}, other {kinds[label]}, d double, n long")
    means = parts.groupBy("id", "label", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).where("n > 0").withColumn("m", F.col("d") / F.col("n"))
    own = F.max(F.when(F.col("label") == F.col("other"), F.col("m")))
    near = F.min(F.when(F.col("label") != F.col("other"), F.col("m")))
    out = means.groupBy("id", "label").agg(own.alias("a"), near.alias("b")).where("a is not null and b is not null")
    return out.withColumn("s", F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).withColumnsRenamed({"id": id, "label": label})


def best_k(df: DataFrame, id: str, vector: str, labels: Sequence[str], least_share: float = 0.05) -> str | None:
    """The label column of greatest mean silhouette among those whose clusters all have the share of the rows; None if none has."""
    n, best = df.count(), (None, -2.0)
    for c in labels:
        small = df.groupBy(c).count().agg(F.min("count")).first()[0]
        if n and small is not None and small >= least_share * n:
            s = silhouette(df, id, c, vector).agg(F.avg("s")).first()[0]
            if s is not None and s > best[1]:
                best = (c, s)
    return best[0]


def diverse_pick(df: DataFrame, id: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """k rows, each the nearest to one of k centres (MLlib k-means)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(id, array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    near = model.transform(data).join(F.broadcast(centres), "prediction")
    d = F.aggregate(F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return near.withColumn("d", d).groupBy("prediction").agg(F.min_by(id, F.struct("d", id)).alias(id), F.count(F.lit(1)).alias("n"), F.sum("d").alias("inertia"))
