"""K-means and clustering errors over blocks of demand vectors.

Prefixes are packed into blocks (matrices of demand by source), each of one class, and blocks stay where they are. A problem is a class with
points, or with the prefixes that are clusters by themselves. A step gives the points to all tasks; each adds up what its
blocks hold for each cluster, Spark sums up, and the new points come back to the driver: as many numbers as all problems have points
times sources, whatever the number of prefixes. All problems that still move take part in one job a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from linkpeak.functions.ranking import top_per_group
from linkpeak.sources.generators import draw
from linkpeak.sources.tables import checkpointed

#: Prefixes of a block, and of a class that is one block; distances that are found at once, as few as caches hold, and the rows among them.
BLOCK, WHOLE, NEAR, PIECE = 2048, 1 << 16, 1 << 15, 256


@dataclass(frozen=True)
class Problem:
    """Clusters of the prefixes of a class: the nearest of points, or, of prefixes in order, each alone and the rest together."""

    of: str
    mode: str
    points: np.ndarray | None = None
    alone: np.ndarray | None = None

    @property
    def clusters(self) -> int:
        return len(self.points) if self.alone is None else len(self.alone) + 1

    def assigned(self, prefixes: np.ndarray, mat: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The cluster of each row: the nearest point by the sum of absolute differences to six digits, ties to the lowest cluster."""
        if self.alone is not None:
            order = np.argsort(self.alone)
            at = np.minimum(np.searchsorted(self.alone, prefixes, sorter=order), max(len(self.alone) - 1, 0))
            return np.where(self.alone[order[at]] == prefixes, order[at], len(self.alone)) if len(order) else np.zeros(len(prefixes), dtype=np.int64)
        x = mat if self.mode == "direct" else mat / scale[:, None]
        weight = scale if self.mode == "scaled" else np.ones(len(x))
        # Equal points tie, so that the first of them stands for all.
        _, first = np.unique(self.points, axis=0, return_index=True)
        first.sort()
        points = self.points[first]
        return first[_nearest(x, points, weight)]


def _nearest(x: np.ndarray, points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest point of each row. Short numbers find it first; rows where their error leaves several are compared in full.

    A sum of absolute differences is both sums less twice that of the smaller numbers, which fits 16 bits where none is negative. Rows
    stand side by side, so that an operation runs over many of them, however few the points are."""
    out = np.zeros(len(x), dtype=np.int64)
    width, of_rows, of_points = x.shape[1], np.abs(x).sum(axis=1), np.abs(points).sum(axis=1)
    size = of_rows + of_points.max(initial=0.0)
    least, most = min(x.min(initial=0.0), points.min(initial=0.0)), max(of_rows.max(initial=0.0), of_points.max(initial=0.0))
    small = least >= 0 and 0 < most < np.inf and width <= 8000
    # Numbers are off by half a unit each, on both sides of a comparison.
    unit = (32000 - width) / most if small else 1.0
    slack = ((width + 4) * 2.0**-21 * size + 2e-6 / weight + (2 * width / unit if small else 0.0)).astype(np.float32)
    kind = np.int16 if small else np.float32
    shown = (lambda a: np.rint(a * unit).astype(kind)) if small else (lambda a: a.astype(kind))
    many, rows_at_once = len(points), max(64, min(BLOCK, (1 << 20) // max(len(points), 1)))
    columns, across, sums = np.ascontiguousarray(shown(x).T), shown(points), of_points.astype(np.float32)
    for start in range(0, len(x), rows_at_once):
        some = columns[:, start : start + rows_at_once]
        rows = some.shape[1]
        far, piece = np.empty((many, rows), dtype=np.float32), min(PIECE, rows)
        step = max(1, NEAR // piece)
        for first in range(0, many, step):
            # A point beside each row: numpy is slow where an operand is one number.
            some_points = across[first : first + step].T[:, :, None]
            near = np.empty((*some_points.shape[:2], piece), dtype=kind)
            near[:] = some_points
            for at in range(0, rows, piece):
                own = some[:, at : at + piece]
                total, gap = np.zeros((near.shape[1], own.shape[1]), dtype=kind), np.empty((near.shape[1], own.shape[1]), dtype=kind)
                for s in range(width):
                    if small:
                        np.minimum(own[s], near[s, :, : own.shape[1]], out=gap)
                    else:
                        np.subtract(own[s], near[s, :, : own.shape[1]], out=gap)
                        np.abs(gap, out=gap)
                    np.add(total, gap, out=total)
                far[first : first + step, at : at + piece] = total
        if small:
            far *= np.float32(-2 / unit)
            far += sums[:, None]
        c, r = np.divmod(np.flatnonzero(far <= far.min(axis=0) + slack[start : start + rows_at_once]), rows)
        out[start + r] = c
        if len(r) > rows:
            several = np.bincount(r, minlength=rows)[r] > 1
            c, r = c[several], r[several] + start
            # By row, points in order.
            order = np.argsort(r, kind="stable")
            c, r = c[order], r[order]
            exact = np.zeros(len(r))
            for s in range(width):
                exact += np.abs(x[r, s] - points[c, s])
            exact = np.round(exact * weight[r], 6)
            begin = np.flatnonzero(np.diff(r, prepend=-1))
            best = exact == np.repeat(np.minimum.reduceat(exact, begin), np.diff(np.append(begin, len(r))))
            # The first of them is the last that is written.
            out[r[best][::-1]] = c[best][::-1]
    return out


def _sums(cluster: np.ndarray, x: np.ndarray, many: int) -> np.ndarray:
    return np.column_stack([np.bincount(cluster, weights=c, minlength=many) for c in x.T]) if len(x) else np.zeros((many, x.shape[1]))


def _totals(problem: Problem, prefixes: np.ndarray, mat: np.ndarray, scale: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By cluster the sums of vectors, and last what they are divided by."""
    x = mat / scale[:, None] if problem.mode == "normalized" else mat
    rows = np.column_stack([x, scale if problem.mode == "scaled" else np.ones(len(mat))])
    return _sums(problem.assigned(prefixes, mat, scale), rows * count[:, None], problem.clusters)


def _centres(own: np.ndarray) -> np.ndarray:
    return own[:, :-1] / np.where(own[:, -1:] == 0, 1.0, own[:, -1:])


def _settled(problem: Problem, prefixes: np.ndarray, mat: np.ndarray, scale: np.ndarray, count: np.ndarray, max_iter: int, tolerance: float) -> Problem:
    """The problem of a class that is one block, when its points hardly move any more; as Vectors.converged()."""
    least = tolerance * (mat.sum(axis=1) * count).sum() if problem.mode == "direct" else tolerance
    for _ in range(max_iter):
        new = _centres(_totals(problem, prefixes, mat, scale, count))
        change, problem = np.abs(new - problem.points).sum(), replace(problem, points=new)
        if change < least:
            break
    return problem


def _missed(problem: Problem, centres: np.ndarray, prefixes: np.ndarray, mat: np.ndarray, scale: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By cluster the demand that its centre misses, what it makes up, and its members."""
    cluster = problem.assigned(prefixes, mat, scale)
    gap = mat - centres[cluster] if problem.mode == "direct" else (mat / scale[:, None] - centres[cluster]) * scale[:, None]
    return _sums(cluster, np.column_stack([np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1), np.ones(len(mat))]) * count[:, None], problem.clusters)


class Alike:
    """The prefixes of a class that is one block, by distinct vectors: k-means puts equal ones into one cluster.

    Of equal points that it starts from, the first gets all members. The others move to zero, and stay there until one is the first point at
    zero and some vector is nearest to it. So each step looks at distinct points and at the first one at zero, however many are asked for.
    """

    def __init__(self, mode: str, prefixes: np.ndarray, mat: np.ndarray):
        self.mode = mode
        self.mat, kind, self.count = np.unique(mat, axis=0, return_inverse=True, return_counts=True)
        self.kind = kind.reshape(-1)
        total = self.mat.sum(axis=1)
        self.scale = np.where(total == 0, 1.0, total)
        self.vectors = self.mat if mode == "direct" else self.mat / self.scale[:, None]
        self.order = np.lexsort((prefixes, -mat.sum(axis=1)))
        self.start = self.kind[self.order]
        self.first = np.zeros(len(prefixes), dtype=bool)
        self.first[np.unique(self.start, return_index=True)[1]] = True
        #: By number of points how many of them differ.
        self.distinct = np.cumsum(self.first)

    def _step(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector, and the centres of the clusters."""
        cluster = Problem("", self.mode, points).assigned(self.kind, self.mat, self.scale)
        x, weight = (self.vectors, 1.0) if self.mode == "normalized" else (self.mat, self.scale if self.mode == "scaled" else 1.0)
        return cluster, _centres(_sums(cluster, np.column_stack([x * self.count[:, None], weight * self.count]), len(points)))

    def settled(self, k: int, max_iter: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """The points that may get members, from the k heaviest on, with their places among all k, when they hardly move any more; and
        whether more points equal to some of them would have changed nothing."""
        least = tolerance * (self.mat.sum(axis=1) * self.count).sum() if self.mode == "direct" else tolerance
        places, zeros = np.flatnonzero(self.first[:k]), np.flatnonzero(~self.first[:k])
        points, left, same = self.vectors[self.start[places]], np.abs(self.vectors[self.start[zeros]]).sum(), True

        def beside_zero() -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(places, zeros[:1])
            return np.insert(places, at, zeros[:1]), np.insert(points, at, 0.0, axis=0)

        for step in range(max_iter):
            if step:
                same = same and len(zeros) > 0
                places, points = beside_zero()
            cluster, new = self._step(points)
            change, left = np.abs(new - points).sum() + left, 0.0
            has = np.bincount(cluster, minlength=len(points)) > 0
            zeros = np.union1d(np.setdiff1d(zeros, places, assume_unique=True), places[~has])
            places, points = places[has], new[has]
            if change < least:
                # What points at zero moved in the first step is part of its change.
                same = same and step > 0
                break
        same = same and len(zeros) > 0
        return *beside_zero(), same

    def error(self, points: np.ndarray) -> float:
        """The demand that the centres of the nearest points miss or make up."""
        cluster, centres = self._step(points)
        gap = self.vectors - centres[cluster]
        return float((np.abs(gap).sum(axis=1) * self.count * (1.0 if self.mode == "direct" else self.scale)).sum())

    def errors(self, ladder: list[int], least: float, max_iter: int, tolerance: float) -> list[tuple[int, float]]:
        """The error with each number of clusters, up to the first that is no more than least."""
        out, known = [], None
        for k in ladder:
            if k == 1 or k == len(self.kind):
                error = self.error(np.zeros((1, self.mat.shape[1]))) if k == 1 else 0.0
            elif known and known[0] == self.distinct[k - 1]:
                # More points, but none that differs from those before.
                error = known[1]
            else:
                _, points, same = self.settled(k, max_iter, tolerance)
                error = self.error(points)
                known = (self.distinct[k - 1], error) if same else None
            out.append((k, error))
            if error <= least:
                break
        return out

    def clusters(self, k: int, max_iter: int, tolerance: float) -> np.ndarray:
        """The cluster of each prefix: one for all, each alone, or k-means."""
        if k == 1:
            return np.zeros(len(self.kind), dtype=np.int64)
        if k == len(self.kind):
            return np.argsort(self.order)
        places, points, _ = self.settled(k, max_iter, tolerance)
        return places[self._step(points)[0]][self.kind]


def _packed(sources: np.ndarray):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        mat = np.zeros((len(rows), len(sources)))
        at = np.repeat(np.arange(len(rows)), rows["srcs"].map(len))
        np.add.at(mat, (at, np.searchsorted(sources, np.concatenate(rows["srcs"].to_list()))), np.concatenate(rows["amounts"].to_list()))
        return pd.DataFrame({"class": [rows["class"].iloc[0]], "prefixes": [rows["prefix"].to_numpy(dtype=np.int64).tobytes()], "mat": [mat.tobytes()], "counts": [rows["n"].to_numpy(dtype=np.int64).tobytes()]})

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows of a block stand together, but a batch may end among them.
        kept = None
        for batch in part:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            same = [own for _, own in rows.groupby(["class", "piece"], sort=False)]
            yield from (block(own) for own in same[:-1])
            kept = same[-1] if same else None
        if kept is not None:
            yield block(kept)

    return run


def _blocks(pieces: DataFrame, sources: np.ndarray) -> DataFrame:
    """(class, prefixes, mat, counts): a block for each class and piece, whose rows stand together."""
    return checkpointed(pieces.select("class", "prefix", "srcs", "amounts", "n", "piece").mapInPandas(_packed(sources), "class string, prefixes binary, mat binary, counts binary"))


class Vectors:
    """Demand vectors by blocks."""

    def __init__(self, sources: np.ndarray, blocks: DataFrame, whole: frozenset[str] = frozenset()):
        self.sources, self.blocks, self.whole = sources, blocks, whole

    @classmethod
    def of(cls, demand: DataFrame) -> Vectors:
        """demand: src, prefix, demand and, if there are several, class; other columns do not matter.

        A class of up to WHOLE prefixes is one block, so that it can be solved where it lies; others are cut by hashes."""
        several = "class" in demand.columns
        rows = demand.select((F.col("class").cast("string") if several else F.lit("")).alias("class"), "prefix", "src", "demand")
        sources = np.sort(np.array([r["src"] for r in rows.select("src").distinct().collect()], dtype=np.int64))
        lists = rows.groupBy("class", "prefix").agg(F.collect_list(F.struct("src", "demand")).alias("c")).select("class", "prefix", F.col("c.src").alias("srcs"), F.col("c.demand").alias("amounts"))
        # One row for each class.
        sizes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.countDistinct("prefix").alias("n")).collect()} if several else {}
        if not several:
            pieces = lists.withColumn("piece", F.floor(F.monotonically_increasing_id() / BLOCK))
        else:
            counts = demand.sparkSession.createDataFrame([(c, 1 if n <= WHOLE else -(-n // BLOCK)) for c, n in sizes.items()], "class string, _pieces int")
            many = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            pieces = lists.join(F.broadcast(counts), "class").withColumn("piece", F.pmod(F.xxhash64("prefix"), F.col("_pieces"))).drop("_pieces")
            pieces = pieces.repartition(many, "class", "piece").sortWithinPartitions("class", "piece")
        return cls(sources, _blocks(pieces.withColumn("n", F.lit(1)), sources), frozenset(c for c, n in sizes.items() if n <= WHOLE))

    @classmethod
    def folded(cls, demand: DataFrame, apart: int) -> tuple[Vectors, np.ndarray, np.ndarray]:
        """demand (src, prefix, demand) as vectors without classes where equal ones are one row, named by their smallest prefix; and the ``apart``
        heaviest prefixes, in order, with their vectors, which stay rows of their own. Up to WHOLE rows are one block.

        Equal vectors are always of one cluster of k-means; for clusters of single prefixes only some of those apart may be named."""
        spark = demand.sparkSession
        cells = demand.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("src", "demand"))).alias("c")).select("prefix", F.col("c.src").alias("srcs"), F.col("c.demand").alias("amounts"))
        lists = checkpointed(cells.withColumn("scale", F.aggregate("amounts", F.lit(0.0), lambda total, x: total + x)))
        sources = np.array([r["src"] for r in lists.select(F.explode("srcs").alias("src")).distinct().orderBy("src").collect()], dtype=np.int64)
        heavy = lists.orderBy(F.desc("scale"), "prefix").limit(apart).collect()
        top, points = np.array([r["prefix"] for r in heavy], dtype=np.int64), np.zeros((len(heavy), len(sources)))
        for row, r in zip(points, heavy, strict=True):
            row[np.searchsorted(sources, r["srcs"])] = r["amounts"]
        names = spark.createDataFrame([(int(p),) for p in top], "own long").withColumn("prefix", F.col("own"))
        rows = lists.join(F.broadcast(names), "prefix", "left").groupBy("srcs", "amounts", "own").agg(F.min("prefix").alias("prefix"), F.count("*").alias("n"))
        rows = checkpointed(rows.select(F.lit("").alias("class"), "prefix", "srcs", "amounts", "n"), lists)
        whole = rows.count() <= WHOLE
        # Steps read the blocks over and over, so that these are dealt evenly once.
        rows = rows.coalesce(1) if whole else rows.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
        piece = F.lit(0) if whole else F.floor(F.monotonically_increasing_id() / BLOCK)
        return cls(sources, _blocks(rows.withColumn("piece", piece), sources), frozenset({""} if whole else ())), top, points

    def _over(self, problems: dict[int, Problem], work, schema: str, blocks: DataFrame | None = None) -> DataFrame:
        """What work gives for each block and problem of its class, or its problem (number, problem, prefixes, mat, scale, count)."""
        by_class: dict[str, list[tuple[int, Problem]]] = {}
        for number, problem in problems.items():
            by_class.setdefault(problem.of, []).append((number, problem))
        width = len(self.sources)

        def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def found() -> Iterator:
                for batch in part:
                    for row in batch.itertuples(index=False):
                        own = ((row.problem, problems[row.problem]),) if "problem" in batch else by_class.get(row[0], ())
                        prefixes, mat = np.frombuffer(row.prefixes, dtype=np.int64), np.frombuffer(row.mat).reshape(-1, width)
                        scale = mat.sum(axis=1)
                        scale = np.where(scale == 0, 1.0, scale)
                        count = np.frombuffer(row.counts, dtype=np.int64)
                        for number, problem in own:
                            yield number, problem, prefixes, mat, scale, count

            yield from work(found())

        return (self.blocks if blocks is None else blocks).mapInPandas(run, schema)

    def heaviest(self, wanted: dict[str, int], seed: int | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of each class the prefixes and vectors that k-means starts from: the wanted number of the heaviest, or of some drawn by seed."""
        most = max(wanted.values(), default=0)
        problems = {i: Problem(name, "direct", alone=np.zeros(0, dtype=np.int64)) for i, name in enumerate(wanted)}

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            for _, problem, prefixes, mat, scale, _ in rows:
                some = np.lexsort((prefixes, -scale))[: most if seed is None else len(prefixes)]
                yield pd.DataFrame({"class": problem.of, "prefix": prefixes[some], "scale": scale[some], "vector": [x.tobytes() for x in mat[some]]})

        order = [F.desc("scale"), F.col("prefix")] if seed is None else [draw(seed, "prefix"), F.col("prefix")]
        found = top_per_group(self._over(problems, work, "class string, prefix long, scale double, vector binary"), ["class"], order, most)
        found = found.withColumn("_r", F.row_number().over(_by_class(order)))
        out: dict[str, list] = {name: [] for name in wanted}
        for r in found.orderBy("class", "_r").collect():
            if len(out[r["class"]]) < wanted[r["class"]]:
                out[r["class"]].append((r["prefix"], np.frombuffer(bytes(r["vector"]))))
        return {name: (np.array([p for p, _ in rows], dtype=np.int64), np.array([v for _, v in rows]).reshape(len(rows), len(self.sources))) for name, rows in out.items()}

    def means(self, problems: dict[int, Problem]) -> dict[int, np.ndarray]:
        """The centre of each cluster of each problem, zero for clusters without members."""
        width = len(self.sources)

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for number, problem, *block in rows:
                found = _totals(problem, *block)
                sums[number] = sums[number] + found if number in sums else found
            for number, own in sums.items():
                c, at = np.nonzero(own)
                yield pd.DataFrame({"problem": number, "cluster": c, "at": at, "value": own[c, at]})

        found = self._over(problems, work, "problem int, cluster int, at int, value double", self._each(problems)).groupBy("problem", "cluster", "at").agg(F.sum("value").alias("value")).toPandas()
        out = {}
        for number, problem in problems.items():
            rows = found[found["problem"] == number]
            own = np.zeros((problem.clusters, width + 1))
            own[rows["cluster"], rows["at"]] = rows["value"]
            out[number] = _centres(own)
        return out

    def converged(self, problems: dict[int, Problem], max_iter: int = 150, tolerance: float = 1e-5) -> dict[int, Problem]:
        """The problems with points that hardly move any more: by tolerance in all, in mode direct by that share of a class's demand."""
        own = {number: problem for number, problem in problems.items() if problem.of in self.whole}
        out, moving = dict(problems), {number: problem for number, problem in problems.items() if number not in own}
        out |= self._settled(own, max_iter, tolerance) if own else {}
        totals = self.totals() if any(p.mode == "direct" for p in moving.values()) else {}
        for _ in range(max_iter):
            if not moving:
                break
            new = self.means(moving)
            still = {}
            for number, problem in moving.items():
                change = np.abs(new[number] - problem.points).sum()
                out[number] = replace(problem, points=new[number])
                if change >= (tolerance * totals.get(problem.of, 0.0) if problem.mode == "direct" else tolerance):
                    still[number] = out[number]
            moving = still
        return out

    def _settled(self, problems: dict[int, Problem], max_iter: int, tolerance: float) -> dict[int, Problem]:
        """converged() for classes that are one block: all steps in one job."""

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            for number, problem, *block in rows:
                yield pd.DataFrame({"problem": [number], "points": [_settled(problem, *block, max_iter, tolerance).points.tobytes()]})

        found = self._over(problems, work, "problem int, points binary", self._each(problems)).collect()
        return {r["problem"]: replace(problems[r["problem"]], points=np.frombuffer(bytes(r["points"])).reshape(-1, len(self.sources))) for r in found}

    def errors_up_to(self, ladders: dict[str, list[int]], least: dict[str, float], mode: str, max_iter: int = 150, tolerance: float = 1e-5) -> dict[tuple[str, int], float]:
        """For classes that are one block: the error with each number of clusters of its ladder, up to the first that is no more than its
        least; one cluster for all, each prefix alone, or k-means from the heaviest. One job."""
        problems = {i: Problem(name, mode) for i, name in enumerate(ladders)}

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            for _, problem, prefixes, mat, _, _ in rows:
                found = Alike(mode, prefixes, mat).errors(ladders[problem.of], least[problem.of], max_iter, tolerance)
                yield pd.DataFrame([(problem.of, *one) for one in found], columns=["class", "k", "error"])

        found = self._over(problems, work, "class string, k int, error double", self._dealt())
        return {(r["class"], r["k"]): r["error"] for r in found.collect()}

    def assignment_up_to(self, wanted: dict[str, int], mode: str, max_iter: int = 150, tolerance: float = 1e-5) -> DataFrame:
        """(class, prefix, cluster) of classes that are one block, each with its wanted number of clusters as errors_up_to() has them; their
        points stay where they lie."""
        problems = {i: Problem(name, mode) for i, name in enumerate(wanted)}

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            for _, problem, prefixes, mat, _, _ in rows:
                yield pd.DataFrame({"class": problem.of, "prefix": prefixes, "cluster": Alike(mode, prefixes, mat).clusters(wanted[problem.of], max_iter, tolerance)})

        return self._over(problems, work, "class string, prefix long, cluster int", self._dealt())

    def _each(self, problems: dict[int, Problem]) -> DataFrame:
        """The blocks, where these are whole classes once for each problem, a task each."""
        if not all(problem.of in self.whole for problem in problems.values()):
            return self.blocks
        pairs = [(number, problem.of, i) for i, (number, problem) in enumerate(problems.items())]
        rows = self.blocks.sparkSession.createDataFrame(pairs, "problem int, class string, task int")
        return self.blocks.join(F.broadcast(rows), "class").repartitionById(len(pairs), "task")

    def _dealt(self) -> DataFrame:
        """The blocks in more tasks than there are cores: a class may take far longer than another."""
        return self.blocks.repartition(4 * self.blocks.sparkSession.sparkContext.defaultParallelism)

    def totals(self) -> dict[str, float]:
        """The demand of each class."""
        width = len(self.sources)

        def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in part:
                sums = [float(np.frombuffer(m).reshape(-1, width).sum(axis=1) @ np.frombuffer(n, dtype=np.int64)) for m, n in zip(batch["mat"], batch["counts"], strict=True)]
                yield pd.DataFrame({"class": batch["class"], "total": sums})

        return {r["class"]: r["total"] for r in self.blocks.mapInPandas(run, "class string, total double").groupBy("class").agg(F.sum("total").alias("total")).collect()}

    def assignment(self, problems: dict[int, Problem]) -> DataFrame:
        """(problem, class, prefix, cluster)"""

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            for number, problem, prefixes, mat, scale, _ in rows:
                yield pd.DataFrame({"problem": number, "class": problem.of, "prefix": prefixes, "cluster": problem.assigned(prefixes, mat, scale)})

        return self._over(problems, work, "problem int, class string, prefix long, cluster int")

    def cluster_errors(self, problems: dict[int, Problem]) -> DataFrame:
        """(problem, cluster, error_pos, error_neg): demand that a cluster's centre misses, and what it makes up."""
        centres = self.means(problems)

        def work(rows: Iterator) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for number, problem, *block in rows:
                found = _missed(problem, centres[number], *block)
                sums[number] = sums[number] + found if number in sums else found
            for number, own in sums.items():
                some = np.flatnonzero(own[:, 2])
                yield pd.DataFrame({"problem": number, "cluster": some, "error_pos": own[some, 0], "error_neg": own[some, 1]})

        found = self._over(problems, work, "problem int, cluster int, error_pos double, error_neg double", self._each(problems))
        return found.groupBy("problem", "cluster").agg(F.sum("error_pos").alias("error_pos"), F.sum("error_neg").alias("error_neg"))

    def errors(self, problems: dict[int, Problem]) -> dict[int, tuple[float, float]]:
        """The same of all clusters of each problem."""
        found = self.cluster_errors(problems).groupBy("problem").agg(F.sum("error_pos").alias("pos"), F.sum("error_neg").alias("neg")).collect()
        return {r["problem"]: (r["pos"], r["neg"]) for r in found}


def _by_class(order: list) -> WindowSpec:
    return Window.partitionBy("class").orderBy(*order)


def started(vectors: Vectors, sizes: dict[str, int], mode: str, seed: int | None = None) -> dict[str, Problem]:
    """Each class with the points that its k-means starts from."""
    begin = vectors.heaviest(sizes, seed)
    out = {}
    for name, (_, points) in begin.items():
        scale = points.sum(axis=1, keepdims=True)
        out[name] = Problem(name, mode, points if mode == "direct" else points / np.where(scale == 0, 1.0, scale))
    return out
