"""Hard negatives by threshold joins in the manner of L2AP.

All rows are dealt into blocks and every anchor meets every block. A block is an inverted index: dimensions in order of their
energy, for each one the rows with that dimension. What a row leaves out is its beginning, the dimensions in which it and any
anchor together cannot reach the threshold by their norms. Scores are accumulated over the index, pairs that the norms of what
remains cannot lift over the threshold are dropped, and the dimensions left out are added for the others.

The join asks for the best few above a threshold. Anchors that get enough are done; for the others the threshold is lowered,
until there is none. First the positives are found so, then the windows of scores that the positives open are filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquill.session import materialize

#: Rows of a block, anchors taken at once and dimensions added at once: memory, not results.
BLOCK_ROWS, ANCHORS, CHUNK = 4096, 128, 16
#: Thresholds of the rounds, as parts of the largest possible score, and as places between the bounds of a window.
POSITIVE_ROUNDS, WINDOW_ROUNDS = (0.5, 0.25, 0.125, -np.inf), (0.75, 0.375, 0.0)
#: Norms below this keep every score a whole number that a double holds.
MOST_NORM = 2.0**26
_FOUND = "anchor bigint, window int, score bigint, id bigint, row bigint"


class Block:
    """Rows of one block as an inverted index."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        self.order = np.argsort((rows**2).sum(axis=0), kind="stable")  # little energy first: long beginnings are left out
        self.rows, self.labels, self.ids, self.numbers = rows[:, self.order], labels, ids, numbers
        self.norms = _prefix_norms(self.rows)

    def scores(self, anchors: np.ndarray, least: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Anchors by rows: the score where it is ``wanted`` and reaches ``least`` of its anchor, -inf elsewhere."""
        n_dims = max(anchors.shape[1], self.rows.shape[1])
        rows = np.pad(self.rows, ((0, 0), (0, n_dims - self.rows.shape[1])))
        order = np.concatenate([self.order, np.arange(len(self.order), n_dims)])
        anchors = np.pad(anchors, ((0, 0), (0, n_dims - anchors.shape[1])))[:, order]
        norms = np.pad(self.norms, ((0, 0), (0, n_dims + 1 - self.norms.shape[1])), mode="edge")
        own = _prefix_norms(anchors)
        covered = norms * own.max(axis=0) < least.min()
        cut = covered.sum(axis=1)  # bounds grow with the dimensions, so these are the first ones
        by_cut = np.argsort(cut, kind="stable")
        rows, norms, cut = rows[by_cut], norms[by_cut], cut[by_cut]
        cut = np.maximum(cut - 1, 0)  # of n + 1 prefixes; the empty one always is covered
        total = np.where(wanted[:, by_cut], 0.0, -np.inf)
        high = n_dims
        while high:
            low = max(0, high - CHUNK)
            some = np.searchsorted(cut, high)  # rows with a dimension in the chunk
            part = rows[:some, low:high] * (np.arange(low, high) >= cut[:some, None])
            total[:, :some] += anchors[:, low:high] @ part.T
            high = low
            missing = np.maximum(cut, high)  # of a row, the dimensions below are not added: left out, or still to come
            reach = total + own[:, missing] * norms[np.arange(len(norms)), missing]
            total[reach < least[:, None]] = -np.inf
            if high and np.isfinite(total).mean() < 0.1:
                break
        end = np.maximum(cut, high)
        a, b = np.nonzero(np.isfinite(total))
        width = int(end.max(initial=0))
        if width and len(a):
            step = max(1, (1 << 21) // width)
            for first in range(0, len(a), step):
                i, j = a[first : first + step], b[first : first + step]
                rest = rows[j, :width] * (np.arange(width) < end[j, None])
                total[i, j] += np.einsum("ij,ij->i", anchors[i, :width], rest)
        total[total < least[:, None]] = -np.inf
        found = np.empty_like(total)
        found[:, by_cut] = total
        return found

    def best(self, scores: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
        """Places of the ``n`` highest scores between the bounds, ties by id, highest first."""
        places = np.flatnonzero((scores >= low) & (scores <= high) & np.isfinite(scores))
        if len(places) > n:
            nth = np.partition(scores[places], len(places) - n)[len(places) - n]
            places = places[scores[places] >= nth]
        return places[np.lexsort((self.numbers[places], self.ids[places], -scores[places]))[:n]]


def _prefix_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of the first 0, 1, 2, ... dimensions, a little too large rather than too small."""
    squares = np.cumsum(np.pad(vectors**2, ((0, 0), (1, 0))), axis=1)
    return np.sqrt(squares) * (1 + 1e-9)


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n_dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), n_dims))
    out[np.arange(n_dims) < lengths[:, None]] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    n_dims = max(part.shape[1] for part in parts)
    return np.concatenate([np.pad(part, ((0, 0), (0, n_dims - part.shape[1]))) for part in parts])


def _meet(batches: Iterator[pa.RecordBatch], same_label: bool, n: int) -> Iterator[pa.RecordBatch]:
    """Blocks, each followed by the anchors: at most ``n`` rows of each block for every window of every anchor."""
    number, parts, block = None, [], None
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        numbers = column["block"].to_numpy(zero_copy_only=False)
        asks = column["asks"].to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1
        for first, end in zip([0, *edges], [*edges, len(numbers)]):
            if first == end:
                continue
            piece = {name: values.slice(first, end - first) for name, values in column.items()}
            vectors, labels, ids, rows = (
                _matrix(piece["vector"]),
                *(piece[name].to_numpy(zero_copy_only=False) for name in ("label", "own_id", "row")),
            )
            if not asks[first]:
                if number != numbers[first]:
                    number, parts, block = numbers[first], [], None
                parts.append((vectors, labels, ids, rows))
                continue
            if number != numbers[first]:
                continue  # a block without rows
            if block is None:
                columns = list(zip(*parts))
                block, parts = Block(_stacked(columns[0]), *map(np.concatenate, columns[1:])), []
            windows = piece["windows"].to_pylist()
            for at in range(0, len(rows), ANCHORS):
                some = slice(at, at + ANCHORS)
                least = np.array([min(w["low"] for w in own) for own in windows[some]])
                alike = labels[some, None] == block.labels
                wanted = alike & (rows[some, None] != block.numbers) if same_label else ~alike
                scores = block.scores(vectors[some], least, wanted)
                found = [
                    (anchor, window["window"], place, line[place])
                    for anchor, own, line in zip(rows[some], windows[some], scores)
                    for window in own
                    for place in block.best(line, window["low"], window["high"], n)
                ]
                if found:
                    anchors, opened, places, values = map(np.array, zip(*found))
                    ids_found = pa.array(block.ids[places], mask=block.ids[places] == np.iinfo(np.int64).max)
                    arrays = [pa.array(anchors), pa.array(opened, pa.int32()), pa.array(values.astype(np.int64)), ids_found, pa.array(block.numbers[places])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "window", "score", "id", "row"])


def _join(rows: DataFrame, asking: DataFrame, n_blocks: int, same_label: bool, n: int) -> DataFrame:
    """The ``n`` best rows of each window of ``asking(row, vector, label, windows)``, ties by id, NULL last."""
    none = F.lit(None).cast("array<struct<window:int,low:double,high:double>>")
    # An id that no row has stands for NULL, so that it sorts last.
    own_id = F.coalesce("id", F.lit(np.iinfo(np.int64).max)).alias("own_id")
    held = rows.select("block", F.lit(0).alias("asks"), "row", "vector", "label", own_id, none.alias("windows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    asks = asking.select(every, F.lit(1).alias("asks"), "row", "vector", "label", F.lit(0).cast("bigint").alias("own_id"), "windows")
    both = held.unionByName(asks).repartitionByRange(n_blocks, "block").sortWithinPartitions("block", "asks")
    found = both.mapInArrow(lambda batches: _meet(batches, same_label, n), _FOUND)
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def _windows(*bounds: tuple[Column, Column, Column]) -> Column:
    kind = "struct<window:int,low:double,high:double>"
    return F.array(*[F.struct(w.alias("window"), low.alias("low"), high.alias("high")).cast(kind) for w, low, high in bounds])


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "id",
    label_col: str = "label",
    vector_col: str = "vector",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of another label that score ``least`` to ``most`` % as high.

    ``anchors`` is a condition on the rows of ``vectors``. A row's score is its inner product with the anchor, higher first, ties
    by smaller id, NULL last. Positives are the first ``positives`` other rows with the anchor's label. Vectors hold whole numbers;
    a shorter one ends in zeros, and a norm of 2**26 or more, beyond which scores might be rounded, is an error.

    Rows with a NULL label, vector or component, or one that is not finite, take no part. Rows that repeat an id are rows of their
    own. A positive whose window holds nothing gives no row; an empty table gives none. Labels are numbers. Other columns are ignored.

    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.
    """
    numbers = F.transform(vector_col, lambda x: x.cast("double"))
    whole = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = vectors.where(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull()).where(whole)
    rows = materialize(
        taken.select(
            F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), numbers.alias("vector"),
            F.coalesce(anchors, F.lit(False)).alias("asking"), F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).first()
    if (size["norm"] or 0.0) >= MOST_NORM:
        raise ValueError(f"a vector has norm {size['norm']:g}; scores are exact below {MOST_NORM:g}")
    n_blocks = max(1, -(-size["n"] // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    highest = norm * (size["norm"] or 0.0)

    open_ = rows.where("asking").select("row", "id", "label", "vector")
    done = []
    for part in POSITIVE_ROUNDS:
        low = highest * part if np.isfinite(part) else F.lit(float("-inf"))
        asking = open_.withColumn("windows", _windows((F.lit(0), low, F.lit(float("inf")))))
        found = materialize(_join(rows, asking, n_blocks, True, positives), "positives")
        count = found.groupBy("anchor").count()
        if np.isfinite(part):
            count = count.where(F.col("count") >= positives)
        full = count.select(F.col("anchor").alias("row"))
        done.append(found.join(full, found["anchor"] == full["row"], "left_semi"))
        open_ = materialize(open_.join(full, "row", "left_anti"), "open-anchors")
        if open_.isEmpty():
            break
    near = done[0]
    for more in done[1:]:
        near = near.unionByName(more)
    near = materialize(near.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "near")

    # 50 * p <= 100 * n <= 95 * p in whole numbers; a window without a number between its bounds stays out.
    p = F.col("positive_score")
    bounds = near.withColumns({"low": F.ceil(p * least / 100.0).cast("double"), "high": F.floor(p * most / 100.0).cast("double")})
    open_ = materialize(bounds.where("low <= high").select("anchor", "window", "low", "high"), "open-windows")
    done = []
    for part in WINDOW_ROUNDS:
        now = F.col("low") + F.ceil((F.col("high") - F.col("low")) * part)
        own = F.struct("window", now.alias("low"), "high").cast("struct<window:int,low:double,high:double>")
        asked = open_.groupBy("anchor").agg(F.collect_list(own).alias("windows"))  # at most one window for each positive
        asking = rows.join(asked, rows["row"] == asked["anchor"]).select("row", "label", "vector", "windows")
        found = materialize(_join(rows, asking, n_blocks, False, negatives), "negatives")
        count = found.groupBy("anchor", "window").count()
        if part:
            count = count.where(F.col("count") >= negatives)
        full = count.select("anchor", "window")
        done.append(found.join(full, ["anchor", "window"], "left_semi"))
        open_ = materialize(open_.join(full, ["anchor", "window"], "left_anti"), "open-windows")
        if open_.isEmpty():
            break
    far = done[0]
    for more in done[1:]:
        far = far.unionByName(more)
    named = rows.where("asking").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        far.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near, ["anchor", "window"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def scaled(vector: Column, by: int = 256) -> Column:
    """Whole numbers ``floor(by * x)``, x as double; what is NULL or not finite stays so."""
    def whole(x: Column) -> Column:
        x = x.cast(T.DoubleType())
        finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(finite, F.floor(x * float(by)).cast("double")).otherwise(x)

    return F.transform(vector, whole)
