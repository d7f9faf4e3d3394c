"""Operator 13: vectors as codes of their parts, codebooks fitted over metric trees.

Each task turns blocks of vectors into one tree of balls for every part, by the anchors
hierarchy (Moore 2000): about root-many anchors are set middle-out, each stealing the
points nearer to it, joined upwards to a root and split downwards again.  A ball keeps
the sum and number of its points.  To assign points to entries a tree is walked from
the root with the list of entries that may still be nearest somewhere in the ball; an
entry leaves the list when another is nearer all over the ball, and a ball with one
entry left is counted as a whole.  Trees are built once and written; a round reads
them and sends sums by entry, nothing by vector.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import common_width, finite, scaled, ship, total_joined, written

#: Scaled components are held at this, so that squared distances stay exact in 64 bits.
MOST = 1 << 27
#: Points of a ball that is not split.
LEAF = 64


# ---- one tree, as flat arrays

def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = x - to
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _anchors(x: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    """Members dealt out to about root-many anchors; each point is with the nearest pivot."""
    dist = _distances(x[members], x[members[0]])
    far = np.argsort(-dist, kind="stable")
    pivots, owned, away = [members[0]], [members[far]], [dist[far]]
    while len(pivots) < max(2, int(np.sqrt(len(members)))):
        widest = max(range(len(away)), key=lambda a: away[a][0])
        if away[widest][0] == 0:
            break
        new = owned[widest][0]
        gaps = _distances(x[pivots], x[new])
        taken, taken_away = [], []
        for a, gap in enumerate(gaps):
            # a point nearer to its pivot than half the gap between the pivots stays
            n = int(np.searchsorted(-away[a], -gap / 2, "right"))
            if not n:
                continue
            d = _distances(x[owned[a][:n]], x[new])
            go = d < away[a][:n]
            if go.any():
                taken.append(owned[a][:n][go])
                taken_away.append(d[go])
                stay = np.ones(len(owned[a]), bool)
                stay[:n] = ~go
                owned[a], away[a] = owned[a][stay], away[a][stay]
        got, d = np.concatenate(taken), np.concatenate(taken_away)
        far = np.argsort(-d, kind="stable")
        pivots.append(new)
        owned.append(got[far])
        away.append(d[far])
    return owned


def _joined(x: np.ndarray, parts: list[np.ndarray]) -> list:
    """Nested pairs of part numbers: of all pairs of balls, the one whose union is smallest is joined first."""
    live = list(range(len(parts)))
    nodes: list = list(range(len(parts)))
    count = np.array([len(p) for p in parts], float)
    centre = np.array([x[p].mean(0) for p in parts])
    radius = np.array([_distances(x[p], c).max() for p, c in zip(parts, centre)])
    cost = np.full((len(parts), len(parts)), np.inf)

    def reach(a: int, others: np.ndarray) -> np.ndarray:
        """Bound of the radius of a's union with each of the others."""
        share = (count[others] / (count[others] + count[a]))[:, None]
        middle = centre[a] + share * (centre[others] - centre[a])
        return np.maximum(_distances(middle, centre[a]) + radius[a],
                          np.sqrt(((middle - centre[others]) ** 2).sum(1)) + radius[others])

    for k, a in enumerate(live[:-1]):
        others = np.array(live[k + 1:])
        cost[a, others] = reach(a, others)
    while len(live) > 1:
        a, b = divmod(int(cost.argmin()), len(parts))
        nodes[a] = [nodes[a], nodes[b]]
        middle = (centre[a] * count[a] + centre[b] * count[b]) / (count[a] + count[b])
        radius[a] = max(np.linalg.norm(middle - centre[a]) + radius[a], np.linalg.norm(middle - centre[b]) + radius[b])
        centre[a], count[a] = middle, count[a] + count[b]
        live.remove(b)
        cost[b], cost[:, b], cost[a], cost[:, a] = np.inf, np.inf, np.inf, np.inf
        others = np.array([o for o in live if o != a], int)
        if len(others):
            cost[np.minimum(a, others), np.maximum(a, others)] = reach(a, others)
    return nodes[live[0]]


def tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Balls over the rows of ``x`` (whole numbers): ``order`` lists the rows so that a ball is a range of it.

    ``lo, hi`` ball's range; ``left, right`` its halves, -1 at a leaf; ``total`` exact sum of its rows; ``radius``
    about its mean.  Ball 0 is the root; a ball comes before its halves.
    """
    f = x.astype(float)
    order: list[np.ndarray] = []
    lo, hi, left, right = [], [], [], []
    placed = 0
    # (what to place, ball that waits for it, side)
    todo: list = [(np.arange(len(x)), None, 0)]
    ends: list[int] = []
    while todo:
        what, above, side = todo.pop()
        if what is None:  # all of a ball's rows are placed
            hi[ends.pop()] = placed
            continue
        ball = len(lo)
        lo.append(placed)
        hi.append(placed)
        left.append(-1)
        right.append(-1)
        if above is not None:
            (left if side == 0 else right)[above] = ball
        if isinstance(what, np.ndarray) and len(what) > LEAF:
            parts = _anchors(f, what)
            if len(parts) > 1:
                def named(node):
                    return parts[node] if isinstance(node, int) else [named(node[0]), named(node[1])]
                what = named(_joined(f, parts))
        if isinstance(what, np.ndarray):
            order.append(what)
            placed += len(what)
            hi[ball] = placed
        else:
            ends.append(ball)
            todo += [(None, None, 0), (what[1], ball, 1), (what[0], ball, 0)]
    at = np.concatenate(order) if order else np.zeros(0, int)
    lo, hi = np.array(lo), np.array(hi)
    upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), x[at].cumsum(0)])
    total = upto[hi] - upto[lo]
    radius = np.array([_distances(f[at[a:b]], t / max(1, b - a)).max(initial=0) for a, b, t in zip(lo, hi, total)])
    return {"order": at.astype(np.int32), "x": x[at].astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
            "left": np.array(left, np.int32), "right": np.array(right, np.int32), "total": total, "radius": radius}


def nearest(t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry of every row in the tree's order, sums and counts by entry, and how many rows were compared one by one.

    Ties go to the lower entry.  Rounding never decides: an entry leaves a list only by a
    margin beyond it, and rows are compared in whole numbers.
    """
    k = len(book)
    entries = book.astype(float)
    apart = np.sqrt(np.maximum(0, ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)))
    first = np.sort(np.unique(book, axis=0, return_index=True)[1])  # an equal entry of a higher number is never taken
    code = np.zeros(len(t["x"]), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(k, np.int64)
    size = (t["hi"] - t["lo"]).astype(np.int64)
    centre = t["total"] / np.maximum(size, 1)[:, None]
    singly = []
    todo = [(0, first)] if len(t["x"]) else []
    while todo:
        ball, cand = todo.pop()
        if len(cand) > 1:
            d = entries[cand] - centre[ball]
            d = np.einsum("ij,ij->i", d, d)
            best = int(d.argmin())
            # c is farther than the best one all over the ball if its square exceeds by twice radius times their gap
            cand = cand[d - d[best] <= 2 * t["radius"][ball] * apart[cand[best], cand] + 1e-9 * (d + 1)]
        a, b = t["lo"][ball], t["hi"][ball]
        if len(cand) == 1:
            code[a:b] = cand[0]
            sums[cand[0]] += t["total"][ball]
            counts[cand[0]] += b - a
        elif t["left"][ball] < 0:
            code[a:b] = cand[_squared(t["x"][a:b], book[cand]).argmin(1)]
            singly.append(np.arange(a, b))
        else:
            todo += [(t["right"][ball], cand), (t["left"][ball], cand)]
    if singly:
        at = np.concatenate(singly)
        np.add.at(sums, code[at], t["x"][at].astype(np.int64))
        counts += np.bincount(code[at], minlength=k)
    return code, sums, counts, sum(map(len, singly))


def _squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers; by a matrix product where doubles hold them exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 52:
        f, e = x.astype(float), book.astype(float)
        return (e * e).sum(1) - 2 * (f @ e.T)  # the row's own square is the same for all entries
    x = x.astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], 1)


# ---- the distributed rounds

def _pack(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{j}_{name}": a for j, t in enumerate(trees) for name, a in t.items()})
    return out.getvalue()


def _unpack(data: bytes, parts: int) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data)) as z:
        return [{name: z[f"{j}_{name}"] for name in ("order", "x", "lo", "hi", "left", "right", "total", "radius")}
                for j in range(parts)]


def _edges(width: int, parts: int) -> list[int]:
    return [j * width // parts for j in range(parts + 1)]


def tree_blocks(vectors: DataFrame, width: int, parts: int, scale: int, block_rows: int) -> DataFrame:
    """``(k, y, v)`` rows -> ``ids, labels, trees``: a row for each block, its trees as one binary value."""
    edges = _edges(width, parts)
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("k", "y")]

    def block(held):
        t = pa.Table.from_batches(held).combine_chunks()
        x = scaled(t.column("v").chunk(0), width, scale, MOST)
        trees = [tree(x[:, a:b]) for a, b in zip(edges, edges[1:])]
        ends = pa.array([0, t.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, t.column(c).chunk(0)) for c in ("k", "y")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_pack(trees)], pa.binary())], names=["ids", "labels", "trees"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, block_rows - n)
                held.append(piece)
                n += piece.num_rows
                at += piece.num_rows
                if n == block_rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return vectors.select("k", "y", "v").mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees binary")


def next_books(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign every part, then put each entry at its parts' sum over count, rounded down."""
    shape = [(len(b), b.shape[1] + 1) for b in books]
    offset = np.cumsum([0] + [k * w for k, w in shape])

    def run(batches):
        held = [np.zeros(s, object) for s in shape]
        for b in batches:
            for data in b.column(0):
                for j, t in enumerate(_unpack(data.as_py(), len(books))):
                    _, sums, counts, _ = nearest(t, books[j])
                    held[j] += np.concatenate([sums, counts[:, None]], 1)
        flat = np.concatenate([h.ravel() for h in held]) if held else np.zeros(0, object)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([int(v) for v in flat[at]], pa.decimal128(38, 0))],
                                         names=["slot", "v"])

    part = trees.select("trees").mapInArrow(run, "slot long, v decimal(38,0)")
    table = part.groupBy("slot").agg(F.sum("v").alias("v")).toArrow()  # entries times components, whatever the rows
    flat = np.zeros(offset[-1], object)
    for s, v in zip(table.column("slot").to_pylist(), table.column("v").to_pylist()):
        flat[s] = int(v)
    out = []
    for j, b in enumerate(books):
        got = flat[offset[j]:offset[j + 1]].reshape(shape[j])
        new = b.copy()
        for e in np.flatnonzero(got[:, -1]):
            new[e] = [s // got[e, -1] for s in got[e, :-1]]
        out.append(new)
    return out


def coded(trees: DataFrame, books: list[np.ndarray], kinds: tuple[str, str]) -> DataFrame:
    """``k, y, code, error`` of every vector."""
    digits = [max(2, len(f"{len(b) - 1:x}")) for b in books]
    names = [pa.array([f"{e:0{d}x}" for e in range(len(b))]) for b, d in zip(books, digits)]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values
                error = np.zeros(len(ids), np.int64)
                texts = []
                for j, t in enumerate(_unpack(b.column("trees")[i].as_py(), len(books))):
                    in_order = nearest(t, books[j])[0]
                    e = np.zeros(len(ids), np.int64)
                    e[t["order"]] = in_order
                    error[t["order"]] += ((t["x"].astype(np.int64) - books[j][in_order]) ** 2).sum(1)
                    texts.append(names[j].take(pa.array(e)))
                code = pc.binary_join_element_wise(*texts, "")
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(error)], names=["k", "y", "code", "error"])

    return trees.mapInArrow(run, f"k {kinds[0]}, y {kinds[1]}, code string, error long")


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block_rows: int = 8192,
             key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, label, code, error, label_error, codebooks_sha256`` of every vector.

    A component counts as ``floor(scale * x)``.  The vectors are cut into ``parts`` consecutive
    parts (equal ones if the length allows); a part's codebook starts as that part of the ``entries``
    rows with the smallest key and takes ``rounds`` rounds of assignment (squared Euclidean distance,
    ties to the lower entry) and means rounded down; unused entries stay.  ``error`` is the final
    squared distance over all parts, ``label_error`` its sum over equal labels (nulls together).
    Results are exact, so they don't depend on blocks, tasks or tree shapes.

    Rows whose vector is null, empty or holds null or non-finite components are left out, as are
    vectors of another length than most have.  Scaled components beyond 2^27 are held there.
    Null keys come last in the start; rows with equal keys are taken by vector, repeated rows
    count each.  Fewer rows than ``entries`` give smaller codebooks.  An empty table gives no
    rows; other columns are left out.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = finite(rows.select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(vector).alias("v")), "v")
    width = common_width(vectors, "v")
    vectors = vectors.where(F.size("v") == width) if width else vectors.where("false")
    kinds = tuple(vectors.schema[c].dataType.simpleString() for c in ("k", "y"))
    if not width:
        return vectors.select(F.col("k").alias(key), F.col("y").alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    start = vectors.orderBy(F.asc_nulls_last("k"), "v").limit(entries).select("v").toArrow()  # at most ``entries`` rows
    x = scaled(start.column("v").combine_chunks(), width, scale, MOST)
    edges = _edges(width, parts)
    books = [x[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    trees = written(tree_blocks(vectors, width, parts, scale, block_rows), "part-trees")
    for _ in range(rounds):
        books = next_books(trees, books)
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    out = written(coded(trees, books, kinds), "part-codes")
    totals = out.groupBy("y").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = total_joined(out, totals, "y", "label_error")
    return out.select(F.col("k").alias(key), F.col("y").alias(label), "code", "error", "label_error",
                      F.lit(digest).alias("codebooks_sha256"))
