"""Exact nearest rows without all pairs: a metric partition searched under the triangle inequality.

Equal vectors are searched once.  Vectors are dealt to the nearest of a few hashed pivot vectors (about one per ``CELL_ROWS``,
found without counting the table, ``PIVOTS`` at most); large cells are cut into blocks, and neighbouring blocks make up an
area of about ``AREA_ROWS`` vectors, which is what a task holds while the vectors that visit it stream past.  A first pass
looks for neighbours in a vector's own area, which bounds the distance of its k-th neighbour.  A vector then travels once to
every other area that can hold something nearer, and is measured there only against blocks whose pivot is no farther away
than the bound plus the cell's radius.  The bound shrinks on the way.  Products in single precision find what can be among
the nearest, within their rounding; only that is measured component by component.

On data without structure nothing can be skipped: the work is that of all pairs, and a vector is sent once per area, not once
per block; ``compared`` tells.  Memory is bounded by an area.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from graticule.plans.lineage import cut
from graticule.plans.tiles import distances, weighed

CELL_ROWS = 512
PIVOTS = 4096
AREA_ROWS = 1 << 16
AREAS = 16  # at least, if there are as many blocks
TASKS = 64  # of a large table; areas are held by several tasks then
SLACK = 1e-6  # rounding of distances from inner products, relative to the size of the data
PAIRS = 1 << 16  # pairs measured component by component at once
VISITS = 1 << 13  # visiting rows, vectors included, of one frame
CHUNK = 512  # visiting rows and
RUN_ROWS = 2048  # held rows of one product
FOUND = "src long, dst long, dist double, compared long"
DEALT = "id long, v binary, cell int, d0 double"


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in single precision where that holds it exactly."""
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    fits = (narrow == x).all(axis=1)
    return [a.tobytes() if f else b.tobytes() for f, a, b in zip(fits, narrow, x)]


def _unpack(column: pd.Series, dims: int) -> np.ndarray:
    """(rows, dims), in single precision if all rows are."""
    held = list(column)
    sizes = {len(b) for b in held}
    if sizes == {4 * dims}:
        return np.frombuffer(b"".join(held), np.float32).reshape(-1, dims)
    if sizes == {8 * dims}:
        return np.frombuffer(b"".join(held), np.float64).reshape(-1, dims)
    return np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dims else np.float64) for b in held], float).reshape(-1, dims)


def _neighbouring(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones are mostly close: halves along the direction of the farthest row, again and again."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > 2:
            off = x[order[a:b]] - x[order[a:b]].mean(axis=0)
            order[a:b] = order[a:b][np.argsort(off @ off[(off * off).sum(axis=1).argmax()], kind="stable")]
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return order


class _Area:
    """The vectors of one area, block after block, and the search among them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: np.ndarray, cell_of: np.ndarray, pivots: np.ndarray, radius: np.ndarray, slack: float, k: int):
        self.pivots, self.slack, self.k = pivots, slack, k
        d0 = np.empty(len(x))
        for s in range(0, len(x), PAIRS):
            d0[s: s + PAIRS] = np.sqrt(((x[s: s + PAIRS] - pivots[cell_of[block[s: s + PAIRS]]]) ** 2).sum(axis=1))
        order = np.lexsort((d0, block))
        self.ids, self.x, self.d0 = ids[order], x[order], d0[order]
        self.blocks, start = np.unique(block[order], return_index=True)
        self.edges = np.append(start, len(x))
        self.cells = cell_of[self.blocks]
        self.radius = radius[self.cells]
        self.centre = pivots.mean(axis=0)
        size = ((self.x - self.centre) ** 2).sum(axis=1)
        self.longest = size.max()
        # single precision for vectors that are neither huge nor tiny
        self.kind = np.float32 if 1e-20 < self.longest < 1e30 else np.float64
        self.right = np.empty((x.shape[1] + 2, len(x)), self.kind)
        for s in range(0, len(x), PAIRS):
            self.right[:-2, s: s + PAIRS] = -2 * (self.x[s: s + PAIRS] - self.centre).T
        self.right[-2], self.right[-1] = 1, size
        self.buffer = np.empty(CHUNK * RUN_ROWS, self.kind)
        self.runs, at = [], 0
        for b in range(1, len(self.blocks) + 1):  # neighbouring blocks of RUN_ROWS rows together, or one
            if b == len(self.blocks) or self.edges[b + 1] - self.edges[at] > RUN_ROWS:
                self.runs.append((at, b))
                at = b

    def visit(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, name, compared) of up to ``CHUNK`` rows: their ``k`` nearest here that are no farther away than ``bound``, in order,
        ties to the smaller id, and how many rows the bounds left to measure.  Blocks of ``own`` come first."""
        x = x.astype(float)
        near, name = np.full((len(x), self.k), np.inf), np.full((len(x), self.k), -1)
        bound, compared = bound.copy(), np.zeros(len(x), np.int64)
        to_pivot = distances(x, self.pivots[self.cells])
        off = x - self.centre
        size = (off * off).sum(axis=1)
        kind = self.kind if size.max() < 1e30 else np.float64
        left = np.concatenate([off, size[:, None], np.ones((len(x), 1))], axis=1).astype(kind)
        unit = np.finfo(kind).eps / 2
        # of every sum of products, and of the components and squared lengths that enter it
        blur = unit * (2 * x.shape[1] + 10) * (size + self.longest) + 1e-37
        mine = [(a, b) for a, b in self.runs if np.isin(self.blocks[a:b], own).any()]
        for a, b in mine + [r for r in self.runs if r not in mine]:
            need = to_pivot[:, a:b] - self.radius[a:b] <= bound[:, None] + self.slack
            pieces = [(a, b)] if need.mean() > 0.5 else [(j, j + 1) for j in range(a, b)]
            for i, j in pieces:
                wanted = to_pivot[:, i:j] - self.radius[i:j] <= bound[:, None] + self.slack
                rows = np.flatnonzero(wanted.any(axis=1))
                if not len(rows):
                    continue
                for c in range(i, j):
                    sorted_d0 = self.d0[self.edges[c]: self.edges[c + 1]]
                    reach = bound[rows] + self.slack
                    inside = np.searchsorted(sorted_d0, to_pivot[rows, c] + reach, "right") - np.searchsorted(sorted_d0, to_pivot[rows, c] - reach)
                    compared[rows] += np.where(wanted[rows, c - i], inside, 0)
                for s in range(self.edges[i], self.edges[j], RUN_ROWS):
                    self._measure(ids, x, left, blur, rows, s, min(s + RUN_ROWS, self.edges[j]), bound, near, name)
        return near, name, compared

    def _measure(self, ids, x, left, blur, rows, start, stop, bound, near, name) -> None:
        """Rows against the vectors start .. stop - 1; near, name and bound are brought up to date."""
        k, n = self.k, stop - start
        some = left if len(rows) == len(left) else left[rows]
        d = np.dot(some, self.right[:, start:stop], out=self.buffer[: len(rows) * n].reshape(-1, n)) if left.dtype == self.kind else some @ self.right[:, start:stop]
        limit = bound[rows] ** 2 * (1 + 1e-12) + blur[rows]
        free = np.flatnonzero(np.isinf(limit))
        if len(free) and n > k + 1:  # the row itself may be among them
            limit[free] = np.partition(d[free], k, axis=1)[:, k].astype(float) + 2 * blur[rows][free]
        hit = np.flatnonzero(d <= np.nextafter(limit.astype(d.dtype), d.dtype.type(np.inf))[:, None])
        if not len(hit):
            return
        r, c = np.divmod(hit, n)
        r, c = rows[r], c + start
        other = self.ids[c] != ids[r]
        r, c = r[other], c[other]
        dist = np.empty(len(r))
        for s in range(0, len(r), PAIRS):
            at = slice(s, s + PAIRS)
            dist[at] = np.sqrt(((x[r[at]] - self.x[c[at]]) ** 2).sum(axis=1))
        kept = dist <= bound[r]
        r, c, dist = r[kept], c[kept], dist[kept]
        if not len(r):
            return
        u = np.unique(r)
        who = np.concatenate([np.repeat(u, k), r])
        what, value = np.concatenate([name[u].ravel(), self.ids[c]]), np.concatenate([near[u].ravel(), dist])
        order = np.lexsort((what, value, who))
        who, what, value = who[order], what[order], value[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        first = rank < k
        near[who[first], rank[first]], name[who[first], rank[first]] = value[first], what[first]
        bound[u] = np.minimum(bound[u], near[u, k - 1])


def _same(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Rows (id, v), their distinct vectors (id of the first row, v, _w), and how many there are of each."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    alike = weighed(rows, ["v"], "id")
    n = alike.agg(F.sum("_w"), F.count(F.lit(1))).first()
    return rows, alike, n[0] or 0, n[1]


def _search(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(src, dst, dist, compared) among ``n`` distinct vectors (id, v): candidates that hold the ``k`` nearest of every one, at most ``k``
    per area, and one row per area with an infinite distance that counts the vectors measured in it."""
    if not n:
        return rows.sparkSession.createDataFrame([], FOUND)
    h = F.xxhash64("id")
    chosen = rows.where(F.pmod(h, F.lit(CELL_ROWS)) == 0).orderBy(h, "id").limit(PIVOTS).select("v").collect()
    pivots = np.array([r["v"] for r in chosen or rows.orderBy(h).limit(1).select("v").collect()], float)  # a small table: one cell around any row
    pivots = pivots[_neighbouring(pivots)]
    dims = pivots.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), CELL_ROWS):
                g = pdf.iloc[start: start + CELL_ROWS]
                x = _stack(g["v"])
                d = distances(x, pivots)
                at = d.argmin(axis=1)
                yield pd.DataFrame({"id": g["id"], "v": _pack(x), "cell": at.astype(np.int32), "d0": d[np.arange(len(d)), at]})

    dealt = rows.select("id", "v").mapInPandas(assign, DEALT)
    stats = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d0").alias("r")).collect()  # at most one row per pivot
    radius, cuts, held = np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64), np.zeros(len(pivots))
    for s in stats:
        radius[s["cell"]], cuts[s["cell"]], held[s["cell"]] = s["r"], -(-s["n"] // (2 * CELL_ROWS)), s["n"]
    slack = SLACK * (1 + np.sqrt((pivots * pivots).sum(axis=1)).max() + max(radius.max(), 0.0))
    first = np.concatenate([[0], np.cumsum(cuts)])  # blocks of a cell are first[cell] .. first[cell + 1] - 1
    cell_of = np.repeat(np.arange(len(pivots)), cuts)
    upto = np.cumsum((held / cuts)[cell_of])
    areas = max(-(-n // AREA_ROWS), min(len(cell_of), AREAS))
    area_of = np.unique(np.minimum((upto - (held / cuts)[cell_of] / 2) * areas / n, areas - 1).astype(np.int64), return_inverse=True)[1]
    areas = int(area_of[-1]) + 1
    begins = np.searchsorted(area_of, np.arange(areas))  # the first block of every area
    slices = min(-(-TASKS // areas), max(1, n // (8 * CELL_ROWS * areas)))
    of = lambda values, at: F.element_at(F.array(*[F.lit(int(c)) for c in values]), at + 1)
    block = of(first[:-1], F.col("cell")) + F.pmod(F.xxhash64("id", F.lit(1)), of(cuts, F.col("cell")))
    blocked = dealt.select("id", "v", block.cast("int").alias("block"))
    kinds = "tile int, member boolean, block int, id long, v binary, bound double"
    area = of(area_of, F.col("block"))
    piece = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(slices))

    def holders(df: DataFrame) -> DataFrame:
        """Every vector in all tasks that hold its area."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        return df.select(spread.alias("s"), "*").select((area * slices + F.col("s")).cast("int").alias("tile"), F.lit(True).alias("member"), "block", "id", "v", F.lit(np.inf).alias("bound"))

    def run(visiting: DataFrame, members: DataFrame, result: Callable, schema: str) -> DataFrame:
        """``result`` of every chunk of visiting rows of a tile; one task per tile, its members first."""
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, place = [], None
            for pdf in batches:
                m = pdf[pdf["member"]]
                if len(m):
                    held.append((m["id"].to_numpy(), _unpack(m["v"], dims), m["block"].to_numpy()))
                q = pdf[~pdf["member"]]
                if len(q) and place is None and held:
                    place = _Area(*[np.concatenate(c) for c in zip(*held)], cell_of, pivots, radius, slack, k)
                    held = []
                for start in range(0, len(q) if place else 0, CHUNK):
                    part = q.iloc[start: start + CHUNK]
                    yield result(part, *place.visit(part["id"].to_numpy(), _unpack(part["v"], dims), part["bound"].to_numpy(), part["block"].unique()))

        # false sorts before true
        return visiting.unionByName(members).repartitionById(areas * slices, F.col("tile")).sortWithinPartitions(F.desc("member"), "block", "id").mapInPandas(work, schema)

    def at_home(part, near, name, compared):
        return pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "block": part["block"].to_numpy(), "bound": near[:, -1], "near": list(near), "name": list(name), "compared": compared - 1})

    home = blocked.select((area * slices + piece).cast("int").alias("tile"), F.lit(False).alias("member"), "block", "id", "v", F.lit(np.inf).alias("bound"))
    told = cut(run(home, holders(blocked), at_home, "id long, v binary, block int, bound double, near array<double>, name array<long>, compared long"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), CELL_ROWS):
                g = pdf.iloc[start: start + CELL_ROWS]
                d = distances(_unpack(g["v"], dims).astype(float), pivots)
                bound = g["bound"].to_numpy()
                may = (d - radius <= bound[:, None] + slack)[:, cell_of]
                may = np.logical_or.reduceat(may, begins, axis=1)
                may[np.arange(len(g)), area_of[g["block"].to_numpy()]] = False
                row, to = np.nonzero(may)
                tile = (to * slices + g["piece"].to_numpy()[row]).astype(np.int32)
                ids, v, blocks = g["id"].to_numpy(), g["v"].to_numpy(), g["block"].to_numpy()
                for s in range(0, len(row), VISITS):  # a row may visit every area: its copies are not held at once
                    at = row[s: s + VISITS]
                    yield pd.DataFrame({"tile": tile[s: s + VISITS], "member": False, "block": blocks[at], "id": ids[at], "v": v[at], "bound": bound[at]})

    def abroad(part, near, name, compared):
        src = part["id"].to_numpy()
        row, rank = np.nonzero(near < np.inf)
        return pd.DataFrame({"src": np.concatenate([src[row], src]), "dst": np.concatenate([name[row, rank], np.full(len(src), -1)]), "dist": np.concatenate([near[row, rank], np.full(len(src), np.inf)]),
                             "compared": np.concatenate([np.zeros(len(row), np.int64), compared])})

    visits = told.select("id", "v", "block", "bound", piece.cast("int").alias("piece")).mapInPandas(expand, kinds)
    found = run(visits, holders(told.select("block", "id", "v")), abroad, FOUND)
    zero = F.lit(0).cast("long")
    here = told.select(F.col("id").alias("src"), F.explode(F.arrays_zip("near", "name")).alias("e")).select("src", F.col("e.name").alias("dst"), F.col("e.near").alias("dist"), zero.alias("compared")).where("dst >= 0 OR dist < double('inf')")
    counted = told.select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(np.inf).alias("dist"), "compared")
    return found.unionByName(here).unionByName(counted)


def _first(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rk") <= k)


def nearest(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(src, dst, dist, rk): the exact ``k`` nearest other rows of every row, ties to the smaller key."""
    rows, alike, n, distinct = _same(df, key, vector)
    near = _first(_search(alike, distinct, k).where(F.col("dist") < float("inf")).select("src", "dst", "dist"), k)
    if n == distinct:
        return near
    # the first k + 1 rows of a vector stand for all of them
    members = cut(rows.join(alike.select("v", F.col("id").alias("first")), "v").select("first", "id"))
    few = members.withColumn("rk", F.row_number().over(Window.partitionBy("first").orderBy("id"))).where(F.col("rk") <= k + 1).select("first", "id")
    others = near.select("src", F.col("dst").alias("first"), "dist").join(few, "first").select("src", F.col("id").alias("dst"), "dist")
    each = _first(others.unionByName(few.select(F.col("first").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))), k + 1)
    lists = each.groupBy(F.col("src").alias("first")).agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("e"))  # k + 1 entries
    own = members.join(lists, "first").select(F.col("id").alias("src"), F.slice(F.filter("e", lambda e: e["dst"] != F.col("id")), 1, k).alias("e"))
    return own.select("src", F.posexplode("e").alias("at", "e")).select("src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"), (F.col("at") + 1).alias("rk"))


def compared(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(n, n_compared, share): rows, measured pairs and their share of all ordered pairs.  Equal rows are measured once."""
    _, alike, n, distinct = _same(df, key, vector)
    total = _search(alike, distinct, k).agg(F.lit(n).cast("long").alias("n"), F.sum("compared").alias("n_compared"))
    return total.select("n", "n_compared", F.try_divide(F.col("n_compared"), F.col("n") * (F.col("n") - 1)).alias("share"))
