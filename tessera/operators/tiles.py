"""Pixel tables as tiles: one exchange by (image, tile) with a rim of neighbours, then any number of local steps on arrays.

A tile is ``TILE`` x ``TILE`` pixels and gets the pixels up to ``rim`` beyond its edges too, so a chain of neighbourhood steps whose reaches add up to the rim
needs no further exchange. Tiles begin a rim before the image, whose first rows are thus in no second tile. Rows arrive sorted by tile and are cut where the tile changes: a task holds the
tiles of a batch at a time, whatever the size of an image, and images smaller than a tile are one tile. Places without a row do not take part (``here``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.core import ship

TILE = 512


class Tiles:
    """Tiles of like size as one stack, so that small images are done many at once. Arrays have ``shape``: tiles, rows, columns.

    ``of, r, c``: the places of the rows in the arrays; ``r0, c0``: the image places of the tiles' corners; ``own``: rows inside their tile; ``tr, tc``: numbers of the tiles. A tile smaller than the stack is at its
    corner, and the rest of its array is not ``here``.
    """

    def __init__(self, rows: pa.Table, starts: np.ndarray, size: int, rims: tuple[int, int]):
        self.rows, self.starts, self.size, self.rims = rows, starts, size, rims
        self.row, self.col, tr, tc = (rows.column(n).to_numpy().astype(np.int64) for n in ("row", "col", "_tr", "_tc"))
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(self.row))))
        self.tr, self.tc = tr[starts], tc[starts]
        self.r0, self.c0 = np.minimum.reduceat(self.row, starts), np.minimum.reduceat(self.col, starts)
        self.r, self.c = self.row - self.r0[self.of], self.col - self.c0[self.of]
        self.shape = len(starts), int(self.r.max()) + 1, int(self.c.max()) + 1
        self.own = ((self.row + rims[0]) // size == tr) & ((self.col + rims[1]) // size == tc)
        self.here = np.zeros(self.shape, bool)
        self.here[self.of, self.r, self.c] = True

    def dense(self, name: str, fill, dtype=float) -> np.ndarray:
        """A column as an array; ``fill`` at places without a row or value."""
        out = np.full(self.shape, fill, dtype)
        v = self.rows.column(name)
        v = v.cast(pa.uint8()) if pa.types.is_boolean(v.type) else v
        good = np.asarray(v.is_valid())
        out[self.of[good], self.r[good], self.c[good]] = v.drop_null().to_numpy()
        return out

    def inside(self, more: int = 0) -> np.ndarray:
        """Places that are their tile's own, of arrays with ``more`` rows above and columns to the left."""
        mine = lambda at, n, rim, tile: (at[:, None] + np.arange(n + more) - more + rim) // self.size == tile[:, None]
        return mine(self.r0, self.shape[1], self.rims[0], self.tr)[:, :, None] & mine(self.c0, self.shape[2], self.rims[1], self.tc)[:, None, :]

    def pixels(self, columns: list[str], **more: np.ndarray) -> pa.Table:
        """The tiles' own rows: ``columns`` as they came, and for each of ``more`` the array's value at the row's place (NaN or masked: null)."""
        own = np.flatnonzero(self.own)
        t = self.rows.select(columns).take(pa.array(own))
        at = self.of[own], self.r[own], self.c[own]
        for name, a in more.items():
            v = a[at]
            t = t.append_column(name, pa.array(np.ma.getdata(v), mask=np.ma.getmaskarray(v) | (np.isnan(np.ma.getdata(v)) if v.dtype.kind == "f" else False)))
        return t

    def with_keys(self, keys: list[str], which: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
        """Rows of tiles as a whole, with the keys of ``which`` tile each is of."""
        return pa.table(taken(self.rows, keys, self.starts[which]) | {k: pa.array(v) for k, v in columns.items()})


#: Places of a stack of tiles, unless one tile has more.
PLACES = 1 << 19


def stacks(rows: pa.Table, starts: np.ndarray, size: int, rims: tuple[int, int]) -> Iterator[Tiles]:
    """Whole tiles (their rows and the places where they begin) as stacks: those whose sides have the same power of two above them, PLACES at a time."""
    ends = np.append(starts[1:], len(rows))
    sides = []
    for name in ("row", "col"):
        v = rows.column(name).to_numpy().astype(np.int64)
        sides.append(np.ceil(np.log2(np.maximum.reduceat(v, starts) - np.minimum.reduceat(v, starts) + 1)).astype(np.int64))
    kinds, kind = np.unique(sides[0] * 64 + sides[1], return_inverse=True)
    for k, code in enumerate(kinds):
        of = np.flatnonzero(kind == k)
        step = max(PLACES >> int(code // 64 + code % 64), 1)
        for i in range(0, len(of), step):
            part = of[i : i + step]
            if len(part) == len(starts):
                yield Tiles(rows, starts, size, rims)
                continue
            n = ends[part] - starts[part]
            first = np.cumsum(n) - n
            yield Tiles(rows.take(pa.array(np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts[part], n))), first, size, rims)


def _changes(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places where a row's tile is not that of the row before."""
    out = np.zeros(b.num_rows - 1, bool)
    for k in keys:
        v = b.column(k)
        x, y = v.slice(1), v.slice(0, len(v) - 1)
        if pa.types.is_nested(v.type):
            out |= np.array([p != q for p, q in zip(x.to_pylist(), y.to_pylist())], bool)
        else:
            out |= np.asarray(pc.fill_null(pc.not_equal(x, y), False)) | (np.asarray(x.is_null()) != np.asarray(y.is_null()))
    return np.flatnonzero(out) + 1


def cut(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, group by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cuts = [0, *_changes(b, keys).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            piece = b.slice(x, y - x)
            if held and any(held[-1].column(k)[-1].as_py() != piece.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def over_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | Iterator[pa.Table] | None], schema: StructType | str, sort: tuple[str, ...] = (), tasks: int | None = None, many: bool = False) -> DataFrame:
    """``work`` on the rows of each group (sorted by ``sort``), one group at a time: for groups that are known to fit a task. What it gives may come in pieces.

    ``tasks``: as many, whatever the bytes; adaptive execution decides without. ``many``: ``work`` is that of ``over_many``.
    """
    if many:
        return over_many(df, keys, work, schema, sort)
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(batches):
        for rows in cut(batches, keys):
            out = work(rows)
            for t in [out] if out is None or isinstance(out, pa.Table) else out:
                if t is not None and t.num_rows:
                    yield from t.select(names).to_batches(max_chunksize=100_000)

    d = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return d.sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def cut_many(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as whole groups, about a batch of them at a time, and the places where their groups begin."""
    held: list[pa.RecordBatch] = []
    starts, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        at = _changes(b, keys).tolist()
        if not held or any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            at = [0, *at]
        if at:
            whole = [*held, b.slice(0, at[-1])]
            starts += [n + i for i in at[:-1]]
            if starts:
                yield pa.Table.from_batches(whole), np.array(starts)
            held, starts, n = [b.slice(at[-1])], [0], b.num_rows - at[-1]
        else:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held), np.array(starts)


def over_many(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], schema: StructType, sort: tuple[str, ...] = ()) -> DataFrame:
    """One row a group: its keys, and the columns that ``work`` gives for a table of whole groups and the places where they begin. For groups that fit a task and are often small."""

    def run(batches):
        for rows, starts in cut_many(batches, keys):
            t = pa.table({k: rows.column(k).combine_chunks().take(pa.array(starts)) for k in keys} | {k: pa.array(v) for k, v in work(rows, starts).items()})
            yield from t.select(schema.names).to_batches(max_chunksize=100_000)

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def taken(rows: pa.Table, keys: list[str], at: np.ndarray) -> dict[str, pa.Array]:
    """The keys of the rows ``at`` these places."""
    return {k: rows.column(k).combine_chunks().take(pa.array(at)) for k in keys}


def alike(*numbers: np.ndarray) -> Iterator[np.ndarray]:
    """Places of groups that have the same numbers of rows."""
    _, kind = np.unique(np.stack(numbers), axis=1, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(kind[order])) + 1)


def over_alike(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[tuple[np.ndarray, dict[str, pa.Array]]]], schema: StructType, sort: tuple[str, ...] = ()) -> DataFrame:
    """Rows of groups that fit a task and are often small, many groups at a time: ``work`` on a table of whole groups and the places where they begin gives the group of each row, and columns."""

    def run(batches):
        for rows, starts in cut_many(batches, keys):
            for of, columns in work(rows, starts):
                if len(of):
                    yield from pa.table(taken(rows, keys, starts[of]) | columns).select(schema.names).to_batches(max_chunksize=100_000)

    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def repeated(rows: pa.Table, keys: list[str], n: int) -> dict[str, pa.ChunkedArray]:
    """The keys of a group, ``n`` times."""
    return {k: pa.chunked_array([rows.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))]) for k in keys}


def over_tiles(df: DataFrame, keys: list[str], rim: int | tuple[int, int], work: Callable[[Tiles], pa.Table | None], schema: StructType | str, size: int | None = None) -> DataFrame:
    """``work`` on stacks of the tiles of ``df`` (``keys, row, col``, values) with their rims (rows, columns), giving rows of ``schema``."""
    size = size or TILE
    rims = (rim, rim) if isinstance(rim, int) else rim
    d = df
    for name, at, reach in (("_tr", "row", rims[0]), ("_tc", "col", rims[1])):
        near = lambda by: F.floor((F.col(at) + by) / size).cast("int")  # noqa: B023,E731
        d = d.withColumn(name, F.explode(F.sequence(near(0), near(2 * reach))) if reach else near(0))
    return _over_stacks(d, [*keys, "_tr", "_tc"], size, rims, work, schema)


def over_images(df: DataFrame, keys: list[str], work: Callable[[Tiles], pa.Table | None], schema: StructType | str, tasks: int | None = None) -> DataFrame:
    """``work`` on stacks of whole images, for images that are known to fit a task."""
    far = 1 << 40
    return _over_stacks(df.withColumn("_tr", F.lit(0)).withColumn("_tc", F.lit(0)), keys, 2 * far, (far, far), work, schema, tasks)


def _over_stacks(d: DataFrame, by: list[str], size: int, rims: tuple[int, int], work: Callable[[Tiles], pa.Table | None], schema: StructType | str, tasks: int | None = None) -> DataFrame:
    d = (d.repartition(tasks, *by) if tasks else d.repartition(*by)).sortWithinPartitions(*by)
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(batches):
        for rows, starts in cut_many(batches, by):
            for t in stacks(rows, starts, size, rims):
                out = work(t)
                if out is not None and out.num_rows:
                    yield from out.select(names).to_batches(max_chunksize=100_000)

    return d.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: list[str], **more: str) -> StructType:
    """The fields of ``columns`` in ``df`` and new ones by DDL type."""
    out = StructType([df.schema[c] for c in columns])
    for name, kind in more.items():
        out = out.add(name, kind, True)
    return out


def slide(a: np.ndarray, half: int, op: np.ufunc, fill) -> np.ndarray:
    """``op`` (an extreme) over 2 * half + 1 columns about each place, by windows of doubled length."""
    if not half:
        return a
    n, width = 2 * half + 1, a.shape[-1]
    cur, k = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(half, half)], constant_values=fill), 1
    while 2 * k <= n:
        cur, k = op(cur[..., :-k], cur[..., k:]), 2 * k
    return op(cur[..., :width], cur[..., n - k : n - k + width])


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[..., r, c] = a[..., r + dy, c + dx]``."""
    out = np.full_like(a, fill)
    h, w = a.shape[-2:]
    if abs(dy) < h and abs(dx) < w:
        out[..., max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = a[..., max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    return out


def unite(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each number's component, from edges between 0 ... n - 1: each takes the smallest among its neighbours' roots until nothing changes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def join_runs(start: np.ndarray, end: np.ndarray, wide: int, reach: int) -> np.ndarray:
    """For each run the index of the first run of its object: runs of adjacent rows that meet are one. Runs are places in a flat array with rows of ``wide``, in order, two empty columns between rows."""
    lo, hi = np.searchsorted(end, start + wide - reach), np.searchsorted(start, end + wide + reach, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return unite(a, b, len(start))


def label_stack(mask: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Objects of a stack by its row runs: ``tile, row, first column, last column, index of the object's first run`` for each run. ``reach`` 1: 8-connected, 0: 4-connected."""
    high, wide = mask.shape[1] + 1, mask.shape[2] + 2  # an empty row parts tiles
    f = np.pad(mask, ((0, 0), (0, 1), (1, 1))).ravel()
    turn = np.flatnonzero(f[1:] != f[:-1])
    start, end = turn[0::2] + 1, turn[1::2]
    row = start // wide
    return row // high, row % high, start % wide - 1, end % wide - 1, join_runs(start, end, wide, reach)


ship(__name__)
