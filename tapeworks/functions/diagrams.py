"""Persistent homology of small point clouds and fields, in NumPy, for use inside Arrow functions.

Diagrams are arrays of (birth, persistence). Point clouds use the Rips filtration, fields sublevel sets of pixels.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: How many points a cloud that is dealt out has at most (topology.clouds). Homology itself takes any number.
MAX_POINTS = 96


def distances(x: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - x[None, :, :]
    return np.sqrt((d * d).sum(2))


def zscore(x: np.ndarray) -> np.ndarray:
    """Columns by their mean and population standard deviation (0 counts as 1)."""
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 0, s, 1.0)


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """Sorted edge lengths of the minimum spanning tree."""
    n = len(d)
    if n < 2:
        return np.zeros(0)
    best, out, left = d[0].copy(), [], np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        j = int(np.where(left, best, np.inf).argmin())
        out.append(best[j])
        left[j] = False
        best = np.minimum(best, d[j])
    return np.sort(np.asarray(out))


def epsilon_by_quantile(x: np.ndarray, q: float = 0.99) -> float:
    """Length of the tree's edge by which the share q of its edges is in."""
    edges = spanning_tree(distances(x))
    return float(edges[max(1, min(len(edges), int(np.ceil(q * len(edges))))) - 1]) if len(edges) else 1.0


def epsilon_for_share(x: np.ndarray, share: float = 0.99) -> float:
    """Least distance at which one component holds the share of the points, exactly: components grow along tree edges."""
    n = len(x)
    if n <= 1:
        return 0.0
    d = distances(x)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    root, size = list(range(n)), [1] * n
    for k in order:
        a, b = _find(root, int(i[k])), _find(root, int(j[k]))
        if a != b:
            root[b] = a
            size[a] += size[b]
            if size[a] >= share * n:
                return float(d[i[k], j[k]])
    return float(d.max())


def _find(root: list[int], a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def rips(x: np.ndarray, *, epsilon: float = np.inf, dim: int = 1, scale: bool = False) -> list[np.ndarray]:
    """Diagrams of dimensions 0 to dim up to epsilon (components, loops, voids at most); under three points they are empty."""
    if dim > 2:
        raise ValueError("homology is computed up to dimension 2")
    if len(x) < 3:
        return [np.zeros((0, 2)) for _ in range(dim + 1)]
    x = zscore(x) if scale else x
    d = distances(x)
    edges = spanning_tree(d)
    out = [np.stack([np.zeros(len(edges)), edges], 1)[edges <= epsilon]]
    return out + _cycles(d, epsilon, dim) if dim >= 1 else out


def _cycles(d: np.ndarray, epsilon: float, dim: int) -> list[np.ndarray]:
    """Loops, and voids if dim is 2, by reduction of coboundaries over two elements, latest simplex first.

    A simplex is its longest edge's place in the order of lengths and the code of its vertices. Coboundaries are worked out
    when they are needed, so memory follows the columns that are added to each other, not the number of triangles.
    """
    n = len(d)
    i, j = np.triu_indices(n, 1)
    # Beyond the enclosing radius all is one cone: what begins there ends at once.
    reach = min(epsilon, d.max(1).min())
    order = np.argsort(d[i, j], kind="stable")
    order = order[d[i, j][order] <= reach]
    i, j = i[order], j[order]
    length, m = d[i, j], len(order)
    place = np.full((n, n), m, np.int64)
    place[i, j] = place[j, i] = np.arange(m)
    everyone = np.arange(n)

    def above(simplex: tuple[int, ...]) -> np.ndarray:
        """Codes of the simplices of one vertex more, within reach."""
        at = max(int(place[a, b]) for k, a in enumerate(simplex) for b in simplex[k + 1 :])
        top = np.maximum(place[list(simplex)].max(0), at)
        c = everyone[top < m]
        vertices = np.sort(np.column_stack([np.tile(simplex, (len(c), 1)), c]), 1)
        code = top[c]
        for v in vertices.T:
            code = code * n + v
        return code

    def reduced(columns: Iterable[tuple[int, tuple[int, ...]]], size: int) -> tuple[np.ndarray, set[int]]:
        """(birth, persistence) of pairs of columns with codes of `size` vertices, and all codes that end something."""
        owner: dict[int, tuple[int, ...]] = {}
        stored: dict[int, set[int]] = {}
        out = []
        for birth, simplex in columns:
            codes = above(simplex)
            if not len(codes):
                continue
            top, mine = int(codes.min()), None
            while top in owner:
                mine = set(codes.tolist()) if mine is None else mine
                mine ^= stored[top] if top in stored else set(above(owner[top]).tolist())
                if not mine:
                    break
                top = min(mine)
            else:
                owner[top] = simplex
                if mine is not None:
                    stored[top] = mine
                death = top // n**size
                if length[death] > length[birth]:
                    out.append((length[birth], length[death] - length[birth]))
        return np.asarray(out, float).reshape(-1, 2), set(owner)

    # Edges that join components make no loop.
    root, makes = list(range(n)), np.zeros(m, bool)
    for k in range(m):
        a, b = _find(root, int(i[k])), _find(root, int(j[k]))
        makes[k] = a == b
        root[b] = a
    loops, ends = reduced(((k, (int(i[k]), int(j[k]))) for k in range(m - 1, -1, -1) if makes[k]), 3)
    if dim == 1:
        return [loops]
    # Triangles that end a loop make no void.
    triangles = ((k, (int(i[k]), int(j[k]), int(c))) for k in range(m - 1, -1, -1) for c in _last_first(place, int(i[k]), int(j[k]), k))
    return [loops, reduced(((k, t) for k, t in triangles if _code(k, t, n) not in ends), 4)[0]]


def _last_first(place: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Third vertices of the triangles whose longest edge is a-b, latest code first."""
    c = np.flatnonzero((place[a] < k) & (place[b] < k))
    return np.asarray(sorted(c[(c != a) & (c != b)].tolist(), key=lambda v: sorted((a, b, v)), reverse=True), int)


def _code(k: int, simplex: tuple[int, ...], n: int) -> int:
    for v in sorted(simplex):
        k = k * n + v
    return k


def _merge_tree(values: np.ndarray, neighbours, outside: bool) -> list[tuple[float, float]]:
    """(value at birth, value at merge) of components as pixels come in rising order; `outside` joins the border from the start."""
    rows, cols = values.shape
    flat = values.ravel()
    order = np.argsort(flat, kind="stable")
    root, born = list(range(flat.size + 1)), np.append(flat, -np.inf)
    there, out = np.zeros(flat.size, bool), []

    def join(a: int, b: int, v: float) -> None:
        a, b = _find(root, a), _find(root, b)
        if a != b:
            if born[a] > born[b]:
                a, b = b, a
            root[b] = a
            if v > born[b]:
                out.append((float(born[b]), float(v)))

    for p in order:
        r, c = divmod(int(p), cols)
        there[p] = True
        if outside and (r in (0, rows - 1) or c in (0, cols - 1)):
            join(int(p), flat.size, flat[p])
        for dr, dc in neighbours:
            y, x = r + dr, c + dc
            if 0 <= y < rows and 0 <= x < cols and there[y * cols + x]:
                join(int(p), y * cols + x, flat[p])
    return out


FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def cubical(field: np.ndarray, dim: int = 1) -> list[np.ndarray]:
    """Diagrams of a field's sublevel sets: components of pixels that touch, and holes as components of what lies above."""
    pairs = _merge_tree(field, EIGHT, False)
    out = [np.asarray([(b, d - b) for b, d in pairs], float).reshape(-1, 2)]
    if dim >= 1:
        holes = _merge_tree(-field, FOUR, True)
        out.append(np.asarray([(-m, m - b) for b, m in holes], float).reshape(-1, 2))
    # A field of two axes has no holes of more dimensions.
    return out + [np.zeros((0, 2))] * (dim - 1)


def _merge_trees(fields: np.ndarray, neighbours, outside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_merge_tree of many fields of one shape, a step of all at once: field, value at birth and value at merge of each component.

    Components of a field stand in the order in which they merge.
    """
    m, rows, cols = fields.shape
    size = rows * cols
    flat = fields.reshape(m, size)
    order = np.argsort(flat, axis=1, kind="stable")
    root, born = np.tile(np.arange(size + 1), (m, 1)), np.column_stack([flat, np.full(m, -np.inf)])
    r, c = np.divmod(np.arange(size), cols)
    border = (r == 0) | (r == rows - 1) | (c == 0) | (c == cols - 1)
    steps = [np.where((r + dr >= 0) & (r + dr < rows) & (c + dc >= 0) & (c + dc < cols), (r + dr) * cols + c + dc, size + 1) for dr, dc in neighbours]
    # The outside is there from the start if it is asked for, what lies beyond the field never.
    there = np.zeros((m, size + 2), bool)
    there[:, size] = outside
    steps = [np.where(border, size, size + 1), *steps] if outside else steps
    every, out = np.arange(m), []
    for p in order.T:
        there[every, p] = True
        for step in steps:
            other = step[p]
            at = np.flatnonzero(there[every, other])
            a, b = root[at, p[at]], root[at, other[at]]
            at, a, b = (x[a != b] for x in (at, a, b))
            if not len(at):
                continue
            older = born[at, a] > born[at, b]
            a, b = np.where(older, b, a), np.where(older, a, b)
            some = root[at]
            root[at] = np.where(some == b[:, None], a[:, None], some)
            birth, value = born[at, b], flat[at, p[at]]
            out.append(np.stack([at, birth, value])[:, value > birth])
    field, birth, value = np.concatenate(out, 1) if out else np.zeros((3, 0))
    first = np.argsort(field, kind="stable")
    return field[first].astype(np.int64), birth[first], value[first]


def cubical_many(fields: np.ndarray, dim: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Diagrams of many fields of one shape: for each dimension births (infinite where a field has no more) and persistences (0 there)."""
    found = [_merge_trees(fields, EIGHT, False)]
    if dim >= 1:
        field, birth, value = _merge_trees(-fields, FOUR, True)
        found.append((field, -value, -birth))
    out = []
    for field, birth, death in found:
        count = np.bincount(field, minlength=len(fields))
        at = np.arange(len(field)) - np.repeat(np.cumsum(count) - count, count)
        b, p = np.full((len(fields), count.max(initial=0)), np.inf), np.zeros((len(fields), count.max(initial=0)))
        b[field, at], p[field, at] = birth, death - birth
        out.append((b, p))
    return out + [(np.zeros((len(fields), 0)),) * 2] * (dim - 1)


def _axes(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    return np.linspace(low, np.where(high > low, high, low + 1.0), size, axis=1)


def landscapes(births: np.ndarray, spans: np.ndarray, levels: int, grid: int = 64, summary: str = "mean") -> np.ndarray:
    """landscape() of many diagrams, a row each."""
    out = np.zeros((len(births), levels))
    some = (spans > 0).any(1)
    b, p = births[some], spans[some]
    if not len(b):
        return out
    d = np.where(p > 0, b + p, -np.inf)
    x = _axes(b.min(1), d.max(1), max(grid, 2))[:, :, None]
    tents = np.clip(np.minimum(x - b[:, None], d[:, None] - x), 0, None)
    tents = np.sort(np.concatenate([tents, np.zeros((*tents.shape[:2], levels))], 2), axis=2)[:, :, ::-1][:, :, :levels]
    # In one layout whatever else is in the batch, so that like diagrams have the same sums.
    tents = np.ascontiguousarray(tents.transpose(0, 2, 1))
    out[some] = tents.max(2) if summary == "max" else tents.mean(2)
    return out


def images(births: np.ndarray, spans: np.ndarray, size: int, sigma: float, birth_range: tuple[float, float] | None = None, span_range: tuple[float, float] | None = None) -> np.ndarray:
    """image() of many diagrams, a row each."""
    out = np.zeros((len(births), size * size))
    some = np.isfinite(births).any(1)
    b, p = births[some], spans[some]
    if not len(b):
        return out
    there = np.isfinite(b)
    ends = lambda v, r: (np.full(len(v), float(r[0])), np.full(len(v), float(r[1]))) if r else (v.min(1, where=there, initial=np.inf), v.max(1, where=there, initial=-np.inf))
    xs, ys = _axes(*ends(b, birth_range), size), _axes(*ends(p, span_range), size)
    total = np.zeros((len(b), size, size))
    for k in range(b.shape[1]):
        gx, gy = np.exp(-((xs - b[:, k : k + 1]) ** 2) / (2 * sigma**2)), np.exp(-((ys - p[:, k : k + 1]) ** 2) / (2 * sigma**2))
        total += (gy * np.clip(p[:, k : k + 1], 0, None))[:, :, None] * gx[:, None, :]
    out[some] = total.reshape(len(b), -1)
    return out


def landscape(diagram: np.ndarray, levels: int, grid: int = 64, summary: str = "mean") -> np.ndarray:
    """Mean (or largest) height of each of the first landscape functions over an even grid of the diagram's range."""
    out = np.zeros(levels)
    ok = diagram[np.isfinite(diagram).all(1) & (diagram[:, 1] > 0)] if len(diagram) else diagram
    if not len(ok):
        return out
    b, d = ok[:, 0], ok.sum(1)
    x = np.linspace(b.min(), d.max() if d.max() > b.min() else b.min() + 1, max(grid, 2))
    tents = np.sort(np.clip(np.minimum(x[:, None] - b, d - x[:, None]), 0, None), axis=1)[:, ::-1][:, :levels]
    out[: tents.shape[1]] = tents.max(0) if summary == "max" else tents.mean(0)
    return out


def image(diagram: np.ndarray, size: int, sigma: float, births: tuple[float, float] | None = None, spans: tuple[float, float] | None = None) -> np.ndarray:
    """size x size sums of Gaussians around the points, weighted by persistence; rows are persistence."""
    ok = diagram[np.isfinite(diagram).all(1)] if len(diagram) else diagram
    if not len(ok):
        return np.zeros(size * size)
    axis = lambda v, r: np.linspace(*((lo, hi) if (hi := (r or (v.min(), v.max()))[1]) > (lo := (r or (v.min(), v.max()))[0]) else (lo, lo + 1.0)), size)
    gx, gy = np.exp(-((axis(ok[:, 0], births)[:, None] - ok[:, 0]) ** 2) / (2 * sigma**2)), np.exp(-((axis(ok[:, 1], spans)[:, None] - ok[:, 1]) ** 2) / (2 * sigma**2))
    return ((gy * np.clip(ok[:, 1], 0, None)) @ gx.T).ravel()


def quantile_landscape(diagram: np.ndarray, levels: int) -> np.ndarray:
    """Quantiles of persistence at 1 / levels to 1: the plain fallback."""
    return np.quantile(diagram[:, 1], np.arange(1, levels + 1) / levels) if len(diagram) else np.zeros(levels)


def histogram_image(diagram: np.ndarray, size: int) -> np.ndarray:
    """Counts of points on an even grid of their range: the plain fallback."""
    return np.histogram2d(diagram[:, 1], diagram[:, 0], bins=size)[0].ravel() if len(diagram) else np.zeros(size * size)
