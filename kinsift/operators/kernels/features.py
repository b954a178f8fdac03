"""Local features of grey planes, visual words, and verification of pairs. NumPy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from kinsift.operators.kernels.planes import blur

# Bars of matching.
FEATURES, GUIDED_BAR, GRID, BLOCK, FLAT = 600, 320.0**2, 48, 8, 16.0


@dataclass
class Keypoints:
    x: np.ndarray
    y: np.ndarray
    sigma: np.ndarray
    angle: np.ndarray
    descriptor: np.ndarray

    def take(self, at: np.ndarray) -> Keypoints:
        return Keypoints(*(getattr(self, k)[at] for k in ("x", "y", "sigma", "angle", "descriptor")))


def _octave(plane: np.ndarray, scales: int, sigma: float) -> list[np.ndarray]:
    step = 2 ** (1 / scales)
    layers = [plane]
    for i in range(1, scales + 3):
        before, after = sigma * step ** (i - 1), sigma * step**i
        layers.append(blur(layers[-1], np.sqrt(after**2 - before**2)))
    return layers


def _extrema(stack: np.ndarray, bar: float) -> np.ndarray:
    """(layer, y, x) of points above all or below all 26 neighbours, and strong."""
    mid = stack[1:-1, 1:-1, 1:-1]
    high, low = np.full(mid.shape, -np.inf), np.full(mid.shape, np.inf)
    n, h, w = stack.shape
    for dz in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dz, dy, dx) != (1, 1, 1):
                    other = stack[dz : n - 2 + dz, dy : h - 2 + dy, dx : w - 2 + dx]
                    high, low = np.maximum(high, other), np.minimum(low, other)
    return np.argwhere(((mid > high) | (mid < low)) & (np.abs(mid) > bar)) + 1


def _refined(stack: np.ndarray, at: np.ndarray, bar: float, edge: float = 10.0, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, their offsets within the sample, responses): extrema of the quadratic through the neighbours, moved to the sample
    they lie nearest to; those that don't settle, are weak there or lie on an edge are left out."""
    shape = np.array(stack.shape)
    settled, offsets = np.zeros(len(at), bool), np.zeros((len(at), 3))
    at = at.copy()
    gradient, hessian = np.zeros((len(at), 3)), np.zeros((len(at), 3, 3))
    axes = np.eye(3, dtype=int)
    for _ in range(rounds):
        todo = np.flatnonzero(~settled & ((at > 0) & (at < shape - 1)).all(axis=1))
        if not len(todo):
            break
        p = at[todo]
        value = lambda d: stack[tuple((p + d).T)]  # noqa: B023, E731
        here = value(0)
        for i in range(3):
            gradient[todo, i] = (value(axes[i]) - value(-axes[i])) / 2
            hessian[todo, i, i] = value(axes[i]) + value(-axes[i]) - 2 * here
            for j in range(i):
                hessian[todo, i, j] = hessian[todo, j, i] = (value(axes[i] + axes[j]) - value(axes[i] - axes[j]) - value(axes[j] - axes[i]) + value(-axes[i] - axes[j])) / 4
        sound = np.abs(np.linalg.det(hessian[todo])) > 1e-12
        step = np.full((len(todo), 3), 9.0)
        step[sound] = -np.linalg.solve(hessian[todo][sound], gradient[todo][sound][..., None])[..., 0]
        offsets[todo] = step
        near = (np.abs(step) < 0.5).all(axis=1)
        settled[todo[near]] = True
        moving = ~near & (np.abs(step) < shape.max()).all(axis=1)
        at[todo[moving]] += np.rint(step[moving]).astype(int)
    inside = settled & ((at > 0) & (at < shape - 1)).all(axis=1)
    at, offsets, gradient, hessian = at[inside], offsets[inside], gradient[inside], hessian[inside]
    response = stack[tuple(at.T)] + (gradient * offsets).sum(axis=1) / 2
    trace, det = hessian[:, 1, 1] + hessian[:, 2, 2], hessian[:, 1, 1] * hessian[:, 2, 2] - hessian[:, 1, 2] ** 2
    good = (np.abs(response) >= bar) & (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det)
    return at[good], offsets[good], np.abs(response[good])


def extract(plane: np.ndarray, most: int = FEATURES, scales: int = 3, sigma: float = 1.6, bar: float = 3.0) -> Keypoints:
    """Extrema of differences of Gaussians with their main angles and 4 x 4 x 8 gradient histograms as bytes; the strongest `most`."""
    found: list[tuple[np.ndarray, ...]] = []
    base, scale = blur(plane.astype(float), np.sqrt(max(0.01, sigma**2 - 0.25))), 1.0
    while min(base.shape) >= 16:
        layers = _octave(base, scales, sigma)
        stack = np.stack([b - a for a, b in zip(layers[:-1], layers[1:], strict=True)])
        at, offset, response = _refined(stack, _extrema(stack, bar / scales / 2), bar / scales)
        for z in np.unique(at[:, 0]):
            here = at[:, 0] == z
            p, o = at[here], offset[here]
            gy, gx = np.gradient(layers[z])
            size = sigma * 2 ** ((z + o[:, 0]) / scales)
            x, y = p[:, 2] + o[:, 2], p[:, 1] + o[:, 1]
            row, angle = _main_angles(gx, gy, p[:, 2], p[:, 1], float(np.median(size)))
            d = _descriptors(gx, gy, p[row, 2], p[row, 1], float(np.median(size)), angle)
            good = d.any(axis=1)
            row, angle = row[good], angle[good]
            found.append((x[row] * scale, y[row] * scale, size[row] * scale, np.degrees(angle) % 360, response[here][row], d[good]))
        base, scale = layers[scales][::2, ::2], scale * 2
    if not found:
        return Keypoints(*(np.zeros(0, np.float32) for _ in range(4)), np.zeros((0, 128), np.uint8))
    x, y, size, angle, response, d = (np.concatenate([f[i] for f in found]) for i in range(6))
    order = np.lexsort((angle, x, y, -response))[:most]
    return Keypoints(*(v[order].astype(np.float32) for v in (x, y, size, angle)), d[order])


def _around(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """(length, direction, dx, dy) of the gradients around points, a row a point; lengths are 0 outside the plane."""
    dy, dx = (g.ravel() for g in np.mgrid[-r : r + 1, -r : r + 1])
    py, px = y[:, None] + dy, x[:, None] + dx
    inside = (py > 0) & (py < gx.shape[0] - 1) & (px > 0) & (px < gx.shape[1] - 1)
    py, px = np.clip(py, 0, gx.shape[0] - 1), np.clip(px, 0, gx.shape[1] - 1)
    u, v = gx[py, px], gy[py, px]
    return np.hypot(u, v) * inside, np.arctan2(v, u), dx, dy


def _main_angles(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, s: float, bins: int = 36, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(point, angle) for each peak of a point's histogram of directions that has `share` of the highest."""
    length, turn, dx, dy = _around(gx, gy, x, y, int(round(4.5 * s)))
    weight = length * np.exp(-(dx * dx + dy * dy) / (2 * (1.5 * s) ** 2))
    at = np.rint(turn / (2 * np.pi) * bins).astype(int) % bins + bins * np.arange(len(x))[:, None]
    hist = np.bincount(at.ravel(), weight.ravel(), minlength=bins * len(x)).reshape(len(x), bins)
    hist = sum(w * np.roll(hist, k, axis=1) for k, w in ((-2, 1 / 16), (-1, 4 / 16), (0, 6 / 16), (1, 4 / 16), (2, 1 / 16)))
    before, after = np.roll(hist, 1, axis=1), np.roll(hist, -1, axis=1)
    row, top = np.nonzero((hist > before) & (hist > after) & (hist >= share * hist.max(axis=1, keepdims=True)))
    a, b, c = before[row, top], hist[row, top], after[row, top]
    return row, (top + 0.5 * (a - c) / (a - 2 * b + c)) / bins * 2 * np.pi


def _descriptors(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, s: float, angle: np.ndarray, batch: int = 64) -> np.ndarray:
    """Rows of 128 bytes; of zeros where there is no gradient."""
    cell, out = 3 * s, np.zeros((len(x), 128), np.uint8)
    for first in range(0, len(x), batch):
        own = slice(first, first + batch)
        length, turn, dx, dy = _around(gx, gy, x[own], y[own], int(round(cell * 2.5 * 1.4142)))
        c, n = np.cos(angle[own])[:, None], np.sin(angle[own])[:, None]
        px, py = (c * dx + n * dy) / cell + 1.5, (-n * dx + c * dy) / cell + 1.5
        weight = length * np.exp(-((px - 1.5) ** 2 + (py - 1.5) ** 2) / 8)
        row, k = np.nonzero((px > -1) & (px < 4) & (py > -1) & (py < 4) & (weight > 0))
        px, py, weight = px[row, k], py[row, k], weight[row, k]
        turned = ((turn[row, k] - angle[own][row]) / (2 * np.pi) * 8) % 8
        fx, fy, ft = np.floor(px).astype(int), np.floor(py).astype(int), np.floor(turned).astype(int)
        sums = np.zeros(len(c) * 288)
        for i in (0, 1):
            for j in (0, 1):
                for t in (0, 1):
                    w = weight * np.abs(1 - i - (px - fx)) * np.abs(1 - j - (py - fy)) * np.abs(1 - t - (turned - ft))
                    sums += np.bincount(((row * 6 + fy + j + 1) * 6 + fx + i + 1) * 8 + (ft + t) % 8, w, len(sums))
        d = sums.reshape(-1, 6, 6, 8)[:, 1:5, 1:5].reshape(-1, 128)
        norm = np.linalg.norm(d, axis=1, keepdims=True)
        d = np.minimum(d / np.maximum(norm, 1e-12), 0.2)
        d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        out[own] = np.minimum(255, np.rint(d * 512))
    return out


def mirrored(k: Keypoints, width: int) -> Keypoints:
    """The features of the mirror image: rows of cells turned round, angles and places mirrored."""
    d = k.descriptor.reshape(-1, 4, 4, 8)[:, ::-1, :, :][..., (-np.arange(8)) % 8]
    return Keypoints(width - 1 - k.x, k.y, k.sigma, (180 - k.angle) % 360, d.reshape(-1, 128))


def inverted(k: Keypoints) -> Keypoints:
    """The features of the negative: every gradient turns round, and the frame with it."""
    d = k.descriptor.reshape(-1, 4, 4, 8)[:, ::-1, ::-1, :]
    return Keypoints(k.x, k.y, k.sigma, (k.angle + 180) % 360, d.reshape(-1, 128))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


@dataclass
class Vocabulary:
    """A tree of centres: of each level the numbers of the nodes that there are, in order, and their centres; node n's children are n * branching and on."""

    branching: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    stands: dict[int, int] = field(default_factory=dict)

    def children(self, level: int, node: int) -> slice:
        nodes = self.levels[level][0]
        return slice(*np.searchsorted(nodes, (node * self.branching, (node + 1) * self.branching)))


def kmeans(data: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Centres by k-means++ seeding and Lloyd's rounds; no more members than k are their own centres."""
    r = np.random.default_rng(seed)
    if len(data) <= k:
        return np.concatenate([data, np.repeat(data[-1:], k - len(data), axis=0)]).astype(np.float32)
    centres = [data[r.integers(len(data))].astype(np.float32)]
    near = distances(data, centres[0][None])[:, 0]
    for _ in range(1, k):
        total = near.sum()
        centres.append(data[r.choice(len(data), p=near / total) if total > 0 else r.integers(len(data))].astype(np.float32))
        near = np.minimum(near, distances(data, centres[-1][None])[:, 0])
    c = np.stack(centres)
    for _ in range(rounds):
        own = distances(data, c).argmin(axis=1)
        new = np.stack([data[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)]).astype(np.float32)
        if np.allclose(new, c):
            break
        c = new
    return c


def tree_shape(n: int) -> tuple[int, int, int]:
    """(depth, branching, sample) for n descriptors: the least depth, and then the least branching, with words for a third of them or more."""
    target = max(2, n // 3)
    depth = next((d for d in range(1, 6) if 16**d >= target), 6)
    return depth, next((b for b in range(2, 16) if b**depth >= target), 16), int(np.clip(n // 10, 1, 1_280_000))


def grow(sample: np.ndarray, depth: int, branching: int, seed: int = 0) -> Vocabulary:
    """A vocabulary fitted on a bounded sample; only nodes that a member of the sample reaches are made."""
    levels, own = [], np.zeros(len(sample), np.int64)
    for level in range(depth):
        order = np.argsort(own, kind="stable")
        parents, first = np.unique(own[order], return_index=True)
        nodes, centres, after = [], [], own.copy()
        for parent, members in zip(parents, np.split(order, first[1:]), strict=True):
            data = sample[members]
            made = kmeans(data, branching, seed + int(parent) + level) if len(data) > branching else np.unique(data, axis=0).astype(np.float32)
            nodes.append(parent * branching + np.arange(len(made)))
            centres.append(made)
            after[members] = parent * branching + distances(data, made).argmin(axis=1)
        levels.append((np.concatenate(nodes), np.concatenate(centres)))
        own = after
    made = Vocabulary(branching, levels)
    made.stands = floored(made)
    return made


# Fixed value: descriptors of sibling leaves nearer than this say the same.
WORD_FLOOR = 143.0


def floored(v: Vocabulary, floor: float = WORD_FLOOR) -> dict[int, int]:
    """The leaves that stand for another one: of sibling leaves nearer than the floor, directly or through others, the lowest is the word of all."""
    nodes, centres = v.levels[-1]
    stands: dict[int, int] = {}
    for parent in np.unique(nodes // v.branching):
        own = v.children(len(v.levels) - 1, int(parent))
        near = distances(centres[own], centres[own]) < floor * floor
        for _ in range(len(near).bit_length() + 1):
            near = near.astype(int) @ near > 0
        first = near.argmax(axis=1)
        stands |= {int(n): int(nodes[own][f]) for n, f in zip(nodes[own], first, strict=True) if nodes[own][f] != n}
    return stands


def quantise(v: Vocabulary, descriptors: np.ndarray, paths: int = 3, ratio: float = 1.3) -> list[list[int]]:
    """Words of each descriptor, nearest first: down the tree along the best paths within the ratio."""
    words = []
    for d in descriptors:
        beam = [0]
        for level, (nodes, centres) in enumerate(v.levels):
            below = np.concatenate([np.arange(s.start, s.stop) for s in (v.children(level, p) for p in beam)])
            far = distances(d[None], centres[below])[0]
            order = np.argsort(far, kind="stable")[:paths]
            beam = [int(nodes[below[i]]) for i in order if far[i] <= ratio * far[order[0]]]
        words.append(list(dict.fromkeys(v.stands.get(w, w) for w in beam)))
    return words


def shared_words(a: list[list[int]], b: list[list[int]], most: int = 60_000) -> np.ndarray:
    """(keypoint of a, keypoint of b) that have a word in common; of more than `most` pairs those of the rarest words."""
    at: dict[int, list[int]] = {}
    for j, own in enumerate(b):
        for w in own:
            at.setdefault(w, []).append(j)
    held: dict[int, list[int]] = {}
    for i, own in enumerate(a):
        for w in own:
            if w in at:
                held.setdefault(w, []).append(i)
    pairs, n = [], 0
    for w in sorted(held, key=lambda w: (len(held[w]) * len(at[w]), w)):
        if n >= most:
            break
        pairs.append(np.stack(np.meshgrid(held[w], at[w], indexing="ij"), -1).reshape(-1, 2)[: most - n])
        n += len(pairs[-1])
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def distinct_points(a: Keypoints, pairs: np.ndarray) -> int:
    """Places of a that matches have, to half a pixel: a place with several angles counts once."""
    i = pairs[:, 0]
    return len(np.unique(np.column_stack([(a.x[i] * 2).astype(int), (a.y[i] * 2).astype(int)]), axis=0))


def size_offset(a: Keypoints, b: Keypoints, m: np.ndarray, pairs: np.ndarray) -> float:
    """The upper median, in octaves, of how much larger b's keypoints are than a's carried by the map."""
    if not len(pairs):
        return 0.0
    scale = max(np.sqrt(abs(np.linalg.det(m[:, :2]))), 1e-12)
    off = np.sort(np.log2(b.sigma[pairs[:, 1]] / (np.maximum(a.sigma[pairs[:, 0]], 1e-6) * scale)))
    return float(off[len(off) // 2])


def encloses_centre(a: Keypoints, b: Keypoints, m: np.ndarray, pairs: np.ndarray, frame_a: tuple[int, int], frame_b: tuple[int, int]) -> bool:
    """Whether the matches' box holds the mean keypoint of the part of a frame that the map puts into the other, in either frame; frames are (height, width)."""

    def held(k: Keypoints, own: np.ndarray, to: np.ndarray | None, frame: tuple[int, int]) -> bool:
        if to is None or not len(own):
            return False
        p = np.column_stack([k.x, k.y]).astype(float)
        at = p @ to[:, :2].T + to[:, 2]
        inside = (at >= 0).all(axis=1) & (at < (frame[1], frame[0])).all(axis=1)
        if not inside.any():
            return False
        centre, box = p[inside].mean(axis=0), p[own]
        return bool((box.min(axis=0) <= centre).all() and (centre <= box.max(axis=0)).all())

    linear = m[:, :2]
    back = None
    if abs(np.linalg.det(linear)) >= 1e-12:
        turned = np.linalg.inv(linear)
        back = np.column_stack([turned, -turned @ m[:, 2]])
    return held(a, pairs[:, 0], m, frame_b) or held(b, pairs[:, 1], back, frame_a)


def correspond(a: Keypoints, b: Keypoints, pairs: np.ndarray) -> np.ndarray:
    """Of pairs of keypoints that share a word, the nearest of b for each of a; there is no ratio test."""
    d = ((a.descriptor[pairs[:, 0]].astype(int) - b.descriptor[pairs[:, 1]].astype(int)) ** 2).sum(axis=1)
    order = np.lexsort((pairs[:, 1], d, pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])] if len(pairs) else pairs


def fit_affine(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The least-squares map of points a on points b as (2, 3), none if they don't determine one."""
    if len(a) < 3:
        return None
    m = np.column_stack([a, np.ones(len(a))])
    normal = m.T @ m
    return np.linalg.solve(normal, m.T @ b).T if abs(np.linalg.det(normal)) > 1e-6 else None


def best_transform(a: Keypoints, b: Keypoints, pairs: np.ndarray, frame: tuple[int, int], most: int = 600) -> tuple[np.ndarray, np.ndarray] | None:
    """(map, inliers) with most inliers: each match is a hypothesis, the best is refitted to its inliers, three times at most."""
    tolerance = max(3.0, 0.015 * np.hypot(*frame))
    pa, pb = (np.column_stack([k.x[pairs[:, i]], k.y[pairs[:, i]]]).astype(float) for i, k in enumerate((a, b)))
    s = (b.sigma[pairs[:, 1]] / a.sigma[pairs[:, 0]])[:most]
    t = np.radians(b.angle[pairs[:, 1]] - a.angle[pairs[:, 0]])[:most]
    c, n = s * np.cos(t), s * np.sin(t)
    best, mask = None, np.zeros(len(pairs), bool)
    for i in range(len(s)):
        linear = np.array([[c[i], -n[i]], [n[i], c[i]]])
        m = np.column_stack([linear, pb[i] - linear @ pa[i]])
        near = np.hypot(*(pa @ m[:, :2].T + m[:, 2] - pb).T) <= tolerance
        if near.sum() > mask.sum():
            best, mask = m, near
    for _ in range(3):
        m = fit_affine(pa[mask], pb[mask]) if best is not None else None
        if m is None:
            break
        near = np.hypot(*(pa @ m[:, :2].T + m[:, 2] - pb).T) <= tolerance
        if near.sum() < mask.sum():
            break
        best, mask = m, near
    return (best, mask) if best is not None else None


def guided(a: Keypoints, b: Keypoints, m: np.ndarray, frame: tuple[int, int]) -> np.ndarray:
    """Matches of a's keypoints, carried by the map, with the nearest descriptor of b within the tolerance circle and the bar."""
    tolerance = max(3.0, 0.015 * np.hypot(*frame))
    carried = np.column_stack([a.x, a.y]) @ m[:, :2].T + m[:, 2]
    far = np.hypot(carried[:, None, 0] - b.x[None], carried[:, None, 1] - b.y[None]) > tolerance
    d = np.where(far, np.inf, distances(a.descriptor, b.descriptor))
    j = d.argmin(axis=1)
    use = d[np.arange(len(j)), j] < GUIDED_BAR
    return np.column_stack([np.flatnonzero(use), j[use]])


def _sampled(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x0, y0 = np.clip(np.floor(x).astype(int), 0, plane.shape[1] - 2), np.clip(np.floor(y).astype(int), 0, plane.shape[0] - 2)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    p = plane.astype(float)
    return (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy


def pixel_check(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[float, int, float, float]:
    """(mean |r| of blocks, blocks that count, least |r|, |r| of all) over a grid of a's part that the map puts into b."""
    h, w = a.shape
    gx, gy = np.meshgrid((np.arange(GRID) + 0.5) / GRID * (w - 1), (np.arange(GRID) + 0.5) / GRID * (h - 1))
    u, v = m[0, 0] * gx + m[0, 1] * gy + m[0, 2], m[1, 0] * gx + m[1, 1] * gy + m[1, 2]
    inside = (u >= 0) & (u <= b.shape[1] - 1) & (v >= 0) & (v <= b.shape[0] - 1)
    if not inside.any():
        return 0.0, 0, 0.0, 0.0
    sa, sb = _sampled(a, gx, gy), _sampled(b, u, v)
    found = []
    for y in range(0, GRID, BLOCK):
        for x in range(0, GRID, BLOCK):
            part = inside[y : y + BLOCK, x : x + BLOCK]
            if part.sum() < BLOCK * BLOCK // 2:
                continue
            p, q = sa[y : y + BLOCK, x : x + BLOCK][part], sb[y : y + BLOCK, x : x + BLOCK][part]
            vp, vq, cov = p.var(), q.var(), ((p - p.mean()) * (q - q.mean())).mean()
            if vp < FLAT and vq < FLAT:
                continue
            found.append(2 * abs(cov) / (vp + vq) if min(vp, vq) < FLAT else abs(cov) / np.sqrt(vp * vq))
    p, q = sa[inside], sb[inside]
    whole = abs(np.corrcoef(p, q)[0, 1]) if p.std() > 0 and q.std() > 0 else 0.0
    return (float(np.mean(found)), len(found), float(np.min(found)), float(whole)) if found else (0.0, 0, 0.0, float(whole))
