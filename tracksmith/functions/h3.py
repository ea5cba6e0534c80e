"""H3 geometry in NumPy: positions to cells, cells to centres and corners.

H3 lays hexagons on the gnomonic projections of the faces of an icosahedron and
refines them by aperture 7, turned by an angle at every odd resolution. What the
public library holds in tables (base cells, their neighbours and turns) is
derived here from the faces: the base cells are the hexagons about the face
centres, their six neighbours, and the vertices, numbered from north to south.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Latitude and longitude (radians) of the centres of faces 0 to 9 (face 19 - k, ... are their opposites) and azimuth of the i axis of faces 0 to 19.
_CENTRES = (
    (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159), (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943), (0.172745327415618701, 1.678146885280433686), (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035), (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203),
    (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622), (-0.427370518328979641, 1.252716453253507838), (-0.600191595538186799, 2.690988744120037492),
    (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139), (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
)
_AXES = (
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400, 2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535, 2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
)
# By home face of a pentagon, the faces from which its first digits are turned clockwise.
_CLOCKWISE = {11: (2, 6), 10: (1, 5), 12: (3, 7), 14: (0, 9), 13: (4, 8), 6: (11, 15), 7: (12, 16), 5: (10, 19), 8: (13, 17), 9: (14, 18)}
#: Distance from a face's centre to the centre of the next hexagon at resolution 0 on the projection; the turn of odd resolutions.
_UNIT, _TURN, _ROOT7, _S = 0.38196601125010500003, 0.333473172251832115336090755351601070065900389, np.sqrt(7.0), np.sqrt(3.0) / 2
# Digits: centre, k, j, jk, i, ik, ij; and each digit turned by 60 degrees counter-clockwise and clockwise.
_STEPS = np.array([(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0)])
_LEFT, _RIGHT = np.array([0, 5, 3, 1, 6, 4, 2, 7]), np.array([0, 3, 6, 2, 5, 1, 4, 7])
MODE = 1


def _xyz(lat, lng) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)


class _Faces:
    """The twenty projections, and the turning of the plane across each edge."""

    def __init__(self):
        lat, lng = np.array(_CENTRES).T
        self.z = _xyz(lat, lng)
        north = np.stack([-np.sin(lat) * np.cos(lng), -np.sin(lat) * np.sin(lng), np.cos(lat)], -1)
        east = np.stack([-np.sin(lng), np.cos(lng), np.zeros(20)], -1)
        az = np.array(_AXES)[:, None]
        # Angles in the plane run against azimuths.
        self.x = np.cos(az) * north + np.sin(az) * east
        self.y = np.sin(az) * north - np.cos(az) * east
        self.corner = 2 * np.array([(1.0, 0.0), (-0.5, _S), (-0.5, -_S)])  # towards i, j, k
        self.vertex = self.point(np.repeat(np.arange(20), 3), np.tile(self.corner, (20, 1))).reshape(20, 3, 3)
        # Across the edge opposite corner c of face f: the next face, and the rigid motion (angle as a complex factor, shift) into its plane.
        self.next = np.zeros((20, 3), int)
        self.turn, self.shift = np.zeros((20, 3), complex), np.zeros((20, 3), complex)
        plane = self.corner[:, 0] + 1j * self.corner[:, 1]
        for f in range(20):
            for c in range(3):
                a, b = [k for k in range(3) if k != c]
                for g in range(20):
                    at = [int(np.argmax(self.vertex[g] @ self.vertex[f, k])) for k in (a, b)]
                    if g != f and all(self.vertex[g, at[n]] @ self.vertex[f, k] > 0.999 for n, k in enumerate((a, b))):
                        t = (plane[at[1]] - plane[at[0]]) / (plane[b] - plane[a])
                        self.next[f, c], self.turn[f, c], self.shift[f, c] = g, t, plane[at[0]] - t * plane[a]

    def point(self, face: np.ndarray, xy: np.ndarray) -> np.ndarray:
        """Unit vectors of plane positions in units of resolution 0."""
        v = self.z[face] + _UNIT * (xy[..., :1] * self.x[face] + xy[..., 1:] * self.y[face])
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    def plane(self, face: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = np.einsum("...i,...i", v, self.z[face]) * _UNIT
        return np.stack([np.einsum("...i,...i", v, self.x[face]) / d, np.einsum("...i,...i", v, self.y[face]) / d], -1)

    def fold(self, face: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Complex plane positions carried over the edges they lie beyond, at most twice."""
        face, p = face.copy(), p.copy()
        out = -(self.corner[:, 0] + 1j * self.corner[:, 1]) / 2  # outward normals of the edges opposite the corners
        for _ in range(2):
            beyond = np.real(p[:, None] * np.conj(out)[None])
            c = beyond.argmax(1)
            go = beyond[np.arange(len(p)), c] > 1 + 1e-12
            if not go.any():
                break
            p[go] = p[go] * self.turn[face[go], c[go]] + self.shift[face[go], c[go]]
            face[go] = self.next[face[go], c[go]]
        return face, p


def _flat(ijk: np.ndarray) -> np.ndarray:
    """Plane positions of lattice coordinates."""
    i, j = ijk[..., 0] - ijk[..., 2], ijk[..., 1] - ijk[..., 2]
    return np.stack([i - 0.5 * j, j * _S], -1)


def _normal(ij: np.ndarray) -> np.ndarray:
    """i, j (with k 0) as coordinates of which the least is 0."""
    ijk = np.concatenate([ij, np.zeros((*ij.shape[:-1], 1), ij.dtype)], -1) if ij.shape[-1] == 2 else ij
    return ijk - ijk.min(-1, keepdims=True)


def _nearest(xy: np.ndarray) -> np.ndarray:
    """Lattice coordinates (i, j) of the hexagon that holds each plane position."""
    j = xy[:, 1] / _S
    i = xy[:, 0] + j / 2
    low = np.stack([np.floor(i), np.floor(j)], -1)
    cand = low[:, None, :] + np.array([(0, 0), (1, 0), (0, 1), (1, 1)])
    d = np.stack([cand[..., 0] - cand[..., 1] / 2 - xy[:, None, 0], cand[..., 1] * _S - xy[:, None, 1]], -1)
    return cand[np.arange(len(xy)), (d * d).sum(-1).argmin(1)].astype(np.int64)


def _odd(res: int) -> bool:
    return res % 2 == 1


def _up(ij: np.ndarray, res: int) -> np.ndarray:
    """The coarser hexagon of each one of resolution ``res``."""
    i, j = ij[:, 0], ij[:, 1]
    a, b = (3 * i - j, i + 2 * j) if _odd(res) else (2 * i + j, 3 * j - i)
    return np.stack([np.rint(a / 7.0), np.rint(b / 7.0)], -1).astype(np.int64)


def _down(ij: np.ndarray, res: int) -> np.ndarray:
    """Coordinates at resolution ``res`` of the centres of hexagons of the next coarser one."""
    i, j = ij[:, 0], ij[:, 1]
    return np.stack([2 * i + j, 3 * j - i], -1) if _odd(res) else np.stack([3 * i - j, i + 2 * j], -1)


class _Bases:
    """The 122 base cells: home face and coordinates, and for every face and coordinates up to 2 the base cell there and the turns into its own directions."""

    def __init__(self, faces: _Faces):
        cells = []
        for f in range(20):
            edges = (((1, 1, 0), (0, 1, 1)), ((1, 0, 1),), ((1, 1, 0),), ((0, 1, 1), (1, 0, 1)))[f // 5]
            tip = ((2, 0, 0),) if f in (0, 19) or 5 <= f < 15 else ()
            cells += [(f, c) for c in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), *edges, *tip)]
        home = np.array([f for f, _ in cells])
        at = faces.point(home, _flat(np.array([c for _, c in cells], float)))
        order = np.argsort(-at[:, 2], kind="stable")
        self.face, self.ijk, self.xyz = home[order], np.array([c for _, c in cells])[order], at[order]
        self.pentagon = self.ijk.max(1) == 2
        self.number, self.turns = np.zeros((20, 3, 3, 3), int), np.zeros((20, 3, 3, 3), int)
        for f in range(20):
            for c in np.ndindex(3, 3, 3):
                p = _flat(_normal(np.array(c)).astype(float))
                n = int(np.argmax(self.xyz @ faces.point(np.array(f), p)))
                self.number[f][c] = n
                if self.pentagon[n]:
                    self.turns[f][c] = self._around(faces, n, f)
                else:  # by how much the directions of the two faces differ there, by the way of unfolding
                    own = _flat(self.ijk[n].astype(float))
                    step = np.array([1e-3, 0.0])
                    a = faces.point(np.array(f), p + step) - faces.point(np.array(f), p)
                    b = faces.point(np.array(self.face[n]), own + step) - faces.point(np.array(self.face[n]), own)
                    angle = np.arctan2(np.dot(np.cross(b, a), self.xyz[n]), np.dot(a, b))
                    self.turns[f][c] = int(np.rint(angle / (np.pi / 3))) % 6
        self.clockwise = np.zeros((122, 20), bool)
        for n in np.flatnonzero(self.pentagon):
            for f in _CLOCKWISE.get(int(self.face[n]), ()):
                self.clockwise[n, f] = True

    def _around(self, faces: _Faces, n: int, f: int) -> int:
        """Turns from the directions of face ``f`` into those of a pentagon's home face, counted among the five that are there (k is not): by the steps between the faces about their common vertex, less what the corner of ``f`` is turned itself; 0 where they have no vertex in common."""
        v, g = self.xyz[n], self.face[n]
        for k in range(5):
            if g == f:
                return (k - (0, 1, 3)[int(np.argmax(faces.vertex[f] @ v))]) % 5
            # Leave over the edge whose corners are the vertex and the one that lies counter-clockwise.
            me = int(np.argmax(faces.vertex[g] @ v))
            others = [c for c in range(3) if c != me]
            side = [np.dot(np.cross(v, faces.vertex[g, c]), faces.z[g]) for c in others]
            g = faces.next[g, others[int(np.argmax(side))]]
        return 0


@lru_cache(maxsize=1)
def _tables() -> tuple[_Faces, _Bases]:
    f = _Faces()
    return f, _Bases(f)


def _turn_digits(digits: np.ndarray, how: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows of digits turned ``times`` times."""
    for k in range(int(times.max(initial=0))):
        rows = times > k
        digits[rows] = how[digits[rows]]
    return digits


def _leading(digits: np.ndarray) -> np.ndarray:
    some = (digits > 0) & (digits < 7)
    first = some.argmax(1)
    return np.where(some.any(1), digits[np.arange(len(digits)), first], 0)


def latlng_to_cell(lat, lng, res: int) -> np.ndarray:
    """H3 ids (int64) of positions in degrees; 0 where one is not finite or out of range."""
    faces, bases = _tables()
    lat, lng = np.asarray(lat, float), np.asarray(lng, float)
    ok = np.isfinite(lat) & np.isfinite(lng) & (np.abs(np.where(np.isfinite(lat), lat, 99)) <= 90)
    v = _xyz(np.radians(np.where(ok, lat, 0)), np.radians(np.where(ok, lng, 0)))
    face = (v @ faces.z.T).argmax(1)
    xy = faces.plane(face, v) * _ROOT7**res
    if _odd(res):
        c, s = np.cos(-_TURN), np.sin(-_TURN)
        xy = np.stack([c * xy[:, 0] - s * xy[:, 1], s * xy[:, 0] + c * xy[:, 1]], -1)
    ij, digits = _nearest(xy), np.full((len(lat), 15), 7, np.int64)
    lookup = {tuple(s): d for d, s in enumerate(_STEPS.tolist())}
    table = np.full((3, 3, 3), 7)
    for s, d in lookup.items():
        table[s] = d
    for r in range(res, 0, -1):
        up = _up(ij, r)
        diff = _normal(ij - _down(up, r))
        digits[:, r - 1] = table[diff[:, 0], diff[:, 1], diff[:, 2]]
        ij = up
    ijk = np.minimum(_normal(ij), 2)
    at = (face, ijk[:, 0], ijk[:, 1], ijk[:, 2])
    base, turns = bases.number[at], bases.turns[at]
    pent = bases.pentagon[base]
    digits[~pent] = _turn_digits(digits[~pent], _LEFT, turns[~pent])
    if pent.any():
        d, b, t, f = digits[pent], base[pent], turns[pent], face[pent]
        k = _leading(d) == 1
        cw = bases.clockwise[b, f]
        d[k & cw] = _RIGHT[d[k & cw]]
        d[k & ~cw] = _LEFT[d[k & ~cw]]
        for n in range(int(t.max(initial=0))):
            rows = t > n
            d[rows] = _LEFT[d[rows]]
            again = rows & (_leading(d) == 1)  # the directions of k are missing
            d[again] = _LEFT[d[again]]
        digits[pent] = d
    out = (MODE << 59) | (res << 52) | (base.astype(np.int64) << 45)
    for r in range(15):
        out |= digits[:, r] << (3 * (14 - r))
    return np.where(ok, out, 0)


def _unfolded(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, complex plane position in units of resolution 0, resolution) of the centres of ids."""
    faces, bases = _tables()
    res, base = (cells >> 52) & 15, (cells >> 45) & 127
    digits = np.stack([(cells >> (3 * (14 - r))) & 7 for r in range(15)], 1)
    face, p = np.zeros(len(cells), int), np.zeros(len(cells), complex)
    for r in np.unique(res):
        rows = np.flatnonzero(res == r)
        b = base[rows]
        ij = bases.ijk[b][:, :2] - bases.ijk[b][:, 2:]
        for q in range(1, r + 1):
            step = _STEPS[np.minimum(digits[rows, q - 1], 6)]
            ij = _down(ij, q) + step[:, :2] - step[:, 2:]
        flat = _flat(np.concatenate([ij, np.zeros((len(ij), 1), np.int64)], 1).astype(float))
        p[rows] = (flat[:, 0] + 1j * flat[:, 1]) / _ROOT7**r * np.exp(1j * (_TURN if _odd(r) else 0.0))
        face[rows] = bases.face[b]
    pent = bases.pentagon[base]
    face, p = _around_pentagons(face, p, pent)
    return face, p, res


def _around_pentagons(face: np.ndarray, p: np.ndarray, pent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions folded into their faces. About a pentagon (the i corner of its home face) the plane lacks the sixth of direction k, so the faces are walked through the other way."""
    faces, _ = _tables()
    out_face, out = faces.fold(face, np.where(pent, 0, p))
    for i in np.flatnonzero(pent):
        f, q, tip = int(face[i]), complex(p[i]), 2 + 0j
        angle = np.degrees(np.angle(q - tip)) if abs(q - tip) > 1e-9 else 180.0
        steps = 0 if abs(q - tip) <= 1e-9 or angle > 150 or angle < -150 else int(np.floor((150 - angle) / 60)) + 1
        if -150 <= angle < -120:  # less than half the gap beyond the home face's other edge
            steps = 0
        for _ in range(min(steps, 4)):
            # Over the edge between the tip and the corner counter-clockwise of it, seen from inside: that towards j in the home face.
            corner = faces.corner[:, 0] + 1j * faces.corner[:, 1]
            me = int(np.argmin(np.abs(corner - tip)))
            leave = next(c for c in range(3) if c != me and c != (me + 1) % 3)
            t, s, g = faces.turn[f, leave], faces.shift[f, leave], faces.next[f, leave]
            q, tip, f = q * t + s, tip * t + s, int(g)
        ff, qq = faces.fold(np.array([f]), np.array([q]))
        out_face[i], out[i] = ff[0], qq[0]
    return out_face, out


def least_width(res: int) -> float:
    """Radians between the parallel sides of the smallest cells: those farthest from a face's centre, where the projection stretches most."""
    return 0.5 * _UNIT / _ROOT7**res


def _degrees(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arcsin(np.clip(v[..., 2], -1, 1))), np.degrees(np.arctan2(v[..., 1], v[..., 0]))


def valid(cells: np.ndarray) -> np.ndarray:
    """Whether ids are H3 cells: mode, resolution, base cell and digits."""
    _, bases = _tables()
    cells = np.asarray(cells, np.int64)
    res, base = (cells >> 52) & 15, (cells >> 45) & 127
    digits = np.stack([(cells >> (3 * (14 - r))) & 7 for r in range(15)], 1)
    inside = np.arange(15)[None, :] < res[:, None]
    ok = (cells >> 59 == MODE) & ((cells >> 56) & 7 == 0) & (base < 122) & np.where(inside, digits < 7, digits == 7).all(1)
    return ok & ~(bases.pentagon[np.minimum(base, 121)] & (_leading(np.where(inside, digits, 7)) == 1))


def cell_to_latlng(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres in degrees; not a number for what is no H3 cell."""
    cells = np.asarray(cells, np.int64)
    ok = valid(cells)
    lat, lng = np.full(len(cells), np.nan), np.full(len(cells), np.nan)
    if ok.any():
        face, p, _ = _unfolded(cells[ok])
        lat[ok], lng[ok] = _degrees(_tables()[0].point(face, np.stack([p.real, p.imag], -1)))
    return lat, lng


def cell_to_boundary(cells: np.ndarray) -> list[list[tuple[float, float]] | None]:
    """Corners (lat, lng) counter-clockwise, six or for a pentagon five; None for what is no H3 cell. The points where an edge of the icosahedron cuts a side are not given."""
    cells = np.asarray(cells, np.int64)
    faces, bases = _tables()
    out: list = [None] * len(cells)
    ok = np.flatnonzero(valid(cells))
    if not len(ok):
        return out
    c = cells[ok]
    face, p, res = _unfolded(c)
    base = (c >> 45) & 127
    digits = np.stack([(c >> (3 * (14 - r))) & 7 for r in range(15)], 1)
    whole = bases.pentagon[base] & (np.where(np.arange(15)[None, :] < res[:, None], digits, 0).sum(1) == 0)
    size = np.exp(1j * np.where(res % 2 == 1, _TURN, 0.0)) / np.sqrt(3.0) / _ROOT7**res
    got = []
    for n in range(6):
        q = p + size * np.exp(1j * np.pi * (1 + 2 * n) / 6)
        f, q = faces.fold(face, q)
        got.append(_degrees(faces.point(f, np.stack([q.real, q.imag], -1))))
    for i, k in enumerate(ok):
        out[k] = [(float(g[0][i]), float(g[1][i])) for g in got]
    for i in np.flatnonzero(whole):
        home = np.full(5, bases.face[base[i]])
        # In odd resolutions the corners lie turned off the edges, still five.
        q = 2 + size[i] * np.exp(1j * np.radians([30.0, 90.0, 150.0, 210.0, 330.0]))
        f, q = _around_pentagons(home, q, np.ones(5, bool))
        a, b = _degrees(faces.point(f, np.stack([q.real, q.imag], -1)))
        out[ok[i]] = list(zip(a.tolist(), b.tolist()))
    return out
