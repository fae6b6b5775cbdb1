"""Column functions of geometry: back-projection, poses, quaternions, angles, boxes, depth units.

Headings are compass angles: 0 is +y, clockwise positive. Quaternions are (x, y, z, w) in files
and (w, x, y, z) in point attributes. Depth in metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def pinhole(u: Column, v: Column, d: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    return (u - cx) * d / fx, (v - cy) * d / fy, d


def equirect(u: Column, v: Column, d: Column, width: int, height: int, convention: str = "lonlat", offset: float = 0.0) -> Vec:
    """Panorama pixels to camera space. lonlat: x = d cos lat sin lon, y = d cos lat cos lon,
    z = d sin lat. thetaphi: polar angle from +y down, with a heading offset. yawpitch: y down, z ahead."""
    lon = u / width * (2 * math.pi) - math.pi
    lat = F.lit(math.pi / 2) - v / height * math.pi
    if convention == "lonlat":
        return d * F.cos(lat) * F.sin(lon), d * F.cos(lat) * F.cos(lon), d * F.sin(lat)
    if convention == "thetaphi":
        theta, phi = lon + offset, v / height * math.pi
        return d * F.sin(phi) * F.sin(theta), d * F.cos(phi), -d * F.sin(phi) * F.cos(theta)
    if convention == "yawpitch":
        return d * F.cos(lat) * F.sin(lon), -d * F.sin(lat), d * F.cos(lat) * F.cos(lon)
    raise ValueError(convention)


def rotate_translate(p: Vec, r: list[Column], t: Vec) -> Vec:
    """R p + t for a row-major 3x3 rotation."""
    return tuple(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3))  # type: ignore[return-value]


def quat_rotation(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major rotation of a unit quaternion."""
    one, two = F.lit(1.0), 2.0
    return [one - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w), two * (x * y + z * w), one - two * (x * x + z * z), two * (y * z - x * w), two * (x * z - y * w), two * (y * z + x * w), one - two * (x * x + y * y)]


def pose_matrix(q: tuple[Column, Column, Column, Column], t: Vec) -> Column:
    """16 numbers, row-major, from a scalar-last quaternion and a translation."""
    r = quat_rotation(*q)
    rows = [*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return F.array(*[c.cast("double") for c in rows])


def invert_pose(r: list[Column], t: Vec) -> tuple[list[Column], Vec]:
    """The rigid inverse: transposed rotation, and minus it times the translation."""
    rt = [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]
    zero = F.lit(0.0)
    moved = rotate_translate(t, rt, (zero, zero, zero))
    return rt, tuple(-m for m in moved)  # type: ignore[return-value]


def hamilton(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Product of quaternions (w, x, y, z)."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw


def unit_quat(q: tuple[Column, ...], eps: float = 1e-4) -> tuple[Column, ...]:
    size = F.greatest(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), F.lit(eps))
    return tuple(c / size for c in q)


def z_up(x: Column, y: Column, z: Column, source: str = "yup") -> Vec:
    """(x, -z, y) from a y-up frame; (x, z, -y) from a panorama with y down."""
    return (x, -z, y) if source == "yup" else (x, z, -y)


def wrap_angle(a: Column) -> Column:
    """(a + pi) mod 2 pi - pi, with a modulo that is never negative."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def heading_of(dx: Column, dy: Column) -> Column:
    return F.pmod(F.lit(math.pi / 2) - F.atan2(dy, dx), F.lit(2 * math.pi))


#: Frame kinds whose camera looks along minus z with z up, along plus z with y down,
#: and (any kind that contains the word) along minus z with the angle taken from the x axis.
LOOKS_BACK, LOOKS_AHEAD, FROM_X = ("matterport", "hm3d", "gibson"), ("realsee",), "structured3d"


def pose_heading(kind: Column, r: list[Column]) -> Column:
    """Heading of a camera with row-major rotation r, by the rule of its frame kind, not wrapped;
    0 for unknown kinds and null."""
    back = F.lit(math.pi / 2) - F.atan2(-r[5], -r[2])
    ahead = F.lit(math.pi / 2) - F.atan2(r[8], r[2])
    return F.when(kind.isin(*LOOKS_BACK), back).when(kind.isin(*LOOKS_AHEAD), ahead).when(F.contains(kind, F.lit(FROM_X)), F.atan2(-r[5], -r[2])).otherwise(0.0)


def pose_position(kind: Column, t: Vec) -> Vec:
    """Position with z up: kinds with y down have y and z exchanged, and z reversed."""
    down = kind.isin(*LOOKS_AHEAD)
    return t[0], F.when(down, t[2]).otherwise(t[1]), F.when(down, -t[1]).otherwise(t[2])


def depth_metres(kind: Column, raw: Column, scale: Column) -> Column:
    """Raw depth in metres: as is, millimetres, or by the frame's own scale; unknown kinds are 0."""
    return F.when(kind == "metres", raw).when(kind == "millimetres", raw / 1000.0).when(kind == "scaled", raw / scale).otherwise(0.0)


#: Valid depth by layout, both ends left out.
DEPTH_LIMITS = {"pinhole": (0.01, 10.0), "panorama": (0.0, 10.0), "triplet": (0.1, 4.0), "ordinal": (0.1, 3.0), "rooms": (0.1, 10.0)}


def depth_valid(layout: str, d: Column, filled_limit: float | None = None) -> Column:
    low, high = DEPTH_LIMITS[layout]
    return (d > low) & (d < (high if filled_limit is None else min(high, filled_limit)))


def panorama_mask(v: Column, d: Column, height: int, pole_deg: float = 30.0, low: float = 0.4, high: float = 10.0, external: Column | None = None) -> Column:
    """Pixels off the poles with a depth in [low, high), and with 255 in the external mask if one is given."""
    if external is not None:
        return panorama_mask(v, d, height, pole_deg, low, high) & (external == 255)
    lat = 90.0 - (v + 0.5) * (180.0 / height)
    return (F.abs(lat) <= 90.0 - pole_deg) & (d >= low) & (d < high)


#: Ids of walkable classes (floor, rug, sidewalk, earth, road, path, step) and of doors.
WALKABLE_IDS, DOOR_IDS = (3, 9, 11, 12, 13, 29, 94), (14,)


def class_mask(cls: Column, depth: Column, ids: tuple[int, ...] = WALKABLE_IDS, near: float = 0.2, far: float = 10.0) -> Column:
    """True for pixels of one of the classes with a depth strictly between near and far; false for
    null classes and depths."""
    return F.coalesce(cls.isin(*ids) & (depth > near) & (depth < far), F.lit(False))


def strip_mask(v: Column, height: int, top: int, bottom: int, of: int) -> Column:
    """Rows left after cutting top/of and bottom/of of the height (whole rows)."""
    return (v >= height * top // of) & (v < height - height * bottom // of)


def colour_match(rgb: Vec, target: tuple[float, float, float], tol: float) -> Column:
    return sum((F.abs(c - t) for c, t in zip(rgb[1:], target[1:])), F.abs(rgb[0] - target[0])) < tol


def zdepth_to_euclid(d: Column, u: Column, v: Column, width: int, height: int) -> Column:
    """Cube-face depth to distance: d over the greatest component of the pixel's unit ray; whole
    millimetres within 16 bits."""
    x, y = (u + 0.5) / width * 2.0 - 1.0, (v + 0.5) / height * 2.0 - 1.0
    size = F.sqrt(x * x + y * y + 1.0)
    top = F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) / size
    return F.least(F.lit(65535), F.greatest(F.lit(0), F.floor(d / top * 1000.0))).cast("int")


def box_corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def box_centre(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    return (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0


def scale_box(box: tuple[Column, ...], sx: Column | float, sy: Column | float, width: int, height: int) -> tuple[Column, ...]:
    """Corners scaled and clamped to the image."""
    clamp = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), c))
    return clamp(box[0] * sx, width), clamp(box[1] * sy, height), clamp(box[2] * sx, width), clamp(box[3] * sy, height)


def reduce_zero_label(label: Column) -> Column:
    return F.when(label == 255, 255).when(label == 0, 255).otherwise(label - 1)


def multi_hot(labels: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(labels, i).cast("int"))


ACTIONS = {"STOP": 0, "MOVE_FORWARD": 1, "TURN_LEFT": 2, "TURN_RIGHT": 3, "LOOK_UP": 4, "LOOK_DOWN": 5}
ARROWS = {0: "STOP", 1: "↑", 2: "←", 3: "→"}


def encode_action(name: Column) -> Column:
    out = None
    for k, v in ACTIONS.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out.otherwise(0)


def action_arrow(action: Column) -> Column:
    out = None
    for k, v in ARROWS.items():
        out = F.when(action == k, v) if out is None else out.when(action == k, v)
    return out.otherwise("")


def rodrigues(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Row-major rotation of a rotation vector."""
    a = F.sqrt(rx * rx + ry * ry + rz * rz)
    s = F.when(a < 1e-12, 1.0).otherwise(F.sin(a) / F.nullif(a, F.lit(0.0)))
    c = F.when(a < 1e-12, 0.5).otherwise((1 - F.cos(a)) / F.nullif(a * a, F.lit(0.0)))
    one = F.lit(1.0)
    return [one - c * (ry * ry + rz * rz), c * rx * ry - s * rz, c * rx * rz + s * ry, c * rx * ry + s * rz, one - c * (rx * rx + rz * rz), c * ry * rz - s * rx, c * rx * rz - s * ry, c * ry * rz + s * rx, one - c * (rx * rx + ry * ry)]


#: Helpers as SQL functions: name, parameters, result and body.
SQL_HELPERS = {
    "wrap_angle": ("a DOUBLE", "DOUBLE", "pmod(a + pi(), 2 * pi()) - pi()"),
    "heading_of": ("dx DOUBLE, dy DOUBLE", "DOUBLE", "pmod(pi() / 2 - atan2(dy, dx), 2 * pi())"),
    "quat_yaw": ("x DOUBLE, y DOUBLE, z DOUBLE, w DOUBLE", "DOUBLE", "atan2(2 * (x * y + z * w), 1 - 2 * (y * y + z * z))"),
    "quat_rotate": (
        "x DOUBLE, y DOUBLE, z DOUBLE, w DOUBLE, p ARRAY<DOUBLE>", "ARRAY<DOUBLE>",
        "array((1 - 2 * (y * y + z * z)) * p[0] + 2 * (x * y - z * w) * p[1] + 2 * (x * z + y * w) * p[2], "
        "2 * (x * y + z * w) * p[0] + (1 - 2 * (x * x + z * z)) * p[1] + 2 * (y * z - x * w) * p[2], "
        "2 * (x * z - y * w) * p[0] + 2 * (y * z + x * w) * p[1] + (1 - 2 * (x * x + y * y)) * p[2])",
    ),
}


def register_helpers(spark) -> None:
    """Angles and quaternions (scalar last) as temporary SQL functions, which Catalyst inlines."""
    for name, (takes, gives, body) in SQL_HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
