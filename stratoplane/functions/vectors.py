"""Column expressions for points, vectors, planes and orientations (x East, y North, z up; angles in degrees).

A vector is a tuple of three columns. Divisions are guarded: undefined results are NULL, never NaN or an error.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, least: float = 1e-8) -> Vec:
    """a at length 1; NULL where it is shorter than least."""
    n = F.when(length(a) >= least, length(a))
    return a[0] / n, a[1] / n, a[2] / n


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def upper(n: Vec, tiny: float = 1e-9) -> Vec:
    """n or -n, so that nz >= 0; for vertical planes ny, then nx decides."""
    sign = F.when(n[2] > tiny, 1.0).when(n[2] < -tiny, -1.0).when(n[1] > tiny, 1.0).when(n[1] < -tiny, -1.0).when(n[0] < -tiny, -1.0).otherwise(1.0)
    return n[0] * sign, n[1] * sign, n[2] * sign


def dip(n: Vec) -> Column:
    return F.degrees(F.atan2(F.sqrt(n[0] * n[0] + n[1] * n[1]), F.abs(n[2])))


def dip_direction(n: Vec) -> Column:
    a = F.degrees(F.atan2(n[0], n[1]))
    return F.when(a < 0, a + 360.0).otherwise(a)


def normal_of(dip_deg: Column, direction_deg: Column) -> Vec:
    """The upward unit normal of a dip and dip direction."""
    d, a = F.radians(dip_deg), F.radians(direction_deg)
    return upper((F.sin(d) * F.sin(a), F.sin(d) * F.cos(a), F.cos(d)))


def plane_angle(a: Vec, b: Vec) -> Column:
    """The undirected angle between two planes with unit normals."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def direction_angle(a: Vec, b: Vec) -> Column:
    """The angle between two unit vectors."""
    return F.degrees(F.acos(clamp(dot(a, b), -1.0, 1.0)))


def plane_distance(n: Vec, d: Column, p: Vec) -> Column:
    """The signed distance of p from the plane n.x + d = 0 with unit normal."""
    return dot(n, p) + d


def normalised_plane_distance(n: Vec, d: Column, p: Vec) -> Column:
    """The same for a normal of any length; NULL for a zero one."""
    return (dot(n, p) + d) / F.nullif(length(n), F.lit(0.0))


def plane_through(a: Vec, b: Vec, c: Vec, least: float = 1e-8) -> tuple[Vec, Column]:
    """Unit normal and offset of the plane through three points; NULL for collinear ones."""
    n = unit(cross(minus(b, a), minus(c, a)), least)
    return n, -dot(n, a)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return length(cross(minus(b, a), minus(c, a))) / 2.0


def tetrahedron_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return F.abs(dot(minus(b, a), cross(minus(c, a), minus(d, a)))) / 6.0


def vertex_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """The angle at b."""
    u, v = minus(a, b), minus(c, b)
    return F.degrees(F.acos(clamp(dot(u, v) / F.nullif(length(u) * length(v), F.lit(0.0)), -1.0, 1.0)))


def in_plane_axes(n: Vec) -> tuple[Vec, Vec]:
    """Two unit axes of the plane: u from the vertical (or from the y axis, if the plane is nearly level), v = n x u."""
    level = F.abs(n[2]) > 0.9
    u = unit((F.when(level, 1.0).otherwise(0.0) * n[2] - F.when(level, 0.0).otherwise(1.0) * n[1], F.when(level, 0.0).otherwise(1.0) * n[0], -F.when(level, 1.0).otherwise(0.0) * n[0]))
    return u, cross(n, u)


def octant(p: Vec, mid: Vec) -> Column:
    """0 to 7: bit 0 for x, bit 1 for y, bit 2 for z at or above the middle."""
    return sum(F.when(p[k] < mid[k], 0).otherwise(1 << k) for k in range(3)).cast("int")


def id_colour(i: Column) -> Vec:
    """Red, green and blue of an integer id."""
    return tuple(F.pmod(a * i.cast("long") + b, F.lit(256)).cast("int") for a, b in ((37, 59), (17, 97), (73, 23)))


def text_colour(text: Column) -> Vec:
    """Red, green and blue from the digest of a text; '-1' is black."""
    h = F.md5(text)
    return tuple(F.when(text == "-1", 0).otherwise(F.conv(F.substring(h, k, 2), 16, 10).cast("int")) for k in (1, 3, 5))


def golden_colour(i: Column) -> Vec:
    """Red, green and blue around the colour wheel by the golden ratio, at fixed saturation and value, cut to whole numbers; exact
    primaries lose ten of each."""
    # The step of hue, saturation and value of debug colours.
    step, s, v = 0.61803398875, 0.65, 0.95
    hue = F.pmod(i.cast("double") * step, F.lit(1.0))
    k = F.floor(hue * 6.0)
    f = hue * 6.0 - k
    low, fall, rise, top = F.lit(v * (1.0 - s)), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f)), F.lit(v)
    ways = [(top, rise, low), (fall, top, low), (low, top, rise), (low, fall, top), (rise, low, top), (top, low, fall)]
    rgb = [F.floor(F.element_at(F.array(*(w[c] for w in ways)), (F.pmod(k, F.lit(6)) + 1).cast("int")) * 255.0).cast("int") for c in range(3)]
    pure = ((rgb[0] == 255).cast("int") + (rgb[1] == 255).cast("int") + (rgb[2] == 255).cast("int") == 1) & (rgb[0] + rgb[1] + rgb[2] == 255)
    return tuple(F.when(pure, F.greatest(F.lit(0), c - 10)).otherwise(c) for c in rgb)


def byte(c: Column) -> Column:
    """Half-even rounding into 0 to 255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(c))).cast("int")


def valid_orientation(dip_deg: Column, direction_deg: Column) -> Column:
    """Whether a dip (0 to 90) and a dip direction (0 up to 360) are there and in range."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    return ok(dip_deg) & ok(direction_deg) & dip_deg.between(0.0, 90.0) & (direction_deg >= 0.0) & (direction_deg < 360.0)


def positive(c: Column) -> Column:
    """Whether a measure is there, finite and above zero."""
    return c.isNotNull() & ~F.isnan(c) & (c > 0.0) & (c < float("inf"))


def compatible(plane: Vec, normal: Vec, least_cosine: float) -> Column:
    """Whether a point's normal, of any length, agrees with a plane's unit normal up to its sign."""
    return F.coalesce(F.abs(dot(plane, normal)) / F.nullif(length(normal), F.lit(0.0)) >= least_cosine, F.lit(False))
