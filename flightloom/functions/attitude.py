"""Quaternions (arrays w, x, y, z), rotation matrices (9 values, row by row) and attitude, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom.functions.geo import is_finite

GRAVITY = 9.81


def let(value: Column, body) -> Column:
    """Bind a value once so that a formula which uses it many times stays small."""
    return F.transform(F.array(value), body)[0]


def _let2(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda both: body(both["a"], both["b"]))


def q_is_finite(q: Column) -> Column:
    return is_finite(q[0]) & is_finite(q[1]) & is_finite(q[2]) & is_finite(q[3])


def q_norm(q: Column) -> Column:
    return F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])


def q_normalize(q: Column) -> Column:

    def scaled(v):
        return let(q_norm(v), lambda n: F.when(q_is_finite(v) & (n >= 1e-12), F.transform(v, lambda part: part / n)))

    return let(q, scaled)


def q_conjugate(q: Column) -> Column:
    return F.array(q[0], -q[1], -q[2], -q[3])


def q_multiply(a: Column, b: Column) -> Column:
    """Hamilton product: (s, u)(t, v) = (st - u.v, sv + tu + u x v)."""

    def product(p, q):
        scalar = p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3]
        vector = []
        for i, j, k in ((1, 2, 3), (2, 3, 1), (3, 1, 2)):
            vector.append(p[0] * q[i] + q[0] * p[i] + (p[j] * q[k] - p[k] * q[j]))
        return F.array(scalar, *vector)

    return _let2(a, b, product)


def q_from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Yaw, then pitch, then roll: the product of the three axis rotations."""

    def half(angle):
        return F.cos(F.radians(angle) / 2.0), F.sin(F.radians(angle) / 2.0)

    (cr, sr), (cp, sp), (cy, sy) = half(roll), half(pitch), half(yaw)
    # q_yaw * q_pitch, then * q_roll, multiplied out
    w, x, y, z = cy * cp, -(sy * sp), cy * sp, sy * cp
    return q_normalize(F.array(w * cr - x * sr, w * sr + x * cr, y * cr + z * sr, z * cr - y * sr))


def q_to_euler(q: Column) -> Column:
    """struct(roll, pitch, yaw) in degrees, yaw in 0..360."""
    return let(q_normalize(q), _euler_of_unit)


def _euler_of_unit(n: Column) -> Column:
    w, x, y, z = (n[i] for i in range(4))
    sin_pitch = (w * y - z * x) * 2.0
    pitch = F.when(F.abs(sin_pitch) >= 1.0, F.signum(sin_pitch) * (math.pi / 2.0)).otherwise(F.asin(sin_pitch))
    return F.struct(
        F.degrees(F.atan2((w * x + y * z) * 2.0, 1.0 - (x * x + y * y) * 2.0)).alias("roll"),
        F.degrees(pitch).alias("pitch"),
        F.pmod(F.degrees(F.atan2((w * z + x * y) * 2.0, 1.0 - (y * y + z * z) * 2.0)), F.lit(360.0)).alias("yaw"),
    )


def q_rotate(q: Column, v: Column) -> Column:
    """v turned by q: v + 2w(u x v) + 2u x (u x v), with u the vector part of the unit quaternion."""

    def turned(n, x):
        u = F.slice(n, 2, 3)
        return let(
            v_cross(u, x),
            lambda once: let(
                v_cross(u, once),
                lambda twice: F.array(*[x[i] + (n[0] * once[i] + twice[i]) * 2.0 for i in range(3)]),
            ),
        )

    return _let2(q_normalize(q), v, turned)


def q_angle_between(a: Column, b: Column) -> Column:
    """Radians between two orientations; infinite when either is invalid."""
    angle = _let2(q_normalize(a), q_normalize(b), lambda p, q: F.acos(F.least(F.lit(1.0), F.abs(_dot4(p, q)))) * 2.0)
    return F.coalesce(angle, F.lit(float("inf")))


def _dot4(p: Column, q: Column) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2] + p[3] * q[3]


def q_xyzw_to_wxyz(q: Column) -> Column:
    return q_normalize(F.array(q[3], q[0], q[1], q[2]))


def q_slerp(a: Column, b: Column, t: Column) -> Column:

    def blended(p, q):
        def by_angle(parts):
            sign, dot, angle = parts["sign"], parts["dot"], parts["angle"]
            near, sin_angle = dot > 0.9995, F.nullif(F.sin(angle), F.lit(0.0))
            keep = F.when(near, 1.0 - t).otherwise(F.sin(angle * (1.0 - t)) / sin_angle)
            take = F.when(near, t).otherwise(F.sin(angle * t) / sin_angle)
            return F.zip_with(p, q, lambda x, y: keep * x + take * sign * y)

        signed = _dot4(p, q)
        parts = F.struct(
            F.when(signed < 0, -1.0).otherwise(1.0).alias("sign"),
            F.abs(signed).alias("dot"),
            F.acos(F.least(F.lit(1.0), F.abs(signed))).alias("angle"),
        )
        return let(parts, by_angle)

    return q_normalize(_let2(q_normalize(a), q_normalize(b), blended))


def rotation_matrix(roll: Column, pitch: Column, yaw: Column) -> Column:
    angles = {"r": roll, "p": pitch, "y": yaw}
    parts = [F.cos(F.radians(v)).alias("c" + k) for k, v in angles.items()]
    parts += [F.sin(F.radians(v)).alias("s" + k) for k, v in angles.items()]
    return let(F.struct(*parts), _matrix_of_angles)


def _matrix_of_angles(v: Column) -> Column:
    cr, sr, cp, sp, cy, sy = (v[k] for k in ("cr", "sr", "cp", "sp", "cy", "sy"))
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def mat3_mul(a: Column, b: Column) -> Column:

    def product(p, q):
        cells = [(r, c) for r in range(3) for c in range(3)]
        return F.array(*[p[3 * r] * q[c] + p[3 * r + 1] * q[3 + c] + p[3 * r + 2] * q[6 + c] for r, c in cells])

    return _let2(a, b, product)


def mat3_transpose(m: Column) -> Column:
    return let(m, lambda v: F.array(*[v[3 * c + r] for r in range(3) for c in range(3)]))


def mat3_inv(m: Column) -> Column:
    """Inverse by cofactors; null when singular."""
    return let(m, _inverse)


def _inverse(m: Column) -> Column:
    def cofactor(r, c):
        r1, r2, c1, c2 = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
        return m[3 * r1 + c1] * m[3 * r2 + c2] - m[3 * r1 + c2] * m[3 * r2 + c1]

    determinant = m[0] * cofactor(0, 0) + m[1] * cofactor(0, 1) + m[2] * cofactor(0, 2)
    adjugate = F.array(*[cofactor(c, r) for r in range(3) for c in range(3)])
    return let(determinant, lambda det: F.when(det != 0.0, F.transform(adjugate, lambda v: v / det)))


def _through_camera(rotation: Column, focal: Column, cx: Column, cy: Column) -> Column:
    """K R K^-1 scaled so its last entry is 1, K being focal, centre x, centre y; nulls where there is no such matrix."""
    zero, one = F.lit(0.0), F.lit(1.0)
    focal = F.nullif(focal, zero)
    k = F.array(focal, zero, cx, zero, focal, cy, zero, zero, one)
    k_inv = F.array(one / focal, zero, -cx / focal, zero, one / focal, -cy / focal, zero, zero, one)
    return let(mat3_mul(mat3_mul(k, rotation), k_inv), lambda h: F.transform(h, lambda v: v / F.nullif(h[8], F.lit(0.0))))


def normalization_homography(
    roll: Column, pitch: Column, yaw: Column, focal: Column, cx: Column, cy: Column
) -> Column:
    return _through_camera(mat3_transpose(rotation_matrix(roll, pitch, yaw)), focal, cx, cy)


def relative_homography(rot_a: Column, rot_b: Column, focal: Column, cx: Column, cy: Column) -> Column:
    return _through_camera(mat3_mul(rot_b, mat3_transpose(rot_a)), focal, cx, cy)


def tilt_from_accel(ax: Column, ay: Column, az: Column) -> Column:
    return F.struct(
        F.degrees(F.atan2(ay, az)).alias("roll"),
        F.degrees(F.atan2(-ax, F.hypot(ay, az))).alias("pitch"),
    )


def mount_rotate(mount: Column, q: Column) -> Column:
    return q_normalize(q_multiply(q_normalize(mount), q))


def vector_norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for part in parts[1:]:
        total = total + part * part
    return F.sqrt(total)


def accel_g(ax: Column, ay: Column, az: Column, gravity: float = 9.80665) -> Column:
    n = vector_norm(ax, ay, az)
    return F.when(n <= 0.0, 1.0).otherwise(n / gravity)


def earth_down_accel(roll: Column, pitch: Column, ax: Column, ay: Column, az: Column) -> Column:
    """Radians in; the body acceleration along the earth's down axis."""
    return F.cos(pitch) * (F.sin(roll) * ay + F.cos(roll) * az) - F.sin(pitch) * ax


def turn_rate_to_bank(rate: Column, airspeed: Column) -> Column:
    return F.when(airspeed < 0.1, 0.0).otherwise(F.atan(rate * airspeed / GRAVITY))


def bank_to_turn_rate(bank: Column, airspeed: Column) -> Column:
    return F.when(airspeed < 0.1, 0.0).otherwise(F.tan(bank) * GRAVITY / F.nullif(airspeed, F.lit(0.0)))


def q_to_matrix(q: Column) -> Column:
    return let(q, _matrix_of_unit)


def _matrix_of_unit(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        1.0 - (y * y + z * z) * 2.0, (x * y - w * z) * 2.0, (x * z + w * y) * 2.0,
        (x * y + w * z) * 2.0, 1.0 - (x * x + z * z) * 2.0, (y * z - w * x) * 2.0,
        (x * z - w * y) * 2.0, (y * z + w * x) * 2.0, 1.0 - (x * x + y * y) * 2.0,
    )


def matrix_to_euler(m: Column) -> Column:
    """struct(roll, pitch, yaw) in degrees; at pitch +-90 yaw is 0 and roll takes the rest."""
    return let(m, _euler_of_matrix)


def _euler_of_matrix(m: Column) -> Column:
    sin_pitch = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -m[6]))
    locked = 1.0 - F.abs(m[6]) < 1e-9
    return F.struct(
        F.degrees(F.when(locked, F.atan2(-m[1], m[4])).otherwise(F.atan2(m[7], m[8]))).alias("roll"),
        F.degrees(F.when(locked, F.signum(-m[6]) * (math.pi / 2.0)).otherwise(F.asin(sin_pitch))).alias("pitch"),
        F.degrees(F.when(locked, F.lit(0.0)).otherwise(F.atan2(m[3], m[0]))).alias("yaw"),
    )


def pose_centre(q: Column, t: Column) -> Column:
    """Camera centre of a world-to-camera pose: minus R transposed times t."""
    back = q_rotate(q_conjugate(q), t)
    return F.transform(back, lambda v: -v)


def v_dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def v_cross(a: Column, b: Column) -> Column:
    return F.array(*[a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)])


def v_rotate(v: Column, axis: Column, degrees: Column) -> Column:
    """v turned about a unit axis."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    along, across = v_dot(v, axis) * (1.0 - c), v_cross(axis, v)
    return F.array(*[v[i] * c + across[i] * s + axis[i] * along for i in range(3)])
