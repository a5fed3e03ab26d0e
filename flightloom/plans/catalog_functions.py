"""Queries: every column function, on the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.functions import attitude as att
from flightloom.functions import footprint as fp
from flightloom.functions import geo, pressure, values
from flightloom.plans.registry import query
from flightloom.plans.sqltext import haversine, r, wrap

c = F.col
LAT0, LON0 = 18.5204, 73.8567


def lit(x):
    return F.lit(float(x))


def rounded(df, keys, **columns):
    """Keys as they are, everything else rounded to six digits."""
    return df.select(*keys, *[F.round(v, 6).alias(k) for k, v in columns.items()])


@query(
    "geo_frames",
    ["fx_capture"],
    f"""with p as (select *, 18.5204::double as lat0, 73.8567::double as lon0, 10 * roll as n, 10 * pitch as e from fx_capture),
    q as (select *, radians(lat0) + n / 6371000.0 as nlat from p)
    select mission_id, seq,
      {r(haversine('lat0', 'lon0', 'latitude', 'longitude'))} as haversine_m,
      {r('radians(longitude - lon0) * 6371000.0 * cos(radians(lat0))')} as ref_east,
      {r('radians(latitude - lat0) * 6371000.0')} as ref_north,
      {r('(radians(latitude) - radians(lat0)) * 6371000.0')} as mean_north,
      {r('(radians(longitude) - radians(lon0)) * 6371000.0 * cos((radians(latitude) + radians(lat0)) / 2)')} as mean_east,
      {r('sqrt(pow((radians(latitude) - radians(lat0)) * 6371000.0, 2) + pow((radians(longitude) - radians(lon0)) * 6371000.0 * cos((radians(latitude) + radians(lat0)) / 2), 2))')} as flat_m,
      {r('degrees(nlat)')} as back_lat,
      {r('degrees(radians(lon0) + e / (6371000.0 * greatest(1e-9, abs(cos((nlat + radians(lat0)) / 2)))))')} as back_lon,
      {r('latitude + degrees(n / 6371000.0)')} as moved_lat,
      {r('longitude + degrees(e / (6371000.0 * greatest(cos(radians(latitude)), 1e-9)))')} as moved_lon,
      cast(floor(radians(longitude - lon0) * 6371000.0 * cos(radians(lat0)) / 120.0) as bigint) as cell_x,
      cast(floor(radians(latitude - lat0) * 6371000.0 / 120.0) as bigint) as cell_y,
      {r('atan2(radians(longitude - lon0) * 6371000.0 * cos(radians(lat0)) * -1, radians(latitude - lat0) * 6371000.0 * -1)')} as bearing,
      {r('sqrt(pow(radians(longitude - lon0) * 6371000.0 * cos(radians(lat0)), 2) + pow(radians(latitude - lat0) * 6371000.0, 2))')} as to_origin_m
    from q""",
)
def geo_frames(d):
    df = d.fx_capture
    lat, lon, lat0, lon0 = c("latitude"), c("longitude"), lit(LAT0), lit(LON0)
    n, e = c("roll") * 10, c("pitch") * 10
    ref, mean = geo.to_local_ref(lat, lon, lat0, lon0), geo.to_local_mean(lat, lon, lat0, lon0)
    back, moved = geo.to_geodetic_mean(n, e, lat0, lon0), geo.offset_latlon(lat, lon, e, n)
    cell = geo.grid_cell(ref["east"], ref["north"], 120.0)
    home = geo.bearing_and_distance(ref["east"], ref["north"], lit(0), lit(0))
    return rounded(
        df, ["mission_id", "seq", cell["cx"].alias("cell_x"), cell["cy"].alias("cell_y")],
        haversine_m=geo.haversine_m(lat0, lon0, lat, lon),
        ref_east=ref["east"], ref_north=ref["north"], mean_north=mean["north"], mean_east=mean["east"],
        flat_m=geo.flat_distance_m(lat0, lon0, lat, lon),
        back_lat=back["lat"], back_lon=back["lon"], moved_lat=moved["lat"], moved_lon=moved["lon"],
        bearing=home["bearing"], to_origin_m=home["distance"],
    )


@query(
    "geo_angles",
    ["fx_capture"],
    f"""select mission_id, seq,
      latitude between -90 and 90 and longitude * 2 between -180 and 180 as valid_doubled,
      {r(wrap('yaw * 3 - 500'))} as wrapped,
      {r(wrap('yaw - roll * 10 + 180') + ' - 180')} as diff,
      {r('abs(' + wrap('roll * 10 - yaw + 180') + ' - 180)')} as delta,
      {r(wrap('yaw + 0.35 * (' + wrap('gyro_x + 180') + ' - 180)'))} as lerped,
      {r('gps_altitude * cos(radians(yaw))')} as vn, {r('gps_altitude * sin(radians(yaw))')} as ve,
      {r('sqrt(roll * roll + pitch * pitch)')} as speed,
      {r('case when roll = 0 and pitch = 0 then 0 else ' + wrap('degrees(atan2(pitch, roll))') + ' end')} as course,
      {r('(case when event_id % 2 = 0 then -1 else 1 end) * (gps_altitude + abs(roll) / 60 + abs(pitch) / 3600)')} as dms,
      {r('gyro_x / nullif(event_id % 5, 0)')} as ratio,
      {r('(case when event_id % 2 = 0 then -1 else 1 end) * (floor(gps_altitude / 1) + (abs(roll) + 0.25) / 60)')} as nmea,
      {r('gps_altitude * 0.514444')} as mps,
      latitude is not null as finite
    from fx_capture""",
)
def geo_angles(d):
    df = d.fx_capture
    ref = F.when(c("event_id") % 2 == 0, "S").otherwise("N")
    text = F.concat(
        F.format_string("%02d", c("gps_altitude").cast("int")), F.format_string("%02d", F.abs("roll").cast("int")), F.lit(".25")
    )
    v, s = geo.velocity_from_course(c("gps_altitude"), c("yaw")), geo.course_from_velocity(c("roll"), c("pitch"))
    return rounded(
        df,
        ["mission_id", "seq", geo.valid_lat_lon(c("latitude"), c("longitude") * 2).alias("valid_doubled"),
         geo.is_finite(c("latitude")).alias("finite")],
        wrapped=geo.wrap_360(c("yaw") * 3 - 500),
        diff=geo.angle_diff(c("yaw"), c("roll") * 10),
        delta=geo.angle_delta(c("yaw"), c("roll") * 10),
        lerped=geo.circular_lerp(c("yaw"), c("yaw") + c("gyro_x"), lit(0.35)),
        vn=v["vn"], ve=v["ve"], speed=s["speed"], course=s["course"],
        dms=geo.dms_to_decimal(c("gps_altitude"), F.abs("roll"), F.abs("pitch"), ref),
        ratio=geo.rational(c("gyro_x"), c("event_id") % 5),
        nmea=geo.nmea_degrees(text, ref),
        mps=geo.knots_to_mps(c("gps_altitude")),
    )


_TILT = "(1 / greatest(0.35, cos(radians(least(70, sqrt(roll * roll + pitch * pitch))))))"


@query(
    "footprint_functions",
    ["fx_capture"],
    f"""with s as (select *, greatest(case when baro_altitude <> 0 then baro_altitude else gps_altitude end, 2) as alt from fx_capture),
    g as (select *, 2 * alt * tan(radians(62.2) / 2) * {_TILT} as w, 2 * alt * tan(radians(48.8) / 2) * {_TILT} as h, cos(radians(yaw)) as co, sin(radians(yaw)) as si from s),
    k as (select *, abs(w / 2 * co) + abs(h / 2 * si) as ex, abs(w / 2 * si) + abs(h / 2 * co) as ny from g)
    select mission_id, seq, {r('alt')} as alt, {r('w')} as width, {r('h')} as height, {r('w * h')} as area,
      {r('-w / 2 * co + h / 2 * si')} as nw_east, {r('w / 2 * si + h / 2 * co')} as nw_north,
      {r('w / 2 * co - h / 2 * si')} as se_east, {r('-w / 2 * si - h / 2 * co')} as se_north,
      {r('-ex')} as min_e, {r('ny')} as max_n,
      {r('least(1, greatest(0, 2 * ex - 10) * (2 * ny) / greatest(1, w * h))')} as shifted_overlap,
      {r('greatest(alt, gps_altitude) / greatest(1e-6, least(alt, gps_altitude))')} as alt_ratio,
      {r('sqrt(pow(roll - 5, 2) + pow(pitch + 3, 2))')} as dtilt
    from k""",
)
def footprint_functions(d):
    from flightloom.operators.prepare import altitude_floor

    df = d.fx_capture.withColumn("alt", altitude_floor(c("baro_altitude"), c("gps_altitude")))
    df = df.withColumn("size", fp.footprint_size_tilted(c("alt"), c("roll"), c("pitch")))
    df = df.withColumn("quad", fp.corners_local(lit(0), lit(0), c("size"), c("yaw")))
    df = df.withColumn("box", fp.bounds(c("quad"))).withColumn("area", fp.area_m2(c("size")))
    moved = F.struct(
        (c("box.min_e") + 10).alias("min_e"), c("box.min_n"), (c("box.max_e") + 10).alias("max_e"), c("box.max_n")
    )
    return rounded(
        df, ["mission_id", "seq"], alt=c("alt"), width=c("size.width"), height=c("size.height"), area=c("area"),
        nw_east=c("quad")[0]["east"], nw_north=c("quad")[0]["north"],
        se_east=c("quad")[2]["east"], se_north=c("quad")[2]["north"],
        min_e=c("box.min_e"), max_n=c("box.max_n"),
        shifted_overlap=fp.overlap_ratio(c("box"), moved, c("area"), c("area")),
        alt_ratio=fp.altitude_ratio(c("alt"), c("gps_altitude")),
        dtilt=fp.tilt_delta(c("roll"), c("pitch"), lit(5), lit(-3)),
    )


# the unit quaternion of roll, pitch, yaw, by the half-angle formula
def _quat(roll: str, pitch: str, yaw: str, name: str) -> str:
    cr, sr = f"cos(radians({roll}) / 2)", f"sin(radians({roll}) / 2)"
    cp, sp = f"cos(radians({pitch}) / 2)", f"sin(radians({pitch}) / 2)"
    cy, sy = f"cos(radians({yaw}) / 2)", f"sin(radians({yaw}) / 2)"
    return (
        f"{cr} * {cp} * {cy} + {sr} * {sp} * {sy} as {name}w, {sr} * {cp} * {cy} - {cr} * {sp} * {sy} as {name}x, "
        f"{cr} * {sp} * {cy} + {sr} * {cp} * {sy} as {name}y, {cr} * {cp} * {sy} - {sr} * {sp} * {cy} as {name}z"
    )


@query(
    "quaternion_functions",
    ["fx_capture"],
    f"""with q as (select *, {_quat('roll', 'pitch', 'yaw', 'a')}, {_quat('pitch', 'roll', 'yaw + 20', 'g')} from fx_capture),
    m as (select *, aw*gw - ax*gx - ay*gy - az*gz as pw, aw*gx + ax*gw + ay*gz - az*gy as px,
       aw*gy - ax*gz + ay*gw + az*gx as py, aw*gz + ax*gy - ay*gx + az*gw as pz, aw*gw + ax*gx + ay*gy + az*gz as dot,
       cos(radians(yaw)) as cy, sin(radians(yaw)) as sy, cos(radians(pitch)) as cp, sin(radians(pitch)) as sp, cos(radians(roll)) as cr, sin(radians(roll)) as sr from q),
    s as (select *, acos(least(1, abs(dot))) as th, case when dot < 0 then -1 else 1 end as sg from m),
    k as (select *, case when abs(dot) > 0.9995 then 0.75 else sin(0.75 * th) / nullif(sin(th), 0) end as ka, case when abs(dot) > 0.9995 then 0.25 else sin(0.25 * th) / nullif(sin(th), 0) end as kb from s),
    l as (select *, ka*aw + kb*sg*gw as lw, ka*ax + kb*sg*gx as lx, ka*ay + kb*sg*gy as ly, ka*az + kb*sg*gz as lz from k)
    select mission_id, seq, {r('aw')} as qw, {r('ax')} as qx, {r('ay')} as qy, {r('az')} as qz,
      {r('pw')} as mul_w, {r('px')} as mul_x, {r('py')} as mul_y, {r('pz')} as mul_z,
      {r('-ax')} as conj_x, {r('roll')} as back_roll, {r('pitch')} as back_pitch, {r('yaw')} as back_yaw,
      {r('cy*cp*1 + (cy*sp*sr - sy*cr)*2 + (cy*sp*cr + sy*sr)*3')} as rot_x,
      {r('sy*cp*1 + (sy*sp*sr + cy*cr)*2 + (sy*sp*cr - cy*sr)*3')} as rot_y,
      {r('-sp*1 + cp*sr*2 + cp*cr*3')} as rot_z,
      {r('2 * acos(least(1, abs(dot)))', 4)} as between_rad,
      {r('lw / sqrt(lw*lw+lx*lx+ly*ly+lz*lz)')} as slerp_w, {r('lz / sqrt(lw*lw+lx*lx+ly*ly+lz*lz)')} as slerp_z,
      1.0::double as norm_doubled, {r('-ax')} as mounted_w, {r('aw')} as mounted_x
    from l""",
)
def quaternion_functions(d):
    df = d.fx_capture.withColumn("a", att.q_from_euler(c("roll"), c("pitch"), c("yaw")))
    df = df.withColumn("b", att.q_from_euler(c("pitch"), c("roll"), c("yaw") + 20))
    df = df.select(
        "*", att.q_multiply(c("a"), c("b")).alias("p"), att.q_to_euler(c("a")).alias("e"),
        att.q_rotate(c("a"), F.array(lit(1), lit(2), lit(3))).alias("v"),
        att.q_slerp(c("a"), c("b"), lit(0.25)).alias("s"),
        att.q_norm(att.q_normalize(F.transform("a", lambda x: x * 2))).alias("n"),
        att.mount_rotate(F.array(lit(0), lit(1), lit(0), lit(0)), c("a")).alias("m"),
        att.q_xyzw_to_wxyz(F.array(c("a")[1], c("a")[2], c("a")[3], c("a")[0])).alias("w"),
    )
    return rounded(
        df, ["mission_id", "seq"],
        qw=c("w")[0], qx=c("w")[1], qy=c("a")[2], qz=c("a")[3],
        mul_w=c("p")[0], mul_x=c("p")[1], mul_y=c("p")[2], mul_z=c("p")[3],
        conj_x=att.q_conjugate(c("a"))[1], back_roll=c("e.roll"), back_pitch=c("e.pitch"),
        back_yaw=F.pmod(F.round("e.yaw", 6), lit(360)),
        rot_x=c("v")[0], rot_y=c("v")[1], rot_z=c("v")[2],
        between_rad=F.round(att.q_angle_between(c("a"), c("b")), 4),
        slerp_w=c("s")[0], slerp_z=c("s")[3], norm_doubled=c("n"), mounted_w=c("m")[0], mounted_x=c("m")[1],
    )


@query(
    "rotation_functions",
    ["fx_capture"],
    f"""with t as (select *, cos(radians(yaw)) as cy, sin(radians(yaw)) as sy, cos(radians(pitch)) as cp, sin(radians(pitch)) as sp, cos(radians(roll)) as cr, sin(radians(roll)) as sr,
        {_quat('roll', 'pitch', 'yaw', 'a')} from fx_capture),
    m as (select *, cy*cp as m0, cy*sp*sr - sy*cr as m1, cy*sp*cr + sy*sr as m2, sy*cp as m3, sy*sp*sr + cy*cr as m4, sy*sp*cr - cy*sr as m5, -sp as m6, cp*sr as m7, cp*cr as m8 from t),
    -- K R' K^-1 for K = (3100, 2028, 1520)
    h as (select *,
       -- rows of K R'
       3100*m0 + 2028*m2 as r00, 3100*m3 + 2028*m5 as r01, 3100*m6 + 2028*m8 as r02,
       3100*m1 + 1520*m2 as r10, 3100*m4 + 1520*m5 as r11, 3100*m7 + 1520*m8 as r12,
       m2 as r20, m5 as r21, m8 as r22 from m),
    g as (select *, r00/3100 as h00, r01/3100 as h01, r02 - r00*2028/3100 - r01*1520/3100 as h02,
       r10/3100 as h10, r11/3100 as h11, r12 - r10*2028/3100 - r11*1520/3100 as h12,
       r20/3100 as h20, r21/3100 as h21, r22 - r20*2028/3100 - r21*1520/3100 as h22 from h)
    select mission_id, seq, {r('m0')} as m0, {r('m1')} as m1, {r('m2')} as m2, {r('m3')} as m3, {r('m5')} as m5, {r('m7')} as m7,
      {r('h00 / h22')} as h00, {r('h01 / h22')} as h01, {r('h02 / h22', 4)} as h02, {r('h12 / h22', 4)} as h12, {r('h21 / h22')} as h21,
      1.0::double as round_trip, {r('roll')} as euler_roll, {r('pitch')} as euler_pitch,
      {r('m0')} as qm0, {r('m5')} as qm5,
      {r('-(m0*1 + m3*2 + m6*3)')} as centre_x, {r('-(m1*1 + m4*2 + m7*3)')} as centre_y, {r('-(m2*1 + m5*2 + m8*3)')} as centre_z,
      {r('h00 / h22')} as rel00, {r('h02 / h22', 4)} as rel02
    from g""",
)
def rotation_functions(d):
    focal, cx, cy = lit(3100), lit(2028), lit(1520)
    identity = F.array(*[lit(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    df = d.fx_capture.withColumn("m", att.rotation_matrix(c("roll"), c("pitch"), c("yaw")))
    df = df.withColumn("q", att.q_from_euler(c("roll"), c("pitch"), c("yaw")))
    df = df.select(
        "*", att.normalization_homography(c("roll"), c("pitch"), c("yaw"), focal, cx, cy).alias("h"),
        att.mat3_mul(c("m"), att.mat3_inv(c("m"))).alias("one"),
        att.q_to_matrix(c("q")).alias("qm"),
        att.pose_centre(c("q"), F.array(lit(1), lit(2), lit(3))).alias("centre"),
        att.relative_homography(c("m"), identity, focal, cx, cy).alias("rel"),
    )
    e = att.matrix_to_euler(c("qm"))
    return rounded(
        df, ["mission_id", "seq"], m0=c("m")[0], m1=c("m")[1], m2=c("m")[2], m3=c("m")[3], m5=c("m")[5], m7=c("m")[7],
        h00=c("h")[0], h01=c("h")[1], h02=F.round(c("h")[2], 4), h12=F.round(c("h")[5], 4), h21=c("h")[7],
        round_trip=c("one")[4], euler_roll=e["roll"], euler_pitch=e["pitch"], qm0=c("qm")[0], qm5=c("qm")[5],
        centre_x=c("centre")[0], centre_y=c("centre")[1], centre_z=c("centre")[2],
        rel00=c("rel")[0], rel02=F.round(c("rel")[2], 4),
    )


@query(
    "vector_functions",
    ["fx_imu"],
    f"""select mission_id, seq, {r('degrees(atan2(ay, az))')} as tilt_roll, {r('degrees(atan2(-ax, sqrt(ay*ay + az*az)))')} as tilt_pitch,
      {r('sqrt(ax*ax + ay*ay + az*az) / 9.80665')} as accel_g, {r('sqrt(mx*mx + my*my + mz*mz)')} as mag_norm,
      {r('-sin(gy)*ax + sin(gx)*cos(gy)*ay + cos(gx)*cos(gy)*az')} as down,
      {r('atan(gx * az / 9.81)')} as bank, {r('9.81 * tan(gx) / az')} as turn,
      {r('ax*mx + ay*my + az*mz')} as dot, {r('ay*mz - az*my')} as cross_x, {r('az*mx - ax*mz')} as cross_y, {r('ax*my - ay*mx')} as cross_z,
      {r('ax*cos(radians(30)) - ay*sin(radians(30))')} as turned_x, {r('ay*cos(radians(30)) + ax*sin(radians(30))')} as turned_y, {r('az')} as turned_z
    from fx_imu""",
)
def vector_functions(d):
    a, m = F.array("ax", "ay", "az"), F.array("mx", "my", "mz")
    tilt = att.tilt_from_accel(c("ax"), c("ay"), c("az"))
    cross = att.v_cross(a, m)
    turned = att.v_rotate(a, F.array(lit(0), lit(0), lit(1)), lit(30))
    return rounded(
        d.fx_imu, ["mission_id", "seq"], tilt_roll=tilt["roll"], tilt_pitch=tilt["pitch"],
        accel_g=att.accel_g(c("ax"), c("ay"), c("az")), mag_norm=att.vector_norm(c("mx"), c("my"), c("mz")),
        down=att.earth_down_accel(c("gx"), c("gy"), c("ax"), c("ay"), c("az")),
        bank=att.turn_rate_to_bank(c("gx"), c("az")), turn=att.bank_to_turn_rate(c("gx"), c("az")),
        dot=att.v_dot(a, m), cross_x=cross[0], cross_y=cross[1], cross_z=cross[2],
        turned_x=turned[0], turned_y=turned[1], turned_z=turned[2],
    )


@query(
    "pressure_functions",
    ["fx_capture"],
    f"""with p as (select *, 1013.25 * pow(1 - gps_altitude / 44330.0, 5.255) as hpa from fx_capture)
    select mission_id, seq, {r('hpa')} as hpa, {r('44330.0 * (1 - pow(hpa / 1000.0, 1 / 5.255))')} as altitude,
      {r('hpa / pow(1 - gps_altitude / 44330.0, 5.255)')} as sea_level,
      {r('case when hpa + event_id % 500 <= 1200 then 44330.0 * (1 - pow((hpa + event_id % 500) / 1000.0, 1 / 5.255)) end')} as checked
    from p""",
)
def pressure_functions(d):
    df = d.fx_capture.withColumn("hpa", pressure.pressure_from_altitude(c("gps_altitude")))
    return rounded(
        df, ["mission_id", "seq"], hpa=c("hpa"), altitude=pressure.altitude_from_pressure(c("hpa"), lit(1000)),
        sea_level=pressure.sea_level_pressure(c("hpa"), c("gps_altitude")),
        checked=pressure.altitude_from_pressure(c("hpa") + c("event_id") % 500, lit(1000)),
    )


@query(
    "number_functions",
    ["fx_capture"],
    f"""select mission_id, seq, {r('least(1, greatest(0, roll / 10))')} as unit, {r('least(5, greatest(-5, roll))')} as held,
      {r('case when abs(roll) < 3 then 0 else roll end')} as quiet,
      {r('case when event_id % 7 = 0 then 1.5 when event_id % 5 = 0 then 1.5 else gps_altitude end')} as tolerant,
      {r('40 + (yaw - min(yaw) over (partition by mission_id)) / greatest(max(yaw) over (partition by mission_id) - min(yaw) over (partition by mission_id), 1e-9) * 1120')} as scaled
    from fx_capture""",
)
def number_functions(d):
    from flightloom.operators.timeline import Whole, scan

    df = scan(
        d.fx_capture, ["mission_id"], ["t", "seq"],
        [Whole("low", c("yaw"), "min"), Whole("high", c("yaw"), "max")], 3600.0,
    )
    text = F.when(c("event_id") % 7 == 0, F.lit("n/a")).when(c("event_id") % 5 != 0, c("gps_altitude").cast("string"))
    return rounded(
        df, ["mission_id", "seq"], unit=values.clamp01(c("roll") / 10), held=values.clamp(c("roll"), -5.0, 5.0),
        quiet=values.deadband(c("roll"), 3.0), tolerant=values.num(text, 1.5),
        scaled=values.minmax_scale(c("yaw"), c("low"), c("high"), 40.0, 1160.0),
    )


@query(
    "text_functions",
    ["fx_capture"],
    """select mission_id, seq,
      'mission_' || cast(mission_id as varchar) as log_mission, image_name as base,
      cast(seq as bigint) as number, cast(null as bigint) as no_number,
      'a;b' as joined, cast(2 as integer) as split_size, '&lt;' || image_name || ' &amp; &gt;' as escaped,
      case when event_id % 3 = 0 then 'BOOST' end as phase,
      sha256(image_name || chr(31) || cast(seq as varchar)) as sig
    from fx_capture""",
)
def text_functions(d):
    m = c("mission_id").cast("string")
    path = F.concat(F.lit("/data/logs/flight_log_"), m, F.lit(".csv"))
    word = F.when(c("event_id") % 3 == 0, "boost").otherwise("elsewhere")
    joined = values.flags_join(F.array(F.lit("a"), F.lit("b")))
    return d.fx_capture.select(
        "mission_id", "seq", values.mission_id(path).alias("log_mission"),
        values.basename(F.concat(F.lit("C:\\shots/"), c("image_name"))).alias("base"),
        values.trailing_number(F.concat(F.lit("7_"), c("image_name"))).alias("number"),
        values.trailing_number(F.lit("none.jpg")).alias("no_number"),
        joined.alias("joined"), F.size(values.flags_split(joined)).alias("split_size"),
        values.xml_escape(F.concat(F.lit("<"), c("image_name"), F.lit(" & >"))).alias("escaped"),
        values.enum_parse(word, ("BOOST", "COAST")).alias("phase"),
        values.signature(c("image_name"), c("seq")).alias("sig"),
    )


@query(
    "time_functions",
    ["fx_base"],
    """select mission_id, seq, strftime(ts, '%Y%m%d_%H%M%S') as slug, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp,
      cast(floor(epoch_us(ts) / 1000000) as double) as exif_colon, cast(floor(epoch_us(ts) / 1000000) as double) as exif_dash,
      cast(null as double) as exif_bad,
      round(epoch_us(ts) / 1000000.0, 6) as epoch, epoch_us(ts) as back_us,
      round((5000000 * seq - 1500000) / 1000000.0, 6) as age,
      (epoch_us(ts) - min(epoch_us(ts)) over (partition by mission_id)) / 1000000.0::double as mission_time
    from fx_base""",
)
def time_functions(d):
    from flightloom.operators.timeline import FirstOf, scan

    seconds = values.epoch_seconds(c("ts"))
    df = scan(
        d.fx_base.withColumn("seconds", seconds), ["mission_id"], ["seconds", "event_id"],
        [FirstOf("start", F.unix_micros(c("ts").cast("timestamp")))], 86400.0,
    )
    colon, dash = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return df.select(
        "mission_id", "seq", values.time_slug(c("ts")).alias("slug"), values.utc_stamp(c("ts")).alias("stamp"),
        values.exif_time(colon).alias("exif_colon"), values.exif_time(dash).alias("exif_dash"),
        values.exif_time(F.concat(F.lit("x"), dash)).alias("exif_bad"),
        F.round("seconds", 6).alias("epoch"), F.unix_micros(values.to_timestamp(c("seconds"))).alias("back_us"),
        F.round(values.age_ms(c("seq") * 5000000, F.lit(1500000)), 6).alias("age"),
        ((F.unix_micros(c("ts").cast("timestamp")) - c("start")) / 1e6).alias("mission_time"),
    )


@query(
    "nested_functions",
    ["fx_imu"],
    f"""select mission_id, seq, seq % 3 <> 0 as vec_ok, {r('gx - 0.5')} as less_x, {r('degrees(gz)')} as deg_z,
      cast(seq as varchar) as looked_up, 'none' as missing, cast(5 as integer) as ring_size, {r('ax')} as ring_last
    from fx_imu""",
)
def nested_functions(d):
    vec = F.when(c("seq") % 3 == 0, F.array("gx", "gy")).otherwise(F.array("gx", "gy", "gz"))
    g = F.array("gx", "gy", "gz")
    ring = values.close_ring(F.array("ax", "ay", "az", "mx"))
    info = values.details(seq=c("seq"), ax=c("ax"))
    return d.fx_imu.select(
        "mission_id", "seq", values.vec3(vec).isNotNull().alias("vec_ok"),
        F.round(values.subtract(g, F.array(lit(0.5), lit(0), lit(0)))[0], 6).alias("less_x"),
        F.round(values.to_degrees(g)[2], 6).alias("deg_z"),
        values.lookup(info, "seq", "none").alias("looked_up"), values.lookup(info, "zz", "none").alias("missing"),
        F.size(ring).alias("ring_size"), F.round(F.element_at(ring, -1), 6).alias("ring_last"),
    )


@query(
    "sql_functions",
    ["fx_capture"],
    f"""select mission_id, seq, {r(haversine('18.5204::double', '73.8567::double', 'latitude', 'longitude'), 4)} as far,
      {r(wrap('yaw - 90'))} as turned, {r('abs(' + wrap('roll * 10 - yaw + 180') + ' - 180)')} as delta, {r('2 * greatest(gps_altitude, 2) * tan(radians(62.2) / 2)')} as width,
      {r('44330.0 * (1 - pow((gps_altitude + 900) / 1000.0, 1 / 5.255))')} as height, cast(seq as bigint) as number, {r('sqrt(roll * roll + pitch * pitch + 1) / 9.80665')} as g
    from fx_capture""",
)
def sql_functions(d):
    from flightloom.functions.sql import register_sql_functions

    register_sql_functions(d.spark)
    return d.spark.sql(
        """select mission_id, seq, round(haversine_m(18.5204D, 73.8567D, latitude, longitude), 4) as far, round(wrap_360(yaw - 90D), 6) as turned,
          round(angle_delta(yaw, roll * 10D), 6) as delta, round(footprint_width_m(gps_altitude), 6) as width,
          round(altitude_from_pressure(gps_altitude + 900D, 1000D), 6) as height, trailing_number(image_name) as number, round(accel_g(roll, pitch, 1D), 6) as g
        from {caps}""",
        caps=d.fx_capture,
    )


def _corner(i, east, north):
    e, n = f"({east} * w / 2)", f"({north} * h / 2)"
    return f"{e} * cos(radians(yaw)) + {n} * sin(radians(yaw)) as e{i}, {n} * cos(radians(yaw)) - {e} * sin(radians(yaw)) as n{i}"


def _crossed(i, j):
    return f"(case when (n{i} > y) <> (n{j} > y) and x < (e{j} - e{i}) * (y - n{i}) / nullif(n{j} - n{i}, 0) + e{i} then 1 else 0 end)"


@query(
    "points_in_footprints",
    ["fx_capture"],
    f"""with s as (select mission_id, seq, yaw, roll * 4 as x, pitch * 4 as y, 2 * greatest(gps_altitude, 2) * tan(radians(62.2) / 2) as w,
      2 * greatest(gps_altitude, 2) * tan(radians(48.8) / 2) as h from fx_capture),
    q as (select *, {_corner(1, -1, 1)}, {_corner(2, 1, 1)}, {_corner(3, 1, -1)}, {_corner(4, -1, -1)} from s)
    select mission_id, seq, ({_crossed(1, 4)} + {_crossed(2, 1)} + {_crossed(3, 2)} + {_crossed(4, 3)}) % 2 = 1 as seen,
      {r('greatest(e1, e2, e3, e4) - least(e1, e2, e3, e4)')} as wide, {r('w * h')} as area from q""",
)
def points_in_footprints(d):
    """Whether a ground point beside the camera lies in the image's footprint, by SQL functions alone."""
    from flightloom.functions.sql import register_sql_functions

    register_sql_functions(d.spark)
    return d.spark.sql(
        """with s as (select mission_id, seq, roll * 4D as x, pitch * 4D as y, footprint_size(gps_altitude) as size, yaw from {caps}),
          q as (select *, corners_local(0D, 0D, size, yaw) as corners from s)
        select mission_id, seq, point_in_quad(x, y, corners) as seen,
          round(polygon_bounds(corners).max_e - polygon_bounds(corners).min_e, 6) as wide, round(area_m2(size), 6) as area from q""",
        caps=d.fx_capture,
    )
