"""Column layouts of the files and messages. Names, order, types and decimals."""

from __future__ import annotations

# Mission log: name and how it is written. A digit is that many decimals, i an integer, b a flag as 0 or 1,
# s text, f a plain number. The names are in the order of the file.
LOG_LAYOUT = """
timestamp:3 mission_time:3 state:s latitude:6 longitude:6 gps_altitude:2 baro_altitude:2 vertical_velocity:2
max_altitude:2 roll:2 pitch:2 yaw:2 gyro_x:3 gyro_y:3 gyro_z:3 image_name:s image_timestamp:3 battery:1 status:s
ahrs_enabled:b ahrs_source:s ahrs_valid:b ahrs_healthy:b ahrs_confidence:s quat_w:8 quat_x:8 quat_y:8 quat_z:8
ahrs_roll:2 ahrs_pitch:2 ahrs_yaw:2 attitude_accuracy_rad:6 imu_sample_age_ms:2 accel_correction_active:b
mag_correction_active:b ahrs_timestamp_ns:i raw_gyro_x:6 raw_gyro_y:6 raw_gyro_z:6 raw_accel_x:4 raw_accel_y:4
raw_accel_z:4 raw_mag_x:4 raw_mag_y:4 raw_mag_z:4 raw_quat_w:8 raw_quat_x:8 raw_quat_y:8 raw_quat_z:8
raw_imu_timestamp_ns:i raw_imu_accuracy_rad:6 raw_imu_calibration_status:i raw_baro_pressure_hpa:4
raw_baro_temperature_c:4 gimbal_x_deflection_deg:3 gimbal_y_deflection_deg:3 gimbal_stepper_angle_deg:3
gimbal_servo_angle_deg:3 gimbal_stepper_steps:i gimbal_ok:b launch_detected:b apogee_detected:b payload_ejected:b
glider_deployed:b actuation_enabled:b previous_state:s state_transition_reason:s telemetry_sequence:i
telemetry_tx_count:i bus_voltage_v:3 current_a:3 power_w:3 min_voltage_v:3 max_current_a:3 undervoltage_events:i
logger_rows_written:i logger_errors:i camera_capture_sequence:i camera_total_captures:i
camera_successful_captures:i camera_failed_captures:i camera_dropped_captures:i camera_last_file_size_bytes:i
camera_last_write_latency_ms:3 image_sync_imu_delta_ms:3 image_sync_gps_delta_ms:3 image_sync_baro_delta_ms:3
image_quality_sharpness:3 image_quality_brightness:3 image_quality_underexposed_fraction:5
image_quality_overexposed_fraction:5 image_quality_status:s images_referenced:i images_present:i images_missing:i
images_orphan:i gps_ground_speed_mps:3 gps_course_deg:3 gps_satellites:i gps_hdop:3 gps_fix_type:s
gps_timestamp_ns:i baro_timestamp_ns:i nav_timestamp_ns:i nav_origin_latitude:8 nav_origin_longitude:8
estimated_latitude:8 estimated_longitude:8 estimated_north_m:3 estimated_east_m:3 estimated_altitude_m:3
estimated_agl_m:3 estimated_velocity_north_mps:3 estimated_velocity_east_mps:3 estimated_ground_speed_mps:3
estimated_course_deg:3 estimated_heading_deg:3 navigation_mode:s position_quality:s heading_quality:s
altitude_quality:s position_source:s nav_gps_valid:b nav_gps_rejected:b nav_gps_rejection_reason:s
nav_gps_age_ms:3 nav_gps_position_error_m:3 dead_reckoning_active:b dead_reckoning_age_s:3 recovery_active:b
navigation_valid:b safe_for_guidance:b nav_consecutive_good_gps:i nav_consecutive_bad_gps:i
estimator_reset_count:i nav_last_event:s servo_left:f servo_right:f servo_drogue:f heading_cmd:f roll_cmd:f
pitch_cmd:f
"""
LOG_COLUMNS = {name: kind for name, kind in (part.split(":") for part in LOG_LAYOUT.split())}

DATASET_COLUMNS = (
    "timestamp mission_time state latitude longitude gps_altitude baro_altitude roll pitch yaw gyro_x gyro_y gyro_z "
    "image_name image_timestamp battery status"
).split()

# Radio packet: key, source column, decimals (None for values passed on as they are), type.
PACKET = (
    ("seq", "telemetry_sequence", None, "bigint"), ("state", "state", None, "string"),
    ("prev", "previous_state", None, "string"), ("reason", "state_transition_reason", None, "string"),
    ("lat", "latitude", 6, "double"), ("lon", "longitude", 6, "double"), ("alt", "baro_altitude", 1, "double"),
    ("vel", "vertical_velocity", 1, "double"), ("max_alt", "max_altitude", 1, "double"),
    ("img", "image_name", None, "string"), ("eject", "payload_ejected", None, "boolean"),
    ("glider", "glider_deployed", None, "boolean"), ("act", "actuation_enabled", None, "boolean"),
    ("gps", "gps_ok", None, "boolean"), ("nq", "navigation_mode", None, "string"),
    ("nlat", "estimated_latitude", 6, "double"), ("nlon", "estimated_longitude", 6, "double"),
    ("nalt", "estimated_altitude_m", 1, "double"), ("nhdg", "estimated_heading_deg", 1, "double"),
    ("ncog", "estimated_course_deg", 1, "double"), ("ngs", "estimated_ground_speed_mps", 1, "double"),
    ("ngps", "nav_gps_valid", None, "boolean"), ("safe", "safe_for_guidance", None, "boolean"),
    ("cam", "camera_ok", None, "boolean"), ("imu", "imu_ok", None, "boolean"), ("ahrs", "ahrs_healthy", None, "boolean"),
    ("src", "ahrs_source", None, "string"), ("r", "roll", 1, "double"), ("p", "pitch", 1, "double"), ("y", "yaw", 1, "double"),
    ("battery", "battery", 1, "double"), ("vbat", "bus_voltage_v", 2, "double"), ("amps", "current_a", 2, "double"),
    ("tx", "telemetry_tx_count", None, "bigint"), ("log_rows", "logger_rows_written", None, "bigint"),
    ("cam_seq", "camera_capture_sequence", None, "bigint"), ("cam_fail", "camera_failed_captures", None, "bigint"),
    ("status", "status", None, "string"), ("t", "mission_time", 2, "double"),
)
PACKET_SCHEMA = ", ".join(f"{key} {kind}" for key, _, _, kind in PACKET)

BENCH_SCHEMA = (
    "t double, ts string, ax double, ay double, az double, gx double, gy double, gz double, mx double, my double, "
    "mz double, qx double, qy double, qz double, qw double, lx double, ly double, lz double, alt double, "
    "press double, temp double"
)

POSE_SCHEMA = (
    "filename string, camera_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, "
    "center_x double, center_y double, center_z double"
)

CALIBRATION_SCHEMA = (
    "created_at_unix double, sample_count struct<imu: bigint, barometer: bigint, magnetometer: bigint>, "
    "imu struct<gyro_bias_rads: array<double>, gyro_bias_dps: array<double>, accel_level_mps2: array<double>, "
    "accel_level_norm_mps2: double, mag_min_ut: array<double>, mag_max_ut: array<double>, mag_offset_ut: array<double>, "
    "last_bno_calibration_status: bigint>, barometer struct<ground_altitude_m: double, pressure_mean_hpa: double, "
    "temperature_mean_c: double, sea_level_pressure_hpa: double>"
)


def log_type(kind: str) -> str:
    return {"s": "string", "i": "bigint", "b": "boolean"}.get(kind, "double")
