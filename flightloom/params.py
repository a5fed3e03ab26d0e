"""Thresholds and limits that results depend on. Every operator takes them as arguments."""

from __future__ import annotations

# geodesy and mapping
EARTH_RADIUS_M = 6_371_000.0
HFOV_DEG = 62.2
VFOV_DEG = 48.8
MIN_FOOTPRINT_ALT_M = 2.0
COVERAGE_GRID_M = 5.0
SPATIAL_GRID_M = 120.0
MAX_DISTANCE_M = 250.0
MAX_TIME_S = 20.0
MAX_YAW_DEG = 80.0
MAX_ALTITUDE_RATIO = 2.5
MAX_TILT_DELTA_DEG = 45.0
MIN_OVERLAP = 0.03
MAX_NEIGHBORS = 8
TEMPORAL_NEIGHBORS = 2
NEIGHBORS_BY_PROFILE = {"FAST": 5, "BALANCED": 8, "QUALITY": 12}

# camera model
SENSOR_WIDTH_PX = 4056
SENSOR_HEIGHT_PX = 3040
FOCAL_PX = 3100.0

# image quality
BLUR_MIN_VARIANCE = 80.0
EXPOSURE_LOW, EXPOSURE_HIGH = 35.0, 220.0
MAX_TILT_DEG = 35.0
MAX_RATE_DPS = 120.0
CLIPPED_SHARE = 0.15
GOOD_SCORE, MARGINAL_SCORE = 0.70, 0.40
LIVE_BLUR_VARIANCE = 80.0
LIVE_BRIGHT_LOW, LIVE_BRIGHT_HIGH = 45.0, 210.0
LIVE_CLIPPED_SHARE = 0.12

# matching
MATCH_RATIO = 0.75
MIN_MATCHES = 12
MIN_INLIERS = 10
MIN_INLIER_RATIO = 0.18
MODELS = ("ESSENTIAL", "FUNDAMENTAL", "HOMOGRAPHY")

# pressure
PRESSURE_MIN_HPA, PRESSURE_MAX_HPA = 300.0, 1200.0
SEA_LEVEL_MIN_HPA, SEA_LEVEL_MAX_HPA = 800.0, 1100.0
STANDARD_SEA_LEVEL_HPA = 1013.25

# phases of a flight, and which may follow which
PHASES = (
    "BOOT", "DISARMED", "IDLE", "ARMED_PAD", "BOOST", "COAST", "APOGEE", "DESCENT",
    "DESCENT_DROGUE", "GLIDER_DEPLOY", "GUIDED_DESCENT", "LANDED", "ABORT", "ERROR",
)
LEGAL_TRANSITIONS = (
    ("BOOT", "DISARMED"), ("BOOT", "IDLE"), ("BOOT", "ERROR"),
    ("DISARMED", "ARMED_PAD"), ("DISARMED", "ERROR"),
    ("IDLE", "ARMED_PAD"), ("IDLE", "ERROR"),
    ("ARMED_PAD", "DISARMED"), ("ARMED_PAD", "BOOST"), ("ARMED_PAD", "ABORT"),
    ("BOOST", "COAST"), ("BOOST", "ABORT"),
    ("COAST", "APOGEE"), ("COAST", "ABORT"),
    ("APOGEE", "DESCENT_DROGUE"), ("APOGEE", "ABORT"),
    ("DESCENT", "GLIDER_DEPLOY"), ("DESCENT", "LANDED"), ("DESCENT", "ABORT"),
    ("DESCENT_DROGUE", "GLIDER_DEPLOY"), ("DESCENT_DROGUE", "ABORT"),
    ("GLIDER_DEPLOY", "GUIDED_DESCENT"), ("GLIDER_DEPLOY", "ABORT"),
    ("GUIDED_DESCENT", "LANDED"), ("GUIDED_DESCENT", "ABORT"),
    ("ABORT", "LANDED"),
    ("ERROR", "BOOT"), ("ERROR", "DISARMED"),
)
CAPTURE_PHASES = ("APOGEE", "DESCENT", "DESCENT_DROGUE", "GLIDER_DEPLOY", "GUIDED_DESCENT")
STANDARD_GRAVITY = 9.80665
LAUNCH_ACCEL_G = 1.5
LAUNCH_ALTITUDE_M = 30.0
BURNOUT_ACCEL_G = 1.5
BOOST_MAX_S = 10.0
APOGEE_VELOCITY_MPS = -1.0
APOGEE_DROP_M = 2.0
APOGEE_MIN_ALTITUDE_M = 50.0
APOGEE_BACKUP_S = 30.0
DEPLOY_ALTITUDE_M = 600.0
SETTLE_S = 1.0
LANDING_ALTITUDE_M = 20.0
LANDING_VELOCITY_MPS = 1.0
LANDING_S = 5.0
MAX_FLIGHT_S = 600.0

# navigation
MIN_SATELLITES = 5
MAX_HDOP = 4.0
MAX_GPS_AGE_MS = 1500.0
MAX_SPEED_MPS = 120.0
MAX_JUMP_M = 250.0

# saved snapshots
SNAPSHOT_MAGIC = 0xDEAD1234
SNAPSHOT_SCHEMA = 2

# monitoring
STALE_S = 3.0
DEBOUNCE_S = 2.0
RATE_ALPHA = 0.35
MIN_DT_S, MAX_DT_S = 0.001, 0.25
UNDERVOLTAGE_V = 4.8
OVERCURRENT_A = 2.0
CPU_HOT_C = 75.0
DISK_LOW_BYTES = 500 * 1024 * 1024
HDOP_WARN = 3.0
SYNC_WARN_MS = 250.0
