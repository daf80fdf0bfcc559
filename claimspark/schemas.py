"""DDL of the stored fingerprint table. Additions are optional columns, filled with NULL on read."""

FINGERPRINTS = (
    "claim_id STRING, file_sha256 STRING, frame_index INT, phash STRING, created_at TIMESTAMP, dhash STRING, "
    "ahash STRING, color_sig STRING, motion_sig STRING, capture_timestamp STRING, gps_lat DOUBLE, gps_lon DOUBLE")
