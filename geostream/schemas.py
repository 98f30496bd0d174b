"""Schemas of the tables as DDL; no source infers one."""

STATIONS = "station_code string, name string, lat double, lon double, elevation double, agency string, status string, date_installed date, fault_segment string, host string, port int, threshold_mm_s double, filter struct<enabled: boolean, decay: double>, metadata map<string, string>"
VELOCITIES = "time timestamp, station_code string, v_east double, v_north double, v_up double, v_horizontal double, quality double"
DISPLACEMENTS = "time timestamp, station_code string, d_east double, d_north double, d_up double, d_horizontal double, overall_completeness double, quality double, displacement_source string"
EVENTS = "station_code string, detection_time timestamp, peak_velocity_horizontal double, peak_displacement_horizontal double, duration_seconds double"
INGESTION_LOG = "file_hash string, filename string, filepath string, station_code string, status string, seq long, error_message string, qc_obs_count int, qc_cycle_slips int, qc_mp1_rms double, qc_mp2_rms double"
PROCESSING_STATUS = "station_code string, processing_year int, status string, available_days array<struct<lo: int, hi: int>>, staff_assigned string, notes string, updated_at timestamp"
CATALOG = "path string, name string, extension string, category string, size_bytes long, size_mb double, modified timestamp, parent_dir string, depth int, in_archive boolean, archive_path string, corrupt_reason string"
PROFILE = "sites string, Ecoord double, Ncoord double, height double, velocity double, azimuth double, Vu double, hgt double, erreast double, errnorth double"
GRID = "East double, Depth double, Width double, Dip double, Residual double, Rate double, Slip double, `Reduced chi2` double, Chi2 double"
KIN_SERIES = "time timestamp, east double, north double, up double"
TOD_SERIES = "clock string, east double, north double, up double"
