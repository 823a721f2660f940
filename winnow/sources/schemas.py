"""Tables of the media library, and their additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "users": "id string, username string, password_hash string, role string, status string, created_at timestamp, updated_at timestamp",
    "trips": "id string, title string, description string, cover_image_id string, visibility string, user_id string, created_at timestamp, updated_at timestamp",
    "media_items": (
        "id string, trip_id string, file_path string, thumbnail_path string, media_type string, mime_type string, original_filename string, file_size long, "
        "width int, height int, perceptual_hash string, quality_score double, sharpness_score double, duplicate_group_id string, created_at timestamp, status string, "
        "trashed_reason string, processing_error string, processing_status string, optimized_path string, compiled_path string, user_id string, visibility string, "
        "blur_status string, exposure_score double, contrast_score double, noise_score double, phash string, avg_brightness double, contrast_level double, "
        "color_cast_r double, color_cast_g double, color_cast_b double, noise_level double, category string, upload_id string, upload_mode string, storage_key string, "
        "video_duration double, video_width int, video_height int, video_codec string, video_bitrate long, preview_proxy_path string, edit_proxy_path string"
    ),
    "duplicate_groups": "id string, trip_id string, default_image_id string, image_count long, created_at timestamp",
    "media_tags": "id string, media_id string, tag_name string, created_at timestamp",
    "processing_jobs": "id string, trip_id string, status string, current_step string, percent int, processed long, total long, error_message string, result_json string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "processing_job_events": "id long, job_id string, seq long, level string, step string, message string, processed long, total long, created_at timestamp",
    "upload_sessions": "id string, media_id string, trip_id string, storage_key string, mode string, status string, total_parts int, part_size long, file_size long, created_at timestamp, updated_at timestamp",
    "video_segments": "id string, media_id string, segment_index int, start_time double, end_time double, duration double, sharpness_score double, stability_score double, exposure_score double, overall_score double, label string, selected boolean, created_at timestamp",
}

#: Values of columns that existing rows get when the column is added.
DEFAULTS = {"status": "active", "processing_status": "none", "visibility": "public", "role": "regular", "level": "info"}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Creates the tables that aren't there, as Parquet."""
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def evolve(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of the table that it lacks, null or by default; its own stay as they are."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in schema(table) if f.name.lower() not in have})
