"""Row shapes the readers produce."""

STREAM = "struct<sample_rate:bigint,channels:int,bits_per_sample:int,total_frames:bigint,audio_md5:string>"

# What one look at a file's leading bytes tells.
PROBE_FIELDS = (
    f"stream {STREAM}, encoder string, comments map<string,array<string>>, "
    "data_offset bigint, data_len bigint, reason string"
)

# A decoded document before any rule is applied.
TORRENT_FIELDS = (
    "name string, piece_length bigint, pieces binary, length bigint, "
    "files array<struct<path_parts:array<string>,length:bigint,attr:string>>, meta_version bigint, "
    "private boolean, source string, announce string, tiers array<array<string>>, comment string, "
    "created_by string, creation_date bigint, info_hash string, reason string"
)
