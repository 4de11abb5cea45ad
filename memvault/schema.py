"""Record types of a vault and the constraints on them."""

from __future__ import annotations

# fixed values: the 14 categories, in export order
CATEGORIES = (
    "fact", "decision", "instruction", "preference", "learning", "goal", "commitment",
    "artifact", "event", "relationship", "observation", "error", "context", "password",
)

MEMORIES = (
    "id string, category string, title string, content string, tags array<string>, confidence double, status string, "
    "provenance string, created_at timestamp_ntz, updated_at timestamp_ntz, expired_at timestamp_ntz"
)
LINKS = "source_id string, target_id string, relation string, weight double, created_at timestamp_ntz"
VECTORS = "id string, embedding array<float>"
ENTITIES = "memory_id string, entity_name string, entity_val string"
ATTACHMENTS = (
    "memory_id string, filename string, mime_type string, media_kind string, size_bytes long, sha256 string, "
    "dimensions string, duration_secs double, data binary"
)
HISTORY = "id long, command string, subcommand string, status string, duration_ms long, error_message string, created_at timestamp_ntz"

#: What an envelope of a backup calls itself.
BACKUP_FORMAT = "memvault-backup-v1"
#: What each line of a JSON export calls itself.
JSON_FORMAT = "memvault-json-v1"
#: What a Markdown export calls itself.
MARKDOWN_FORMAT = "memvault-markdown-v1"

#: Least and greatest weight of a link.
WEIGHTS = (0.01, 10.0)
