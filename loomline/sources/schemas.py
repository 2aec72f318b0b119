"""Explicit schemas, as DDL text, of every relation that is read from outside; nothing is inferred."""

from __future__ import annotations

PLAYLISTS = "id string, name string, description string, owner string, public boolean, track_count int, playlist_url string"
TRACKS = (
    "playlist_id string, playlist_name string, track_id string, track_name string, artist_names string, album_name string, duration_ms bigint, explicit boolean, popularity int, "
    "added_at string, added_by string, spotify_url string, track_number int, disc_number int, is_local boolean"
)
MANIFEST = (
    "track_id string, track_name string, artist_names string, album_name string, duration_ms bigint, explicit boolean, popularity int, playlist_names string, playlist_ids string, "
    "playlist_count int, spotify_url string"
)
CATALOG = "path string, artist string, albumartist string, album string, title string, track int, length double"
RANKED_ALBUMS = "rank int, title string, artist string, year string, album_id string, spotify_url string"
LIBRARY = "artist string, albumartist string, album string, track string, title string, year string, path string"
UNMATCHED = ["playlist_name", "track_id", "track_name", "artist_names", "album_name", "tier_tried", "spotify_url"]
RETRY_REPORT = ["artist", "track", "album", "reason", "spotify_url", "search"]


def names(ddl: str) -> list[str]:
    """The column names of a schema."""
    return [part.split()[0] for part in ddl.split(",")]
