"""Nested API pages: their schema, and from pages to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordering import first_seen

_NAMES = "array<struct<name:string>>"
TRACK = (
    f"struct<id:string,name:string,artists:{_NAMES},album:struct<name:string>,duration_ms:bigint,explicit:boolean,popularity:int,"
    "track_number:int,disc_number:int,is_local:boolean,external_urls:struct<spotify:string>>"
)
#: ``seq`` is the place of an item over all pages; sources without it get null.
PAGE = f"struct<playlist_id:string,playlist_name:string,items:array<struct<track:{TRACK},added_at:string,added_by:struct<id:string>,seq:bigint>>,next:string>"
ALBUM_ITEMS = f"array<struct<id:string,name:string,artists:{_NAMES},duration_ms:bigint,explicit:boolean,popularity:int,external_urls:struct<spotify:string>>>"
ALBUM_PAGE = f"struct<name:string,tracks:struct<items:{ALBUM_ITEMS},next:string>,items:{ALBUM_ITEMS},next:string>"
PLAYLIST_PAGE = "struct<items:array<struct<id:string,name:string,description:string,owner:struct<id:string,display_name:string>,public:boolean,tracks:struct<total:int>,external_urls:struct<spotify:string>>>,next:string>"
RANKED = "ranking int, album string, artist string, year string, albumID string"
# Items of a page, and what saved tracks carry instead of a playlist.
PAGE_ITEMS, PLAYLISTS_OF_A_PAGE = 100, 50
SAVED_ID, SAVED_NAME = "liked_songs", "Liked Songs"


def parsed(pages: DataFrame, column: str, schema: str) -> DataFrame:
    """``pages`` with the JSON text in ``column`` as a structure ``page``; text that is no JSON gives null."""
    return pages.withColumn("page", F.from_json(column, schema))


def artist_names(artists: Column) -> Column:
    """Names joined by ', '; '' without any."""
    return F.coalesce(F.array_join(F.transform(artists, lambda a: F.coalesce(a["name"], F.lit(""))), ", "), F.lit(""))


def _items(pages: DataFrame, column: str, playlist_id: Column, playlist_name: Column) -> DataFrame:
    items = parsed(pages, column, PAGE).select(playlist_id.alias("playlist_id"), playlist_name.alias("playlist_name"), F.explode("page.items").alias("i")).filter("i.track is not null")
    t = lambda c: T.text(F.col(f"i.track.{c}"))
    return items.select(
        F.col("i.seq").alias("seq"), "playlist_id", "playlist_name", t("id").alias("track_id"), t("name").alias("track_name"), artist_names(F.col("i.track.artists")).alias("artist_names"),
        t("album.name").alias("album_name"), "i.track.duration_ms", "i.track.explicit", "i.track.popularity", T.text(F.col("i.added_at")).alias("added_at"), F.col("i.added_by.id").alias("added_by"),
        t("external_urls.spotify").alias("spotify_url"), "i.track.track_number", "i.track.disc_number", "i.track.is_local",
    )


def flatten_tracks(pages: DataFrame, column: str = "json") -> DataFrame:
    """Flat track rows of playlist pages; items without a track are dropped."""
    return _items(pages, column, F.col("page.playlist_id"), F.col("page.playlist_name"))


def flatten_saved(pages: DataFrame, column: str = "json") -> DataFrame:
    """Flat track rows of the pages of saved tracks, which all carry one constant playlist."""
    return _items(pages, column, F.lit(SAVED_ID), F.lit(SAVED_NAME))


def with_saved(tracks: DataFrame, saved: DataFrame, seq: str = "seq") -> DataFrame:
    """Playlist rows and behind them the saved ones; their ``seq`` goes on where that of the others ends."""
    last = tracks.agg(F.coalesce(F.max(seq), F.lit(0)).alias("last")).scalar()
    return tracks.unionByName(saved.withColumn(seq, last + 1 + F.col(seq)))


def flatten_playlists(pages: DataFrame, column: str = "json", owner: str | Column | None = None) -> DataFrame:
    """Flat playlist rows; with ``owner`` only those of that owner id."""
    items = parsed(pages, column, PLAYLIST_PAGE).select(F.explode("page.items").alias("p")).filter("p is not null")
    rows = items if owner is None else items.filter(F.col("p.owner.id") == owner)
    return rows.select(
        T.text(F.col("p.id")).alias("id"), T.text(F.col("p.name")).alias("name"), T.text(F.col("p.description")).alias("description"), T.text(F.col("p.owner.display_name")).alias("owner"),
        "p.public", F.col("p.tracks.total").alias("track_count"), T.text(F.col("p.external_urls.spotify")).alias("playlist_url"),
    )


def flatten_album_tracks(pages: DataFrame, column: str, album: str, page_no: str) -> DataFrame:
    """Manifest rows of album pages, with ``album``, ``page_no`` and ``pos`` in front.

    The first page names the album and has its items below ``tracks``, later ones have them
    on top. Items carry no playlists; without a link they are dropped.
    """
    named = parsed(pages, column, ALBUM_PAGE).withColumn("album_name", T.text(F.first("page.name", ignorenulls=True).over(W.partitionBy(album).orderBy(page_no).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    both = named.select(F.col(album).alias("album"), F.col(page_no).alias("page_no"), "album_name", F.posexplode(F.coalesce("page.tracks.items", "page.items")).alias("pos", "i")).filter("i is not null")
    return both.select(
        "album", "page_no", "pos", T.text(F.col("i.id")).alias("track_id"), T.text(F.col("i.name")).alias("track_name"), artist_names(F.col("i.artists")).alias("artist_names"), "album_name",
        F.coalesce("i.duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("i.explicit", F.lit(False)).alias("explicit"), F.coalesce("i.popularity", F.lit(0)).alias("popularity"),
        F.lit("").alias("playlist_names"), F.lit("").alias("playlist_ids"), F.lit(0).alias("playlist_count"), T.text(F.col("i.external_urls.spotify")).alias("spotify_url"),
    ).filter("spotify_url <> ''")


def expand_albums(albums: DataFrame, pages: DataFrame, column: str = "json", page_no: str = "page_no") -> DataFrame:
    """The tracks of ranked albums (rank, spotify_url), the first of equal links by rank and place.

    ``pages`` has the album id in ``album``; albums whose link holds no id have no tracks.
    ``place`` orders the result.
    """
    wanted = albums.select("rank", T.album_id_of(F.col("spotify_url")).alias("album")).filter("album <> ''")
    tracks = flatten_album_tracks(pages, column, "album", page_no).join(wanted, "album")
    return first_seen(tracks.withColumn("place", F.struct("rank", "page_no", "pos")).drop("album", "rank", "page_no", "pos"), ["spotify_url"], "place")


def top_ranked(documents: DataFrame, limit: int = 200) -> DataFrame:
    """(rank, title, artist, year, album_id, spotify_url) of the first ``limit`` landed album documents by ranking; no links yet."""
    best = documents.orderBy("ranking", "albumID").limit(limit)
    return best.select(
        F.coalesce("ranking", F.lit(0)).alias("rank"), T.text(F.col("album")).alias("title"), T.text(F.col("artist")).alias("artist"), T.text(F.col("year")).alias("year"),
        T.text(F.col("albumID")).alias("album_id"), F.lit("").alias("spotify_url"),
    )


def as_pages(tracks: DataFrame, columns: tuple[str, ...] = ("playlist_id", "playlist_name")) -> DataFrame:
    """(json): track rows as nested pages of at most PAGE_ITEMS items (by ranges of ``seq``).

    Artist lists are split at ', '; a row without a track name is an item without a track.
    """
    track = F.struct(
        F.col("track_id").alias("id"), F.col("track_name").alias("name"), F.transform(F.split("artist_names", ", "), lambda a: F.struct(a.alias("name"))).alias("artists"),
        F.struct(F.col("album_name").alias("name")).alias("album"), "duration_ms", "explicit", "popularity", "track_number", "disc_number", "is_local",
        F.struct(F.col("spotify_url").alias("spotify")).alias("external_urls"),
    )
    item = F.struct(F.when(F.col("track_name").isNotNull(), track).alias("track"), "added_at", F.struct(F.col("added_by").alias("id")).alias("added_by"), "seq")
    paged = tracks.groupBy(*columns, F.floor(F.col("seq") / PAGE_ITEMS).alias("page_no")).agg(F.collect_list(item).alias("items"))
    return paged.select(F.to_json(F.struct(*columns, "items")).alias("json"))


def playlists_as_pages(playlists: DataFrame, order: str) -> DataFrame:
    """(json): playlist rows as nested pages (by ranges of ``order``); the display name is the owner's id as well."""
    one = F.struct(
        "id", "name", "description", F.struct(F.col("owner").alias("id"), F.col("owner").alias("display_name")).alias("owner"), "public", F.struct(F.col("track_count").alias("total")).alias("tracks"),
        F.struct(F.col("playlist_url").alias("spotify")).alias("external_urls"),
    )
    return playlists.groupBy(F.floor(F.col(order) / PLAYLISTS_OF_A_PAGE).alias("page_no")).agg(F.collect_list(one).alias("items")).select(F.to_json(F.struct("items")).alias("json"))


def albums_as_pages(tracks: DataFrame, album: str, name: str, pos: str) -> DataFrame:
    """(album, page_no, json): tracks as album pages, the first with the album's name and its items below ``tracks``."""
    item = F.struct(
        F.col("track_id").alias("id"), F.col("track_name").alias("name"), F.transform(F.split("artist_names", ", "), lambda a: F.struct(a.alias("name"))).alias("artists"), "duration_ms", "explicit",
        F.struct(F.col("spotify_url").alias("spotify")).alias("external_urls"),
    )
    placed = tracks.withColumn("page_no", F.floor((F.col(pos) - 1) / PLAYLISTS_OF_A_PAGE))
    listed = placed.groupBy(F.col(album).alias("album"), "page_no").agg(F.max(name).alias("name"), F.transform(F.array_sort(F.collect_list(F.struct(pos, item.alias("item")))), lambda x: x["item"]).alias("items"))
    first = F.to_json(F.struct("name", F.struct("items").alias("tracks")))
    return listed.select("album", "page_no", F.when(F.col("page_no") == 0, first).otherwise(F.to_json(F.struct("items"))).alias("json"))
