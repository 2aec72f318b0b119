"""The queries of the problems of this subpackage over the tables of one data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.multivalue import NAME_DELIMITERS, split_values
from ..operators.references import bare_id
from ..sources.tables import table
from . import cooccurrence, leakage, linkage, name_variants, plain_text, survivors
from .mixing import Mix
from .shared_spans import SharedSpans

TEXT_FIELDS = (("playlist_tracks", "seq", "track_name"), ("playlist_tracks", "seq", "artist_names"), ("library", "file_id", "artist"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = plain_text.not_plain(table(spark, sf_dir, "playlist_tracks"), "seq", "track_name", "artist_names")
    library = plain_text.not_plain(table(spark, sf_dir, "library"), "file_id", "artist")
    return tracks.select(F.lit("playlist_tracks").alias("tab"), "rec_id", "field").unionByName(library.select(F.lit("library").alias("tab"), "rec_id", "field"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field and plain form how many rows show it and in how many different writings."""
    parts = [
        table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col(field).alias("value")).filter(F.col(field) != "")
        for tab, _, field in TEXT_FIELDS
    ]
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tab", "field", "value").agg(F.count("*").alias("n"))
    plain = counted.select("tab", "field", "n", plain_text.plain(F.col("value")).alias("plain"))
    return plain.groupBy("tab", "field", "plain").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"))


def _track_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "playlist_tracks").select(bare_id(F.col("playlist_id")).alias("basket"), F.trim("track_id").alias("item"))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tracks with its counts, lift and odds ratio."""
    return cooccurrence.together(_track_baskets(spark, sf_dir), "basket", "item")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    often = p7_pairs(spark, sf_dir).filter(F.col("n_ab") * F.col("n_baskets") >= 3 * F.col("n_a") * F.col("n_b"))
    return often.select(F.col("item_a").alias("track_a"), F.col("item_b").alias("track_b"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its longest run of words and the share of the item in the document."""
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "eval_items"), "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents"), "doc_id").found_pairs()


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how much of it stands in others too."""
    return SharedSpans(table(spark, sf_dir, "documents"), "doc_id").coverage()


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its class of equal texts and how many other texts share a span with it."""
    return SharedSpans(table(spark, sf_dir, "documents"), "doc_id").linked()


def p10_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier document has too."""
    return SharedSpans(table(spark, sf_dir, "documents"), "doc_id").stripped()


def _first_credit(field: str) -> Column:
    """The first of the acts in a packed field. Where the field is not quoted, its commas are
    left in: whether one is part of a name is seen from the name."""
    quoted = F.ltrim(field).rlike(r'^["\[]')
    first = F.when(quoted, F.get(split_values(F.col(field), NAME_DELIMITERS), 0)).otherwise(F.get(split_values(F.col(field), "[;|]| / "), 0))
    return F.coalesce(first, field)


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track id and file of one recording with a confidence."""
    tracks = table(spark, sf_dir, "playlist_tracks").select("track_id", "track_name", "duration_ms", _first_credit("artist_names").alias("act"))
    library = table(spark, sf_dir, "library")
    return linkage.recordings(
        tracks, "track_id", "track_name", "act", "duration_ms", library, "file_id", "artist", "albumartist", "title", "path", "length"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_links(spark, sf_dir).select("track_id", "file_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every recording of the manifest."""
    manifest = table(spark, sf_dir, "spotify_manifest").withColumn("act", _first_credit("artist_names"))
    return survivors.best_records(manifest, "row_id", "track_id", "track_name", "act", "popularity", "spotify_url", "exported_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_records(spark, sf_dir).filter(F.col("n_rows") > 1).select("first_id", "keeper_id", "url_id")


def p6_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out times: how many groups whose link comes from their latest row choose the same row
    when the times of all rows without a popularity are taken away and have to be inferred."""
    manifest = table(spark, sf_dir, "spotify_manifest").withColumn("act", _first_credit("artist_names"))
    hidden = manifest.withColumn("exported_at", F.when(F.col("popularity").isNotNull(), F.col("exported_at")))
    fields = ("row_id", "track_id", "track_name", "act", "popularity", "spotify_url", "exported_at")
    true = survivors.best_records(manifest, *fields).filter("n_rows > 1 and url_id <> keeper_id").select("first_id", "url_id")
    inferred = survivors.best_records(hidden, *fields).select("first_id", F.col("url_id").alias("inferred"))
    both = true.join(inferred, "first_id")
    return both.agg(F.count("*").alias("n_groups"), F.count_if(F.col("url_id") == F.col("inferred")).alias("n_same"))


def _act_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "library")
    return library.select(F.col("artist").alias("name")).unionByName(library.select(F.col("albumartist").alias("name")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(_act_names(spark, sf_dir), "name")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of a single act with the act's cluster."""
    return name_variants.act_clusters(_act_names(spark, sf_dir), "name")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself: one row per slot, with the tokens of its block."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).mixed()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and real share of every source in that mix."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), counts_only=True).shares()


QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p6_found": p6_found, "p6_records": p6_records, "p6_undated": p6_undated, "p3_found": p3_found, "p3_clusters": p3_clusters, "p9_mix": p9_mix, "p9_shares": p9_shares, "p1_found": p1_found, "p1_forms": p1_forms, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_found": p8_found, "p8_report": p8_report, "p10_found": p10_found, "p10_coverage": p10_coverage, "p10_stripped": p10_stripped, "p10_links": p10_links}

#: A playlist reference as a bare id, in SQL.
_TEXT = r"regexp_replace(coalesce(playlist_id, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_ID = r"'^(?:.*[/:])?([^/:?#\s]+)/?(?:[?#].*)?$'"
_P7 = f"""WITH d AS (SELECT DISTINCT CASE WHEN regexp_extract({_TEXT}, {_ID}, 1) <> '' THEN regexp_extract({_TEXT}, {_ID}, 1) ELSE {_TEXT} END AS basket,
  trim(track_id) AS item FROM playlist_tracks WHERE trim(coalesce(track_id, '')) <> ''),
sizes AS (SELECT basket FROM d WHERE basket <> '' GROUP BY basket HAVING count(*) BETWEEN 2 AND 300),
k AS (SELECT d.* FROM d JOIN sizes USING (basket)),
n AS (SELECT item, count(*) AS n FROM k GROUP BY item),
t AS (SELECT count(*) AS total FROM sizes),
ab AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM k a JOIN k b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, total AS n_baskets FROM ab JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b CROSS JOIN t)"""
_P10 = """WITH named AS (SELECT *, CASE WHEN length(text) >= 240 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS class_id FROM documents),
w AS (SELECT doc_id, class_id, k, substring(text, k, 240) AS span FROM (SELECT doc_id, class_id, text, unnest(range(1, length(text) - 238)) AS k FROM named WHERE length(text) >= 240)),
shared AS (SELECT span, min(doc_id) AS low FROM w GROUP BY span HAVING count(DISTINCT doc_id) > 1), s AS (SELECT w.*, low FROM w JOIN shared USING (span))"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _grams(name: str, key: str, tab: str) -> str:
    windows = f"SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {key}, {_WORDS} AS w FROM {tab}) WHERE len(w) >= 12"
    return f"{name} AS (SELECT {key}, array_to_string(w[k:k + 11], ' ') AS gram FROM ({windows}))"


SQL: dict[str, str] = {
    "p8_found": f"WITH {_grams('d', 'doc_id', 'documents')}, {_grams('i', 'item_id', 'eval_items')} SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON d.gram = i.gram",
    "p8_report": f"""WITH {_grams('d', 'doc_id', 'documents')}, {_grams('i', 'item_id', 'eval_items')}, hit AS (SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON d.gram = i.gram),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hit))),
iw AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM eval_items)),
same AS (SELECT h.doc_id, h.item_id, d.k - i.k AS diagonal, i.k FROM hit h JOIN dw d ON h.doc_id = d.doc_id JOIN iw i ON h.item_id = i.item_id AND d.w[d.k] = i.w[i.k]),
runs AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS island FROM same) GROUP BY doc_id, item_id, diagonal, island),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM dw WHERE k + 4 <= len(w)), items AS (SELECT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM iw WHERE k + 4 <= len(w)),
held AS (SELECT h.doc_id, h.item_id, CAST(count(ds.s) AS DOUBLE) / count(*) AS share FROM hit h JOIN items i ON h.item_id = i.item_id LEFT JOIN ds ON ds.doc_id = h.doc_id AND ds.s = i.s GROUP BY 1, 2)
SELECT r.doc_id, r.item_id, max(n) AS longest_run, any_value(share) AS containment FROM runs r JOIN held USING (doc_id, item_id) GROUP BY 1, 2""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, substring(text, k, 240) AS span FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS k FROM documents WHERE length(text) >= 240)),
shared AS (SELECT span FROM g GROUP BY span HAVING count(*) > 1), s AS (SELECT g.* FROM g JOIN shared ON g.span = shared.span)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.span = b.span AND a.doc_id < b.doc_id""",
    "p10_coverage": f"""{_P10}, gaps AS (SELECT doc_id, least(240, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 240)) AS fresh FROM s), c AS (SELECT doc_id, CAST(sum(fresh) AS BIGINT) AS covered FROM gaps GROUP BY 1)
SELECT n.doc_id, class_id, length(text) AS n_chars, coalesce(covered, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(covered, 0)::DOUBLE / length(text) ELSE 0 END AS share FROM named n LEFT JOIN c ON n.doc_id = c.doc_id""",
    "p10_links": f"""{_P10}, l AS (SELECT DISTINCT a.class_id, b.class_id AS other FROM s a JOIN s b ON a.span = b.span AND a.class_id <> b.class_id), c AS (SELECT class_id, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, n.class_id, coalesce(c.n, 0) AS n_links FROM named n LEFT JOIN c ON n.class_id = c.class_id""",
    "p10_stripped": f"""{_P10}, f AS (SELECT doc_id, k FROM s WHERE low < doc_id), p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM f)),
m AS (SELECT p.*, max(f.k) OVER (PARTITION BY p.doc_id ORDER BY p) AS last FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.p = f.k)
SELECT doc_id, coalesce(string_agg(substring(text, p, 1), '' ORDER BY p) FILTER (WHERE last IS NULL OR p - last >= 240), '') AS kept FROM m GROUP BY doc_id""",
    "p7_found": f"{_P7} SELECT item_a AS track_a, item_b AS track_b FROM p WHERE n_ab * n_baskets >= 3 * n_a * n_b",
    "p7_pairs": f"""{_P7} SELECT *, CAST(n_ab * n_baskets AS DOUBLE) / (n_a * n_b) AS lift,
  ((n_ab + 0.5::DOUBLE) * (n_baskets - n_a - n_b + n_ab + 0.5::DOUBLE)) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)) AS odds_ratio FROM p""",
}
