"""Places by similar text (J4): spelling variants of a gazetteer's names.

Places without an exact entry are looked up by the edit distance of
``city, country`` in lower case, with runs of other characters than letters and
digits as one blank.  Up to a quarter of the shorter name's characters may be
edited, and ``MOST`` at most.

Only distinct places are compared, and only with entries that share one of
their rarest 3-grams: a string of n characters has n + 2 padded 3-grams (those
that repeat are numbered), an edit changes three, so strings within d edits
agree in one of the first 3 d + 1 of each, in any order common to both.  The
order is from rare to frequent in the gazetteer, so frequent 3-grams bring
nobody together.  Candidates are checked by their distance; of several the
nearest is taken, then the least in the order of name and point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgraph.session import materialize

GRAM = 3
MOST = 2


def place_text(city: Column, country: Column) -> Column:
    """What is compared; null if a part is missing or has no letter or digit."""
    def plain(c: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))
    return F.concat(plain(city), F.lit(", "), plain(country))


def allowed(n: Column) -> Column:
    """Edits allowed for a name of ``n`` characters."""
    return F.least(F.lit(MOST), F.floor(n / 4)).cast("int")


def _grams(names: DataFrame) -> DataFrame:
    """``(name, gram)``: padded 3-grams, the second of a kind as another one."""
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), F.col("name"), F.lit("\x02" * (GRAM - 1)))
    each = names.select("name", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("name") + GRAM - 1), lambda i: F.substring(padded, i, F.lit(GRAM)))).alias("g"))
    repeats = each.groupBy("name", "g").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return repeats.select("name", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("_n")), lambda k: F.concat("g", k.cast("string")))).alias("gram"))


def _prefixes(grams: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rarest grams of each name, as many as its edits can spoil and one."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    ranked = grams.join(frequency, "gram", "left").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= GRAM * allowed(F.char_length("name")) + 1).select("name", "gram")


def similar_places(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(city, country, matched_city, matched_country, distance, latitude,
    longitude)`` for the distinct ``(city, country)`` of ``places`` whose text
    has an entry within the allowed distance (0: another writing of the same)."""
    text = place_text(F.col("city"), F.col("country"))
    wanted = places.select("city", "country").distinct().withColumn("name", text).where("name is not null")
    entries = gazetteer.select("city", "country", "latitude", "longitude").withColumn("name", text).where("name is not null")
    wanted, entries = materialize(wanted, "wanted"), materialize(entries, "entries")
    theirs = materialize(_grams(entries.select("name").distinct()), "grams")
    frequency = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(_grams(wanted.select("name").distinct()), frequency).select(F.col("name").alias("a"), "gram")
    b = _prefixes(theirs, frequency).select(F.col("name").alias("b"), "gram")
    most = allowed(F.least(F.char_length("a"), F.char_length("b")))
    pairs = a.join(b, "gram").where(F.abs(F.char_length("a") - F.char_length("b")) <= most).select("a", "b").distinct()
    near = pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)
    points = entries.select(F.col("name").alias("b"), F.struct(
        F.col("city").alias("matched_city"), F.col("country").alias("matched_country"), "latitude", "longitude").alias("entry"))
    best = near.join(points, "b").groupBy(F.col("a").alias("name")).agg(F.min(F.struct("distance", "b", "entry")).alias("m"))
    return wanted.join(best, "name").select("city", "country", "m.entry.matched_city", "m.entry.matched_country",
                                            "m.distance", "m.entry.latitude", "m.entry.longitude")


def geocode_similar(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``df`` (columns ``city, country``) with ``latitude, longitude,
    place_distance``: of the exact entry (distance 0), else of the nearest
    similar one; nulls for a place that has none."""
    entries = gazetteer.groupBy("city", "country").agg(F.min(F.struct("latitude", "longitude")).alias("ll"))
    entries = entries.select("city", "country", "ll.latitude", "ll.longitude")
    places = df.select("city", "country").distinct()
    same = places.alias("p").join(entries.alias("g"), F.col("p.city").eqNullSafe(F.col("g.city"))
                                  & F.col("p.country").eqNullSafe(F.col("g.country")), "left").select(
        "p.city", "p.country", "g.latitude", "g.longitude", F.col("g.latitude").isNotNull().alias("known"))
    same = materialize(same, "exact")
    near = similar_places(same.where("not known"), entries).select("city", "country", "latitude", "longitude", "distance")
    found = materialize(same.where("known").select("city", "country", "latitude", "longitude", F.lit(0).alias("distance"))
                        .unionByName(near), "places").select(
        F.col("city").alias("_c"), F.col("country").alias("_k"), "latitude", "longitude", F.col("distance").alias("place_distance"))
    cond = df["city"].eqNullSafe(found["_c"]) & df["country"].eqNullSafe(found["_k"])
    return df.join(found, cond, "left").drop("_c", "_k")
