"""Schemas and fixed axis system."""

from __future__ import annotations

from pyspark.sql import types as T

#: The axes of a track's feature vector, in order.
SCALAR_AXES = ["tempo", "energy", "valence", "acousticness", "lyrical_depth"]
GENRES = ["country", "rap", "indie", "pop", "rock", "electronic", "folk", "metal", "rnb", "jazz"]
AXES = SCALAR_AXES + [f"genre:{g}" for g in GENRES]
NEUTRAL = {a: 0.5 if a in SCALAR_AXES else 0.0 for a in AXES}

_track = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("artist_name", T.StringType()), T.StructField("track_uri", T.StringType()),
    T.StructField("artist_uri", T.StringType()), T.StructField("track_name", T.StringType()), T.StructField("album_uri", T.StringType()),
    T.StructField("album_name", T.StringType()), T.StructField("duration_ms", T.LongType()),
])
SLICE = T.StructType([
    T.StructField("info", T.StructType([T.StructField(n, T.StringType()) for n in ("generated_on", "slice", "version")])),
    T.StructField("playlists", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("collaborative", T.StringType()), T.StructField("pid", T.LongType()),
        T.StructField("modified_at", T.LongType()), T.StructField("num_tracks", T.LongType()), T.StructField("num_albums", T.LongType()),
        T.StructField("num_followers", T.LongType()), T.StructField("tracks", T.ArrayType(_track)),
    ]))),
])
CHALLENGE = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("playlists", T.ArrayType(T.StructType([
        T.StructField("pid", T.LongType()), T.StructField("name", T.StringType()), T.StructField("num_samples", T.LongType()),
        T.StructField("num_holdouts", T.LongType()), T.StructField("tracks", T.ArrayType(_track)),
    ]))),
])
AUDIO = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("tempo", "energy", "valence", "acousticness", "instrumentalness")]])
RESULTS = T.StructType([T.StructField("model", T.StringType()), T.StructField("scenario", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("r_precision", "ndcg", "clicks")]])
META = ["track_uri", "track_name", "artist_uri", "artist_name", "album_uri", "album_name"]
