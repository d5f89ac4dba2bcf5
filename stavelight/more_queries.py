"""Further queries and their SQL: the MIDI source, streams, messages, nested validation, device windows, density tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import fixed
from .functions import scalars as S
from .operators import bars as B
from .operators import features as A
from .operators import notes as N
from .operators import pieces as P
from .operators import rolls as R
from .operators import schemas
from .operators import segments as G
from .queries import _ACTIVE, _FILES, _HAS, _files, _listed, _r, all_bars, bar_notes, events, lengths, notes, query, table, track_table
from .session import shared_folder
from .sources import dataset, edit, midi, smf
from .streaming import notes as streamed


def fresh(spark, name: str) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(_FILES + """ SELECT piece_id || '.mid' AS piece_id, smf_track, "start"::BIGINT AS tick, 144 + smf_track - 1 + CASE WHEN smf_track > 9 THEN 1 ELSE 0 END AS status, pitch AS p1, velocity AS p2, count(*)::BIGINT AS n FROM fl GROUP BY ALL
UNION ALL SELECT piece_id || '.mid', smf_track, "end"::BIGINT, 144 + smf_track - 1 + CASE WHEN smf_track > 9 THEN 1 ELSE 0 END, pitch, 0, count(*) FROM fl GROUP BY ALL""")
def midi_source(spark, sf_dir):
    """Messages of all users written as files by the data source and read by it: every onset and offset."""
    midi.register(spark)
    path = fresh(spark, "midi")
    midi.save(smf.decode(_files(spark, sf_dir), "piece_id"), path)
    back = spark.read.format("midi").schema("piece_id string, smf_track int, tick long, status int, p1 int, p2 int, error string").load(path)
    return back.where("status between 144 and 159").groupBy("piece_id", "smf_track", "tick", "status", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT piece_id, track, pitch, \"start\", \"end\", velocity FROM nt")
def streamed_notes(spark, sf_dir):
    """All events as a stream of files in an order that has nothing to do with time, a file a micro-batch; two far later ones move the watermark past the last event."""
    streamed.use_rocks(spark)
    path = fresh(spark, "stream")
    start = 1_704_067_200
    rows = events(spark, sf_dir).select(F.timestamp_seconds(F.col("tick").cast("long") * 3600 + start).alias("ts"), "piece_id", "track", "pitch", "tick", "velocity", F.col("seq").cast("long").alias("seq"))
    rows.repartition(3, F.xxhash64("seq", "tick")).write.parquet(f"{path}/in")
    for years in (100, 101):
        end = spark.range(1).select(F.timestamp_seconds(F.lit(start + years * 31_536_000)).alias("ts"), F.lit(-1).alias("piece_id"), F.lit(0).alias("track"), F.lit(0).alias("pitch"), F.lit(0).alias("tick"), F.lit(0).alias("velocity"), F.lit(0).cast("long").alias("seq"))
        end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = streamed.streamed_notes(source, "18250 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("piece_id", "track", "pitch", "start", "end", "velocity")


# --- messages ---


@query(""", c AS (SELECT l_suppkey::INT AS piece_id, l_linenumber::INT AS channel, ([64, 65, 69, 80, 1, 90, 122])[l_partkey % 7 + 1] AS controller, floor(l_quantity)::INT * 5 % 128 >= 64 AS up, (l_orderkey * 8 + l_linenumber) * 64 + floor(l_quantity)::INT AS seq, l_orderkey AS tick FROM lineitem WHERE l_partkey % 7 <> 4),
g AS (SELECT *, row_number() OVER (PARTITION BY piece_id, channel, controller ORDER BY seq) - row_number() OVER (PARTITION BY piece_id, channel, controller, up ORDER BY seq) AS island FROM c),
i AS (SELECT piece_id, channel, controller, up, min(seq) AS seq, min(tick) AS tick FROM g GROUP BY piece_id, channel, controller, up, island),
l AS (SELECT *, lead(seq) OVER w AS off_seq, lead(tick) OVER w AS off_tick FROM i WINDOW w AS (PARTITION BY piece_id, channel, controller ORDER BY seq))
SELECT piece_id, channel, controller, seq AS on_seq, off_seq, tick AS on_tick, off_tick FROM l WHERE up AND off_seq IS NOT NULL""")
def linked_switches(spark, sf_dir):
    """Line items as controllers, one of which isn't a switch."""
    li = table(spark, sf_dir, "lineitem")
    channel = F.col("l_linenumber").cast("int")
    number = F.element_at(F.array(*map(F.lit, (64, 65, 69, 80, 1, 90, 122))), (F.col("l_partkey") % 7 + 1).cast("int"))
    m = li.select(
        F.col("l_suppkey").cast("int").alias("piece_id"), F.lit(0).alias("smf_track"), channel.alias("channel"), (channel + 176).alias("status"), number.alias("p1"), (F.floor("l_quantity").cast("int") * 5 % 128).alias("p2"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.floor("l_quantity").cast("int")).alias("seq"), F.col("l_orderkey").alias("tick"),
    )
    return N.link_switches(m).drop("smf_track")


@query(_FILES + """, s AS (SELECT piece_id, smf_track, pitch, velocity, "start" - 240 AS a, "end" - 240 AS b FROM fl WHERE "start" >= 240 AND "start" < 720),
m AS (SELECT piece_id, smf_track, a AS tick, pitch AS p1, velocity AS p2 FROM s UNION ALL SELECT piece_id, smf_track, least(b, 480), pitch, 0 FROM s)
SELECT piece_id, smf_track, tick::BIGINT AS tick, p1, p2, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def excerpt_messages(spark, sf_dir):
    """Seconds 10 to 30 of files whose tempo gives 24 ticks a second: notes that begin there, ended at the end at the latest."""
    m = edit.excerpt(smf.decode(_files(spark, sf_dir), "piece_id"), 10, 30).where("status between 128 and 159")
    return m.select("piece_id", "smf_track", "tick", "p1", F.when(F.col("status") < 144, 0).otherwise(F.col("p2")).alias("p2")).groupBy("piece_id", "smf_track", "tick", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))


@query(""", h AS (SELECT piece_id, track, "start", pitch, "end" AS e, row_number() OVER (PARTITION BY piece_id, track, "start" ORDER BY pitch DESC, "end" DESC) AS r FROM nt),
t AS (SELECT *, lead("start") OVER (PARTITION BY piece_id, track ORDER BY "start") AS nx FROM h WHERE r = 1)
SELECT piece_id, track, "start", pitch FROM t UNION ALL SELECT piece_id, track, e, NULL FROM t WHERE nx IS NULL OR nx > e""")
def melody_lines(spark, sf_dir):
    return N.melody(notes(spark, sf_dir))


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY track, "start", pitch) AS place FROM nt),
g AS (SELECT piece_id, pitch, row_number() OVER (PARTITION BY piece_id ORDER BY md5('11:' || piece_id || ':' || place), place) AS place FROM o)
SELECT o.piece_id, track, g.pitch, "start", "end", velocity FROM o JOIN g ON o.piece_id = g.piece_id AND o.place = g.place""")
def mixed_pitches(spark, sf_dir):
    return edit.mixup(notes(spark, sf_dir), 11)


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track ORDER BY "start", pitch) AS place, count(*) OVER (PARTITION BY piece_id, track) AS n FROM nt)
SELECT a.piece_id, a.track, b.pitch, a."start", a."end", a.velocity FROM o AS a JOIN o AS b ON a.piece_id = b.piece_id AND a.track = b.track AND b.place = a.n + 1 - a.place""")
def reversed_pitches(spark, sf_dir):
    """Each track's pitches backwards."""
    return edit.mixup(notes(spark, sf_dir), None, ("piece_id", "track"), ("start", "pitch"))


# --- the eight-track device ---

_DEVICE = _HAS + """, px AS (SELECT piece_id, track, unnest(range("start", "end")) AS step FROM nt), pm AS (SELECT piece_id, track, max(n) AS p FROM (SELECT piece_id, track, step, count(*) AS n FROM px GROUP BY ALL) GROUP BY ALL),
ty AS (SELECT piece_id, track, CASE WHEN t = 9 THEN CASE WHEN p <= 4 THEN [x FOR x IN [CASE WHEN p <= 2 THEN 6 END, CASE WHEN p <= 3 THEN 5 END, CASE WHEN p <= 4 THEN 7 END] IF x IS NOT NULL] ELSE [9] END
  WHEN t IN (0, 1, 2) AND p > 2 THEN [13] WHEN t = 4 AND p > 1 THEN [15] WHEN t = 3 AND p > 2 THEN [14] ELSE [t] END AS types FROM (SELECT piece_id, track, track // 5 % 10 AS t, p FROM pm)),
vs AS (SELECT piece_id, bar AS "start", list(track ORDER BY track) AS tracks, count(DISTINCT list_sort(types)) AS kinds, count(*) FILTER (list_sort(types) = [5, 6] OR list_sort(types) = [5, 6, 7]) AS flexible FROM w JOIN ty USING (piece_id, track) WHERE bar <= nb - 4 AND f >= 3 GROUP BY piece_id, bar),
sg AS (SELECT piece_id, "start", tracks FROM vs WHERE kinds >= 3 OR flexible >= 2)
"""


def _device(spark, sf_dir):
    """(segments, types): every piece's tracks as the device's types."""
    n = notes(spark, sf_dir)
    types = G.remap_train_types(A.max_polyphony(n).withColumn("track_type", F.expr("track div 5 % 10").cast("int"))).select("piece_id", "track", "train_types")
    bars = A.has_notes(events(spark, sf_dir), all_bars(spark, sf_dir))
    return G.valid_segments_opz(bars, types, 4, 3), types


@query(_DEVICE + """SELECT piece_id, "start", array_to_string(tracks, ',') AS tracks FROM sg""")
def device_segments(spark, sf_dir):
    return _device(spark, sf_dir)[0].select("piece_id", "start", _listed("tracks"))


@query(_DEVICE + """, one AS (SELECT piece_id, "start", tracks FROM sg QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY md5('7:' || piece_id || ':' || "start")) = 1),
ex AS (SELECT piece_id, "start", unnest(tracks) AS track FROM one),
od AS (SELECT ex.*, row_number() OVER (PARTITION BY piece_id ORDER BY md5('7:' || piece_id || ':' || track)) AS i, [x.t FOR x IN list_sort([{'r': md5('8:' || piece_id || ':' || track || ':' || t), 't': t} FOR t IN types]) IF x.t < 8] AS free FROM ex JOIN ty USING (piece_id, track)),
st AS (SELECT piece_id, 0::BIGINT AS i, []::INT[] AS used, []::VARCHAR[] AS chosen FROM one UNION ALL
  SELECT st.piece_id, od.i, CASE WHEN len([x FOR x IN free IF NOT list_contains(used, x::INT)]) > 0 THEN used || [([x FOR x IN free IF NOT list_contains(used, x::INT)])[1]::INT] ELSE used END,
  CASE WHEN len([x FOR x IN free IF NOT list_contains(used, x::INT)]) > 0 THEN chosen || [track || ':' || ([x FOR x IN free IF NOT list_contains(used, x::INT)])[1]] ELSE chosen END FROM st JOIN od ON od.piece_id = st.piece_id AND od.i = st.i + 1),
en AS (SELECT piece_id, arg_max(chosen, i) AS chosen FROM st GROUP BY piece_id)
SELECT p.piece_id, one."start", CASE WHEN len(chosen) >= 5 THEN array_to_string(chosen, ',') END AS tracks, CASE WHEN one."start" IS NULL THEN 'no valid segments' WHEN len(chosen) < 5 THEN 'less than min tracks' END AS problem
FROM (SELECT DISTINCT piece_id FROM ty) p LEFT JOIN one USING (piece_id) LEFT JOIN en USING (piece_id)""", recursive=True)
def device_tracks(spark, sf_dir):
    """One segment a piece, its tracks with types that differ; the fewest are five."""
    out = G.select_segments_opz(*_device(spark, sf_dir), 7, 5)
    told = F.array_join(F.transform("tracks", lambda t: F.concat_ws(":", t["track"].cast("string"), t["track_type"].cast("string"))), ",")
    return out.select("piece_id", "start", told.alias("tracks"), "problem")


# --- nested validation ---


@query(""", p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_linenumber - 1 AS num FROM lineitem), k AS (SELECT DISTINCT l_orderkey FROM lineitem),
v AS (SELECT l_orderkey, 'piece.tracks[' || i || '].instrument' AS path, (l_partkey % 130) AS value, 0 AS lo, 127 AS hi FROM p
UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[0].events[0]', l_suppkey - 3, 0, 2147483647 FROM p UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[0].events[1]', l_linenumber, 0, 2147483647 FROM p
UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[0].tsNumerator', num, 1, 1000000 FROM p UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[0].tsDenominator', 4, 1, 1000000 FROM p
UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[1].tsNumerator', 3, 1, 1000000 FROM p UNION ALL SELECT l_orderkey, 'piece.tracks[' || i || '].bars[1].tsDenominator', CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE 8 END, 1, 1000000 FROM p
UNION ALL SELECT l_orderkey, 'piece.events[' || i || '].time', l_partkey * 700, 0, 1000000 FROM p UNION ALL SELECT l_orderkey, 'piece.events[' || i || '].velocity', l_suppkey % 130, 0, 127 FROM p UNION ALL SELECT l_orderkey, 'piece.events[' || i || '].pitch', l_partkey % 131 - 1, 0, 127 FROM p
UNION ALL SELECT l_orderkey, 'piece.resolution', l_orderkey % 14, 1, 12 FROM k UNION ALL SELECT l_orderkey, 'piece.tempo', CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 120 END, 1, 1000000 FROM k)
SELECT l_orderkey AS piece_id, path, value::DOUBLE AS value FROM v WHERE value < lo OR value > hi""")
def nested_violations(spark, sf_dir):
    """Orders as nested pieces, a track and an event a line; unset numbers count as 0, internal fields (always out of range here) aren't tested."""
    i = lambda c: c.cast("int")
    bad = F.lit(-1).cast("int").alias("internalDuration")
    bars = F.array(
        F.struct(F.array(i(F.col("l_suppkey") - 3), i(F.col("l_linenumber"))).alias("events"), i(F.col("l_linenumber") - 1).alias("tsNumerator"), F.lit(4).alias("tsDenominator")),
        F.struct(F.array().cast("array<int>").alias("events"), F.lit(3).alias("tsNumerator"), F.when(F.col("l_partkey") % 11 != 0, 8).alias("tsDenominator")),
    )
    track = F.struct(i(F.col("l_partkey") % 130).alias("instrument"), bars.alias("bars"))
    event = F.struct(i(F.col("l_partkey") * 700).alias("time"), i(F.col("l_suppkey") % 130).alias("velocity"), i(F.col("l_partkey") % 131 - 1).alias("pitch"), bad)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", track.alias("t"), event.alias("e")))).alias("x"))
    piece = F.struct(
        F.transform("x", lambda r: r["t"]).alias("tracks"), F.transform("x", lambda r: r["e"]).alias("events"), i(F.col("l_orderkey") % 14).alias("resolution"), F.when(F.col("l_orderkey") % 5 != 0, 120).alias("tempo"), F.lit(-5).alias("internalSegmentLength")
    )
    return schemas.out_of_range(rows.select(F.col("l_orderkey").alias("piece_id"), piece.alias("piece")), "piece", schemas.PIECE, ["piece_id"])


# --- density tables ---


@query(""", b AS (SELECT track % 14 AS kind, track * 7 % 128 AS inst, n FROM (SELECT piece_id, track, bar, count(*) AS n FROM ev WHERE velocity > 0 GROUP BY ALL)),
r AS (SELECT NULL::INT AS track_type, CASE WHEN kind IN (0, 1, 2, 8, 11) THEN 128 ELSE inst END::INT AS program, n FROM b UNION ALL SELECT kind, inst, n FROM b WHERE kind BETWEEN 3 AND 7 UNION ALL SELECT -1, 0, n FROM b WHERE kind <= 2),
l AS (SELECT track_type, program, list(n ORDER BY n) AS l, count(*) AS c FROM r GROUP BY ALL),
q AS (SELECT track_type, program, [(l[(c - 1) * i // 10 + 1] * (10 - (c - 1) * i % 10) + l[least((c - 1) * i // 10 + 2, c)] * ((c - 1) * i % 10)) // 10 FOR i IN range(1, 10)] || [1073741824] AS q FROM l),
d AS (SELECT track_type, program, q FROM q WHERE track_type IS NULL OR track_type >= 0 UNION ALL SELECT t, p, q FROM q, (SELECT unnest(range(0, 3)) AS t), (SELECT unnest(range(0, 128)) AS p) WHERE track_type = -1)
SELECT track_type::INT AS track_type, program::INT AS program, array_to_string(q, ',') AS quantiles, array_to_string([list_position(q, x) - 1 FOR x IN q], ',') AS first_equal FROM d""")
def density_tables(spark, sf_dir):
    """Deciles of onsets a bar by program, and by the device's type and program."""
    counts = events(spark, sf_dir).where("velocity > 0").groupBy("piece_id", "track", "bar").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select((F.col("track") % 14).alias("track_type"), (F.col("track") * 7 % 128).alias("instrument"), "n")
    return A.density_tables(rows).select("track_type", "program", _listed("quantiles"), _listed("first_equal"))


# --- file tools ---


def _decoded(spark, sf_dir):
    return smf.decode(_files(spark, sf_dir), "piece_id")


@query(_FILES + """ SELECT piece_id, "start"::BIGINT AS tick, ("end" - "start")::BIGINT AS duration, smf_track, pitch AS key FROM fl""")
def file_note_durations(spark, sf_dir):
    return smf.durations(_decoded(spark, sf_dir))


@query(_FILES + """ SELECT piece_id, max("end")::BIGINT AS max_tick, round(max("end") / 12, 6)::DOUBLE AS quarters, round(max("end") / 24, 6)::DOUBLE AS seconds FROM fl GROUP BY piece_id""")
def file_durations(spark, sf_dir):
    """At 120 quarters of 12 ticks a minute."""
    return smf.file_duration(_decoded(spark, sf_dir)).select("piece_id", "max_tick", _r(F.col("quarters")).alias("quarters"), _r(F.col("seconds")).alias("seconds"))


@query(_FILES + """ SELECT piece_id, smf_track, pitch AS key, "start"::BIGINT AS tick, round("start" / 24, 6)::DOUBLE AS seconds FROM fl""")
def file_onset_seconds(spark, sf_dir):
    m = smf.with_seconds(_decoded(spark, sf_dir)).where("status between 144 and 159 and p2 > 0")
    return m.select("piece_id", "smf_track", F.col("p1").alias("key"), "tick", _r(F.col("seconds")).alias("seconds"))


@query(_FILES + """ SELECT piece_id, smf_track, pitch AS key, "start"::BIGINT * 40 AS finer, floor("start" * 5 / 12::DOUBLE + 0.5)::BIGINT AS coarser, floor("start" * 1.3::DOUBLE + 0.5)::BIGINT AS slower FROM fl""")
def scaled_ticks(spark, sf_dir):
    """Onsets at 480 and at 5 ticks a quarter, and stretched."""
    m = _decoded(spark, sf_dir).where("status between 144 and 159 and p2 > 0")
    own = ["piece_id", "smf_track", "seq"]
    tick = lambda df, name: df.select(*own, F.col("tick").cast("long").alias(name))
    df = m.select(*own, F.col("p1").alias("key")).join(tick(smf.retick(m, 480), "finer"), own).join(tick(smf.retick(m, 5), "coarser"), own).join(tick(smf.stretch(m, 1.3), "slower"), own)
    return df.drop("seq")


@query(_FILES + """, m AS (SELECT piece_id, smf_track, "start" AS tick, 1 AS part, 1 AS up, pitch AS p1, velocity AS p2 FROM fl UNION ALL SELECT piece_id, smf_track, "end", 1, 0, pitch, 0 FROM fl
UNION ALL SELECT DISTINCT piece_id, smf_track, 0, 0, 0, 0, 0 FROM fl UNION ALL SELECT piece_id, smf_track, max("end"), 2, 0, NULL, NULL FROM fl GROUP BY piece_id, smf_track UNION ALL SELECT DISTINCT piece_id, 0, 0, 0, 0, NULL, NULL FROM fl UNION ALL SELECT DISTINCT piece_id, 0, 0, 2, 0, NULL, NULL FROM fl)
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY tick, smf_track, part, up, p1, p2) - 1)::INT AS seq, smf_track AS split_track, tick::BIGINT AS tick, p1::INT AS p1, p2::INT AS p2 FROM m""")
def joined_tracks(spark, sf_dir):
    """All messages of a file in one track, in order of ticks."""
    return smf.join_tracks(_decoded(spark, sf_dir)).select("piece_id", "seq", "split_track", "tick", "p1", "p2")


@query(""" SELECT conv_id || '.mid' AS piece_id, (turn * 48)::BIGINT AS tick, text FROM conversations WHERE text IS NOT NULL""")
def file_lyrics(spark, sf_dir):
    """Conversations as files of lyrics, a turn a message of its whole text, written and read back."""
    midi.register(spark)
    c = table(spark, sf_dir, "conversations").where("text is not null")
    m = c.select(F.col("conv_id").cast("string").alias("piece_id"), F.lit(0).alias("smf_track"), edit.text(F.col("turn") * 48, F.col("text"), "lyric").alias("m"), F.col("turn").alias("seq"))
    path = fresh(spark, "lyrics")
    midi.save(m.select("piece_id", F.lit(480).alias("tpq"), "smf_track", "seq", "m.*"), path)
    return smf.lyrics(spark.read.format("midi").load(path))


@query(_FILES + """, m AS (SELECT piece_id, max("end") // 48 + 1 AS total FROM fl GROUP BY piece_id), v AS (SELECT piece_id, 3 % greatest(total - 4, 1) * 48 AS lo, least(3 % greatest(total - 4, 1) + 4, total) * 48 AS hi FROM m),
c AS (SELECT DISTINCT fl.piece_id, unnest(range(greatest("start", lo), least("end", hi))) - lo AS step, pitch FROM fl JOIN v USING (piece_id) WHERE "start" < hi AND "end" > lo) SELECT piece_id, step::INT AS step, pitch FROM c""")
def file_rolls(spark, sf_dir):
    """Cells of four bars of each file, from the fourth."""
    return R.roll_of_file(_decoded(spark, sf_dir), 12, 4, 3).where("problem is null").drop("problem")


# --- features, bars, JSON ---


@query(_ACTIVE + """, d AS (SELECT piece_id, track, array_to_string(list(active ORDER BY step), ',') AS polyphony_distribution FROM a GROUP BY ALL),
l AS (SELECT piece_id, track, "end" - "start" AS n, floor(greatest(0.0, least(5.0, log2(greatest(("end" - "start") / 3, 1e-6)) + 1)))::INT AS v FROM nt), b AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY piece_id, track) AS c FROM l),
e AS (SELECT piece_id, track, max(CASE WHEN i = least(round(c * 0.15::DOUBLE), c - 1) THEN v END) AS lo, max(CASE WHEN i = least(round(c * 0.85::DOUBLE), c - 1) THEN v END) AS hi, min(v) AS least_, max(v) AS most FROM b GROUP BY piece_id, track)
SELECT ln.piece_id, ln.track, (greatest(least(coalesce(q1, 0), 10), 1) - 1)::INT AS min_polyphony_q_bin, (greatest(least(coalesce(q2, 0), 10), 1) - 1)::INT AS max_polyphony_q_bin, (greatest(least(coalesce(mn, 0), 10), 1) - 1)::INT AS min_polyphony_hard, (greatest(least(coalesce(mx, 0), 10), 1) - 1)::INT AS max_polyphony_hard,
lo AS min_duration_q, hi AS max_duration_q, least_ AS min_duration_hard, most AS max_duration_hard, round((max_tick - coalesce(n, 0)) / greatest(max_tick, 1), 6)::DOUBLE AS rest_percentage, coalesce(polyphony_distribution, '') AS polyphony_distribution
FROM ln LEFT JOIN f USING (piece_id, track) LEFT JOIN d USING (piece_id, track) LEFT JOIN e USING (piece_id, track)""")
def all_track_features(spark, sf_dir):
    n = notes(spark, sf_dir)
    f = A.track_features(n, lengths(n)).join(A.polyphony_distribution(n, lengths(n)), ["piece_id", "track"], "left")
    told = F.coalesce(F.array_join(F.transform("polyphony_distribution", lambda x: x.cast("string")), ","), F.lit(""))
    names = ["min_polyphony_q_bin", "max_polyphony_q_bin", "min_polyphony_hard", "max_polyphony_hard", "min_duration_q", "max_duration_q", "min_duration_hard", "max_duration_hard"]
    return f.select("piece_id", "track", *names, _r(F.col("rest_percentage")).alias("rest_percentage"), told.alias("polyphony_distribution"))


@query(""", a AS (SELECT DISTINCT piece_id, bar, CASE WHEN (piece_id + bar) % 3 = 0 THEN 3.0 ELSE 4.0 END::DOUBLE AS "left" FROM bn WHERE track < 4), b AS (SELECT DISTINCT piece_id, bar, CASE WHEN bar % 2 = 0 THEN 3.0 ELSE 4.0 END::DOUBLE AS "right" FROM bn WHERE track >= 4)
SELECT piece_id, bar, "left", "right" FROM a JOIN b USING (piece_id, bar) WHERE "right" <> "left" """)
def unlike_bars(spark, sf_dir):
    """Bars of two pieces that can't be put side by side."""
    b = bar_notes(spark, sf_dir).select("piece_id", "track", "bar").distinct()
    length = lambda three: F.when(three, 3.0).otherwise(4.0).cast("double")
    return P.unlike_bars(b.where("track < 4").withColumn("beat_length", length((F.col("piece_id") + F.col("bar")) % 3 == 0)), b.where("track >= 4").withColumn("beat_length", length(F.col("bar") % 2 == 0)))


@query(""" SELECT piece_id, track, bar, (row_number() OVER (PARTITION BY piece_id, track, bar ORDER BY time, pitch, seq) - 1)::INT AS pos, time, duration AS velocity, pitch FROM bn""")
def events_of_json(spark, sf_dir):
    """Events written into nested JSON pieces and followed back from their bars."""
    n = bar_notes(spark, sf_dir)
    w = Window.partitionBy("piece_id", "track", "bar").orderBy("time", "pitch", "seq")
    ev = n.select("piece_id", "track", "bar", (F.row_number().over(w) - 1).alias("pos"), "time", F.col("duration").alias("velocity"), "pitch")
    tracks = n.select("piece_id", "track").distinct().select("piece_id", (F.col("track") - 1).alias("track"), F.lit(3).alias("instrument"), F.lit(10).alias("track_type"))
    ev = ev.withColumn("track", F.col("track") - 1)
    every = tracks.select("piece_id", "track", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bar")).withColumns({"ts_num": F.lit(4), "ts_den": F.lit(4)})
    back = dataset.piece_events(dataset.parse_pieces(dataset.to_pieces(tracks, every, ev)))
    # tracks are numbered by place in JSON
    place = tracks.select("piece_id", F.col("track").alias("_t"), (F.row_number().over(Window.partitionBy("piece_id").orderBy("track")) - 1).alias("track"))
    return back.join(place, ["piece_id", "track"]).select("piece_id", (F.col("_t") + 1).alias("track"), "bar", "pos", "time", "velocity", "pitch")


@query(""", t AS (SELECT DISTINCT o_custkey AS piece_id, (o_orderkey % 50 * 480)::INT AS tick, (300000 + o_orderkey % 50 * 960)::INT AS micros FROM orders), z AS (SELECT * FROM t UNION ALL SELECT DISTINCT piece_id, 0, 500000 FROM t WHERE piece_id NOT IN (SELECT piece_id FROM t WHERE tick = 0)),
m AS (SELECT *, (tick - lag(tick) OVER w) * (lag(micros) OVER w / 1e6 / 480) AS step FROM z WINDOW w AS (PARTITION BY piece_id ORDER BY tick)), s AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY piece_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS seconds FROM m),
q AS (SELECT o_custkey AS piece_id, o_orderkey, (o_orderkey % 97 / 7)::DOUBLE AS second FROM orders)
SELECT q.piece_id, o_orderkey, round(s.tick + (q.second - s.seconds) / (micros / 1e6 / 480), 3)::DOUBLE AS tick FROM q ASOF JOIN s ON q.piece_id = s.piece_id AND q.second >= s.seconds""")
def ticks_of_seconds(spark, sf_dir):
    """Time interpolated the other way round."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_custkey").alias("piece_id"), (k % 50 * 480).cast("int").alias("tick"), (k % 50 * 960 + 300000).cast("int").alias("micros")).distinct()
    tempo = B.tempo_map(t, t.select("piece_id", F.lit(480).alias("tpq")).distinct())
    q = o.select(F.col("o_custkey").alias("piece_id"), "o_orderkey", (k % 97 / 7).alias("seconds"))
    return B.tick_at_second(q, tempo).select("piece_id", "o_orderkey", F.round("tick", 3).alias("tick"))
