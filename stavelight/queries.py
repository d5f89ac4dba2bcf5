"""Queries over the supplied tables and their SQL.

The tables hold no music, so musical tables are derived from them by arithmetic that both engines share; every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import expected
from .functions import fixed, gm
from .functions import scalars as S
from .operators import bars as B
from .operators import features as A
from .operators import notes as N
from .operators import pieces as P
from .operators import rolls as R
from .operators import segments as G
from .plans import encode as E
from .plans import facade, generation, grammar, vocab
from .sources import dataset, edit, smf, tables

RESOLUTION, BAR = 12, 48
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, recursive: bool = False):
    """Register a query, with SQL over the derived tables if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (DERIVED.replace("WITH", "WITH RECURSIVE", 1) if recursive else DERIVED) + sql
        return f

    return add


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each event: piece_id, track, tick, pitch, velocity, dur, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("piece_id"), F.col("user_id").cast("int").alias("track"), F.expr("cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 3600 as int)").alias("tick"),
        (F.col("event_id") % 128).cast("int").alias("pitch"), (F.abs(F.floor("value")) % 127 + 1).cast("int").alias("velocity"), (F.col("event_id") % 48 + 1).cast("int").alias("dur"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and offsets in steps, with bar and time in it."""
    s = source_notes(spark, sf_dir)
    both = F.array(F.struct(F.col("tick").alias("tick"), F.col("velocity").alias("velocity"), (F.col("event_id") * 2).alias("seq")), F.struct((F.col("tick") + F.col("dur")).alias("tick"), F.lit(0).alias("velocity"), (F.col("event_id") * 2 + 1).alias("seq")))
    df = s.select("piece_id", "track", "pitch", F.explode(both).alias("x")).select("piece_id", "track", "pitch", "x.*")
    return df.withColumns({"bar": F.expr(f"cast(tick div {BAR} as int)"), "time": (F.col("tick") % BAR).cast("int")})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pair_notes(events(spark, sf_dir))


def bar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with bars from line items: piece_id, track, bar, time, pitch, duration, id."""
    li = table(spark, sf_dir, "lineitem")
    i = lambda c: c.cast("int")
    return li.select(
        i(F.col("l_suppkey")).alias("piece_id"), i(F.col("l_linenumber")).alias("track"), i(F.col("l_orderkey") % 64).alias("bar"), i(F.col("l_partkey") % 48).alias("time"), i(F.col("l_partkey") % 128).alias("pitch"),
        i(F.floor("l_quantity")).alias("duration"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.floor("l_quantity").cast("int")).alias("seq"),
    )


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece_id, track, instrument, track_type): every fifth track is drums."""
    t = source_notes(spark, sf_dir).select("piece_id", "track").distinct()
    return t.withColumns({"instrument": (F.col("track") * 7 % 128).cast("int"), "track_type": F.when(F.col("track") % 5 == 0, fixed.STANDARD_DRUM).otherwise(fixed.STANDARD)})


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("piece_id", "track").agg(F.max("end").cast("int").alias("max_tick"))


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar of every track of a piece, up to the piece's last."""
    e = events(spark, sf_dir)
    size = e.groupBy("piece_id").agg(F.max("bar").alias("last"))
    return e.select("piece_id", "track").distinct().join(size, "piece_id").select("piece_id", "track", F.explode(F.sequence(F.lit(0), "last")).alias("bar"))


DERIVED = f"""
WITH src AS (SELECT event_id, (user_id % 5)::INT AS piece_id, user_id::INT AS track, ((floor(epoch(ts))::BIGINT - 1704067200) // 3600)::INT AS tick, (event_id % 128)::INT AS pitch,
  (abs(floor(value)::BIGINT) % 127 + 1)::INT AS velocity, (event_id % 48 + 1)::INT AS dur FROM events),
ev0 AS (SELECT piece_id, track, pitch, tick, velocity, event_id * 2 AS seq FROM src UNION ALL SELECT piece_id, track, pitch, tick + dur, 0, event_id * 2 + 1 FROM src),
ev AS (SELECT *, (tick // {BAR})::INT AS bar, (tick % {BAR})::INT AS time, least(velocity, 1) AS onoff FROM ev0),
evl AS (SELECT *, lag(tick) OVER w AS ptick, lag(velocity) OVER w AS pvel, lag(seq) OVER w AS pseq, lead(velocity) OVER w AS nvel FROM ev WINDOW w AS (PARTITION BY piece_id, track, pitch ORDER BY tick, onoff, seq)),
nt AS (SELECT piece_id, track, pitch, ptick AS "start", tick AS "end", pvel AS velocity FROM evl WHERE velocity = 0 AND pvel > 0),
ln AS (SELECT piece_id, track, max("end")::INT AS max_tick FROM nt GROUP BY ALL),
bn AS (SELECT l_suppkey::INT AS piece_id, l_linenumber::INT AS track, (l_orderkey % 64)::INT AS bar, (l_partkey % 48)::INT AS time, (l_partkey % 128)::INT AS pitch, floor(l_quantity)::INT AS duration, (l_orderkey * 8 + l_linenumber) * 64 + floor(l_quantity)::INT AS seq FROM lineitem),
tr AS (SELECT DISTINCT piece_id, track, (track * 7 % 128)::INT AS instrument, CASE WHEN track % 5 = 0 THEN 11 ELSE 10 END AS track_type FROM src),
ab AS (SELECT t.piece_id, t.track, unnest(range(0, m.l + 1))::INT AS bar FROM (SELECT DISTINCT piece_id, track FROM ev) t JOIN (SELECT piece_id, max(bar) AS l FROM ev GROUP BY piece_id) m USING (piece_id))
"""


def _listed(c, name: str | None = None):
    """An array as text, which all engines compare alike."""
    values = F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string"))
    return F.array_join(values, ",").alias(name or c)


def _r(c, n: int = 6):
    return F.round(c, n)


# --- scalars ---


@query("""SELECT l_orderkey, l_linenumber, (floor(floor(l_partkey / 480.0 * 12 + 0.5) * 40.0))::INT AS snapped, (floor(l_partkey / 480.0 * 12 + 0.5))::INT AS step, (480 * 4 * l_linenumber // 8)::INT AS bar_ticks,
 (l_linenumber / 8.0 * 4)::FLOAT AS beats, floor(greatest(0.0, least(5.0, log2(greatest(floor(l_quantity) / 3, 1e-6)) + 1)))::INT AS duration_level,
 (greatest(least(l_linenumber, 10), 1) - 1)::INT AS polyphony_bin, (floor(floor((l_partkey % 128) / (128 / 31.0)) + CASE WHEN l_partkey % 128 > 0 THEN 1 ELSE 0 END))::INT AS velocity_level, round(l_linenumber / 8.0 * 1000)::INT AS beat_code,
 l_linenumber IN (0, 1, 2, 8, 11) AS drum, l_linenumber <= 7 AS opz FROM lineitem""")
def scalar_levels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line, part, tpq, spq = F.col("l_linenumber"), F.col("l_partkey"), F.lit(480), F.lit(12)
    return li.select(
        "l_orderkey", "l_linenumber", S.quantize_beat(part, tpq, spq).alias("snapped"), S.quantize_step(part, tpq, spq).alias("step"), S.bar_ticks(tpq, line, F.lit(8)).alias("bar_ticks"), S.beat_length(line, F.lit(8)).alias("beats"),
        S.duration_level(F.floor("l_quantity")).alias("duration_level"), S.polyphony_bin(line).alias("polyphony_bin"), S.velocity_level(part % 128).alias("velocity_level"), S.integer_beat_length(line, F.lit(8)).alias("beat_code"),
        S.is_drum_track(line).alias("drum"), S.is_opz_track(line).alias("opz"),
    )


@query(f"""SELECT p_partkey, {expected.DENSE_GROUPS}[p_partkey % 128 + 1] AS dense_group, {expected.GROUP_PROGRAMS}[p_partkey % 128 + 1] AS group_program,
 {expected.DRUM_TYPES}[p_partkey % 128 + 1] AS drum_type, {expected.PROGRAM_TYPES}[p_partkey % 128 + 1] AS inst_type FROM part""")
def instrument_lookups(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    i = (F.col("p_partkey") % 128).cast("int")
    return p.select("p_partkey", S.instrument_group(i, True).alias("dense_group"), S.instrument_group(i, False).alias("group_program"), S.opz_track_type(F.lit(9), i, i).alias("drum_type"), S.opz_track_type(F.lit(0), i, i).alias("inst_type"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_partkey / 480::DOUBLE * 12 * 2 + 0.5)::INT AS second_step, round((l_partkey - 700) / 480::DOUBLE * 12)::INT AS from_bar, (l_partkey // 480)::INT AS whole_quarters, greatest(2, least(l_linenumber, 5))::INT AS clipped,
([1, 2, 3, 5, 8, 13, 21, 34, 55, 89])[l_linenumber + 1]::INT AS target, CASE WHEN l_partkey % 3 > 0 THEN 99 ELSE 0 END::INT AS flat, (l_partkey % 128 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE -5 END)::INT AS moved, round(l_linenumber / 8::DOUBLE * 9)::INT AS rest,
CASE WHEN l_quantity <= 10 THEN 'CONDITION' WHEN l_quantity > 40 THEN 'RESAMPLE' ELSE 'INFILL' END AS kind, ((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 40)::INT)::INT AS selected,
CASE WHEN l_linenumber = 1 THEN 'GENRE = rock' WHEN l_linenumber = 2 THEN 'TIME_SIGNATURE = 3/4' ELSE 'BAR = ' || l_linenumber END AS told, round(6e7 / (l_partkey + 1), 6)::DOUBLE AS bpm, round((l_partkey + 1) / 1e6 / 480, 12)::DOUBLE AS per_tick FROM lineitem""")
def scalar_rules(spark, sf_dir):
    """Rules that scalar_levels has not."""
    li = table(spark, sf_dir, "lineitem")
    line, part, q, tpq, spq = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int"), F.col("l_quantity"), F.lit(480), F.lit(12)
    selected = F.array(q > 10, q > 20, q > 40)
    kind = F.when(line == 1, "GENRE").when(line == 2, "TIME_SIGNATURE").otherwise("BAR")
    told = S.pretty(kind, line, F.when(line == 1, "rock"), F.when(line == 2, 3), F.when(line == 2, 4))
    return li.select(
        "l_orderkey", "l_linenumber", S.quantize_second(part, tpq, spq, F.lit(2)).alias("second_step"), S.relative_step(part, F.lit(700), tpq, spq).alias("from_bar"), S.beat_length_truncated(part, tpq).alias("whole_quarters"), S.clip(line, F.lit(2), F.lit(5)).alias("clipped"),
        S.density_target(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)]), line).alias("target"), S.flatten_velocity(part % 3, 99).alias("flat"), S.transpose(part % 128, line % 2 == 0, F.lit(-5)).alias("moved"), S.rest_token(line / 8, 10).alias("rest"),
        S.selection_kind(selected).alias("kind"), S.count_selected(selected).alias("selected"), told.alias("told"), _r(S.tempo_bpm(part + 1)).alias("bpm"), _r(S.seconds_per_tick(part + 1, tpq), 12).alias("per_tick"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s = 255 THEN CASE m WHEN 1 THEN 'text' WHEN 2 THEN 'copyright' WHEN 3 THEN 'track_name' WHEN 4 THEN 'instrument_name' WHEN 5 THEN 'lyric' WHEN 6 THEN 'marker' WHEN 7 THEN 'cue' WHEN 47 THEN 'end_of_track' WHEN 81 THEN 'tempo' WHEN 88 THEN 'time_signature' WHEN 89 THEN 'key_signature' ELSE 'meta' END
WHEN s < 144 OR s < 160 AND p2 = 0 THEN 'note_off' WHEN s < 160 THEN 'note_on' WHEN s < 176 THEN 'aftertouch' WHEN s < 192 THEN CASE WHEN p1 IN (64, 67) THEN CASE p1 WHEN 64 THEN 'sustain' ELSE 'soft' END || CASE WHEN p2 >= 64 THEN '_on' ELSE '_off' END ELSE 'controller' END
WHEN s < 208 THEN 'patch_change' WHEN s < 224 THEN 'pressure' WHEN s < 240 THEN 'pitch_bend' ELSE 'system' END AS kind FROM (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN 255 ELSE 128 + l_partkey % 127 END AS s, l_suppkey % 70 AS p1, l_linenumber * 20 % 128 - CASE WHEN l_linenumber = 1 THEN 20 ELSE 0 END AS p2, l_partkey % 90 AS m FROM lineitem)""")
def message_kinds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line, part, supp = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    status = F.when(supp % 4 == 0, 255).otherwise(part % 127 + 128)
    p2 = line * 20 % 128 - F.when(line == 1, 20).otherwise(0)
    return li.select("l_orderkey", "l_linenumber", S.message_kind(status, supp % 70, p2, part % 90).alias("kind"))


# --- pairing ---


@query('SELECT piece_id, track, pitch, "start", "end", velocity FROM nt')
def paired_notes(spark, sf_dir):
    return notes(spark, sf_dir)


@query("SELECT piece_id, track, pseq AS onset_seq, seq AS offset_seq FROM evl WHERE velocity = 0 AND pvel > 0")
def linked_events(spark, sf_dir):
    return N.link_events(events(spark, sf_dir))


@query(""", r AS (SELECT *, sum(CASE WHEN velocity > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id, track, pitch ORDER BY tick, onoff, seq ROWS UNBOUNDED PRECEDING) AS run FROM ev),
m AS (SELECT *, max(CASE WHEN velocity = 0 THEN tick END) OVER (PARTITION BY piece_id, track, pitch, run) AS l FROM r)
SELECT piece_id, track, pitch, tick, seq, coalesce(l - tick, 0)::INT AS duration FROM m WHERE velocity > 0""")
def note_durations(spark, sf_dir):
    return N.note_durations(events(spark, sf_dir)).select("piece_id", "track", "pitch", "tick", "seq", "duration")


@query("SELECT piece_id, track, pitch, tick, velocity, seq FROM evl WHERE velocity = 0 OR nvel = 0")
def events_without_hanging_onsets(spark, sf_dir):
    return N.drop_hanging_onsets(events(spark, sf_dir)).select("piece_id", "track", "pitch", "tick", "velocity", "seq")


@query(""", o AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track, tick ORDER BY pitch DESC, seq DESC) AS r FROM ev WHERE velocity > 0),
x AS (SELECT *, lead(tick) OVER (PARTITION BY piece_id, track ORDER BY tick) AS nx FROM o WHERE r = 1),
c AS (SELECT x.piece_id, x.track, x.pitch, x.tick AS "start", x.velocity, least(min(f.tick), x.nx) AS "end" FROM x LEFT JOIN ev f ON f.velocity = 0 AND f.piece_id = x.piece_id AND f.track = x.track AND f.pitch = x.pitch AND f.tick > x.tick GROUP BY x.piece_id, x.track, x.pitch, x.tick, x.velocity, x.nx)
SELECT piece_id, track, pitch, "start", "end", velocity FROM c WHERE "end" IS NOT NULL""")
def monophonic_notes(spark, sf_dir):
    return N.force_monophonic(events(spark, sf_dir))


@query(""", x AS (SELECT *, CASE WHEN velocity > 0 THEN 1 ELSE -1 END AS d FROM ev),
s AS (SELECT *, sum(d) OVER w AS s FROM x WINDOW w AS (PARTITION BY piece_id, track, pitch ORDER BY tick, seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY piece_id, track, pitch ORDER BY tick, seq ROWS UNBOUNDED PRECEDING)) AS lo, least(0, min(s) OVER (PARTITION BY piece_id, track, pitch ORDER BY tick, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS plo FROM s),
l AS (SELECT *, CASE WHEN d = 1 THEN s - lo ELSE s - d - coalesce(plo, 0) END AS level FROM m),
p AS (SELECT *, lead(seq) OVER w AS t, lead(d) OVER w AS k FROM l WHERE level > 0 WINDOW w AS (PARTITION BY piece_id, track, pitch, level ORDER BY tick, seq))
SELECT piece_id, track, pitch, seq AS on_seq, t AS off_seq FROM p WHERE d = 1 AND k = -1""")
def lifo_pairs(spark, sf_dir):
    return N.link_lifo(events(spark, sf_dir), ["piece_id", "track", "pitch"], ["tick", "seq"], F.col("velocity") > 0, F.col("velocity") == 0)


# --- features ---

_ACTIVE = """, s AS (SELECT piece_id, track, unnest(range("start", least("end", max_tick - 1))) AS step FROM nt JOIN ln USING (piece_id, track)),
a AS (SELECT piece_id, track, step, count(*) AS active FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track ORDER BY active) - 1 AS i, count(*) OVER (PARTITION BY piece_id, track) AS n FROM a),
f AS (SELECT piece_id, track, sum(active) AS total, count(*) AS n, min(active) AS mn, max(active) AS mx, max(CASE WHEN i = least(round(n * 0.15::DOUBLE), n - 1) THEN active END) AS q1, max(CASE WHEN i = least(round(n * 0.85::DOUBLE), n - 1) THEN active END) AS q2 FROM k GROUP BY piece_id, track)
"""


@query(""", s AS (SELECT piece_id, track, unnest(range("start", "end")) AS step FROM nt), a AS (SELECT piece_id, track, step, count(*) AS n FROM s GROUP BY ALL)
SELECT piece_id, track, max(n)::INT AS max_polyphony FROM a GROUP BY piece_id, track""")
def max_polyphony(spark, sf_dir):
    return A.max_polyphony(notes(spark, sf_dir))


@query(_ACTIVE + """SELECT ln.piece_id, ln.track, round(coalesce(total, 0) / greatest(coalesce(n, 0), 1), 6)::DOUBLE AS av_polyphony, round((max_tick - coalesce(n, 0)) / greatest(max_tick, 1), 6)::DOUBLE AS silence, coalesce(q1, 0)::INT AS min_polyphony_q,
 coalesce(q2, 0)::INT AS max_polyphony_q, coalesce(mn, 0)::INT AS min_polyphony, coalesce(mx, 0)::INT AS max_polyphony FROM ln LEFT JOIN f USING (piece_id, track)""")
def polyphony_features(spark, sf_dir):
    n = notes(spark, sf_dir)
    return A.polyphony(n, lengths(n)).withColumns({"av_polyphony": _r(F.col("av_polyphony")), "silence": _r(F.col("silence"))})


@query(""", l AS (SELECT piece_id, track, "end" - "start" AS d, floor(greatest(0.0, least(5.0, log2(greatest(("end" - "start") / 3, 1e-6)) + 1)))::INT AS v FROM nt),
k AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY piece_id, track) AS n FROM l)
SELECT piece_id, track, round(avg(d), 6) AS note_duration, max(CASE WHEN i = least(round(n * 0.15::DOUBLE), n - 1) THEN v END) AS min_duration_q, max(CASE WHEN i = least(round(n * 0.85::DOUBLE), n - 1) THEN v END) AS max_duration_q, min(v) AS min_duration_hard, max(v) AS max_duration_hard FROM k GROUP BY piece_id, track""")
def duration_features(spark, sf_dir):
    return A.durations(notes(spark, sf_dir)).withColumn("note_duration", _r(F.col("note_duration")))


@query(""", c AS (SELECT piece_id, track, bar, count(*) AS n FROM ev WHERE velocity > 0 GROUP BY ALL) SELECT ab.piece_id, ab.track, ab.bar, coalesce(n, 0)::BIGINT AS n FROM ab LEFT JOIN c USING (piece_id, track, bar)""")
def bar_density(spark, sf_dir):
    return A.bar_density(events(spark, sf_dir), all_bars(spark, sf_dir))


_DENS = """, c AS (SELECT piece_id, track, count(*) AS onsets, count(DISTINCT bar) AS bars FROM ev WHERE velocity > 0 GROUP BY ALL), d AS (SELECT *, onsets / greatest(bars, 1) AS density FROM c),
bc AS (SELECT piece_id, track, bar, count(*) AS n FROM ev WHERE velocity > 0 GROUP BY ALL),
q AS (SELECT CASE WHEN track % 5 = 0 THEN 128 ELSE track * 7 % 128 END AS inst, quantile_cont(n, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM bc GROUP BY ALL)
"""


@query(_DENS + "SELECT piece_id, track, onsets, bars, round(density, 6) AS density, len([x FOR x IN q IF floor(x) < round(density)])::INT AS bin FROM d JOIN q ON q.inst = CASE WHEN track % 5 = 0 THEN 128 ELSE track * 7 % 128 END")
def density_bins(spark, sf_dir):
    e = events(spark, sf_dir)
    inst = F.when(F.col("track") % 5 == 0, 128).otherwise((F.col("track") * 7 % 128)).cast("int")
    counts = e.where("velocity > 0").groupBy("piece_id", "track", "bar").agg(F.count(F.lit(1)).alias("n")).withColumn("inst", inst)
    q = A.corpus_density_quantiles(counts, ["inst"])
    return A.density_bins(A.note_density(e).withColumn("inst", inst), q, ["inst"]).select("piece_id", "track", "onsets", "bars", _r(F.col("density")).alias("density"), "bin")


@query(_DENS + "SELECT inst::INT AS inst, array_to_string([floor(x)::INT FOR x IN q] || [1073741824], ',') AS quantiles, array_to_string([list_position([floor(x)::INT FOR x IN q] || [1073741824], y) - 1 FOR y IN [floor(x)::INT FOR x IN q] || [1073741824]], ',') AS first_equal FROM q")
def corpus_density_quantiles(spark, sf_dir):
    inst = F.when(F.col("track") % 5 == 0, 128).otherwise((F.col("track") * 7 % 128)).cast("int")
    counts = events(spark, sf_dir).where("velocity > 0").groupBy("piece_id", "track", "bar").agg(F.count(F.lit(1)).alias("n")).withColumn("inst", inst)
    q = A.corpus_density_quantiles(counts, ["inst"])
    return q.select("inst", _listed("quantiles"), _listed(A.first_equal(q["quantiles"]), "first_equal"))


@query(""", h AS (SELECT piece_id, track, bar, bool_or(velocity > 0) AS h FROM ev GROUP BY ALL) SELECT ab.piece_id, ab.track, ab.bar, coalesce(h, false) AS has_notes FROM ab LEFT JOIN h USING (piece_id, track, bar)""")
def bar_has_notes(spark, sf_dir):
    return A.has_notes(events(spark, sf_dir), all_bars(spark, sf_dir))


@query(""", s AS (SELECT piece_id, track, bar, unnest(range(time, least(time + duration, 47))) AS step FROM bn), a AS (SELECT piece_id, track, bar, step, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT piece_id, track, bar, sum(n) AS t, count(*) AS n FROM a GROUP BY ALL),
d AS (SELECT piece_id, track, bar, avg(duration) AS d FROM bn GROUP BY ALL)
SELECT piece_id, track, bar, round(coalesce(t, 0) / greatest(coalesce(n, 0), 1), 6)::DOUBLE AS av_polyphony, round((48 - coalesce(n, 0)) / 48, 6)::DOUBLE AS silence, round(d, 6) AS note_duration, round(d / 48, 6) AS note_duration_norm FROM d LEFT JOIN f USING (piece_id, track, bar)""")
def bar_features(spark, sf_dir):
    n = bar_notes(spark, sf_dir).select("piece_id", "track", "bar", "pitch", F.col("time").alias("start"), (F.col("time") + F.col("duration")).alias("end"))
    b = n.select("piece_id", "track", "bar").distinct().withColumn("max_tick", F.lit(BAR))
    return A.bar_features(n, b).select("piece_id", "track", "bar", *[_r(F.col(c)).alias(c) for c in ("av_polyphony", "silence", "note_duration", "note_duration_norm")])


@query("SELECT piece_id, track, min(pitch) AS min_pitch, max(pitch) AS max_pitch FROM ev WHERE velocity > 0 GROUP BY ALL")
def pitch_range(spark, sf_dir):
    e = events(spark, sf_dir)
    return A.pitch_range(e, e.select("piece_id", "track").distinct())


@query("SELECT piece_id, track, array_to_string([list_contains(list(pitch % 12), i) FOR i IN range(0, 12)], ',') AS pitch_classes FROM ev WHERE velocity > 0 GROUP BY ALL")
def pitch_classes(spark, sf_dir):
    return A.pitch_classes(events(spark, sf_dir)).select("piece_id", "track", _listed("pitch_classes"))


@query("SELECT piece_id, min(pitch) AS low, max(pitch) AS high FROM ev WHERE track % 5 <> 0 GROUP BY ALL")
def pitch_extents(spark, sf_dir):
    return A.pitch_extents(events(spark, sf_dir), F.col("track") % 5 == 0)


@query(""", g AS (SELECT piece_id, tick % 12 AS k, count(*) AS n FROM ev WHERE velocity > 0 GROUP BY ALL), p AS (SELECT DISTINCT piece_id FROM g), r AS (SELECT piece_id, unnest(range(0, 12)) AS k FROM p)
SELECT r.piece_id, array_to_string(list(coalesce(n, 0)::BIGINT ORDER BY r.k), ',') AS counts FROM r LEFT JOIN g USING (piece_id, k) GROUP BY r.piece_id""")
def onset_distribution(spark, sf_dir):
    return A.onset_distribution(events(spark, sf_dir), 12).select("piece_id", _listed("counts"))


@query("SELECT piece_id, " + ", ".join(f"round(avg(CASE WHEN {12 // g == 0} OR tick % {max(12 // g, 1)} = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS grid_{g}" for g in A.GRIDS) + " FROM ev WHERE velocity > 0 GROUP BY ALL")
def quantize_info(spark, sf_dir):
    df = A.quantize_info(events(spark, sf_dir), RESOLUTION)
    return df.select("piece_id", *[_r(F.col(f"grid_{g}")).alias(f"grid_{g}") for g in A.GRIDS])


# --- time ---


@query(""", sg AS (SELECT DISTINCT o_custkey::INT AS piece_id, (o_orderkey % 40 * 100)::INT AS tick, (o_orderkey % 5 + 2)::INT AS num, (CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 8 END)::INT AS den FROM orders),
e AS (SELECT piece_id, (max(tick) + 5000)::INT AS max_tick FROM sg GROUP BY ALL), z AS (SELECT piece_id, tick, num, den, 1 AS g FROM sg UNION ALL SELECT piece_id, 0, 4, 4, 0 FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY piece_id, tick ORDER BY g DESC, num DESC, den DESC) AS r FROM z), c AS (SELECT b.piece_id, tick, num, den, max_tick, (480 * 4 * num // den)::INT AS len FROM b JOIN e USING (piece_id) WHERE r = 1 AND tick < max_tick),
n AS (SELECT *, coalesce(lead(tick) OVER (PARTITION BY piece_id ORDER BY tick), max_tick) AS nx FROM c), x AS (SELECT *, unnest(range(tick, nx, len))::INT AS start_tick FROM n)
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY start_tick) - 1)::INT AS bar, start_tick, least(len, nx - start_tick)::INT AS ticks, num AS ts_num, den AS ts_den, (num / den * 4)::FLOAT AS beat_length FROM x""")
def bar_grid(spark, sf_dir):
    sig, ends = _signatures(spark, sf_dir)
    return B.bar_grid(sig, ends)


def _signatures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sig = o.select(F.col("o_custkey").cast("int").alias("piece_id"), (k % 40 * 100).cast("int").alias("tick"), (k % 5 + 2).cast("int").alias("ts_num"), F.when(k % 2 == 0, 4).otherwise(8).alias("ts_den")).distinct()
    return sig, sig.groupBy("piece_id").agg((F.max("tick") + 5000).cast("int").alias("max_tick")).withColumn("tpq", F.lit(480))


@query(""", g AS (SELECT piece_id, tick, max(bar) AS bar FROM (SELECT piece_id, unnest(range(0, m + 50, 50))::INT AS tick, unnest(range(0, (m + 49) // 50 + 1))::INT AS bar FROM (SELECT piece_id, max(tick) AS m FROM ev GROUP BY ALL)) GROUP BY ALL)
SELECT piece_id, track, seq, coalesce((CASE WHEN velocity = 0 THEN (tick - 1) // 50 ELSE tick // 50 END), NULL)::INT AS bar, (tick - 50 * (CASE WHEN velocity = 0 THEN (tick - 1) // 50 ELSE tick // 50 END))::INT AS time FROM ev""")
def events_in_bars(spark, sf_dir):
    e = events(spark, sf_dir).drop("bar", "time")
    grid = e.groupBy("piece_id").agg(F.max("tick").alias("m")).select("piece_id", F.posexplode(F.sequence(F.lit(0), F.col("m"), F.lit(50))).alias("bar", "start_tick"))
    return B.events_to_bars(e, grid).select("piece_id", "track", "seq", "bar", (F.col("tick") - F.col("bar_start")).cast("int").alias("time"))


@query(""", p AS (SELECT user_id AS piece_id, event_id AS seq, CASE WHEN event_type = 'click' THEN (event_id % 128)::INT END AS patch, event_type FROM events)
SELECT piece_id, seq, coalesce(last_value(patch IGNORE NULLS) OVER (PARTITION BY piece_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0)::INT AS instrument FROM p""")
def patches_in_force(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("piece_id"), F.lit(0).alias("smf_track"), F.lit(0).alias("channel"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 192).otherwise(144).alias("status"), (F.col("event_id") % 128).cast("int").alias("p1"))
    return B.carry_patches(m).select("piece_id", "seq", "instrument")


@query(""", t AS (SELECT DISTINCT o_custkey AS piece_id, (o_orderkey % 50 * 480)::INT AS tick, (300000 + o_orderkey % 50 * 960)::INT AS micros FROM orders), z AS (SELECT * FROM t UNION ALL SELECT DISTINCT piece_id, 0, 500000 FROM (SELECT l_suppkey AS piece_id FROM lineitem UNION SELECT piece_id FROM t) WHERE piece_id NOT IN (SELECT piece_id FROM t WHERE tick = 0)),
m AS (SELECT *, (tick - lag(tick) OVER w) * (lag(micros) OVER w / 1e6 / 480) AS step FROM z WINDOW w AS (PARTITION BY piece_id ORDER BY tick)), s AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY piece_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS seconds FROM m),
q AS (SELECT l_suppkey AS piece_id, l_orderkey, l_linenumber, (l_partkey % 24000)::INT AS tick FROM lineitem)
SELECT q.piece_id, l_orderkey, l_linenumber, q.tick, round((seconds + (q.tick - s.tick) * micros / 1e6 / 480) * 480e6)::BIGINT AS tick_micros FROM q ASOF JOIN s ON q.piece_id = s.piece_id AND q.tick >= s.tick""")
def seconds_of_ticks(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("piece_id"), (k % 50 * 480).cast("int").alias("tick"), (k % 50 * 960 + 300000).cast("int").alias("micros")).distinct()
    q = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("piece_id"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 24000).cast("int").alias("tick"))
    files = t.select("piece_id").unionByName(q.select("piece_id")).distinct().withColumn("tpq", F.lit(480))
    return B.with_seconds(q, B.tempo_map(t, files)).select("piece_id", "l_orderkey", "l_linenumber", "tick", F.round(F.col("seconds") * 480e6).cast("long").alias("tick_micros"))


@query("SELECT piece_id, track, seq, (tick - coalesce(lag(tick) OVER (PARTITION BY piece_id, track ORDER BY tick, seq), 0))::INT AS delta FROM ev")
def delta_ticks(spark, sf_dir):
    return B.delta_ticks(events(spark, sf_dir), ["piece_id", "track"]).select("piece_id", "track", "seq", "delta")


# --- segments ---

_HAS = """, h AS (SELECT ab.piece_id, ab.track, ab.bar, coalesce(max(CASE WHEN velocity > 0 THEN 1 ELSE 0 END), 0) AS h FROM ab LEFT JOIN ev USING (piece_id, track, bar) GROUP BY ALL),
w AS (SELECT *, sum(h) OVER (PARTITION BY piece_id, track ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS f, max(bar) OVER (PARTITION BY piece_id) + 1 AS nb FROM h)
"""


@query(_HAS + "SELECT piece_id, bar AS \"start\", array_to_string(list(track ORDER BY track), ',') AS tracks FROM w WHERE bar <= nb - 4 AND f >= 3 GROUP BY piece_id, bar HAVING count(*) >= 2")
def valid_segments(spark, sf_dir):
    bars = A.has_notes(events(spark, sf_dir), all_bars(spark, sf_dir))
    return G.valid_segments(bars, 4, 2).select("piece_id", "start", _listed("tracks"))


def _unit(text: str) -> str:
    """SQL of a uniform number: the first 52 bits of an MD5."""
    return f"(('0x' || substr(md5({text}), 1, 13))::UBIGINT / 4503599627370496)"


@query(_HAS + """, g AS (SELECT piece_id, bar AS "start", list(track ORDER BY track) AS tracks FROM w WHERE bar <= nb - 4 AND f >= 3 GROUP BY piece_id, bar HAVING count(*) >= 2),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY piece_id ORDER BY md5('7:' || piece_id || ':' || "start"), "start") = 1), u AS (SELECT piece_id, "start", unnest(tracks) AS track, unnest(range(0, len(tracks))) AS i FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY md5('7:' || piece_id || ':' || i), i) AS n FROM u) SELECT piece_id, "start", string_agg(track::VARCHAR, ',' ORDER BY n) AS tracks FROM r WHERE n <= 3 GROUP BY ALL""")
def selected_segments(spark, sf_dir):
    bars = A.has_notes(events(spark, sf_dir), all_bars(spark, sf_dir))
    return G.select_segments(G.valid_segments(bars, 4, 2), 7, 3).select("piece_id", "start", _listed("tracks"))


@query(f""", x AS (SELECT piece_id, min(pitch) AS low, max(pitch) AS high FROM ev WHERE track % 5 <> 0 GROUP BY ALL), l AS (SELECT *, [t FOR t IN range(-6, 6) IF low + t >= 0 AND high + t <= 127] AS ok FROM x)
SELECT piece_id, low, high, coalesce(ok[floor({_unit("'3:' || piece_id")} * len(ok))::INT + 1], 0)::INT AS transpose FROM l""")
def transposed_pieces(spark, sf_dir):
    return G.select_transpose(A.pitch_extents(events(spark, sf_dir), F.col("track") % 5 == 0), 3)


@query(f""", r AS (SELECT *, count(*) OVER (PARTITION BY piece_id) AS n, row_number() OVER (PARTITION BY piece_id ORDER BY md5('5:' || piece_id || ':' || track || ':' || bar), track, bar) AS r FROM ab)
SELECT piece_id, track, bar FROM r WHERE r <= floor({_unit("'6:' || piece_id")} * greatest(round(n * 0.75::DOUBLE), 1))""")
def bars_to_fill(spark, sf_dir):
    return G.bar_mask(all_bars(spark, sf_dir), 0.75, 5)


@query(f""", c AS (SELECT *, ("end" - 1) // 48 = "start" // 48 AS can FROM nt), r AS (SELECT *, sum(can::INT) OVER (PARTITION BY piece_id) AS n, row_number() OVER (PARTITION BY piece_id ORDER BY can DESC, md5('9:' || piece_id || ':' || track || ':' || "start" || ':' || pitch), track, "start", pitch) AS r FROM c)
SELECT piece_id, track, CASE WHEN can AND r <= greatest(floor(n * 0.25::DOUBLE), 1) THEN floor({_unit("'10:' || piece_id || ':' || track || ':' || \"start\" || ':' || pitch")} * 128)::INT ELSE pitch END AS pitch, "start", "end", velocity, CASE WHEN n < greatest(floor(n * 0.25::DOUBLE), 1) THEN 'not enough notes' END AS problem FROM r""")
def perturbed_notes(spark, sf_dir):
    return G.perturb(notes(spark, sf_dir), 0.25, 9)


# --- whole pieces ---


@query("SELECT piece_id, track, bar, seq, (row_number() OVER (PARTITION BY piece_id ORDER BY tick, onoff, pitch, track, seq) - 1)::INT AS pos FROM ev")
def sorted_events(spark, sf_dir):
    return N.reindex(events(spark, sf_dir)).select("piece_id", "track", "bar", "seq", "pos")


@query(""", l AS (SELECT * FROM (VALUES (3, 0), (1, 1), (3, 2), (99, 3)) v(t, i)), b AS (SELECT * FROM (VALUES (5, 0), (2, 1)) v(b, j)), x AS (SELECT piece_id, i, j, seq FROM bn JOIN l ON track = t JOIN b ON bar = b)
SELECT piece_id, (dense_rank() OVER (PARTITION BY piece_id ORDER BY i) - 1)::INT AS track, j::INT AS bar, seq FROM x""")
def pruned_tracks(spark, sf_dir):
    return P.prune_tracks(bar_notes(spark, sf_dir), [3, 1, 3, 99], [5, 2]).select("piece_id", "track", "bar", "seq")


@query("SELECT piece_id, track, bar, seq FROM ev WHERE (piece_id, track) IN (SELECT piece_id, track FROM ev WHERE velocity > 0 AND bar IN (0, 1))")
def tracks_with_notes(spark, sf_dir):
    return P.prune_empty_tracks(events(spark, sf_dir), [0, 1]).select("piece_id", "track", "bar", "seq")


@query("SELECT piece_id, track, seq FROM ev WHERE seq // 2 NOT IN (SELECT event_id FROM src WHERE dur < 10)")
def pruned_events(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("event_id", F.expr("seq div 2"))
    return P.prune_events(e, source_notes(spark, sf_dir).where("dur < 10").select("event_id"), ["event_id"]).select("piece_id", "track", "seq")


@query("SELECT piece_id, ([0, 3, 1, 2, 6, 5, 4, 7][track + 1])::INT AS track, bar, seq FROM bn")
def reordered_tracks(spark, sf_dir):
    order = F.array(*map(F.lit, [0, 3, 1, 2, 6, 5, 4, 7]))
    return P.reorder_tracks(bar_notes(spark, sf_dir), order).select("piece_id", "track", "bar", "seq")


@query(""", s AS (SELECT piece_id, max(track) + 1 AS t, max(bar) + 1 AS b FROM ev GROUP BY ALL)
SELECT piece_id, track, bar, seq FROM ev UNION ALL SELECT bn.piece_id, (bn.track + coalesce(t, 0))::INT, bn.bar, bn.seq FROM bn LEFT JOIN s ON s.piece_id = bn.piece_id WHERE b IS NULL OR bn.bar < b""")
def appended_pieces(spark, sf_dir):
    c = ["piece_id", "track", "bar", "seq"]
    return P.append_piece(events(spark, sf_dir).select(c), bar_notes(spark, sf_dir).select(c))


@query(""", b AS (SELECT DISTINCT piece_id, track, bar FROM bn), s AS (SELECT DISTINCT piece_id, (track + 2)::INT AS track FROM bn), w AS (SELECT piece_id, track, unnest(range(0, 16))::INT AS bar FROM s)
SELECT coalesce(w.piece_id, b.piece_id) AS piece_id, coalesce(w.track, b.track) AS track, coalesce(w.bar, b.bar) AS bar, CASE WHEN b.piece_id IS NULL THEN 4.0 ELSE 3.0 END::DOUBLE AS beat_length FROM w FULL JOIN b ON w.piece_id = b.piece_id AND w.track = b.track AND w.bar = b.bar""")
def padded_pieces(spark, sf_dir):
    b = bar_notes(spark, sf_dir).select("piece_id", "track", "bar").distinct().withColumn("beat_length", F.lit(3.0).cast("double"))
    s = b.select("piece_id", (F.col("track") + 2).alias("track"), F.lit(16).alias("n_bars")).distinct()
    return P.pad_with_status(b, s, 4)


@query(""", m AS (SELECT DISTINCT piece_id, 1 AS st, 3 AS sb, 2 AS dt, 5 AS db FROM bn)
SELECT piece_id, track, bar, seq FROM bn WHERE NOT (track = 2 AND bar = 5) UNION ALL SELECT piece_id, 2, 5, seq FROM bn WHERE track = 1 AND bar = 3""")
def inserted_bars(spark, sf_dir):
    n = bar_notes(spark, sf_dir).select("piece_id", "track", "bar", "seq")
    m = n.select("piece_id").distinct().withColumns({"src_track": F.lit(1), "src_bar": F.lit(3), "dst_track": F.lit(2), "dst_bar": F.lit(5)})
    return P.insert_bars(n, n, m)


@query("SELECT piece_id, 'duration' AS field, duration::DOUBLE AS value FROM bn WHERE duration NOT BETWEEN 5 AND 40 UNION ALL SELECT piece_id, 'pitch', pitch::DOUBLE FROM bn WHERE pitch NOT BETWEEN 21 AND 108")
def range_violations(spark, sf_dir):
    return P.range_violations(bar_notes(spark, sf_dir), {"duration": (5, 40), "pitch": (21, 108)})


@query("SELECT piece_id, track, seq FROM ev WHERE (velocity > 0 AND time >= 36) OR (velocity = 0 AND time > 36)")
def event_violations(spark, sf_dir):
    return P.event_violations(events(spark, sf_dir), F.lit(36)).select("piece_id", "track", "seq")


@query(""", n AS (SELECT piece_id, track, count(DISTINCT bar) AS n FROM bn GROUP BY ALL) SELECT piece_id, min(n) AS least, max(n) AS most FROM n GROUP BY ALL HAVING min(n) < max(n)""")
def unequal_lengths(spark, sf_dir):
    return P.unequal_lengths(bar_notes(spark, sf_dir))


@query("SELECT piece_id, bar, count(DISTINCT duration % 3) AS signatures FROM bn GROUP BY ALL HAVING count(DISTINCT duration % 3) > 1")
def unequal_signatures(spark, sf_dir):
    b = bar_notes(spark, sf_dir).select("piece_id", "bar", (F.col("duration") % 3).alias("ts_num"), F.lit(4).alias("ts_den"))
    return P.unequal_signatures(b)


@query(""", l AS (SELECT piece_id, track, pitch, count(*) AS n FROM bn GROUP BY ALL), r AS (SELECT piece_id, track, CASE WHEN piece_id % 2 = 0 AND track = 1 THEN (pitch + 1) % 128 ELSE pitch END AS pitch, count(*) AS n FROM bn GROUP BY ALL)
SELECT piece_id, track, bool_and(coalesce(a, 0) = coalesce(b, 0)) AS identical FROM (SELECT coalesce(l.piece_id, r.piece_id) AS piece_id, coalesce(l.track, r.track) AS track, l.n AS a, r.n AS b FROM l FULL JOIN r ON l.piece_id = r.piece_id AND l.track = r.track AND l.pitch = r.pitch) GROUP BY ALL""")
def identical_tracks(spark, sf_dir):
    n = bar_notes(spark, sf_dir).select("piece_id", "track", "pitch")
    other = n.withColumn("pitch", F.when((F.col("piece_id") % 2 == 0) & (F.col("track") == 1), (F.col("pitch") + 1) % 128).otherwise(F.col("pitch")))
    return P.identical_tracks(n, other, ["pitch"])


# --- rolls and sketches ---


@query(""", c AS (SELECT DISTINCT piece_id, track, pitch, unnest(range("start", "end")) AS step FROM nt)
SELECT piece_id, track, step::INT AS step, coalesce(bit_or(CASE WHEN pitch < 63 THEN 1::BIGINT << pitch::INT WHEN pitch = 63 THEN (-9223372036854775807 - 1)::BIGINT END), 0)::BIGINT AS low, coalesce(bit_or(CASE WHEN pitch BETWEEN 64 AND 126 THEN 1::BIGINT << (pitch - 64)::INT WHEN pitch = 127 THEN (-9223372036854775807 - 1)::BIGINT END), 0)::BIGINT AS high FROM c GROUP BY piece_id, track, step""")
def bit_roll(spark, sf_dir):
    return R.bit_roll(R.roll(notes(spark, sf_dir)))


@query("""SELECT DISTINCT piece_id, track, (x // 48)::INT AS bar, (x % 48)::INT AS step, pitch FROM (SELECT piece_id, track, pitch, unnest(range("start", "end")) AS x FROM nt)""")
def bar_roll(spark, sf_dir):
    return R.bar_roll(notes(spark, sf_dir)).select("piece_id", "track", "bar", "step", "pitch")


def _min_hash_sql(seeds: list[int]) -> str:
    """Least XXH32 of the eight-byte shingles of documents; one step of the public algorithm a subquery."""
    seeds_list = ", ".join(f"({s})" for s in seeds)
    turned = lambda x, n: f"((({x} << {n}) | ({x} >> {32 - n})) % 4294967296)"
    return f""", w AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS w FROM documents),
    t AS (SELECT doc_id, [('0x' || w[i + 3] || w[i + 2] || w[i + 1] || w[i])::UBIGINT FOR i IN range(1, len(w) - 2)] AS x FROM w),
    l AS (SELECT doc_id, unnest(x[1:len(x) - 4]) AS a, unnest(x[5:len(x)]) AS b FROM t WHERE len(x) > 4),
    s AS (SELECT doc_id, seed, (seed + 374761401 + a * 3266489917 % 4294967296) % 4294967296 AS h, b FROM l, (VALUES {seeds_list}) v(seed)),
    s2 AS (SELECT doc_id, seed, ({turned("h", 17)} * 668265263 % 4294967296 + b * 3266489917 % 4294967296) % 4294967296 AS h FROM s),
    s3 AS (SELECT doc_id, seed, {turned("h", 17)} * 668265263 % 4294967296 AS h FROM s2),
    s4 AS (SELECT doc_id, seed, xor(h, h >> 15) * 2246822519 % 4294967296 AS h FROM s3), s5 AS (SELECT doc_id, seed, xor(h, h >> 13) * 3266489917 % 4294967296 AS h FROM s4),
    m AS (SELECT doc_id, seed, min(xor(h, h >> 16))::BIGINT AS h FROM s5 GROUP BY ALL)
    SELECT doc_id, {", ".join(f"coalesce(max(CASE WHEN seed = {s} THEN h END), -1) AS h{s}" for s in seeds)} FROM t LEFT JOIN m USING (doc_id) GROUP BY doc_id"""


@query(_min_hash_sql([1, 2, 3, 4]))
def text_min_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    # texts of fewer than eight bytes have no shingle
    return R.min_hash(d, "data", [1, 2, 3, 4], 8).select("doc_id", *[F.when(F.length("data") >= 8, F.col("sketch")[i]).otherwise(-1).alias(f"h{i + 1}") for i in range(4)])


def _roll_hash_sql() -> str:
    """Least XXH32 of the sixteen-byte shingles of bars of rolls, 768 bytes each, for seeds 1 and 2; one step of the public algorithm a subquery."""
    turned = lambda x, n: f"((({x} << {n}) | ({x} >> {32 - n})) % 4294967296)"
    p1, p2, p3, all_ = 2654435761, 2246822519, 3266489917, 4294967296
    start = [f"(seed + {(p1 + p2) % all_})", f"(seed + {p2})", "seed", f"(seed + {all_ - p1})"]
    lanes = ", ".join(f"({a} + l{i} * {p2} % {all_}) % {all_} AS a{i}" for i, a in enumerate(start))
    mixed = " + ".join(turned(f"({turned(f'a{i}', 13)} * {p1} % {all_})", n) for i, n in enumerate((1, 7, 12, 18)))
    return f""", c AS (SELECT DISTINCT piece_id, track, x // 48 AS bar, x % 48 AS step, pitch FROM (SELECT piece_id, track, pitch, unnest(range("start", "end")) AS x FROM nt)),
y AS (SELECT piece_id, track, bar, step * 16 + pitch // 8 AS i, bit_or(1 << (pitch % 8)::INT)::UBIGINT AS v FROM c GROUP BY ALL), z AS (SELECT piece_id, track, bar, unnest(range(0, 768)) AS i FROM (SELECT DISTINCT piece_id, track, bar FROM c)),
b AS (SELECT piece_id, track, bar, i, coalesce(v, 0)::UBIGINT AS v FROM z LEFT JOIN y USING (piece_id, track, bar, i)),
l AS (SELECT *, v + lead(v, 1, 0) OVER w * 256 + lead(v, 2, 0) OVER w * 65536 + lead(v, 3, 0) OVER w * 16777216 AS l0 FROM b WINDOW w AS (PARTITION BY piece_id, track, bar ORDER BY i)),
s AS (SELECT *, lead(l0, 4) OVER w AS l1, lead(l0, 8) OVER w AS l2, lead(l0, 12) OVER w AS l3 FROM l WINDOW w AS (PARTITION BY piece_id, track, bar ORDER BY i)),
s1 AS (SELECT piece_id, track, bar, seed, {lanes} FROM s, (VALUES (1::UBIGINT), (2::UBIGINT)) v(seed) WHERE i <= 752),
s2 AS (SELECT piece_id, track, bar, seed, ({mixed} + 16) % {all_} AS h FROM s1), s3 AS (SELECT *, xor(h, h >> 15) * {p2} % {all_} AS g FROM s2), s4 AS (SELECT *, xor(g, g >> 13) * {p3} % {all_} AS f FROM s3),
m AS (SELECT piece_id, track, bar, seed, min(xor(f, f >> 16))::BIGINT AS h FROM s4 GROUP BY ALL)
SELECT piece_id, track, bar::INT AS bar, max(CASE WHEN seed = 1 THEN h END) AS h1, max(CASE WHEN seed = 2 THEN h END) AS h2 FROM m GROUP BY ALL"""


@query(_roll_hash_sql())
def roll_min_hash(spark, sf_dir):
    out = R.roll_min_hash(R.bar_roll(notes(spark, sf_dir)), [1, 2], 16)
    return out.select("piece_id", "track", "bar", *[F.col("sketch")[i].alias(f"h{i + 1}") for i in range(2)])


# --- tokens ---

_DOMAINS = ", ".join(f"('{n}', {i}, '{k}', {size})" for n, domains in expected.DOMAINS.items() for i, (k, size) in enumerate(domains))


@query(f""", d AS (SELECT * FROM (VALUES {_DOMAINS}) v(encoder, i, token_type, n)) SELECT encoder, token_type, (sum(n) OVER (PARTITION BY encoder ORDER BY i ROWS UNBOUNDED PRECEDING) - n)::INT AS first_token, n::INT AS n_tokens FROM d""")
def vocabulary_layout(spark, sf_dir):
    v = vocab.vocabulary(spark)
    return v.groupBy("encoder", "token_type").agg(F.min("token").alias("first_token"), F.count_distinct("token").cast("int").alias("n_tokens"))


@query(""", g AS (SELECT *, time - coalesce(lag(time) OVER (PARTITION BY piece_id, track, bar ORDER BY time, pitch, seq), 0) AS gap FROM bn),
v AS (SELECT *, floor(floor(((seq % 127 + 1)::INT) / (128 / 31.0)) + 1)::INT AS lv FROM g), c AS (SELECT *, (lv IS DISTINCT FROM lag(lv) OVER (PARTITION BY piece_id, track, bar ORDER BY time, pitch, seq)) AS new FROM v),
z AS (SELECT piece_id, track, bar, seq, CASE WHEN gap > 0 THEN list_concat([9 FOR x IN range(0, (gap - 1) // 10)], [gap - (gap - 1) // 10 * 10 - 1]) ELSE [] END::INT[] AS cl, new FROM c)
SELECT piece_id, track, bar, seq, array_to_string(cl, ',') AS clock, new FROM z""")
def time_and_velocity_tokens(spark, sf_dir):
    keys, order = ["piece_id", "track", "bar"], ["time", "pitch", "seq"]
    df = E.time_tokens(bar_notes(spark, sf_dir), keys, order, False, 10)
    level = S.velocity_level((F.col("seq") % 127 + 1).cast("int"))
    new = ~level.eqNullSafe(F.lag(level).over(Window.partitionBy(*keys).orderBy(*order)))
    return df.select(*keys, "seq", _listed("clock"), new.alias("new"))


def _token_inputs(spark, sf_dir):
    """Tracks, bars and events of pieces of 64 bars in 4/4, from line items."""
    n = bar_notes(spark, sf_dir)
    tracks = n.select("piece_id", "track").distinct().withColumns({
        "track_type": F.when(F.col("track") == 7, fixed.STANDARD_DRUM).otherwise(fixed.STANDARD), "instrument": (F.col("piece_id") * 7 % 128).cast("int"), "density_bin": F.lit(4), "genre": F.lit("rock"),
        **{c: F.lit(v) for c, v in (("min_polyphony", 1), ("max_polyphony", 3), ("min_note_duration", 1), ("max_note_duration", 4))},
    })
    bars = n.select("piece_id").distinct().select("piece_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bar")).withColumns({"ts_num": F.lit(4), "ts_den": F.lit(4)})
    ev = n.withColumn("velocity", (F.col("seq") % 127 + 1).cast("int"))
    return tracks, bars, ev


_SIZES = expected.DOMAINS["NEW_DURATION_ENCODER"]
_AT = {k: sum(size for _, size in _SIZES[:i]) for i, (k, _) in enumerate(_SIZES)}
_DURATION_SQL = f""", t AS (SELECT DISTINCT piece_id, track FROM bn), p AS (SELECT DISTINCT piece_id FROM bn), b AS (SELECT piece_id, track, unnest(range(0, 64)) AS bar FROM t),
g AS (SELECT *, time - coalesce(lag(time) OVER w, 0) AS gap, row_number() OVER w AS i FROM bn WHERE duration > 0 WINDOW w AS (PARTITION BY piece_id, track, bar ORDER BY time, pitch, seq)),
r AS (SELECT piece_id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS f, 0 AS h, {_AT['PIECE_START']} AS token FROM p
UNION ALL SELECT piece_id, 1, track, 0, 0, 0, 0, 0, {_AT['TRACK']} + CASE WHEN track = 7 THEN 1 ELSE 0 END FROM t
UNION ALL SELECT piece_id, 1, track, 0, 2, 0, 0, 0, {_AT['INSTRUMENT']} + piece_id * 7 % 128 FROM t
UNION ALL SELECT piece_id, 1, track, 0, 5, 0, 0, 0, {_AT['MIN_NOTE_DURATION']} + 1 FROM t
UNION ALL SELECT piece_id, 1, track, 0, 6, 0, 0, 0, {_AT['MAX_NOTE_DURATION']} + 4 FROM t
UNION ALL SELECT piece_id, 1, track, 1, bar, 0, 0, 0, {_AT['BAR']} FROM b
UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 0, {_AT['TIME_DELTA']} + gap - 1 FROM g WHERE gap > 0
UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 1, {_AT['NOTE_ONSET']} + pitch FROM g
UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 2, {_AT['NOTE_DURATION']} + least(duration, 96) - 1 FROM g
UNION ALL SELECT piece_id, 1, track, 1, bar, 9, 0, 0, {_AT['BAR_END']} FROM b
UNION ALL SELECT piece_id, 1, track, 2, 0, 0, 0, 0, {_AT['TRACK_END']} FROM t)
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY a, b, c, d, e, f, h) - 1)::INT AS idx, token::INT AS token FROM r"""


@query(_DURATION_SQL)
def encoded_durations(spark, sf_dir):
    return E.encode("NEW_DURATION_ENCODER", *_token_inputs(spark, sf_dir)).select("piece_id", "idx", "token")


@query()
def encoded_absolute_infill(spark, sf_dir):
    tracks, bars, ev = _token_inputs(spark, sf_dir)
    fills = ev.select("piece_id", "track", "bar").distinct().where("bar % 9 = 0")
    out = E.encode("ABSOLUTE_ENCODER", tracks, bars, ev, fills)
    return out.groupBy("piece_id", "token_type").agg(F.count(F.lit(1)).alias("n"), F.count("problem").alias("problems"))


@query("SELECT piece_id, track, bar, time, pitch, CASE WHEN track = 7 AND false THEN 1 ELSE least(duration, 96) END::INT AS duration FROM bn WHERE duration > 0")
def decoded_durations(spark, sf_dir):
    v = vocab.vocabulary(spark, ["NEW_DURATION_ENCODER"])
    tok = E.encode("NEW_DURATION_ENCODER", *_token_inputs(spark, sf_dir)).select("piece_id", "idx", "token").withColumn("encoder", F.lit("NEW_DURATION_ENCODER"))
    d = E.decode(vocab.decode_tokens(tok, v))
    ids = bar_notes(spark, sf_dir).select("piece_id", F.col("track").alias("_t")).distinct().withColumn("track", F.row_number().over(Window.partitionBy("piece_id").orderBy("_t")) - 1)
    return d.join(ids, ["piece_id", "track"]).select("piece_id", F.col("_t").alias("track"), "bar", "time", "pitch", "duration")


_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in expected.EDGES.items() for b in bs)


@query(f""", e AS (SELECT * FROM (VALUES {_EDGES}) v(a, b)), k AS (SELECT conv_id AS piece_id, turn AS idx, (['BAR', 'TIME_DELTA', 'NOTE_ONSET', 'NOTE_DURATION', 'BAR_END'])[length(text) % 5 + 1] AS a FROM conversations),
l AS (SELECT *, lead(a) OVER (PARTITION BY piece_id ORDER BY idx, a) AS b FROM k) SELECT piece_id, idx, a, b FROM l WHERE b IS NOT NULL AND (a, b) NOT IN (SELECT a, b FROM e)""")
def grammar_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(x) for x in ("BAR", "TIME_DELTA", "NOTE_ONSET", "NOTE_DURATION", "BAR_END")])
    t = c.select(F.col("conv_id").alias("piece_id"), F.col("turn").alias("idx"), F.element_at(kinds, (F.length("text") % 5 + 1).cast("int")).alias("token_type"))
    return grammar.violations(t, grammar.edge_table(spark, "NEW_DURATION_ENCODER"))


@query()
def interleaved_tokens(spark, sf_dir):
    e = events(spark, sf_dir)
    bars = e.select("piece_id", "bar").distinct()
    return E.encode_interleaved("TRACK_INTERLEAVED_W_HEADER_ENCODER", track_table(spark, sf_dir), bars, e).groupBy("piece_id", "token_type").agg(F.count(F.lit(1)).alias("n"))


# --- files and batches ---


def _files(spark, sf_dir) -> DataFrame:
    """(piece_id, content): MIDI files of twelve users each, with all their notes."""
    n = notes(spark, sf_dir).where("end > start").withColumns({"piece_id": F.expr("track div 12"), "track": F.expr("track % 12")})
    tracks = n.select("piece_id", "track").distinct().withColumns({"instrument": F.lit(0), "track_type": F.lit(fixed.STANDARD)})
    ends = F.array(F.struct(F.col("start").alias("tick"), F.col("velocity").alias("velocity")), F.struct(F.col("end").alias("tick"), F.lit(0).alias("velocity")))
    return smf.to_bytes(tracks, n.select("piece_id", "track", "pitch", F.explode(ends).alias("e")).select("piece_id", "track", "pitch", "e.*"))


_FILES = """, fn AS (SELECT (track // 12)::VARCHAR AS piece_id, track % 12 AS t, pitch, "start", "end", velocity FROM nt WHERE "end" > "start"),
fl AS (SELECT *, (dense_rank() OVER (PARTITION BY piece_id ORDER BY t))::INT AS smf_track FROM fn)"""


@query(_FILES + """ SELECT piece_id, smf_track, pitch AS key, velocity, "start"::BIGINT AS on_tick, "end"::BIGINT AS off_tick FROM fl""")
def smf_round_trip(spark, sf_dir):
    """Notes of all users written to MIDI files of twelve users each and read back."""
    back = smf.linked_notes(smf.decode(_files(spark, sf_dir), "piece_id")).where("off_tick is not null")
    return back.select("piece_id", "smf_track", "key", "velocity", "on_tick", "off_tick")


@query(_FILES + """ SELECT piece_id, smf_track, smf_track - 1 AS channel, count(*)::BIGINT AS onsets, count(*)::BIGINT AS offsets FROM (SELECT piece_id, CASE WHEN smf_track > 9 THEN smf_track + 1 ELSE smf_track END AS smf_track FROM fl) GROUP BY ALL""")
def voice_counts(spark, sf_dir):
    """Onsets and offsets by voice; the tenth channel is the drums', so later tracks use the next."""
    v = edit.voice_counts(smf.decode(_files(spark, sf_dir), "piece_id"))
    return v.select("piece_id", (F.col("channel") + 1).alias("smf_track"), "channel", "onsets", "offsets")


@query(_FILES + """ SELECT piece_id, (max(smf_track) + 1)::INT AS tracks, (2 * count(*) + 2 * max(smf_track) + 2)::BIGINT AS events, max("end")::BIGINT AS max_tick FROM fl GROUP BY piece_id""")
def file_counts(spark, sf_dir):
    return edit.counts(smf.decode(_files(spark, sf_dir), "piece_id"))


@query(_FILES + """, m AS (SELECT piece_id::INT AS p, max("end") AS e FROM fl GROUP BY ALL), s AS (SELECT p, sum(e) OVER (ORDER BY p) - e AS base FROM m)
SELECT smf_track, count(*)::BIGINT AS n_notes, sum("start" + base)::BIGINT AS starts, max("end" + base)::BIGINT AS last FROM fl JOIN s ON fl.piece_id::INT = s.p GROUP BY smf_track""")
def concatenated_files(spark, sf_dir):
    """All files one after the other."""
    m = smf.decode(_files(spark, sf_dir), "piece_id")
    listing = m.select("piece_id").distinct().select("piece_id", F.lit("all").alias("target"), F.col("piece_id").cast("int").alias("position"))
    on = edit.concatenate(m, listing).where("status >= 144 and status < 160")
    a = on.where("p2 > 0").groupBy("smf_track").agg(F.count(F.lit(1)).alias("n_notes"), F.sum("tick").alias("starts"))
    return a.join(on.groupBy("smf_track").agg(F.max("tick").alias("last")), "smf_track")


@query(_FILES + """, c AS (SELECT piece_id, smf_track, pitch, unnest(range("start", "end")) AS s FROM fl), d AS (SELECT DISTINCT * FROM c)
SELECT piece_id, (s // 48)::INT AS bar, count(*)::BIGINT AS cells, sum(s % 48 * 128 + pitch)::BIGINT AS places FROM d GROUP BY ALL""")
def file_bar_rolls(spark, sf_dir):
    """Cells of the bar rolls of files, 4/4 throughout."""
    r = R.bar_roll_of_file(smf.decode(_files(spark, sf_dir), "piece_id"))
    return r.groupBy("piece_id", "bar").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("step") * 128 + F.col("pitch")).cast("long").alias("places"))


@query(_FILES + """ SELECT piece_id, md5('4d') AS same FROM fl GROUP BY piece_id""")
def binasc_round_trip(spark, sf_dir):
    """Files as text and back: the first byte of each that comes back whole."""
    files = edit.binasc_content(edit.binasc_dump(_files(spark, sf_dir).withColumnRenamed("content", "old"), "old"))
    return files.select(F.col("piece_id").cast("string").alias("piece_id"), F.when(F.col("old") == F.col("content"), F.md5(F.lower(F.hex(F.substring("content", 1, 1))).cast("binary"))).alias("same"))


@query("""SELECT piece_id, track, CASE WHEN track_type = 11 THEN 'drums' WHEN instrument = 8 THEN 'none' WHEN instrument < 8 THEN 'piano' ELSE (['chromatic_perc', 'organ', 'guitar', 'bass', 'strings', 'ensemble', 'brass', 'reed', 'pipe', 'synth_lead', 'synth_pad', 'synth_effects', 'ethnic', 'percussive', 'sound_fx'])[instrument // 8] END AS family,
CASE WHEN track_type = 11 THEN 'drum_' || instrument ELSE 'program' END AS name FROM tr""")
def instrument_families(spark, sf_dir):
    t, drum = track_table(spark, sf_dir), F.col("track_type") == fixed.STANDARD_DRUM
    name = gm.name_column(drum, F.col("instrument"))
    return t.select("piece_id", "track", F.coalesce(gm.family_column(drum, F.col("instrument")), F.lit("none")).alias("family"), F.when(name.startswith("drum_") | name.isNull(), name).otherwise("program").alias("name"))


_PIECES = """, pc AS (SELECT o_orderkey AS piece_id, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 12 END AS resolution, 100 + o_orderkey % 1000 AS tempo FROM orders),
br AS (SELECT l_orderkey AS piece_id, 0 AS track, l_linenumber AS bar, 4 AS ts_num, 4 AS ts_den FROM lineitem UNION ALL SELECT l_orderkey, 1, l_linenumber, CASE WHEN l_partkey % 91 = 0 THEN 3 ELSE 4 END, 4 FROM lineitem WHERE NOT (l_suppkey % 29 = 0 AND l_linenumber > 1)),
et AS (SELECT l_orderkey AS piece_id, l_linenumber AS bar, l_partkey % 49 AS time, l_suppkey % 129 AS pitch FROM lineitem)"""


@query(_PIECES + """, p AS (SELECT piece_id, 0 AS r, 'no resolution' AS problem FROM pc WHERE resolution = 0 UNION ALL SELECT piece_id, 1, 'resolution out of range' FROM pc WHERE resolution = 0 UNION ALL SELECT piece_id, 1, 'tempo out of range' FROM pc WHERE tempo > 1000
UNION ALL SELECT piece_id, 1, 'pitch out of range' FROM et WHERE pitch > 127 UNION ALL SELECT piece_id, 2, 'tracks differ in bars' FROM (SELECT piece_id, count(DISTINCT CASE WHEN track = 0 THEN bar END) AS a, count(DISTINCT CASE WHEN track = 1 THEN bar END) AS b FROM br GROUP BY piece_id) WHERE a <> b AND b > 0
UNION ALL SELECT piece_id, 3, 'tracks differ in time signature' FROM (SELECT piece_id, bar FROM br GROUP BY ALL HAVING count(DISTINCT ts_num) > 1) UNION ALL SELECT et.piece_id, 4, 'event outside its bar' FROM et JOIN pc USING (piece_id) WHERE time >= 4 * resolution)
SELECT piece_id, problem FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY r, problem) AS n FROM p) WHERE n = 1""")
def validated_pieces(spark, sf_dir):
    """The first problem of pieces made of orders, with two tracks each."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pieces = o.select(F.col("o_orderkey").alias("piece_id"), F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(12).alias("resolution"), (100 + F.col("o_orderkey") % 1000).alias("tempo"))
    first = li.select(F.col("l_orderkey").alias("piece_id"), F.lit(0).alias("track"), F.col("l_linenumber").alias("bar"), F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"))
    second = li.where(~((F.col("l_suppkey") % 29 == 0) & (F.col("l_linenumber") > 1))).select(F.col("l_orderkey").alias("piece_id"), F.lit(1).alias("track"), F.col("l_linenumber").alias("bar"), F.when(F.col("l_partkey") % 91 == 0, 3).otherwise(4).alias("ts_num"), F.lit(4).alias("ts_den"))
    ev = li.select(F.col("l_orderkey").alias("piece_id"), F.lit(0).alias("track"), F.col("l_linenumber").alias("bar"), (F.col("l_partkey") % 49).alias("time"), F.lit(90).alias("velocity"), (F.col("l_suppkey") % 129).alias("pitch"))
    return P.validate({"pieces": pieces, "bars": first.unionByName(second), "events": ev})


@query("""SELECT l_orderkey, bool_or(l_quantity > 45) AS "any", bool_and(l_quantity > 5) AS "all", count(DISTINCT l_suppkey) <= 1 AS all_same, count(DISTINCT l_suppkey) = count(l_suppkey) AS all_different FROM lineitem GROUP BY l_orderkey""")
def group_predicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"big": F.col("l_quantity") > 45, "some": F.col("l_quantity") > 5})
    k = ["l_orderkey"]
    return P.any_of(li, k, "big").join(P.all_of(li, k, "some"), k).join(P.sameness(li, k, "l_suppkey"), k)


@query("""SELECT piece_id, track, pitch, tick, (bar // 4)::INT AS segment, (bar % 4)::INT AS bar FROM (SELECT *, (max(bar) OVER (PARTITION BY piece_id) + 1) // 4 AS n FROM ev) WHERE bar // 4 < n""")
def four_bar_segments(spark, sf_dir):
    return G.multi_segments(events(spark, sf_dir), 4).select("piece_id", "track", "pitch", "tick", "segment", F.col("bar").cast("int").alias("bar"))


@query("""SELECT (row_number() OVER (ORDER BY n DESC, signature) - 1)::INT AS place, signature, n FROM (SELECT l_linenumber || '/' || (l_suppkey % 9 + 1) AS signature, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, signature LIMIT 36)""")
def frequent_signatures(spark, sf_dir):
    """The 36 most frequent of time signatures: a top-k report."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("/", "l_linenumber", F.col("l_suppkey") % 9 + 1).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    return tables.most_frequent(li, 36)


@query(_FILES + f""", t AS (SELECT DISTINCT piece_id, smf_track AS track FROM fl), n AS (SELECT piece_id, ((max("end") - 1) // 48 + 1)::INT AS bars FROM fl GROUP BY piece_id), b AS (SELECT piece_id, track, unnest(range(0, bars)) AS bar FROM t JOIN n USING (piece_id)),
l AS (SELECT piece_id, smf_track AS track, floor(greatest(0.0, least(5.0, log2(("end" - "start") / 3) + 1)))::INT AS v FROM fl), k AS (SELECT *, row_number() OVER (PARTITION BY piece_id, track ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY piece_id, track) AS n FROM l),
d AS (SELECT piece_id, track, max(CASE WHEN i = least(round(n * 0.15::DOUBLE), n - 1) THEN v END) AS least_, max(CASE WHEN i = least(round(n * 0.85::DOUBLE), n - 1) THEN v END) AS most FROM k GROUP BY piece_id, track),
o AS (SELECT piece_id, smf_track AS track, "start" // 48 AS bar, "start" % 48 AS time, pitch, "end" - "start" AS duration FROM fl),
g AS (SELECT *, time - coalesce(lag(time) OVER w, 0) AS gap, row_number() OVER w AS i FROM o WINDOW w AS (PARTITION BY piece_id, track, bar ORDER BY time, pitch)),
r AS (SELECT DISTINCT piece_id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS f, 0 AS h, {_AT['PIECE_START']} AS token FROM t
UNION ALL SELECT piece_id, 1, track, 0, 0, 0, 0, 0, {_AT['TRACK']} FROM t UNION ALL SELECT piece_id, 1, track, 0, 2, 0, 0, 0, {_AT['INSTRUMENT']} FROM t
UNION ALL SELECT piece_id, 1, track, 0, 5, 0, 0, 0, {_AT['MIN_NOTE_DURATION']} + least_ FROM d UNION ALL SELECT piece_id, 1, track, 0, 6, 0, 0, 0, {_AT['MAX_NOTE_DURATION']} + most FROM d
UNION ALL SELECT piece_id, 1, track, 1, bar, 0, 0, 0, {_AT['BAR']} FROM b UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 0, {_AT['TIME_DELTA']} + gap - 1 FROM g WHERE gap > 0
UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 1, {_AT['NOTE_ONSET']} + pitch FROM g UNION ALL SELECT piece_id, 1, track, 1, bar, 3, i, 2, {_AT['NOTE_DURATION']} + least(duration, 96) - 1 FROM g
UNION ALL SELECT piece_id, 1, track, 1, bar, 9, 0, 0, {_AT['BAR_END']} FROM b UNION ALL SELECT piece_id, 1, track, 2, 0, 0, 0, 0, {_AT['TRACK_END']} FROM t)
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY a, b, c, d, e, f, h) - 1)::INT AS idx, token::INT AS token FROM r""")
def tokens_of_files(spark, sf_dir):
    """All tokens of files that go through the facade, MIDI to tokens."""
    t = facade.midi_to_piece(_files(spark, sf_dir).withColumn("path", F.col("piece_id").cast("string")))
    return facade.piece_to_tokens(t, "NEW_DURATION_ENCODER").select("piece_id", "idx", "token")


_HEAD, _TAIL = _DURATION_SQL.rsplit("\nSELECT", 1)


@query(f"""{_HEAD}, tk AS (SELECT{_TAIL}), n AS (SELECT piece_id, count(*) AS n, {_unit("'1:' || piece_id")} AS u FROM tk GROUP BY ALL), c AS (SELECT *, least(n, 2048) AS real, floor(u * (greatest(n - 2048, 0) + 1)) AS skip, floor(u * 8)::INT AS bucket FROM n),
k AS (SELECT *, bucket || '-' || ((row_number() OVER (PARTITION BY bucket ORDER BY md5('1:' || piece_id), piece_id) - 1) // 4) AS batch FROM c), l AS (SELECT *, max(real) OVER (PARTITION BY batch) AS length FROM k),
td AS (SELECT piece_id, string_agg(token::VARCHAR, ',' ORDER BY idx) AS told FROM tk JOIN c USING (piece_id) WHERE idx >= skip AND idx < skip + 2048 GROUP BY piece_id)
SELECT batch, piece_id, length::INT AS length, real::INT AS real, md5(told || repeat(',0', (length - real)::INT)) AS tokens FROM l JOIN td USING (piece_id)""")
def training_batches(spark, sf_dir):
    """Random runs of at most 2048 tokens, padded to the longest of their batch."""
    seq = E.sequences(E.encode("NEW_DURATION_ENCODER", *_token_inputs(spark, sf_dir)))
    out = dataset.batches(seq, 4, 2048, 1, 8)
    return out.select("batch", "piece_id", F.size("tokens").alias("length"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("real"), F.md5(_listed("tokens")).alias("tokens"))


@query("SELECT piece_id, CASE WHEN n < 10 THEN 'Unknown' WHEN d / n < 0.2 THEN 'Quantized' WHEN d / n > 0.5 THEN 'Performance' ELSE 'Unknown' END AS kind FROM (SELECT piece_id, count(*) AS n, count(DISTINCT g) AS d FROM (SELECT piece_id, tick - lag(tick) OVER (PARTITION BY piece_id ORDER BY tick) AS g FROM (SELECT DISTINCT piece_id, tick FROM ev WHERE velocity > 0)) WHERE g IS NOT NULL GROUP BY ALL)")
def performance_kind(spark, sf_dir):
    return smf.performance_kind(events(spark, sf_dir).where("velocity > 0"))


@query("SELECT piece_id, track, pitch, greatest(\"start\", 100) - 100 AS \"start\", least(\"end\", 400) - 100 AS \"end\" FROM nt WHERE \"start\" < 400 AND \"end\" > 100")
def excerpt(spark, sf_dir):
    return smf.excerpt(notes(spark, sf_dir), 100, 400).select("piece_id", "track", "pitch", "start", "end")


@query()
def generated_pieces(spark, sf_dir):
    """Sequences drawn under the grammar, one request for each supplier, checked for the grammar again."""
    s = table(spark, sf_dir, "supplier")
    req = s.select(F.col("s_suppkey").alias("piece_id"), F.lit(2).alias("n_tracks"), F.lit(2).alias("n_bars"), F.col("s_suppkey").alias("seed"), F.lit('[{"TRACK": [10]}, {"TRACK": [11]}]').alias("controls"))
    out = generation.generate(req, "NEW_DURATION_ENCODER")
    broken = F.when(F.col("error").isNull(), grammar.broken_edges(F.col("tokens"), "NEW_DURATION_ENCODER", False))
    return out.select("piece_id", F.size("tokens").alias("length"), broken.alias("violations"), "error")


@query(""", s AS (SELECT date_trunc('day', ts) AS day, user_id % 5 AS piece_id FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, piece_id, count(*) AS onsets FROM s GROUP BY ALL""")
def onsets_by_day(spark, sf_dir):
    from . import streaming

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("piece_id"), F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), F.lit(1).alias("velocity"))
    return streaming.onset_counts(e, window="1 day").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "piece_id", "onsets")


from . import more_queries, token_queries  # noqa: E402, F401
