"""Training examples from pieces: a random valid segment, transposed and perhaps masked, as tokens; pairs of halves; batches.

All choices hash (seed, piece_id, draw), so reruns and retried tasks agree. A piece is a dict of tables as in ``facade``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as A
from ..operators import segments as G
from ..sources import dataset
from . import encode as E
from . import facade, vocab

KEY = ["piece_id", "track"]


@dataclass(frozen=True)
class Options:
    """What a reader draws. fill_share: chance of an infilling example where the encoder has both kinds; mask: share of bars that it may leave out."""

    seed: int = 0
    num_bars: int = 4
    min_tracks: int = 1
    max_tracks: int = 12
    max_seq_len: int = 2048
    fill_share: float = 0.75
    mask: float = 0.75
    transpose: bool = True
    crop: bool = True


def segment(t: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    """One random valid segment of each piece: its bars from 0 on, at most max_tracks of its tracks, transposed together but for drums. Pieces without one go."""
    bars = t["bars"].select("piece_id", "bar", "ts_num", "ts_den").distinct()
    grid = bars.select("piece_id", "bar").join(t["tracks"].select(*KEY), "piece_id")
    chosen = G.select_segments(G.valid_segments(A.has_notes(t["events"], grid), o.num_bars, o.min_tracks), o.seed, o.max_tracks)
    drum = S.is_drum_track(F.col("track_type"))
    cells = chosen.select("piece_id", "start", F.explode("tracks").alias("track"))
    tracks = t["tracks"].join(cells, KEY)
    events = t["events"].drop("bar_start").join(tracks.select(*KEY, "start", drum.alias("_drum")), KEY).where((F.col("bar") >= F.col("start")) & (F.col("bar") < F.col("start") + o.num_bars))
    if o.transpose:
        extents = events.where("not _drum").groupBy("piece_id").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"))
        events = events.join(G.select_transpose(extents, o.seed + 1).select("piece_id", "transpose"), "piece_id", "left")
        events = events.withColumn("pitch", S.transpose(F.col("pitch"), F.col("_drum"), F.coalesce("transpose", F.lit(0)))).drop("transpose")
    cut = bars.join(chosen.select("piece_id", "start"), "piece_id").where((F.col("bar") >= F.col("start")) & (F.col("bar") < F.col("start") + o.num_bars)).withColumn("bar", F.col("bar") - F.col("start")).drop("start")
    events = events.withColumn("bar", F.col("bar") - F.col("start")).drop("start", "_drum")
    events = events.withColumn("tick", (F.col("bar") * 100_000 + F.col("time")).cast("int"))
    return t | {"tracks": tracks.drop("start"), "bars": cut, "events": events}


def masked_bars(t: dict[str, DataFrame], o: Options) -> DataFrame:
    """Bars (piece_id, track, bar) to fill, of the share of pieces that become infilling examples."""
    cells = t["bars"].select("piece_id", "bar").join(t["tracks"].select(*KEY), "piece_id").where(G.unit(o.seed + 2, F.col("piece_id")) < o.fill_share)
    return G.bar_mask(cells, o.mask, o.seed + 3).select(*KEY, "bar")


def _features(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Features while ticks are whole pieces' own; bars are cut afterwards."""
    return facade.with_features(t)


def load_segment(t: dict[str, DataFrame], encoder: str, o: Options = Options(), pieces: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Token rows of a random segment of each piece, or of those that pieces (piece_id) names."""
    t = t if pieces is None else {k: v.join(pieces.select("piece_id").distinct(), "piece_id", "left_semi") for k, v in t.items() if "piece_id" in v.columns}
    cut = segment(_features(t), o)
    both = vocab.get_encoder(encoder).config.both_in_one
    return facade.piece_to_tokens(cut, encoder, fills=masked_bars(cut, o) if both else None, preprocess=False)


def load_piece(t: dict[str, DataFrame], encoder: str, piece_id, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(piece_id, tokens) of one piece's segment."""
    own = {k: v.where(F.col("piece_id") == piece_id) for k, v in t.items() if "piece_id" in v.columns}
    return E.sequences(load_segment(own, encoder, o))


def load_piece_pairs(t: dict[str, DataFrame], encoder: str, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(piece_id, a, b): tokens of the consecutive halves of a window of twice num_bars; b lacks one track, half of the time. Pieces without such a window go."""
    two = segment(_features(t), replace(o, num_bars=2 * o.num_bars))
    bars, events = two["bars"], two["events"]

    def half(lo: int, tracks: DataFrame) -> DataFrame:
        part = {"bars": bars.where(F.col("bar").between(lo, lo + o.num_bars - 1)).withColumn("bar", F.col("bar") - lo), "events": events.where(F.col("bar").between(lo, lo + o.num_bars - 1)).withColumn("bar", F.col("bar") - lo), "tracks": tracks}
        return E.sequences(facade.piece_to_tokens(two | part, encoder, preprocess=False))

    place = F.row_number().over(Window.partitionBy("piece_id").orderBy(G.draw(o.seed + 4, F.col("piece_id"), F.col("track")), "track"))
    n = F.count(F.lit(1)).over(Window.partitionBy("piece_id"))
    fewer = two["tracks"].withColumns({"_r": place, "_n": n}).where((F.col("_r") > 1) | (F.col("_n") == 1) | (G.unit(o.seed + 5, F.col("piece_id")) < 0.5)).drop("_r", "_n")
    return half(0, two["tracks"]).withColumnRenamed("tokens", "a").join(half(o.num_bars, fewer).withColumnRenamed("tokens", "b"), "piece_id")


def read_batches(t: dict[str, DataFrame], encoder: str, batch_size: int, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(batch, piece_id, tokens, mask) of random segments."""
    longest = o.max_seq_len if o.crop else 1 << 30
    return dataset.batches(E.sequences(load_segment(t, encoder, o)), batch_size, longest, o.seed)


def read_batches_of_lengths(t: dict[str, DataFrame], encoder: str, batch_size: int, o: Options = Options()) -> DataFrame:  # noqa: B008
    """The same, with each piece's number of bars drawn from the encoder's domain."""
    sizes = [r[2] for r in vocab.rows_of(vocab.get_encoder(encoder).domains) if r[1] == "NUM_BARS"] or [o.num_bars]
    ids = t["tracks"].select("piece_id").distinct().withColumn("_n", G.pick_element(F.array(*[F.lit(n) for n in sizes]), o.seed + 6, F.col("piece_id")))
    parts = [E.sequences(load_segment(t, encoder, replace(o, num_bars=n), ids.where(F.col("_n") == n))) for n in sizes]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return dataset.batches(rows, batch_size, o.max_seq_len if o.crop else 1 << 30, o.seed)


def read_batches_with_features(t: dict[str, DataFrame], encoder: str, batch_size: int, bar_features: DataFrame, o: Options = Options()) -> DataFrame:  # noqa: B008
    """(batch, piece_id, tokens, mask, embeddings): tokens and their embeddings are cropped at one place, so they stay aligned."""
    cut = segment(_features(t), o)
    rows = facade.encode_with_embeddings(cut, encoder, bar_features, preprocess=False)
    both = F.array_sort(F.collect_list(F.struct("idx", "token", "embedding")))
    seq = rows.groupBy("piece_id").agg(both.alias("x")).select("piece_id", F.col("x.token").alias("tokens"), F.col("x.embedding").alias("embeddings"))
    out = dataset.batches(seq.select("piece_id", "tokens"), batch_size, o.max_seq_len, o.seed)
    own = seq.select("piece_id", dataset.crop(F.col("embeddings"), o.max_seq_len, o.seed, F.col("piece_id")).alias("embeddings"))
    dim = vocab.get_encoder(encoder).config.embed_dim
    pad = F.array_repeat(facade.empty_embedding(dim), F.greatest(F.size("tokens") - F.size("embeddings"), F.lit(0)))
    return out.join(own, "piece_id").select("batch", "piece_id", "tokens", "mask", F.concat("embeddings", pad).alias("embeddings"))
