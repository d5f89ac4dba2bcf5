"""Fixed values that results depend on, and small lookups built by rule."""

from __future__ import annotations

# Token types, in order.
TOKEN_TYPES = (
    "PIECE_START NOTE_ONSET NOTE_OFFSET PITCH NON_PITCH VELOCITY TIME_DELTA TIME_ABSOLUTE INSTRUMENT BAR BAR_END TRACK TRACK_END DRUM_TRACK FILL_IN "
    "FILL_IN_PLACEHOLDER FILL_IN_START FILL_IN_END HEADER VELOCITY_LEVEL GENRE DENSITY_LEVEL TIME_SIGNATURE SEGMENT SEGMENT_END SEGMENT_FILL_IN NOTE_DURATION "
    "AV_POLYPHONY MIN_POLYPHONY MAX_POLYPHONY MIN_NOTE_DURATION MAX_NOTE_DURATION NUM_BARS MIN_POLYPHONY_HARD MAX_POLYPHONY_HARD MIN_NOTE_DURATION_HARD "
    "MAX_NOTE_DURATION_HARD REST_PERCENTAGE PITCH_CLASS NONE"
).split()

# Track types, in order of their numbers.
TRACK_TYPES = (
    "OPZ_KICK_TRACK OPZ_SNARE_TRACK OPZ_HIHAT_TRACK OPZ_SAMPLE_TRACK OPZ_BASS_TRACK OPZ_LEAD_TRACK OPZ_ARP_TRACK OPZ_CHORD_TRACK AUX_DRUM_TRACK AUX_INST_TRACK "
    "STANDARD_TRACK STANDARD_DRUM_TRACK STANDARD_BOTH OPZ_INVALID_DRUM_TRACK OPZ_INVALID_SAMPLE_TRACK OPZ_INVALID_BASS_TRACK NUM_TRACK_TYPES"
).split()
DRUM_TYPES = (0, 1, 2, 8, 11)
STANDARD, STANDARD_DRUM = 10, 11

# Time signatures by frequency; each vocabulary is a prefix of this list.
TIME_SIGNATURES = [
    (4, 4), (3, 4), (2, 4), (6, 8), (2, 2), (1, 4), (6, 4), (3, 8), (5, 4), (4, 2), (1, 8), (3, 2), (9, 8), (5, 8), (7, 8), (12, 8), (8, 4), (7, 4), (4, 8),
    (3, 1), (1, 2), (8, 8), (11, 8), (2, 8), (6, 2), (9, 4), (2, 1), (9, 16), (12, 4), (10, 4), (13, 16), (15, 16), (17, 16), (1, 16), (10, 8), (16, 4),
]
FOUR_FOUR, BASIC, BLUE, YELLOW = TIME_SIGNATURES[:1], TIME_SIGNATURES[:9], TIME_SIGNATURES[:19], TIME_SIGNATURES[:36]

# Genres by taxonomy.
GENRES = {
    "discogs": "NONE|blues|brass & military|children's|classical|electronic|folk, world, & country|funk / soul|hip hop|jazz|latin|non-music|pop|reggae|rock|stage & screen".split("|"),
    "tagtraum": (
        "NONE|anime|blues|celtic|childrens|christmas/holiday|classical|comedy|country|dance|drumnbass|dubstep|easylistening|electronic|folk|funk|game|gospel|hiphop|industrial|"
        "jazz|latin|newage|reggae|reggaeton|rnb|rock/pop|soundtrack|spoken|techno|trance|world"
    ).split("|"),
    "lastfm": (
        "NONE|blues|brazilian|chillout|christian|christmas/holiday|classical|country|dance|electronic|experimental|folk|gospel|gothic|hiphop|instrumental|jazz|jpop/jrock|latin|"
        "metal|neofolk|newage|oldie|pop|posthardcore|postrock|reggae|rock|soul|soundtrack|world"
    ).split("|"),
}

# Programs that join the one before them in the same group.
GROUPED_PROGRAMS = (1, 2, 5, 17, 18, 20, 34, 37, 39, 49, 51, 63, 89, 90, 91, 92, 93, 94, 95)

# Output channels of melodic tracks; 9 is the drum channel.
SAFE_CHANNELS = [c for c in range(16) if c != 9]


def get_genres(taxonomy: str) -> dict[str, int]:
    """Genre -> number."""
    if taxonomy not in GENRES:
        raise ValueError(f"unknown genre taxonomy {taxonomy!r}")
    return {g: i for i, g in enumerate(GENRES[taxonomy])}


def velocity_level(v: int) -> int:
    """128 velocities to 32 levels; 0 stays 0."""
    return int(v // (128 / 31) + (v > 0))


def instrument_group(i: int, dense: bool) -> int:
    """Number of a program's group (dense) or the smallest program in it."""
    first = [p for p in range(i + 1) if p not in GROUPED_PROGRAMS]
    return len(first) - 1 if dense else first[-1]


def opz_drum_type(pitch: int) -> int:
    """Track type of a drum pitch on the eight-track device."""
    return 0 if pitch in (35, 36) else 1 if 37 <= pitch <= 40 else 2 if pitch in (42, 44, 49, 51) else 8


def opz_instrument_type(program: int) -> int:
    """Track type of a melodic program on the eight-track device."""
    return 4 if 32 <= program <= 39 else 3 if 96 <= program <= 103 or 120 <= program <= 127 else 9


#: Drum pitches that generation allows by drum type.
OPZ_NOTE_DOMAINS = {0: (35, 36), 1: (37, 38, 39, 40), 2: (42, 44, 46, 49, 51, 55, 57, 59)}
