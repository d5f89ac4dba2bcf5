"""Expected values of queries, typed in as plain text, so that SQL does not come from the tables that it tests."""

from __future__ import annotations

# Domains of each encoder in token order, and how many tokens each has.
DOMAINS = {
    "TE_TRACK_DENSITY_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 8), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN", 3), ("DENSITY_LEVEL", 10)],
    "TRACK_DENSITY_ENCODER_V2": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10)],
    "TRACK_INTERLEAVED_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("INSTRUMENT", 256), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48)],
    "TRACK_INTERLEAVED_W_HEADER_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("INSTRUMENT", 256), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("HEADER", 2)],
    "TRACK_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48)],
    "TRACK_NO_INST_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48)],
    "TRACK_UNQUANTIZED_ENCODER": [("PIECE_START", 1)],
    "TRACK_DENSITY_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("DENSITY_LEVEL", 10)],
    "TRACK_BAR_FILL_DENSITY_ENCODER": [("PIECE_START", 1), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10)],
    "TRACK_NOTE_DURATION_CONT_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("TIME_SIGNATURE", 9)],
    "TRACK_NOTE_DURATION_EMBED_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("TIME_SIGNATURE", 9)],
    "DENSITY_GENRE_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10), ("GENRE", 16)],
    "DENSITY_GENRE_TAGTRAUM_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10), ("GENRE", 32)],
    "DENSITY_GENRE_LASTFM_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10), ("GENRE", 31)],
    "POLYPHONY_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10)],
    "POLYPHONY_DURATION_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)],
    "DURATION_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)],
    "NEW_DURATION_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)],
    "TE_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 4), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 9), ("TRACK", 8), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("DENSITY_LEVEL", 10)],
    "NEW_VELOCITY_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_DELTA", 48), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("VELOCITY_LEVEL", 32)],
    "ABSOLUTE_ENCODER": [("PIECE_START", 2), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)],
    "MULTI_LENGTH_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 4), ("BAR", 1), ("BAR_END", 1), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)],
    "TE_VELOCITY_DURATION_POLYPHONY_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 4), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 9), ("TRACK", 8), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("DENSITY_LEVEL", 10), ("VELOCITY_LEVEL", 32)],
    "TE_VELOCITY_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 4), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 9), ("TRACK", 8), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("DENSITY_LEVEL", 10), ("VELOCITY_LEVEL", 32)],
    "EL_VELOCITY_DURATION_POLYPHONY_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 2), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 19), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 109), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 96), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("DENSITY_LEVEL", 10), ("VELOCITY_LEVEL", 32)],
    "EL_VELOCITY_DURATION_POLYPHONY_YELLOW_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 2), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 36), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 109), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 192), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("DENSITY_LEVEL", 10), ("VELOCITY_LEVEL", 32)],
    "EL_VELOCITY_DURATION_POLYPHONY_YELLOW_FIXED_ENCODER": [("PIECE_START", 2), ("NUM_BARS", 2), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 36), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 192), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6), ("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10), ("DENSITY_LEVEL", 10), ("VELOCITY_LEVEL", 32)],
    "ENCODER_VT": [("PIECE_START", 2), ("NUM_BARS", 2), ("BAR", 1), ("BAR_END", 1), ("TIME_SIGNATURE", 19), ("TRACK", 2), ("TRACK_END", 1), ("INSTRUMENT", 128), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), ("TIME_ABSOLUTE", 192), ("FILL_IN_PLACEHOLDER", 1), ("FILL_IN_START", 1), ("FILL_IN_END", 1), ("MIN_NOTE_DURATION_HARD", 6), ("MAX_NOTE_DURATION_HARD", 6), ("MIN_POLYPHONY_HARD", 10), ("MAX_POLYPHONY_HARD", 10), ("REST_PERCENTAGE", 10), ("DENSITY_LEVEL", 10), ("PITCH_CLASS", 12), ("VELOCITY_LEVEL", 32)],
}

# What may follow what in NEW_DURATION_ENCODER.
EDGES = {
    "BAR": ["FILL_IN_PLACEHOLDER", "NOTE_ONSET", "TIME_DELTA"],
    "BAR_END": ["BAR", "TRACK_END"],
    "FILL_IN_END": ["FILL_IN_START"],
    "FILL_IN_PLACEHOLDER": ["BAR_END"],
    "FILL_IN_START": ["FILL_IN_END", "NOTE_ONSET", "TIME_DELTA"],
    "INSTRUMENT": ["MIN_NOTE_DURATION"],
    "MAX_NOTE_DURATION": ["BAR"],
    "MIN_NOTE_DURATION": ["MAX_NOTE_DURATION"],
    "NOTE_DURATION": ["BAR_END", "FILL_IN_END", "NOTE_ONSET", "TIME_DELTA"],
    "NOTE_ONSET": ["NOTE_DURATION"],
    "PIECE_START": ["TRACK"],
    "TIME_DELTA": ["BAR_END", "FILL_IN_END", "NOTE_ONSET", "TIME_DELTA"],
    "TRACK": ["INSTRUMENT"],
    "TRACK_END": ["FILL_IN_START", "TRACK"],
}

# Number of a program's group, 0 to 127.
DENSE_GROUPS = [
    0, 0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12,
    13, 13, 13, 14, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25,
    26, 27, 27, 28, 29, 29, 30, 30, 31, 32, 33, 34, 35, 36, 37, 38,
    39, 39, 40, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 51,
    52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67,
    68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 76, 76, 76, 76, 76, 76,
    77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 90, 91, 92,
    93, 94, 95, 96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108,
]

# Smallest program of a program's group, 0 to 127.
GROUP_PROGRAMS = [
    0, 0, 0, 3, 4, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15,
    16, 16, 16, 19, 19, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31,
    32, 33, 33, 35, 36, 36, 38, 38, 40, 41, 42, 43, 44, 45, 46, 47,
    48, 48, 50, 50, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 62,
    64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79,
    80, 81, 82, 83, 84, 85, 86, 87, 88, 88, 88, 88, 88, 88, 88, 88,
    96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111,
    112, 113, 114, 115, 116, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126, 127,
]

# Device track type of a drum pitch, 0 to 127.
DRUM_TYPES = [
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 0, 0, 1, 1, 1, 1, 8, 2, 8, 2, 8, 8, 8,
    8, 2, 8, 2, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
]

# Device track type of a program, 0 to 127.
PROGRAM_TYPES = [
    9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9,
    9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9,
    4, 4, 4, 4, 4, 4, 4, 4, 9, 9, 9, 9, 9, 9, 9, 9,
    9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9,
    9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9,
    9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9,
    3, 3, 3, 3, 3, 3, 3, 3, 9, 9, 9, 9, 9, 9, 9, 9,
    9, 9, 9, 9, 9, 9, 9, 9, 3, 3, 3, 3, 3, 3, 3, 3,
]
