"""Instruments by name: programs, families, drum pitches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Names of the 128 programs, in order.
PROGRAMS = (
    "acoustic_grand_piano", "bright_acoustic_piano", "electric_grand_piano", "honky_tonk_piano", "electric_piano_1", "electric_piano_2", "harpsichord", "clavi",
    "celesta", "glockenspiel", "music_box", "vibraphone", "marimba", "xylophone", "tubular_bells", "dulcimer",
    "drawbar_organ", "percussive_organ", "rock_organ", "church_organ", "reed_organ", "accordion", "harmonica", "tango_accordion",
    "acoustic_guitar_nylon", "acoustic_guitar_steel", "electric_guitar_jazz", "electric_guitar_clean", "electric_guitar_muted", "overdriven_guitar", "distortion_guitar", "guitar_harmonics",
    "acoustic_bass", "electric_bass_finger", "electric_bass_pick", "fretless_bass", "slap_bass_1", "slap_bass_2", "synth_bass_1", "synth_bass_2",
    "violin", "viola", "cello", "contrabass", "tremolo_strings", "pizzicato_strings", "orchestral_harp", "timpani",
    "string_ensemble_1", "string_ensemble_2", "synth_strings_1", "synth_strings_2", "choir_aahs", "voice_oohs", "synth_voice", "orchestra_hit",
    "trumpet", "trombone", "tuba", "muted_trumpet", "french_horn", "brass_section", "synth_brass_1", "synth_brass_2",
    "soprano_sax", "alto_sax", "tenor_sax", "baritone_sax", "oboe", "english_horn", "bassoon", "clarinet",
    "piccolo", "flute", "recorder", "pan_flute", "blown_bottle", "shakuhachi", "whistle", "ocarina",
    "lead_1_square", "lead_2_sawtooth", "lead_3_calliope", "lead_4_chiff", "lead_5_charang", "lead_6_voice", "lead_7_fifths", "lead_8_bass__lead",
    "pad_1_new_age", "pad_2_warm", "pad_3_polysynth", "pad_4_choir", "pad_5_bowed", "pad_6_metallic", "pad_7_halo", "pad_8_sweep",
    "fx_1_rain", "fx_2_soundtrack", "fx_3_crystal", "fx_4_atmosphere", "fx_5_brightness", "fx_6_goblins", "fx_7_echoes", "fx_8_sci_fi",
    "sitar", "banjo", "shamisen", "koto", "kalimba", "bag_pipe", "fiddle", "shanai",
    "tinkle_bell", "agogo", "steel_drums", "woodblock", "taiko_drum", "melodic_tom", "synth_drum", "reverse_cymbal",
    "guitar_fret_noise", "breath_noise", "seashore", "bird_tweet", "telephone_ring", "helicopter", "applause", "gunshot",
)

# Families of programs, first and last; program 8 is in none.
FAMILIES = {
    "piano": (0, 7), "chromatic_perc": (9, 15), "organ": (16, 23), "guitar": (24, 31), "bass": (32, 39), "strings": (40, 47), "ensemble": (48, 55), "brass": (56, 63), "reed": (64, 71),
    "pipe": (72, 79), "synth_lead": (80, 87), "synth_pad": (88, 95), "synth_effects": (96, 103), "ethnic": (104, 111), "percussive": (112, 119), "sound_fx": (120, 127),
}


def instruments(name: str) -> list[int]:
    """Instrument keys that a name stands for: programs are 0 to 127, drum kits 128 more."""
    if name == "any":
        return list(range(256))
    if name in ("no_drums", "drums"):
        return list(range(128)) if name == "no_drums" else list(range(128, 256))
    if name in FAMILIES:
        return list(range(FAMILIES[name][0], FAMILIES[name][1] + 1))
    if name.startswith("drum_") and name[5:].isdigit() and int(name[5:]) < 128:
        return [128 + int(name[5:])]
    if name in PROGRAMS:
        return [PROGRAMS.index(name)]
    raise ValueError(f"no instrument {name!r}")


def programs(name: str) -> list[int]:
    """The same without the drum bit."""
    return sorted({i % 128 for i in instruments(name)})


def name_of(key: int) -> str:
    """Name of one instrument key."""
    return PROGRAMS[key] if key < 128 else f"drum_{key - 128}"


def name_column(is_drum: Column, instrument: Column) -> Column:
    names = F.array(*[F.lit(n) for n in PROGRAMS])
    known = instrument.between(0, 127)
    return F.when(known & is_drum, F.concat(F.lit("drum_"), instrument.cast("int").cast("string"))).when(known, F.element_at(names, F.greatest(instrument.cast("int"), F.lit(0)) + 1))


def track_type_of(name: str) -> int:
    """Track type that a name asks for: drums, both for any, else melodic."""
    if name == "any":
        return fixed.TRACK_TYPES.index("STANDARD_BOTH")
    return fixed.STANDARD_DRUM if min(instruments(name)) >= 128 else fixed.STANDARD


def family_column(is_drum: Column, instrument: Column) -> Column:
    """Family of a melodic program; drums, or null for the program that has none."""
    out = F.when(is_drum, F.lit("drums"))
    for name, (lo, hi) in FAMILIES.items():
        out = out.when(instrument.between(lo, hi), F.lit(name))
    return out
