"""Transcript noise: markers, known phrases, fillers and scripts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOISE_WORDS = (
    "crying", "laughter", "laughing", "applause", "growling", "music", "sobbing", "cheering", "sighing", "clapping", "coughing", "sneezing", "gasping", "whispering",
    "mumbling", "humming", "breathing", "silence", "snoring", "yelling", "screaming", "blank_audio", "inaudible", "noise", "crosstalk", "typing", "static", "beep",
    "ringing", "śmiech", "risas", "musik", "musique", "musica", "música", "muzyka", "applaus", "aplausos", "applausi", "oklaski", "ruido", "geräusch", "stille",
    "silencio", "cisza", "rires", "rire", "gelächter", "weeping",
)
ALWAYS_NOISE = ("[music]", "[blank_audio]", "[silence]", "music")
PHRASES = (
    "thank you for watching", "thanks for watching", "thank you for watching!", "thank you so much for watching", "please subscribe to our channel", "please subscribe",
    "please like and subscribe", "like and subscribe", "smash that like button", "don't forget to subscribe", "see you in the next video", "see you next time",
    "subtitles by the amara.org community", "transcribed by the amara.org community", "translated by the amara.org community", "the amara.org community",
    "amara.org community", "captions by the cyclope",
)
PHRASE_PREFIXES = ("transcripted by", "transcribed by", "captions by", "captioned by", "subtitles by", "translated by")
COMMANDS = (
    "stop recording", "stop the recording", "end recording", "end the recording", "stop transcription", "end transcription", "stop transcribing",
    "okay stop", "ok stop",
)
CLOSING_FILLERS = ("you", "okay.", "yeah.")
FILLERS = ("okay", "ok", "yeah", "yes", "right", "so", "and", "but", "well", "uh", "um", "hmm", "mhm")


def text_part(line: Column) -> Column:
    """What follows the first `] ` of a line; the line, if there is none."""
    at = F.locate("] ", line)
    return F.when(at > 0, F.substring(line, at + 2, F.length(line))).otherwise(line)


def always_noise(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*ALWAYS_NOISE)


def noise_marker(text: Column) -> Column:
    """A short `[...]` or `(...)` whose last word is a noise word; no time, no mark of an earlier pass."""
    t = F.regexp_replace(F.trim(text), r"\.$", "")
    shaped = t.rlike(r"(?s)^(\[.*\]|\(.*\))$") & ~F.trim(text).startswith("[...]")
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    own = F.filter(F.split(inner, r"\s+"), lambda w: w != "")
    last = F.lower(F.get(own, F.size(own) - 1))
    return shaped & ~inner.rlike("^[0-9:]*$") & F.size(own).between(1, 4) & (F.octet_length(inner) <= 40) & F.coalesce(last.isin(*NOISE_WORDS), F.lit(False))


def known_phrase(text: Column) -> Column:
    """A phrase that recognisers make of silence, a credit line, or a web address."""
    t = F.trim(F.regexp_replace(F.trim(F.lower(text)), r"[.!?,;:]+$", ""))
    credit = F.lit(False)
    for p in PHRASE_PREFIXES:
        credit = credit | t.startswith(p)
    return (t != "") & (t.isin(*PHRASES) | credit | t.rlike(r"^(www\.|http://|https://)"))


def script(text: Column) -> Column:
    """`latin`, `cjk` or `other`, whichever has half of the letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-zÀ-ɏḀ-ỿ]|[^\p{L}]", ""))
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿㐀-䶿぀-ヿ가-힯]|[^\p{L}]", ""))
    return F.when(letters == 0, None).when(latin * 2 >= letters, "latin").when(cjk * 2 >= letters, "cjk").otherwise("other")


def command(text: Column, wake: str | None = None) -> Column:
    """Ends with a voice command to stop; with a wake word, also with that word and `stop`."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"\.+$", "")
    found = F.lit(False)
    for c in (*COMMANDS, *([f"{wake.lower()} stop"] if wake else [])):
        found = found | t.endswith(c)
    return found
