"""Limits for cues, and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


# The limits' defaults, the prices of a break and a layout, and marks; they decide results.
@dataclass(frozen=True)
class CueRules:
    """Layout and timing limits of a cue, in characters and seconds."""

    max_line_chars: int = 42
    max_lines: int = 2
    min_duration: float = 0.833
    max_duration: float = 7.0
    target_cps: float = 17.0
    max_cps: float = 20.0
    min_gap: float = 0.083
    max_linger: float = 1.0
    min_linger: float = 1.0
    lead_in: float = 0.1
    split_pause: float = 0.6
    max_word_duration: float = 2.0
    flag_duration: float = 10.0


DEFAULT_RULES = CueRules()
CUE_WORDS = 40
CUE_PRICE, FULLNESS_PRICE, INNER_SENTENCE_PRICE, LONE_WORD_PRICE = 4, 10, 2.5, 6
OVERLONG_PRICE, OVERLONG_S_PRICE, FAST_PRICE, BRISK_PRICE, BRIEF_S_PRICE = 50, 20, 3, 0.3, 4
BREAK_PRICES = {"sentence": 0.0, "clause": 2.0, "other": 6.0, "weak": 8.0, "before": -3.0}
PAUSE_REWARD, PAUSE_MOST_S = 6, 0.6
SPLIT_PRICES = {"sentence": -14, "clause": -8, "weak": 12, "after_sentence": 8, "before": -3}
UNEVEN_PRICE, TOP_HEAVY_PRICE, SPLIT_SHARE = 0.5, 1, 0.4
REPEAT_CHARS, REPEAT_MS, PUSH_MS = 32, 1000, 100
PUNCTUATION = r"^[.,!?;:…%)\]}\"'”’»\-–—]+$"
CONTRACTION = r"(?i)^(?:['’](?:s|t|d|m|re|ll|ve)|n['’]t)$"

# Word lists, phrases and marks whose content decides results.
ABBREVIATIONS = "mr mrs ms dr st prof sr jr vs etc mt lt col gen sgt capt".split()
ABBREVIATIONS_IN_LINES = [a for a in ABBREVIATIONS if a != "etc"]
WEAK_ENDS = (
    "a an the of to in on at by for with from into onto upon about over under after before "
    "and or but nor if as than because while my your his its our their"
).split()
BREAK_BEFORE = (
    "and or but nor so because although though when while where which who whom whose that "
    "if unless until than to of in on at for with from about into after before"
).split()
STOCK_PHRASES = [
    "thank you", "thank you very much", "thanks for watching", "thank you for watching",
    "thanks for watching and see you next time", "please subscribe", "subscribe to my channel",
    "bye", "bye bye", "you", "the end", "subtitles by the amaraorg community", "subtitles by",
    "transcription by",
]
FILLERS = "uh um umm er erm ah hmm mm mhm huh eh".split()
EQUIVALENTS = {"ok": "okay", "mr": "mister", "mrs": "missus"}
ALWAYS_CAPITAL = (
    "i i'm i'll i've i'd god lord mum mom dad sir madam mr mrs ms dr ok okay tv "
    "monday tuesday wednesday thursday friday saturday sunday january february march april "
    "june july august september october november december christmas english"
).split()
CLOSERS = "\"'”’)]}»"
OPENERS = "([{“‘¿¡«"
SUBTITLE_SUFFIXES = ["srt", "ass", "ssa", "vtt", "sub", "idx", "smi"]
TEXT_SUBTITLE_CODECS = ["subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text"]
LANGUAGE_CODES = {
    "en": "eng", "es": "spa", "fr": "fra", "de": "deu", "it": "ita", "pt": "por", "ja": "jpn",
    "ko": "kor", "zh": "zho", "ru": "rus", "nl": "nld", "sv": "swe", "pl": "pol",
}
LAYOUTS_WITHOUT_CENTER = ["quad", "quad(side)", "2.2", "3.0(back)", "6.0(front)", "6.1(front)"]
COMMENTARY_HINTS = ["commentary", "director", "descriptive", "audio description"]
HARDWARE_CODECS = ["h264", "hevc", "av1", "vp9", "vp8", "mpeg2video", "mpeg4", "vc1"]

# Gates and thresholds.
ISOLATION_S, ISOLATED_BELOW, CAPS_BELOW = 4.0, 0.85, 0.5
FLAG_BELOW = 0.6
CLUSTER_S, DOMINANCE = 0.5, 2.0
SNAP_FRAMES, SNAP_LATE_FRAMES, GAP_FRAMES, DEFAULT_FPS = 12, 4, 2, 24.0
REPEATS_KEPT = 3
REPAIR_SPAN_S, REPAIR_PAD_S, REPAIR_SIMILARITY, REPAIR_WORDS = 28.0, 0.3, 0.8, 4
WITHIN_MS = (100, 250, 500)
LOCAL_NEIGHBOURS = 25
QA_BUCKETS = (1, 2, 5, 10, 20, 40, 80, 160)
SILENT_DBFS, SHORTFALL_S = -55.0, 0.25

# What names of files, roles and plots are read by; their content decides results.
RELEASE_WORDS = [
    r"\d{3,4}p", r"web[\s.-]?dl", "webrip", "bluray", "brrip", "hdtv", "x26[45]", r"h\.?26[45]", "hevc", "remux",
]
SEASON_WORDS = ["season", "series", "staffel", "saison"]
CENTURIES = ["19", "20"]
SPOKEN_PARTS = ["Actor", "GuestStar"]
ROLE_NOTES = ["voice", "uncredited", "archive[^)]*"]
NO_NAMES = ["himself", "herself", "themselves", "self", "narrator", "additional voices?"]
TERM = r"[A-Z][a-z]+(?:[-'][A-Z]?[a-z]+)*"
