"""Settings, labels and word lists.

Everything here is a fixed value: results only agree with the message triage
rules this library implements if these stay as they are.  Callers who need
other values pass their own ``Settings`` or word lists to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

VERSION = "0.1.0"


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits shared by the operators."""

    relevance_threshold: float = 0.65
    type_threshold: float = 0.40
    urgency_critical: float = 0.85
    urgency_high: float = 0.65
    urgency_medium: float = 0.40
    duplicate_threshold: float = 0.85
    duplicate_window: int = 500
    max_request_chars: int = 5000
    max_batch_items: int = 100
    model_weight: float = 0.7
    keyword_weight: float = 0.3
    max_tokens: int = 128


DEFAULTS = Settings()

# Relevance candidates, the first one is the crisis label.
RELEVANCE_LABELS = (
    "natural disaster emergency crisis",
    "normal everyday activity",
)

# Event types, description then short label, by position.
EVENT_TYPES = (
    ("rescue and evacuation request", "RESCUE_REQUEST"),
    ("infrastructure and utility damage", "INFRASTRUCTURE_DAMAGE"),
    ("medical emergency and health crisis", "MEDICAL_EMERGENCY"),
    ("food water and supply request", "SUPPLY_REQUEST"),
    ("casualty and death report", "CASUALTY_REPORT"),
    ("volunteer and donation offer", "VOLUNTEER_OFFER"),
    ("situational update and warning", "SITUATIONAL_UPDATE"),
    ("displaced people and shelter need", "DISPLACEMENT"),
)

# Urgency levels from most to least urgent, with the weight of
# the matching candidate score.
URGENCY_LEVELS = (
    ("CRITICAL", 1.0),
    ("HIGH", 0.75),
    ("MEDIUM", 0.5),
    ("LOW", 0.25),
)

# Urgency lexicon, keyword and weight.
CRITICAL_KEYWORDS = {
    "trapped": 0.25, "dying": 0.30, "drowning": 0.30, "buried": 0.25,
    "collapsed": 0.20, "fire": 0.15, "bleeding": 0.25, "unconscious": 0.25,
    "children": 0.10, "baby": 0.15, "pregnant": 0.15, "elderly": 0.10,
    "help us": 0.20, "please help": 0.15, "sos": 0.25, "emergency": 0.15,
    "urgent": 0.15, "immediately": 0.10, "critical": 0.15, "life threatening": 0.25,
    "socorro": 0.20, "ayuda": 0.20, "urgente": 0.15,
    "au secours": 0.20, "aide": 0.15,
    "مساعدة": 0.20, "طوارئ": 0.15,
    "बचाओ": 0.20, "मदद": 0.15,
}
HIGH_KEYWORDS = {
    "injured": 0.10, "damage": 0.08, "destroyed": 0.10, "flood": 0.08,
    "earthquake": 0.08, "casualties": 0.12, "missing": 0.10,
    "evacuation": 0.10, "rescue": 0.10, "survivors": 0.08,
    "medical": 0.08, "hospital": 0.08, "ambulance": 0.10,
}

# Words that make an organisation mention a place.
FACILITY_KEYWORDS = (
    "hospital", "school", "university", "airport", "station",
    "bridge", "church", "mosque", "temple", "shelter",
    "camp", "center", "centre", "building", "tower",
    "stadium", "park", "market", "port", "base",
)

# Link endings that count as media.
MEDIA_MARKS = (".jpg", ".png", ".gif", ".mp4", ".video")

# Map marker colours and icons.
MARKER_COLOURS = {"CRITICAL": "red", "HIGH": "orange", "MEDIUM": "beige", "LOW": "green"}
DEFAULT_COLOUR = "blue"
MARKER_ICONS = {
    "RESCUE_REQUEST": "life-ring",
    "INFRASTRUCTURE_DAMAGE": "building",
    "MEDICAL_EMERGENCY": "plus-sign",
    "SUPPLY_REQUEST": "shopping-cart",
    "CASUALTY_REPORT": "exclamation-sign",
    "VOLUNTEER_OFFER": "hand-up",
    "SITUATIONAL_UPDATE": "info-sign",
    "DISPLACEMENT": "home",
}
DEFAULT_ICON = "info-sign"
DEFAULT_CENTRE = (20.0, 0.0)
HEADING_COLOURS = {"CRITICAL": "#ff4757", "OTHER": "#333"}

# Text patterns.  The word class is letters, numbers and the
# underscore; the space class is Unicode white space.  Java's own \w and \s
# differ from these, so both are spelt out.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
URL_PATTERN = rf"(?i)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
MENTION_PATTERN = rf"@{WORD}+"
HASHTAG_PATTERN = rf"#({WORD}+)"
REPOST_PATTERN = rf"(?i)^RT{SPACE}+@{WORD}+:{SPACE}*"
CAMEL_PATTERN = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"

# Names of common symbols where the short name in use differs
# from the Unicode character name.
SYMBOL_NAMES = {
    "🆘": "SOS_button", "🍕": "pizza", "🚨": "police_car_light", "🌊": "water_wave",
    "🏚": "derelict_house", "🙏": "folded_hands", "😭": "loudly_crying_face",
    "⚠": "warning", "❤": "red_heart", "🏗": "building_construction", "⚕": "medical_symbol",
    "🌧": "cloud_with_rain", "🌨": "cloud_with_snow", "🌩": "cloud_with_lightning",
    "🌪": "tornado", "🌫": "fog", "🏠": "house", "🏡": "house_with_garden",
    "🏥": "hospital", "🏫": "school", "🍽": "fork_and_knife_with_plate",
    "📍": "round_pushpin", "📢": "loudspeaker", "📞": "telephone_receiver",
    "🆓": "FREE_button", "🆗": "OK_button", "🚑": "ambulance", "🚒": "fire_engine",
    "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping_hands", "💪": "flexed_biceps",
    "😢": "crying_face", "😡": "enraged_face", "😱": "face_screaming_in_fear",
    "🤲": "palms_up_together", "🛑": "stop_sign", "❌": "cross_mark", "❗": "red_exclamation_mark",
    "✅": "check_mark_button", "⚡": "high_voltage", "☔": "umbrella_with_rain_drops",
    "⛑": "rescue_worker’s_helmet", "⛺": "tent", "✈": "airplane", "☎": "telephone",
    "♻": "recycling_symbol", "☠": "skull_and_crossbones", "☢": "radioactive", "☣": "biohazard",
}
