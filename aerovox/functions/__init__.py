from aerovox.functions.casts import epoch_timestamp, loose_boolean, loose_double, loose_int, loose_text
from aerovox.functions.text import flight_label, public_callsign, word_count

__all__ = [
    "epoch_timestamp",
    "flight_label",
    "loose_boolean",
    "loose_double",
    "loose_int",
    "loose_text",
    "public_callsign",
    "word_count",
]
