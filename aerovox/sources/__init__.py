from aerovox.sources.files import (
    flights_in,
    read_flight_stream,
    read_flights,
    read_line_stream,
    read_lines,
    read_utterance_stream,
    read_utterances,
    utterances_in,
    write_utterances,
)
from aerovox.sources.formats import LandedLines, register

__all__ = [
    "LandedLines",
    "flights_in",
    "read_flight_stream",
    "read_flights",
    "read_line_stream",
    "read_lines",
    "read_utterance_stream",
    "read_utterances",
    "register",
    "utterances_in",
    "write_utterances",
]
