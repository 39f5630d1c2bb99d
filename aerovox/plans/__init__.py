from aerovox.plans.tables import VIEWS, publish, read_view, refresh_flights, refresh_transcripts, refresh_view

__all__ = ["VIEWS", "publish", "read_view", "refresh_flights", "refresh_transcripts", "refresh_view"]
