from forecourt.sources.listings import Market, canonical, read_listings

__all__ = ["Market", "canonical", "read_listings"]
