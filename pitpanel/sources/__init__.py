"""Readers and writers: candles, articles, lists, archives of requests, manifests."""
