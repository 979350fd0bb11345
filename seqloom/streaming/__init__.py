"""Event-time streams: sessions whose state expires by watermark."""
