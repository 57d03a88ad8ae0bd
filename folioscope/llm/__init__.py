"""Training-data operators: deduplication, mixing, packing, language, quality, media and chat.

Nothing else in the package imports this subpackage; the driver contract adds
its queries only where it can be imported.
"""
