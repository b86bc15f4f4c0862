"""DataFrame -> DataFrame operators.

``text``      pages, character cap, word chunks, ordered re-assembly, cleanup
``requests``  request tables, batch completion (mapInPandas), response fallback
``dialogue``  reply parser, gate, rendering, contracts, transcript lines
``udtf``      the reply parser as a Python table function
``episode``   voices, synthesis results, timelines, pacing, counters, pairs, overlaps, manifests
``audio``     frames, gain, peak, normalisation, filters, compressor, mix, fades, ambience, resampling
``scan``      blocked ordered scans (running sums, previous non-null, totals)
``dims``      size-checked broadcasts and joins of per-key tables
"""
