"""Training-data operators: language id, quality, packing, decontamination, token counts,
fingerprints, Jaccard join, WARC, URL filters, secret scans, filter interactions, harmonic packing and whitening.

Nothing outside this subpackage imports it; ``registry`` lists its queries and their SQL.
"""
