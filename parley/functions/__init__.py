"""Column expressions: fixed values (``fixed``), text rules (``text``) and
numeric helpers (``audio_math``)."""
