"""Sources: file readers (``files``) and the derived inputs built from the
driver tables for tests, oracles and benchmarks (``fixtures``)."""
