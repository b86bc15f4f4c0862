"""Operators for preparing training text: duplicate removal, language
identification, toxicity, personal data, mixing, token counts and benchmark
decontamination.  Nothing else in the library imports this subpackage."""
