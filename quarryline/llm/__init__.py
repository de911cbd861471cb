"""Training-data operators: sharding, mixing, toxicity, exact search, chat
formatting, set joins, decontamination, page extraction, quality and language
model scoring.  Nothing outside this subpackage imports it."""
