"""Training-data operators: licences, near-duplicates, rollups, quality, secrets, personal data, leaks, chat, packing."""
