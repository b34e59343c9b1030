"""Training-data operators over a corpus: media, licences, duplicates, quality, tokens, mixing, archives, languages."""
