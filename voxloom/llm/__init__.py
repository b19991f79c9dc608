"""Training-data operators: fingerprints, media, near-duplicates, packing, tokenisation,
language identification, pseudonyms, token counts, id files and toxicity."""
