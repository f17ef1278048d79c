"""Training-data operators: near-dedup, decontamination, chat formatting,
toxicity, packing, nearest neighbours, secrets, personal data, sharding and
token files.  Nothing else in docq imports this subpackage."""
