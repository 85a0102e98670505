"""Training-data operators: mixing, sharding, near and exact duplicates, decontamination, language, licence and URL scans."""
